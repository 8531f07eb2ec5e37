"""Files of clouds, meshes and face images: PLY, OBJ with MTL, one OBJ for each part, EXR."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Names of PLY's numbers, and of EXR's pixel types and line blocks by compression.
PLY_TYPES = {
    "char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8",
    "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8",
}
EXR_TYPES = {0: "<u4", 1: "<f2", 2: "<f4"}
EXR_LINES = {0: 1, 2: 1, 3: 16}
EXR_MAGIC = 20000630


def read_ply(content: bytes) -> pd.DataFrame:
    """The vertex element's scalar properties as columns; ascii and both binary orders. It must be the first element."""
    end = content.index(b"end_header")
    start = content.index(b"\n", end) + 1
    form, names, types, count, element = "", [], [], 0, 0
    for words in (line.split() for line in content[:end].decode("ascii").splitlines()):
        if words[:1] == ["format"]:
            form = words[1]
        elif words[:1] == ["element"]:
            element += 1
            if element == 1:
                if words[1] != "vertex":
                    raise ValueError("vertices must come first")
                count = int(words[2])
        elif words[:1] == ["property"] and element == 1:
            if words[1] == "list":
                raise ValueError("a list among the vertices' properties")
            types.append(PLY_TYPES[words[1]])
            names.append(words[2])
    if form == "ascii":
        rows = np.loadtxt(io.BytesIO(content[start:]), max_rows=count, ndmin=2) if count else np.empty((0, len(names)))
        return pd.DataFrame({n: rows[:, i] for i, n in enumerate(names)})
    order = {"binary_little_endian": "<", "binary_big_endian": ">"}[form]
    kind = np.dtype([(n, order + t) for n, t in zip(names, types)])
    rows = np.frombuffer(content, kind, count, start)
    return pd.DataFrame({n: rows[n].astype("f8") for n in names})


PLY_SCHEMA = "cloud string, idx long, x double, y double, z double, r double, g double, b double"
EXR_SCHEMA = "view string, row int, col int, face_id long"


def ply_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """PLY_SCHEMA's rows of (path, content)."""
    for pdf in parts:
        for name, content in zip(pdf["path"], pdf["content"]):
            v = read_ply(content)
            for k in range(0, len(v), 65536):
                few = v.iloc[k : k + 65536]
                colours = {a: few[n] if n in few else np.nan for a, n in zip("rgb", ("red", "green", "blue"))}
                yield pd.DataFrame({"cloud": name, "idx": few.index, **{a: few[a] for a in "xyz"}, **colours})


def ply_points(spark: SparkSession, path: str) -> DataFrame:
    """cloud, idx, x, y, z, r, g, b (null without colours) of PLY files; each file is read whole by one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(ply_rows, PLY_SCHEMA)


def label_colours(labels: DataFrame, palette: list[tuple[int, int, int]]) -> DataFrame:
    """label, r, g, b: distinct labels in order take the palette's colours, spread over it; ``labels`` has one row a label."""
    ranked = labels.select("label").distinct().withColumn("_r", F.row_number().over(Window.orderBy("label")) - 1)
    n = labels.select("label").distinct().agg(F.count(F.lit(1))).scalar()
    colours = F.array(*[F.array(*map(F.lit, rgb)) for rgb in palette])
    at = F.least(F.lit(len(palette) - 1), F.floor(F.coalesce(F.try_divide(F.col("_r"), n - 1), F.lit(0.0)) * len(palette)))
    picked = ranked.withColumn("_c", F.get(colours, at.cast("int")))
    return picked.select("label", *[F.col("_c")[i].alias(a) for i, a in enumerate("rgb")])


def ply_lines(points: DataFrame) -> DataFrame:
    """ASCII PLY of points (idx, x, y, z, r, g, b) as lines in file order."""
    names = [f"property double {a}" for a in "xyz"] + [f"property uchar {a}" for a in ("red", "green", "blue")]
    count = points.agg(F.count(F.lit(1))).scalar()
    spark = points.sparkSession
    head = spark.range(1, numPartitions=1).select(
        F.lit(0).alias("kind"), F.lit(0).cast("long").alias("at"), F.concat(F.lit("ply\nformat ascii 1.0\nelement vertex "), count.cast("string"), F.lit("\n" + "\n".join(names) + "\nend_header")).alias("line")
    )
    body = points.select(F.lit(1).alias("kind"), F.col("idx").cast("long").alias("at"), F.concat_ws(" ", *[F.col(a).cast("double").cast("string") for a in "xyz"], *[F.col(a).cast("int").cast("string") for a in "rgb"]).alias("line"))
    return head.unionByName(body).orderBy("kind", "at").select("line")


def _numbers(letter: str, form: str, columns: list[Column]) -> Column:
    return F.format_string(f"{letter} {form} {form} {form}", *columns)


def material_obj_lines(points: DataFrame, faces: DataFrame, library: str) -> DataFrame:
    """OBJ lines that use material m1 of an MTL file; corners are written as they are."""
    v = points.select(F.lit(1).alias("kind"), F.col("idx").cast("long").alias("at"), _numbers("v", "%f", [F.col(a).cast("double") for a in "xyz"]).alias("line"))
    f = faces.select(F.lit(2).alias("kind"), F.col("fid").cast("long").alias("at"), _numbers("f", "%d", [F.col(a).cast("long") for a in ("v0", "v1", "v2")]).alias("line"))
    head = points.sparkSession.range(1, numPartitions=1).select(F.lit(0).alias("kind"), F.col("id").alias("at"), F.lit(f"mtllib {library}\nusemtl m1").alias("line"))
    return head.unionByName(v).unionByName(f).orderBy("kind", "at").select("line")


def mtl_text(colour: tuple[float, float, float]) -> str:
    return "newmtl m1\nKd %f %f %f\nKa 0 0 0\n" % tuple(colour)


def part_meshes(faces: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points: number, part, idx, x, y, z; faces: number, part, fid, v0, v1, v2) of each part as a mesh of its own.

    Parts are numbered from 1 by their first face, a part's vertices from 0 in their old order.
    """
    first = faces.groupBy("part").agg(F.min("fid").alias("_f"))
    # a row for each part
    number = first.select("part", F.row_number().over(Window.orderBy("_f")).alias("number"))
    long = faces.select("part", "fid", F.posexplode(F.array("v0", "v1", "v2")).alias("_k", "_v"))
    used = long.select("part", "_v").distinct().withColumn("_new", F.row_number().over(Window.partitionBy("part").orderBy("_v")) - 1)
    corners = long.join(used, ["part", "_v"]).groupBy("part", "fid").agg(*[F.max(F.when(F.col("_k") == k, F.col("_new"))).alias(f"v{k}") for k in range(3)])
    own = used.join(points.select(F.col("idx").alias("_v"), *"xyz"), "_v").select("part", F.col("_new").alias("idx"), *"xyz")
    return own.join(number, "part").select("number", "part", "idx", *"xyz"), corners.join(number, "part").select("number", "part", "fid", "v0", "v1", "v2")


def part_obj_lines(points: DataFrame, faces: DataFrame) -> DataFrame:
    """number, line: OBJ lines of each part's mesh, in file order within a part; corners from 1."""
    v = points.select("number", F.lit(0).alias("kind"), F.col("idx").cast("long").alias("at"), F.concat_ws(" ", F.lit("v"), *[F.col(a).cast("string") for a in "xyz"]).alias("line"))
    f = faces.select("number", F.lit(1).alias("kind"), F.col("fid").cast("long").alias("at"), F.concat_ws(" ", F.lit("f"), *[(F.col(a) + 1).cast("string") for a in ("v0", "v1", "v2")]).alias("line"))
    return v.unionByName(f).repartition("number").sortWithinPartitions("number", "kind", "at").select("number", "line")


def write_part_objs(points: DataFrame, faces: DataFrame, path: str) -> None:
    """A folder number=<k> with one OBJ text for each part."""
    part_obj_lines(points, faces).write.mode("overwrite").partitionBy("number").text(path)


def exr_bytes(plane: np.ndarray) -> bytes:
    """An uncompressed EXR with one float plane as its B, G and R."""
    h, w = plane.shape
    box = struct.pack("<4i", 0, 0, w - 1, h - 1)
    attribute = lambda name, kind, data: name.encode() + b"\0" + kind.encode() + b"\0" + struct.pack("<i", len(data)) + data
    channels = b"".join(n + b"\0" + struct.pack("<iBxxxii", 2, 0, 1, 1) for n in (b"B", b"G", b"R")) + b"\0"
    head = struct.pack("<ii", EXR_MAGIC, 2) + attribute("channels", "chlist", channels) + attribute("compression", "compression", b"\0")
    head += attribute("dataWindow", "box2i", box) + attribute("displayWindow", "box2i", box) + attribute("lineOrder", "lineOrder", b"\0")
    head += attribute("pixelAspectRatio", "float", struct.pack("<f", 1)) + attribute("screenWindowCenter", "v2f", struct.pack("<ff", 0, 0))
    head += attribute("screenWindowWidth", "float", struct.pack("<f", 1)) + b"\0"
    size = 8 + 12 * w
    start = len(head) + 8 * h
    offsets = struct.pack(f"<{h}Q", *range(start, start + size * h, size))
    rows = plane.astype("<f4")
    return head + offsets + b"".join(struct.pack("<ii", y, size - 8) + rows[y].tobytes() * 3 for y in range(h))


def read_exr(content: bytes, channel: str = "R") -> np.ndarray:
    """One channel of a scan-line EXR, uncompressed or by ZIP, as floats."""
    magic, version = struct.unpack_from("<ii", content)
    if magic != EXR_MAGIC or version & 0x1A00:
        raise ValueError("not a single-part scan-line EXR")
    at, found = 8, {}
    while content[at]:
        name_end = content.index(b"\0", at)
        kind_end = content.index(b"\0", name_end + 1)
        (n,) = struct.unpack_from("<i", content, kind_end + 1)
        found[content[at:name_end].decode()] = content[kind_end + 5 : kind_end + 5 + n]
        at = kind_end + 5 + n
    x0, y0, x1, y1 = struct.unpack("<4i", found["dataWindow"])
    w, h, how = x1 - x0 + 1, y1 - y0 + 1, found["compression"][0]
    if how not in EXR_LINES:
        raise ValueError(f"EXR compression {how}")
    kinds, rest = [], found["channels"]
    while rest[0]:
        end = rest.index(b"\0")
        kinds.append((rest[:end].decode(), np.dtype(EXR_TYPES[struct.unpack_from("<i", rest, end + 1)[0]])))
        rest = rest[end + 17 :]
    skip = 0
    for name, kind in kinds:
        if name == channel:
            break
        skip += kind.itemsize * w
    else:
        raise ValueError(f"no channel {channel}")
    line = sum(k.itemsize for _, k in kinds) * w
    out = np.empty((h, w))
    for offset in struct.unpack_from(f"<{-(-h // EXR_LINES[how])}Q", content, at + 1):
        y, n = struct.unpack_from("<ii", content, offset)
        lines = min(EXR_LINES[how], y1 - y + 1)
        data = content[offset + 8 : offset + 8 + n]
        if how and n < line * lines:
            # ZIP: differences of bytes, whose even and odd places stand in two halves
            flat = np.frombuffer(zlib.decompress(data), "u1").astype("i8")
            flat[1:] -= 128
            flat = np.cumsum(flat).astype("u1")
            both = np.empty(len(flat), "u1")
            both[0::2], both[1::2] = flat[: (len(flat) + 1) // 2], flat[(len(flat) + 1) // 2 :]
            data = both.tobytes()
        for i in range(lines):
            out[y - y0 + i] = np.frombuffer(data, kind, w, i * line + skip)
    return out


def exr_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """EXR_SCHEMA's rows of (view, content): the R channel."""
    for pdf in parts:
        for name, content in zip(pdf["view"], pdf["content"]):
            for y, values in enumerate(read_exr(content)):
                yield pd.DataFrame({"view": name, "row": y, "col": np.arange(len(values)), "face_id": values.astype("i8")})


def exr_pixels(spark: SparkSession, path: str) -> DataFrame:
    """view, row, col, face_id of EXR files, a view for each file's stem."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.exr").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.exr$", 1).alias("view"), "content").mapInPandas(exr_rows, EXR_SCHEMA)


def exr_files(pixels: DataFrame) -> DataFrame:
    """view, content: one EXR for each view of pixels (view, row, col, face_id); places without a pixel are 0. A view is one image in one task."""

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        plane = np.zeros((pdf["row"].max() + 1, pdf["col"].max() + 1), "f4")
        plane[pdf["row"], pdf["col"]] = pdf["face_id"]
        return pd.DataFrame({"view": [pdf["view"].iloc[0]], "content": [exr_bytes(plane)]})

    return pixels.select("view", "row", "col", "face_id").groupBy("view").applyInPandas(encode, "view string, content binary")
