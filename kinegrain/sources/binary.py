"""Binary files as Python data sources: GLB meshes, NPZ clouds, NPY maps, and files by name.

Readers plan a partition for each run of files of about RUN_BYTES and yield Arrow batches. Writers
put files under a hidden folder of the write, named by the task's attempt; the commit renames them
into place and the folder goes, with whatever failed attempts left in it; an aborted write leaves
nothing. A file's rows must come in one task and in order: ``save_files`` deals and sorts them.

Register the sources of a session with ``register(spark)``; then for instance
``spark.read.format("glb").load(path)`` and ``save_files(df, "npz", path)``.

Paths are local (``file:`` or plain) or anything that Arrow's file systems open.
"""

from __future__ import annotations

import base64
import io
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

RUN_BYTES, BATCH_ROWS = 64 << 20, 1 << 16

COORDINATES = [c + a for c in "pqr" for a in "xyz"]


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _batches(columns: dict[str, object], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Columns (arrays, or single values for all rows) in batches."""
    n = max((len(v) for v in columns.values() if isinstance(v, np.ndarray)), default=0)
    for lo in range(0, n, BATCH_ROWS):
        hi = min(lo + BATCH_ROWS, n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[f.name][lo:hi] if isinstance(columns[f.name], np.ndarray) else [columns[f.name]] * (hi - lo), f.type) for f in schema], schema=schema
        )


# --- GLB

# Fixed values of the format: magic, chunk types, component types, numbers of an element.
GLB_MAGIC, GLB_JSON, GLB_BIN = 0x46546C67, 0x4E4F534A, 0x004E4942
COMPONENTS = {5120: "<i1", 5121: "<u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}
WIDTHS = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4, "MAT2": 4, "MAT3": 9, "MAT4": 16}
TRIANGLES, STRIP, FAN = 4, 5, 6


def glb_chunks(content: bytes) -> tuple[dict, bytes]:
    """(document, binary chunk) of a GLB file."""
    magic, version, length = struct.unpack_from("<III", content)
    if magic != GLB_MAGIC or version != 2 or length > len(content):
        raise ValueError("not a GLB file of version 2")
    at, document, data = 12, None, b""
    while at + 8 <= length:
        size, kind = struct.unpack_from("<II", content, at)
        body = content[at + 8 : at + 8 + size]
        if kind == GLB_JSON:
            document = json.loads(body)
        elif kind == GLB_BIN and not data:
            data = body
        at += 8 + size
    if document is None:
        raise ValueError("a GLB file without a document")
    return document, data


def _buffer(document: dict, number: int, data: bytes) -> bytes:
    uri = document["buffers"][number].get("uri")
    if uri is None:
        return data
    if not uri.startswith("data:"):
        raise ValueError(f"a buffer outside of the file: {uri}")
    return base64.b64decode(uri.partition(",")[2])


def _view(document: dict, number: int, data: bytes, offset: int, count: int, kind: np.dtype, width: int) -> np.ndarray:
    view = document["bufferViews"][number]
    raw = _buffer(document, view["buffer"], data)
    start, step = view.get("byteOffset", 0) + offset, view.get("byteStride") or kind.itemsize * width
    return np.ndarray((count, width), kind, raw, start, (step, kind.itemsize)).copy()


def accessor(document: dict, number: int, data: bytes) -> np.ndarray:
    """The elements of an accessor (count x width), normalised integers as fractions, sparse ones filled in."""
    a = document["accessors"][number]
    kind, width, count = np.dtype(COMPONENTS[a["componentType"]]), WIDTHS[a["type"]], a["count"]
    out = np.zeros((count, width), kind) if "bufferView" not in a else _view(document, a["bufferView"], data, a.get("byteOffset", 0), count, kind, width)
    if s := a.get("sparse"):
        where, what = s["indices"], s["values"]
        at = _view(document, where["bufferView"], data, where.get("byteOffset", 0), s["count"], np.dtype(COMPONENTS[where["componentType"]]), 1)
        out[at[:, 0]] = _view(document, what["bufferView"], data, what.get("byteOffset", 0), s["count"], kind, width)
    if a.get("normalized") and kind.kind in "iu":
        return np.maximum(out / np.iinfo(kind).max, -1.0)
    return out


def node_matrix(node: dict) -> np.ndarray:
    """A node's own transform: its matrix (stored by columns), or scale, then rotation (a quaternion), then translation."""
    if "matrix" in node:
        return np.array(node["matrix"], float).reshape(4, 4).T
    x, y, z, w = node.get("rotation", (0, 0, 0, 1))
    turn = np.array(
        [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
    )
    out = np.eye(4)
    out[:3, :3] = turn * np.array(node.get("scale", (1, 1, 1)), float)
    out[:3, 3] = node.get("translation", (0, 0, 0))
    return out


def _corner_rows(mode: int, order: np.ndarray) -> np.ndarray:
    """Triangles (n x 3) of a primitive's vertices in order."""
    if mode == TRIANGLES:
        return order[: len(order) // 3 * 3].reshape(-1, 3)
    if mode not in (STRIP, FAN) or len(order) < 3:
        return np.zeros((0, 3), order.dtype)
    k = np.arange(len(order) - 2)
    if mode == FAN:
        return np.stack([np.full(len(k), order[0]), order[k + 1], order[k + 2]], axis=1)
    odd = k % 2
    return np.stack([order[k], order[k + 1 + odd], order[k + 2 - odd]], axis=1)


def glb_geometries(content: bytes) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(name, points in the scene's frame, triangles) of each triangle primitive, in the order of the scene's nodes."""
    document, data = glb_chunks(content)
    nodes = document.get("nodes", [])
    below = {c for n in nodes for c in n.get("children", ())}
    scenes = document.get("scenes")
    roots = scenes[document.get("scene", 0)].get("nodes", []) if scenes else [i for i in range(len(nodes)) if i not in below]
    walk, seen = [(i, np.eye(4)) for i in reversed(roots)], set()
    while walk:
        i, above = walk.pop()
        if i in seen:
            raise ValueError("a node with two parents")
        seen.add(i)
        node = nodes[i]
        matrix = above @ node_matrix(node)
        walk += [(c, matrix) for c in reversed(node.get("children", []))]
        if "mesh" not in node:
            continue
        mesh = document["meshes"][node["mesh"]]
        name = node.get("name") or mesh.get("name") or f"node_{i}"
        for primitive in mesh["primitives"]:
            if "POSITION" not in primitive["attributes"]:
                continue
            points = accessor(document, primitive["attributes"]["POSITION"], data).astype(float)
            order = accessor(document, primitive["indices"], data)[:, 0].astype(np.int64) if "indices" in primitive else np.arange(len(points))
            faces = _corner_rows(primitive.get("mode", TRIANGLES), order)
            if np.linalg.det(matrix[:3, :3]) < 0:  # a mirrored mesh would face inward
                faces = faces[:, ::-1]
            yield name, points @ matrix[:3, :3].T + matrix[:3, 3], faces


def glb_bytes(parts: list[tuple[str, np.ndarray]]) -> bytes:
    """A GLB file with a node and a mesh for each (name, triangles: n x 9), equal corners of a part stored once."""
    document: dict = {"asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": list(range(len(parts)))}], "nodes": [], "meshes": [], "accessors": [], "bufferViews": []}
    data = b""
    for k, (name, triangles) in enumerate(parts):
        points, order = np.unique(triangles.reshape(-1, 3).astype("<f4"), axis=0, return_inverse=True)
        document["nodes"].append({"name": name, "mesh": k})
        document["meshes"].append({"name": name, "primitives": [{"attributes": {"POSITION": 2 * k}, "indices": 2 * k + 1, "mode": TRIANGLES}]})
        for values, kind, of, target in ((points, 5126, "VEC3", 34962), (order.astype("<u4").ravel(), 5125, "SCALAR", 34963)):
            raw = values.tobytes()
            document["bufferViews"].append({"buffer": 0, "byteOffset": len(data), "byteLength": len(raw), "target": target})
            bounds = {"min": values.min(axis=0).tolist(), "max": values.max(axis=0).tolist()} if of == "VEC3" else {}
            document["accessors"].append({"bufferView": len(document["bufferViews"]) - 1, "componentType": kind, "count": len(values), "type": of, **bounds})
            data += raw
    document["buffers"] = [{"byteLength": len(data)}]
    text = json.dumps(document, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 4)
    data += b"\0" * (-len(data) % 4)
    chunks = struct.pack("<II", len(text), GLB_JSON) + text + struct.pack("<II", len(data), GLB_BIN) + data
    return struct.pack("<III", GLB_MAGIC, 2, 12 + len(chunks)) + chunks


# --- kinds of files


def _stem(path: str, ending: str) -> str:
    return path.rsplit("/", 1)[-1].removesuffix(ending)


class Glb:
    """file, geometry, name, fid, px..rz: a row for each triangle, fid counted over the file."""

    ending = ".glb"
    schema = pa.schema([("file", pa.string()), ("geometry", pa.int32()), ("name", pa.string()), ("fid", pa.int64()), *[(c, pa.float64()) for c in COORDINATES]])
    order = ["name", "fid"]

    @staticmethod
    def read(path: str, content: bytes) -> Iterator[pa.RecordBatch]:
        before = 0
        for k, (name, points, faces) in enumerate(glb_geometries(content)):
            flat = points[faces].reshape(-1, 9)
            rows = {"file": _stem(path, Glb.ending), "geometry": k, "name": name, "fid": np.arange(before, before + len(flat)), **{c: flat[:, i] for i, c in enumerate(COORDINATES)}}
            yield from _batches(rows, Glb.schema)
            before += len(flat)

    @staticmethod
    def write(rows: pa.Table) -> bytes:
        names = rows["name"].to_pylist()
        flat = np.stack([rows[c].to_numpy() for c in COORDINATES], axis=1)
        cuts = [k for k in range(len(names)) if not k or names[k] != names[k - 1]]
        return glb_bytes([(names[lo] or "", flat[lo:hi]) for lo, hi in zip(cuts, [*cuts[1:], len(names)])])


class Npz:
    """file, idx, x..z, r..b, nx..nz: clouds with the arrays point, color and normal (absent normals are 0)."""

    ending = ".npz"
    schema = pa.schema([("file", pa.string()), ("idx", pa.int64()), *[(a, pa.float32()) for a in "xyz"], *[(a, pa.uint8()) for a in "rgb"], *[(f"n{a}", pa.float32()) for a in "xyz"]])
    spark_schema = "file string, idx long, x float, y float, z float, r short, g short, b short, nx float, ny float, nz float"
    order = ["idx"]
    arrays = {"point": (["x", "y", "z"], "<f4"), "color": (["r", "g", "b"], "u1"), "normal": (["nx", "ny", "nz"], "<f4")}

    @staticmethod
    def read(path: str, content: bytes) -> Iterator[pa.RecordBatch]:
        with np.load(io.BytesIO(content)) as z:
            found = {n: z[n] for n in z.files if n in Npz.arrays}
        n = len(found["point"])
        found.setdefault("normal", np.zeros((n, 3), "<f4"))
        if any(found.get(k) is None or found[k].shape != (n, 3) for k in Npz.arrays):
            raise ValueError(f"{path}: arrays of different shapes")
        rows = {c: found[k][:, i] for k, (names, _) in Npz.arrays.items() for i, c in enumerate(names)}
        kinds = pa.schema([(f.name, pa.int16() if f.name in "rgb" else f.type) for f in Npz.schema])
        yield from _batches({"file": _stem(path, Npz.ending), "idx": np.arange(n), **rows}, kinds)

    @staticmethod
    def write(rows: pa.Table) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **{k: np.stack([rows[c].to_numpy() for c in names], axis=1).astype(kind) for k, (names, kind) in Npz.arrays.items()})
        return out.getvalue()


class Npy:
    """file, layer, row, col, value: maps of two or three dimensions (layers first); a written map holds 0 where it has no row."""

    ending = ".npy"
    schema = pa.schema([("file", pa.string()), ("layer", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("value", pa.int64())])
    order = ["layer", "row", "col"]

    @staticmethod
    def read(path: str, content: bytes) -> Iterator[pa.RecordBatch]:
        a = np.load(io.BytesIO(content), allow_pickle=False)
        a = a[None] if a.ndim == 2 else a
        if a.ndim != 3 or a.dtype.kind not in "iub":
            raise ValueError(f"{path}: not a map of whole numbers")
        layer, row, col = (x.ravel() for x in np.indices(a.shape))
        yield from _batches({"file": _stem(path, Npy.ending), "layer": layer, "row": row, "col": col, "value": a.ravel().astype(np.int64)}, Npy.schema)

    @staticmethod
    def write(rows: pa.Table) -> bytes:
        at = [rows[c].to_numpy() for c in ("layer", "row", "col")]
        plane = np.zeros([int(x.max()) + 1 for x in at], np.int32)
        plane[tuple(at)] = rows["value"].to_numpy()
        out = io.BytesIO()
        np.save(out, plane)
        return out.getvalue()


class Named:
    """file, content: whole files by their names, which may have folders."""

    ending = ""
    schema = pa.schema([("file", pa.string()), ("content", pa.binary())])
    order: list[str] = []

    @staticmethod
    def read(path: str, content: bytes) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"file": [path], "content": [content]}, Named.schema)

    @staticmethod
    def write(rows: pa.Table) -> bytes:
        return rows["content"][0].as_py() or b""


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, kind, path: str):
        self.kind, self.path = kind, path

    def partitions(self) -> list[Files]:
        files, root = filesystem(self.path)
        info = files.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        listed = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(root, recursive=True))
        hidden = lambda p: any(x.startswith((".", "_")) for x in p[len(root) :].split("/"))
        listed = sorted((f.path, f.size) for f in listed if f.type == fs.FileType.File and f.path.endswith(self.kind.ending) and not hidden(f.path))
        runs: list[list[str]] = []
        held = RUN_BYTES
        for path, size in listed:
            if held + size > RUN_BYTES:
                runs.append([])
                held = 0
            runs[-1].append(path)
            held += size
        return [Files(x) for x in runs]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, _ = filesystem(self.path)
        for path in partition.paths if partition else ():
            with files.open_input_stream(path) as f:
                yield from self.kind.read(path, f.read())


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)


class _Writer(DataSourceArrowWriter):
    def __init__(self, kind, path: str, overwrite: bool):
        self.kind, self.path, self.overwrite = kind, path, overwrite
        self.staging = f".staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        files, root = filesystem(self.path)
        attempt = TaskContext.get().taskAttemptId()
        done: list[tuple[str, str]] = []
        name, held = None, []

        def flush() -> None:
            if held:
                staged = f"{root}/{self.staging}/{attempt}-{len(done)}"
                files.create_dir(f"{root}/{self.staging}", recursive=True)
                with files.open_output_stream(staged) as out:
                    out.write(self.kind.write(pa.Table.from_batches(held)))
                done.append((staged, f"{root}/{name}{self.kind.ending}"))
                held.clear()

        seen = set()
        for batch in iterator:
            names = batch["file"].to_pylist()
            cuts = [k for k in range(len(names)) if not k or names[k] != names[k - 1]]
            for lo, hi in zip(cuts, [*cuts[1:], len(names)]):
                if names[lo] != name:
                    flush()
                    name = names[lo]
                    if name is None or ".." in name.split("/"):
                        raise ValueError(f"not a file's name: {name}")
                    if name in seen:
                        raise ValueError(f"the rows of {name} are not together")
                    seen.add(name)
                held.append(batch.slice(lo, hi - lo))
        flush()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = filesystem(self.path)
        moved = [pair for m in messages if m for pair in m.files]
        targets = [t for _, t in moved]
        if len(set(targets)) != len(targets):
            self.abort(messages)
            raise ValueError("a file was written by two tasks")
        if self.overwrite and files.get_file_info(root).type == fs.FileType.Directory:
            for old in files.get_file_info(fs.FileSelector(root, recursive=True)):
                if old.type == fs.FileType.File and self.staging not in old.path and old.path not in targets:
                    files.delete_file(old.path)
        for folder in {t.rsplit("/", 1)[0] for t in targets}:
            files.create_dir(folder, recursive=True)
        for staged, target in moved:
            files.move(staged, target)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        files, root = filesystem(self.path)
        if files.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.staging}")


def _source(label: str, kind) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self):
            if hasattr(kind, "spark_schema"):
                return kind.spark_schema
            from pyspark.sql.pandas.types import from_arrow_schema

            return from_arrow_schema(kind.schema)

        def reader(self, schema) -> _Reader:
            return _Reader(kind, self.options["path"])

        def writer(self, schema, overwrite: bool) -> _Writer:
            return _Writer(kind, self.options["path"], overwrite)

    Source.__name__ = Source.__qualname__ = f"{kind.__name__}Source"
    return Source


KINDS = {"glb": Glb, "npz": Npz, "npy": Npy, "named_files": Named}
GlbSource, NpzSource, NpySource, NamedSource = (_source(n, k) for n, k in KINDS.items())


def register(spark: SparkSession) -> SparkSession:
    """The session with the data sources glb, npz, npy and named_files."""
    for source in (GlbSource, NpzSource, NpySource, NamedSource):
        spark.dataSource.register(source)
    return spark


def save_files(rows: DataFrame, kind: str, path: str, overwrite: bool = False) -> None:
    """Writes rows (file, ...) as files of a kind: each file's rows in one task, in the kind's order. A file is one object and fits in memory."""
    k = KINDS[kind]
    dealt = rows.select(*[f.name for f in k.schema if f.name in rows.columns]).repartition("file").sortWithinPartitions("file", *k.order)
    register(rows.sparkSession)
    dealt.write.format(kind).mode("overwrite" if overwrite else "append").save(path)
