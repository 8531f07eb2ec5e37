"""Records, annotations, point clouds and meshes as tables."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsonv import parse_json


def json_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, text: every *.json below the paths once, whole."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(paths, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).dropDuplicates(["path"])


def records(files: DataFrame) -> DataFrame:
    """path, pos, record, error: one object, a list, or {"records": [...]} for each file; what can't be read is a row with an error."""
    v = files.withColumn("v", parse_json(F.col("text")))
    kind = F.schema_of_variant("v")
    listed = F.when(kind.startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).otherwise(F.try_variant_get("v", "$.records", "array<variant>"))
    items = F.when(F.col("v").isNull(), F.array(F.lit(None).cast("variant"))).when(listed.isNotNull(), listed).otherwise(F.array("v"))
    rows = v.select("path", F.posexplode(items).alias("pos", "record"))
    bad = F.when(F.col("record").isNull(), "not JSON").when(~F.schema_of_variant("record").startswith("OBJECT"), "not an object")
    return rows.select("path", "pos", "record", bad.alias("error"))


def annotations(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(objects: entity, v; parts: entity, part, v) of annotations/object.json and part_<id>.json trees; parts need their object."""
    files = json_files(spark, [root])
    entity = F.regexp_extract("path", r"([^/]+)/annotations/[^/]+$", 1)
    part = F.regexp_extract("path", r"(?i)/part_(\d+)\.json$", 1)
    rows = files.select(entity.alias("entity"), part.alias("part"), F.col("path").endswith("/object.json").alias("is_object"), parse_json(F.col("text")).alias("v")).where("entity <> ''")
    objects = rows.where("is_object").select("entity", "v")
    parts = rows.where("part <> ''").select("entity", "part", "v").join(objects.select("entity"), "entity", "left_semi")
    return objects, parts


def npz_points(spark: SparkSession, path: str) -> DataFrame:
    """cloud, idx, x..z, r..b, nx..nz of NPZ files with point, color and normal arrays of one length; normals may be absent."""
    import numpy as np

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for name, content in zip(pdf["path"], pdf["content"]):
                z = np.load(io.BytesIO(content))
                p, c = z["point"], z["color"]
                n = z["normal"] if "normal" in z.files else np.zeros_like(p)
                if not (p.shape == c.shape == n.shape and p.ndim == 2 and p.shape[1] == 3):
                    raise ValueError(f"{name}: arrays of different shapes")
                for k in range(0, len(p), 65536):
                    few = slice(k, k + 65536)
                    yield pd.DataFrame({"cloud": name, "idx": np.arange(k, k + len(p[few])), **{a: p[few, i] for i, a in enumerate("xyz")}, **{a: c[few, i].astype("int16") for i, a in enumerate("rgb")}, **{f"n{a}": n[few, i] for i, a in enumerate("xyz")}})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(read, "cloud string, idx long, x float, y float, z float, r short, g short, b short, nx float, ny float, nz float")


def obj_meshes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(points: file, idx, x, y, z; faces: file, fid, v0, v1, v2) of OBJ files, numbered in each file's order.

    Rows are numbered within a file's blocks, and blocks by the sums of those before them, so that a large file is not ordered by one task.
    """
    from pyspark.sql import Window

    from ..operators.mesh import parse_obj

    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))

    def numbered(rows: DataFrame, name: str) -> DataFrame:
        sums = rows.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        base = sums.select("file", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
        inner = rows.withColumn("_r", F.row_number().over(Window.partitionBy("file", "_block").orderBy("_at")) - 1)
        return inner.join(base, ["file", "_block"]).select("file", (F.col("_base") + F.col("_r")).alias(name), *[c for c in rows.columns if c not in ("file", "_block", "_at")])

    v, f = parse_obj(lines, keep=["file", "_block", "_at"])
    return numbered(v, "idx"), numbered(f, "fid")


def obj_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(points: idx, x, y, z; faces: fid, v0, v1, v2) of one OBJ file, numbered in file order."""
    points, faces = obj_meshes(spark, path)
    return points.drop("file"), faces.drop("file")


#: Extensions of dataset files and the reader of each.
FORMATS = {"csv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet", "txt": "text", "orc": "orc"}


def dataset(spark: SparkSession, path: str) -> DataFrame:
    """A dataset by its extension; a folder's files must share one."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    kinds = {n.rsplit(".", 1)[-1].lower() for n in names if not n.startswith(("_", "."))}
    if len(kinds) != 1 or not kinds <= set(FORMATS):
        raise ValueError(f"one known kind of file is needed, not {sorted(kinds)}")
    reader = spark.read.format(FORMATS[kinds.pop()])
    return reader.option("header", "true").load(path)


def binary_listing(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path, stem, length of files; what media probes join with."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return f.select("path", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1).alias("stem"), "length")


def name_clashes(files: DataFrame) -> DataFrame:
    """Lower-case stems that more than one file has."""
    return files.groupBy(F.lower("stem").alias("stem")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
