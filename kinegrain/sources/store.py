"""Stored intermediate tables and sinks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``; only where that is unset, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="kinegrain-")
        root = _LOCAL[app]
    return f"{root.rstrip('/')}/kinegrain"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df through a Parquet table in the shared folder: cuts the lineage, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kinegrain_path = path
    return out


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path of any kind."""
    context = spark.sparkContext
    p = context._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(context._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its place and renamed into it; one that is there gives way."""
    fs, p = _hadoop(spark, path)
    _, staged = _hadoop(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    out = fs.create(staged, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(p):
        fs.delete(p, False)
    fs.rename(staged, p)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if it isn't there."""
    fs, p = _hadoop(spark, path)
    if not fs.exists(p):
        return None
    with_all = spark.sparkContext._jvm.org.apache.commons.io.IOUtils
    stream = fs.open(p)
    try:
        return with_all.toString(stream, "UTF-8")
    finally:
        stream.close()


def list_files(spark: SparkSession, path: str, ending: str, folders: bool = False) -> list[str]:
    """Paths in a folder, sorted, without hidden ones; none if it isn't there."""
    fs, p = _hadoop(spark, path)
    if not fs.exists(p):
        return []
    found = [s for s in fs.listStatus(p) if bool(s.isDirectory()) == folders]
    names = [s.getPath().getName() for s in found]
    return sorted(f"{path.rstrip('/')}/{n}" for n in names if n.endswith(ending) and not n.startswith((".", "_")))


def discard(*frames: DataFrame) -> None:
    """Deletes tables of stored() that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_kinegrain_path", None):
            delete(df.sparkSession, path)


def write_json_lines(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """JSON lines, in a folder for each value of ``by``; the committer makes the write atomic."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).json(path)


def write_strict_json(df: DataFrame, path: str) -> None:
    """JSON lines without NaN and infinities: raises if a double column has one."""
    doubles = [n for n, t in df.dtypes if t in ("double", "float")]
    bad = [F.count_if(F.isnan(n) | (F.abs(F.col(n)) == float("inf"))).alias(n) for n in doubles]
    if bad and any(df.agg(*bad).first()):
        raise ValueError("not a JSON number")
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_text(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)


def append_rejects(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def cached_dataset(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at path; built and written first if it is not there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        build().write.parquet(path)
    return spark.read.parquet(path)
