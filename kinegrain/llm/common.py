"""Helpers that the training-data operators share.

Intermediate tables go to the shared folder that ``spark.checkpoint.dir`` names,
as Parquet: they cut the lineage, every executor can read them, and an executor
that is lost takes nothing with it.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, for Python's re and for Java's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset (tests), a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="kinegrain-")
        root = _LOCAL[app]
    return f"{root.rstrip('/')}/kinegrain"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of a batch that a stored table's Python functions get, so that batches of long texts stay small.
BATCH_ROWS = 1024
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back with the same schema."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    usual = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, BATCH_ROWS)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, usual)
    out = spark.read.schema(df.schema).parquet(path)
    out._kinegrain_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes tables of stored() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_kinegrain_path", None)
        if path:
            spark = df.sparkSession
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored_bytes(df: DataFrame) -> int:
    """Bytes on disk of a table of stored()."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._kinegrain_path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength()


#: Bytes on disk up to which a stored table is broadcast.
BROADCAST_BYTES = 16 << 20


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if the stored table's files are at most ``limit`` bytes; else df, for a shuffled join."""
    return F.broadcast(df) if stored_bytes(df) <= limit else df


def word_count(text: Column) -> Column:
    """Words of a text as a long; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected edge table (a, b), both of one orderable type; component is the least node.

    Alternating large-star and small-star rounds: each node is linked to the
    least neighbour, so chains shorten exponentially and a hot node only ever
    passes on one edge for each neighbour. Every round is cut by a stored
    table, and rounds end when the edges, told by their number and two hashes of them
    all, stay as they are. Nodes without edges don't appear. Raises if not done by max_rounds.
    """
    cur = stored(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "cc",
    )
    mark = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", F.lit(7), "u"))).first()
    last = mark(cur)
    for _ in range(max_rounds):
        if not last[0]:
            break
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # stored, so that the adaptive join can split a hot node's rows
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "cc")
        # large star: strictly larger neighbours go to the least of the neighbourhood
        large = both.join(checked_broadcast(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "cc")
        # small star: the smaller neighbours and the node itself go to the least of them
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "cc")
        near = large.join(checked_broadcast(least), "u")
        small = (
            near.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        new = stored(small, "cc")
        discard(cur, low, large, least)
        cur, before, last = new, last, mark(new)
        if last == before:
            break
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    nodes = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.union(roots)
