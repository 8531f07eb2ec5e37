"""Results of a stream written exactly once: a folder for each attempt at a batch, and a manifest entry that says which one counts.

A batch's rows are written first, under ``batch=<id>/try=<uuid>``; then its manifest entry is put in place, which names that
folder. A stream that stops between the two is given the batch again and writes it anew; what the first try left isn't
named by any entry and never read. One that stops between the entry and the stream's own commit replaces its entry and its
rows. Metrics of a batch (counts, means) are rows like any others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from ..sources.store import delete, list_files, put_text, read_text

MANIFEST = "_manifest"


def write_batch(rows: DataFrame, batch: int, path: str, hook: Callable[[str], None] = lambda step: None) -> None:
    """Writes a batch's rows and makes them the ones that count. hook is told of each step, for tests."""
    spark = rows.sparkSession
    folder = f"batch={batch:012d}/try={uuid.uuid4().hex}"
    entry = f"{path}/{MANIFEST}/{batch:012d}.json"
    before = read_text(spark, entry)
    rows.write.parquet(f"{path}/{folder}")
    hook("written")
    put_text(spark, entry, json.dumps({"batch": batch, "folder": folder}))
    hook("named")
    if before:
        delete(spark, f"{path}/{json.loads(before)['folder']}")


def once(stream: DataFrame, path: str, checkpoint: str, make: Callable[[DataFrame, int], DataFrame] = lambda df, batch: df, hook: Callable[[str], None] = lambda step: None) -> DataStreamWriter:
    """A writer of the stream's batches, each as ``make`` makes it; start() it with a trigger of choice."""

    def each(df: DataFrame, batch: int) -> None:
        write_batch(make(df, batch), batch, path, hook)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)


def read_results(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows that count, of all batches."""
    folders = [json.loads(read_text(spark, f))["folder"] for f in list_files(spark, f"{path}/{MANIFEST}", ".json")]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders])


def forget_tries(spark: SparkSession, path: str) -> None:
    """Deletes what no entry names. Not while a stream writes."""
    named = {json.loads(read_text(spark, f))["folder"] for f in list_files(spark, f"{path}/{MANIFEST}", ".json")}
    for f in list_files(spark, path, "", folders=True):
        batch = f.rstrip("/").rsplit("/", 1)[-1]
        if batch.startswith("batch="):
            for t in list_files(spark, f, "", folders=True):
                if f"{batch}/{t.rstrip('/').rsplit('/', 1)[-1]}" not in named:
                    delete(spark, t)
