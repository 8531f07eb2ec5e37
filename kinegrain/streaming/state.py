"""Stage state: the latest record of each stage, resuming, readiness; in batch and in streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DONE = ("succeeded", "skipped", "adopted")


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys and status of the last record; later ones win, ties by the next order column."""
    return log.groupBy(*keys).agg(F.max_by("status", F.struct(*order)).alias("status"), F.max(order[0]).alias("updated_at"), F.count(F.lit(1)).alias("records"))


def status_grid(state: DataFrame, stages: DataFrame, entities: DataFrame) -> DataFrame:
    """entity, stage, status with ``pending`` where there is no record; stages are a bounded registry."""
    every = entities.withColumn("stage", F.explode(F.lit([r[0] for r in stages.collect()])))
    return every.join(state.select("entity", "stage", "status"), ["entity", "stage"], "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def run_summary(grid: DataFrame) -> DataFrame:
    """entity, ok (all stages done), done, failed."""
    done = F.col("status").isin(*DONE)
    return grid.groupBy("entity").agg(F.bool_and(done).alias("ok"), F.count_if(done).alias("done"), F.count_if(F.col("status") == "failed").alias("failed"))


def to_run(planned: DataFrame, state: DataFrame) -> DataFrame:
    """Planned (entity, stage, fingerprint) without those that are done with the same fingerprint."""
    done = state.where(F.col("status").isin(*DONE)).select("entity", "stage", "fingerprint")
    return planned.join(done, ["entity", "stage", "fingerprint"], "left_anti")


def gate(status: Column, same: Column, outputs: Column, force: Column) -> Column:
    """What happens to a stage: run, skipped or adopted."""
    done = status.isin(*DONE) & same & outputs
    return F.when(force, "run").when(F.coalesce(done, F.lit(False)), "skipped").when(status.isNull() & outputs, "adopted").otherwise("run")


def blocked(grid: DataFrame, needs: DataFrame) -> DataFrame:
    """entity, stage, missing: needed stages that are not done."""
    waiting = grid.where(~F.col("status").isin(*DONE)).select("entity", F.col("stage").alias("needs"))
    return grid.select("entity", "stage").join(needs, "stage").join(waiting, ["entity", "needs"]).groupBy("entity", "stage").agg(F.array_sort(F.collect_set("needs")).alias("missing"))


def stale(locks: DataFrame, now: Column, seconds: int = 86400) -> DataFrame:
    """Locks that are older than ``seconds``, to the microsecond."""
    return locks.where(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) > seconds * 1_000_000)


def stream_latest(events: DataFrame, keys: list[str], watermark: str = "1 day") -> DataFrame:
    """Streaming state: the latest status of keys, as a running aggregate in update mode."""
    return events.withWatermark("ts", watermark).groupBy(*keys).agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.count(F.lit(1)).alias("records"))


def stream_windows(events: DataFrame, width: str, keys: list[str], watermark: str = "10 minutes") -> DataFrame:
    """Events by tumbling window and keys; late ones beyond the watermark are left out."""
    w = events.withWatermark("ts", watermark).groupBy(F.window("ts", width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), *keys, "n")


def frame_memory(events: DataFrame, keep: int):
    """Streaming memory bank: for each object the last ``keep`` frames, by custom state."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, parts, state):
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values("frame")
        out = []
        for f in rows["frame"].tolist():
            out.append((key[0], f, list(held)))
            held = (held + [f])[-keep:]
        state.update((held,))
        yield pd.DataFrame(out, columns=["object", "frame", "memory"])

    return events.groupBy("object").applyInPandasWithState(
        step, "object long, frame long, memory array<long>", "held array<long>", "append", GroupStateTimeout.NoTimeout
    )
