"""Frames propagated from prompts, for each object: forwards and backwards, with reset, removal and idle objects; as a stream and in batch.

Rows are (object, frame, ts, kind), kind being ``frame``, ``prompt`` (a frame with the user's mark), ``reset`` or ``remove``. From
its first prompt on, every frame of an object is answered by the last prompt (``cond``) and the ``keep`` frames answered before
it (``memory``); the first prompt also answers up to ``reach`` frames before it, from the nearest to the farthest, by itself and
the frames after them. A reset forgets prompts and memory, but not the frames; after a removal, or after more than ``idle`` seconds
without a row, the object begins anew. The model that makes masks of all this stays outside.

The stream keeps for each object what the last row left: a value, and two lists of at most ``keep`` and ``reach`` frames; a timer
on event time drops objects that have been idle. An object's rows must come in the order of frames from one trigger to the
next. Batch and stream give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

KEEP, REACH, IDLE = 6, 16, 86_400
OUT = "object long, frame long, direction string, source string, cond long, memory array<long>"


def propagate(rows: DataFrame, keep: int = KEEP, reach: int = REACH, idle: int = IDLE) -> DataFrame:
    """object, frame, direction, source, cond, memory of a whole table of rows."""
    own = Window.partitionBy("object").orderBy("frame")
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = us - F.lag(us).over(own) > idle * 1_000_000
    t = rows.withColumn("_gap", F.coalesce(gap, F.lit(False)))
    # a removal ends a life behind itself, a gap before the row
    life = F.count_if("_gap").over(upto) + F.coalesce(F.count_if(F.col("kind") == "remove").over(before), F.lit(0))
    t = t.withColumns({"life": life, "resets": F.count_if(F.col("kind") == "reset").over(upto)}).where(F.col("kind").isin("frame", "prompt"))
    in_life = Window.partitionBy("object", "life").orderBy("frame")
    in_run = Window.partitionBy("object", "life", "resets").orderBy("frame")
    so_far = in_run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prompt = F.when(F.col("kind") == "prompt", F.col("frame"))
    t = t.withColumns({"pos": F.row_number().over(in_life), "cond": F.max(prompt).over(so_far), "start": F.min(prompt).over(so_far)})
    t = t.withColumn("after", F.collect_list("frame").over(in_life.rowsBetween(1, keep)))
    memory = F.collect_list(F.when(F.col("start").isNotNull(), F.col("frame"))).over(in_run.rowsBetween(-keep, -1))
    forward = t.withColumn("memory", memory).where("start is not null")
    forward = forward.select("object", "frame", F.lit("forward").alias("direction"), F.when(F.col("kind") == "prompt", "prompt").otherwise("tracked").alias("source"), "cond", "memory")
    earlier = F.transform(F.sequence(F.lit(1), F.lit(reach)), lambda k: F.col("pos") - k)
    firsts = t.where("frame = start").select("object", "life", F.col("frame").alias("cond"), F.explode(earlier).alias("pos"))
    back = t.drop("cond").join(firsts, ["object", "life", "pos"]).select(
        "object", "frame", F.lit("back").alias("direction"), F.lit("tracked").alias("source"), "cond", F.reverse(F.filter("after", lambda f: f <= F.col("cond"))).alias("memory")
    )
    return forward.unionByName(back)


class Propagation(StatefulProcessor):
    """The same for one object's rows of one trigger, with what is kept between triggers."""

    def __init__(self, keep: int, reach: int, idle: int):
        self.keep, self.reach, self.idle = keep, reach, idle

    def _expiry(self, us: int) -> int:
        """In milliseconds, which timers count."""
        return us // 1000 + self.idle * 1000 + 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "started boolean, cond long, us long")
        self.memory = handle.getListState("memory", "frame long")
        self.recent = handle.getListState("recent", "frame long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        started, cond, last = self.last.get() if self.last.exists() else (False, None, None)
        memory = [r[0] for r in self.memory.get()] if self.memory.exists() else []
        recent = [r[0] for r in self.recent.get()] if self.recent.exists() else []
        out: list[tuple] = []
        if last is not None:
            self.handle.deleteTimer(self._expiry(last))
        batch = pd.concat(list(rows)).sort_values("frame")
        times = (batch["ts"].astype("datetime64[us]").astype("int64")).tolist()
        for frame, kind, us in zip(batch["frame"].tolist(), batch["kind"].tolist(), times):
            if last is not None and us - last > self.idle * 1_000_000:
                started, cond, memory, recent = False, None, [], []
            last = us
            if kind == "remove":
                started, cond, memory, recent = False, None, [], []
            elif kind == "reset":
                started, cond, memory = False, None, []
            elif kind == "prompt" or kind == "frame":
                if kind == "prompt":
                    cond = frame
                    if not started:
                        back = [frame]
                        for earlier in reversed(recent):
                            out.append((key[0], earlier, "back", "tracked", frame, back[-self.keep :]))
                            back.append(earlier)
                    started = True
                if started:
                    out.append((key[0], frame, "forward", "prompt" if kind == "prompt" else "tracked", cond, list(memory)))
                    memory = (memory + [frame])[-self.keep :]
                recent = (recent + [frame])[-self.reach :]
        self.last.update((started, cond, last))
        for state, held in ((self.memory, memory), (self.recent, recent)):
            state.clear()
            if held:
                state.put([(f,) for f in held])
        self.handle.registerTimer(self._expiry(last))
        if out:
            yield pd.DataFrame(out, columns=["object", "frame", "direction", "source", "cond", "memory"])

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.last, self.memory, self.recent):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


#: The state store that lists and timers need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_propagate(rows: DataFrame, keep: int = KEEP, reach: int = REACH, idle: int = IDLE, watermark: str = "1 hour") -> DataFrame:
    """The same of a stream of rows, in append mode; the session's state store must be STATE_STORE."""
    timed = rows.select("object", "frame", "ts", "kind").withWatermark("ts", watermark)
    return timed.groupBy("object").transformWithStateInPandas(Propagation(keep, reach, idle), OUT, "Append", "EventTime")
