"""Runs of stages: time limits with a second plan, failing fast or not, and a state table that says what became of each stage.

Every stage's Spark jobs carry a tag of their own. A watch on the driver cancels a stage's tag when its time is over; the stage
then gets its second plan, if it has one, under a new tag. After a failure, either no further stage begins (fail fast), or only
those that need what is missing are left out. A stage's table is written to its folder, and a stage that the state table calls
done, with the same fingerprint and its folder there, is not run again.

A limit ends Spark jobs, not Python code on the driver between them: a stage's function that hangs without a job is left behind
in its thread, and its outcome is the limit's all the same.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import delete, list_files
from ..streaming.state import DONE
from .stages import Stage

STATE = "run string, number int, stage string, status string, plan string, seconds double, error string, fingerprint string, at timestamp"
#: What a stage can become. ``fallback`` is a success of the second plan.
STATUSES = ("succeeded", "fallback", "timed_out", "failed", "skipped", "blocked", "resumed")
ENDED_WELL = ("succeeded", "fallback", "resumed")


@dataclass(frozen=True)
class Limit:
    """Seconds that a stage may take, and the plan that replaces it afterwards, under the same limit."""

    seconds: float | None = None
    second_plan: Callable[..., DataFrame] | None = None


@dataclass
class Outcome:
    run: str
    number: int
    stage: str
    status: str
    plan: str | None = None
    seconds: float = 0.0
    error: str | None = None
    fingerprint: str = ""


def _attempt(spark: SparkSession, work: Callable[[], None], seconds: float | None) -> tuple[str, str | None]:
    """(succeeded, failed or timed_out, error) of work whose Spark jobs are cancelled when its time is over."""
    tag, error = f"stage-{uuid.uuid4().hex}", []
    context = spark.sparkContext
    late = threading.Event()

    def body() -> None:
        context.addJobTag(tag)
        try:
            work()
        except Exception as e:  # noqa: BLE001  what a stage raises becomes its outcome
            error.append(f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:500])
        finally:
            context.removeJobTag(tag)

    thread = InheritableThread(target=body, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        late.set()
        deadline = time.time() + 10
        while thread.is_alive() and time.time() < deadline:  # jobs that begin after the first cancellation are met by a later one
            context.cancelJobsWithTag(tag)
            thread.join(0.2)
    if late.is_set():
        return "timed_out", f"over {seconds:g} seconds"
    return ("failed", error[0]) if error else ("succeeded", None)


def load_state(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with why) of a state table: a stage, a known status, a time, and no negative seconds are needed."""
    known = F.col("status").isin(*STATUSES)
    why = (
        F.when(F.col("stage").isNull() | (F.col("stage") == ""), "no stage").when(~F.coalesce(known, F.lit(False)), "unknown status")
        .when(F.col("at").isNull(), "no time").when(F.col("seconds") < 0, "negative seconds")
    )
    judged = rows.withColumn("why", why)
    return judged.where("why is null").drop("why"), judged.where("why is not null")


def last_states(rows: DataFrame) -> DataFrame:
    """stage, status, fingerprint of each stage's last valid row."""
    good, _ = load_state(rows)
    return good.groupBy("stage").agg(F.max_by(F.struct("status", "fingerprint"), F.struct("at", "run")).alias("s")).select("stage", "s.*")


def run_stages(
    spark: SparkSession, stages: list[Stage], start: DataFrame, folder: str, limits: dict[str, Limit] | None = None, *, fail_fast: bool = True, fingerprint: str = ""
) -> list[Outcome]:
    """Runs stages in order, each on the tables of what it needs (on start, if nothing), and appends their outcomes to folder/state."""
    limits, state = limits or {}, f"{folder}/state"
    run = uuid.uuid4().hex
    done: dict[str, tuple[str, str]] = {}
    if list_files(spark, state, ".parquet"):
        done = {r["stage"]: (r["status"], r["fingerprint"]) for r in last_states(spark.read.schema(STATE).parquet(state)).collect()}
    outcomes: dict[str, Outcome] = {}
    stop = False
    for s in stages:
        out = outcomes[s.name] = Outcome(run, s.number, s.name, "skipped", fingerprint=fingerprint)
        path = f"{folder}/{s.name}"
        there = bool(list_files(spark, path, ".parquet"))
        if stop:
            continue
        if any(n in outcomes and outcomes[n].status not in ENDED_WELL for n in s.needs):
            out.status = "blocked"
            continue
        if there and done.get(s.name, ("", ""))[0] in (*ENDED_WELL, *DONE) and done[s.name][1] == fingerprint and all(outcomes[n].status == "resumed" for n in s.needs if n in outcomes):
            out.status = "resumed"
            continue
        limit = limits.get(s.name, Limit())
        inputs = [spark.read.parquet(f"{folder}/{n}") for n in s.needs] or [start]
        begun = time.time()
        for name, plan in (("first", s.run), ("second", limit.second_plan)):
            if plan is None:
                break
            # a cancelled attempt's folder is its own, so that nothing of it can be taken for the stage's table
            own = f"{folder}/.{s.name}-{uuid.uuid4().hex}"
            out.plan = name
            out.status, out.error = _attempt(spark, lambda: plan(*inputs).write.parquet(own), limit.seconds)  # noqa: B023
            if out.status == "succeeded":
                _rename(spark, own, path)
                out.status = "succeeded" if name == "first" else "fallback"
                break
            delete(spark, own)
        out.seconds = round(time.time() - begun, 3)
        stop = fail_fast and out.status not in ENDED_WELL
    rows = spark.createDataFrame([tuple(asdict(o).values()) for o in outcomes.values()], STATE.rpartition(",")[0])
    rows.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(state)
    return list(outcomes.values())


def _rename(spark: SparkSession, source: str, target: str) -> None:
    from ..sources.store import _hadoop

    fs, a = _hadoop(spark, source)
    _, b = _hadoop(spark, target)
    fs.delete(b, True)
    if not fs.rename(a, b):
        raise OSError(f"{target} can't be put in place")
