"""Stage runs with limits, and stream results that are written once whatever stops them."""

import os
import time

import pytest
from pyspark.sql import functions as F

from kinegrain.plans import runs
from kinegrain.plans.stages import Stage
from kinegrain.streaming import results


def slow(df):
    def wait(parts):
        for pdf in parts:
            time.sleep(60)
            yield pdf

    return df.mapInPandas(wait, df.schema)


def plus(k):
    return lambda df: df.select((F.col("id") + k).alias("id"))


def fails(df):
    return df.select(F.raise_error(F.lit("no good")).cast("long").alias("id"))


def by_name(outcomes):
    return {o.stage: o for o in outcomes}


def test_time_limits_second_plans_and_failing_fast(spark, tmp_path):
    folder = "file://" + str(tmp_path / "run")
    start = spark.range(3)
    stages = [Stage("a", 1, plus(1)), Stage("b", 2, slow, ("a",)), Stage("c", 3, plus(10), ("b",)), Stage("d", 4, plus(5), ("a",))]
    begun = time.time()
    out = by_name(runs.run_stages(spark, stages, start, folder, {"b": runs.Limit(3)}))
    assert time.time() - begun < 45
    assert [out[n].status for n in "abcd"] == ["succeeded", "timed_out", "skipped", "skipped"] and "3 seconds" in out["b"].error
    assert not os.path.exists(tmp_path / "run" / "b") and not [f for f in os.listdir(tmp_path / "run") if f.startswith(".b")]
    # what is done is not done again; the second plan takes over; both inputs of the last stage are there
    stages.append(Stage("e", 5, lambda x, y: x.union(y), ("c", "d")))
    out = by_name(runs.run_stages(spark, stages, start, folder, {"b": runs.Limit(3, plus(100))}))
    assert [out[n].status for n in "abcde"] == ["resumed", "fallback", "succeeded", "succeeded", "succeeded"] and out["b"].plan == "second"
    assert sorted(r.id for r in spark.read.parquet(folder + "/e").collect()) == [6, 7, 8, 111, 112, 113]
    state = spark.read.schema(runs.STATE).parquet(folder + "/state")
    assert state.count() == 9 and {r.stage: r.status for r in runs.last_states(state).collect()} == {"a": "resumed", "b": "fallback", "c": "succeeded", "d": "succeeded", "e": "succeeded"}
    # another fingerprint runs everything again
    assert {o.status for o in runs.run_stages(spark, stages[:1], start, folder, fingerprint="new")} == {"succeeded"}


def test_going_on_after_a_failure(spark, tmp_path):
    folder = "file://" + str(tmp_path / "run")
    stages = [Stage("a", 1, fails), Stage("b", 2, plus(1), ("a",)), Stage("c", 3, plus(2)), Stage("d", 4, plus(2), ("b",))]
    out = by_name(runs.run_stages(spark, stages, spark.range(2), folder, {"a": runs.Limit(30, fails)}, fail_fast=False))
    assert [out[n].status for n in "abcd"] == ["failed", "blocked", "succeeded", "blocked"] and "no good" in out["a"].error and out["a"].plan == "second"
    assert spark.read.parquet(folder + "/c").count() == 2


def test_load_state(spark):
    rows = spark.sql("select * from values (null, 'failed', now(), 1d), ('a', 'odd', now(), 1d), ('a', null, now(), 1d), ('a', 'failed', null, 1d), ('a', 'failed', now(), -1d), ('a', 'failed', now(), null) t(stage, status, at, seconds)")
    good, bad = runs.load_state(rows)
    assert good.count() == 1 and sorted(r.why for r in bad.collect()) == ["negative seconds", "no stage", "no time", "unknown status", "unknown status"]


class Stop(Exception):
    pass


@pytest.mark.parametrize("where", ["written", "named"])
def test_a_stopped_batch_counts_once(spark, tmp_path, where):
    """The stream stops after a batch's rows, or after its entry, and starts again from its checkpoint."""
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    for lo in (0, 10, 20):
        spark.range(lo, lo + 10).coalesce(1).write.mode("append").parquet(source)
    stops = [where]
    seen = []

    def hook(step):
        seen.append(step)
        if stops and step == stops[0] and len(seen) > 2:
            stops.pop()
            raise Stop(step)

    def start():
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
        q = results.once(stream, out, checkpoint, lambda df, batch: df.withColumn("batch", F.lit(batch)), hook).trigger(availableNow=True).start()
        q.awaitTermination()

    with pytest.raises(Exception):
        start()
    start()
    rows = results.read_results(spark, out, "id long, batch int").collect()
    assert sorted(r.id for r in rows) == list(range(30)) and {r.batch for r in rows} == {0, 1, 2}
    results.forget_tries(spark, out)
    assert spark.read.option("recursiveFileLookup", "true").schema("id long").parquet(out).count() == 30
    assert results.read_results(spark, str(tmp_path / "none"), "id long").count() == 0
