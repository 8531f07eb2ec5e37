"""Frame propagation: the stream against the batch form, over triggers of any size, and a restart."""

from datetime import datetime, timedelta
import pytest

from conftest import SF
from kinegrain.plans.views import view
from kinegrain.streaming import propagation as P


@pytest.fixture()
def store(spark):
    key, value = P.STATE_STORE
    old = spark.conf.get(key)
    spark.conf.set(key, value)
    yield
    spark.conf.set(key, old)


def plain(rows):
    return sorted((r.object, r.frame, r.direction, r.source, r.cond, tuple(r.memory)) for r in rows)


def run(spark, folder, checkpoint, out):
    stream = spark.readStream.schema("object long, frame long, ts timestamp, kind string").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(folder)
    q = P.stream_propagate(stream, keep=3, reach=4).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def test_stream_is_batch(spark, store, tmp_path):
    rows = view(spark, SF, "shots").toPandas().sort_values(["ts", "object", "frame"]).reset_index(drop=True)
    folder = tmp_path / "in"
    folder.mkdir()
    cuts = [0, 1, len(rows) // 3, len(rows) // 2, len(rows)]
    whole = spark.createDataFrame(rows)
    want = plain(P.propagate(whole, keep=3, reach=4).collect())
    # the second run goes on from the first one's state
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        few = rows.iloc[lo:hi]
        few.assign(ts=few["ts"].astype("datetime64[us]")).to_parquet(folder / f"{k}.parquet")
        if k in (1, 3):
            run(spark, str(folder), str(tmp_path / "state"), str(tmp_path / "out"))
    got = plain(spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == want and {r[2] for r in got} == {"forward", "back"}


def test_prompts_resets_removals_and_idle_objects(spark):
    kinds = ["frame", "frame", "prompt", "frame", "reset", "frame", "prompt", "remove", "frame", "prompt", "frame"]
    at = [*range(10), 200_000]
    rows = spark.createDataFrame([(1, k, datetime(2024, 1, 1) + timedelta(seconds=at[k]), kind) for k, kind in enumerate(kinds)], "object long, frame long, ts timestamp, kind string")
    got = plain(P.propagate(rows, keep=2, reach=3).collect())
    forward = [(2, "prompt", 2, ()), (3, "tracked", 2, (2,)), (6, "prompt", 6, ()), (9, "prompt", 9, ())]
    back = [(0, 2, (2, 1)), (1, 2, (2,)), (2, 6, (5, 3)), (3, 6, (6, 5)), (5, 6, (6,)), (8, 9, (9,))]
    assert [r[1:2] + r[3:] for r in got if r[2] == "forward"] == forward
    assert [(r[1], r[4], r[5]) for r in got if r[2] == "back"] == back
    assert P.propagate(rows.limit(0)).count() == 0
