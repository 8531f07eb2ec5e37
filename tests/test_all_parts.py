"""Every part is answered, and frames are found however far they are."""

from conftest import SF
from kinegrain.operators import spatial
from kinegrain.plans import catalogue
from kinegrain.plans.views import view


def test_closest_frames_however_far(spark):
    frames = spark.createDataFrame([(1, f) for f in (0, 7, 1000, 5000, 9000)] + [(2, 50)], "object long, frame long")
    targets = spark.createDataFrame([(1, 500), (1, 1000), (1, 9999), (2, 1), (3, 1)], "object long, target long")
    got = {}
    for r in sorted(spatial.closest_frames(frames, targets, 3).collect(), key=lambda r: r["rank"]):
        got.setdefault((r.object, r.target), []).append(r.frame)
    assert got == {(1, 500): [7, 1000, 0], (1, 1000): [7, 1000, 0], (1, 9999): [9000, 5000, 1000], (2, 1): [50]}


def test_small_part_merge_answers_every_part(spark):
    got = catalogue.QUERIES["small_part_merge"](spark, SF).select("entity", "part").collect()
    want = view(spark, SF, "annotations").select("entity", "part").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
