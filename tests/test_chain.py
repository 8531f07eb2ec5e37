"""The refine-and-merge chain: ways of merging by observed counts, and objects with too many parts."""

from kinegrain.operators import chain, parts


def test_chain_of_two_objects(spark):
    # object 1: parts 0..5 of two faces, masks hold {0, 1, 2} four times and {3, 4} three times; object 2: seven parts, more than the limit
    p = [(1, part, 10 * part + k) for part in range(6) for k in range(2)] + [(2, part, part) for part in range(7)]
    m = [(1, mask, 10 * part + k) for mask in range(4) for part in (0, 1, 2) for k in range(2)] + [(1, mask, 10 * part + k) for mask in (7, 8, 9) for part in (3, 4) for k in range(2)]
    m += [(1, 7, 50), (2, 0, 0), (2, 0, 1), (2, 1, 1), (2, 1, 2)]
    parts_df, masks_df = spark.createDataFrame(p, "entity long, part long, fid long"), spark.createDataFrame(m, "entity long, mask long, fid long")
    faces, record, metrics = chain.refine_and_merge(parts_df, masks_df, limit=6)
    got = {r.entity: (r.masks, r.refined_parts, r.merged_parts, r.strategy, r.error) for r in record.collect()}
    assert got == {1: (7, 6, 3, "item sets", None), 2: (2, 7, 6, "containment", None)}
    cls = {(r.entity, r.fid): r.cls for r in faces.collect()}
    assert {cls[1, 10 * k] for k in (0, 1, 2)} == {0} and {cls[1, 10 * k] for k in (3, 4)} == {1} and cls[1, 50] == 2
    assert [cls[2, k] for k in range(7)] == [0, 0, 1, 2, 3, 4, 5]
    assert metrics["refined"] == {"objects": 2, "large": 1, "most": 7} and metrics["merged"] == {"faces": 19}
    faces, record, _ = chain.refine_and_merge(parts_df, masks_df, limit=5)
    assert {r.entity: r.error for r in record.collect()} == {1: None, 2: "too many merged parts: 6"} and {r.entity for r in faces.collect()} == {1}
    assert chain.refine_and_merge(parts_df.limit(0), masks_df)[1].count() == 0


def test_cycles_are_peeled(spark):
    needs = [(f"n{i}", f"n{i + 1}") for i in range(40)] + [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "a"), ("e", "y"), ("s", "s"), ("n0", None)]
    got = parts.names_in_cycles(spark.createDataFrame(needs, "name string, needs string"))
    assert {r.name for r in got.collect()} == {"a", "b", "d", "e", "s"}
    assert parts.names_in_cycles(got.select("name", got["name"].alias("needs")).limit(0)).count() == 0
