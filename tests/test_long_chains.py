"""Chains longer than 32 hops."""

from kinegrain.operators import graph


def test_long_chains(spark):
    rows = [(1, i, i + 1, "C", i, 0.0, 1.0) for i in range(40)]
    e = spark.createDataFrame(rows, "entity int, src int, dst int, kind string, seq int, lo double, hi double")
    start = spark.createDataFrame([(1, 0)], "entity int, node int")
    assert {r.node for r in graph.reachable(e, start).collect()} == set(range(41))
    needs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "name int, needs int")
    got = {(r.name, r.needs) for r in graph.closure(needs).collect()}
    assert got == {(i, j) for i in range(41) for j in range(i + 1, 41)} | {(a, b) for a in (100, 101) for b in (100, 101)}
