"""Larger or denser inputs than the given tables: what has to hold beyond sf0.1."""

import datetime as dt
import os
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from kinegrain.operators import kernels
from kinegrain.plans import catalogue
from kinegrain.plans.views import TABLES


@pytest.fixture
def tables(tmp_path):
    """A folder with the given tables, where a test may put its own in place of some."""
    for t in TABLES:
        os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")

    def put(name, df):
        os.unlink(tmp_path / f"{name}.parquet")
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return put


def by_sql(sf, name):
    duckdb = pytest.importorskip("duckdb")
    d = duckdb.connect()
    d.execute("set timezone='UTC'")
    for t in TABLES:
        d.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{sf}/{t}.parquet') else ''}')")
    return sorted(map(tuple, d.execute(catalogue.ORACLE[name]).fetchall()))


EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def test_ids_of_seven_digits(spark, tables):
    t = dt.datetime(2024, 1, 1)
    sf = tables("events", spark.createDataFrame([(i, t, 5, "view", 1.0, "") for i in (11, 999_998, 1_234_567, 1_234_568, 1_234_569)], EVENT))
    assert sorted(map(tuple, catalogue.QUERIES["sample_id_build"](spark, sf).collect())) == by_sql(sf, "sample_id_build")


def test_locks_older_by_parts_of_a_second(spark, tables):
    now = dt.datetime(2024, 1, 3, 0, 0, 0, 300_000)
    ages = [dt.timedelta(days=1, microseconds=m) for m in (-1, 0, 1, 200_000, 400_000)] + [dt.timedelta()]
    sf = tables("events", spark.createDataFrame([(i, now - a, i, "view", 1.0, "") for i, a in enumerate(ages)], EVENT))
    got = sorted(map(tuple, catalogue.QUERIES["stale_locks"](spark, sf).collect()))
    assert got == [(2, 2), (3, 3), (4, 4)] == by_sql(sf, "stale_locks")


def peak_mb(f, *args) -> float:
    tracemalloc.start()
    f(*args)
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return top / 1e6


def test_memory_of_clusters_grows_with_points():
    x = np.random.default_rng(5).standard_normal((1200, 3))
    assert peak_mb(kernels.ward, x) < 10  # its 719,400 links took far more


def test_chains_merge_as_sorted_links_do():
    rng = np.random.default_rng(6)
    for n in (1, 2, 7, 60):
        x = rng.standard_normal((n, 3))[rng.integers(0, n, n)]
        plain = kernels.ward(x, [(i, j) for i in range(n) for j in range(i)])
        got = kernels.ward(x)
        assert [round(h, 9) for *_, h in got] == [round(h, 9) for *_, h in plain]
        for k in (1, 2, 5):
            assert (kernels.cut(got, n, k) == kernels.cut(plain, n, k)).all()


def test_repair_by_blocks():
    rng = np.random.default_rng(7)

    def tree(x, k=3, block=1 << 20):
        some = kernels.spanning_tree(kernels.nearest_edges(x, k, block), len(x))
        return {(max(e), min(e)) for e in some + kernels.bridges(x, some)}

    for n in (1, 2, 5, 40, 90):
        for x in (rng.standard_normal((n, 3)), rng.integers(0, 4, (n, 3)).astype(float)):
            d = ((x[:, None] - x[None]) ** 2).sum(2)
            near = np.argsort(d + np.diag(np.full(n, np.inf)), axis=1, kind="stable")[:, : min(3, n - 1)]
            edges = [(float(d[i, j]), i, int(j)) for i in range(n) for j in near[i]] + [(float(d[i, j]) + 1e9, i, j) for i in range(n) for j in range(i)]
            assert tree(x, block=200) == {(max(e), min(e)) for e in kernels.spanning_tree(edges, n)}
    assert peak_mb(tree, rng.standard_normal((2500, 3))) < 80  # all differences are 150 MB


def test_deciding_pairs_are_those_of_all_masks(spark):
    from kinegrain.operators import clouds, grouped

    rng = np.random.default_rng(9)
    for scores in ([0.97, 0.5, 0.3], [0.5, 0.3]):
        rows = []
        for i in range(160):
            x, y, w, h = [float(v) for v in (*rng.integers(0, 9, 2), *rng.choice([1, 2, 3, 9], 2))]
            rows.append((i % 3, i, float(rng.choice(scores)), x, y, x + w, y + h))
        rows += [(7, 500 + i, 0.2, 1.0, 1.0, 1.0, 2.0) for i in range(3)] + [(7, 510, 0.1, 0.0, 0.0, 9.0, 9.0)]
        b = spark.createDataFrame(rows, "grp int, id int, score double, x0 double, y0 double, x1 double, y1 double")
        area = {r[1]: (r[5] - r[3]) * (r[6] - r[4]) for r in rows}
        every = []
        for p in rows:
            for q in rows:
                w, h = min(p[5], q[5]) - max(p[3], q[3]), min(p[6], q[6]) - max(p[4], q[4])
                if p[0] == q[0] and p[1] < q[1] and w > 0 and h > 0:
                    every.append((p[0], p[1], q[1], w * h, w * h / (area[p[1]] + area[q[1]] - w * h)))
        every = spark.createDataFrame(every, "grp int, a int, b int, inter double, iou double")
        masks, pairs = clouds.deciding_pairs(b)
        whole = b.selectExpr("grp", "id", "score", "(x1 - x0) * (y1 - y0) as area")
        answer = lambda df: sorted(map(tuple, df.collect()))
        for most in (0.2, 0.7):
            assert answer(clouds.mask_nms(pairs, masks, most, 0.95)) == answer(clouds.mask_nms(every, whole, most, 0.95))
            assert answer(grouped.mask_nms(pairs, masks, most)) == answer(grouped.mask_nms(every, whole, most))
        # a row for few masks, whatever the number of pairs
        assert pairs.count() < 5 * len(rows) < every.count()


def test_masks_of_any_score_are_read(spark, tables):
    sf = tables("lineitem", spark.read.parquet(f"{SF}/lineitem.parquet").limit(900).withColumn("l_extendedprice", F.col("l_extendedprice") / 2))
    got = sorted(map(tuple, catalogue.QUERIES["mask_nms"](spark, sf).collect()))
    assert len({g for g, _ in got}) == 50 and got == by_sql(sf, "mask_nms")


def test_masks_meet_those_alike_only(spark):
    from kinegrain.operators import clouds, grouped

    rng = np.random.default_rng(10)
    rows = []
    for i in range(900):
        x, y = [float(v) for v in rng.uniform(-20, 20, 2)]
        w, h = [float(v) for v in rng.choice([1, 1.4, 2, 8, 30], 2) * rng.uniform(0.9, 1.1, 2)]
        rows.append((i % 3, i, float(rng.choice([0.97, 0.96, 0.5] if i % 3 else [0.5, 0.3])), x, y, x + w, y + h))
    rows += [(0, 1000 + i, 0.5, *r[3:]) for i, r in enumerate(rows[:60])] + [(5, 2000, 0.97, 1.0, 1.0, 1.0, 2.0), (5, 2001, None, 0.0, 0.0, 9.0, 9.0), (6, 2002, 0.1, 1e9, 1e9, 1e9 + 1, 1e9 + 1), (6, 2003, 0.1, 1e9, 1e9, 1e9 + 1, 1e9 + 1.2)]
    b = spark.createDataFrame(rows, "grp int, id int, score double, x0 double, y0 double, x1 double, y1 double")
    answer = lambda df: sorted(map(tuple, df.collect()))
    masks, every = clouds.deciding_pairs(b)
    for most in (0.2, 0.7):
        few = clouds.deciding_pairs(b, most=most, least_score=0.95)[1]
        assert answer(clouds.mask_nms(few, masks, most, 0.95)) == answer(clouds.mask_nms(every, masks, most, 0.95))
        few = clouds.deciding_pairs(b, most=most, inside_too=False)[1]
        assert answer(grouped.mask_nms(few, masks, most)) == answer(grouped.mask_nms(every, masks, most))
        assert few.count() < every.count()


def test_pairs_of_faces_are_rows_once(spark):
    from kinegrain.operators import mesh

    faces = [(i, *map(int, np.random.default_rng(i % 40).choice(9, 3))) for i in range(120)] + [(None, 1, 2, 3), (900, None, 2, 3), (901, None, 2, 3), (3, 1, 2, 8)]
    edges = {}
    for f, *v in faces:
        for a, b in ((0, 1), (1, 2), (0, 2)):
            e = sorted(x for x in (v[a], v[b]) if x is not None)
            edges.setdefault((e[0], e[-1]), set()).add(f)
    want = {(x, y) for fs in edges.values() for x in fs for y in fs if x is not None and y is not None and x < y}
    df = mesh.adjacent_faces(spark.createDataFrame(faces, "fid long, v0 long, v1 long, v2 long"))
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # its pairs are not shuffled: nothing but faces and edges goes through an exchange
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and plan.index("Join") < plan.index("Aggregate") and "Aggregate" not in plan[: plan.index("Join")]


def test_pixels_reach_masks_once(spark):
    from kinegrain.operators import grouped

    rows = [(1, 2, r, c) for r in range(4) for c in range(4)] * 50
    df = spark.createDataFrame(rows, "view long, mask long, prow long, pcol long")
    for out in (grouped.clean_masks(df, ["view", "mask"], 8, 8, 3), kernels.mask_components(df, ["view", "mask"], 8, 8)):
        assert [r.area for r in out.collect()] == [16]
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" in plan[plan.index("FlatMapGroupsInPandas") :]


def test_levels_grow_with_kinds_of_baskets(spark, monkeypatch):
    from kinegrain.operators import graph

    kept, rows = graph.stored, []

    def counted(df, name):
        out = kept(df, name)
        rows.append((name, out.count()))
        return out

    monkeypatch.setattr(graph, "stored", counted)
    sets = [(1, 2, 3, 4), (2, 3, 5), (4, 9)]
    b = spark.createDataFrame([(100 * k + i, x) for k, s in enumerate(sets) for i in range(50) for x in s] + [(None, 1), (None, 2), (7, None)], "basket int, item int")
    got = graph.itemsets(b, 50)
    assert {(tuple(r["items"]), r.n) for r in got.collect() if len(r["items"]) > 3} == {((1, 2, 3, 4), 50)} and got.where("items = array(1)").first().n == 51
    assert all(n <= 16 for name, n in rows if name == "level")
    assert sorted(r["items"] for r in graph.maximal(got).collect()) == [[1, 2, 3, 4], [2, 3, 5], [4, 9]]


def test_nothing_is_kept_for_each_basket(spark, monkeypatch):
    from itertools import combinations

    from kinegrain.operators import graph

    kept, rows = graph.stored, []

    def counted(df, name):
        out = kept(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "stored", counted)
    sets = [(1, 2, 3), (2, 3, 5), (), (2,)]
    # every 97th basket has an item of its own, and every row is there twice
    b = {k: (*sets[k % 4], *([1000 + k] if k % 97 == 0 else [])) for k in range(900)}
    frame = spark.createDataFrame([(k, x) for k, s in b.items() for x in s] * 2 + [(None, 2)] * 3, "basket int, item int")
    want = {}
    for s in [*b.values(), (2,)]:
        for x in (x for size in range(1, len(s) + 1) for x in combinations(sorted(s), size)):
            want[x] = want.get(x, 0) + 1
    want = {x: n for x, n in want.items() if n >= 100}
    got = graph.itemsets(frame, 100)
    assert {tuple(r["items"]): r.n for r in got.collect()} == want and got.count() == len(want)
    assert max(rows) <= 4 + 10  # 3 kinds and those of the 10 items of their own, of 900 baskets
    assert sorted(r["items"] for r in graph.maximal(got).collect()) == [[1, 2, 3], [2, 3, 5]]


def test_points_midway_between_cells(spark, tables):
    # this tetrahedron's sides come back from its corners with other last digits, which moved a point midway between two cells
    sf = tables("supplier", spark.createDataFrame([(5021, "", 18, 0.0), (5020, "", 18, 0.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"))
    assert sorted(map(tuple, catalogue.QUERIES["voxel_volumes"](spark, sf).collect())) == by_sql(sf, "voxel_volumes")


def test_near_points_are_connected_without_their_pairs(spark):
    from kinegrain.operators import graph, spatial

    rng = np.random.default_rng(11)
    dense = [(i, *map(float, v)) for i, v in enumerate(rng.normal(0, 0.1, (900, 3)))]
    sparse = [(2000 + i, *map(float, v)) for i, v in enumerate(rng.uniform(-3, 3, (700, 3)))]
    rows = dense + sparse + [(5000, 9.0, 9.0, 9.0), (5001, 9.0, 9.0, 9.099), (5002, 9.0, 9.0, 9.2), (5003, 8.95, 9.0, 9.0), (5000, 8.0, 8.0, 8.0), (6000, float("nan"), 0.0, 0.0), (6001, None, 0.0, 0.0), (6002, float("inf"), 0.0, 0.0), (6003, float("inf"), 0.0, 0.0)]
    p = spark.createDataFrame(rows, "idx long, x double, y double, z double")
    for eps in (0.1, 0.35):
        edges = spatial.near_components(p, eps)
        want = graph.components(spatial.radius_pairs(p.where("abs(x) < 100"), eps).select("a", "b"))
        assert sorted(map(tuple, graph.components(edges).collect())) == sorted(map(tuple, want.collect()))
        assert edges.count() < 2 * len(rows)
    assert spatial.near_components(p.limit(0), 0.1).count() == 0


def test_copies_of_parts_meet_as_kinds(spark, monkeypatch):
    from kinegrain.operators import contact, volume

    shapes = [(0.0, 1.0), (0.02, 0.7), (0.5, 1.0), (4.0, 0.5)]
    tri, points = [], []
    for part in range(40):
        at, a = shapes[part % 4 if part != 39 else 3]
        corners = [(at + a * (k & 1), at + a * (k >> 1 & 1), at + a * (k >> 2)) for k in range(8)]
        points += [(1, part, part * 8 + k, *c) for k, c in enumerate(corners)]
        tri += [(1, part, *[x for v in t for x in corners[v]]) for t in ((0, 4, 6), (0, 6, 2), (1, 3, 7), (1, 7, 5), (0, 1, 5), (0, 5, 4), (2, 6, 7), (2, 7, 3), (0, 2, 3), (0, 3, 1), (4, 5, 7), (4, 7, 6))]
    points += [(1, 50, 900, 0.0, 0.0, 0.5), (1, 50, 901, 0.0, 0.0, 0.5)]  # without a surface
    points = spark.createDataFrame(points, "entity long, part long, idx long, x double, y double, z double")
    tri = spark.createDataFrame(tri, "entity long, part long, " + ", ".join(f"{n} double" for n in volume.COORDINATES))
    near = [tuple(r) for r in contact.near_surfaces(points, tri, 30.0).select("part", "idx", "other", "distance").collect()]
    sizes = {r.part: r["count"] for r in points.groupBy("part").count().collect()}
    kept, met = contact._met, []
    monkeypatch.setattr(contact, "_met", lambda p, ids, t, reach, *x: met.append((p.count(), t.count())) or kept(p, ids, t, reach, *x))
    for eps in (0.6,):
        counts = {}
        for p, _, o, d in near:
            if d < eps:
                counts[p, o] = counts.get((p, o), 0) + 1
        want = {p: min((-n, o) for (q, o), n in counts.items() if q == p) for p in {p for p, _ in counts}}
        got = {r.part: (-r.touching, r.other) for r in contact.best_neighbours(points, tri, eps).collect()}
        assert got == want
    for least in (7, 90):
        want = {}
        for part in range(40):
            ds = sorted(d for _, _, o, d in near if o == part)
            kth = ds[min(least, len(ds)) - 1]
            steps = min(1000, 0 if kth < 0.01 else int(np.floor(round((kth - 0.01) / 0.01, 9))) + 1)
            want[part] = (steps, sum(d < 0.01 + steps * 0.01 for d in ds))
        assert {r.part: (r.relaxations, r.size) for r in contact.contact_regions(points, tri, least=least).collect()} == want
    assert max(p for p, _ in met) <= 4 * 8 + 1 and max(t for _, t in met) <= 4 * 12  # of 322 points and 480 triangles


def test_small_parts_hand_on_their_contacts(spark):
    from kinegrain.operators import grouped

    def plain(sizes, touching, small):
        into = {p: p for p in sizes}

        def root(p):
            return p if into[p] == p else root(into[p])

        for p in sorted(small, key=lambda p: (sizes[p], p)):
            weight = {}
            for a, b, w in touching:
                a, b = root(a), root(b)
                if a != b and root(p) in (a, b):
                    weight[a + b - root(p)] = weight.get(a + b - root(p), 0) + w
            if weight:
                into[root(p)] = min(weight, key=lambda t: (-weight[t], t))
        return {p: root(p) for p in sizes}

    rng = np.random.default_rng(12)
    parts, contacts, want = [], [], []
    for e in range(60):
        n = int(rng.integers(1, 9))
        sizes = {p: float(rng.integers(1, 20)) for p in range(n)}
        touching = [(int(rng.integers(n)), int(rng.integers(n)), float(rng.integers(1, 5))) for _ in range(int(rng.integers(0, 15)))]
        parts += [(e, p, s) for p, s in sizes.items()]
        contacts += [(e, *t) for t in touching] + [(e, 0, 99, 50.0)]
        want += [(e, p, q) for p, q in plain(sizes, touching, {p for p, s in sizes.items() if s < 12}).items()]
    contacts += [(1000, 1, 2, 3.0)]
    out = grouped.small_parts(spark.createDataFrame(parts, "entity long, part long, size double"), spark.createDataFrame(contacts, "entity long, a long, b long, w double"), "entity", 12.0)
    assert sorted(map(tuple, out.collect())) == sorted(want)
    # many entities in a batch, not a group of pandas each
    assert "InPandas" not in out._jdf.queryExecution().optimizedPlan().toString()
    n = 3000
    assert set(kernels.merge_small_parts({p: 1.0 for p in range(n)}, [(p, p + 1, 1.0) for p in range(n - 1)], set(range(n))).values()) == {n - 1}


def test_values_of_variants_are_evaluated_once(spark):
    from kinegrain.functions import jsonv, numeric

    v = F.try_parse_json("t")
    for made in (jsonv.parse_json(F.col("t")), jsonv.non_empty(v), numeric.as_float(v), numeric.numeric_vector(v, 3)):
        plan = spark.createDataFrame([("[1, 2, 3]",)], "t string").select(made.alias("x"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("parse_json(") <= 2  # as_float names it for its kind and its text


def test_entities_are_dealt_into_tasks(spark):
    from kinegrain.operators import bodies, parts

    tree = bodies.body_tree(spark.createDataFrame([(1, 0, None, None, *[0.0] * 9)], "entity int, part int, parent int, kind string, px double, py double, pz double, ax double, ay double, az double, lo double, hi double, damping double"))
    rows = spark.createDataFrame([(1, 2, 3)], "entity int, part int, fid int")
    made = parts.assemble(rows.select("entity", "part", F.col("fid").alias("group")), rows)
    for df in (bodies.body_models(tree), made):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in plan[: plan.index("Union") if "Union" in plan else None].split("Join")[0]
