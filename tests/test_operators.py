"""Fixed examples and properties of functions and kernels."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinegrain.functions import curves, jsonv, numeric, text, vec3
from kinegrain.operators import augment, datasets, graph, kernels, mesh, metrics, raster, rules, sampling, spatial
from kinegrain.plans.registry import TRANSFORMS
from kinegrain.streaming import state


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def lit(x):
    return F.lit(x)


def variant(t):
    return jsonv.parse_json(F.lit(t))


def test_numbers(spark):
    r = one(
        spark, t=numeric.as_float(variant("true")), s=numeric.as_float(variant('"5"')), x=numeric.as_float(variant('"x"')), n=numeric.as_float(variant("null")),
        i=numeric.as_float(variant("3")), v=numeric.numeric_vector(variant('[1,"2",3]'), 3), w=numeric.numeric_vector(variant("[1,2]"), 3),
        z=numeric.numeric_vector(variant("[1,null,3]"), 3), a=numeric.positive_alde(lit(2.0), lit(1.0)), m=numeric.positive_min_ratio(lit(2.0), lit(4.0)),
        zero=numeric.positive_alde(lit(0.0), lit(1.0)),
    )
    assert (r.t, r.s, r.x, r.n, r.i) == (None, 5.0, None, None, 3.0) and r.v == [1, 2, 3] and r.w is None and r.z is None
    assert r.a == pytest.approx(0.693147, abs=1e-6) and r.m == 0.5 and r.zero is None


def test_axes(spark):
    v = lambda *x: vec3.vec(*x)
    r = one(
        spark, sph=vec3.axis_vector(variant('{"theta": 90, "phi": 0}')), none=vec3.axis_vector(variant("[0,0,0]")), a=vec3.axis_angle(v(1, 1, 0), v(1, 0, 0)),
        b=vec3.axis_angle(v(1, 0, 0), v(-1, 0, 0)), d=vec3.point_to_line(v(1, 0, 0), v(0, 0, 0), v(0, 0, 1)),
        m=vec3.source_to_model(v(2, 0, 0), v(0, 0, 0), numeric.lit(2), v(-1, -1, -1)), c=numeric.canonical_interval(lit(-2.0), lit(1.0)),
        i=numeric.interval_iou(numeric.canonical_interval(lit(0.0), lit(1.0)), numeric.canonical_interval(lit(0.5), lit(1.5))),
        same=numeric.interval_iou(numeric.canonical_interval(lit(1.0), lit(1.0)), numeric.canonical_interval(lit(1.0), lit(1.0))),
    )
    assert r.sph == pytest.approx([1, 0, 0], abs=1e-9) and r.none is None and r.a == pytest.approx(45) and r.b == pytest.approx(0) and r.d == 1
    assert r.m == [2, 1, 1] and (r.c.lo, r.c.hi) == (1, 2) and r.i == pytest.approx(1 / 3) and r.same == 1


def test_text(spark):
    r = one(
        spark, tag=text.tagged_json(lit('x ===BEGIN_JSON=== {"a":1} ===END_JSON===')), no=text.tagged_json(lit("x")), out=text.outer_braces(lit('foo {"a":{"b":1}} bar')),
        bad=text.outer_braces(lit("no")), trail=text.outer_braces(lit('{"a":1}}')), vec=text.vector_text(lit("[ 9.8e-01 -1.7  4.6e-04]")), two=text.vector_text(lit("1 2")),
        unit=text.first_number(lit("7.8 g/cm^3")), dim=text.dimension_text(lit("20*3*2 cm")), rng=text.range_text(lit("0-180 degrees")), name=text.safe_filename(lit("a b/c..")),
        head=text.material_head(lit("Metal/Steel")), none=text.material_head(lit("/x")), ver=text.version(lit("Blender 4.2.1")), rt=text.rounded_text(lit(1.5)),
        sid=text.sample_id(lit(None).cast("string"), lit("a"), lit("b"), lit("3"), lit(1)), anon=text.sample_id(lit(None).cast("string"), lit(None).cast("string"), lit("b"), lit("3"), lit(4)),
        ids=jsonv.member_set(variant('[3, 3.0, " 7 "]')), bools=jsonv.member_set(variant("[1, true]")), half=text.part_id(variant("3.5")),
    )
    assert r.tag == '{"a":1}' and r.no is None and r.out == '{"a":{"b":1}}' and r.bad is None and r.trail is None and r.vec == [0.98, -1.7, 0.00046] and r.two is None
    assert r.unit == 7.8 and r.dim == [20, 3, 2] and r.rng == [0, 180] and r.name == "a_b_c" and r.head == "metal" and r.none is None and r.ver == [4, 2, 1] and r.rt == "1.5000"
    assert r.sid == "a-b-3" and r.anon == "sample-000004" and r.ids == ["3", "7"] and r.bools is None and r.half is None


def test_sequence_lengths(spark):
    for given, want in (((100, 10, 50), (40, 10)), ((10, 100, 50), (10, 40)), ((60, 60, 50), (25, 25))):
        s, t = numeric.infer_seqlen(*map(lit, given))
        r = one(spark, s=s, t=t)
        assert (r.s, r.t) == want


def test_codes(spark):
    cells = {(1, 0, 0): 4, (0, 1, 0): 2, (0, 0, 1): 1, (3, 2, 1): 53, (255, 255, 255): 16777215}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "x long, y long, z long, want long")
    z = curves.zorder(F.col("x"), F.col("y"), F.col("z"))
    for r in df.select("*", z.alias("code"), curves.zorder_decode(z).alias("d")).collect():
        assert r.code == r.want and tuple(r.d) == (r.x, r.y, r.z)
    assert str(one(spark, h=curves.fnv_hash(lit(1), lit(2), lit(3))).h) == "15657232601398921515"
    grid = np.array(list(itertools.product(range(8), repeat=3)))
    code = curves.hilbert_codes(grid, 3)
    assert sorted(code) == list(range(512)) and (curves.hilbert_cells(code, 3) == grid).all()
    path = curves.hilbert_cells(np.arange(512), 3)
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
    r = one(spark, g=curves.gray_inverse(curves.gray(lit(12345))))
    assert r.g == 12345


def test_runs(spark):
    bits = spark.createDataFrame([(m, p, b) for m, row in enumerate(([0, 1, 1, 1], [1, 1, 1, 1])) for p, b in enumerate(row)], "mask int, pos int, bit int")
    counts = raster.rle_counts(raster.rle_encode(bits, "mask", "pos", "bit"), "mask", "bit")
    got = {r["mask"]: (r["counts"], r["area"]) for r in counts.select("*", raster.rle_area(F.col("counts")).alias("area")).collect()}
    assert got == {0: ([1, 3], 3), 1: ([0, 4], 4)}
    assert sorted(map(tuple, raster.rle_decode(counts, "mask").collect())) == sorted(map(tuple, bits.collect()))


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, m = map(int, rng.integers(1, 6, 2))
        c = rng.random((n, m))
        got = sum(c[i, j] for i, j in kernels.assignment(c))
        k = min(n, m)
        best = min(sum(c[i, j] for i, j in zip(rows, cols)) for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k))
        assert got == pytest.approx(best) and len(kernels.assignment(c)) == k
    assert kernels.assignment(np.array([[0.1, 0.9], [0.2, 0.3]])) == [(0, 0), (1, 1)]


def test_kernels():
    boxes = np.array([[0, 0, 10, 10], [1, 1, 11, 11], [20, 20, 30, 30]], float)
    assert sorted(kernels.greedy_nms(boxes, np.array([1.0, 2.0, 3.0]), np.arange(3), 0.5)) == [1, 2]
    rng = np.random.default_rng(1)
    blobs = np.concatenate([rng.normal(c, 0.1, (20, 3)) for c in (0, 5, 10)])
    assert len(set(map(tuple, kernels.lloyd(blobs, 3)[0].reshape(3, 20)))) == 3
    merges = kernels.ward(blobs)
    heights = [h for *_, h in merges]
    assert len(merges) == 59 and heights == sorted(heights) and len(set(kernels.cut(merges, 60, 3)[::20])) == 3
    flat = np.c_[rng.random((50, 2)), np.full(50, 2.0)]
    p, inside = kernels.ransac_plane(np.r_[flat, rng.random((10, 3)) * 9], 0.01, 200)
    assert inside[:50].all() and np.allclose(np.abs(p), [0, 0, 1, 2], atol=1e-6)
    m = np.array([[1, 0, 0], [0, 1, 0], [0, 0, 0], [1, 1, 1]], bool)
    assert kernels.label_mask(m).max() == 2
    assert kernels.remove_small(m, 3, False)[0].sum() == 3 and kernels.remove_small(m, 99, True)[0].all()
    assert kernels.merge_groups([{1, 2, 3}, {3, 4}, {2, 3, 9}], lambda x: 1) == [{1, 2, 3, 4, 9}]
    assert kernels.merge_groups([set(range(1, 11)), set(range(10, 21))], lambda x: 1) == [set(range(1, 10)), set(range(10, 21))]
    assert kernels.absorb_masks({1: {7: 2, 8: 1}, 2: {8: 1, 7: 3}}) == {1: 7, 2: 7}
    assert kernels.spanning_tree([(1, 0, 1), (3, 0, 2), (2, 1, 2)], 3) == [(0, 1), (1, 2)]
    assert kernels.farthest_points(np.array([[0.0], [1], [5]]), 2).tolist() == [0, 2]
    assert kernels.merge_small_parts({1: 9, 2: 1, 3: 8}, [(1, 2, 2.0), (2, 3, 1.0)], {2}) == {1: 1, 2: 1, 3: 3}


def test_spatial(spark):
    rng = np.random.default_rng(2)
    x = rng.random((120, 3))
    pts = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "idx long, x double, y double, z double")
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    assert {(r.a, r.b) for r in spatial.radius_pairs(pts, 0.2).collect()} == {(i, j) for i in range(120) for j in range(i + 1, 120) if d[i, j] <= 0.04}
    got = {}
    for r in spatial.knn(pts, pts, 3, crowd=2).collect():
        got.setdefault(r.query, {})[r["rank"]] = r.idx
    for i in range(120):
        assert [got[i][k] for k in (1, 2, 3)] == [j for j in np.argsort(d[i], kind="stable") if j != i][:3]
    frames = spark.createDataFrame([(1, f) for f in (0, 4, 9, 20)], "object long, frame long")
    near = spatial.closest_frames(frames, spark.createDataFrame([(1, 5)], "object long, target long"), 3, 32)
    assert {r.frame for r in near.collect()} == {4, 9, 0}


def test_graphs(spark):
    e = spark.createDataFrame([(1, 1, 2, "A", 1, 0.0, 1.0), (1, 2, 3, "C", 2, 0.0, 1.0), (1, 3, 4, "A", 3, 0.0, 1.0)], "entity int, src int, dst int, kind string, seq int, lo double, hi double")
    start = spark.createDataFrame([(1, 1)], "entity int, node int")
    assert {r.node for r in graph.reachable(e, start).collect()} == {1, 2, 3}
    d = spark.createDataFrame([(1, 1, 2, "D", 1, 0.0, 1.0), (1, 2, 1, "C", 2, 0.0, 1.0)], e.schema)
    assert [(r.src, r.dst, r.kind) for r in graph.motion_graph(d).collect()] == [(2, 1, "C")]
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a int, b int")
    got = {r.node: r.component for r in graph.components(chain).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100
    b = spark.createDataFrame([(k, i) for k, s in enumerate(({0, 1}, {0, 1, 2}, {0, 1}, {2})) for i in s], "basket int, item int")
    sets = graph.itemsets(b, 3)
    assert {tuple(r["items"]): r.n for r in sets.collect()} == {(0,): 3, (1,): 3, (0, 1): 3}
    assert [r["items"] for r in graph.maximal(sets).collect()] == [[0, 1]]


def test_sampling(spark):
    rows = spark.createDataFrame([(i,) for i in range(10)], "idx int")
    pick = lambda a, b: [r.idx for r in sampling.slice_rows(rows, ["idx"], a, b).collect()]
    assert pick(2, 5) == [2, 3, 4] and pick(0, -1) == list(range(10))
    with pytest.raises(ValueError):
        pick(7, 3)
    assert sampling.resample(rows, "idx", 15, 10).count() == 15 and sampling.resample(rows, "idx", 4, 10).count() == 4
    areas = spark.createDataFrame([(0, 1.0), (1, 3.0)], "fid int, area double")
    s = sampling.surface_sample(areas, 4000).collect()
    assert len(s) == 4000 and abs(sum(r.fid for r in s) / 4000 - 0.75) < 0.03 and all(abs(r.u + r.v + r.w - 1) < 1e-9 and min(r.u, r.v, r.w) >= 0 for r in s)


def test_voxels(spark):
    pts = spark.createDataFrame([(0, 0.1, 0.1, 0.1), (1, 0.2, 0.1, 0.1), (2, 0.3, 0.1, 0.1), (3, 1.5, 0.1, 0.1)], "idx int, x double, y double, z double")
    rep = raster.voxel_representative(raster.voxelise(pts, 1.0), [], "idx")
    assert {r.idx for r in rep.collect()} == {1, 3}


def test_augmentations_repeat(spark):
    pts = spark.range(40).select(F.col("id").alias("idx"), (F.col("id") % 3).alias("part"), *[F.rand(1).alias(a) for a in "xyz"], *[(F.col("id") * k % 256).alias(c) for k, c in ((3, "r"), (5, "g"), (7, "b"))])
    run = TRANSFORMS.compose([{"type": t} for t in ("jitter", "rotate", "scale", "flip", "shift", "grayscale", "drop_colour", "auto_contrast", "dropout")])
    first, again = run(pts).orderBy("idx").collect(), run(pts.repartition(5)).orderBy("idx").collect()
    assert 0 < len(first) <= 40 and [r.idx for r in first] == [r.idx for r in again]
    assert augment.views(pts, 2, [{"type": "jitter"}]).count() == 80
    with pytest.raises(KeyError):
        TRANSFORMS.build({"type": "nothing"})


def test_rules(spark):
    parts = spark.createDataFrame([("metal", 7800.0, 2.1e11, 250.0, 0.3, 0.5, 1, True), ("x", 30001.0, 0.0, 1.0, 0.5, 3.1, 9, False)], "material string, density double, young double, hardness double, poisson double, friction double, affordance int, graspable boolean")
    a, b = rules.check_parts(parts, rules.priors(spark)).orderBy("density").collect()
    assert (a.value_issues, a.prior_issues, a.hardness_issues) == ([], [], [])
    assert b.value_issues == ["friction", "young", "poisson", "density"] and b.prior_issues == []
    assert one(spark, r=rules.hardness_ratio(lit(250.0), lit(210.0))).r == pytest.approx(0.011675, abs=1e-6)
    p = spark.createDataFrame([(1, 1000.0, 0.001), (1, 1000.0, 0.002)], "entity int, density double, volume double")
    m = rules.mass_consistency(p, spark.createDataFrame([(1, 1.0)], "entity int, object_mass double")).first()
    assert m.rel_err == pytest.approx(2.0) and m.warning
    t = spark.createDataFrame([(1, 'api_key = "abcdefghijkl"'), (2, "sk-xxx")], "id int, t string")
    assert [r.id for r in rules.secret_hits(t, "id", "t").collect()] == [1]


def test_filters(spark):
    rates = [2.0, 2.1, None, float("nan")]
    got = [one(spark, k=datasets.mass_ok(F.lit(x).cast("double"))).k for x in rates]
    assert got == [True, False, False, False]
    msgs = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (2, 0, "user", "a"), (2, 1, "assistant", "b")], "conv_id int, turn int, role string, text string")
    assert {r.conv_id: (r.aligned, r.pairs) for r in datasets.alignment(msgs).collect()} == {1: (False, 1), 2: (True, 1)}
    assert datasets.turn_pairs(msgs).count() == 2


def test_obj_round_trip(spark):
    pts = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0)], "idx long, x double, y double, z double")
    faces = spark.createDataFrame([(0, 0, 1, 2)], "fid long, v0 long, v1 long, v2 long")
    v, f = mesh.parse_obj(mesh.obj_lines(faces, pts), "line")
    assert sorted(map(tuple, v.collect())) == [(0, 0, 0), (0, 1, 0), (1, 0, 0)] and f.first()[:] == (0, 1, 2)
    assert mesh.face_areas(faces, pts).first().area == 0.5


def test_streams(spark, tmp_path):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    rows = [(1, "a", "running", t0, 1), (1, "a", "succeeded", t0 + timedelta(minutes=1), 2), (2, "a", "failed", t0 + timedelta(minutes=2), 3)]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "entity int, stage string, status string, ts timestamp, event_id int").write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)

    def result(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    got = {(r.entity, r.stage): r.status for r in result(state.stream_latest(stream, ["entity", "stage"]), "complete", "latest")}
    assert got == {(1, "a"): "succeeded", (2, "a"): "failed"}
    counted = result(state.stream_windows(stream, "1 minute", ["stage"]), "complete", "windows")
    assert sum(r.n for r in counted) == 3
    frames = stream.select(F.col("entity").cast("long").alias("object"), F.col("event_id").cast("long").alias("frame"))
    mem = {(r.object, r.frame): r.memory for r in result(state.frame_memory(frames, 2), "append", "memory_bank")}
    assert mem[1, 1] == [] and mem[1, 2] == [1]


def test_gate(spark):
    g = lambda s, same, out, force=False: one(spark, g=state.gate(F.lit(s).cast("string"), lit(same), lit(out), lit(force))).g
    assert (g("succeeded", True, True), g("succeeded", False, True), g(None, False, True), g("failed", True, True), g("succeeded", True, True, True)) == ("skipped", "run", "adopted", "run", "run")


def test_rules_by_hand(spark):
    """Hand-computed rows: priors, soft materials, mass, the joint verdict, credentials."""
    part = "name string, material string, density double, young double, hardness double, poisson double, friction double, affordance int, graspable boolean"
    parts = spark.createDataFrame(
        [
            ("ok", "metal", 7800.0, 2.1e11, 250.0, 0.3, 0.5, 1, False), ("light", "metal", 2600.0, 2.1e11, 250.0, 0.3, 0.9, 1, False),
            ("foam", "foam", 300.0, 1e5, 1.0, 0.2, 0.1, 3, True), ("paper", "paper", 1.0, 1e9, 1.0, 0.4, 0.5, 5, False), ("other", "other", 1.0, 1e9, 1.0, 0.4, 3.1, 5, False),
        ],
        part,
    )
    got = {r.name: r for r in rules.check_parts(parts, rules.priors(spark)).collect()}
    assert {n: r.prior_issues for n, r in got.items()} == {"ok": [], "light": ["density", "friction"], "foam": ["friction"], "paper": [], "other": []}
    assert {n: len(r.hardness_issues) for n, r in got.items()} == {"ok": 0, "light": 0, "foam": 0, "paper": 0, "other": 0}
    assert got["foam"].friction_issues == ["interaction_friction"] and got["other"].value_issues == ["friction"]
    m = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 1.0), (2, 1.0, None), (2, 1.4, 1.0), (3, 0.0, 1.0)], "entity int, density double, volume double")
    o = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, None)], "entity int, object_mass double")
    rows = {r.entity: (r.rel_err and round(r.rel_err, 6), r.warning, r.non_positive, r.missing_volume) for r in rules.mass_consistency(m, o).collect()}
    assert rows == {1: (2.0, True, 0, 0), 2: (0.4, False, 0, 1), 3: (None, False, 1, 0)}
    v = lambda *a: one(spark, v=metrics.verdict(*map(lit, a))).v
    assert (v(True, True, 0.0, 1.0, 1.0, 5), v(True, False, 0.2, 0.3, 1.0, 5), v(True, False, 0.05, 0.3, 1.0, 5)) == (0, 0, 1)
    assert (v(False, True, 0.9, 0.1, 3.0, 5), v(False, False, 0.0, 1.0, 3.1, 5), v(True, True, 0.9, 0.1, 9.0, 0)) == (1, 0, -2)
    t = spark.createDataFrame([(1, 'api_key = "abcdefghij-kl!"'), (2, "sk-abcdefghijklmnop"), (3, "sk-xxx sk-abcdefghijklmnop"), (4, "password = 'abcdefghijklmn'")], "id int, t string")
    assert sorted((r.id, r.rule) for r in rules.secret_hits(t, "id", "t").collect()) == [(1, "assignment"), (2, "key")]


def test_itemsets_of_any_size(spark):
    b = spark.createDataFrame([(k, i) for k in range(3) for i in range(6)] + [(9, 1)], "basket int, item int")
    sets = graph.itemsets(b, 3)
    assert sets.count() == 2**6 - 1
    assert [(r["items"], r.n) for r in graph.maximal(sets).collect()] == [([0, 1, 2, 3, 4, 5], 3)]
