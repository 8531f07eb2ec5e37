"""Clouds, mesh files, mask suppression, templates and object validation against plain code."""

import json
import struct
import zlib

import numpy as np
import pytest

from kinegrain.functions import templates as T
from kinegrain.operators import clouds as C
from kinegrain.operators import spatial as S
from kinegrain.operators.validation import validate_objects
from kinegrain.sources import meshes as M

POINT = "idx long, x double, y double, z double"


def test_knn_of_clusters_copies_and_gaps(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1e-4, (60, 3)), np.zeros((20, 3)), rng.random((30, 3)) * 100])
    rows = [(i, *map(float, p)) for i, p in enumerate(x)]
    pts = spark.createDataFrame(rows + [(900, None, 0.0, 0.0), (901, float("nan"), 0.0, 0.0)], POINT)
    far = spark.createDataFrame([(0, 500.0, 0.0, 0.0), (1, 0.0, 0.0, 0.0)], POINT)
    for queries, at, skip in ((pts, x, True), (far, np.array([[500.0, 0, 0], [0, 0, 0]]), False)):
        got = {(r.query, r["rank"]): r.idx for r in S.knn(queries, pts, 4, skip, crowd=8).collect()}
        want = {}
        for i, p in enumerate(at):
            d = ((p - x) ** 2)
            order = sorted((j for j in range(len(x)) if not (skip and i == j)), key=lambda j: (d[j][0] + d[j][1] + d[j][2], j))
            want.update({(i, k + 1): j for k, j in enumerate(order[:4])})
        assert got == want
    assert S.knn(pts.limit(0), pts, 2).count() == 0 and S.knn(pts, pts.limit(0), 2).count() == 0


def test_outliers(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.random((80, 3)), [[9.0, 9, 9]]])
    pts = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], POINT)
    m = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), axis=1)[:, :5].mean(1)
    want = {i for i in range(81) if 0 < m[i] < m.mean() + 2 * m.std(ddof=1)}
    assert 80 not in want and {r.idx for r in C.without_outliers(pts, 5).collect()} == want
    shares = spark.createDataFrame([(0.5, 1.0, 0.0)], "r double, g double, b double")
    assert C.byte_colours(shares).first()[:] == (127, 255, 0) and C.byte_colours(shares.withColumn("g", shares.g * 7)).first().g == 7


def test_elastic_distortion(spark):
    x = np.random.default_rng(7).random((40, 3)) * 2
    pts = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)] + [(99, None, 0.0, 0.0)], POINT)
    low, high = x.min(0), x.max(0)
    low[1:], high[1:] = np.minimum(low[1:], 0), np.maximum(high[1:], 0)
    grid = C.noise_grid(tuple(int(n) + 3 for n in (high - low) // 0.5), 3)
    got = {r.idx: (r.x, r.y, r.z) for r in C.elastic_distortion(pts, 0.5, 0.4, 3).collect()}
    for i, p in enumerate(x):
        at = (p - low) / 0.5 + 1
        moved = np.zeros(3)
        for c in np.ndindex(2, 2, 2):
            node = np.floor(at).astype(int) + c
            moved += np.prod(1 - np.abs(at - node)) * grid[tuple(node)]
        assert np.allclose(got[i], p + 0.4 * moved)
    assert got[99][1:] == (0, 0) and C.elastic_distortion(pts.limit(0), 0.5, 0.4).count() == 0
    with pytest.raises(ValueError):
        C.elastic_distortion(pts, 1e-3, 0.4)
    # twice a mean of three: an inner node's weights are (1, 2, 3, 2, 1) / 9 along each axis
    noise = np.random.default_rng(1).standard_normal((7, 7, 7, 3)).astype("f4")
    w = np.array([1, 2, 3, 2, 1]) / 9
    assert np.allclose(C.noise_grid((7, 7, 7), 1)[3, 3, 3], np.einsum("i,j,k,ijkc->c", w, w, w, noise[1:6, 1:6, 1:6]), atol=1e-5)


def test_mask_nms(spark):
    rng = np.random.default_rng(8)
    masks = rng.random((12, 30)) < rng.random((12, 1))
    masks[3], masks[4] = np.arange(30) < 25, np.arange(30) < 6
    for scores in (rng.random(12), np.full(12, 0.05)):
        order = sorted(range(12), key=lambda i: (-scores[i], i))
        area = masks.sum(1)
        inter = (masks[:, None] & masks[None]).sum(2)
        inside = lambda i, j: 1 - inter[i, j] ** 2 / area[i] / area[j] if inter[i, j] / area[i] >= 0.85 and inter[i, j] / area[j] < 0.5 else 0  # noqa: B023, E731
        good = [max([inter[i, j] / (area[i] + area[j] - inter[i, j]) for j in order[:r]], default=0) <= 0.7 for r, i in enumerate(order)]
        for test in (
            [scores[i] > 0.1 for i in order],
            [max([inside(i, j) for j in order[:r]], default=0) <= 0.8 for r, i in enumerate(order)],
            [max([inside(i, j) for j in order[r + 1 :]], default=0) <= 0.8 for r, i in enumerate(order)],
        ):
            if not any(test):
                test = [True] * 3 + [False] * 9
            good = [a and b for a, b in zip(good, test)]
        m = spark.createDataFrame([(1, i, float(scores[i]), float(area[i])) for i in range(12)], "grp int, id int, score double, area double")
        p = spark.createDataFrame([(1, i, j, float(inter[i, j])) for i in range(12) for j in range(i) if inter[i, j]], "grp int, a int, b int, inter double")
        assert {r.id for r in C.mask_nms(p, m).collect()} == {i for i, ok in zip(order, good) if ok}


def test_multi_view_loss(spark):
    matches = spark.createDataFrame([(1, 1, 1, 0.5), (1, 1, 2, 1.0)], "entity int, view int, mask int, iou double")
    views = spark.createDataFrame([(1, 1, 1, 7, 2.0), (1, 1, 2, 7, 2.0), (1, 1, 2, 8, 1.0), (1, 1, 3, 9, 5.0), (1, 2, 1, 7, 2.0)], "entity int, view int, mask int, fid int, area double")
    surface = spark.createDataFrame([(1, 6.0)], "entity int, surface double")
    # view 1: mean IoU 0.75, faces 7 and 8 are half the surface; view 2 has no match
    assert C.multi_view_loss(matches, views, surface).first().loss == pytest.approx(((1 - 0.75 * 0.5) + 1) / 2)


def test_ply(spark, tmp_path):
    head = b"ply\nformat binary_little_endian 1.0\ncomment c\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    (tmp_path / "a.ply").write_bytes(head + struct.pack("<fffBBBfffBBB", 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12) + struct.pack("<Biii", 3, 0, 1, 1))
    (tmp_path / "b.ply").write_text("ply\nformat ascii 1.0\nelement vertex 1\nproperty double x\nproperty double y\nproperty double z\nend_header\n0.5 1 2\n")
    (tmp_path / "c.ply").write_text("ply\nformat ascii 1.0\nelement vertex 0\nproperty double x\nproperty double y\nproperty double z\nend_header\n")
    rows = M.ply_points(spark, str(tmp_path)).orderBy("cloud", "idx").collect()
    assert [r[2:] for r in rows[:2]] == [(1, 2, 3, 4, 5, 6), (7, 8, 9, 10, 11, 12)] and rows[2].x == 0.5 and rows[2].r is None and len(rows) == 3
    pts = spark.createDataFrame([(0, 0.5, 1.0, 2.0, 9)], POINT + ", label int")
    colours = M.label_colours(pts.select("label"), [(1, 2, 3), (4, 5, 6)])
    lines = [r.line for r in M.ply_lines(pts.join(colours, "label")).collect()]
    assert lines[0].split("\n")[2] == "element vertex 1" and lines[1] == "0.5 1.0 2.0 1 2 3"


def test_obj_files(spark, tmp_path):
    pts = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(6)], POINT)
    faces = spark.createDataFrame([(0, 5, 4, 3, 8), (1, 0, 1, 3, 2), (2, 3, 5, 4, 8)], "fid long, v0 long, v1 long, v2 long, part long")
    own, cut = M.part_meshes(faces, pts)
    M.write_part_objs(own, cut, str(tmp_path / "o"))
    text = {n: [r.value for r in spark.read.text(str(tmp_path / "o" / f"number={n}")).collect()] for n in (1, 2)}
    assert text == {1: ["v 3.0 0.0 0.0", "v 4.0 0.0 0.0", "v 5.0 0.0 0.0", "f 3 2 1", "f 1 3 2"], 2: ["v 0.0 0.0 0.0", "v 1.0 0.0 0.0", "v 3.0 0.0 0.0", "f 1 2 3"]}
    lines = [r.line for r in M.material_obj_lines(pts.limit(1), faces.limit(1), "m.mtl").collect()]
    assert lines == ["mtllib m.mtl\nusemtl m1", "v 0.000000 0.000000 0.000000", "f 5 4 3"]
    assert M.mtl_text((0.5, 0, 1)) == "newmtl m1\nKd 0.500000 0.000000 1.000000\nKa 0 0 0\n"


def test_exr(spark, tmp_path):
    plane = np.arange(40 * 7, dtype="f4").reshape(40, 7)
    plain = M.exr_bytes(plane)
    assert (M.read_exr(plain) == plane).all()
    # the same lines by ZIP, 16 a block
    head_end = plain.index(b"screenWindowWidth") + len("screenWindowWidth\0float\0") + 8 + 1
    head = plain[:head_end].replace(b"compression\0compression\0\x01\0\0\0\0", b"compression\0compression\0\x01\0\0\0\x03")
    blocks = []
    for y in range(0, 40, 16):
        raw = b"".join(plane[i].tobytes() * 3 for i in range(y, min(40, y + 16)))
        halves = np.frombuffer(raw[0::2] + raw[1::2], "u1").astype("i8")
        halves[1:] = (np.diff(halves) + 128) & 255
        data = zlib.compress(halves.astype("u1").tobytes())
        blocks.append(struct.pack("<ii", y, len(data)) + data)
    starts = np.cumsum([len(head) + 8 * len(blocks)] + [len(b) for b in blocks[:-1]])
    packed = head + struct.pack("<3Q", *map(int, starts)) + b"".join(blocks)
    assert (M.read_exr(packed) == plane).all()
    (tmp_path / "v1.exr").write_bytes(packed)
    rows = M.exr_pixels(spark, str(tmp_path)).collect()
    assert len(rows) == 280 and all(r.face_id == r.row * 7 + r["col"] and r.view == "v1" for r in rows)
    with pytest.raises(ValueError):
        M.read_exr(plain, "A")


def test_templates():
    t = T.ChatTemplate(user=("<user>it's {{content}}</s>",), system=("{{content}}\n",), prefix=(frozenset({"bos_token"}),), default_system="don't", stop_words=("<end>", "<tool>"), replace_eos=True)
    words = T.special_tokens(t, T.Vocabulary(bos_token="<s>", eos_token="</s>"))
    assert words == T.Vocabulary("<s>", "<end>", "<end>", ("<tool>",))
    text = T.jinja_text(t, words)
    assert text.startswith("{{ '<s>' }}{% set system_message = 'don\\'t' %}{% if messages[0]['role'] == 'system' %}")
    assert "{{ '<user>it\\'s ' + content + '</s>' }}{% elif" in text and "{{ content + '<end>' }}{% endif %}{% endfor %}" in text and "{{ system_message + '\n' }}" in text
    assert T.special_tokens(T.ChatTemplate(), T.Vocabulary()).pad_token == T.DEFAULT_EOS
    with pytest.raises(ValueError):
        T.special_tokens(T.ChatTemplate(replace_eos=True), T.Vocabulary())
    T.register("plain-test", T.ChatTemplate())
    with pytest.raises(ValueError):
        T.register("plain-test", T.ChatTemplate())
    assert T.named("plain-test", "hi").default_system == "hi" and T.named("plain-test").default_system == ""
    with pytest.raises(ValueError):
        T.named(None)


def test_validate_objects(spark):
    part = {"label": 1, "name": "leg", "material": "metal/steel", "density": "7.8 g/cm^3", "Young's Modulus (GPa)": 200.0, "Poisson's Ratio": 0.3, "friction_coefficient": 0.1, "Hardness (HV)": 150.0, "priority_rank": 1, "graspable": False}
    whole = {"dimension": "20*10*5 cm", "mass": "7.8 kg", "parts": [part]}
    texts = {1: json.dumps(whole), 2: "not json", 3: json.dumps({**whole, "dimension": "wide"}), 4: json.dumps({**whole, "mass": "heavy"}), 5: json.dumps(whole), 6: None, 7: json.dumps({**whole, "parts": []})}
    a = spark.createDataFrame(list(texts.items()), "entity long, text string")
    e = spark.createDataFrame([(i, 2.0, 1.0, 0.5) for i in (1, 2, 3, 4, 6, 7)], "entity long, dx double, dy double, dz double")
    v = spark.createDataFrame([(1, 1, 1.0)], "entity long, label long, volume double")
    got = {r.entity: r for r in validate_objects(a, e, v).collect()}
    # 1000 cm3 over a unit box, so the part is 1e-3 m3 of 7800 kg/m3
    assert got[1].rel_err == pytest.approx(0) and not got[1].warning and got[1].error is None
    assert [tuple(i) for i in got[1].issues] == [(1, "friction"), (1, "interaction_friction")]
    assert [got[i].error for i in range(2, 8)] == ["no parts", "dimension", "mass", "extents", "no parts", None] and got[7].issues is None
