"""GLB, NPZ, NPY and named files: formats by hand, and writes that fail."""

import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinegrain.sources import binary, records


def glb(document, data):
    text = json.dumps(document).encode()
    text += b" " * (-len(text) % 4)
    body = struct.pack("<II", len(text), binary.GLB_JSON) + text + struct.pack("<II", len(data), binary.GLB_BIN) + data
    return struct.pack("<III", binary.GLB_MAGIC, 2, 12 + len(body)) + body


def scene():
    """A square of four points as triangles (mirrored, under a moved parent), as a strip, as a fan, and without indices; and points that are no triangles."""
    square = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [1, 1, 0]], "<f4")
    spaced = np.zeros((4, 5), "<f4")
    spaced[:, 1:4] = square
    order = np.array([0, 1, 2, 2, 1, 3], "<u2")
    sparse_at, sparse = np.array([3], "<u1"), np.array([[5, 5, 5]], "<f4")
    data, views = b"", []
    for raw, step in ((spaced.tobytes(), 20), (order.tobytes(), None), (sparse_at.tobytes(), None), (sparse.tobytes(), None)):
        data += b"\0" * (-len(data) % 4)
        views.append({"buffer": 0, "byteOffset": len(data), "byteLength": len(raw), **({"byteStride": step} if step else {})})
        data += raw
    position = {"bufferView": 0, "byteOffset": 4, "componentType": 5126, "count": 4, "type": "VEC3"}
    return glb(
        {
            "asset": {"version": "2.0"}, "buffers": [{"byteLength": len(data)}], "bufferViews": views, "scene": 0, "scenes": [{"nodes": [0, 4]}],
            "accessors": [position, {"bufferView": 1, "componentType": 5123, "count": 6, "type": "SCALAR"}, {**position, "sparse": {"count": 1, "indices": {"bufferView": 2, "componentType": 5121}, "values": {"bufferView": 3}}}],
            "nodes": [{"children": [1, 2], "translation": [10, 0, 0]}, {"mesh": 0, "scale": [-1, 1, 1]}, {"mesh": 1, "name": "turned", "rotation": [0, 0, 2**-0.5, 2**-0.5]}, {"mesh": 0}, {"mesh": 2, "matrix": [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 3, 1]}],
            "meshes": [{"name": "plain", "primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}, {"primitives": [{"attributes": {"POSITION": 0}, "mode": 5}, {"attributes": {"POSITION": 0}, "mode": 6}]}, {"name": "odd", "primitives": [{"attributes": {"POSITION": 2}}, {"attributes": {"POSITION": 0}, "mode": 0}]}],
        },
        data,
    )


def test_glb_by_hand(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.glb").write_bytes(scene())
    rows = binary.register(spark).read.format("glb").load(str(tmp_path)).orderBy("fid").collect()
    assert [(r.geometry, r.name) for r in rows] == [(0, "plain")] * 2 + [(1, "turned")] * 2 + [(2, "turned")] * 2 + [(3, "odd")] and {r.file for r in rows} == {"one"}
    corners = [tuple(tuple(round(r[n + a], 6) for a in "xyz") for n in "pqr") for r in rows]
    assert corners[0] == ((10, 1, 0), (9, 0, 0), (10, 0, 0))  # mirrored, so turned round
    assert corners[2] == ((10, 0, 0), (10, 1, 0), (9, 0, 0)) and corners[3] == ((10, 1, 0), (9, 1, 0), (9, 0, 0))
    assert corners[5] == ((10, 0, 0), (9, 0, 0), (9, 1, 0)) and corners[6] == ((0, 0, 3), (1, 0, 3), (0, 1, 3))
    for bad in (b"", b"glTF" + b"\0" * 20, b"x" * 40):
        with pytest.raises((ValueError, struct.error)):
            list(binary.glb_geometries(bad))


def test_glb_round_trip_of_odd_names(spark, tmp_path):
    rows = [("f", n, k, *[float(v) for v in range(k, k + 9)]) for n in ("b", "a", "") for k in range(3)]
    df = spark.createDataFrame(rows, "file string, name string, fid long, " + ", ".join(f"{x} double" for x in binary.COORDINATES))
    binary.save_files(df, "glb", str(tmp_path / "g"))
    back = spark.read.format("glb").load(str(tmp_path / "g")).orderBy("fid").collect()
    assert [r.name for r in back] == ["node_0"] * 3 + ["a"] * 3 + ["b"] * 3 and [r.px for r in back] == [0, 1, 2] * 3 and [r.fid for r in back] == list(range(9))


def test_npz_and_npy(spark, tmp_path):
    cloud = spark.range(70_000).select(F.lit("c").alias("file"), F.col("id").alias("idx"), *[(F.col("id") % 97).cast("float").alias(a) for a in "xyz"], *[(F.col("id") % 256).cast("short").alias(a) for a in "rgb"], *[F.lit(0.5).cast("float").alias(f"n{a}") for a in "xyz"])
    binary.save_files(cloud.repartition(5), "npz", str(tmp_path / "z"))
    assert sorted(np.load(tmp_path / "z" / "c.npz").files) == ["color", "normal", "point"]
    back = spark.read.format("npz").load(str(tmp_path / "z"))
    assert back.count() == 70_000 and back.where("x <> idx % 97 or r <> idx % 256 or nx <> 0.5").count() == 0
    assert records.npz_points(spark, str(tmp_path / "z")).count() == 70_000
    np.save(tmp_path / "m.npy", np.arange(24).reshape(2, 3, 4))
    m = spark.read.format("npy").load(str(tmp_path / "m.npy")).collect()
    assert all(r.value == 12 * r.layer + 4 * r.row + r.col for r in m) and len(m) == 24
    assert spark.read.format("npy").load(str(tmp_path / "z")).count() == 0


def files_in(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names)


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "n")
    good = spark.createDataFrame([("a/x.txt", bytearray(b"1")), ("b.txt", bytearray(b"2"))], "file string, content binary")
    binary.save_files(good, "named_files", path)
    assert files_in(path) == ["a/x.txt", "b.txt"]
    fails = F.when(F.col("file") == "z.txt", F.raise_error(F.lit("stop")).cast("binary")).otherwise(F.col("content"))
    more = spark.createDataFrame([(f"m{i}.txt", bytearray(b"3")) for i in range(20)] + [("z.txt", bytearray(b"4"))], good.schema)
    dealt = more.repartition(4, "file").sortWithinPartitions("file").select("file", fails.alias("content"))
    with pytest.raises(Exception):
        dealt.write.format("named_files").mode("append").save(path)
    assert files_in(path) == ["a/x.txt", "b.txt"] and not [d for d in os.listdir(path) if d.startswith(".")]
    binary.save_files(spark.createDataFrame([("new.txt", bytearray(b"5"))], good.schema), "named_files", path, overwrite=True)
    assert files_in(path) == ["new.txt"]
    twice = spark.createDataFrame([("t.txt", bytearray(b"1"))], good.schema).union(spark.createDataFrame([("t.txt", bytearray(b"2"))], good.schema))
    with pytest.raises(Exception):
        twice.write.format("named_files").mode("append").save(path)
    with pytest.raises(Exception):
        binary.save_files(spark.createDataFrame([("../out.txt", bytearray(b"1"))], good.schema), "named_files", path)
    assert files_in(path) == ["new.txt"] and files_in(tmp_path) == ["n/new.txt"]


def test_meshes_of_many_files(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.obj").write_text("".join(f"v {i} 0 {len(name)}\n" for i in range(50)) + "f 1 2 3\nf 2//1 3//1 50//2\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        points, faces = records.obj_meshes(spark, str(tmp_path))
        assert points.where("idx <> x").count() == 0 and points.count() == 100
        assert sorted((r.file[-5], r.fid, r.v2) for r in faces.collect()) == [("a", 0, 2), ("a", 1, 49), ("b", 0, 2), ("b", 1, 49)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
