"""Sources, sinks, stages and the predictor hook."""

import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinegrain.plans import stages
from kinegrain.sources import records, store


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_records(spark, tmp_path):
    for name, text in (("a.json", '{"x": 1}'), ("b/c.json", '[{"x": 2}, 3]'), ("d.json", '{"records": [{"x": 4}]}'), ("e.json", "not json"), ("f.txt", "{}")):
        write(str(tmp_path / name), text)
    rows = records.records(records.json_files(spark, [str(tmp_path)]))
    got = sorted((os.path.basename(r.path), r.pos, r.x, r.error) for r in rows.select("path", "pos", F.try_variant_get("record", "$.x", "int").alias("x"), "error").collect())
    assert got == [("a.json", 0, 1, None), ("c.json", 0, 2, None), ("c.json", 1, None, "not an object"), ("d.json", 0, 4, None), ("e.json", 0, None, "not JSON")]


def test_annotations(spark, tmp_path):
    for e, parts in (("m1", (1, 2)), ("m2", (3,))):
        for p in parts:
            write(str(tmp_path / e / "annotations" / f"part_{p}.json"), json.dumps({"p": p}))
    write(str(tmp_path / "m1" / "annotations" / "object.json"), "{}")
    objects, parts = records.annotations(spark, str(tmp_path))
    assert [r.entity for r in objects.collect()] == ["m1"] and sorted(r.part for r in parts.collect()) == ["1", "2"]


def test_points_and_meshes(spark, tmp_path):
    p = np.arange(12, dtype="f4").reshape(4, 3)
    np.savez(tmp_path / "a.npz", point=p, color=np.full((4, 3), 200, "u1"))
    rows = records.npz_points(spark, str(tmp_path)).orderBy("idx").collect()
    assert [r.x for r in rows] == [0, 3, 6, 9] and rows[0].r == 200 and rows[0].nz == 0
    write(str(tmp_path / "m.obj"), "# c\nv 0 0 0\nv 1 0 0\nv 0 1 0\nf 1/1/1 2/2/2 3/3/3\n")
    points, faces = records.obj_mesh(spark, str(tmp_path / "m.obj"))
    assert points.count() == 3 and faces.select("v0", "v1", "v2").first()[:] == (0, 1, 2)
    assert records.binary_listing(spark, str(tmp_path), "*.npz").first().stem == "a"


def test_datasets_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "b", 1.5)], "id int, task string, x double")
    store.write_json_lines(df, str(tmp_path / "j"), ["task"])
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    store.write_strict_json(df, str(tmp_path / "s"))
    assert records.dataset(spark, str(tmp_path / "s")).count() == 2
    with pytest.raises(ValueError):
        store.write_strict_json(df.withColumn("x", F.lit(float("nan"))), str(tmp_path / "n"))
    write(str(tmp_path / "mixed" / "a.csv"), "x\n1\n")
    write(str(tmp_path / "mixed" / "b.json"), "{}")
    with pytest.raises(ValueError):
        records.dataset(spark, str(tmp_path / "mixed"))
    made = []
    build = lambda: made.append(1) or df
    for _ in range(2):
        assert store.cached_dataset(spark, str(tmp_path / "cache"), build).count() == 2
    assert made == [1]


def test_stages():
    s = stages.Stages()
    same = lambda df: df
    s.add(stages.Stage("render", 1, same))
    s.add(stages.Stage("split", 3, same, ("merge",)))
    s.add(stages.Stage("merge", 2, same, ("render",)))
    assert [x.name for x in s.ordered()] == ["render", "merge", "split"]
    assert [x.name for x in s.with_needs("split")] == ["render", "merge", "split"] and [x.name for x in s.between(2, 3)] == ["merge", "split"]
    with pytest.raises(KeyError):
        s.get("none")
    loop = stages.Stages({"a": stages.Stage("a", 1, same, ("b",)), "b": stages.Stage("b", 2, same, ("a",))})
    with pytest.raises(ValueError):
        loop.ordered()


def test_predictor(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "id int").coalesce(1)

    def picky(pdf: pd.DataFrame) -> pd.Series:
        if (pdf["id"] == 2).any():
            raise ValueError("two")
        return pdf["id"].astype(str)

    got = {r.id: (r.raw_response, r.error) for r in stages.predict(df, picky).collect()}
    assert got == {1: ("1", None), 2: (None, "ValueError: two"), 3: ("3", None)}


def test_command_line(capsys):
    stages.main(["list"])
    assert "eval_kinematic_report" in capsys.readouterr().out
