"""Body trees and their models, read back from XML."""

import xml.etree.ElementTree as ET

from kinegrain.operators import bodies as B

SCHEMA = "entity string, part long, parent long, kind string, px double, py double, pz double, ax double, ay double, az double, lo double, hi double, damping double"


def row(entity, part, parent, kind=None, pivot=(0.0, 0.0, 0.0), damping=0.5):
    return (entity, part, parent, kind, *pivot, 0.0, 0.0, 1.0, -0.5, 1.5, damping)


def read_back(xml):
    """{part: (parent, world pivot, joint type)} of a model."""
    out = {}

    def walk(element, parent, origin):
        for body in element.findall("body"):
            part = int(body.get("name").removeprefix("part_"))
            at = tuple(round(o + float(v), 6) for o, v in zip(origin, body.get("pos").split()))
            joint = body.find("joint")
            back = tuple(float(v) for v in body.find("geom").get("pos").split())
            assert all(abs(a + b) < 1e-5 for a, b in zip(at, back))
            out[part] = (parent, at, None if joint is None else joint.get("type"))
            walk(body, part, at)

    root = ET.fromstring(xml)
    walk(root.find("worldbody"), None, (0.0, 0.0, 0.0))
    assert {m.get("name") for m in root.find("asset")} == {f"mesh_{p}" for p in out}
    return out


def test_models_read_back(spark, tmp_path):
    rows = [
        row('a"&<', 0, None), row('a"&<', 1, 0, "C", (1.0, 2.0, 3.0)), row('a"&<', 2, 1, "B", (1.5, 2.0, -3.0), None), row('a"&<', 10, 1), row('a"&<', 3, 0, None, (None, None, None)), row('a"&<', 12, 10, "C"),
        row("two", 5, None, "C"), row("two", 6, None), row("two", 6, None),
    ]
    tree = B.body_tree(spark.createDataFrame(rows, SCHEMA))
    got = {r.entity: r.xml for r in B.body_models(tree).collect()}
    one, two = read_back(got['a"&<']), read_back(got["two"])
    assert one == {0: (None, (0, 0, 0), None), 1: (0, (1, 2, 3), "hinge"), 2: (1, (1.5, 2, -3), "slide"), 10: (1, (0, 0, 0), None), 3: (0, (0, 0, 0), None), 12: (10, (0, 0, 0), "hinge")}
    assert two == {5: (None, (0, 0, 0), "hinge"), 6: (None, (0, 0, 0), None)} and ET.fromstring(got['a"&<']).get("model") == 'a"&<'
    roles = {(r.motion, r.part): r.role for r in B.motion_roles(tree).where("entity <> 'two'").collect()}
    assert {p for (m, p), r in roles.items() if m == 1 and r == "child"} == {2, 10, 12} and roles[1, 1] == "motion" and roles[2, 1] == "base" and len(roles) == 3 * 6
    B.write_models(B.body_models(tree.where("entity = 'two'")), str(tmp_path / "models"))
    back = spark.read.text(str(tmp_path / "models"), wholetext=True).collect()
    assert [(r.entity, read_back(r.value)) for r in back] == [("two", two)]


def test_errors_and_long_chains(spark):
    rows = [row("chain", i, i - 1 if i else None) for i in range(300)] + [row("loop", 0, None), row("loop", 1, 3), row("loop", 2, 1), row("loop", 3, 2), row("loop", 4, 3), row("self", 7, 7)]
    rows += [row("lost", 1, 99), row("lost", 2, 1), row("lost", 3, None)]
    got = {(r.entity, r.part): r for r in B.body_paths(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got["chain", i].level == i and got["chain", i].error is None for i in range(300)) and got["chain", 2].path == "0000000000/0000000001/0000000002"
    assert [got["loop", i].error for i in range(5)] == [None, "cycle", "cycle", "cycle", "cycle"] and got["self", 7].error == "cycle"
    assert [got["lost", i].error for i in (1, 2, 3)] == ["no parent", "no parent", None] and got["lost", 1].path is None
    assert B.body_models(B.body_tree(spark.createDataFrame([], SCHEMA))).count() == 0
