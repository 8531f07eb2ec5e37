"""Queries that write files to the shared folder and read them back through the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import binary, meshes, records
from ..sources.store import shared_dir
from .q_volumes import BOX, TETRAHEDRON, solid_faces, solid_points
from .q_volumes import KEYS, V
from .registry import query
from .views import table, view

c = F.col


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _text_files(rows: DataFrame, path: str) -> None:
    """Files of rows (file, text)."""
    binary.save_files(rows.select("file", F.encode("text", "UTF-8").alias("content")), "named_files", path)


_CORNER = ", ".join(f"({o} + {d} * ((v[{k + 1}] >> {i}) & 1))::float::double as {n}{x}" for k, n in enumerate("pqr") for i, (x, o, d) in enumerate((("x", "ox", "a"), ("y", "oy", "b"), ("z", "oz", "c"))))


@query(f"""with t as (select *, unnest(case label when 0 then {[list(x) for x in BOX]} else {[list(x) for x in TETRAHEDRON]} end) as v,
    unnest(range(case label when 0 then 12 else 4 end)) as k from {{solids}})
select entity, label, row_number() over (partition by entity order by label, k) - 1 as fid, {_CORNER} from t""")
def glb_round_trip(spark, sf_dir):
    faces, points = solid_faces(spark, sf_dir), solid_points(spark, sf_dir).select("idx", *"xyz")
    t = V.triangles(faces.withColumn("n", c("fid")), points, [*KEYS, "n"])
    path = _folder(spark, "glb")
    binary.save_files(t.select(c("entity").cast("string").alias("file"), c("label").cast("string").alias("name"), c("n").alias("fid"), *binary.COORDINATES), "glb", path)
    back = spark.read.format("glb").load(path)
    return back.select(c("file").cast("long").alias("entity"), c("name").cast("long").alias("label"), "fid", *binary.COORDINATES)


@query("""select part, row_number() over (partition by part order by idx) - 1 as idx, x::float::double as x, y::float::double as y, z::float::double as z, r, g, b,
    nx::float::double as nx, ny::float::double as ny, nz::float::double as nz from {points}""")
def npz_round_trip(spark, sf_dir):
    p, path = view(spark, sf_dir, "points"), _folder(spark, "npz")
    cloud = [c("part").cast("string").alias("file"), "idx", *[c(a).cast("float").alias(a) for a in "xyz"], *[c(a).cast("short").alias(a) for a in "rgb"], *[c(f"n{a}").cast("float").alias(f"n{a}") for a in "xyz"]]
    binary.save_files(p.select(*cloud), "npz", path)
    back = spark.read.format("npz").load(path)
    wide = [c(a).cast("double").alias(a) for a in ("x", "y", "z", "nx", "ny", "nz")]
    return back.select(c("file").cast("long").alias("part"), "idx", *wide, *[c(a).cast("long").alias(a) for a in "rgb"])


@query("select view, prow::int as row, pcol::int as col, max(mask) + 1 as value from {pixels} group by 1, 2, 3")
def npy_round_trip(spark, sf_dir):
    p = view(spark, sf_dir, "pixels").groupBy("view", c("prow").cast("int").alias("row"), c("pcol").cast("int").alias("col")).agg((F.max("mask") + 1).alias("value"))
    path = _folder(spark, "npy")
    binary.save_files(p.select(F.concat(c("view").cast("string"), F.lit("_s")).alias("file"), F.lit(0).alias("layer"), "row", "col", "value"), "npy", path)
    back = spark.read.format("npy").load(path).where("value > 0")
    return back.select(F.split("file", "_")[0].cast("long").alias("view"), "row", "col", "value")


@query("""select 'e' || s_suppkey as entity, k::varchar as part, s_nationkey + k as v from supplier, range(3) r(k) where k < s_suppkey % 4 and s_suppkey % 5 <> 0""")
def annotation_tree(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("e"), c("s_suppkey").cast("string"), F.lit("/annotations/")).alias("folder"), "s_suppkey", "s_nationkey")
    objects = s.where("s_suppkey % 5 <> 0").select(F.concat("folder", F.lit("object.json")).alias("file"), F.to_json(F.struct(c("s_nationkey").alias("n"))).alias("text"))
    parts = s.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).where("k < s_suppkey % 4")
    parts = parts.select(F.concat("folder", F.lit("part_"), c("k").cast("string"), F.lit(".json")).alias("file"), F.to_json(F.struct((c("s_nationkey") + c("k")).alias("v"))).alias("text"))
    path = _folder(spark, "tree")
    _text_files(objects.unionByName(parts), path)
    return records.annotations(spark, path)[1].select("entity", "part", F.variant_get("v", "$.v", "long").alias("v"))


@query("""with s as (select s_suppkey as id, s_suppkey % 4 as kind from supplier)
select id, 0 as pos, id as x, null::varchar as error from s where kind = 0 union all
select id, 0, id, null from s where kind = 1 union all select id, 1, null, 'not an object' from s where kind = 1 union all
select id, p::int, id + p, null from s, range(2) r(p) where kind = 2 union all select id, 0, null, 'not JSON' from s where kind = 3""")
def json_file_records(spark, sf_dir):
    one = F.concat(F.lit('{"x": '), c("s_suppkey").cast("string"), F.lit("}"))
    two = F.concat(F.lit('{"x": '), (c("s_suppkey") + 1).cast("string"), F.lit("}"))
    texts = F.array(one, F.concat(F.lit("["), one, F.lit(", 7]")), F.concat(F.lit('{"records": ['), one, F.lit(", "), two, F.lit("]}")), F.concat(F.lit("{"), one))
    files = table(spark, sf_dir, "supplier").select(F.concat(c("s_suppkey").cast("string"), F.lit(".json")).alias("file"), F.get(texts, (c("s_suppkey") % 4).cast("int")).alias("text"))
    path = _folder(spark, "records")
    _text_files(files, path)
    rows = records.records(records.json_files(spark, [path, path]))
    stem = F.regexp_extract("path", r"(\d+)\.json$", 1).cast("long")
    return rows.select(stem.alias("id"), "pos", F.try_variant_get("record", "$.x", "long").alias("x"), "error")


@query("""with n as (select part, row_number() over (order by min(fid)) as number from {faces} group by 1),
    u as (select distinct part, unnest([v0, v1, v2]) as v from {faces}), k as (select part, v, row_number() over (partition by part order by v) - 1 as new from u),
    f as (select number, f.part, row_number() over (partition by f.part order by fid) - 1 as fid, v0, v1, v2 from {faces} f join n on f.part = n.part)
select number, fid, a.new as v0, b.new as v1, d.new as v2, round(x.x + y.y + z.z, 4) as mix from f
    join k a on f.part = a.part and f.v0 = a.v join k b on f.part = b.part and f.v1 = b.v join k d on f.part = d.part and f.v2 = d.v
    join {points} x on x.idx = f.v0 join {points} y on y.idx = f.v1 join {points} z on z.idx = f.v2""")
def part_obj_files(spark, sf_dir):
    points, faces = meshes.part_meshes(view(spark, sf_dir, "faces"), view(spark, sf_dir, "points").select("idx", *"xyz"))
    path = _folder(spark, "parts")
    meshes.write_part_objs(points, faces, path)
    number = F.regexp_extract("file", r"number=(\d+)/", 1).cast("int")
    v, f = (x.withColumn("number", number).drop("file") for x in records.obj_meshes(spark, path))
    for k, a in enumerate("xyz"):
        f = f.join(v.select("number", c("idx").alias(f"v{k}"), c(a).alias(f"_{a}")), ["number", f"v{k}"])
    return f.select("number", "fid", "v0", "v1", "v2", F.round(c("_x") + c("_y") + c("_z"), 4).alias("mix"))


@query("select part, row_number() over (partition by part order by idx) - 1 as idx, x, y, z, r::double as r, g::double as g, b::double as b from {points}")
def ply_file_points(spark, sf_dir):
    p = view(spark, sf_dir, "points")
    line = F.concat_ws(" ", *[c(a).cast("string") for a in ("x", "y", "z", "r", "g", "b")])
    cloud = p.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))).alias("lines"))
    head = "".join(f"property {k} {n}\n" for k, n in [*(("double", a) for a in "xyz"), *(("uchar", a) for a in ("red", "green", "blue"))])
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    text = F.concat(F.lit("ply\nformat ascii 1.0\nelement vertex "), F.size("lines").cast("string"), F.lit(f"\n{head}end_header\n"), body, F.lit("\n"))
    path = _folder(spark, "ply")
    _text_files(cloud.select(F.concat(c("part").cast("string"), F.lit(".ply")).alias("file"), text.alias("text")), path)
    back = meshes.ply_points(spark, path)
    return back.select(F.regexp_extract("cloud", r"([^/]+)\.ply$", 1).cast("long").alias("part"), "idx", *"xyz", *"rgb")


@query("select view::varchar as view, prow::int as row, pcol::int as col, max(face) + 1 as face_id from {pixels} group by 1, 2, 3")
def exr_file_pixels(spark, sf_dir):
    p = view(spark, sf_dir, "pixels").groupBy(c("view").cast("string").alias("view"), c("prow").cast("int").alias("row"), c("pcol").cast("int").alias("col")).agg((F.max("face") + 1).alias("face_id"))
    path = _folder(spark, "exr")
    binary.save_files(meshes.exr_files(p).select(F.concat("view", F.lit(".exr")).alias("file"), "content"), "named_files", path)
    return meshes.exr_pixels(spark, path).where("face_id > 0")
