"""Queries of point clouds, mask suppression, textures and mesh files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import clouds as C
from ..operators import kernels as K
from ..sources import meshes as M
from ..sources.store import shared_dir, write_text
from .q_eval import rounded
from .q_relational import D2
from .registry import query
from .views import view

c = F.col

VOXELS = """v as (select min(idx) as idx, avg(x) as x, avg(y) as y, avg(z) as z, avg(r) as r
    from (select p.*, floor((x - lx + 0.1e0) / 0.2e0) as cx, floor((y - ly + 0.1e0) / 0.2e0) as cy, floor((z - lz + 0.1e0) / 0.2e0) as cz
        from {points} p, (select min(x) as lx, min(y) as ly, min(z) as lz from {points})) group by cx, cy, cz)"""


@query(f"with {VOXELS} select idx, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z, round(r, 6) as r from v")
def voxel_down_sample(spark, sf_dir):
    return rounded(C.voxel_down_sample(view(spark, sf_dir, "points"), 0.2, ["r"]))


@query(f"""with {VOXELS},
    d as (select a.idx, sqrt({D2}) as d, row_number() over (partition by a.idx order by {D2}, b.idx) as rank from v a, v b),
    m as (select idx, avg(d) as m from d where rank <= 15 group by 1),
    t as (select avg(m) as mean, sqrt(sum(case when m > 0 then power(m - (select avg(m) from m), 2) end) / (count(*) - 1)) as dev from m)
select idx, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z, round(r, 6) as r from v join m using (idx), t where m > 0 and m < mean + 2 * dev""")
def cloud_cleanup(spark, sf_dir):
    return rounded(C.cleanup(view(spark, sf_dir, "points"), 0.2, values=["r"]))


# boxes stand for masks, so their overlaps have closed forms
@query("""with b as (select grp, id, max(score) / 1e5 as score, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from {boxes} where score > 80000 group by 1, 2),
    r as (select *, (x1 - x0) * (y1 - y0) as area, row_number() over (partition by grp order by score desc, id) as rank from b),
    i as (select x.grp, x.id, x.rank, y.rank as other, x.area, y.area as rim, greatest(0e0, least(x.x1, y.x1) - greatest(x.x0, y.x0)) * greatest(0e0, least(x.y1, y.y1) - greatest(x.y0, y.y0)) as inter
        from r x join r y on x.grp = y.grp and x.id <> y.id),
    s as (select *, inter / (area + rim - inter) as iou, case when inter / area >= 0.85 and inter / rim < 0.5 then 1 - inter / area * inter / rim else 0 end as inside from i),
    w as (select grp, id, max(case when other < rank then iou end) as iou, max(case when other < rank then inside end) as up, max(case when other > rank then inside end) as down from s group by 1, 2),
    k as (select r.grp, r.id, r.rank, coalesce(iou, 0) <= 0.7 as o, score > 0.95 as c, coalesce(up, 0) <= 0.8 as u, coalesce(down, 0) <= 0.8 as d from r left join w using (grp, id)),
    n as (select *, bool_or(c) over (partition by grp) as cs, bool_or(u) over (partition by grp) as us, bool_or(d) over (partition by grp) as ds from k)
select grp, id from n where o and (c or (not cs and rank <= 3)) and (u or (not us and rank <= 3)) and (d or (not ds and rank <= 3))""")
def mask_nms_inner(spark, sf_dir):
    b = view(spark, sf_dir, "boxes").where("score > 80000").groupBy("grp", "id").agg((F.max("score") / 1e5).alias("score"), *[f(n).alias(n) for f, n in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    masks, pairs = C.deciding_pairs(b, most=0.7, least_score=0.95)
    return C.mask_nms(pairs, masks, least_score=0.95)


@query("""with s as (select fid as sample, v0 / 500e0 as u0, v1 / 500e0 as t0, v1 / 400e0 as u1, v2 / 500e0 as t1, v2 / 500e0 as u2, v0 / 450e0 as t2 from {faces}),
    m as (select sample, least(1, 0.5e0 * u0 + 0.25e0 * u1 + 0.25e0 * u2) as u, least(1, 0.5e0 * t0 + 0.25e0 * t1 + 0.25e0 * t2) as v from s)
select sample, floor(u * 63)::int * 4 as r, floor((1 - v) * 31)::int * 8 as g, (floor(u * 63)::int + floor((1 - v) * 31)::int) % 256 as b from m""")
def texture_sampling(spark, sf_dir):
    f = view(spark, sf_dir, "faces")
    at = {"u0": c("v0") / 500.0, "t0": c("v1") / 500.0, "u1": c("v1") / 400.0, "t1": c("v2") / 500.0, "u2": c("v2") / 500.0, "t2": c("v0") / 450.0}
    corners = f.select("fid", *[x.alias(n) for n, x in at.items()])
    samples = f.select(c("fid").alias("sample"), "fid", F.lit(0.5).alias("w0"), F.lit(0.25).alias("w1"), F.lit(0.25).alias("w2"))
    p = spark.range(64 * 32).select((c("id") % 64).alias("col"), F.floor(c("id") / 64).alias("row"))
    pixels = p.select("col", "row", (c("col") * 4).cast("int").alias("r"), (c("row") * 8).cast("int").alias("g"), ((c("col") + c("row")) % 256).cast("int").alias("b"))
    return C.texture_colours(samples, corners, pixels)


@query()
def elastic_distortion(spark, sf_dir):
    return C.elastic_distortion(view(spark, sf_dir, "points").select("idx", *"xyz"), 0.2, 0.4)


@query()
def multi_view_loss(spark, sf_dir):
    p = view(spark, sf_dir, "pixels").withColumn("entity", c("face") % 2)
    views = p.groupBy("entity", "view", "mask", c("face").alias("fid")).agg(F.lit(1.0).alias("area"))
    meet = views.groupBy("entity", "view", c("mask").alias("a"), (c("fid") % 10).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    size = lambda key, n: views.groupBy("entity", "view", key).agg(F.countDistinct("fid").alias(n))
    iou = meet.join(size(c("mask").alias("a"), "na"), ["entity", "view", "a"]).join(size((c("fid") % 10).alias("b"), "nb"), ["entity", "view", "b"]).withColumn("cost", 1 - c("n") / (c("na") + c("nb") - c("n")))
    # a view of one entity is one assignment
    both = iou.withColumn("view", c("view") * 2 + c("entity"))
    matched = K.match(both.select("view", "a", "b", "cost"), "view").select("view", "a", "b")
    matches = both.join(matched, ["view", "a", "b"]).select("entity", "view", c("a").alias("mask"), (1 - c("cost")).alias("iou"))
    surface = p.groupBy("entity").agg(F.countDistinct("face").cast("double").alias("surface"))
    return rounded(C.multi_view_loss(matches, views.withColumn("view", c("view") * 2 + c("entity")), surface))


@query("select idx, x, y, z, r::double as r, g::double as g, b::double as b from {points}")
def ply_round_trip(spark, sf_dir):
    p = view(spark, sf_dir, "points").select("idx", *"xyz", *"rgb")
    path = f"{shared_dir(spark)}/ply-{uuid.uuid4().hex}"
    write_text(M.ply_lines(p).coalesce(1), f"{path}/lines")
    lines = spark.read.format("binaryFile").load(f"{path}/lines/part-*").select("path", "content")
    return lines.mapInPandas(M.ply_rows, M.PLY_SCHEMA).drop("cloud")


@query("""with n as (select part, row_number() over (order by min(fid)) as number from {faces} group by 1),
    u as (select distinct part, unnest([v0, v1, v2]) as v from {faces}), k as (select part, v, row_number() over (partition by part order by v) - 1 as new from u)
select number, f.part, fid, a.new as v0, b.new as v1, d.new as v2 from {faces} f join n on f.part = n.part
    join k a on f.part = a.part and f.v0 = a.v join k b on f.part = b.part and f.v1 = b.v join k d on f.part = d.part and f.v2 = d.v""")
def part_meshes(spark, sf_dir):
    points = view(spark, sf_dir, "points").select("idx", *"xyz")
    return M.part_meshes(view(spark, sf_dir, "faces"), points)[1]


@query("select view::varchar as view, prow::int as row, pcol::int as col, max(face) as face_id from {pixels} group by 1, 2, 3")
def exr_round_trip(spark, sf_dir):
    p = view(spark, sf_dir, "pixels").groupBy(c("view").cast("string").alias("view"), c("prow").cast("int").alias("row"), c("pcol").cast("int").alias("col")).agg(F.max("face").alias("face_id"))
    back = M.exr_files(p).mapInPandas(M.exr_rows, M.EXR_SCHEMA)
    return back.join(p.select("view", "row", "col"), ["view", "row", "col"], "left_semi")
