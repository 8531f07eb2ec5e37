"""Queries of points, voxels, rasters, runs and curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import color as K
from ..functions import curves as C
from ..functions import numeric as N
from ..functions import vec3 as V
from ..operators import raster as R
from .q_eval import rounded
from .registry import query
from .views import table, view

c = F.col

GRID = """p as (select *, floor(x / 0.25e0)::bigint as fx, floor(y / 0.25e0)::bigint as fy, floor(z / 0.25e0)::bigint as fz from {points}),
    v as (select *, fx - min(fx) over () as gx, fy - min(fy) over () as gy, fz - min(fz) over () as gz from p)"""


def cells(spark, sf_dir):
    return R.voxelise(view(spark, sf_dir, "points"), 0.25)


@query(f"with {GRID} select gx, gy, gz, count(*) as n, min(idx) as first from v group by all")
def voxel_grouping(spark, sf_dir):
    return cells(spark, sf_dir).groupBy(*R.CELL).agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"))


@query(f"""with {GRID}, r as (select *, count(*) over (partition by gx, gy, gz) as n, row_number() over (partition by gx, gy, gz order by idx) - 1 as rk from v),
    t as (select *, max(n) over () as top from r) select idx, gx, gy, gz from t where rk = (top // 2) % n""")
def voxel_representative(spark, sf_dir):
    return R.voxel_representative(cells(spark, sf_dir), [], "idx").select("idx", *R.CELL)


@query(f"""with {GRID}, r as (select *, count(*) over (partition by gx, gy, gz) as n, row_number() over (partition by gx, gy, gz order by idx) - 1 as rk from v),
    t as (select *, unnest(range(0, (select max(n) from r)))::bigint as fragment from r) select fragment, idx from t where fragment % n = rk""")
def voxel_fragments(spark, sf_dir):
    return R.voxel_fragments(cells(spark, sf_dir), "idx").select("fragment", "idx")


@query(f"with {GRID} select part, gx // 2 as gx, gy // 2 as gy, gz // 2 as gz, max(r) as r, round(avg(x), 6) as x, round(avg(y), 6) as y, round(avg(z), 6) as z, count(*) as n from v group by 1, 2, 3, 4")
def voxel_pooling(spark, sf_dir):
    return rounded(R.grid_pool(cells(spark, sf_dir), ["part"], 2, ["r"]))


@query(f"""with {GRID}, m as (select part, gx // 2 as qx, gy // 2 as qy, gz // 2 as qz, max(r) as r, count(*) as n from v group by all)
select v.idx, m.r as pooled_r, m.n as pooled_n from v join m on v.part = m.part and v.gx // 2 = qx and v.gy // 2 = qy and v.gz // 2 = qz""")
def voxel_unpooling(spark, sf_dir):
    p = cells(spark, sf_dir)
    return R.grid_unpool(p, R.grid_pool(p, ["part"], 2, ["r"]), ["part"], 2).select("idx", "pooled_r", "pooled_n")


@query("select part, round(min(x), 6) as x0, round(max(x), 6) as x1, round((min(y)+max(y))/2, 6) as cy, round(greatest((max(x)-min(x))/2, (max(y)-min(y))/2, (max(z)-min(z))/2), 6) as half from {points} group by 1")
def aabb(spark, sf_dir):
    return rounded(R.bounds(view(spark, sf_dir, "points"), ["part"]).select("part", "x0", "x1", "cy", "half"))


@query("""with b as (select part, (min(x)+max(x))/2 as mx, greatest((max(x)-min(x))/2, (max(y)-min(y))/2, (max(z)-min(z))/2) as s from {points} group by 1)
select idx, round((x - mx) / (case when s < 1e-12 then 1 else s end + 1e-12), 6) as nx from {points} join b using (part)""")
def aabb_normalise(spark, sf_dir):
    p = view(spark, sf_dir, "points")
    s = F.when(c("half") < 1e-12, N.lit(1)).otherwise(c("half")) + 1e-12
    return p.join(R.bounds(p, ["part"]).select("part", "cx", "half"), "part").select("idx", F.round((c("x") - c("cx")) / s, 6).alias("nx"))


@query("""with m as (select part, avg(x) as mx, avg(y) as my, avg(z) as mz from {points} group by 1), d as (select p.*, x-mx as dx, y-my as dy, z-mz as dz from {points} p join m using (part)),
    r as (select part, max(sqrt(dx*dx+dy*dy+dz*dz)) as rad from d group by 1) select idx, round(dx / rad, 6) as ux, round(dz / rad, 6) as uz from d join r using (part)""")
def unit_sphere_normalise(spark, sf_dir):
    p = view(spark, sf_dir, "points")
    m = p.groupBy("part").agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"])
    d = p.join(m, "part").select("idx", "part", *[(c(a) - c(f"m{a}")).alias(f"d{a}") for a in "xyz"])
    r = d.groupBy("part").agg(F.max(F.sqrt(c("dx") * c("dx") + c("dy") * c("dy") + c("dz") * c("dz"))).alias("rad"))
    return d.join(r, "part").select("idx", F.round(c("dx") / c("rad"), 6).alias("ux"), F.round(c("dz") / c("rad"), 6).alias("uz"))


@query("select part, round(avg(x), 4) as x, round(avg(y), 4) as y, round(avg(z), 4) as z, count(*) as n from {points} group by 1")
def part_centroid(spark, sf_dir):
    return rounded(view(spark, sf_dir, "points").groupBy("part").agg(*[F.avg(a).alias(a) for a in "xyz"], F.count(F.lit(1)).alias("n")), 4)


@query("""with o as (select min(floor(x / 0.25e0))::bigint as ox from {points}) select idx, greatest(0, least(floor(x / 0.25e0)::bigint - ox, 8))::bigint as gx from {points}, o""")
def shared_grid_origin(spark, sf_dir):
    return R.voxelise(view(spark, sf_dir, "points"), 0.25, bins=8).select("idx", "gx")


ZBITS = " + ".join(f"((((gx >> {b}) & 1) << {3 * b + 2}) + (((gy >> {b}) & 1) << {3 * b + 1}) + (((gz >> {b}) & 1) << {3 * b}))" for b in range(10))


@query(f"with {GRID} select idx, {ZBITS} as code, gx as x, gy as y, gz as z from v")
def zorder_code(spark, sf_dir):
    p = cells(spark, sf_dir).withColumn("code", C.zorder(c("gx"), c("gy"), c("gz"), 10))
    d = C.zorder_decode(c("code"), 10)
    return p.select("idx", "code", d["x"].alias("x"), d["y"].alias("y"), d["z"].alias("z"))


@query(f"with {GRID}, z as (select part, idx, {ZBITS.replace('gx', 'gq').replace('gy', 'gx').replace('gq', 'gy')} as code from v) select part, idx, code, row_number() over (partition by part order by code, idx) - 1 as position from z")
def serialised_order(spark, sf_dir):
    p = cells(spark, sf_dir).withColumn("batch", c("part"))
    return C.serialised(p, "z-trans", 10).select("part", "idx", "code", "position")


@query()
def hilbert_code(spark, sf_dir):
    return cells(spark, sf_dir).select("idx", *R.CELL, C.hilbert(c("gx"), c("gy"), c("gz"), 10).alias("code"))


@query(f"with {GRID} select idx, (gx * (my + 1) + gy) * (mz + 1) + gz as ravel, xor(gx, gx >> 1) as gray, gx as back from v, (select max(gy) as my, max(gz) as mz from v)")
def ravel_and_gray(spark, sf_dir):
    p = cells(spark, sf_dir)
    top = p.agg(F.max("gy").alias("my"), F.max("gz").alias("mz"))
    p = p.crossJoin(F.broadcast(top))
    g = C.gray(c("gx"))
    return p.select("idx", C.ravel(c("gx"), c("gy"), c("gz"), c("my"), c("mz")).alias("ravel"), g.alias("gray"), C.gray_inverse(g).alias("back"))


@query(f"""with {GRID}, a as (select *, xor(((14695981039346656037::hugeint * 1099511628211::hugeint) % 18446744073709551616::hugeint)::ubigint, gx::ubigint) as h1 from v),
    b as (select *, xor(((h1::hugeint * 1099511628211::hugeint) % 18446744073709551616::hugeint)::ubigint, gy::ubigint) as h2 from a)
select idx, xor(((h2::hugeint * 1099511628211::hugeint) % 18446744073709551616::hugeint)::ubigint, gz::ubigint)::varchar as hash from b""")
def fnv_voxel_hash(spark, sf_dir):
    return cells(spark, sf_dir).select("idx", C.fnv_hash(c("gx"), c("gy"), c("gz")).cast("string").alias("hash"))


@query("select idx, 9 as n, round(sin(x * pi() * 2), 6) as s1, round(cos(x * pi() * 4), 6) as c3, round(sin(idx / 1e0), 6) as p0, round(cos(idx / 10e0), 6) as p3 from {points}")
def fourier_encode(spark, sf_dir):
    f, s = C.fourier(c("x")), C.sine_position(c("idx").cast("double"))
    return rounded(view(spark, sf_dir, "points").select("idx", F.size(f).alias("n"), f[2].alias("s1"), f[8].alias("c3"), s[0].alias("p0"), s[3].alias("p3")))


@query("select mask, run, bit, count(*) as length from (select mask, bit, pos - row_number() over (partition by mask, bit order by pos) as grp, pos, sum(chg) over (partition by mask order by pos) - 1 as run from (select *, case when lag(bit) over (partition by mask order by pos) = bit then 0 else 1 end as chg from {bits})) group by mask, run, bit")
def rle_encode(spark, sf_dir):
    return R.rle_encode(view(spark, sf_dir, "bits"), "mask", "pos", "bit")


@query("select mask, sum(bit)::bigint as area, count(*) as n from {bits} group by 1")
def rle_area(spark, sf_dir):
    counts = R.rle_counts(R.rle_encode(view(spark, sf_dir, "bits"), "mask", "pos", "bit"), "mask", "bit")
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)
    return counts.select("mask", R.rle_area(c("counts")).alias("area"), total.alias("n"))


@query("select mask, pos, bit from {bits}")
def rle_decode(spark, sf_dir):
    counts = R.rle_counts(R.rle_encode(view(spark, sf_dir, "bits"), "mask", "pos", "bit"), "mask", "bit")
    return R.rle_decode(counts, "mask")


@query("select view, mask, min(prow) as r0, max(prow) as r1, min(pcol) as c0, max(pcol) as c1, count(*) as area from {pixels} group by 1, 2")
def mask_bbox(spark, sf_dir):
    return R.mask_box(view(spark, sf_dir, "pixels"), ["view", "mask"], "prow", "pcol")


@query("select grp, round(count(*) filter (score > 51000) / count(*) filter (score > 49000)::double, 6) as stability from {boxes} group by 1")
def stability_score(spark, sf_dir):
    return rounded(view(spark, sf_dir, "boxes").groupBy("grp").agg(R.stability(c("score"), 50000, 1000).alias("stability")))


@query("select view, prow, pcol, arg_max(mask, seq * 10 + mask) as mask from {pixels} group by 1, 2, 3")
def overpaint(spark, sf_dir):
    return R.overpaint(view(spark, sf_dir, "pixels"), ["view", "prow", "pcol"], ["seq", "mask"], "mask")


@query("""with v as (select face, mask, count(*) as votes, min(seq) as f from {pixels} group by 1, 2), r as (select *, row_number() over (partition by face order by votes desc, f) as k from v)
select face, mask, votes from r where k = 1""")
def face_majority_vote(spark, sf_dir):
    return R.majority_vote(view(spark, sf_dir, "pixels"), "face", "mask", "seq")


@query("""with o as (select distinct mask, face, (face % 7 + 1) as area from {pixels}), s as (select mask, sum(area) as size from o group by 1),
    i as (select x.mask as a, y.mask as b, sum(x.area) as inter from o x join o y on x.face = y.face and x.mask < y.mask group by 1, 2)
select a, b, inter::bigint as inter, round(inter / (sa.size + sb.size - inter), 6) as iou, round(inter / least(sa.size, sb.size), 6) as containment from i join s sa on sa.mask = a join s sb on sb.mask = b""")
def area_weighted_iou(spark, sf_dir):
    p = view(spark, sf_dir, "pixels").withColumn("area", c("face") % 7 + 1)
    return rounded(R.pair_overlaps(p, "mask", "face", "area"))


@query("""with k as (select view, mask, count(*) as area from {pixels} group by 1, 2), s as (select *, coalesce(sum(area) over (partition by view order by area desc, mask rows between unbounded preceding and 1 preceding), 0) as before,
    sum(area) over (partition by view) as total from k) select view, mask, area from s where before <= 0.6 * total""")
def coverage_prefix(spark, sf_dir):
    k = view(spark, sf_dir, "pixels").groupBy("view", "mask").agg(F.count(F.lit(1)).alias("area"))
    return R.coverage_prefix(k, ["view"], "area", "mask", 0.6)


@query("select view, prow, pcol, max(case when face > 0 then face + mask * 500 else 0 end) as face from {pixels} group by 1, 2, 3")
def raster_batch_combine(spark, sf_dir):
    return R.combine_batches(view(spark, sf_dir, "pixels"), ["view", "prow", "pcol"], "face", "mask", 500)


@query("""select idx, round(r / 127.5e0 - 1, 6) as rn, round((0.2989e0 * r + 0.587e0 * g + 0.114e0 * b) / 255, 6) as gray, round((0.25e0 * r + 0.75e0 * 255), 6) as over from {points}""")
def colour_normalise(spark, sf_dir):
    p = view(spark, sf_dir, "points")
    return rounded(p.select("idx", K.normalise(c("r")).alias("rn"), (K.gray(c("r"), c("g"), c("b")) / 255).alias("gray"), K.over_white(c("r"), N.lit(0.25)).alias("over")))


@query("select idx, r, g, b from {points}")
def hsv_round_trip(spark, sf_dir):
    p = view(spark, sf_dir, "points").withColumn("hsv", K.rgb_to_hsv(c("r"), c("g"), c("b")))
    back = K.hsv_to_rgb(c("hsv"))
    return p.select("idx", *[F.round(back[k] * 255).cast("long").alias(n) for k, n in enumerate("rgb")])


@query("""with t as (select f.fid, f.part, a.x as ax, a.y as ay, a.z as az, b.x - a.x as ux, b.y - a.y as uy, b.z - a.z as uz, d.x - a.x as wx, d.y - a.y as wy, d.z - a.z as wz
    from {faces} f join {points} a on a.idx = v0 join {points} b on b.idx = v1 join {points} d on d.idx = v2)
select part, count(*) as faces, round(sum(sqrt(power(uy*wz-uz*wy,2)+power(uz*wx-ux*wz,2)+power(ux*wy-uy*wx,2))/2), 4) as area from t group by 1""")
def face_area_sum(spark, sf_dir):
    from ..operators.mesh import face_areas

    a = face_areas(view(spark, sf_dir, "faces"), view(spark, sf_dir, "points"))
    return rounded(a.groupBy("part").agg(F.count(F.lit(1)).alias("faces"), F.sum("area").alias("area")), 4)


@query("""with e as (select fid, least(v0,v1) as a, greatest(v0,v1) as b from {faces} union select fid, least(v1,v2), greatest(v1,v2) from {faces} union select fid, least(v0,v2), greatest(v0,v2) from {faces})
select distinct x.fid as f1, y.fid as f2 from e x join e y on x.a = y.a and x.b = y.b and x.fid < y.fid""")
def edge_adjacent_faces(spark, sf_dir):
    from ..operators.mesh import adjacent_faces

    return adjacent_faces(view(spark, sf_dir, "faces"))


@query("select round(prod_x * prod_y * prod_z, 6) as volume, round(0.9e0 / (greatest(prod_x, prod_y, prod_z) / 2), 6) as scale from (select max(x)-min(x) as prod_x, max(y)-min(y) as prod_y, max(z)-min(z) as prod_z from {points})")
def aabb_volume(spark, sf_dir):
    p = view(spark, sf_dir, "points").agg(*[(F.max(a) - F.min(a)).alias(a) for a in "xyz"])
    return rounded(p.select((c("x") * c("y") * c("z")).alias("volume"), (0.9 / (F.greatest(*"xyz") / 2)).alias("scale")))


@query("select id, x0, x1 - x0 as w, y1 - y0 as h, x0 + 7 as ux, round(x0 / 60 * 1024, 6) as sx from {boxes}")
def box_formats(spark, sf_dir):
    b = view(spark, sf_dir, "boxes")
    return b.select("id", "x0", (c("x1") - c("x0")).alias("w"), (c("y1") - c("y0")).alias("h"), (c("x0") + 7).alias("ux"), F.round(c("x0") / 60 * 1024, 6).alias("sx"))


@query("select p_partkey, least(1, 1280 / greatest(p_size * 100, 900)::double) < 1 as shrunk, floor(p_size * 100 * least(1e0, 1280e0 / greatest(p_size * 100, 900)))::bigint as w from part")
def longest_side_resize(spark, sf_dir):
    s = N.longest_side(c("p_size") * 100, F.lit(900))
    return table(spark, sf_dir, "part").select("p_partkey", (F.greatest(c("p_size") * 100, F.lit(900)) > 1280).alias("shrunk"), s["w"].alias("w"))


@query("select gi * 8 + gj as cell, (gi + 0.5e0) / 8 as x, (gj + 0.5e0) / 8 as y from (select unnest(range(0, 8))::bigint as gi), (select unnest(range(0, 8))::bigint as gj)")
def point_grid(spark, sf_dir):
    from ..operators.sampling import point_grid as grid

    return grid(spark, 8)


@query("""select idx, round(x * 0.8e0 - y * 0.6e0 + 1, 6) as tx, round(x * 0.6e0 + y * 0.8e0, 6) as ty, round(z * 2, 6) as tz from {points}""")
def apply_transform(spark, sf_dir):
    from ..operators.mesh import transform_points

    m = [[0.8, -0.6, 0.0], [0.6, 0.8, 0.0], [0.0, 0.0, 2.0]]
    return rounded(transform_points(view(spark, sf_dir, "points"), m, [1.0, 0.0, 0.0]).select("idx", c("x").alias("tx"), c("y").alias("ty"), c("z").alias("tz")))
