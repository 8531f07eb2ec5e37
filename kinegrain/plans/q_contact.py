"""Queries of contact between parts and of clicks drawn from wrong masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contact as C
from .q_eval import rounded
from .q_relational import uniform
from .q_volumes import KEYS, V, solid_faces, solid_points
from .registry import query
from .views import view

c = F.col


def boxes(spark, sf_dir):
    """(points, triangles) of the solids that are boxes, as parts of their nation's object."""
    s = view(spark, sf_dir, "solids").where("label = 0").select(*KEYS, c("id").alias("part"), c("nation"))
    points = solid_points(spark, sf_dir).join(s, KEYS).select(c("nation").alias("entity"), "part", "idx", *"xyz")
    t = V.triangles(solid_faces(spark, sf_dir), solid_points(spark, sf_dir).select("idx", *"xyz"), KEYS)
    return points, t.join(s, KEYS).select(c("nation").alias("entity"), "part", *V.COORDINATES)


#: Distances of every box's corners to the surfaces of the other boxes of its nation.
DISTANCES = """with s as (select * from {solids} where label = 0),
p as (select nation, id, ox + a * (k & 1) as x, oy + b * ((k >> 1) & 1) as y, oz + c * ((k >> 2) & 1) as z from s, range(8) r(k)),
o as (select p.id as part, s.id as other, p.nation, greatest(ox - x, x - ox - a) as dx, greatest(oy - y, y - oy - b) as dy, greatest(oz - z, z - oz - c) as dz from p join s on p.nation = s.nation and p.id <> s.id),
d as (select nation as entity, part, other, case when greatest(dx, dy, dz) <= 0 then -greatest(dx, dy, dz)
    else sqrt(power(greatest(dx, 0), 2) + power(greatest(dy, 0), 2) + power(greatest(dz, 0), 2)) end as distance from o)"""


@query(f"""{DISTANCES}, n as (select entity, part, other, count(*) as touching from d where distance < 0.25 group by all)
select entity, part, other, touching, touching / 8e0 as share from n qualify row_number() over (partition by entity, part order by touching desc, other) = 1""")
def best_neighbours(spark, sf_dir):
    return C.best_neighbours(*boxes(spark, sf_dir), eps=0.25)


@query(f"""{DISTANCES}, r as (select entity, other as part, distance, row_number() over (partition by entity, other order by distance) as rank, count(*) over (partition by entity, other) as n from d),
    k as (select entity, part, case when distance < 0.01 then 0 else floor(round((distance - 0.01) / 0.01, 9)) + 1 end as steps from r where rank = least(7, n))
select entity, part, steps::int as relaxations, (select count(*) from r where r.entity = k.entity and r.part = k.part and distance < 0.01 + steps * 0.01) as size from k""")
def contact_regions(spark, sf_dir):
    return C.contact_regions(*boxes(spark, sf_dir))


@query(f"""with p as (select view as image, prow::int as row, pcol::int as col, max(face) % 2 = 0 as gold, max(mask) % 3 = 0 as mask from {{pixels}} group by 1, 2, 3),
    k as (select *, case when gold <> mask then 1 when not gold then 0 end as kind, case when gold and not mask then 1 else 0 end as label from p),
    n as (select *, {uniform(42, "image", "draw", "row", "col")} as chance from k, range(8) r(draw) where kind is not null)
select image, draw::int as draw, row, col, label from n qualify row_number() over (partition by image, draw order by kind desc, chance desc, row desc, col desc) = 1""")
def error_points(spark, sf_dir):
    p = view(spark, sf_dir, "pixels").groupBy(c("view").alias("image"), c("prow").cast("int").alias("row"), c("pcol").cast("int").alias("col"))
    return C.error_points(p.agg((F.max("face") % 2 == 0).alias("gold"), (F.max("mask") % 3 == 0).alias("mask")), 8)
