"""Queries of part volumes and of the validation of whole objects, over boxes and tetrahedra whose volumes have closed forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import volume as V
from ..operators.validation import validate_objects
from ..sources.store import stored
from .q_eval import rounded
from .registry import query
from .views import view

c = F.col
KEYS = ["entity", "label"]

#: Corners (bits: x, y, z) of the outward triangles of a box and of a tetrahedron.
BOX = [(0, 4, 6), (0, 6, 2), (1, 3, 7), (1, 7, 5), (0, 1, 5), (0, 5, 4), (2, 6, 7), (2, 7, 3), (0, 2, 3), (0, 3, 1), (4, 5, 7), (4, 7, 6)]
TETRAHEDRON = [(0, 2, 1), (0, 1, 4), (0, 4, 2), (1, 2, 4)]


def solid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, label, idx, x, y, z of the corners of the solids."""
    s = view(spark, sf_dir, "solids").withColumn("k", F.explode(F.when(c("label") == 0, F.array(*map(F.lit, range(8)))).otherwise(F.array(*map(F.lit, (0, 1, 2, 4))))))
    at = [c(o) + c(d) * F.shiftright("k", i).bitwiseAND(1) for i, (o, d) in enumerate((("ox", "a"), ("oy", "b"), ("oz", "c")))]
    return s.select(*KEYS, (c("id") * 8 + c("k")).alias("idx"), *[x.alias(n) for x, n in zip(at, "xyz")])


def solid_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, label, fid, v0, v1, v2."""
    rows = lambda t: F.array(*[F.array(*map(F.lit, x)) for x in t])
    s = view(spark, sf_dir, "solids").select("id", *KEYS, F.posexplode(F.when(c("label") == 0, rows(BOX)).otherwise(rows(TETRAHEDRON))).alias("t", "v"))
    return s.select(*KEYS, (c("id") * 12 + c("t")).alias("fid"), *[(c("id") * 8 + c("v")[k]).alias(f"v{k}") for k in range(3)])


def solid_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.triangles(solid_faces(spark, sf_dir), solid_points(spark, sf_dir).select("idx", *"xyz"), KEYS)


KNOWN = "a * b * c / case label when 0 then 1 else 6 end"


# nine places, as sixths of six places would be ties at six
@query(f"""select entity, label, round({KNOWN}, 9) as volume, round({KNOWN}, 9) as hull, round(a * b * c, 9) as box from {{solids}}""")
def part_volumes(spark, sf_dir):
    t = solid_triangles(spark, sf_dir)
    box = V.box_volumes(V.part_boxes(t, KEYS), KEYS).withColumnRenamed("volume", "box")
    hull = V.hull_volumes(solid_points(spark, sf_dir), KEYS).withColumnRenamed("volume", "hull")
    return rounded(V.mesh_volumes(t, KEYS).join(hull, KEYS).join(box, KEYS), 9)


#: Cells of the solids by brute force: lattices point by point, and every centre by the solid's own inequalities.
CELLS = f"""with s as (select *, greatest(a, b, c) / 16 as p from {{solids}}),
t as (select id, p, unnest(case label when 0 then {[list(x) for x in BOX]} else {[list(x) for x in TETRAHEDRON]} end) as v, a, b, c, ox, oy, oz from s),
corner as (select id, p, {", ".join(f"{o} + {d} * ((v[{k + 1}] >> {i}) & 1) as {n}{x}" for k, n in enumerate("pqr") for i, (x, o, d) in enumerate((("x", "ox", "a"), ("y", "oy", "b"), ("z", "oz", "c"))))} from t),
edge as (select *, sqrt(greatest({", ".join("+".join(f"power({n}{x} - {m}{x}, 2)" for x in "xyz") for m, n in ("pq", "qr", "rp"))})) as longest from corner),
sized as (select *, power(2, greatest(0, ceil(log2(longest / (p / 2)))))::bigint as n from edge),
lattice as (select * from (select *, unnest(range(n + 1)) as i from sized), lateral (select unnest(range(n - i + 1)) as j)),
surface as (select distinct id, {", ".join(f"round_even((p{x} + (q{x} - p{x}) * i / n + (r{x} - p{x}) * j / n) / p, 0)::bigint as c{x}" for x in "xyz")} from lattice),
grid as (select id, label, i, j, k, (i * p - ox) / a as u, (j * p - oy) / b as v, (k * p - oz) / c as w from s, range(18) x(i), range(18) y(j), range(18) z(k)),
solid as (select id, i as cx, j as cy, k as cz from grid where least(u, v, w) >= 0 and case label when 0 then greatest(u, v, w) <= 1 else u + v + w <= 1 end),
filled as (select id, count(*) as n from (select * from surface union select * from solid) group by 1),
cells as (select s.*, (select count(*) from surface x where x.id = s.id) as surface_cells, (select count(*) from solid x where x.id = s.id) as solid_cells, n as filled_cells from s join filled using (id))"""


@query(f"{CELLS} select entity, label, round(p, 6) as pitch, surface_cells, solid_cells, filled_cells, 0::bigint as open_columns, round(filled_cells * power(p, 3), 6) as volume, null::varchar as error from cells")
def voxel_volumes(spark, sf_dir):
    return rounded(V.voxel_volumes(solid_triangles(spark, sf_dir), KEYS, resolution=16))


def _draw(axis: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', '42', entity, label, '{axis}', n)), 1, 13))::bigint::double / 4503599627370496"


@query(f"""with d as (select entity, label, a, b, c, {_draw("x")} as u, {_draw("y")} as v, {_draw("z")} as w from {{solids}}, range(200) r(n)),
    k as (select entity, label, a * b * c as box, count(*) filter (label = 0 or u + v + w < 1) as inside from d group by all)
select entity, label, inside, round(box * inside / 200, 6) as volume from k""")
def sampled_volumes(spark, sf_dir):
    return rounded(V.sampled_volumes(solid_triangles(spark, sf_dir), KEYS, samples=200))


def annotation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, text: annotations in JSON; every seventh object has no mass that can be read, and every eleventh no dimension."""
    steel = {"name": "part", "material": "metal/steel", "density": "7.8 g/cm^3", "Young's Modulus (GPa)": 200.0, "Poisson's Ratio": 0.3, "friction_coefficient": 0.1, "Hardness (HV)": 150.0, "priority_rank": 1, "graspable": False}
    part = F.struct("label", *[F.lit(v).alias(k) for k, v in steel.items()])
    size = F.when(c("entity") % 11 == 5, "unknown").otherwise("30*20*10 cm")
    mass = F.when(c("entity") % 7 == 3, "heavy").otherwise(F.concat((2 + c("entity") % 9).cast("string"), F.lit(" kg")))
    whole = F.struct(size.alias("dimension"), mass.alias("mass"), c("parts"))
    return view(spark, sf_dir, "solids").groupBy("entity").agg(F.collect_list(part).alias("parts")).select("entity", F.to_json(whole).alias("text"))


@query(f"""{CELLS}, o as (select entity, max(ox + a) - min(ox) as dx, max(oy + b) - min(oy) as dy, max(oz + c) - min(oz) as dz, sum(filled_cells * power(p, 3)) as v from cells group by 1),
    e as (select *, case when entity % 11 = 5 then 'dimension' when entity % 7 = 3 then 'mass' end as error, abs(7800 * v * 6000 / (dx * dy * dz) * 1e-6 - (2 + entity % 9)) / (2 + entity % 9) as rel from o)
select entity, case when error is null then round(rel, 6) end as rel_err, case when error is null then rel > 0.5 end as warning, error from e""")
def object_validation(spark, sf_dir):
    t = solid_triangles(spark, sf_dir)
    extents = V.part_boxes(t, ["entity"]).select("entity", *[(c(a + "1") - c(a + "0")).alias(f"d{a}") for a in "xyz"])
    volumes = stored(V.voxel_volumes(t, KEYS, resolution=16).select(*KEYS, "volume", c("error").alias("volume_error")), "volumes")
    checked = validate_objects(annotation_texts(spark, sf_dir), extents, volumes)
    return rounded(checked.select("entity", "rel_err", "warning", "error"))
