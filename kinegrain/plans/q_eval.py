"""Queries of evaluation metrics and validation rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import vec3 as V
from ..operators import metrics as M
from ..operators import rules as R
from .registry import query
from .views import table, view

c = F.col


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, other columns as they are."""
    return df.select(*[F.round(F.col(n), places).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = view(spark, sf_dir, "motion")
    return m.withColumns(
        {
            "pred_axis": V.vec(c("px"), c("py"), c("pz")), "gold_axis": V.vec(c("gx"), c("gy"), c("gz")),
            "pred_pivot": V.vec(c("pz"), c("px"), c("py")), "gold_pivot": V.vec(c("gy"), c("gz"), c("gx")),
        }
    )


# SQL pieces that the oracles share
DOT = "(px*gx+py*gy+pz*gz)"
NP, NG = "sqrt(px*px+py*py+pz*pz)", "sqrt(gx*gx+gy*gy+gz*gz)"
UNIT = f"(case when {NP} > 1e-12 and {NG} > 1e-12 then least(1e0, abs({DOT}/({NP}*{NG}))) end)"
ANGLE = f"degrees(acos({UNIT}))"
PIVOT = f"""(case when {NG} > 1e-12 then sqrt(power((px-gz)*(gz/{NG})-(py-gx)*(gy/{NG}),2)+power((py-gx)*(gx/{NG})-(pz-gy)*(gz/{NG}),2)
    +power((pz-gy)*(gy/{NG})-(px-gz)*(gx/{NG}),2)) end)"""
LO1, HI1 = "least(abs(plo),abs(phi))", "greatest(abs(plo),abs(phi))"
LO2, HI2 = "least(abs(glo),abs(ghi))", "greatest(abs(glo),abs(ghi))"
IOU = f"""(case when greatest({HI1},{HI2})-least({LO1},{LO2}) <= 1e-12 then case when abs({LO1}-{LO2}) <= 1e-12 then 1e0 else 0e0 end
    else greatest(0e0, least({HI1},{HI2})-greatest({LO1},{LO2}))/(greatest({HI1},{HI2})-least({LO1},{LO2})) end)"""
#: distance of the predicted pivot (pz, px, py) from the gold line through (gy, gz, gx)
D0, D1, D2 = "(pz-gy)", "(px-gz)", "(py-gx)"
PDIST = f"sqrt(power({D1}*gz/{NG}-{D2}*gy/{NG},2)+power({D2}*gx/{NG}-{D0}*gz/{NG},2)+power({D0}*gy/{NG}-{D1}*gx/{NG},2))"


@query(f"""with m as (select *, coalesce(ptype = gtype, false) as ok from {{motion}}), e as (
    select *, case when ok then {ANGLE} end as ax, case when ok and gtype = 'C' and {NG} > 1e-12 then {PDIST} end as pv, case when ok then {IOU} end as li from m)
select count(*) as joint_total, count(*) filter (ok) as joint_correct, round(avg(ok::int), 6) as joint_accuracy, count(*) filter (ptype is null) as missing_prediction,
    round(avg(ax), 6) as axis_error, count(ax) as axis_count, round(avg((ax < 10)::int), 6) as axis_accuracy_10, round(avg(pv), 6) as pivot_error, count(pv) as pivot_count,
    round(avg(li), 6) as limit_miou from e""")
def eval_kinematic_report(spark, sf_dir):
    return rounded(M.kinematic_report(motion(spark, sf_dir)))


def _dims(f: str) -> str:
    return f"({'+'.join(f.format(p=f'list_sort([p0,p1,p2])[{k}]', g=f'list_sort([g0,g1,g2])[{k}]') for k in (1, 2, 3))})/3"


POS = "least(p0,p1,p2) > 0 and least(g0,g1,g2) > 0"


@query(f"""select count(*) as records, round(avg(case when {POS} then {_dims('abs(ln({p})-ln({g}))')} end), 6) as scale_alde,
    round(avg(case when {POS} then {_dims('least({p}/{g},{g}/{p})')} end), 6) as scale_mnre, round(avg(case when {POS} then {_dims('abs({p}-{g})')} end), 6) as scale_mae,
    round(avg(abs(ln(pmass)-ln(gmass))), 6) as mass_alde, round(avg(least(pmass/gmass, gmass/pmass)), 6) as mass_mnre, round(avg(abs(pmass-gmass)), 6) as mass_mae,
    round(avg((lower(trim(pcat)) = lower(trim(gcat)))::int), 6) as category_accuracy, count(lower(trim(pcat)) = lower(trim(gcat))) as category_count from {{objects}}""")
def eval_object_report(spark, sf_dir):
    return rounded(M.object_report(view(spark, sf_dir, "objects")))


def _alde(x: str) -> str:
    return f"round(avg(case when {x} > 0 and g_{x} > 0 then abs(ln({x})-ln(g_{x})) end), 6) as {x}_alde"


@query(f"""select count(*) as records, round(avg((material = g_material)::int), 6) as material_accuracy, {_alde('density')}, {_alde('young')}, {_alde('hardness')},
    round(avg(abs(friction-g_friction)), 6) as friction_mae, round(avg(abs(affordance::double-g_affordance::double)), 6) as affordance_mae,
    round(avg(abs(poisson-g_poisson)), 6) as poisson_mae, round(avg((graspable = g_graspable)::int), 6) as graspable_accuracy,
    count(case when density > 0 and g_density > 0 then 1 end) as density_count from {{phys}}""")
def eval_part_report(spark, sf_dir):
    return rounded(M.part_report(view(spark, sf_dir, "phys")))


SETS = """sets as (select id, list_distinct(list(p)) as p, list_distinct(list(g)) as g from {members} group by id),
    n as (select *, len(list_intersect(p, g))::double as tp, len(p)::double as np, len(g)::double as ng from sets),
    s as (select *, np - tp as fp, ng - tp as fn, tp / np as pr, tp / ng as rc from n),
    f as (select *, tp / (tp + fp + fn) as iou, case when pr + rc > 0 then 2 * pr * rc / (pr + rc) else 0 end as f1 from s)"""


def member_sets(spark, sf_dir):
    return view(spark, sf_dir, "members").groupBy("id").agg(F.collect_set("p").alias("pred"), F.collect_set("g").alias("gold"))


@query(f"""with {SETS} select count(*) as records, 0::bigint as missing_pairs, round(avg(iou), 6) as macro_iou, round(avg(f1), 6) as macro_f1, round(avg(pr), 6) as macro_precision,
    round(avg(rc), 6) as macro_recall, round(avg((fp + fn = 0)::int), 6) as exact_match, round(sum(tp)/sum(tp+fp+fn), 6) as micro_iou,
    round(2*sum(tp)/(2*sum(tp)+sum(fp)+sum(fn)), 6) as micro_f1 from f""")
def eval_structure_report(spark, sf_dir):
    return rounded(M.structure_report(member_sets(spark, sf_dir)))


@query(f"with {SETS} select id, tp, fp, fn, round(iou, 6) as iou, round(f1, 6) as f1 from f")
def structure_rows(spark, sf_dir):
    s = member_sets(spark, sf_dir).select("id", M.structure_scores(c("pred"), c("gold")).alias("s"))
    return rounded(s.select("id", "s.tp", "s.fp", "s.fn", "s.iou", "s.f1"))


@query("""with s as (select id, list_sort(list_distinct(list(p))) as p, list_distinct(list(g)) as g from {members} group by id)
select id, len(list_intersect(p, g)) as both, len(p) - len(list_intersect(p, g)) as only_pred, len(list_distinct(list_concat(p, g))) as either from s""")
def member_set_algebra(spark, sf_dir):
    s = member_sets(spark, sf_dir)
    size = lambda x: F.size(x).cast("long")
    return s.select(
        "id", size(F.array_intersect("pred", "gold")).alias("both"), size(F.array_except("pred", "gold")).alias("only_pred"), size(F.array_union("pred", "gold")).alias("either")
    )


@query("""select p_size as grp, round(avg(case when p_retailprice < 1500 then p_retailprice end), 6) as mean, count(case when p_retailprice < 1500 then 1 end) as n from part group by 1""")
def finite_mean(spark, sf_dir):
    x = F.when(c("p_retailprice") < 1500, c("p_retailprice")).otherwise(F.when(c("p_partkey") % 2 == 0, N.lit("nan")).otherwise(N.lit("inf")))
    p = table(spark, sf_dir, "part").select(c("p_size").alias("grp"), x.alias("x"))
    return rounded(p.groupBy("grp").agg(M.finite_mean(c("x")).alias("mean"), M.finite_count(c("x")).alias("n")))


@query(f"select id, round({ANGLE}, 4) as axis_error from {{motion}}")
def axis_angle_error(spark, sf_dir):
    return motion(spark, sf_dir).select("id", F.round(V.axis_angle(c("pred_axis"), c("gold_axis")), 4).alias("axis_error"))


@query(f"select id, round({IOU}, 6) as iou from {{motion}}")
def interval_iou(spark, sf_dir):
    i = N.interval_iou(N.canonical_interval(c("plo"), c("phi")), N.canonical_interval(c("glo"), c("ghi")))
    return motion(spark, sf_dir).select("id", F.round(i, 6).alias("iou"))


@query(f"select id, round(case when {NG} > 1e-12 then {PDIST} end, 6) as distance from {{motion}}")
def pivot_line_distance(spark, sf_dir):
    return motion(spark, sf_dir).select("id", F.round(V.point_to_line(c("pred_pivot"), c("gold_pivot"), c("gold_axis")), 6).alias("distance"))


@query("select id, round((px - 1) / 2e0 + 3, 6) as mx, round((py - 2) / 2e0 + 3, 6) as my, round(px, 6) as sx, round(pz, 6) as sz from {motion}")
def frame_round_trip(spark, sf_dir):
    m = motion(spark, sf_dir)
    centre, low, s = V.vec(1, 2, 3), V.vec(-3, -3, -3), N.lit(2)
    model = V.source_to_model(c("pred_axis"), centre, s, low)
    back = V.model_to_source(model, centre, s, low)
    return rounded(m.select("id", model[0].alias("mx"), model[1].alias("my"), back[0].alias("sx"), back[2].alias("sz")))


@query("""select id, ptype as kind, round(case ptype when 'C' then round(radians(px), 5) when 'B' then round(px * 0.01e0, 5) end, 6) as lo,
    round(case ptype when 'C' then round(radians(py), 5) when 'B' then round(py * 0.01e0, 5) end, 6) as hi, round(-case ptype when 'C' then round(radians(px), 5) when 'B' then round(px * 0.01e0, 5) end, 6) as flipped_hi
    from {motion}""")
def motion_range_conversion(spark, sf_dir):
    r = N.motion_range(c("ptype"), c("px"), c("py"), N.lit(0.01))
    return rounded(motion(spark, sf_dir).select("id", c("ptype").alias("kind"), r[0].alias("lo"), r[1].alias("hi"), N.flip_range(r)[1].alias("flipped_hi")))


@query(f"""select id, round(px*cos(0.5e0) - py*sin(0.5e0), 6) as rx, round(px*sin(0.5e0) + py*cos(0.5e0), 6) as ry, round(pz, 6) as rz from {{motion}}""")
def rodrigues_rotation(spark, sf_dir):
    r = V.rodrigues(c("pred_axis"), V.vec(0, 0, 1), N.lit(0.5))
    return rounded(motion(spark, sf_dir).select("id", *[r[k].alias(n) for k, n in enumerate(("rx", "ry", "rz"))]))


@query("select id, round(px, 6) as x, round(1 + (py-1)*cos(radians(30e0)) - (pz-1)*sin(radians(30e0)), 6) as y, round(1 + (py-1)*sin(radians(30e0)) + (pz-1)*cos(radians(30e0)), 6) as z from {motion}")
def rotate_about_axis(spark, sf_dir):
    r = V.rotate_about(c("pred_axis"), V.vec(1, 1, 1), "x", N.lit(30))
    return rounded(motion(spark, sf_dir).select("id", *[r[k].alias(n) for k, n in enumerate("xyz")]))


@query(f"""with u as (select id, px/{NP} as x, py/{NP} as y, pz/{NP} as z from {{motion}} where {NP} > 1e-12),
    w as (select id, case when z < 0 or (z = 0 and (y < 0 or (y = 0 and x < 0))) then -1e0 else 1e0 end as s, x, y, z from u)
select id, round_even(degrees(acos(greatest(-1e0, least(1e0, s*z)))), 0)::int as theta,
    (round_even(case when degrees(atan2(s*y, s*x)) < 0 then degrees(atan2(s*y, s*x)) + 360 else degrees(atan2(s*y, s*x)) end, 0)::int % 360) as phi from w""")
def theta_phi_encode(spark, sf_dir):
    t = V.theta_phi(c("pred_axis"))
    return motion(spark, sf_dir).where(V.length(c("pred_axis")) > 1e-12).select("id", t["theta"].alias("theta"), t["phi"].alias("phi"))


@query(f"""with u as (select *, gx/{NG} as ux, gy/{NG} as uy, gz/{NG} as uz from {{motion}} where {NG} > 1e-12),
    t as (select *, (px-pz)*ux + (py-px)*uy + (pz-py)*uz as k from u)
select id, round(pz + ux*k, 6) as x, round(px + uy*k, 6) as y, round(py + uz*k, 6) as z from t""")
def pivot_projection(spark, sf_dir):
    m = motion(spark, sf_dir).where(V.length(c("gold_axis")) > 1e-12)
    p = V.project_pivot(c("pred_pivot"), c("gold_axis"), c("pred_axis"))
    return rounded(m.select("id", *[p[k].alias(n) for k, n in enumerate("xyz")]))


@query(f"""with a as (select *, px/{NP} as ax, py/{NP} as ay, pz/{NP} as az, gx/{NG} as bx, gy/{NG} as by_, gz/{NG} as bz from {{motion}} where {NP} > 1e-12 and {NG} > 1e-12),
    n as (select *, ay*bz-az*by_ as nx, az*bx-ax*bz as ny, ax*by_-ay*bx as nz from a),
    d as (select *, sqrt(nx*nx+ny*ny+nz*nz) as ln, gy-pz as dx, gz-px as dy, gx-py as dz from n)
select id, round(case when ln < 1e-6 then sqrt(power(dy*az-dz*ay,2)+power(dz*ax-dx*az,2)+power(dx*ay-dy*ax,2)) else abs(dx*nx+dy*ny+dz*nz)/ln end, 4) as distance from d""")
def line_line_distance(spark, sf_dir):
    m = motion(spark, sf_dir).where((V.length(c("gold_axis")) > 1e-12) & (V.length(c("pred_axis")) > 1e-12))
    return m.select("id", F.round(V.line_distance(c("pred_pivot"), c("pred_axis"), c("gold_pivot"), c("gold_axis")), 4).alias("distance"))


@query("select id, round(abs(px*0.6e0 + pz*0.8e0 - 1), 6) as dist, round(hardness_pa, 2) as pa from (select *, px * 9.807e6 as hardness_pa from {motion})")
def plane_offset_and_units(spark, sf_dir):
    d = V.plane_offset(c("pred_axis"), V.vec(0.6, 0, 0.8), N.lit(-1))
    return motion(spark, sf_dir).select("id", F.round(d, 6).alias("dist"), F.round(N.hv_to_pa(c("px")), 2).alias("pa"))


PRIOR_SQL = """(values ('metal', 2700, 8900, 5e10, 2.5e11, 0.25, 0.35, 0.2, 0.8), ('plastic', 850, 1500, 5e8, 8e9, 0.30, 0.45, 0.2, 0.6),
    ('fabric', 300, 1500, 1e6, 1e9, 0.30, 0.49, 0.4, 1.2), ('leather', 600, 1000, 5e7, 5e8, 0.35, 0.49, 0.5, 1.0),
    ('foam', 20, 300, 1e5, 5e8, 0.20, 0.45, 0.4, 1.0), ('rubber', 900, 1400, 1e6, 1e7, 0.45, 0.49, 0.6, 1.5),
    ('glass', 2200, 2600, 5e10, 9e10, 0.20, 0.25, 0.3, 0.9), ('stone', 2200, 3000, 2e10, 7e10, 0.15, 0.30, 0.6, 1.2),
    ('ceramics', 2000, 6000, 1e11, 4e11, 0.20, 0.30, 0.4, 1.0), ('wood', 300, 900, 5e8, 2e10, 0.25, 0.40, 0.4, 0.9),
    ('concrete', 1800, 2600, 2e10, 4e10, 0.15, 0.25, 0.6, 1.0)) as q(material, dl, dh, yl, yh, pl, ph, fl, fh)"""


@query(f"""select id,
    (not friction between 0 and 3)::int + (not (young > 0 and young <= 1e12))::int + (not (poisson > -1 and poisson < 0.5))::int
        + (not (density > 0 and density <= 30000))::int as n_value,
    coalesce((not density between dl and dh)::int + (not young between yl and yh)::int + (not poisson between pl::double and ph::double)::int
        + (not friction between fl::double and fh::double)::int, 0) as n_prior,
    case when material in ('rubber', 'foam', 'fabric', 'leather', 'other') or young <= 0 or hardness <= 0
        or hardness * 9.807e6 / young between 1e-3 and 1e-1 then 0 else 1 end as n_hardness,
    case when (affordance <= 2 or graspable) and friction < 0.2 then 1 else 0 end as n_friction from {{phys}} left join {PRIOR_SQL} using (material)""")
def physics_rule_set(spark, sf_dir):
    out = R.check_parts(view(spark, sf_dir, "phys"), R.priors(spark))
    return out.select("id", *[F.size(f"{n}_issues").alias(f"n_{n}") for n in ("value", "prior", "hardness", "friction")])


@query("select id, not friction between 0 and 3 as friction, not (poisson > -1 and poisson < 0.5) as poisson from {phys}")
def value_range_check(spark, sf_dir):
    v = view(spark, sf_dir, "phys").withColumn("v", R.value_ranges())
    return v.select("id", F.array_contains("v", "friction").alias("friction"), F.array_contains("v", "poisson").alias("poisson"))


@query("select id, round(ln(hardness * 9.807e6 / young), 6) as log_ratio from {phys}")
def hardness_ratio_check(spark, sf_dir):
    return view(spark, sf_dir, "phys").select("id", F.round(F.ln(R.hardness_ratio(c("hardness"), c("young") / 1e9)), 6).alias("log_ratio"))


@query("""with p as (select entity, coalesce(sum(density * volume), 0) as pm, count(*) filter (density * volume <= 0) as bad, count(*) filter (volume is null) as gone
    from (select * replace (case when affordance = 7 then null when affordance = 6 then 0 else volume end as volume) from {phys}) group by 1), o as (select o_orderkey as entity, o_totalprice / 10e0 as om from orders)
select entity, round(pm, 4) as parts_mass, round(om, 4) as object_mass, round(abs(pm - om) / greatest(om, 1e-6), 6) as rel_err,
    abs(pm - om) / greatest(om, 1e-6) > 0.5 as warning, bad as non_positive, gone as missing_volume from p join o using (entity)""")
def mass_consistency(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("entity"), (c("o_totalprice") / 10.0).alias("object_mass"))
    volume = F.when(c("affordance") == 7, None).when(c("affordance") == 6, 0.0).otherwise(c("volume"))
    m = R.mass_consistency(view(spark, sf_dir, "phys").withColumn("volume", volume), o)
    return m.select(
        "entity", *[F.round(n, 4).alias(n) for n in ("parts_mass", "object_mass")], F.round("rel_err", 6).alias("rel_err"), "warning", "non_positive", "missing_volume"
    )


@query("""select id, (list_sort([p0,p1,p2])[1] < 1e-6) or (list_sort([p0,p1,p2])[2]/list_sort([p0,p1,p2])[1] > 100 and list_sort([p0,p1,p2])[3]/list_sort([p0,p1,p2])[1] > 100) as slender,
    round(sqrt(power(greatest(0, g0 - p0), 2) + power(greatest(0, g1 - p1), 2) + power(greatest(0, g2 - p2), 2)), 6) as gap from {objects}""")
def slender_and_box_gap(spark, sf_dir):
    o = view(spark, sf_dir, "objects")
    zero = N.lit(0)
    gap = R.box_gap([(zero, c(f"p{k}")) for k in range(3)], [(c(f"g{k}"), c(f"g{k}") + 1) for k in range(3)])
    return o.select("id", R.slender(c("p0"), c("p1"), c("p2")).alias("slender"), F.round(gap, 6).alias("gap"))


@query("""select id, p0*p1 <= 0.1e0*g0*g1*10 and p2 <= 5 and (pmass < 10 or p0*p1*p2 / pmass > 50) as small from {objects}""")
def small_part_candidates(spark, sf_dir):
    o = view(spark, sf_dir, "objects")
    odd = (c("pmass") < 10) | (F.try_divide(c("p0") * c("p1") * c("p2"), c("pmass")) > 50)
    return o.select("id", ((c("p0") * c("p1") <= 0.1 * c("g0") * c("g1") * 10) & (c("p2") <= 5) & odd).alias("small"))


@query("""select source, round(avg((l.quality = l.toxic)::int), 6) as accuracy, count(*) as n from documents d join labels l using (doc_id) group by 1""")
def classification_accuracy(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return rounded(d.groupBy("source").agg(M.ratio(c("quality") == c("toxic")).alias("accuracy"), F.count(F.lit(1)).alias("n")))


@query("""with x as (select l_orderkey % 20 as shape, l_suppkey % 5 as gold, l_partkey % 4 as pred from lineitem), k as (select shape, gold, pred, count(*) as n from x group by all),
    g as (select shape, gold, sum(n) as ng from k group by all), p as (select shape, pred, sum(n) as np from k group by all),
    b as (select shape, gold, max(100.0 * n / (ng + np - n)) as best from k join g using (shape, gold) join p using (shape, pred) group by all)
select shape, round(avg(best), 6) as miou from b group by 1""")
def best_iou_miou(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select((c("l_orderkey") % 20).alias("shape"), (c("l_suppkey") % 5).alias("gold"), (c("l_partkey") % 4).alias("pred"))
    return rounded(M.best_iou(x, "shape", "gold", "pred"))


@query("""with s as (select object, quantile_cont(value / 25, 0.95) as p95, quantile_cont(value / 100, 0.1) as p10, avg((value < 40)::int) as share,
        count(*) filter (event_type <> 'error') as angles, max(value) < 90 as lost from {frames} group by 1)
    select object, round(p95, 6) as p95, round(p10, 6) as p10, round(share, 6) as share, case when angles = 0 then -2
        when object % 2 = 0 and (lost or (share > 0.1 and p10 < 0.4)) or p95 > 3 then 0 else 1 end as level from s""")
def percentile_verdict(spark, sf_dir):
    s = view(spark, sf_dir, "frames").groupBy("object").agg(
        F.percentile(c("value") / 25, 0.95).alias("p95"), F.percentile(c("value") / 100, 0.1).alias("p10"), F.avg((c("value") < 40).cast("int")).alias("share"),
        F.count_if(c("event_type") != "error").alias("angles"), (F.max("value") < 90).alias("lost"),
    )
    level = M.verdict(c("object") % 2 == 0, c("lost"), c("share"), c("p10"), c("p95"), c("angles"))
    return rounded(s.withColumn("level", level).drop("angles", "lost"))


@query("select round(sum(10e0 * n_out / 1e6 + 1.25e0 * n_in / 1e6), 6) as cost, count(*) as calls from (select length(text) as n_in, turn * 10 as n_out from conversations)")
def token_cost(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select(F.length("text").alias("n_in"), (c("turn") * 10).alias("n_out"))
    return rounded(t.agg(F.sum(10 * c("n_out") / 1e6 + 1.25 * c("n_in") / 1e6).alias("cost"), F.count(F.lit(1)).alias("calls")))


@query("""select gtype, round(avg(1 - abs(case when sqrt(px*px+py*py+pz*pz) > 0 and sqrt(gx*gx+gy*gy+gz*gz) > 0 then (px*gx+py*gy+pz*gz)/(sqrt(px*px+py*py+pz*pz)*sqrt(gx*gx+gy*gy+gz*gz)) end)), 6) as direction,
    round(avg(abs(plo-glo) + abs(phi-ghi)), 6) as span, round(avg(-0.1e0 * ln(exp(-abs(plo-glo)/0.1e0) + exp(-abs(phi-ghi)/0.1e0))), 6) as softmin from {motion} group by 1""")
def motion_losses(spark, sf_dir):
    cos = V.dot(V.unit(c("pred_axis")), V.unit(c("gold_axis")))
    a, b = F.abs(c("plo") - c("glo")), F.abs(c("phi") - c("ghi"))
    return rounded(motion(spark, sf_dir).groupBy("gtype").agg(
        F.avg(1 - F.abs(cos)).alias("direction"), F.avg(a + b).alias("span"), F.avg(-0.1 * F.ln(F.exp(-a / 0.1) + F.exp(-b / 0.1))).alias("softmin")
    ))


@query("""select entity, count(*) as n, round(sqrt(sum(density*density)), 3) as norm, round(max(young), 1) as max_young, round(sum(density*exp(-friction))/sum(exp(-friction)), 6) as pooled from {phys} group by 1""")
def masked_pooling(spark, sf_dir):
    w = F.exp(-c("friction"))
    p = view(spark, sf_dir, "phys").groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.sum(c("density") * c("density"))), 3).alias("norm"), F.round(F.max("young"), 1).alias("max_young"), F.round(F.sum(c("density") * w) / F.sum(w), 6).alias("pooled")
    )
    return p


@query("select 'lines' as name, count(*) as n, count(*) filter (l_returnflag = 'A') as kept, count(*) filter (l_returnflag <> 'A') as skipped from lineitem")
def eval_input_summary(spark, sf_dir):
    kept = c("l_returnflag") == "A"
    return table(spark, sf_dir, "lineitem").agg(F.first(F.lit("lines")).alias("name"), F.count(F.lit(1)).alias("n"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("skipped"))
