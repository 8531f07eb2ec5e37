"""Queries of part and motion picks, dataset unions, filters and measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import parts as P
from .q_eval import rounded
from .registry import query
from .views import table, view

c = F.col

@query("""select 'customers' as dataset, c_custkey as id, c_acctbal as value, null::varchar as extra from customer union all
    select 'suppliers', s_suppkey, s_acctbal, s_name from supplier""")
def dataset_union(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(c("c_custkey").alias("id"), c("c_acctbal").alias("value"))
    b = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("id"), c("s_acctbal").alias("value"), c("s_name").alias("extra"))
    return P.union_datasets({"customers": a, "suppliers": b}).select("dataset", "id", "value", "extra")


@query("""select 'customers' as dataset, count(*) as n, round(avg(c_acctbal), 4) as mean from customer union all select 'suppliers', count(*), round(avg(s_acctbal), 4) from supplier""")
def datasets_one_by_one(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(c("c_acctbal").alias("value"))
    b = table(spark, sf_dir, "supplier").select(c("s_acctbal").alias("value"))
    each = P.merged_or_each({"customers": a, "suppliers": b}, apart=True)
    out = {n: df.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean")) for n, df in each.items()}
    return P.union_datasets(out).select("dataset", "n", "mean")


def _motions(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), (c("l_partkey") % 5).alias("a"), (c("l_suppkey") % 4).alias("b"), c("l_tax").alias("axis")
    )
    there = lambda ok: F.when(ok, F.struct(F.when(c("axis") > 0.02, c("axis")).alias("axis")))
    return m.select("id", "a", "b", F.create_map(F.lit("C"), there(c("a") > 1), F.lit("B"), there(c("b") > 1), F.lit("A"), there(F.lit(True))).alias("motions"))


@query("""select id, case when b > 1 and axis > 0.02 then 'B' when a > 1 and axis > 0.02 then 'C' end as kind from
    (select l_orderkey * 10 + l_linenumber as id, l_partkey % 5 as a, l_suppkey % 4 as b, l_tax as axis from lineitem)""")
def label_motion_pick(spark, sf_dir):
    return _motions(spark, sf_dir).select("id", P.label_motion(c("motions")).alias("kind"))


@query("""select id, case when a = 4 and b > 1 then 'B' when a > 1 then 'C' when b > 1 then 'B' end as kind from
    (select l_orderkey * 10 + l_linenumber as id, l_partkey % 5 as a, l_suppkey % 4 as b from lineitem)""")
def gold_motion_pick(spark, sf_dir):
    listed = F.when(c("a") == 4, F.array(F.lit("A"), F.lit("B")))
    return _motions(spark, sf_dir).select("id", P.gold_motion(listed, c("motions")).alias("kind"))


@query("""select id, least(p0 - 1, p1, p2 - 1) < 1e-6 or pmass - 1 < 1e-10 as invalid from {objects}""")
def invalid_parts(spark, sf_dir):
    o = view(spark, sf_dir, "objects")
    return o.select("id", P.invalid_part([c("p0") - 1, c("p1"), c("p2") - 1], c("pmass") - 1).alias("invalid"))


@query("select idx, part from {points} where part < 7")
def class_range_filter(spark, sf_dir):
    return view(spark, sf_dir, "points").where(c("part") < 7).select("idx", "part")


@query("select l_orderkey * 10 + l_linenumber as id, case when l_quantity % 9 <= 3 then 'parent' else 'others' end as side from lineitem")
def contact_side(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), P.touching_side(c("l_quantity") % 9).alias("side"))


@query("""with v as (select entity, src, max(seq) as seq from {edges} group by all), m as (select entity, max(src) as last from v group by 1),
    g as (select entity, unnest(range(0, last + 1)) as k from m)
    select g.entity, string_agg(coalesce(seq::varchar, '-'), ',' order by k) as items from g left join v on v.entity = g.entity and v.src = g.k group by 1""")
def dense_lists(spark, sf_dir):
    d = P.dense_list(view(spark, sf_dir, "edges"), ["entity"], "src", "seq")
    return d.select("entity", F.array_join("items", ",", "-").alias("items"))


@query("select part, round(max(0.6 * x + 0.8 * z + 1) - min(0.6 * x + 0.8 * z + 1), 6) as thickness from {points} group by 1")
def plane_thickness(spark, sf_dir):
    return rounded(P.thickness(view(spark, sf_dir, "points"), ["part"], (0.6, 0.0, 0.8), 1.0))


@query("select id, round(greatest(p0, p1, p2) / greatest(g0, g1, g2), 6) as scale from {objects}")
def real_sim_scale(spark, sf_dir):
    return view(spark, sf_dir, "objects").select("id", F.round(P.sim_scale([c(f"p{k}") for k in range(3)], [c(f"g{k}") for k in range(3)]), 6).alias("scale"))


@query("select idx, round(least(greatest(x, -0.1), 0.1), 6) as x, round(least(greatest(y, -0.05), 0.2), 6) as y from {points}")
def point_clip(spark, sf_dir):
    return rounded(view(spark, sf_dir, "points").select("idx", P.clipped(c("x"), -0.1, 0.1).alias("x"), P.clipped(c("y"), -0.05, 0.2).alias("y")))


@query("""with s as (select l_orderkey as batch, list(l_quantity order by l_linenumber, l_quantity) as v from lineitem group by 1), m as (select max(len(v)) as most from s)
    select batch, len(v) as n, most as length, array_to_string(list_transform(v, lambda x: x::int::varchar), ',') || repeat(',nan', (most - len(v))::int) as filled from s, m""")
def pad_to_longest(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("batch")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("v"))
    s = s.select("batch", c("v.l_quantity").alias("v"))
    out = s.withColumn("length", s.agg(F.max(F.size("v"))).scalar()).withColumn("filled", P.padded(c("v"), c("length")))
    text = F.transform("filled", lambda x: F.when(F.isnan(x), F.lit("nan")).otherwise(x.cast("int").cast("string")))
    return out.select("batch", F.size("v").cast("long").alias("n"), c("length").cast("long").alias("length"), F.array_join(text, ",").alias("filled"))


@query("""with b as (select part, (min(x) + max(x)) / 2 as cx, (min(y) + max(y)) / 2 as cy, min(z) as cz from {points} where idx % 2 = 0 group by 1)
    select idx, round(x - cx, 6) as x, round(y - cy, 6) as y, round(z - cz, 6) as z from {points} join b using (part)""")
def object_centre_shift(spark, sf_dir):
    p = view(spark, sf_dir, "points").select("idx", "part", "x", "y", "z")
    return rounded(P.centre_shift(p, p.where("idx % 2 = 0"), "part").drop("part"))


@query("select view, face from {pixels} group by 1, 2 having count(distinct mask) > 1")
def voted_faces(spark, sf_dir):
    return P.voted_faces(view(spark, sf_dir, "pixels"), "view", "face", "mask")


@query("""with s as (select l_orderkey as id, list(distinct l_partkey % 12) as a, list(distinct l_suppkey % 12) as b from lineitem group by 1),
    w as (select range as part, (range % 4) * 1.5e0 as area from range(11)),
    e as (select id, a, b, unnest(list_distinct(list_concat(a, b))) as part from s),
    t as (select id, sum(area) as u, sum(case when list_contains(a, part) and list_contains(b, part) then area else 0 end) as i,
        sum(case when list_contains(a, part) then area else 0 end) as wa, sum(case when list_contains(b, part) then area else 0 end) as wb
        from (select id, a, b, part, coalesce(area, 0) as area from e left join w using (part)) group by 1)
    select id, round(case when u > 0 then i / u else 0 end, 6) as area_iou, round(case when least(wa, wb) > 0 then i / least(wa, wb) else 0 end, 6) as containment from t""")
def itemset_area_iou(spark, sf_dir):
    sets = table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("id")).agg(F.collect_set(c("l_partkey") % 12).alias("a"), F.collect_set(c("l_suppkey") % 12).alias("b"))
    areas = spark.range(11).select(c("id").alias("part"), (c("id") % 4 * 1.5).alias("area"))
    return rounded(P.itemset_iou(sets, "a", "b", areas).select("id", "area_iou", "containment"))


@query("""select entity, count(distinct src) as pieces, count(distinct src) between 2 and 5 as split from {edges} where kind <> 'A' group by 1""")
def component_guard(spark, sf_dir):
    return P.whole_or_split(view(spark, sf_dir, "edges").where("kind <> 'A'"), "entity", "src").select("entity", "pieces", "split")


@query("""with recursive d as (select distinct p_partkey % 97 as name, p_size as needs from part where p_partkey % 7 = 0), r as (select * from d union select r.name, d.needs from r join d on r.needs = d.name)
    select name from r where name = needs""")
def cycle_check(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_partkey % 7 = 0").select((c("p_partkey") % 97).alias("name"), c("p_size").cast("long").alias("needs"))
    return P.names_in_cycles(p)


@query("""with k as (select l_orderkey as joint, (l_linenumber % 3)::varchar as colour, max(l_quantity) as x, max(l_discount) as y, max(l_tax) as z from lineitem group by 1, 2),
    r as (select * from k union all select joint, 'average', avg(x), avg(y), avg(z) from k group by 1),
    p as (select o_orderkey as joint, case when o_orderkey % 4 = 3 then 'average' else (o_orderkey % 4)::varchar end as colour, 25e0 as x, 0.05e0 as y, 0.04e0 as z from orders)
    select p.joint, p.colour, round(r.x, 5) as x_row, coalesce(round(p.x, 5) = round(r.x, 5) and round(p.y, 5) = round(r.y, 5) and round(p.z, 5) = round(r.z, 5), false) as same
    from p left join r on p.joint = r.joint and p.colour = r.colour""")
def colour_candidates(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    k = l.groupBy(c("l_orderkey").alias("joint"), (c("l_linenumber") % 3).cast("string").alias("colour")).agg(F.max("l_quantity").alias("x"), F.max("l_discount").alias("y"), F.max("l_tax").alias("z"))
    colour = F.when(c("o_orderkey") % 4 == 3, "average").otherwise((c("o_orderkey") % 4).cast("string"))
    p = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("joint"), colour.alias("colour"), F.lit(25.0).alias("x"), F.lit(0.05).alias("y"), F.lit(0.04).alias("z"))
    return P.chosen_row(p, k, ["joint"]).select("joint", "colour", F.round("x_row", 5).alias("x_row"), "same")


@query("""with n as (select user_id, count(*) filter (event_type = 'click') as clicks, count(*) filter (event_type = 'error') as errors from events group by 1)
    select user_id, 'clicks: ' || clicks || chr(10) || 'errors: ' || errors as report from n""")
def stage_report(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(c("event_type") == "click").alias("clicks"), F.count_if(c("event_type") == "error").alias("errors"))
    return P.report_lines(n, "user_id", ["clicks", "errors"])


@query("""with x as (select o_custkey as entity, case when o_orderkey % 5 = 0 then 'p' || o_orderkey else o_orderkey::varchar end as ident from orders)
    select entity, ident, (row_number() over (partition by entity order by try_cast(ident as bigint) nulls last, ident) - 1)::int as place from x""")
def numeric_id_order(spark, sf_dir):
    ident = F.when(c("o_orderkey") % 5 == 0, F.concat(F.lit("p"), c("o_orderkey").cast("string"))).otherwise(c("o_orderkey").cast("string"))
    x = table(spark, sf_dir, "orders").select(c("o_custkey").alias("entity"), ident.alias("ident"))
    return P.by_number(x, "entity", "ident")
