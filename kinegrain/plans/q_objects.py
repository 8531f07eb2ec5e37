"""Queries of motion labels, prompts, masks and meshes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import jsonv as J
from ..functions import numeric as N
from ..functions import text as T
from ..functions import vec3 as V
from ..operators import clouds as C
from ..operators import datasets as D
from ..operators import graph as G
from ..operators import grouped as P
from ..operators import raster as R
from ..operators import spatial as S
from ..plans import stages
from .q_eval import motion, rounded
from .registry import query
from .views import table, view

c = F.col


@query()
def mask_absorption(spark, sf_dir):
    return P.absorb(view(spark, sf_dir, "pixels"), "view", "face", "mask")


@query()
def overlap_merge(spark, sf_dir):
    p = view(spark, sf_dir, "pixels").select((c("view")).alias("entity"), c("mask").alias("grp"), (c("face") % 60).alias("item")).distinct().withColumn("weight", c("item") % 5 + 1)
    return P.merge_overlapping(p, "entity", "grp", "item", "weight")


@query("select distinct view, cast(null as bigint) as mask, 1000 + view as face from {pixels} union select distinct view, mask, face from {pixels}")
def uncovered_parts(spark, sf_dir):
    p = view(spark, sf_dir, "pixels").select("view", "mask", "face").distinct()
    parts = p.select("view", "face").unionByName(p.select("view", (c("view") + 1000).alias("face"))).distinct()
    return P.with_uncovered(p, parts, ["view", "face"])


@query()
def connectivity_repair(spark, sf_dir):
    return P.repair(view(spark, sf_dir, "points"), "part")


def _farthest_sql(k: int) -> str:
    """Each step's point is the farthest from those before; ties go to the least index."""
    steps = ["with p as (select part, idx, x, y, z, count(*) over (partition by part) as n from {points})", "c0 as (select * from p qualify row_number() over (partition by part order by idx) = 1)"]
    d2 = "power(p.x - c.x, 2) + power(p.y - c.y, 2) + power(p.z - c.z, 2)"
    for i in range(1, k):
        last = "" if i == 1 else f", d{i - 1} as e"
        near = d2 if i == 1 else f"least(e.d, {d2})"
        on = "" if i == 1 else " and e.part = p.part and e.idx = p.idx"
        steps.append(f"d{i} as (select p.*, {near} as d from p, c{i - 1} c{last} where p.part = c.part{on})")
        steps.append(f"c{i} as (select * exclude (d) from d{i} where n > {i} qualify row_number() over (partition by part order by d desc, idx) = 1)")
    return ",\n".join(steps) + "\n" + " union all ".join(f"select part, idx, {i} as rank from c{i}" for i in range(k))


@query(_farthest_sql(8))
def farthest_sampling(spark, sf_dir):
    return P.farthest(view(spark, sf_dir, "points"), "part", 8)


@query()
def small_region_removal(spark, sf_dir):
    return P.clean_masks(view(spark, sf_dir, "pixels"), ["view", "mask"], 64, 64, 3)


@query()
def small_part_merge(spark, sf_dir):
    a = view(spark, sf_dir, "annotations").select("entity", "part", c("price").alias("size"))
    pairs = a.select("entity", c("part").alias("a"), "size").join(a.select("entity", c("part").alias("b")), "entity").where("a < b").select("entity", "a", "b", c("size").alias("w"))
    return P.small_parts(a, pairs, "entity", 100_000.0)


@query()
def seeded_cosegmentation(spark, sf_dir):
    p = view(spark, sf_dir, "points").withColumn("shape", c("idx") % 5)
    return P.coseg(p, "shape", 0)


@query("""with b as (select *, row_number() over (partition by grp order by score desc, id) as rank from (select grp, id, max(score) as score, min(x0) as x0, min(y0) as y0, min(x1) as x1, min(y1) as y1 from {boxes} group by 1, 2)),
    i as (select x.grp, x.id as a, y.id as b, greatest(0e0, least(x.x1, y.x1) - greatest(x.x0, y.x0)) * greatest(0e0, least(x.y1, y.y1) - greatest(x.y0, y.y0)) as inter,
        (x.x1-x.x0)*(x.y1-x.y0) + (y.x1-y.x0)*(y.y1-y.y0) as total, case when x.rank > y.rank then x.id else y.id end as loser from b x join b y on x.grp = y.grp and x.id < y.id),
    w as (select grp, loser as id, max(inter / (total - inter)) as iou from i group by 1, 2), k as (select b.grp, b.id, b.rank, coalesce(iou <= 0.3, true) as ok from b left join w using (grp, id)),
    a as (select *, max(ok::int) over (partition by grp) as any_ok from k) select grp, id from a where ok or (any_ok = 0 and rank <= 3)""")
def mask_nms(spark, sf_dir):
    b = view(spark, sf_dir, "boxes").groupBy("grp", "id").agg(F.max("score").alias("score"), *[F.min(n).alias(n) for n in ("x0", "y0", "x1", "y1")])
    masks, pairs = C.deciding_pairs(b, most=0.3, inside_too=False)
    return P.mask_nms(pairs, masks, 0.3)


@query("""with r as (select part, idx, row_number() over (partition by part order by idx) - 1 as place, count(*) over (partition by part) as n from {points})
select part, place, idx from r union all select part, place + 16, idx from r where n > 16 and place >= n - 16 and place < ceil(n / 16.0) * 16 - 16""")
def patch_padding(spark, sf_dir):
    return P.patch_padding(view(spark, sf_dir, "points"), "part", "idx", 16)


@query("select floor(x / 0.25e0)::bigint - lx as gx, round(avg(nx), 6) as nx, count(*) as n from {points}, (select min(floor(x / 0.25e0))::bigint as lx from {points}) group by 1")
def voxel_features(spark, sf_dir):
    p = R.voxelise(view(spark, sf_dir, "points"), 0.25).withColumns({"gy": F.lit(0), "gz": F.lit(0)})
    return rounded(P.voxel_features(p, ["nx"]).select("gx", "nx", "n"))


@query("""with e as (select a.idx as a, b.idx as b from {points} a join {points} b on a.idx < b.idx and power(a.x-b.x,2)+power(a.y-b.y,2)+power(a.z-b.z,2) <= 0.01e0)
select count(distinct a) as heads, count(*) as pairs from e""")
def near_vertex_pairs(spark, sf_dir):
    e = S.radius_pairs(view(spark, sf_dir, "points"), 0.1)
    return e.agg(F.count_distinct("a").alias("heads"), F.count(F.lit(1)).alias("pairs"))


@query("""with recursive p as (select idx, x, y, z from {points}),
    f as (select v0 as a, v1 as b from {faces} union select v1, v2 from {faces} union select v0, v2 from {faces} union
        select p.idx, q.idx from p join p as q on p.idx < q.idx and power(p.x - q.x, 2) + power(p.y - q.y, 2) + power(p.z - q.z, 2) <= 0.1 * 0.1),
    e as (select a as u, b as v from f union select b, a from f), r as (select u as node, u as far from e union select node, v from r join e on far = u)
    select node, min(far) as component from r group by 1""")
def vertex_components(spark, sf_dir):
    """Components of vertices joined by faces' edges or by nearness."""
    from ..operators.mesh import edges_of

    e = edges_of(view(spark, sf_dir, "faces")).select("a", "b").union(S.near_components(view(spark, sf_dir, "points"), 0.1))
    return G.components(e)


def motion_json(spark, sf_dir):
    m = motion(spark, sf_dir)
    item = lambda kind, ok: F.concat(F.lit(f'"{kind}":'), F.when(ok, F.concat(F.lit('{"axis":['), c("px").cast("string"), F.lit(",0.0,1.0]}"))).otherwise(F.lit("null")))
    text = F.concat(F.lit('{"motion_types":["'), F.coalesce("ptype", F.lit("A")), F.lit('"],"motion_info":{'), item("B", c("gtype") == "B"), F.lit(","), item("C", c("ptype") == "C"), F.lit("}}"))
    return m.select("id", "px", "ptype", "gtype", J.parse_json(text).alias("v"))


@query("select id, gtype = 'B' or coalesce(ptype = 'C', false) as valid, case when gtype = 'B' then 'B' when ptype = 'C' then 'C' end as kind, case when gtype = 'B' or ptype = 'C' then px end as ax from {motion}")
def valid_motion_filter(spark, sf_dir):
    # in steps, so that each value is looked up once for a row
    both = motion_json(spark, sf_dir).select("id", *[J.path(c("v"), f"motion_info.{k}").alias(k) for k in "BC"])
    kind = both.withColumn("kind", F.when(J.non_empty(c("B")), "B").when(J.non_empty(c("C")), "C"))
    axis = N.numeric_vector(J.path(F.when(c("kind") == "B", c("B")).otherwise(c("C")), "axis"), 3)
    return kind.select("id", c("kind").isNotNull().alias("valid"), "kind", axis[0].alias("ax"))


@query("""select id, case when ptype in ('B', 'C') then ptype end as first_kind, case when gtype = 'B' then 'bad_length' when ptype is null then 'bad_kind' end as error from {motion}""")
def result_schema_check(spark, sf_dir):
    m = motion(spark, sf_dir)
    axis = F.when(c("gtype") == "B", F.array("px", "py")).otherwise(c("pred_axis"))
    error = F.when(F.size(axis) != 3, "bad_length").when(~F.coalesce(c("ptype").isin("B", "C"), F.lit(False)), "bad_kind")
    kinds = F.array(c("ptype"), F.lit("A"))
    return m.select("id", F.get(F.filter(kinds, lambda k: k.isin("B", "C")), 0).alias("first_kind"), error.alias("error"))


@query("""select id, '[[' || px::bigint || ',2]]' as packed, case when ptype = 'C' then 6.28319 when ptype = 'B' then 2.0 end as hi from {motion}""")
def restore_units(spark, sf_dir):
    turn = F.when(c("ptype") == "C", F.round(N.lit(1) * 2 * 3.141592653589793, 5)).when(c("ptype") == "B", N.lit(1) * 2)
    return motion(spark, sf_dir).select("id", F.concat(F.lit("[["), c("px").cast("long").cast("string"), F.lit(",2]]")).alias("packed"), turn.alias("hi"))


@query("select id, 12 as n, round(case when sqrt(gx*gx+gy*gy+gz*gz) > 1e-12 then gx/sqrt(gx*gx+gy*gy+gz*gz) end, 6) as nx, 1e0 as zz from {motion}")
def candidate_axes(spark, sf_dir):
    a = V.plane_rotations(c("gold_axis"), c("pred_axis"), 8)
    return motion(spark, sf_dir).select("id", F.size(F.array(*a)).alias("n"), F.round(a[0][0], 6).alias("nx"), a[-1][2].alias("zz"))


@query("""select entity, '[' || string_agg('{"id":"' || part || '","position":"' || round(price, 1) || '"}', ',' order by part) || ']' as parts from (select entity, part, price from {annotations}) group by 1""")
def part_list_json(spark, sf_dir):
    item = F.concat(F.lit('{"id":"'), c("part").cast("string"), F.lit('","position":"'), F.round("price", 1).cast("string"), F.lit('"}'))
    a = view(spark, sf_dir, "annotations").select("entity", "part", item.alias("j"))
    return a.groupBy("entity").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "j"))), lambda x: x["j"]), ","), F.lit("]")).alias("parts"))


@query("select doc_id, case when doc_id % 2 = 0 then 3 else 2 end as n, 'user' as second from documents")
def alpaca_converter(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(c("doc_id") % 2 == 0, F.lit("be brief")).alias("system"), F.lit("instruction").alias("prompt"), c("text").alias("response"))
    m = D.role_messages(d, "system", "prompt", "response")
    users = F.filter("messages", lambda x: x["role"] == "user")
    return m.select("doc_id", F.size("messages").alias("n"), users[0]["role"].alias("second"))


@query("""with m as (select conv_id, turn, role, lead(role) over (partition by conv_id order by turn) as next, length(text) as n from {messages})
select conv_id, max(turn) as last_turn, arg_max(role, turn) as last_role, sum(n)::bigint as chars, count(*) filter (role = 'user' and next = 'assistant') as pairs from m group by 1""")
def turn_pairing(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    m = view(spark, sf_dir, "messages").withColumns({"next": F.lead("role").over(w), "n": F.length("text")})
    return m.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"), F.sum("n").alias("chars"), F.count_if((c("role") == "user") & (c("next") == "assistant")).alias("pairs"))


@query("""with m as (select *, sum(length(text)) over (partition by conv_id order by turn) as used from {messages}) select conv_id, turn, used::bigint as used from m where used <= 1000""")
def token_budget(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return view(spark, sf_dir, "messages").select("conv_id", "turn", F.sum(F.length("text")).over(w).alias("used")).where("used <= 1000")


@query("""with f as (select object, frame, value, sum(value) over (partition by object order by frame) as elapsed, count(*) over (partition by object) as n from {frames})
select object, frame, round(elapsed / (frame + 1), 9) as mean, round(elapsed / (frame + 1) * (n - frame - 1), 8) as remaining from f""")
def progress_timing(spark, sf_dir):
    w = Window.partitionBy("object")
    f = view(spark, sf_dir, "frames").withColumns({"elapsed": F.sum("value").over(w.orderBy("frame")), "n": F.count(F.lit(1)).over(w)})
    mean = c("elapsed") / (c("frame") + 1)
    return f.select("object", "frame", F.round(mean, 9).alias("mean"), F.round(mean * (c("n") - c("frame") - 1), 8).alias("remaining"))


@query("""with t as (select conv_id as seg, turn as i from {messages}) select a.seg, a.i, count(*) as visible from t a join t b on a.seg = b.seg and b.i <= a.i group by 1, 2""")
def packed_attention(spark, sf_dir):
    w = Window.partitionBy("seg").orderBy("i").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    m = view(spark, sf_dir, "messages").select(c("conv_id").alias("seg"), c("turn").alias("i"))
    return m.select("seg", "i", F.count(F.lit(1)).over(w).alias("visible")).groupBy("seg", "i").agg(F.sum("visible").alias("visible"))


@query("""with l as (select l_orderkey as entity, l_suppkey % 13 as k, round(l_discount, 2) as loss from lineitem) select entity, min(loss) as loss, min(k) filter (loss = lo) as k from (select *, min(loss) over (partition by entity) as lo from l) group by 1""")
def candidate_search(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("entity"), (c("l_suppkey") % 13).alias("k"), F.round("l_discount", 2).alias("loss"))
    best = F.min(F.struct("loss", "k")).alias("b")
    return l.groupBy("entity").agg(best).select("entity", "b.loss", "b.k")


@query("""select p_partkey, case when p_size > 40 then 'texture' when p_size > 25 then 'face' when p_size > 10 then 'vertex' else 'white' end as colour from part""")
def colour_fallback(spark, sf_dir):
    pick = F.coalesce(F.when(c("p_size") > 40, "texture"), F.when(c("p_size") > 25, "face"), F.when(c("p_size") > 10, "vertex"), F.lit("white"))
    return table(spark, sf_dir, "part").select("p_partkey", pick.alias("colour"))


@query("select part, dense_rank() over (order by first) - 1 as material from (select part, min(idx) as first from {points} group by 1)")
def material_index(spark, sf_dir):
    g = view(spark, sf_dir, "points").groupBy("part").agg(F.min("idx").alias("first"))
    return g.select("part", (F.dense_rank().over(Window.orderBy("first")) - 1).alias("material"))


@query("select view, mask, count(*) as area, min(prow) <= 2 or max(prow) >= 61 or min(pcol) <= 2 or max(pcol) >= 61 as near_edge, count(*) >= 40 as large from {pixels} group by 1, 2")
def mask_quality_filter(spark, sf_dir):
    b = R.mask_box(view(spark, sf_dir, "pixels"), ["view", "mask"], "prow", "pcol")
    edge = (c("r0") <= 2) | (c("r1") >= 61) | (c("c0") <= 2) | (c("c1") >= 61)
    return b.select("view", "mask", "area", edge.alias("near_edge"), (c("area") >= 40).alias("large"))


@query("select part, round(avg((r + g + b) / 765e0), 6) as light, avg((r + g + b) / 765e0) < 1e-6 as blank from {points} group by 1")
def blank_render(spark, sf_dir):
    light = F.avg((c("r") + c("g") + c("b")) / 765.0)
    return view(spark, sf_dir, "points").groupBy("part").agg(F.round(light, 6).alias("light"), (light < 1e-6).alias("blank"))


@query("select entity, count(distinct part) as parts, count(distinct part) between 1 and 19 as ok, string_agg(distinct status, '' order by status) as statuses from {annotations} group by 1")
def export_parts_gate(spark, sf_dir):
    n = F.count_distinct("part")
    return view(spark, sf_dir, "annotations").groupBy("entity").agg(n.alias("parts"), n.between(1, 19).alias("ok"), F.array_join(F.array_sort(F.collect_set("status")), "").alias("statuses"))


@query("""select '<joint name="' || id || '" type="' || case ptype when 'B' then 'slide' else 'hinge' end || '" range="' || round(plo, 2) || ' ' || round(phi, 2) || '"/>' as xml, count(*) as n from {motion} where ptype is not null group by 1""")
def joint_xml(spark, sf_dir):
    kind = F.when(c("ptype") == "B", "slide").otherwise("hinge")
    xml = F.concat(F.lit('<joint name="'), c("id").cast("string"), F.lit('" type="'), kind, F.lit('" range="'), F.round("plo", 2).cast("string"), F.lit(" "), F.round("phi", 2).cast("string"), F.lit('"/>'))
    return motion(spark, sf_dir).where(c("ptype").isNotNull()).groupBy(xml.alias("xml")).agg(F.count(F.lit(1)).alias("n"))


@query("select l_returnflag as retry, count(*) as n from lineitem where l_returnflag = 'A' and l_discount < 0.05 group by 1")
def reverse_motion_retry(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return t.where((c("l_returnflag") == "A") & (c("l_discount") < 0.05)).groupBy(c("l_returnflag").alias("retry")).agg(F.count(F.lit(1)).alias("n"))


@query("select conv_id, turn, '===BEGIN_JSON=== {} ===END_JSON===' as raw_response, '{}' as result from conversations")
def predictor_hook(spark, sf_dir):
    t = stages.predict(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), stages.echo)
    return t.select("conv_id", "turn", "raw_response", T.tagged_json(c("raw_response")).alias("result"))


@query("select event_id, user_id % 7 as fields, case when user_id % 7 = 5 then 'row' end as kept from events")
def csv_line_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("n", c("user_id") % 7)
    line = F.array_join(F.array_repeat(F.lit("x"), c("n").cast("int")), ",")
    fields = F.when(line == "", 0).otherwise(F.size(F.split(line, ",")))
    return e.select("event_id", fields.cast("long").alias("fields"), F.when(fields == 5, "row").alias("kept"))


@query("select conv_id, list(turn order by turn)[1:3] as first_members, count(distinct turn) as n from {messages} group by 1")
def ordered_members(spark, sf_dir):
    m = view(spark, sf_dir, "messages").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t"), F.count_distinct("turn").alias("n"))
    return m.select("conv_id", F.slice("t", 1, 3).alias("first_members"), "n")
