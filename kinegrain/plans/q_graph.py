"""Queries of graphs, itemsets and dependencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chain
from ..operators import graph as G
from .registry import query
from .views import table, view

c = F.col


@query("""with recursive e as (select entity, src as u, dst as v from {edges} union select entity, dst, src from {edges}), r as (select entity, u as node, u as far from e union select r.entity, node, v from r join e on r.entity = e.entity and far = u)
select entity, node, min(far) as component from r group by 1, 2""")
def union_find_components(spark, sf_dir):
    return G.components(view(spark, sf_dir, "edges").select("entity", c("src").alias("a"), c("dst").alias("b")), ["entity"])


@query("""with recursive e as (select distinct entity, src, dst, kind from {edges}), s as (select distinct entity, dst as node from e where kind in ('B', 'C')),
    r as (select entity, node as start, node, 0 as hop from s union select r.entity, start, dst, 1 from r join e on r.entity = e.entity and r.node = src and (hop = 0 or kind in ('B', 'C', 'D')))
select distinct entity, start, node from r""")
def motion_reachability(spark, sf_dir):
    e = view(spark, sf_dir, "edges")
    return G.reachable(e, G.motion_nodes(e))


@query("""with l as (select entity, src, dst, kind, arg_max(lo, seq) as lo, arg_max(hi, seq) as hi from {edges} group by all), a as (select * from l union all select entity, dst, src, kind, lo, hi from l where kind in ('A', 'D')),
    m as (select entity, src, dst, kind, min({'a': lo, 'b': hi}) as r from a group by all),
    o as (select *, max((kind <> 'D')::int) over (partition by entity, least(src, dst), greatest(src, dst)) as other from m)
select entity, src, dst, kind, r.a as lo, r.b as hi from o where kind <> 'D' or other = 0""")
def motion_graph(spark, sf_dir):
    return G.motion_graph(view(spark, sf_dir, "edges"))


@query("with n as (select entity, src as node, kind from {edges} union all select entity, dst, kind from {edges}) select entity, node from n group by 1, 2 having bool_and(kind = 'A')")
def contact_only_nodes(spark, sf_dir):
    return G.contact_only(view(spark, sf_dir, "edges"))


SETS = """with recursive b as (select basket, item from {baskets}), r as (
        select basket, [item] as items from b union all
        select r.basket, list_append(r.items, b.item) from r join b on r.basket = b.basket and b.item > r.items[-1]),
    f as (select items, count(*) as n from r group by 1 having count(*) >= 60)"""


def baskets(spark, sf_dir):
    """The rows of the view of baskets, with repeats, which itemsets() doesn't count: the view's DISTINCT would shuffle them once more."""
    return table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("basket"), (c("l_partkey") % 20).alias("item"))


@query(f"{SETS} select * from f")
def itemset_support(spark, sf_dir):
    return G.itemsets(baskets(spark, sf_dir), 60)


@query(f"{SETS} select * from f where not exists (select 1 from f as g where len(g.items) > len(f.items) and list_has_all(g.items, f.items))")
def maximal_itemsets(spark, sf_dir):
    return G.maximal(G.itemsets(baskets(spark, sf_dir), 60))


@query("""with recursive d as (select n_nationkey as name, (n_nationkey // 2) as needs from nation where n_nationkey > 0), r as (select * from d union select r.name, d.needs from r join d on r.needs = d.name) select name, needs from r""")
def dependency_closure(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where("n_nationkey > 0").select(c("n_nationkey").alias("name"), F.floor(c("n_nationkey") / 2).cast("int").alias("needs"))
    return G.closure(n)


@query("select entity, string_agg(src || '>' || dst || ':' || kind, ',' order by src, dst, kind, seq) as graph, count(*) as edges from {edges} group by 1")
def graph_export(spark, sf_dir):
    e = view(spark, sf_dir, "edges")
    items = F.array_sort(F.collect_list(F.struct("src", "dst", "kind", "seq")))
    text = F.transform(items, lambda x: F.concat(x["src"].cast("string"), F.lit(">"), x["dst"].cast("string"), F.lit(":"), x["kind"]))
    return e.groupBy("entity").agg(F.array_join(text, ",").alias("graph"), F.count(F.lit(1)).alias("edges"))


# every third number is asked for, so most that are asked for are not there
@query("select c_custkey * 3 as name from customer where not exists (select 1 from orders where o_custkey = c_custkey * 3)")
def missing_entities(spark, sf_dir):
    have = table(spark, sf_dir, "orders").select(c("o_custkey").alias("name"))
    return table(spark, sf_dir, "customer").select((c("c_custkey") * 3).alias("name")).join(have, "name", "left_anti")


#: Faces of seven objects: eleven refined parts of the first four, 150 of the others; and masks that hold two of three kinds of parts.
CHAIN = """with p as (select distinct view as entity, face as fid, case when view <= 4 then face % 11 else face % 150 end as part, mask from {pixels}),
    k as (select distinct entity, part, fid from p), m as (select distinct entity, mask, fid, part from p where (part + mask) % 3 <> 0),
    z as (select entity, count(distinct part) as refined from k group by 1), s as (select entity, part, count(*) as n from k group by 1, 2),
    h as (select entity, mask, part from m join s using (entity, part) group by entity, mask, part, n having count(*) >= 0.5 * n),
    c as (select entity, part, min(mask) as grp from h join z using (entity) where refined > 100 group by 1, 2),
    b as (select entity, mask, sum(1 << least(part, 10))::bigint as bits from h join z using (entity) where refined <= 100 group by 1, 2),
    f as (select entity, x as bits, count(*) as n from b, range(1, 2048) r(x) where (b.bits & x) = x group by 1, 2 having count(*) >= 3),
    u as (select * from f where not exists (select 1 from f g where g.entity = f.entity and g.bits <> f.bits and (g.bits & f.bits) = f.bits)),
    i as (select entity, part, arg_min(bits, (-n, -bit_count(bits), [y for y in range(11) if (bits >> y) & 1 = 1])) as bits from u, range(11) r(part) where (bits >> part) & 1 = 1 group by 1, 2),
    g as (select entity, part, 0 as late, grp as place from c union all select entity, part, 0, min(part) over (partition by entity, bits) from i),
    a as (select * from g union all select entity, part, 1, part from s where not exists (select 1 from g where g.entity = s.entity and g.part = s.part)),
    o as (select entity, part, dense_rank() over (partition by entity order by late, place) - 1 as cls from a),
    r as (select entity, count(distinct cls) as merged from o group by 1)"""


@query(f"""{CHAIN} select entity, (select count(distinct mask) from m where m.entity = z.entity) as masks, refined as refined_parts, merged as merged_parts,
    case when refined > 100 then 'containment' else 'item sets' end as strategy, case when merged > 100 then 'too many merged parts: ' || merged end as error from z join r using (entity)""")
def merge_record(spark, sf_dir):
    return _chain(spark, sf_dir)[1]


@query(f"{CHAIN} select entity, fid, cls::int as cls from o join k using (entity, part) join r using (entity) where merged <= 100")
def merge_chain(spark, sf_dir):
    return _chain(spark, sf_dir)[0]


def _chain(spark, sf_dir):
    p = view(spark, sf_dir, "pixels").select(c("view").alias("entity"), c("face").alias("fid"), F.when(c("view") <= 4, c("face") % 11).otherwise(c("face") % 150).alias("part"), "mask")
    return chain.refine_and_merge(p, p.where("(part + mask) % 3 <> 0"))
