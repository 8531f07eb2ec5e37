"""Queries of annotations, records, listings, merged parts and sampled transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonv as J
from ..functions import text as T
from ..operators import augment as A
from ..operators import datasets as D
from ..operators import parts as P
from ..operators import spatial as S
from .q_eval import rounded
from .q_relational import D2, uniform
from .registry import query
from .views import table, view

c = F.col


@query("select doc_id, n_chars as n, lang from documents")
def object_level_unwrap(spark, sf_dir):
    """Wrapped, plain, and with a field of that name that is no object."""
    d = table(spark, sf_dir, "documents")
    own = F.to_json(F.struct(c("n_chars").alias("n"), c("lang").alias("lang")))
    texts = F.array(F.concat(F.lit('{"n": -1, "object_level": '), own, F.lit("}")), own, F.concat(F.lit('{"object_level": 5, '), F.substr(own, F.lit(2))))
    v = J.object_level(J.parse_json(F.get(texts, (c("doc_id") % 3).cast("int"))))
    return d.select("doc_id", F.try_variant_get(v, "$.n", "long").alias("n"), F.try_variant_get(v, "$.lang", "string").alias("lang"))


@query("""select conv_id, turn, case conv_id % 4 when 0 then 'a' || turn when 1 then 'a' || turn || ',b' when 2 then 'a' || turn || ',b,c' else '' end as media from conversations""")
def media_lists(spark, sf_dir):
    a = F.concat(F.lit('"a'), c("turn").cast("string"), F.lit('"'))
    texts = F.array(a, F.concat(F.lit("["), a, F.lit(', "b", null, ""]')), F.concat(F.lit("[["), a, F.lit(', "b"], "c", []]')), F.lit("null"))
    v = J.parse_json(F.get(texts, (c("conv_id") % 4).cast("int")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(J.media_list(v), ",").alias("media"))


@query("""select '{"schema_version":"v1","sample_id":"' || conv_id || '_' || turn || '","task":' || coalesce('"' || role || '"', 'null') || ',"source_index":' || turn || ',"source_json":'
    || case when conv_id % 3 = 0 then 'null' else '"s' || conv_id || '.json"' end || ',"inputs":{"object_pcd":"o' || conv_id || '.npz","part_pcd":' || case when turn % 2 = 0 then 'null' else '"p' || turn || '.npz"' end || '}}' as record from conversations""")
def base_records(spark, sf_dir):
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    source = F.when(c("conv_id") % 3 != 0, text("s", c("conv_id"), ".json"))
    record = D.base_record("v1", c("role"), text(c("conv_id"), "_", c("turn")), c("turn"), source, object_pcd=text("o", c("conv_id"), ".npz"), part_pcd=F.when(c("turn") % 2 != 0, text("p", c("turn"), ".npz")))
    return table(spark, sf_dir, "conversations").select(record.alias("record"))


@query("""select c_custkey from customer where c_custkey % 5 = 0 or c_custkey % 7 = 0 or c_mktsegment not in ('AUTOMOBILE', 'BUILDING')""")
def annotations_to_make(spark, sf_dir):
    """Customers without an annotation, with a broken one, or with a category that the taxonomy lacks."""
    t = table(spark, sf_dir, "customer")
    good = F.to_json(F.struct(c("c_mktsegment").alias("category")))
    existing = t.where("c_custkey % 5 <> 0").select("c_custkey", F.when(c("c_custkey") % 7 == 0, "{").otherwise(good).alias("text"))
    known = spark.createDataFrame([("AUTOMOBILE",), ("BUILDING",), (None,)], "category string")
    return D.without_valid(t.select("c_custkey"), existing, known, "c_custkey", "category")


#: Files of objects: parts for every third, folders of unfinished meshes for every fifth, older folders otherwise.
LISTING = """select s_suppkey as entity, folder, concat(cast(k as varchar(9)), case when k = 2 then '.mtl' else '.obj' end) as name from <supplier>, <folders>
    where case folder when 'parts' then s_suppkey % 3 = 0 when 'glbs' then s_suppkey % 5 = 0 when 'merge_objs' then s_suppkey % 2 = 0 else s_suppkey % 7 <> 0 end and (s_suppkey + k) % 4 <> 0"""


@query(f"""with l as ({LISTING.replace("<supplier>", "supplier").replace("<folders>", "(values ('parts'), ('glbs'), ('merge_objs'), ('objs')) f(folder), range(4) r(k)")}),
    e as (select entity, bool_or(folder = 'parts') as p, bool_or(folder = 'glbs') as g, bool_or(folder = 'merge_objs') as m from l group by 1)
select entity, folder, name from l join e using (entity) where ends_with(name, '.obj') and folder = case when p then 'parts' when g then 'none' when m then 'merge_objs' else 'objs' end""")
def useful_objs(spark, sf_dir):
    folders = "(select explode(array('parts', 'glbs', 'merge_objs', 'objs')) as folder), (select explode(sequence(0, 3)) as k)"
    rows = spark.sql(LISTING.replace("<supplier>", f"parquet.`{sf_dir}/supplier.parquet`").replace("<folders>", folders))
    return D.useful_objs(rows)


@query("""with f as (select user_id as entity, event_id % 1000 as n, case event_id % 4 when 0 then '00' else '' end || (event_id % 1000) || case event_id % 3 when 0 then '.JPG' else '.jpeg' end as name from events where event_id % 11 <> 0)
select entity, row_number() over (partition by entity order by n, name) - 1 as frame, name from f""")
def frame_folders(spark, sf_dir):
    e, n = table(spark, sf_dir, "events"), c("event_id") % 1000
    name = F.concat(F.when(c("event_id") % 4 == 0, "00").otherwise(""), n.cast("string"), F.when(c("event_id") % 3 == 0, ".JPG").otherwise(".jpeg"))
    return D.frame_listing(e.select(c("user_id").alias("entity"), F.when(c("event_id") % 11 == 0, "cover.png").otherwise(name).alias("name")))


@query("""with m as (select l_orderkey as entity, l_linenumber as part, l_partkey % 3 as grp from lineitem where l_linenumber <> 2), f as (select l_orderkey as entity, l_linenumber as part, unnest([l_suppkey % 40, l_partkey % 40]) as fid from lineitem),
    u as (select distinct entity, 0 as late, grp as place, part from m union all select distinct entity, 1, part, part from f where not exists (select 1 from m where m.entity = f.entity and m.part = f.part)),
    k as (select *, dense_rank() over (partition by entity order by late, place) - 1 as cls from u)
select entity, fid, min(cls)::int as cls from k join f using (entity, part) group by 1, 2""")
def merged_part_faces(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("entity"), c("l_linenumber").alias("part"), "l_partkey", "l_suppkey")
    groups = li.where("part <> 2").select("entity", "part", (c("l_partkey") % 3).alias("group"))
    return P.assemble(groups, li.select("entity", "part", F.explode(F.array(c("l_suppkey") % 40, c("l_partkey") % 40)).alias("fid")))


@query("""with p as (select distinct view, mask, face % 7 as part, face from {pixels}), i as (select view, mask, part, count(*) as n from p group by all),
    m as (select view, mask, count(distinct face) as a from p group by 1, 2), q as (select view, part, count(distinct face) as b from p group by 1, 2),
    u as (select view, mask, part, n / (a + b - n)::double as iou from i join m using (view, mask) join q using (view, part)),
    k as (select *, row_number() over (partition by view, mask order by iou desc, part) as r from u)
select view, round(1 - avg(iou), 6) as loss, string_agg(mask || ':' || part, ',' order by mask) as matches from k where r = 1 group by 1""")
def best_match_loss(spark, sf_dir):
    p = view(spark, sf_dir, "pixels").select("view", "mask", (c("face") % 7).alias("part"), "face").distinct()
    size = lambda k, n: p.groupBy("view", k).agg(F.count_distinct("face").alias(n))
    both = p.groupBy("view", "mask", "part").agg(F.count(F.lit(1)).alias("n")).join(size("mask", "a"), ["view", "mask"]).join(size("part", "b"), ["view", "part"])
    loss = P.best_match_loss(both.select("view", "mask", "part", (c("n") / (c("a") + c("b") - c("n"))).alias("iou")), ["view"])
    pairs = F.array_join(F.transform("matches", lambda x: F.concat(x["mask"].cast("string"), F.lit(":"), x["part"].cast("string"))), ",")
    return loss.select("view", F.round("loss", 6).alias("loss"), pairs.alias("matches"))


@query(f"with d as (select a.idx, min(sqrt({D2})) as d from {{points}} a join {{points}} b on a.part = b.part and a.idx <> b.idx group by 1) select round(avg(d), 6) as mean, count(*) as n from d")
def mean_nearest_distance(spark, sf_dir):
    """The mean distance to the nearest other point of the same part: parts stand far from each other along one axis."""
    p = view(spark, sf_dir, "points").withColumn("x", c("x") + c("part") * 1000)
    return S.knn(p, p, 1).agg(F.round(F.avg(F.sqrt("d2")), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query(f"""with t as (select s_suppkey, {uniform(7, "s_suppkey", "'angle'")} * 6.283185307179586 as angle, floor({uniform(7, "s_suppkey", "'axis'")} * 3)::int as k, 0.75 + {uniform(7, "s_suppkey", "'scale'")} * 0.5e0 as scaling from supplier)
select s_suppkey, 'xyz'[k + 1] as axis, round(angle, 6) as angle, round(scaling, 6) as scaling, round(case k when 0 then 1 else cos(angle) end, 6) as m00, round(case k when 0 then -sin(angle) else 0 end, 6) as m12,
    round(case k when 2 then sin(angle) else 0 end, 6) as m10 from t""")
def sampled_transforms(spark, sf_dir):
    t = table(spark, sf_dir, "supplier").select("s_suppkey", A.sampled_transform(7, c("s_suppkey")).alias("t"))
    cells = {"m00": 0, "m12": 5, "m10": 3}
    return rounded(t.select("s_suppkey", "t.axis", "t.angle", "t.scaling", *[(c("t.matrix")[k] + 0.0).alias(n) for n, k in cells.items()]))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' as at_utc from events")
def utc_texts(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.utc_text(c("ts")).alias("at_utc"))


@query("""select user_id, string_agg(distinct event_type, ',' order by event_type) as blockers from events where event_type <> 'view' group by 1""")
def blocker_lists(spark, sf_dir):
    blockers = F.array_sort(F.collect_set("event_type"))
    return table(spark, sf_dir, "events").where("event_type <> 'view'").groupBy("user_id").agg(F.array_join(blockers, ",").alias("blockers"))


@query("""select ptype, count(*) as n, round(avg(px), 6) as mean from {motion} where ptype is not null and px > 10 and pz < 6 group by 1""")
def column_store(spark, sf_dir):
    """Two batches of one table, filtered by one mask over all columns and put together again."""
    m = view(spark, sf_dir, "motion")
    keep = (c("px") > 10) & (c("pz") < 6) & c("ptype").isNotNull()
    batches = [m.where(c("id") % 2 == k).where(keep) for k in (0, 1)]
    return batches[0].unionByName(batches[1]).groupBy("ptype").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("px"), 6).alias("mean"))
