"""Queries of joins, windows, sampling, augmentation and kernels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import augment as A
from ..operators import kernels as K
from ..operators import sampling as L
from ..operators import spatial as S
from .q_eval import rounded
from .registry import TRANSFORMS, query
from .views import table, view

c = F.col
D2 = "power(a.x-b.x,2)+power(a.y-b.y,2)+power(a.z-b.z,2)"


def points(spark, sf_dir):
    return view(spark, sf_dir, "points")


def uniform(seed: int, *keys: str) -> str:
    """SQL of numeric.hash_uniform."""
    text = ", ".join(f"{k}::varchar" for k in keys)
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', {text})), 1, 13))::bigint::double / 4503599627370496)"


@query(f"with p as (select * from {{points}}) select a.idx as a, b.idx as b, round({D2}, 6) as d2 from p a join p b on a.idx < b.idx and {D2} <= 0.01e0")
def radius_self_join(spark, sf_dir):
    return rounded(S.radius_pairs(points(spark, sf_dir), 0.1))


@query(f"""with p as (select * from {{points}}), r as (select a.idx as query, b.idx, row_number() over (partition by a.idx order by {D2}, b.idx) as rank, {D2} as d2 from p a join p b on a.idx <> b.idx where a.idx % 50 = 0)
select query, idx, rank::int as rank, round(d2, 6) as d2 from r where rank <= 3""")
def knn_join(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(S.knn(p.where("idx % 50 = 0"), p, 3))


@query(f"""with p as (select * from {{points}}), q as (select part as idx, avg(x) as x, avg(y) as y, avg(z) as z from p group by 1)
select a.idx as query, arg_min(b.idx, {D2}) as idx from p a, q b group by 1""")
def nn_relabel(spark, sf_dir):
    p = points(spark, sf_dir)
    few = p.groupBy(c("part").alias("idx")).agg(*[F.avg(a).alias(a) for a in "xyz"])
    return S.nearest(p, few).select("query", "idx")


@query(f"""with p as (select * from {{points}}), a as (select part as idx, avg(x) as x, avg(y) as y, avg(z) as z from p group by 1), b as (select part as idx, avg(nx) as x, avg(ny) as y, avg(nz) as z from p group by 1),
    ab as (select a.idx as a, arg_min(b.idx, {D2}) as b from a, b group by 1), ba as (select b.idx as b, arg_min(a.idx, {D2}) as a from a, b group by 1)
select a, b from ab join ba using (a, b)""")
def mutual_nearest(spark, sf_dir):
    p = points(spark, sf_dir)
    left = p.groupBy(c("part").alias("idx")).agg(*[F.avg(a).alias(a) for a in "xyz"])
    right = p.groupBy(c("part").alias("idx")).agg(*[F.avg(f"n{a}").alias(a) for a in "xyz"])
    return S.mutual_nearest(left, right)


@query(f"""with p as (select * from {{points}}), n as (select distinct a.idx from p a join p b on a.part <> 0 and b.part = 0 and {D2} <= 0.04e0)
select part, round(avg((n.idx is not null)::int), 6) as share from p left join n using (idx) where part <> 0 group by 1""")
def contact_overlap(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(S.contact_overlap(p.where("part <> 0"), p.where("part = 0"), 0.2))


@query("""with o as (select part, row_number() over (partition by part order by abs(x)) as k, abs(x) as d from {points})
select part, least(100, greatest(0, floor((d - 0.01e0) / 0.01e0) + 1))::int as steps from o where k = 7""")
def threshold_relaxation(spark, sf_dir):
    o = points(spark, sf_dir).select("part", F.abs("x").alias("d"), F.row_number().over(Window.partitionBy("part").orderBy(F.abs("x"))).alias("k"))
    return o.where("k = 7").select("part", S.relax_steps(c("d"), 0.01).alias("steps"))


# clicks are the conditioning frames, and every frame asks for its nearest
@query("""with f as (select object, frame from {frames} where event_type = 'click'), t as (select object, frame as target from {frames}),
    j as (select t.object, target, frame, case when frame < target then 0 else 1 end as side, abs(frame - target) as gap from t join f on t.object = f.object),
    r as (select *, row_number() over (partition by object, target, side order by gap) as f1 from j), k as (select *, row_number() over (partition by object, target order by case when f1 = 1 then side else 2 end, gap, frame) as rank from r)
select object, target, frame, rank::int as rank from k where rank <= 3""")
def closest_frames(spark, sf_dir):
    f = view(spark, sf_dir, "frames")
    return S.closest_frames(f.where("event_type = 'click'"), f.select("object", c("frame").alias("target")), 3)


@query("""with f as (select object, frame from {frames}), w as (select object, frame, unnest(range(1, 7))::int as slot from f),
    s as (select *, case when slot = 1 then frame - 1 else floor((frame - 2) / 3.0)::bigint * 3 - (slot - 2) * 3 end as source from w)
select object, frame, slot, source from s where exists (select 1 from f where f.object = s.object and f.frame = s.source)""")
def memory_offsets(spark, sf_dir):
    return S.memory_frames(view(spark, sf_dir, "frames"), 6, 3)


@query("select object, frame, round(abs(value - first_value(value) over (partition by object order by frame)), 6) as drift, round(value - lag(value) over (partition by object order by frame), 6) as step from {frames}")
def trajectory_deviation(spark, sf_dir):
    w = Window.partitionBy("object").orderBy("frame")
    return rounded(view(spark, sf_dir, "frames").select("object", "frame", F.abs(c("value") - F.first("value").over(w)).alias("drift"), (c("value") - F.lag("value").over(w)).alias("step")))


@query("select object, arg_min(frame, value * 1000000 + frame) as best, round(min(value), 6) as loss from {frames} group by 1")
def best_so_far(spark, sf_dir):
    f = view(spark, sf_dir, "frames")
    return rounded(f.groupBy("object").agg(F.min_by("frame", F.struct("value", "frame")).alias("best"), F.min("value").alias("loss")))


@query("select part, count(*) as n, coalesce(sum(count(*)) over (order by part rows between unbounded preceding and 1 preceding), 0)::bigint as first from {points} group by 1")
def batch_offsets(spark, sf_dir):
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    g = points(spark, sf_dir).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("first", F.coalesce(F.sum("n").over(w), F.lit(0)))


@query("select face, min(mask) filter (seq = lo) as first_mask, max(mask) filter (seq = hi) as last_mask from (select *, min(seq) over (partition by face) as lo, max(seq) over (partition by face) as hi from {pixels}) group by 1")
def first_and_last_wins(spark, sf_dir):
    p = view(spark, sf_dir, "pixels")
    return p.groupBy("face").agg(F.min_by("mask", F.struct("seq", "mask")).alias("first_mask"), F.max_by("mask", F.struct("seq", "mask")).alias("last_mask"))


@query("select idx, row_number() over (order by idx) - 1 as place from {points} qualify place between 10 and 49")
def batch_slice(spark, sf_dir):
    p = L.slice_rows(points(spark, sf_dir).select("idx"), ["idx"], 10, 50)
    return p.withColumn("place", F.row_number().over(Window.orderBy("idx")) + 9)


@query("select idx, round(power(x-0.1e0,2)+power(y-0.1e0,2)+power(z-0.1e0,2), 6) as d2 from {points} order by power(x-0.1e0,2)+power(y-0.1e0,2)+power(z-0.1e0,2), idx limit 64")
def sphere_crop(spark, sf_dir):
    return rounded(L.nearest_crop(points(spark, sf_dir), (0.1, 0.1, 0.1), 64).select("idx", "d2"))


@query("select entity, part, greatest(10000, floor(price / sum(price) over (partition by entity) * 100000))::bigint as points from {annotations}")
def area_sample_size(spark, sf_dir):
    return L.area_sample_size(view(spark, sf_dir, "annotations"), "entity", "price").select("entity", "part", "points")


@query("select object, frame, frame // 8 as batch from {frames}")
def fixed_batches(spark, sf_dir):
    return L.batches(view(spark, sf_dir, "frames"), ["object"], "frame", 8).select("object", "frame", "batch")


@query("select 0::int as layer, 0 as x0, 0 as y0, 800 as x1, 800 as y1 union all select 1, x, y, least(x + 500, 800), least(y + 500, 800) from (values (0, 0), (300, 0), (0, 300), (300, 300)) t(x, y)")
def crop_boxes(spark, sf_dir):
    return L.crop_boxes(spark, 1, 800, 800, 0.25)


@query(f"""with t as (select sum(p_retailprice) as total from part),
    a as (select p_partkey as fid, sum(p_retailprice) over (order by p_partkey rows unbounded preceding) as hi, p_retailprice as area from part),
    d as (select range as sample, {uniform(42, 'range', '0')} * (select total from t) as pos, sqrt({uniform(42, 'range', '1')}) as r1, {uniform(42, 'range', '2')} as r2 from range(5000))
    select sample, fid, round(1 - r1, 6) as u, round(r1 * (1 - r2), 6) as v, round(r1 * r2, 6) as w from d join a on pos >= hi - area and pos < hi""")
def surface_sampling(spark, sf_dir):
    areas = table(spark, sf_dir, "part").select(c("p_partkey").alias("fid"), c("p_retailprice").alias("area"))
    return rounded(L.surface_sample(areas, 5000))


@query(f"""select doc_id, case when {uniform(42, 'doc_id')} < 0.1 then 'val' else 'train' end as split from documents""")
def train_val_split(spark, sf_dir):
    from ..operators.datasets import split_by_hash

    return split_by_hash(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.1)


@query(f"""with n as (select count(*) as n from customer), m as (select range as id from range((select n // 2 from n))),
    r as (select c_custkey, row_number() over (order by c_custkey) - 1 as place from customer)
    select c_custkey from customer union all
    select c_custkey from (select floor({uniform(43, 'id')} * (select n from n))::bigint as place from m) join r using (place)""")
def dataset_resample(spark, sf_dir):
    d = table(spark, sf_dir, "customer").select("c_custkey")
    n = d.count()
    return L.resample(d, "c_custkey", n + n // 2, n)


@query()
def augment_compose(spark, sf_dir):
    run = TRANSFORMS.compose([{"type": "jitter"}, {"type": "rotate"}, {"type": "scale"}, {"type": "flip"}, {"type": "shift"}, {"type": "grayscale"}, {"type": "drop_colour"}])
    return run(points(spark, sf_dir))


@query()
def augment_views(spark, sf_dir):
    return A.views(points(spark, sf_dir), 2, [{"type": "jitter", "seed": 11}, {"type": "dropout", "ratio": 0.3}])


@query("select idx, floor(0.5e0 * r + 0.5e0 * coalesce((r - lo) * 255e0 / nullif(hi - lo, 0), r))::bigint as r from (select *, min(r) over (partition by part) as lo, max(r) over (partition by part) as hi from {points})")
def augment_contrast(spark, sf_dir):
    return A.auto_contrast(points(spark, sf_dir)).select("idx", "r")


@query("select part, row_number() over (order by part) - 1 as instance, count(*) as n, round(avg(x), 6) as cx, round(max(z) - min(z), 6) as sz from {points} where part not in (3, 4) group by 1")
def instance_parser(spark, sf_dir):
    return rounded(A.instances(points(spark, sf_dir), "part", [3, 4]).select("part", "instance", "n", "cx", "sz"))


@query("""with v as (select a.vec_id as a, b.vec_id as b, a.embedding as x, b.embedding as y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)
select a, b, round((1 - list_cosine_similarity(x::double[], y::double[])) / 2, 6) as distance from v""")
def cosine_distance(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    x = e.select(c("vec_id").alias("a"), c("embedding").alias("x"), (c("vec_id") + 1).alias("b"))
    y = e.select(c("vec_id").alias("b"), c("embedding").alias("y"))
    return x.join(y, "b").select("a", "b", F.round(N.cosine_distance(c("x"), c("y")), 6).alias("distance"))


@query("select vec_id, round(embedding[1]::double / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as first, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as norm from embeddings")
def l2_normalise(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(N.l2_normalise(c("embedding"))[0], 6).alias("first"), F.round(N.norm(c("embedding")), 6).alias("norm"))


@query("select label, i - 1 as dim, round(avg(embedding[i]::double), 6) as mean from embeddings, (select unnest(range(1, 65)) as i) group by 1, 2")
def cluster_feature_mean(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v"))
    return rounded(x.groupBy("label", c("dim").cast("long").alias("dim")).agg(F.avg(c("v").cast("double")).alias("mean")))


@query()
def pca_rgb(spark, sf_dir):
    """Three principal components of the embeddings, scaled to 0..255."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(c("embedding").cast("array<double>")).alias("f"))
    p = PCA(k=3, inputCol="f", outputCol="p").fit(e).transform(e).select("vec_id", vector_to_array("p").alias("p"))
    ends = p.select(F.array_min("p").alias("a"), F.array_max("p").alias("b")).agg(F.min("a").alias("lo"), F.max("b").alias("hi"))
    p = p.crossJoin(F.broadcast(ends))
    return p.select("vec_id", *[F.floor((c("p")[k] - c("lo")) / (c("hi") - c("lo")) * 255).cast("int").alias(n) for k, n in enumerate("rgb")])


@query()
def kmeans(spark, sf_dir):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(c("embedding").cast("array<double>")).alias("f"))
    return KMeans(k=10, seed=42, featuresCol="f", predictionCol="cluster").fit(e).transform(e).select("vec_id", "cluster")


@query()
def supervised_cosegmentation(spark, sf_dir):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    e = table(spark, sf_dir, "embeddings").select("vec_id", c("label").cast("double").alias("label"), array_to_vector(c("embedding").cast("array<double>")).alias("features"))
    return LogisticRegression(maxIter=20).fit(e.where("vec_id % 2 = 0")).transform(e).select("vec_id", "label", "prediction")


@query()
def hungarian_match(spark, sf_dir):
    p = view(spark, sf_dir, "pixels")
    rows = p.groupBy("view", c("mask").alias("a"), (c("face") % 10).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    size = p.groupBy("view", c("mask").alias("a")).agg(F.count(F.lit(1)).alias("na"))
    return K.match(rows.join(size, ["view", "a"]).select("view", "a", "b", (1 - c("n") / c("na")).alias("cost")), "view")


@query()
def box_nms(spark, sf_dir):
    return K.box_nms(view(spark, sf_dir, "boxes"), "grp", 0.5)


@query()
def pivot_kmeans(spark, sf_dir):
    return K.cluster_points(points(spark, sf_dir), "part", 5)


@query()
def ward_clusters(spark, sf_dir):
    return K.ward_clusters(points(spark, sf_dir), "part", 4)


@query()
def least_squares_plane(spark, sf_dir):
    return K.fit_planes(points(spark, sf_dir), "part")


@query()
def ransac_plane(spark, sf_dir):
    return K.fit_planes(points(spark, sf_dir), "part", 0.05)


@query()
def mask_components(spark, sf_dir):
    return K.mask_components(view(spark, sf_dir, "pixels"), ["view", "mask"], 64, 64)
