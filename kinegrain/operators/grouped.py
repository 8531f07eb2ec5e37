"""Order-dependent algorithms of one object, mask set or mesh, run group by group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .raster import CELL


def absorb(pixels: DataFrame, view: str, face: str, mask: str) -> DataFrame:
    """view, face, mask after masks that lost over half of their pixels were absorbed. Votes are counted before they meet in a group of one view."""
    votes = pixels.groupBy(view, face, mask).agg(F.count(F.lit(1)).alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table: dict[int, dict[int, int]] = {}
        for f, m, n in zip(pdf[face], pdf[mask], pdf["n"]):
            table.setdefault(f, {})[m] = n
        out = K.absorb_masks(table)
        return pd.DataFrame({view: pdf[view].iloc[0], face: list(out), mask: list(out.values())})

    return votes.groupBy(view).applyInPandas(run, f"{view} long, {face} long, {mask} long")


def merge_overlapping(items: DataFrame, entity: str, group: str, item: str, weight: str) -> DataFrame:
    """entity, merged, item: groups of an entity merged in order of their number."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = dict(zip(pdf[item], pdf[weight]))
        groups = [set(g[item]) for _, g in pdf.sort_values([group, item]).groupby(group)]
        rows = [(pdf[entity].iloc[0], k, i) for k, g in enumerate(K.merge_groups(groups, w.__getitem__)) for i in sorted(g)]
        return pd.DataFrame(rows, columns=[entity, "merged", item])

    return items.groupBy(entity).applyInPandas(run, f"{entity} long, merged int, {item} long")


def with_uncovered(groups: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """groups, and parts in none of them, each with a null group."""
    alone = parts.join(groups.select(*keys).distinct(), keys, "left_anti")
    return groups.unionByName(alone, allowMissingColumns=True)


def repair(points: DataFrame, group: str, k: int = 3) -> DataFrame:
    """group, a, b: edges of a least spanning tree over each group's nearest neighbours, bridged where they don't connect it. Groups are one mesh's faces;
    their distances are looked at by blocks and never held together."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        x, ids = pdf[["x", "y", "z"]].to_numpy(float), pdf["idx"].to_numpy()
        tree = K.spanning_tree(K.nearest_edges(x, k), len(x))
        tree += K.bridges(x, tree)
        rows = [(pdf[group].iloc[0], min(ids[a], ids[b]), max(ids[a], ids[b])) for a, b in tree]
        return pd.DataFrame(rows, columns=[group, "a", "b"])

    return K.dealt(points.select(group, "idx", "x", "y", "z"), group).groupBy(group).applyInPandas(run, f"{group} long, a long, b long")


def farthest(points: DataFrame, group: str, k: int) -> DataFrame:
    """group, idx, rank: points each farthest from those before, from the first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        at = K.farthest_points(pdf[["x", "y", "z"]].to_numpy(float), k)
        return pd.DataFrame({group: pdf[group].iloc[0], "idx": pdf["idx"].to_numpy()[at], "rank": range(len(at))})

    return points.groupBy(group).applyInPandas(run, f"{group} long, idx long, rank int")


def clean_masks(pixels: DataFrame, keys: list[str], height: int, width: int, least: int) -> DataFrame:
    """keys, area, changed: masks after holes were filled and islands dropped."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((height, width), bool)
        m[pdf["prow"], pdf["pcol"]] = True
        m, filled = K.remove_small(m, least, True)
        m, dropped = K.remove_small(m, least, False)
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in keys], int(m.sum()), filled or dropped]], columns=[*keys, "area", "changed"])

    kinds = dict(pixels.dtypes)
    # a pixel counts once however many rows it has, so a group is no larger than its raster
    once = pixels.select(*keys, "prow", "pcol").distinct()
    return once.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", area long, changed boolean")


def small_parts(parts: DataFrame, contacts: DataFrame, entity: str, least: float) -> DataFrame:
    """entity, part, into: parts under a size joined to the one they touch most."""

    @F.pandas_udf("part array<long>, into array<long>")
    def merged(parts: pd.Series, size: pd.Series, a: pd.Series, b: pd.Series, w: pd.Series) -> pd.DataFrame:
        rows = []
        for p, s, *ends in zip(parts, size, a, b, w):
            sizes = dict(zip(p.tolist(), s.tolist()))
            touching = [t for t in zip(*[x.tolist() for x in ends]) if t[0] in sizes and t[1] in sizes]
            out = K.merge_small_parts(sizes, touching, {p for p, s in sizes.items() if s < least})
            rows.append((list(out), list(out.values())))
        return pd.DataFrame(rows, columns=["part", "into"])

    # an entity's parts and contacts are lists of one row, and a batch has many entities: a group of pandas for each took most of the time
    nan = F.lit(float("nan"))
    own = parts.where("part is not null").select(F.col(entity).cast("long").alias(entity), F.col("part").cast("long").alias("part"), F.coalesce(F.col("size").cast("double"), nan).alias("size"))
    met = contacts.where("a is not null and b is not null").select(F.col(entity).cast("long").alias(entity), *[F.col(n).cast("long").alias(n) for n in "ab"], F.coalesce(F.col("w").cast("double"), F.lit(0.0)).alias("w"))
    rows = own.unionByName(met, allowMissingColumns=True)
    lists = K.dealt(rows, entity).groupBy(entity).agg(*[F.collect_list(n).alias(n) for n in ("part", "size", "a", "b", "w")])
    out = lists.where(F.size("part") > 0).select(entity, merged("part", "size", "a", "b", "w").alias("m"))
    return out.select(entity, F.inline(F.arrays_zip("m.part", "m.into")))


def coseg(points: DataFrame, group: str, source: int) -> DataFrame:
    """group, idx, cluster: k-means of each group from the source group's part means, a bounded table."""
    means = points.where(F.col(group) == source).groupBy("part").agg(*[F.avg(a).alias(a) for a in "xyz"]).orderBy("part").collect()
    init = np.array([[r[a] for a in "xyz"] for r in means])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        labels, _ = K.lloyd(pdf[["x", "y", "z"]].to_numpy(float), len(init), init)
        return pd.DataFrame({group: pdf[group], "idx": pdf["idx"], "cluster": labels.astype("int32")})

    return points.groupBy(group).applyInPandas(run, f"{group} long, idx long, cluster int")


def mask_nms(overlaps: DataFrame, masks: DataFrame, most: float, fallback: int = 3) -> DataFrame:
    """group, id of masks whose greatest IoU with any better one is at most ``most``; the best few where none stays. Better is by score, then id."""
    w = Window.partitionBy("grp").orderBy(F.desc("score"), "id")
    ranked = masks.withColumn("rank", F.row_number().over(w))
    a = ranked.select("grp", F.col("id").alias("a"), F.col("rank").alias("ra"))
    b = ranked.select("grp", F.col("id").alias("b"), F.col("rank").alias("rb"))
    both = overlaps.join(a, ["grp", "a"]).join(b, ["grp", "b"])
    worst = both.withColumn("id", F.when(F.col("ra") > F.col("rb"), F.col("a")).otherwise(F.col("b"))).groupBy("grp", "id").agg(F.max("iou").alias("iou"))
    kept = ranked.join(worst, ["grp", "id"], "left").withColumn("ok", F.coalesce(F.col("iou") <= most, F.lit(True)))
    any_ok = F.max(F.col("ok").cast("int")).over(Window.partitionBy("grp"))
    return kept.withColumn("_any", any_ok).where(F.col("ok") | ((F.col("_any") == 0) & (F.col("rank") <= fallback))).select("grp", "id")


def patch_padding(points: DataFrame, batch: str, order: str, size: int) -> DataFrame:
    """batch, place, order: each batch's rows and, up to a multiple of ``size``, the tail of the patch before the last again."""
    w = Window.partitionBy(batch)
    rows = points.select(batch, order, (F.row_number().over(w.orderBy(order)) - 1).alias("place"), F.count(F.lit(1)).over(w).alias("n"))
    full = F.ceil(F.col("n") / size) * size
    again = rows.where((F.col("n") > size) & (F.col("place") >= F.col("n") - size) & (F.col("place") < full - size)).withColumn("place", F.col("place") + size)
    return rows.unionByName(again).select(batch, "place", order)


def voxel_features(points: DataFrame, values: list[str]) -> DataFrame:
    return points.groupBy(*CELL).agg(*[F.avg(v).alias(v) for v in values], F.count(F.lit(1)).alias("n"))
