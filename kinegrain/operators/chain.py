"""Refined parts merged under masks: counts observed in the passes that make the rows choose each object's way of merging.

An object of more than ``limit`` refined parts is merged by containment: each part goes to the first mask that holds enough of
its faces. Other objects are merged by item sets: masks are baskets of the parts that they hold, and a part goes to the best of the
maximal frequent sets it is in (by support, then size, then items). Parts in no group stay alone. A way that no object
takes is not planned at all, which the observed counts tell without a pass of their own. Objects that still have more than ``limit``
parts are errors of the record and have no faces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.store import stored
from .graph import itemsets, maximal
from .parts import assemble


def observed(rows: DataFrame, name: str, metrics: dict[str, dict], **what: Column) -> DataFrame:
    """rows, stored, with aggregates of them taken by the same pass and put into metrics under the name."""
    seen = Observation(name)
    out = stored(rows.observe(seen, *[x.alias(n) for n, x in what.items()]), name)
    metrics[name] = seen.get
    return out


def held_parts(parts: DataFrame, masks: DataFrame, share: float = 0.5) -> DataFrame:
    """entity, mask, part: parts (entity, part, fid) at least that share of whose faces is in the mask (entity, mask, fid)."""
    faces = parts.select("entity", "part", "fid").distinct()
    size = faces.groupBy("entity", "part").agg(F.count(F.lit(1)).alias("n"))
    inside = faces.join(masks.select("entity", "mask", "fid").distinct(), ["entity", "fid"]).groupBy("entity", "part", "mask").agg(F.count(F.lit(1)).alias("k"))
    return inside.join(size, ["entity", "part"]).where(F.col("k") >= share * F.col("n")).select("entity", "mask", "part")


def by_containment(held: DataFrame) -> DataFrame:
    """entity, group, part: each part with the first mask that holds it."""
    return held.groupBy("entity", "part").agg(F.min("mask").cast("long").alias("group")).select("entity", "group", "part")


def by_itemsets(held: DataFrame, min_support: int = 3) -> DataFrame:
    """entity, group, part: each part with the best maximal set of parts that ``min_support`` masks hold together; groups are numbered by their best part."""
    sets = maximal(itemsets(held.select(F.struct("entity", "mask").alias("basket"), F.struct("entity", "part").alias("item")), min_support))
    each = sets.select("items", "n", F.explode("items").alias("i"))
    best = each.groupBy(F.col("i.entity").alias("entity"), F.col("i.part").alias("part")).agg(F.min_by("items", F.struct(-F.col("n"), -F.size("items"), "items")).alias("items"))
    first = best.groupBy("entity", "items").agg(F.min("part").cast("long").alias("group"))
    return best.join(first, ["entity", "items"]).select("entity", "group", "part")


def refine_and_merge(parts: DataFrame, masks: DataFrame, limit: int = 100, min_support: int = 3, share: float = 0.5) -> tuple[DataFrame, DataFrame, dict[str, dict]]:
    """(faces: entity, fid, cls; record: entity, masks, refined_parts, merged_parts, strategy, error; metrics of each pass)."""
    metrics: dict[str, dict] = {}
    sizes = parts.groupBy("entity").agg(F.count_distinct("part").alias("refined_parts"))
    large = F.col("refined_parts") > limit
    sizes = observed(sizes, "refined", metrics, objects=F.count(F.lit(1)), large=F.count_if(large), most=F.max("refined_parts"))
    held = held_parts(parts, masks, share).join(sizes.select("entity", large.alias("large")), "entity")
    held = observed(held, "held", metrics, links=F.count(F.lit(1)), links_large=F.count_if("large"))
    ways = []
    if metrics["held"]["links_large"]:
        ways.append(by_containment(held.where("large").drop("large")))
    if metrics["held"]["links"] > metrics["held"]["links_large"]:
        ways.append(by_itemsets(held.where("not large").drop("large"), min_support))
    groups = ways[0] if ways else held.select("entity", F.col("mask").cast("long").alias("group"), "part").limit(0)
    for w in ways[1:]:
        groups = groups.unionByName(w)
    faces = observed(assemble(stored(groups, "groups"), parts), "merged", metrics, faces=F.count(F.lit(1)))
    merged = faces.groupBy("entity").agg(F.count_distinct("cls").alias("merged_parts"))
    known = masks.groupBy("entity").agg(F.count_distinct("mask").alias("masks"))
    record = sizes.join(known, "entity", "left").join(merged, "entity", "left")
    many = F.col("merged_parts") > limit
    error = F.when(many, F.concat(F.lit("too many merged parts: "), F.col("merged_parts").cast("string")))
    record = stored(record.select("entity", F.coalesce("masks", F.lit(0)).alias("masks"), "refined_parts", "merged_parts", F.when(large, "containment").otherwise("item sets").alias("strategy"), error.alias("error")), "record")
    return faces.join(record.where("error is null").select("entity"), "entity", "left_semi"), record, metrics
