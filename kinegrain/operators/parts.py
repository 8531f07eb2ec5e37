"""Parts, motions and datasets: picks, unions, filters and measures over annotation rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import discard, stored
from .kernels import dealt


def union_datasets(named: dict[str, DataFrame], column: str = "dataset") -> DataFrame:
    """All datasets as one, with the name of each row's dataset; columns that one lacks are null there."""
    each = [df.withColumn(column, F.lit(name)) for name, df in named.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)


def merged_or_each(named: dict[str, DataFrame], apart: bool) -> DataFrame | dict[str, DataFrame]:
    """The datasets by name, to be evaluated one by one, or their union."""
    return dict(named) if apart else union_datasets(named)


def label_motion(motions: Column) -> Column:
    """The first kind of B and C that has an axis, from a map of kind to struct(axis, ...)."""
    return reduce(lambda rest, k: F.when(motions[k]["axis"].isNotNull(), F.lit(k)).otherwise(rest), ["C", "B"], F.lit(None).cast("string"))


def gold_motion(listed: Column, motions: Column) -> Column:
    """The first of the listed kinds, then of the map's keys, that is B or C and whose motion is there."""
    kinds = F.concat(F.coalesce(listed, F.array().cast("array<string>")), F.coalesce(F.map_keys(motions), F.array().cast("array<string>")))
    return F.get(F.filter(kinds, lambda k: k.isin("B", "C") & F.element_at(motions, k).isNotNull()), 0)


def invalid_part(extents: list[Column], area: Column) -> Column:
    """A part that is flat in a direction, or has no surface."""
    return (F.least(*extents) < 1e-6) | (area < 1e-10)


def touching_side(steps: Column) -> Column:
    """Against what a child's contact is judged: its parent, if few relaxations were needed, else all other parts."""
    return F.when(steps <= 3, "parent").otherwise("others")


def dense_list(rows: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """keys, items: values at their positions from 0 to the last, null where there is none; the last of several wins by value."""
    one = rows.groupBy(*keys, position).agg(F.max(value).alias("v"))
    found = one.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(position, "v"))).alias("m"), F.max(position).alias("last"))
    return found.select(*keys, F.transform(F.sequence(F.lit(0), F.col("last").cast("int")), lambda k: F.col("m")[k.cast("bigint")]).alias("items"))


def thickness(points: DataFrame, keys: list[str], normal: tuple[float, float, float], offset: float) -> DataFrame:
    """keys, thickness: extent of the points along a plane's normal."""
    along = sum((F.col(c) * n for c, n in zip("xyz", normal)), F.lit(offset))
    return points.groupBy(*keys).agg((F.max(along) - F.min(along)).alias("thickness"))


def sim_scale(simulated: list[Column], real: list[Column]) -> Column:
    """Greatest simulated extent over the greatest real dimension."""
    return F.try_divide(F.greatest(*simulated), F.greatest(*real))


def clipped(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def padded(values: Column, length: Column) -> Column:
    """An array filled up with NaN."""
    return F.concat(values, F.array_repeat(F.lit(float("nan")), F.greatest(F.lit(0), length.cast("int") - F.size(values))))


def centre_shift(points: DataFrame, objects: DataFrame, key: str) -> DataFrame:
    """points moved by their object's centre in x and y and its least z."""
    box = objects.groupBy(key).agg(*[((F.min(c) + F.max(c)) / 2).alias(f"c{c}") for c in "xy"], F.min("z").alias("cz"))
    return points.join(box, key).withColumns({c: F.col(c) - F.col(f"c{c}") for c in "xyz"}).drop("cx", "cy", "cz")


def voted_faces(covers: DataFrame, group: str, face: str, mask: str, least: int = 2) -> DataFrame:
    """group, face: faces that at least so many of the group's masks cover."""
    return covers.groupBy(group, face).agg(F.count_distinct(mask).alias("n")).where(F.col("n") >= least).select(group, face)


def itemset_iou(sets: DataFrame, a: str, b: str, areas: DataFrame) -> DataFrame:
    """sets with area_iou and containment of two part sets, from areas (part, area); a part without an area weighs nothing."""
    # stored, so that the rows' numbers are the same on both sides of the join
    both = stored(sets.withColumn("_id", F.monotonically_increasing_id()), "sets")
    every = both.select("_id", F.explode(F.array_union(a, b)).alias("part"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    w = every.join(areas, "part", "left").withColumn("area", F.coalesce("area", F.lit(0.0)))
    in_a, in_b = F.array_contains("_a", F.col("part")), F.array_contains("_b", F.col("part"))
    total = w.groupBy("_id").agg(
        F.sum("area").alias("u"), F.sum(F.when(in_a & in_b, F.col("area")).otherwise(0.0)).alias("i"),
        F.sum(F.when(in_a, F.col("area")).otherwise(0.0)).alias("wa"), F.sum(F.when(in_b, F.col("area")).otherwise(0.0)).alias("wb"),
    )
    iou = F.coalesce(F.try_divide("i", "u"), F.lit(0.0)).alias("area_iou")
    held = F.coalesce(F.try_divide(F.col("i"), F.least("wa", "wb")), F.lit(0.0)).alias("containment")
    return both.join(total, "_id", "left").select(*sets.columns, iou, held)


def whole_or_split(components: DataFrame, part: str, component: str, most: int = 5) -> DataFrame:
    """part, pieces, split: a part that falls into over ``most`` components is kept whole."""
    n = components.groupBy(part).agg(F.count_distinct(component).alias("pieces"))
    return n.withColumn("split", (F.col("pieces") > 1) & (F.col("pieces") <= most))


def names_in_cycles(needs: DataFrame) -> DataFrame:
    """name: what depends on itself, over however many steps, from (name, needs).

    Names that need nothing left, or that nothing left needs, are peeled off in rounds, so that only cycles, and what stands between them, are closed.
    """
    from .graph import closure

    core = stored(needs.select("name", "needs").where("name is not null and needs is not null").distinct(), "core")
    size = core.count()
    while size:
        inner = core.join(core.select(F.col("name").alias("needs")).distinct(), "needs", "left_semi").join(core.select(F.col("needs").alias("name")).distinct(), "name", "left_semi")
        inner = stored(inner.select("name", "needs"), "core")
        discard(core)
        core, before, size = inner, size, inner.count()
        if size == before:
            break
    return closure(core).where("name = needs").select("name").distinct()


def check_cycles(needs: DataFrame) -> None:
    """Raises if a stage needs itself."""
    found = [r["name"] for r in names_in_cycles(needs).orderBy("name").limit(10).collect()]
    if found:
        raise ValueError(f"stages need themselves: {', '.join(map(str, found))}")


def chosen_row(picks: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """picks with the vector of their colour among the candidates (keys, colour, x, y, z), the mean of all for ``average``, and whether it equals the pick's own to five places."""
    mean = candidates.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in "xyz"]).withColumn("colour", F.lit("average"))
    rows = candidates.select(*keys, "colour", "x", "y", "z").unionByName(mean.select(*keys, "colour", "x", "y", "z"))
    joined = picks.join(rows.select(*keys, "colour", *[F.col(c).alias(f"{c}_row") for c in "xyz"]), [*keys, "colour"], "left")
    same = reduce(Column.__and__, [F.round(c, 5) == F.round(f"{c}_row", 5) for c in "xyz"])
    return joined.withColumn("same", F.coalesce(same, F.lit(False)))


def report_lines(counts: DataFrame, key: str, names: list[str]) -> DataFrame:
    """key, report: ``name: value`` lines of a row's counts."""
    lines = [F.concat(F.lit(f"{n}: "), F.coalesce(F.col(n).cast("string"), F.lit("0"))) for n in names]
    return counts.select(key, F.concat_ws("\n", *lines).alias("report"))


def by_number(rows: DataFrame, key: str, ident: str) -> DataFrame:
    """rows with their place in the order of numeric ids within a key; ids that aren't numbers come last, by text."""
    order = Window.partitionBy(key).orderBy(F.expr(f"try_cast(`{ident}` as bigint)").asc_nulls_last(), ident)
    return rows.withColumn("place", F.row_number().over(order) - 1)


def assemble(groups: DataFrame, parts: DataFrame) -> DataFrame:
    """entity, fid, cls of parts' faces: classes 0, 1, ... of groups (entity, group, part) in order, then of the parts in no group.

    parts: (entity, part, fid). A face of several classes keeps the first.
    """
    # dealt before they are made distinct: a task's whole share of the input would be held by it else
    groups, parts = dealt(groups.select("entity", "part", "group"), "entity", "part"), dealt(parts.select("entity", "part", "fid"), "entity", "part")
    # a row for each class of an object
    kinds = groups.select("entity", F.lit(0).alias("_late"), F.col("group").alias("_at")).distinct()
    alone = parts.select("entity", "part").distinct().join(groups.select("entity", "part").distinct(), ["entity", "part"], "left_anti")
    kinds = kinds.unionByName(alone.select("entity", F.lit(1).alias("_late"), F.col("part").alias("_at")))
    kinds = kinds.withColumn("cls", F.row_number().over(Window.partitionBy("entity").orderBy("_late", "_at")) - 1)
    held = groups.select("entity", "part", F.lit(0).alias("_late"), F.col("group").alias("_at")).unionByName(alone.select("entity", "part", F.lit(1).alias("_late"), F.col("part").alias("_at")))
    at = held.join(kinds, ["entity", "_late", "_at"]).select("entity", "part", "cls")
    faces = dealt(at, "entity", "part").join(parts, ["entity", "part"]).select("entity", "fid", "cls")
    return dealt(faces, "entity", "fid").groupBy("entity", "fid").agg(F.min("cls").alias("cls"))


def best_match_loss(iou: DataFrame, keys: list[str]) -> DataFrame:
    """keys, loss, matches of iou (keys, mask, part, iou): 1 - the mean of each mask's best IoU, and the part that each mask takes; ties to the first."""
    best = iou.groupBy(*keys, "mask").agg(F.max_by(F.struct("part", "iou"), F.struct("iou", -F.col("part"))).alias("b"))
    pairs = F.array_sort(F.collect_list(F.struct("mask", F.col("b.part").alias("part"))))
    return best.groupBy(*keys).agg((1 - F.avg("b.iou")).alias("loss"), pairs.alias("matches"))
