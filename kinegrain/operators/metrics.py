"""Evaluation metrics: null-aware means, structure scores and the four reports, each one aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import vec3 as V


def finite_mean(x: Column) -> Column:
    """Mean of the finite values; null without any."""
    return F.avg(N.finite(x))


def finite_count(x: Column) -> Column:
    return F.count(N.finite(x))


def ratio(hits: Column) -> Column:
    """Share of true among non-null."""
    return F.avg(hits.cast("double"))


def structure_scores(pred: Column, gold: Column) -> Column:
    """Counts, IoU, precision, recall, F1 and exactness of two member sets."""
    p, g = F.array_distinct(pred), F.array_distinct(gold)
    tp = F.size(F.array_intersect(p, g)).cast("double")
    fp, fn = F.size(F.array_except(p, g)).cast("double"), F.size(F.array_except(g, p)).cast("double")
    union = tp + fp + fn
    precision = F.when(tp + fp > 0, F.try_divide(tp, tp + fp)).otherwise(F.when(fn == 0, N.lit(1)).otherwise(N.lit(0)))
    recall = F.when(tp + fn > 0, F.try_divide(tp, tp + fn)).otherwise(F.when(fp == 0, N.lit(1)).otherwise(N.lit(0)))
    f1 = F.when(precision + recall > 0, F.try_divide(2 * precision * recall, precision + recall)).otherwise(N.lit(0))
    return F.struct(
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.when(union > 0, F.try_divide(tp, union)).otherwise(N.lit(1)).alias("iou"),
        precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), (fp + fn == 0).cast("double").alias("exact"),
    )


def structure_report(rows: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """Macro means over rows and micro scores over summed counts; rows with a null set count as missing."""
    s = rows.select(structure_scores(F.col(pred), F.col(gold)).alias("s"), (F.col(pred).isNull() | F.col(gold).isNull()).alias("missing"))
    s = s.select("missing", *[F.when(~F.col("missing"), F.col(f"s.{k}")).alias(k) for k in ("tp", "fp", "fn", "iou", "precision", "recall", "f1", "exact")])
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return s.agg(
        F.count(F.lit(1)).alias("records"), F.count_if("missing").alias("missing_pairs"), F.avg("iou").alias("macro_iou"), F.avg("f1").alias("macro_f1"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("exact").alias("exact_match"),
        F.try_divide(tp, tp + fp + fn).alias("micro_iou"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("micro_f1"),
    )


def in_order(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    """Three numbers in ascending order."""
    return F.least(a, b, c), F.greatest(F.least(a, b), F.least(F.greatest(a, b), c)), F.greatest(a, b, c)


def object_report(rows: DataFrame) -> DataFrame:
    """Scale, mass and category metrics of (p0..p2, g0..g2, pmass, gmass, pcat, gcat); scales count only where all six dimensions are positive."""
    p, g = [F.col(f"p{k}") for k in range(3)], [F.col(f"g{k}") for k in range(3)]
    positive = reduce(Column.__and__, [x > 0 for x in (*p, *g)])
    same = F.when(F.col("pcat").isNotNull() & F.col("gcat").isNotNull(), F.lower(F.trim("pcat")) == F.lower(F.trim("gcat")))
    # sorted once below the aggregation, not in each of its expressions
    low = rows.select(
        "pmass", "gmass", same.alias("same"),
        *[F.when(positive, x).alias(f"{n}{k}") for n, v in (("p", p), ("g", g)) for k, x in enumerate(in_order(*v))],
    )
    kinds = (("alde", N.positive_alde), ("mnre", N.positive_min_ratio), ("mae", N.absolute_error))
    scale = lambda f: (f(F.col("p0"), F.col("g0")) + f(F.col("p1"), F.col("g1")) + f(F.col("p2"), F.col("g2"))) / 3
    low = low.select("pmass", "gmass", "same", *[scale(f).alias(f"scale_{n}") for n, f in kinds])
    return low.agg(
        F.count(F.lit(1)).alias("records"), *[finite_mean(F.col(f"scale_{n}")).alias(f"scale_{n}") for n, _ in kinds],
        *[finite_mean(f(F.col("pmass"), F.col("gmass"))).alias(f"mass_{n}") for n, f in kinds],
        ratio(F.col("same")).alias("category_accuracy"), F.count("same").alias("category_count"),
    )


def part_report(rows: DataFrame) -> DataFrame:
    """Material, continuous and graspable metrics of part physics; ground truth columns start with g_."""
    alde = lambda c: finite_mean(N.positive_alde(F.col(c), F.col(f"g_{c}")))
    mae = lambda c: finite_mean(N.absolute_error(F.col(c).cast("double"), F.col(f"g_{c}").cast("double")))
    return rows.agg(
        F.count(F.lit(1)).alias("records"), ratio(F.col("material") == F.col("g_material")).alias("material_accuracy"),
        *[alde(c).alias(f"{c}_alde") for c in ("density", "young", "hardness")], *[mae(c).alias(f"{c}_mae") for c in ("friction", "affordance", "poisson")],
        ratio(F.col("graspable") == F.col("g_graspable")).alias("graspable_accuracy"), F.count(N.positive_alde(F.col("density"), F.col("g_density"))).alias("density_count"),
    )


def kinematic_report(rows: DataFrame) -> DataFrame:
    """Joint, axis, pivot and limit metrics of (ptype, gtype, pred_axis, gold_axis, pred_pivot, gold_pivot, plo, phi, glo, ghi).

    A missing prediction is a wrong joint; geometry counts only where the types agree,
    pivots only for hinges, limits by absolute endpoints.
    """
    right = F.coalesce(F.col("ptype") == F.col("gtype"), F.lit(False))
    counted = F.col("gtype").isNotNull()
    axis = F.when(right, V.axis_angle(F.col("pred_axis"), F.col("gold_axis")))
    pivot = F.when(right & (F.col("gtype") == "C"), V.point_to_line(F.col("pred_pivot"), F.col("gold_pivot"), F.col("gold_axis")))
    limit = F.when(right, N.interval_iou(N.canonical_interval(F.col("plo"), F.col("phi")), N.canonical_interval(F.col("glo"), F.col("ghi"))))
    return rows.where(counted).agg(
        F.count(F.lit(1)).alias("joint_total"), F.count_if(right).alias("joint_correct"), ratio(right).alias("joint_accuracy"),
        F.count_if(F.col("ptype").isNull()).alias("missing_prediction"), finite_mean(axis).alias("axis_error"), finite_count(axis).alias("axis_count"),
        ratio(axis < 10).alias("axis_accuracy_10"), finite_mean(pivot).alias("pivot_error"), finite_count(pivot).alias("pivot_count"), finite_mean(limit).alias("limit_miou"),
    )


def best_iou(pairs: DataFrame, shape: str, gold: str, pred: str, ignore: int = -1) -> DataFrame:
    """shape, miou in percent: mean over gold labels of the best IoU with any predicted label, from one row for each point."""
    cells = pairs.groupBy(shape, gold, pred).agg(F.count(F.lit(1)).alias("n"))
    golds = cells.groupBy(shape, gold).agg(F.sum("n").alias("ng"))
    preds = cells.groupBy(shape, pred).agg(F.sum("n").alias("np"))
    joined = cells.join(golds, [shape, gold]).join(preds, [shape, pred]).where(F.col(gold) != ignore)
    iou = joined.withColumn("iou", 100.0 * F.col("n") / (F.col("ng") + F.col("np") - F.col("n")))
    return iou.groupBy(shape, gold).agg(F.max("iou").alias("best")).groupBy(shape).agg(F.avg("best").alias("miou"))


def verdict(hinge: Column, no_contact: Column, bad_share: Column, overlap_p10: Column, thickness_p95: Column, angles: Column) -> Column:
    """Level of a simulated joint: -2 without angles, 0 if a hinge lost contact or its overlap, or the thickness grew over three times, else 1."""
    lost = hinge & (no_contact | ((bad_share > 0.1) & (overlap_p10 < 0.4)))
    return F.when(F.coalesce(angles, F.lit(0)) == 0, -2).when(lost | (thickness_p95 > 3), 0).otherwise(1)
