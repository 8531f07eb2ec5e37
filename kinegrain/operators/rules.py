"""Validation rules of annotated physics: each gives an array of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import gpa_to_pa, hv_to_pa

# Ranges of the prior for each material (density kg/m3, Young's modulus Pa, Poisson's ratio, hardness Pa, friction).
PRIORS = [
    ("metal", 2700.0, 8900.0, 5e10, 2.5e11, 0.25, 0.35, 1e9, 1e10, 0.2, 0.8),
    ("plastic", 850.0, 1500.0, 5e8, 8e9, 0.30, 0.45, 5e7, 5e8, 0.2, 0.6),
    ("fabric", 300.0, 1500.0, 1e6, 1e9, 0.30, 0.49, 1e5, 1e7, 0.4, 1.2),
    ("leather", 600.0, 1000.0, 5e7, 5e8, 0.35, 0.49, 1e6, 5e7, 0.5, 1.0),
    ("foam", 20.0, 300.0, 1e5, 5e8, 0.20, 0.45, 1e4, 1e6, 0.4, 1.0),
    ("rubber", 900.0, 1400.0, 1e6, 1e7, 0.45, 0.49, 5e5, 5e7, 0.6, 1.5),
    ("glass", 2200.0, 2600.0, 5e10, 9e10, 0.20, 0.25, 5e9, 1e10, 0.3, 0.9),
    ("stone", 2200.0, 3000.0, 2e10, 7e10, 0.15, 0.30, 3e9, 1e10, 0.6, 1.2),
    ("ceramics", 2000.0, 6000.0, 1e11, 4e11, 0.20, 0.30, 1e10, 3e10, 0.4, 1.0),
    ("wood", 300.0, 900.0, 5e8, 2e10, 0.25, 0.40, 5e7, 5e8, 0.4, 0.9),
    ("concrete", 1800.0, 2600.0, 2e10, 4e10, 0.15, 0.25, 1e9, 5e9, 0.6, 1.0),
]
PRIOR_COLUMNS = "material string, " + ", ".join(f"{n}_{end} double" for n in ("density", "young", "poisson", "hardness", "friction") for end in ("lo", "hi"))
#: Materials whose hardness says nothing about their stiffness.
SOFT = ("rubber", "foam", "fabric", "leather", "other")


def priors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRIORS, PRIOR_COLUMNS)


def issues(*rules: tuple[str, Column]) -> Column:
    """Names of the rules that are broken; a rule is broken where its condition is false."""
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules]))


def value_ranges() -> Column:
    c = F.col
    return issues(
        ("friction", c("friction").between(0, 3)), ("young", (c("young") > 0) & (c("young") <= 1e12)),
        ("poisson", (c("poisson") > -1) & (c("poisson") < 0.5)), ("density", (c("density") > 0) & (c("density") <= 30000)),
    )


def prior_ranges() -> Column:
    """Issues of values against joined *_lo and *_hi; none where the material has no prior."""
    return issues(*[(n, F.coalesce(F.col(n).between(F.col(f"{n}_lo"), F.col(f"{n}_hi")), F.lit(True))) for n in ("density", "young", "poisson", "friction")])


def hardness_young() -> Column:
    ratio = F.try_divide(hv_to_pa(F.col("hardness")), F.col("young"))
    free = F.col("material").isin(*SOFT) | (F.col("young") <= 0) | (F.col("hardness") <= 0)
    return issues(("hardness_young", F.coalesce(free | ratio.between(1e-3, 1e-1), F.lit(True))))


def hardness_ratio(hardness: Column, young_gpa: Column) -> Column:
    return F.try_divide(hv_to_pa(hardness), gpa_to_pa(young_gpa))


def interaction_friction() -> Column:
    touched = (F.col("affordance") <= 2) | F.col("graspable")
    return issues(("interaction_friction", ~touched | (F.col("friction") >= 0.2)))


def check_parts(parts: DataFrame, prior: DataFrame) -> DataFrame:
    """parts with the issues of all four rules; the prior has a row for each material."""
    joined = parts.join(prior, "material", "left")
    return joined.withColumns(
        {"value_issues": value_ranges(), "prior_issues": prior_ranges(), "hardness_issues": hardness_young(), "friction_issues": interaction_friction()}
    ).drop(*[c for c in prior.columns if c != "material"])


def mass_consistency(parts: DataFrame, objects: DataFrame, key: str = "entity") -> DataFrame:
    """key, parts_mass, object_mass, rel_err, warning, non_positive, missing_volume: density times volume summed against the object's mass.

    Parts without a volume have no mass; they and parts of no positive mass are counted. An object
    without a mass has no rel_err and no warning; the least divisor is 1e-6.
    """
    mass = F.col("density") * F.col("volume")
    total = parts.groupBy(key).agg(
        F.coalesce(F.sum(mass), F.lit(0.0)).alias("parts_mass"), F.count_if(mass <= 0).alias("non_positive"), F.count_if(F.col("volume").isNull()).alias("missing_volume")
    )
    rel = F.abs(F.col("parts_mass") - F.col("object_mass")) / F.greatest(F.col("object_mass"), F.when(F.col("object_mass").isNotNull(), 1e-6))
    return total.join(objects, key).select(
        key, "parts_mass", "object_mass", rel.alias("rel_err"), F.coalesce(rel > 0.5, F.lit(False)).alias("warning"), "non_positive", "missing_volume"
    )


def slender(dx: Column, dy: Column, dz: Column, eps: float = 1e-6) -> Column:
    e = F.array_sort(F.array(dx, dy, dz))
    return (e[0] < eps) | ((F.try_divide(e[1], e[0]) > 100) & (F.try_divide(e[2], e[0]) > 100))


def small_part(area_ratio: Column, volume_ratio: Column, box: Column, area: Column, thin: Column, volume: Column) -> Column:
    odd = (box < 1e-6) | (area < 1e-6) | thin | (F.try_divide(box, volume) > 50) | ((volume < 1e-4) & (area < 5e-4))
    return (area_ratio <= 0.1) & (volume_ratio <= 0.1) & odd


def box_gap(a: list[tuple[Column, Column]], b: list[tuple[Column, Column]]) -> Column:
    """Distance of two boxes given as (min, max) for each axis."""
    gaps = [F.greatest(F.lit(0.0), lo2 - hi1, lo1 - hi2) for (lo1, hi1), (lo2, hi2) in zip(a, b)]
    return F.sqrt(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]))


#: Credential patterns of the repository scan, and what must not be in a release.
SECRETS = [
    ("key", r"\bsk-[A-Za-z0-9_-]{16,}\b"),
    ("assignment", r"(?i)(?:api[_-]?key|access[_-]?token)\s*[=:]\s*['\"][^'\"]{12,}['\"]"),
]
PLACEHOLDERS = ("your_api_key", "sk-xxx")
FORBIDDEN_NAMES = (".DS_Store", "__pycache__")
FORBIDDEN_PREFIXES = (".idea/", "outputs/", "exp_results/")
FORBIDDEN_SUFFIXES = (".ckpt", ".pth", ".pt", ".pyc", ".so")
MOST_BYTES = 50 * 1024 * 1024


def secret_hits(lines: DataFrame, key: str, text: str) -> DataFrame:
    """key, rule: a row for every rule that one of a row's text lines meets; lines with a placeholder are passed over."""
    each = lines.select(key, F.explode(F.split(text, "\\R")).alias("_line"))
    real = ~F.greatest(*[F.contains("_line", F.lit(x)) for x in PLACEHOLDERS])
    found = F.array_compact(F.array(*[F.when(F.col("_line").rlike(p), F.lit(n)) for n, p in SECRETS]))
    return each.where(real).select(key, F.explode(found).alias("rule")).distinct()


def release_issues(path: Column, size: Column) -> Column:
    """What speaks against a file's release: a forbidden name or suffix, a forbidden folder, or over MOST_BYTES bytes."""
    name = F.element_at(F.split(path, "/"), -1)
    suffix = F.regexp_extract(name, r".(\.[^.]*)$", 1)
    return issues(
        ("path", ~(name.isin(*FORBIDDEN_NAMES) | F.lower(suffix).isin(*FORBIDDEN_SUFFIXES))),
        ("prefix", ~F.greatest(*[path.startswith(p) for p in FORBIDDEN_PREFIXES])), ("size", size <= MOST_BYTES),
    )


def missing_files(files: DataFrame, path: str, required: DataFrame) -> DataFrame:
    """path of required files that are not there."""
    return required.join(files.select(path), path, "left_anti")
