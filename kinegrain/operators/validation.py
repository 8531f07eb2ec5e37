"""Validation of whole objects: annotation texts to SI units, real volumes, all rules, and an error for each object that can't be read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import gpa_to_pa, hv_to_pa
from ..functions.text import dimension_text, first_number
from .rules import check_parts, mass_consistency, priors

# Names in an object's annotation.
ANNOTATION = """dimension string, mass string, parts array<struct<label bigint, name string, material string, density string, `Young's Modulus (GPa)` double,
    `Poisson's Ratio` double, friction_coefficient double, `Hardness (HV)` double, priority_rank int, graspable boolean>>"""
RULES = ("value_issues", "prior_issues", "hardness_issues", "friction_issues")


def validate_objects(annotations: DataFrame, extents: DataFrame, volumes: DataFrame) -> DataFrame:
    """entity, issues (of label and rule), rel_err, warning, error: one row for each annotation.

    annotations: (entity, text); extents: (entity, dx, dy, dz) of simulated objects; volumes: (entity, label, volume) of
    simulated parts, as volume.voxel_volumes() makes them, with why a part has none as volume_error, if that is a column. A part's real volume is its simulated one times the real box (in cm) over the simulated box. An object
    whose text, dimensions, mass or extents can't be read has an error and nothing else; a part without a volume has no mass; an object without parts has null issues.
    """
    a = annotations.select("entity", F.from_json("text", ANNOTATION).alias("a")).join(extents, "entity", "left")
    d = dimension_text(F.col("a.dimension"))
    real, simulated = d[0] * d[1] * d[2], F.col("dx") * F.col("dy") * F.col("dz")
    a = a.withColumns({"mass": first_number(F.col("a.mass")), "scale": F.when(F.size(d) == 3, F.try_divide(real, simulated))})
    error = (
        F.when(F.col("a.parts").isNull(), "no parts").when(F.size(d) != 3, "dimension").when(real.isNull(), "dimension").when(F.col("mass").isNull(), "mass")
        .when(F.col("scale").isNull(), "extents")
    )
    if "volume_error" in volumes.columns:
        unmeasured = volumes.where("volume_error is not null").groupBy("entity").agg(F.concat(F.lit("volume: "), F.min("volume_error")).alias("unmeasured"))
        a, error = a.join(unmeasured, "entity", "left"), F.coalesce(error, F.col("unmeasured"))
        volumes = volumes.drop("volume_error")
    a = a.withColumn("error", error)
    good = a.where("error is null").select("entity", "mass", "scale", F.explode("a.parts").alias("p"))
    p = F.col("p")
    parts = good.select(
        "entity", "scale", p["label"].alias("label"), F.split(p["material"], "/")[0].alias("material"), (first_number(p["density"]) * 1000).alias("density"),
        gpa_to_pa(p["Young's Modulus (GPa)"]).alias("young"), p["Poisson's Ratio"].alias("poisson"), p["friction_coefficient"].alias("friction"),
        p["Hardness (HV)"].alias("hardness"), p["priority_rank"].alias("affordance"), p["graspable"].alias("graspable"),
    )
    parts = parts.join(volumes, ["entity", "label"], "left").withColumn("volume", F.col("volume") * F.col("scale") * 1e-6)
    mass = mass_consistency(parts, a.select("entity", F.col("mass").alias("object_mass"))).select("entity", "rel_err", "warning")
    checked = check_parts(parts, priors(annotations.sparkSession))
    found = F.flatten(F.array(*[F.transform(F.col(n), lambda r: F.struct(F.col("label"), r.alias("rule"))) for n in RULES]))
    issues = checked.select("entity", found.alias("i")).groupBy("entity").agg(F.array_sort(F.flatten(F.collect_list("i"))).alias("issues"))
    return a.select("entity", "error").join(issues, "entity", "left").join(mass, "entity", "left").select("entity", "issues", "rel_err", "warning", "error")
