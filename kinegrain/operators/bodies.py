"""Body trees of jointed objects and their simulation models in XML.

A body's place in its object is its path: the numbers of its parents from the root down, and
its own. Paths are found by pointers to ancestors that double, so a chain of n bodies costs
log n rounds. A model's lines then are ordered by path alone: a body's closing line sorts
behind all paths that begin with its own, so no nesting is assembled level by level.

Defined cases: a body whose parent isn't there has the error ``no parent``, one in a cycle ``cycle``, and bodies below such
ones the same as these; of rows with one entity and part the first by parent counts; a body without kind is fixed to its
parent; null pivots are at the origin; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import discard, stored
from .kernels import dealt

# Fixed values of a model: joint types by kind of motion, and the world's numbers.
JOINTS = {"B": "slide", "C": "hinge"}
WORLD = {"timestep": "0.002", "gravity": "0 0 -9.81"}
MASSES = {"base": "3", "moving": "5", "fixed": "2"}

PIVOT = ["px", "py", "pz"]


def _number(part: Column) -> Column:
    return F.lpad(part.cast("string"), 10, "0")


def body_paths(parts: DataFrame) -> DataFrame:
    """entity, part, path, level, error of parts (entity, part, parent): path is null where there is an error."""
    one = parts.groupBy("entity", "part").agg(F.min("parent").alias("parent"))
    known = one.select("entity", F.col("part").alias("parent"), F.lit(True).alias("there"))
    start = one.join(known, ["entity", "parent"], "left").select(
        "entity", "part", F.when(F.col("there"), F.col("parent")).alias("to"), _number(F.col("part")).alias("path"),
        F.when(F.col("parent").isNotNull() & F.col("there").isNull(), "no parent").alias("error"),
    )
    jumps = stored(start, "bodies")
    most = jumps.groupBy("entity").count().agg(F.max("count")).first()[0] or 0
    for _ in range(most.bit_length() + 1):
        if jumps.where("to is not null").isEmpty():
            break
        above = jumps.select("entity", F.col("part").alias("to"), F.col("to").alias("to2"), F.col("path").alias("path2"), F.col("error").alias("error2"))
        far = jumps.where("to is not null").join(above, ["entity", "to"]).select(
            "entity", "part", F.col("to2").alias("to"), F.concat_ws("/", "path2", "path").alias("path"), F.col("error2").alias("error")
        )
        grown = stored(jumps.where("to is null").unionByName(far), "bodies")
        discard(jumps)
        jumps = grown
    error = F.coalesce("error", F.when(F.col("to").isNotNull(), "cycle"))
    out = jumps.select("entity", "part", F.when(error.isNull(), F.col("path")).alias("path"), error.alias("error"))
    return out.select("entity", "part", "path", (F.size(F.split("path", "/")) - 1).alias("level"), "error")


def body_tree(parts: DataFrame) -> DataFrame:
    """parts (entity, part, parent, kind, px..pz, ...) with path, level, and x, y, z: the pivot relative to the parent's. Bodies with errors are left out."""
    # dealt before equal bodies are told apart: a task's whole share of the input would be held by it else
    parts = dealt(parts, "entity", "part")
    paths = body_paths(parts).where("error is null").select("entity", "part", "path", "level")
    first = parts.groupBy("entity", "part").agg(F.min_by(F.struct(*[F.col(n) for n in parts.columns if n not in ("entity", "part")]), F.struct("parent", *PIVOT)).alias("s")).select("entity", "part", "s.*")
    at = [F.coalesce(n, F.lit(0.0)).alias(n) for n in PIVOT]
    placed = first.select(*[n for n in first.columns if n not in PIVOT], *at)
    above = placed.select("entity", F.col("part").alias("parent"), *[F.col(n).alias(f"_{n}") for n in PIVOT])
    near = [(F.col(n) - F.coalesce(f"_{n}", F.lit(0.0))).alias(a) for n, a in zip(PIVOT, "xyz")]
    return placed.join(paths, ["entity", "part"]).join(above, ["entity", "parent"], "left").select(*placed.columns, "path", "level", *near)


def motion_roles(tree: DataFrame) -> DataFrame:
    """entity, motion, part, role: for each moving body (motion) every body of its object as ``motion``, ``child`` (moved with it) or ``base`` (the rest)."""
    moving = tree.where(F.col("kind").isin(*JOINTS)).select("entity", F.col("part").alias("motion"), F.col("path").alias("own"))
    below = F.col("path").startswith(F.concat(F.col("own"), F.lit("/")))
    role = F.when(F.col("part") == F.col("motion"), "motion").when(below, "child").otherwise("base")
    return moving.join(tree.select("entity", "part", "path"), "entity").select("entity", "motion", "part", role.alias("role"))


def _triple(*values: Column) -> Column:
    # adding 0 makes a negative zero a plain one
    return F.format_string("%.6f %.6f %.6f", *[v + 0.0 for v in values])


def model_lines(tree: DataFrame) -> DataFrame:
    """entity, at, line: the lines of each object's model; in the order of ``at`` they are its XML.

    tree: body_tree() of parts with kind, px..pz, ax..az (axis), lo, hi, damping. A body's frame has its pivot as origin, relative to the
    parent's; its mesh, given in the object's frame, is moved back by the pivot.
    """
    name = F.col("part").cast("string")
    pad = F.expr("repeat('  ', level + 2)")
    joint = F.create_map(*[F.lit(x) for kv in JOINTS.items() for x in kv])[F.col("kind")]
    mass = F.when(F.col("level") == 0, MASSES["base"]).when(joint.isNotNull(), MASSES["moving"]).otherwise(MASSES["fixed"])
    inside = F.concat(pad, F.lit("  "))
    body = F.concat(
        pad, F.lit('<body name="part_'), name, F.lit('" pos="'), _triple(F.col("x"), F.col("y"), F.col("z")), F.lit('">\n'),
        inside, F.lit('<inertial pos="0 0 0" mass="'), mass, F.lit('" diaginertia="0.2 0.2 0.2"/>\n'),
        inside, F.lit('<geom type="mesh" mesh="mesh_'), name, F.lit('" pos="'), _triple(*[-F.col(n) for n in PIVOT]), F.lit('"/>\n'),
    )
    moved = F.concat(
        inside, F.lit('<joint name="joint_'), name, F.lit('" type="'), joint, F.lit('" axis="'), _triple(F.col("ax"), F.col("ay"), F.col("az")),
        F.lit('" range="'), F.format_string("%.6f %.6f", F.col("lo"), F.col("hi")), F.lit('" damping="'), F.format_string("%.6f", F.coalesce("damping", F.lit(0.0))), F.lit('"/>\n'),
    )
    close = F.concat(pad, F.lit("</body>\n"))
    lines = F.array(
        F.struct(F.concat(F.lit("1"), _number(F.col("part"))).alias("at"), F.concat(F.lit('    <mesh name="mesh_'), name, F.lit('" file="'), name, F.lit('.obj"/>\n')).alias("line")),
        F.struct(F.concat(F.lit("3"), F.col("path")).alias("at"), F.concat(body, F.when(joint.isNotNull(), moved).otherwise("")).alias("line")),
        F.struct(F.concat(F.lit("3"), F.col("path"), F.lit("~")).alias("at"), close.alias("line")),
    )
    entity = F.regexp_replace(F.regexp_replace(F.col("entity").cast("string"), "&", "&amp;"), '"', "&quot;")
    head = F.concat(F.lit('<mujoco model="'), F.regexp_replace(entity, "<", "&lt;"), F.lit(f'">\n  <compiler angle="radian"/>\n  <option timestep="{WORLD["timestep"]}" gravity="{WORLD["gravity"]}"/>\n  <asset>\n'))
    frame = F.array(
        F.struct(F.lit("0").alias("at"), head.alias("line")), F.struct(F.lit("2").alias("at"), F.lit("  </asset>\n  <worldbody>\n").alias("line")),
        F.struct(F.lit("4").alias("at"), F.lit("  </worldbody>\n</mujoco>\n").alias("line")),
    )
    own = tree.select("entity", F.explode(lines).alias("l"))
    return own.unionByName(tree.select("entity").distinct().select("entity", F.explode(frame).alias("l"))).select("entity", "l.*")


def body_models(tree: DataFrame) -> DataFrame:
    """entity, xml: one model for each object. An object's bodies meet in one row, as they do in its file."""
    by = F.array_sort(F.collect_list(F.struct("at", "line")))
    return dealt(model_lines(tree), "entity").groupBy("entity").agg(F.array_join(F.transform(by, lambda x: x["line"]), "").alias("xml"))


def write_models(models: DataFrame, path: str) -> None:
    """A folder entity=<entity> with the text of each model; the committer makes the write atomic."""
    models.repartition("entity").select("entity", F.rtrim("xml").alias("value")).write.mode("overwrite").partitionBy("entity").text(path)
