"""Training datasets and manifests: filters, fan-out, labels, conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_json(**fields: Column) -> Column:
    """Strict JSON of a label: fields in the given order, nulls kept."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


def mass_ok(rate: Column, most: float = 2.0) -> Column:
    """Mass rate of at most ``most``; null and NaN don't pass."""
    return F.coalesce(~F.isnan(rate) & (rate <= most), F.lit(False))


def passed(check: Column) -> Column:
    """Strictly true."""
    return F.coalesce(check, F.lit(False))


def filter_counters(samples: DataFrame) -> DataFrame:
    """One row: samples, those with a good and a bad mass rate, and those that pass all filters."""
    ok = mass_ok(F.col("mass_rate"))
    return samples.agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(ok).alias("mass_ok"), F.count_if(~ok).alias("mass_dropped"), F.count_if(ok & passed(F.col("pass_check"))).alias("kept")
    )


def fan_out(samples: DataFrame, tasks: dict[str, Column]) -> DataFrame:
    """A row for each sample and each task whose condition it meets; one pass, no union."""
    wanted = F.array_compact(F.array(*[F.when(ok, F.lit(t)) for t, ok in tasks.items()]))
    return samples.withColumn("task", F.explode(wanted))


def alias_of(text: Column, aliases: dict[str, str]) -> Column:
    """Canonical name of a spelling, after trimming and folding case; null if unknown."""
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.try_element_at(table, F.lower(F.trim(text)))


def first_wins(rows: DataFrame, keys: list[str], order: str, values: dict[str, str]) -> DataFrame:
    """keys, the values of the row that comes first, and how many there were."""
    return rows.groupBy(*keys).agg(*[F.min_by(c, order).alias(n) for n, c in values.items()], F.count(F.lit(1)).alias("n"))


def last_wins(rows: DataFrame, keys: list[str], order: str, values: dict[str, str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.max_by(c, order).alias(n) for n, c in values.items()], F.count(F.lit(1)).alias("n"))


def manifest(samples: DataFrame, entity: str, order: str) -> DataFrame:
    """samples with their place in their entity and the entity's size."""
    w = Window.partitionBy(entity)
    return samples.withColumns({"source_index": F.row_number().over(w.orderBy(order)) - 1, "parts": F.count(F.lit(1)).over(w)})


def _positions(messages: DataFrame) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return messages.where("role <> 'system'").withColumn("pos", F.row_number().over(w) - 1)


def alignment(messages: DataFrame) -> DataFrame:
    """conv_id, n, aligned (user and assistant take turns, evenly many), pairs."""
    role = F.when(F.col("pos") % 2 == 0, "user").otherwise("assistant")
    g = _positions(messages).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("role") == role).alias("alternates"))
    return g.select("conv_id", "n", (F.col("alternates") & (F.col("n") % 2 == 0)).alias("aligned"), F.floor(F.col("n") / 2).cast("long").alias("pairs"))


def turn_pairs(messages: DataFrame) -> DataFrame:
    """conv_id, pair, source, target: every even message with the next one."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = _positions(messages).withColumn("target", F.lead("text").over(w))
    return p.where("pos % 2 = 0 and target is not null").select("conv_id", F.floor(F.col("pos") / 2).cast("long").alias("pair"), F.col("text").alias("source"), "target")


def conversation(messages: DataFrame, piece: str) -> DataFrame:
    """conv_id, chat (pieces joined in turn order), n."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text", piece)))
    return messages.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x[piece]), "").alias("chat"), F.count(F.lit(1)).alias("n"))


def in_taxonomy(rows: DataFrame, taxonomy: DataFrame, key: str) -> DataFrame:
    """rows with known: whether key is in the taxonomy, a bounded table."""
    return rows.join(taxonomy.select(key, F.lit(True).alias("known")).distinct(), key, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def with_default(value: Column, default) -> Column:
    return F.coalesce(value, F.lit(default))


def role_messages(rows: DataFrame, system: str | None, prompt: str, response: str) -> DataFrame:
    """Instruction rows as arrays of (role, content)."""
    one = lambda role, col: F.struct(F.lit(role).alias("role"), F.col(col).alias("content"))
    parts = ([one("system", system)] if system else []) + [one("user", prompt), one("assistant", response)]
    return rows.withColumn("messages", F.filter(F.array(*parts), lambda m: m["content"].isNotNull()))


def split_by_hash(rows: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """rows with split: 'val' for about ``share`` of the keys, the same ones in every run."""
    from ..functions.numeric import hash_uniform

    return rows.withColumn("split", F.when(hash_uniform(seed, F.col(key)) < share, "val").otherwise("train"))


#: Folders of an object's part meshes, the best first; where the second is there, the object isn't finished and has none.
OBJ_FOLDERS, UNFINISHED = ("parts", "merge_objs", "objs"), "glbs"


def useful_objs(files: DataFrame) -> DataFrame:
    """entity, folder, name of the OBJ files that stand for an object, from a listing (entity, folder, name) of all its folders' files.

    ``parts`` counts whatever else is there; without it an object with a folder of unfinished meshes has no files, and any other one
    those of its best folder, even if none of that folder's files is an OBJ.
    """
    rank = F.array_position(F.array(*map(F.lit, OBJ_FOLDERS)), F.col("folder"))
    seen = files.groupBy("entity").agg(F.min(F.when(rank > 0, rank)).alias("best"), F.bool_or(F.col("folder") == UNFINISHED).alias("unfinished"))
    good = seen.where((F.col("best") == 1) | ~F.col("unfinished")).select("entity", F.get(F.array(*map(F.lit, OBJ_FOLDERS)), (F.col("best") - 1).cast("int")).alias("folder"))
    return files.join(good, ["entity", "folder"]).where(F.col("name").endswith(".obj")).select("entity", "folder", "name")


def frame_listing(files: DataFrame) -> DataFrame:
    """entity, frame (from 0), name of image files (entity, name) in the order of their numbers; names that aren't numbers are left out."""
    number = F.regexp_extract("name", r"^(\d+)\.(?i:jpe?g)$", 1).try_cast("long")
    rows = files.withColumn("_n", number).where("_n is not null")
    return rows.select("entity", (F.row_number().over(Window.partitionBy("entity").orderBy("_n", "name")) - 1).alias("frame"), "name")


def without_valid(planned: DataFrame, existing: DataFrame, categories: DataFrame, key: str, category: str) -> DataFrame:
    """Planned rows whose existing annotation (key, text) is absent, no JSON object, or of a category that the taxonomy lacks."""
    found = existing.select(key, F.try_variant_get(F.try_parse_json("text"), f"$.{category}", "string").alias("_c"))
    known = categories.select(F.col(category).alias("_c")).where("_c is not null").distinct()
    return planned.join(found.join(known, "_c", "left_semi").select(key).distinct(), key, "left_anti")


def base_record(schema_version: str, task: Column, sample: Column, index: Column, source: Column, **inputs: Column) -> Column:
    """The part of an inference record that every answer has: where a sample comes from, and its inputs; nulls are written."""
    given = F.struct(*[x.alias(n) for n, x in inputs.items()])
    whole = F.struct(F.lit(schema_version).alias("schema_version"), sample.alias("sample_id"), task.alias("task"), index.alias("source_index"), source.alias("source_json"), given.alias("inputs"))
    return F.to_json(whole, {"ignoreNullFields": "false"})
