"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Sources share ``share`` times all words in proportion to their weights. A source
is clamped at ``max_epochs`` times its own size; its excess goes to the others by
weight until none is above. Sorted by cap over weight, the clamped sources are a
prefix, so the water level has a closed form: running sums over the table of
sources, which has a row for each source. Documents are repeated whole
``floor(target / size)`` times; the rest of the target is taken in seeded order,
whole documents up to the one on the boundary, of which a fraction is taken.

The order is found without sorting a source: a hash puts documents in ``BUCKETS``
buckets, sums by bucket find the bucket with the boundary, and only its documents
are ordered. Equal rows have equal hashes and sizes, so ties don't change what is
taken from any size.

Defined cases: null text has size 0; null source is a source of its own and comes
last; a source of size 0 has target 0; repeated rows count one by one; an empty
table gives an empty result; other columns are carried by ``mix`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, discard, stored, word_count

WEIGHTS = (3.0, 1.0, 2.0)
BUCKETS = 4096


def seeded_order(seed: int, doc_id: Column) -> Column:
    """Hex digits that order documents; the first three are the bucket."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def source_targets(sizes: DataFrame, *, weights=WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row for each source in and out."""
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", w)
    cap = F.col("source_size") * F.lit(float(max_epochs))
    ranked = ranked.withColumns({"cap": cap, "ratio": cap / F.col("weight")})
    order = Window.orderBy("ratio", "rank")
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(every) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    found = ranked.withColumn("level", level)
    # levels rise while sources clamp; the first that its own source can hold is the water level
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(every)["level"]
    return found.withColumn("water", first).select(
        "source",
        "source_size",
        F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("water"), F.col("cap"))).alias("target"),
    )


def mixing_plan(
    docs: DataFrame, *, weights=WEIGHTS, share: float = 1.5, max_epochs: float = 2.0, seed: int = 7
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row for each row of docs."""
    order = seeded_order(seed, F.col("doc_id"))
    sized = stored(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).withColumn("ord", order)
        .withColumn("bucket", F.conv(F.substring("ord", 1, 3), 16, 10).cast("int")),
        "mix",
    )
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    sized = sized.withColumn("key", key)
    by_bucket = stored(sized.groupBy("key", "source", "bucket").agg(F.sum("size").alias("words")), "mix")
    sizes = by_bucket.groupBy("key", "source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes.select("source", "source_size"), weights=weights, share=share, max_epochs=max_epochs)
    ratio = F.col("target") / F.col("source_size")
    whole = F.when(F.col("source_size") > 0, F.floor(ratio)).otherwise(0).cast("long")
    plan = targets.withColumn("key", key).withColumn("whole", whole).withColumn(
        "need", F.when(F.col("source_size") > 0, F.round(F.col("target")).cast("long") - F.col("whole") * F.col("source_size")).otherwise(0)
    )
    run = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    upto = by_bucket.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    edge = (
        upto.join(plan.select("key", "need"), "key")
        .where("before <= need and need < before + words")
        .groupBy("key")
        .agg(F.min(F.struct("bucket", "before")).alias("e"))
    )
    plan = stored(
        plan.join(edge, "key", "left").select("key", "source_size", "target", "whole", "need", F.coalesce("e.bucket", F.lit(BUCKETS)).alias("edge"), F.coalesce("e.before", F.lit(0)).alias("before")),
        "mix",
    )
    all_ = sized.join(checked_broadcast(plan), "key")
    cols = ["doc_id", "source", "size", "source_size", "target"]
    clear = all_.where("bucket <> edge").select(
        *cols, (F.col("size") * (F.col("whole") + (F.col("bucket") < F.col("edge")).cast("long"))).alias("taken")
    )
    inner = Window.partitionBy("key").orderBy("ord", "size").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = all_.where("bucket = edge").withColumn("prior", F.col("before") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("need") - F.col("prior")))
    return clear.unionByName(at_edge.select(*cols, (F.col("size") * F.col("whole") + part).cast("long").alias("taken")))


def mix(docs: DataFrame, **how) -> DataFrame:
    """docs with each row as often as the mix takes it whole, and the boundary documents' fraction as a row with their first words."""
    same = lambda doc_id, source, size: [
        F.coalesce(doc_id.cast("string"), F.lit("null")).alias("k"), F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n")).alias("s"), size.alias("size")
    ]
    c = F.col
    plan = stored(mixing_plan(docs, **how), "plan")
    # equal rows share an entry; at most one boundary row differs, so the mean over equal rows is spread by whole words
    entry = plan.select(*same(c("doc_id"), c("source"), c("size")), "taken").groupBy("k", "s", "size")
    entry = stored(entry.agg(F.floor(F.sum("taken") / F.count(F.lit(1))).cast("long").alias("each")), "taken")
    discard(plan)
    # the row's own columns are in one struct, so none of them can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), *same(c("doc_id"), c("source"), word_count(c("text"))))
    both = rows.join(checked_broadcast(entry), ["k", "s", "size"])
    pieces = F.when(c("size") == 0, F.lit(0)).otherwise(F.ceil(c("each") / c("size"))).cast("int")
    out = both.withColumn("piece", F.explode(F.when(pieces > 0, F.sequence(F.lit(1), pieces)).otherwise(F.array().cast("array<int>"))))
    left = F.least(c("size"), c("each") - (c("piece") - 1) * c("size"))
    words = F.regexp_extract_all(c("row.text"), F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))
    text = F.when(left >= c("size"), c("row.text")).otherwise(F.array_join(F.slice(words, F.lit(1), left.cast("int")), ""))
    return out.select(*[text.alias(n) if n == "text" else c("row").getField(n).alias(n) for n in docs.columns])
