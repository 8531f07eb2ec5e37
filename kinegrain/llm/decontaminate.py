"""Benchmark decontamination, in DataFrame functions only.

1. Documents and items become arrays of word-shingle hashes. A Bloom filter of the
   items' shingles, one bounded array for each run, keeps documents with at least one
   of them: a window without any cannot be similar to an item.
2. Where such a shingle stands at place p of a document and at place q of an item,
   an item-sized window starts at p - q. Windows are the distinct starts and sizes.
3. Every window and every item gets a SimHash fingerprint of 64 bits over its
   shingles, weighted by how rare a shingle is among the items.
4. Multi-index Hamming search: 64 bits are cut into 8 blocks of 8. Fingerprints
   within RADIUS = 23 bits differ by at most 2 bits in some block, so items are
   listed under all block values within 2 bits, and windows look up their own 8:
   every pair within the radius meets.
5. Exact weighted similarity of the shingle sets, sum of weights in both over sum of
   weights in either, decides: ``threshold`` or more is a leak.

A shingle weighs 1 over the number of distinct item texts that hold it, so an item
under several ids weighs as under one. Shingles that no item holds weigh as the mean
of the window's others in fingerprints; in the exact similarity, those that the item
does not hold weigh no more than the item's mean.

The benchmark is bounded by MAX_ITEMS and MAX_SHINGLES (an error beyond), so its
tables may be broadcast; documents are never shuffled whole, only the few that hold
an item's shingle.

Defined cases: null and empty texts and items match nothing; texts shorter than a
shingle match nothing; items shorter than a shingle have no shingle and are skipped;
repeated documents are each reported under their doc_id, once; null doc_ids are
never reported and never dropped; equal items are all reported; an empty benchmark
finds no leak.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, stored

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 23
MAX_ITEMS = 100_000
MAX_SHINGLES = 4_000_000
#: Bits of Bloom filter for each shingle of the benchmark, and bits set for one: a strange shingle passes 3 times in a million,
#: so that a document of thousands of words seldom does.
BLOOM_BITS, BLOOM_SPOTS = 64, 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of a text's word shingles in order; empty for fewer words. A-Z count as a-z."""
    words = F.filter(
        F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x20\x09-\x0D]+"), lambda w: F.length(w) > 0
    )
    # words are hashed once; a shingle's hash is that of its words' hashes
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.transform(
        F.array(hashed),
        lambda a: F.when(
            F.size(a) >= size,
            F.transform(F.sequence(F.lit(1), F.size(a) - size + 1), lambda i: F.xxhash64(*[F.get(a, i - 1 + k) for k in range(size)])),
        ).otherwise(F.array().cast("array<long>")),
    )[0]


def item_shingles(items: DataFrame, size: int = SHINGLE) -> DataFrame:
    """item_id, n (shingles), sh (their hashes in order) of the items that have any; raises beyond the bounds."""
    out = stored(
        items.select("item_id", shingle_hashes(F.col("text"), size).alias("sh")).select("item_id", F.size("sh").alias("n"), "sh").where("n > 0"),
        "items",
    )
    total = out.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("s")).first()
    if total["n"] > MAX_ITEMS or total["s"] > MAX_SHINGLES:
        raise ValueError(f"benchmark of {total['n']} items and {total['s']} shingles is beyond the bounds of one run")
    return out


def _bloom(items: DataFrame) -> tuple[DataFrame, int]:
    """One row with an array of 64-bit words, and how many words."""
    total = items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = 1 << max(6, (total * BLOOM_BITS // 64).bit_length())
    bits = items.select(F.explode("sh").alias("h")).select(F.explode(F.array(*_spots(F.col("h"), words))).alias("b")).distinct()
    by_word = bits.groupBy(F.shiftright("b", 6).cast("int").alias("w")).agg(
        F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias("v")
    )
    every = F.sequence(F.lit(0), F.lit(words - 1))
    one = by_word.agg(F.map_from_entries(F.collect_list(F.struct("w", "v"))).alias("m")).select(F.expr("map_entries(m)").alias("e"))
    # an array by place, without a lookup for each word: fill in the words that are missing, then sort by place
    filled = one.select(
        F.array_sort(
            F.concat(
                "e",
                F.transform(F.array_except(every, F.transform("e", lambda x: x["key"])), lambda w: F.struct(w.alias("key"), F.lit(0).cast("long").alias("value"))),
            )
        ).alias("e")
    )
    return stored(filled.select(F.transform("e", lambda x: x["value"]).alias("bloom")).coalesce(1), "bloom"), words


def _spots(h: Column, words: int) -> list[Column]:
    bits = F.lit(words * 64 - 1)
    return [F.shiftright(h, 9 * k).bitwiseAND(bits) for k in range(BLOOM_SPOTS)]


def _held(h: Column, bloom: Column, words: int) -> Column:
    test = None
    for b in _spots(h, words):
        word = F.get(bloom, F.shiftright(b, 6).cast("int"))
        one = F.expr("1L")
        hit = F.call_function("shiftrightunsigned", word, b.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(one) == 1
        test = hit if test is None else test & hit
    return test


def fingerprint(weighted: DataFrame, keys: list[str]) -> DataFrame:
    """keys and fp, the 64-bit SimHash of (keys, h, w): sign of the weighted vote of each bit."""
    votes = [F.sum(F.when(F.shiftright("h", b).bitwiseAND(F.lit(1)) == 1, F.col("w")).otherwise(-F.col("w"))).alias(f"v{b}") for b in range(64)]
    bits = None
    for b in range(64):
        bit = F.when(F.col(f"v{b}") > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return weighted.groupBy(*keys).agg(*votes).select(*keys, bits.alias("fp"))


def _block(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * k).bitwiseAND(F.lit(255)).cast("int")


def _near_masks() -> list[int]:
    """The 37 masks of at most two of eight bits."""
    return [0] + [1 << i for i in range(8)] + [1 << i | 1 << j for i in range(8) for j in range(i)]


def find_leaks(
    docs: DataFrame, items: DataFrame, *, size: int = SHINGLE, threshold: float = THRESHOLD, radius: int = RADIUS
) -> DataFrame:
    """doc_id, item_id, start (first word of the best window, from 0), distance, similarity: a row for each document and item that leaks into it."""
    if radius > 23:
        raise ValueError("blocks within 2 bits guarantee a radius of 23 at most")
    bench = item_shingles(items, size)
    listed = bench.select("item_id", "n", F.posexplode("sh").alias("q", "h"))
    df = bench.select("sh").distinct().select(F.explode(F.array_distinct("sh")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    # weight of a shingle: its rarity among the items' distinct texts
    weights = stored(df.select("h", (1.0 / F.col("df")).alias("w")), "weights")
    bloom, words = _bloom(bench)

    source = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("doc_id"), shingle_hashes(F.col("text"), size).alias("sh"))
    gated = source.withColumn("bloom", bloom.select("bloom").scalar())
    gated = gated.where(F.exists("sh", lambda h: _held(h, F.col("bloom"), words)))
    # rows are told apart by their shingles where a doc_id repeats
    near = stored(gated.select("doc_id", F.xxhash64("sh").alias("row"), "sh", F.filter(F.transform("sh", lambda h, i: F.struct(i.alias("p"), h.alias("h"))), lambda x: _held(x["h"], F.col("bloom"), words)).alias("hits")), "near").dropDuplicates(["doc_id", "row"])

    hits = near.select("doc_id", "row", F.size("sh").alias("len"), F.explode("hits").alias("x")).select("doc_id", "row", "len", "x.p", "x.h")
    starts = (
        hits.join(checked_broadcast(bench_index(listed)), "h")
        .select("doc_id", "row", "n", F.greatest(F.lit(0), F.least(F.col("p") - F.col("q"), F.col("len") - F.col("n"))).alias("s"))
        .groupBy("doc_id", "row", "n", "s")
        .agg(F.count(F.lit(1)).alias("votes"))
    )
    # a window similar enough shares at least this many shingle places with its item, whatever the weights
    starts = stored(starts, "starts")
    windows = starts.join(near.select("doc_id", "row", "sh"), ["doc_id", "row"]).select(
        "doc_id", "row", "s", "n", F.explode(F.array_distinct(F.slice("sh", F.col("s") + 1, F.col("n")))).alias("h")
    )
    keys = ["doc_id", "row", "s", "n"]
    # what no item holds weighs as the window's other shingles do, so that it counts on the scale of the item
    held = F.avg("w").over(Window.partitionBy(*keys))
    weighed = stored(windows.join(checked_broadcast(weights), "h", "left").withColumn("w", F.coalesce("w", held, F.lit(1.0))), "windows")
    of_windows = fingerprint(weighed, keys)
    own = listed.select("item_id", "n", "h").distinct().join(checked_broadcast(weights), "h")
    of_items = stored(fingerprint(own, ["item_id", "n"]), "item_fp")

    masks = F.array(*[F.lit(m) for m in _near_masks()])
    blocks = lambda fp: F.array(*[F.struct(F.lit(k).alias("k"), _block(fp, k).alias("v")) for k in range(8)])
    lookup = of_items.select("item_id", F.col("n").alias("n_item"), F.col("fp").alias("fp_item"), F.explode(blocks(F.col("fp"))).alias("x"), masks.alias("masks"))
    lookup = stored(lookup.select("item_id", "n_item", "fp_item", "x.k", F.explode(F.transform("masks", lambda m: m.bitwiseXOR(F.col("x.v")))).alias("v")), "lookup")
    probes = of_windows.select(*keys, "fp", F.explode(blocks(F.col("fp"))).alias("x")).select(*keys, "fp", "x.k", "x.v")
    found = (
        probes.join(checked_broadcast(lookup), ["k", "v"])
        .where(F.col("n") == F.col("n_item"))
        .withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_item"))))
        .where(F.col("distance") <= radius)
        .select(*keys, "item_id", "distance")
        .distinct()
    )
    found = stored(found, "found")

    both = found.join(weighed, keys).join(checked_broadcast(stored(own.select("item_id", "h", F.lit(1).alias("own")), "own")), ["item_id", "h"], "left")
    item_weight = stored(own.groupBy("item_id").agg(F.sum("w").alias("item"), F.avg("w").alias("mean")), "item_weight")
    both = both.join(checked_broadcast(item_weight), "item_id")
    window = both.groupBy("doc_id", "row", "s", "item_id", "distance", "item").agg(
        F.sum(F.when(F.col("own").isNull(), F.least("w", "mean")).otherwise(0.0)).alias("strange"),
        F.coalesce(F.sum(F.when(F.col("own") == 1, F.col("w"))), F.lit(0.0)).alias("shared"),
    )
    scored = window.withColumn("similarity", F.col("shared") / (F.col("strange") + F.col("item")))
    best = F.max(F.struct(F.col("similarity"), (-F.col("s")).alias("s"), (-F.col("distance")).alias("d")))
    return (
        scored.where(F.col("similarity") >= threshold - 1e-9)
        .groupBy("doc_id", "item_id")
        .agg(best.alias("b"))
        .select("doc_id", "item_id", (-F.col("b.s")).cast("long").alias("start"), (-F.col("b.d")).cast("int").alias("distance"), F.col("b.similarity").alias("similarity"))
    )


def bench_index(listed: DataFrame) -> DataFrame:
    """h, q, n: places of shingles in items, without the item: windows depend on place and size only."""
    return stored(listed.select("h", "q", "n").distinct(), "places")


def drop_leaks(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """docs without those that an item leaks into."""
    bad = stored(find_leaks(docs, items, **how).select("doc_id").distinct(), "leaks")
    return docs.join(checked_broadcast(bad), "doc_id", "left_anti").select(*docs.columns)
