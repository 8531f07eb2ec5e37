"""Components, reachability, motion graphs and itemsets."""

from __future__ import annotations

from itertools import combinations, count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import discard, stored


def components(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, node, component (the least node) of undirected edges (keys, a, b): least labels pass along edges and jump to their label's label.

    Each round is cut by a stored table; rounds end when no label changes, which they do, as labels only become less.
    """
    keys = keys or []
    both = edges.select(*keys, F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(*keys, F.col("b").alias("u"), F.col("a").alias("v"))).distinct()
    both = stored(both, "edges")
    labels = stored(both.groupBy(*keys, "u").agg(F.least(F.first("u"), F.min("v")).alias("l")), "labels")
    while True:
        pushed = both.join(labels.select(*keys, F.col("u").alias("v"), "l"), [*keys, "v"]).groupBy(*keys, "u").agg(F.min("l").alias("n"))
        new = labels.join(pushed, [*keys, "u"]).select(*keys, "u", F.least("l", "n").alias("l"))
        jump = new.select(*keys, F.col("u").alias("l"), F.col("l").alias("j"))
        new = stored(new.join(jump, [*keys, "l"], "left").select(*keys, "u", F.least(F.col("l"), F.coalesce("j", "l")).alias("l")), "labels")
        changed = new.join(labels, [*keys, "u", "l"], "left_anti").take(1)
        discard(labels)
        labels = new
        if not changed:
            break
    return labels.select(*keys, F.col("u").alias("node"), F.col("l").alias("component"))


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """entity, start, node: what a start reaches when its first hop may be of any kind and later hops are B, C or D; itself included.

    Each round extends the frontier only, by nodes not seen yet, until there are none.
    """
    e = stored(edges.select("entity", "src", "dst", "kind").distinct(), "edges")
    seen = stored(starts.select("entity", F.col("node").alias("start"), "node").distinct(), "reach")
    front = seen
    for hop in count():
        usable = e if hop == 0 else e.where("kind in ('B', 'C', 'D')")
        step = front.join(usable, (front["entity"] == usable["entity"]) & (front["node"] == usable["src"])).select(front["entity"], "start", F.col("dst").alias("node")).distinct()
        front = stored(step.join(seen, ["entity", "start", "node"], "left_anti"), "reach")
        if not front.take(1):
            break
        seen = stored(seen.unionByName(front), "reach")
    return seen


def motion_graph(edges: DataFrame) -> DataFrame:
    """entity, src, dst, kind, lo, hi: one edge of a kind for a pair, the last by seq; D only where the pair has nothing else in either sense; A and D in both senses."""
    last = edges.groupBy("entity", "src", "dst", "kind").agg(F.max_by(F.struct("lo", "hi"), "seq").alias("r"))
    sym = last.where("kind in ('A', 'D')").select("entity", F.col("dst").alias("src"), F.col("src").alias("dst"), "kind", "r")
    every = last.unionByName(sym).groupBy("entity", "src", "dst", "kind").agg(F.min("r").alias("r"))
    pair = Window.partitionBy("entity", F.least("src", "dst"), F.greatest("src", "dst"))
    other = F.max((F.col("kind") != "D").cast("int")).over(pair)
    return every.withColumn("_o", other).where((F.col("kind") != "D") | (F.col("_o") == 0)).select("entity", "src", "dst", "kind", "r.lo", "r.hi")


def contact_only(edges: DataFrame) -> DataFrame:
    """entity, node of nodes all of whose edges are of kind A."""
    ends = edges.select("entity", F.explode(F.array("src", "dst")).alias("node"), "kind")
    return ends.groupBy("entity", "node").agg(F.bool_and(F.col("kind") == "A").alias("pure")).where("pure").select("entity", "node")


def motion_nodes(edges: DataFrame) -> DataFrame:
    return edges.where("kind in ('B', 'C')").select("entity", F.col("dst").alias("node")).distinct()


def closure(edges: DataFrame) -> DataFrame:
    """name, needs: all that a name depends on, however far; rounds end when they bring no new pair."""
    seen = stored(edges.select("name", "needs").distinct(), "closure")
    front = seen
    while True:
        step = front.join(edges.select(F.col("name").alias("needs"), F.col("needs").alias("far")), "needs").select("name", F.col("far").alias("needs")).distinct()
        last, front = front, stored(step.join(seen, ["name", "needs"], "left_anti"), "closure")
        if not front.take(1):
            break
        grown = stored(seen.unionByName(front), "closure")
        discard(seen, last)
        seen = grown
    return seen


def itemsets(baskets: DataFrame, min_count: int) -> DataFrame:
    """items (sorted array), n: item sets of any size in at least min_count baskets, level by level from the frequent ones below. Rows (basket, item) may repeat.

    Baskets are shuffled once; those with the same items, and then with the same frequent items, are one row with their number. A set's row holds what its baskets have beyond its last item, and rows
    that are alike in both are one again, so levels grow with the kinds of baskets and not with the baskets.
    """
    # items without a basket are in none with another
    alone = F.when(F.col("basket").isNull(), F.col("item"))
    whole = baskets.where("item is not null").groupBy("basket", alone.alias("alone")).agg(F.array_sort(F.collect_set("item")).alias("rest"))
    whole = stored(whole.groupBy("rest").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.monotonically_increasing_id()), "kinds")
    each = whole.select("kind", "n", F.explode("rest").alias("item"))
    single = each.groupBy("item").agg(F.sum("n").alias("all")).where(F.col("all") >= min_count)
    kinds = each.join(single, "item").groupBy("kind", "n").agg(F.array_sort(F.collect_set("item")).alias("rest"))
    level = kinds.groupBy("rest").agg(F.sum("n").alias("n")).select(F.slice("rest", 1, 0).alias("items"), "rest", "n")
    frequent, last = [], whole
    while True:
        one = level.select("items", "rest", "n", F.posexplode("rest").alias("p", "item"))
        one = one.select(F.concat("items", F.array("item")).alias("items"), F.slice("rest", F.col("p") + 2, F.size("rest")).alias("rest"), "n")
        bigger = stored(one.groupBy("items", "rest").agg(F.sum("n").alias("n")), "level")
        discard(last)
        counts = stored(bigger.groupBy("items").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count), "counts")
        frequent.append(counts)
        level, last = bigger.where(F.size("rest") > 0).join(counts.select("items"), "items", "left_semi"), bigger
        if not counts.take(1):
            break
    discard(last)
    out = frequent[0]
    for f in frequent[1:]:
        out = out.unionByName(f)
    return out


def maximal(sets: DataFrame) -> DataFrame:
    """Item sets that no longer one holds, of sets that come with all their subsets, as those of itemsets() do: a set that is held is one item short of another."""
    size = F.size("items")
    short = F.transform(F.sequence(F.lit(1), size), lambda k: F.concat(F.slice("items", 1, k - 1), F.slice("items", k + 1, size)))
    held = sets.where(size > 1).select(F.explode(short).alias("items")).distinct()
    return sets.join(held, "items", "left_anti")


def subsets(items: list[int], size: int) -> list[tuple[int, ...]]:
    return list(combinations(sorted(items), size))
