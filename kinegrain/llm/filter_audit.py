"""Filter interaction audit: what each of five filters removes in each of their 120 orders.

A document's failures are a mask of five bits. Four bits are expressions of its text. The
fifth says that a smaller doc_id has the same text, which partition refinement finds: rows
are split by code-point length, then by the hash of one block of the text after the other
(ROUND_ENDS; the last block goes to the end), and after each split classes of one doc_id drop
out. The full texts of the classes left are then grouped, with a partial sum in each task, so
that many copies leave it as one row; where a class turns out to hold several texts, its
rows are judged by text, not by class. The narrow table of lengths and hashes is stored, so
that texts are read twice only. Classes meet documents by joins that a hot class doesn't
hold up: the class side has one row each, and is broadcast where its size is checked.

All counts are sums over masks, at most 32 rows for each part, before orders are looked at.
A filter's Shapley number needs no sum over orders: of the failing filters of a mask, each
comes first in the same number of orders, so the mask gives each 120 / failing filters.

Defined cases: null text is empty; null source is the empty part; a null doc_id neither is
smaller than another nor has a smaller one, and has no labels; rows that repeat a doc_id and
its text are each counted, and are no duplicates of each other; a doc_id counts as good
(toxic) where any of its label rows says so; empty tables give empty results.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, checked_broadcast, discard, stored

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
#: Code points at which blocks of a text end; what is behind the last is one block more.
ROUND_ENDS = (64, 512, 4096)


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails: words, distinct words, capitals, symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    few = F.size(words) < 50
    same = F.size(F.array_distinct(words)) * 100 < F.size(words) * 65
    loud = F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.char_length(text).cast("long") * 5
    odd = text.rlike(r"[#$%&*|]")
    return sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate((few, same, loud, odd))), F.lit(0))


def block_hashes(text: Column) -> dict[str, Column]:
    """Length of a text in code points, and hashes of its blocks."""
    starts = (0, *ROUND_ENDS)
    ends = (*ROUND_ENDS, None)
    blocks = [F.substring(text, a + 1, 0x7FFFFFFF if b is None else b - a) for a, b in zip(starts, ends)]
    return {"size": F.char_length(text), **{f"block{i}": F.xxhash64(b) for i, b in enumerate(blocks)}}


CLASS = ["size", *(f"block{i}" for i in range(len(ROUND_ENDS) + 1))]


def _several(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Classes by keys that hold more than one doc_id."""
    return rows.groupBy(*keys).agg(F.min("doc_id").alias("_least"), F.max("doc_id").alias("_most")).where("_least < _most").select(*keys)


def refined(facts: DataFrame) -> DataFrame:
    """doc_id and class columns of the rows whose class holds several doc_ids, after all rounds; a stored table."""
    left, last = facts.where("doc_id is not null").select("doc_id", *CLASS), None
    for k in range(1, len(CLASS) + 1):
        several = stored(_several(left, CLASS[:k]), "classes")
        left = stored(left.join(checked_broadcast(several), CLASS[:k], "left_semi").select("doc_id", *CLASS), "refined")
        discard(several, *([last] if last is not None else ()))
        last = left
    return left


def document_rows(docs: DataFrame) -> DataFrame:
    """doc_id, part, text, mask of the filters A to D, and class columns, of docs (doc_id, source, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), text.alias("text"))
    return base.select("*", failures(F.col("text")).alias("mask"), *(c.alias(n) for n, c in block_hashes(F.col("text")).items()))


def marked_duplicates(rows: DataFrame) -> DataFrame:
    """doc_id, part, mask of document_rows(), with the bit of duplicates of a smaller doc_id's text."""
    facts = stored(rows.drop("text"), "facts")
    left = refined(facts)
    classes = stored(left.select(*CLASS).distinct(), "classes")
    texts = rows.where("doc_id is not null").select("doc_id", "text", *CLASS)
    equal = texts.join(checked_broadcast(classes), CLASS, "left_semi").groupBy(*CLASS, "text").agg(F.min("doc_id").alias("least"))
    equal = stored(equal.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("texts"), F.min("least").alias("least")), "equal")
    discard(left, classes)
    later = lambda: F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))  # noqa: E731
    found = facts.join(checked_broadcast(equal), CLASS, "left").select("doc_id", "part", "mask", "texts", later().alias("later"))
    mixed = equal.where("texts > 1").select(*CLASS)
    if not mixed.isEmpty():  # hashes of different texts that are all equal: these rows are judged by text
        own = rows.join(mixed, CLASS, "left_semi")
        by_text = own.groupBy("text").agg(F.min("doc_id").alias("least"))
        own = own.join(by_text, "text").select("doc_id", "part", "mask", F.lit(1).alias("texts"), later().alias("later"))
        found = found.where("texts is null or texts = 1").unionByName(own)
    return found.select("doc_id", "part", F.col("mask").bitwiseOR(F.when(F.col("later"), DUPLICATE).otherwise(0)).alias("mask"))


def mask_counts(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each mask, those with quality 1 and those with toxic 1."""
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    said = said.agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    return marked.join(said, "doc_id", "left").groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")
    )


def steps(filters: str = FILTERS) -> list[tuple[str, int, int, int]]:
    """(order, step, bit of the step's filter, bits of those before it) of all orders."""
    bit = {f: 1 << i for i, f in enumerate(filters)}
    return [("".join(o), k + 1, bit[f], sum(bit[g] for g in o[:k])) for o in permutations(filters) for k, f in enumerate(o)]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of docs (doc_id, source, text)."""
    counts = mask_counts(marked_duplicates(document_rows(docs)), labels)
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    orders = F.array(*(F.struct(F.lit(o).alias("o"), F.lit(k).alias("k"), F.lit(b).alias("b"), F.lit(p).alias("p")) for o, k, b, p in steps()))
    each = parts.select("part", "masks", F.explode(orders).alias("s")).select("part", "masks", "s.*")
    bit, before = F.col("b"), F.col("p")

    def total(of: str, which) -> Column:
        return F.aggregate("masks", F.lit(0).cast("long"), lambda t, m: t + F.when(which(m["mask"]), m[of]).otherwise(0))

    fails = lambda m: m.bitwiseAND(bit) != 0  # noqa: E731
    here = lambda m: fails(m) & (m.bitwiseAND(before) == 0)  # noqa: E731
    orders_first = lambda m: F.lit(len(steps()) // len(FILTERS)) / F.bit_count(m)  # noqa: E731
    shapley = F.aggregate("masks", F.lit(0).cast("long"), lambda t, m: t + F.when(fails(m["mask"]), m["n"] * orders_first(m["mask"]).cast("long")).otherwise(0))
    return each.select(
        "part", F.col("o").alias("filter_order"), F.col("k").alias("step"),
        total("n", lambda m: m.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"), total("n", here).alias("removed"),
        total("n", lambda m: fails(m) & (m.bitwiseAND(before) != 0)).alias("redundant"), total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"), shapley.alias("shapley"),
    )  # fmt: skip


AUDIT_SQL = r"""
with texts as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
words as (select *, regexp_extract_all(text, '[^ 	-]+') as w, min(doc_id) over (partition by text) as least from texts),
said as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
failed as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
        case when len(w) < 50 then 'A' else '' end || case when 100 * len(list_distinct(w)) < 65 * len(w) then 'B' else '' end
        || case when 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) then 'C' else '' end
        || case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end || case when words.doc_id > least then 'E' else '' end as fails
    from words left join said using (doc_id)),
counts as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from failed group by all),
f(x) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
orders as (select a.x || b.x || c.x || d.x || e.x as o from f a, f b, f c, f d, f e
    where a.x <> b.x and a.x <> c.x and a.x <> d.x and a.x <> e.x and b.x <> c.x and b.x <> d.x and b.x <> e.x and c.x <> d.x and c.x <> e.x and d.x <> e.x),
steps as (select o, k::int as step, o[k:k] as x, left(o, k::int - 1) as earlier from orders, range(1, 6) r(k)),
judged as (select *, contains(fails, x) as bad, length(translate(earlier, fails, '')) < length(earlier) as gone from counts, steps),
sums as (select part, o as filter_order, step, x, coalesce(sum(n) filter (not bad and not gone), 0)::bigint as kept, coalesce(sum(n) filter (bad and not gone), 0)::bigint as removed,
        coalesce(sum(n) filter (bad and gone), 0)::bigint as redundant, coalesce(sum(n) filter (fails = x), 0)::bigint as unique_fails,
        coalesce(sum(good) filter (bad and not gone), 0)::bigint as good_lost, coalesce(sum(toxic) filter (bad and not gone), 0)::bigint as toxic_lost
    from judged group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, x)::bigint as shapley from sums"""
