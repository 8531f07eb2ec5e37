"""Ranked lexical search: WAND per document shard, and a merge of the shards' heaps.

One pass over the documents keeps, of each, its length and its occurrences of the queries'
terms, as a stored table. Document frequencies are counted from that table. Each task then
reads its part of it in shards of SHARD_DOCS documents, inverts a shard into lists by term,
each with the maximum impact in it, and takes the queries one by one:

* lists are ordered by maximum impact; the pivot list is the last one whose maximum, with
  those of all behind it, can reach the heap's threshold. A document that no list up to the
  pivot holds is skipped without being touched; so is a shard whose maxima don't reach it;
* what is left is a document's bound: the maxima of the lists that hold it. The lists behind
  the pivot are sought at the documents left only, and those fall out as the bound sinks
  below the threshold;
* documents that stay are scored from the highest bound down, some at a time, so that the
  threshold rises, until no bound reaches it.

Bounds equal to the threshold are scored too, since equal scores rank by doc_id. A heap lives
as long as its task, so later shards start with the threshold of earlier ones. Heaps of tasks
meet in two steps, by a share of the tasks and then by query. All arithmetic of impacts is in
whole numbers. Queries are taken in blocks of about BLOCK_TERMS terms, which bounds what is
broadcast and sent to the driver; each block passes over the documents once.

Defined cases: documents without a term (null, empty) count nowhere and are never found; rows
with equal doc_ids are documents of their own; null doc_ids rank behind others of the same
score; query rows with equal ids are one query of all their terms, a null id is an id like
others; a query without terms finds nothing; empty tables give empty results. Very long
texts are taken whole.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, IntegerType, StructField, StructType

from .common import discard, stored

#: Documents of a shard, terms of a block of queries, documents scored at a time.
SHARD_DOCS, BLOCK_TERMS, SCORE_TOGETHER = 1 << 14, 1 << 20, 256
#: Shares of tasks in which heaps meet first.
MEETINGS = 64

#: A byte's term character, lower-cased if A-Z; a space for what separates terms.
_FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text's UTF-8: maximal runs of letters and digits of ASCII and of all other characters, A-Z lower-cased."""
    return text.translate(_FOLD).split()


def query_terms(items: DataFrame) -> DataFrame:
    """item_id, terms (distinct) of items (item_id, text)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [list(dict.fromkeys(terms_of(x or b""))) for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["item_id"], pa.array(terms, pa.list_(pa.binary()))], ["item_id", "terms"])

    schema = StructType([StructField("item_id", items.schema["item_id"].dataType), StructField("terms", ArrayType(BinaryType()))])
    return items.select("item_id", F.col("text").cast("binary").alias("text")).mapInArrow(read, schema)


def term_index(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n, terms (places in the vocabulary), times of the documents that have a term."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(sent.value)}
        for batch in batches:
            names, n, size, terms, times = [], [], [0], [], []
            for d, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                words = terms_of(text.as_py() or b"")
                if words:
                    found = Counter(words)
                    held = found.keys() & place.keys()
                    names.append(d)
                    n.append(len(words))
                    terms += [place[t] for t in held]
                    times += [found[t] for t in held]
                    size.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(x, pa.int32())) for x in (terms, times)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "times"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(read, "doc_id long, n long, terms array<int>, times array<int>")


def weight(documents: int, holders: int) -> int:
    """A term's weight."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holders + 1)))


class Shard:
    """Lists of a shard's documents by term, with impacts and their maxima."""

    def __init__(self, names: list[int | None], n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, times: np.ndarray, weights: np.ndarray, documents: int, length: int):
        self.names = names
        lengths, which = np.unique(n, return_inverse=True)
        # in Python's own whole numbers, which don't overflow
        m = np.array([10 + 90 * int(x) * documents // length for x in lengths], np.int64)[which]
        place = np.repeat(np.arange(len(names)), sizes)
        impact = weights[terms] * (1_000_000_000 * times // (1000 * times + 8 * m[place]))
        order = np.argsort(terms, kind="stable")
        self.docs, self.impacts = place[order], impact[order]
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(weights)))])
        filled = np.flatnonzero(np.diff(self.ends))
        self.most = np.zeros(len(weights), np.int64)
        if len(filled):
            self.most[filled] = np.maximum.reduceat(self.impacts, self.ends[filled])

    def search(self, query: np.ndarray, heap: list[tuple[int, bool, int]], k: int) -> None:
        """Puts the shard's best k documents for the query's terms into the heap of (score, doc_id is known, -doc_id)."""
        query = query[self.most[query] > 0]
        query = query[np.argsort(-self.most[query], kind="stable")]
        most = self.most[query]
        rest = np.concatenate([np.cumsum(most[::-1])[::-1], [0]])
        least = heap[0][0] if len(heap) == k else 1
        pivot = int((rest >= max(least, 1)).sum())  # lists before it can reach the threshold without those before them
        if not pivot:
            return
        lists = [(self.docs[self.ends[t] : self.ends[t + 1]], self.impacts[self.ends[t] : self.ends[t + 1]]) for t in query]
        bound = np.zeros(len(self.names), np.int64)
        for (docs, _), top in zip(lists[:pivot], most):
            bound[docs] += top
        left = np.flatnonzero(bound)
        left = left[bound[left] + rest[pivot] >= least]
        high = bound[left] + rest[pivot]
        for (docs, _), top in zip(lists[pivot:], most[pivot:]):
            high -= np.where(_held(docs, left)[0], 0, top)
            stay = high >= least
            if not stay.all():
                left, high = left[stay], high[stay]
        order = np.argsort(-high, kind="stable")
        left, high = left[order], high[order]
        for lo in range(0, len(left), SCORE_TOGETHER):
            some = left[lo : lo + SCORE_TOGETHER][high[lo : lo + SCORE_TOGETHER] >= least]
            if not len(some):
                break
            some.sort()
            score = np.zeros(len(some), np.int64)
            for docs, impacts in lists:
                held, at = _held(docs, some)
                score[held] += impacts[at[held]]
            for i in np.flatnonzero(score >= least).tolist():
                name = self.names[some[i]]
                entry = (int(score[i]), name is not None, -(name or 0))
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
            if len(heap) == k:
                least = heap[0][0]


def _held(docs: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of some are in the ascending docs, where)."""
    at = np.minimum(np.searchsorted(docs, some), len(docs) - 1)
    return docs[at] == some, at


def _searcher(sent, k: int, shard_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, documents, length = sent.value
        heaps: list[list[tuple[int, bool, int]]] = [[] for _ in queries]

        def take(held: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            terms, times = (t[c].chunk(0) for c in ("terms", "times"))
            shard = Shard(
                t["doc_id"].to_pylist(), t["n"].to_numpy(), np.diff(terms.offsets.to_numpy()), terms.flatten().to_numpy().astype(np.int64),
                times.flatten().to_numpy().astype(np.int64), weights, documents, length,
            )
            for query, heap in zip(queries, heaps):
                shard.search(query, heap, k)

        held, rows = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, shard_docs):
                some = batch.slice(lo, shard_docs)
                if rows + some.num_rows > shard_docs and held:
                    take(held)
                    held, rows = [], 0
                held.append(some)
                rows += some.num_rows
        if rows:
            take(held)
        part = TaskContext.get().partitionId()
        found = [(q, score, -minus if known else None) for q, heap in enumerate(heaps) for score, known, minus in heap]
        for lo in range(0, len(found), 1 << 16):
            cols = list(zip(*found[lo : lo + (1 << 16)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(cols[0]), pa.int32()), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())],
                ["part", "query", "score", "doc_id"],
            )

    return run


def _best(hits: DataFrame, keys: list, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, *, shard_docs: int = SHARD_DOCS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of docs (doc_id, text) for each of items (item_id, text)."""
    spark = docs.sparkSession
    asked = stored(query_terms(items), "queries")
    blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms)
    kind = items.schema["item_id"]
    out = spark.createDataFrame([], StructType([StructField("item_id", kind.dataType), StructField("rank", IntegerType()), StructField("doc_id", LongType()), StructField("score", LongType())]))
    for b in range(blocks):
        place: dict[bytes, int] = {}
        queries: dict[object, dict[int, None]] = {}
        for item_id, terms in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect():
            queries.setdefault(item_id, {}).update(dict.fromkeys(place.setdefault(bytes(t), len(place)) for t in terms))
        index = stored(term_index(docs, list(place)), "terms")
        documents, length = index.agg(F.count(F.lit(1)), F.sum("n")).first()
        holders = np.zeros(len(place), np.int64)
        for term, count in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            holders[term] = count
        if not documents or not queries:
            continue
        weights = np.array([weight(documents, int(x)) for x in holders], np.int64)
        asks = [np.fromiter(q, np.int64, len(q)) for q in queries.values()]
        sent = spark.sparkContext.broadcast((asks, weights, documents, length))
        hits = index.mapInArrow(_searcher(sent, k, shard_docs), "part int, query int, score long, doc_id long")
        met = _best(hits, ["query", F.pmod(F.col("part"), F.lit(MEETINGS))], k)
        best = stored(_best(met, ["query"], k), "hits")
        discard(index)
        ids = spark.createDataFrame([(i, q) for i, q in enumerate(queries)], StructType([StructField("query", IntegerType()), StructField("item_id", kind.dataType)]))
        out = out.union(best.join(F.broadcast(ids), "query").select("item_id", "rank", "doc_id", "score"))
    discard(asked)
    return out


SEARCH_SQL = r"""
with words as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
docs as (select doc_id, terms, len(terms)::bigint as n from words where len(terms) > 0),
totals as (select count(*)::bigint as big_n, sum(n)::bigint as big_l from docs),
asked as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
times as (select doc_id, n, term, count(*)::bigint as tf from (select doc_id, n, unnest(terms) as term from docs) group by all),
weights as (select term, floor(1000 * ln((2 * big_n + 2)::double / (2 * count(*) + 1)::double))::bigint as w from times, totals
    where term in (select term from asked) group by term, big_n),
impacts as (select doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * big_n) // big_l)))) as impact
    from times join weights using (term), totals),
scores as (select item_id, doc_id, sum(impact)::bigint as score from asked join impacts using (term) group by all having sum(impact) > 0),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as r from scores)
select item_id, r::int as "rank", doc_id, score from ranked where r <= 10"""
