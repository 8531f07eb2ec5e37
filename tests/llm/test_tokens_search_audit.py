"""Byte-level BPE against tiktoken, lexical search and the filter audit against plain re-computations."""

import base64
import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF
from kinegrain.llm import byte_bpe, filter_audit, lexical_search, queries

P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_50k.tiktoken")
ODD = ["", None, " ", "a", "it's 12 x\n\n  y\t", "é中文 \U0001f600\U0001f600 z", "<|endoftext|>", "́‍ x", "a  b", "ab " * 40_000, "x" * 30_000, "\x00\x1f"]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def model(spark):
    return byte_bpe.Model(spark.range(1), RANKS, P.PATTERN)


def test_pattern():
    assert byte_bpe.USUAL_PATTERN == P.PATTERN
    table = byte_bpe.byte_characters()
    assert len(set(table)) == 256 and table[65] == "A" and table[0] == "Ā"


def test_digests_are_those_of_tiktoken(spark, reference):
    got = {r.doc_id: r for r in queries.op11_byte_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids, r = reference.encode_ordinary(d.text or ""), got[d.doc_id]
        sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha, hashlib.sha256((d.text or "").encode()).hexdigest())


def test_odd_texts(spark, reference, model):
    docs = spark.createDataFrame([(i, t, "kept", i) for i, t in enumerate(ODD)] + [(None, "a b", "kept", 1), (3, "a", "kept", 2), (3, "a", "kept", 2)], "doc_id long, text string, ids string, other int")
    rows = byte_bpe.decode_ids(byte_bpe.encode_texts(docs, model, offsets=True), model).withColumn("again", byte_bpe.decoded_text(F.col("decoded")))
    assert rows.columns == ["doc_id", "other", "n_tokens", "ids", "byte_ends", "char_ends", "decoded", "again"]
    rows = rows.collect()
    assert len(rows) == len(ODD) + 3
    for r in rows:
        text = "a b" if r.doc_id is None else ODD[r.doc_id] or ""
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == reference.encode_ordinary(text) and r.n_tokens == len(ids)
        assert bytes(r.decoded) == text.encode() and r.again == text
        parts = [reference.decode_single_token_bytes(i) for i in ids]
        assert r.byte_ends == np.cumsum([len(p) for p in parts]).tolist()
        for end, chars in zip(r.byte_ends, r.char_ends):
            assert chars == len(text.encode()[:end].decode(errors="ignore"))
    empty = docs.limit(0)
    assert byte_bpe.digest(byte_bpe.decode_ids(byte_bpe.encode_texts(empty.select("doc_id", "text"), model), model)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=80))
def test_any_text(reference, model, text):
    import pyarrow as pa

    try:
        text.encode()
    except UnicodeEncodeError:
        return
    coder, _ = model.coder()
    (ids,) = coder.encode(pa.array([text]), None)
    assert ids.tolist() == reference.encode_ordinary(text)
    packed = pa.array([ids.astype("<u4").tobytes(), None, b""], pa.binary())
    out = [x for *_, a in byte_bpe._decoded(packed, model.table()) for x in a.to_pylist()]
    assert out == [text.encode(), None, b""]


def test_split_characters_and_unknown_ids(spark, reference, model):
    ids = reference.encode_ordinary("\U0001f9ff")
    assert len(ids) > 1
    rows = spark.createDataFrame([(1, bytearray(np.array(x, "<u4").tobytes())) for x in (ids, ids[:-1], [*ids, 50256, 4_000_000])] + [(2, None)], "n int, ids binary")
    out = byte_bpe.decode_ids(rows, model).withColumn("t", byte_bpe.decoded_text(F.col("decoded"))).collect()
    assert out[0].t == out[2].t == "\U0001f9ff" and "�" in out[1].t and out[3].decoded is None


def found_by_hand(docs, items, k):
    term = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    bags = [(d, Counter(term(x))) for d, x in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, length = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = {}
    asked = defaultdict(set)
    for i, x in items:
        asked[i] |= set(term(x))
    for i, q in asked.items():
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in q}
        scores = []
        for d, b, n in bags:
            m = 10 + (90 * n * n_docs) // length
            s = sum(w[t] * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m)) for t in q if t in b)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out[i] = [(None if null else d, -s) for s, null, d in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("shard_docs,block_terms", [(7, 5), (1 << 14, 1 << 20)])
def test_search(spark, shard_docs, block_terms):
    rng = random.Random(3)
    words = ["ka", "Lo", "mi", "été", "x1", "zu", "be", "rare", "o"]
    some = lambda n: rng.choice((" ", "-", ", ")).join(rng.choices(words, [8, 7, 6, 5, 4, 3, 2, 1, 1], k=n))
    docs = [(i, some(rng.randint(0, 30))) for i in range(300)] + [(None, "rare rare"), (None, None), (5, "rare"), (5, "rare"), (900, "ka " * 50_000), (901, None)]
    items = [(1, "rare Ka ka"), (2, "été zu LO"), (2, "o"), (3, ""), (4, None), (None, "mi be"), (6, "unheard"), (7, " ".join(words))]
    docs_df = spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, n int").repartition(5)
    got = defaultdict(list)
    rows = lexical_search.search(docs_df, spark.createDataFrame(items, "item_id long, text string"), shard_docs=shard_docs, block_terms=block_terms).collect()
    for r in sorted(rows, key=lambda r: r["rank"]):
        got[r.item_id].append((r.doc_id, r.score))
    want = found_by_hand(docs, items, 10)
    assert {i: x for i, x in want.items() if x} == dict(got)
    assert all(sorted(r["rank"] for r in rows if r.item_id == i) == list(range(1, len(x) + 1)) for i, x in got.items())


def test_search_of_nothing(spark):
    docs, items = (spark.createDataFrame([], s) for s in ("doc_id long, text string", "item_id int, text string"))
    one = spark.createDataFrame([(1, "a")], docs.schema)
    assert lexical_search.search(docs, items).count() == lexical_search.search(one, items).count() == 0
    assert lexical_search.search(docs, spark.createDataFrame([(1, "a")], items.schema)).count() == 0


def test_search_skips(monkeypatch):
    """Documents that cannot beat the threshold aren't scored."""
    scored = []
    real = lexical_search._held
    monkeypatch.setattr(lexical_search, "_held", lambda docs, some: scored.append(len(some)) or real(docs, some))
    n = 10_000
    sizes, terms = np.full(n, 1), np.zeros(n, np.int64)
    terms[:12] = 1
    weights = np.array([10, 9000])
    one, two = (lexical_search.Shard(list(range(lo, lo + n)), np.full(n, 10), sizes, terms, np.ones(n, np.int64), weights, n, 10 * n) for lo in (0, n))
    heap = []
    one.search(np.array([0, 1]), heap, 10)
    assert sum(scored) <= 2 * lexical_search.SCORE_TOGETHER
    scored.clear()
    two.search(np.array([0, 1]), heap, 10)
    assert sorted(-d for *_, d in heap) == list(range(10)) and sum(scored) <= 12 * 3


def audited_by_hand(docs, labels):
    good, toxic = ({d for d, *x in labels if x[i] == 1 and d is not None} for i in (0, 1))
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    fails, out = [], defaultdict(lambda: [0] * 6)
    for d, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > least[t]}
        fails.append((s or "", {k for k, v in f.items() if v}, d in good, d in toxic))
    for part in {p for p, *_ in fails}:
        first = Counter()
        for o in map("".join, itertools.permutations("ABCDE")):
            for k, x in enumerate(o):
                row = out[part, o, k + 1]
                for p, f, g, tox in fails:
                    if p == part:
                        gone, bad = bool(f & set(o[:k])), x in f
                        for i, v in enumerate((not gone and not bad, bad and not gone, bad and gone, f == {x}, bad and not gone and g, bad and not gone and tox)):
                            row[i] += v
                        first[x] += bad and not gone
        for (p, o, k), row in out.items():
            if p == part:
                row.append(first[o[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audit_fixture():
    rng = random.Random(5)
    base = [" ".join(rng.choices(["Ab", "c", "d", "ee", "F", "g#", "hh", "i", "é"], k=rng.choice((3, 60, 70)))) for _ in range(14)]
    base += [" ".join(f"w{i}{k}" for i in range(55)) for k in range(4)] + ["x" * 70 + c for c in "abc"]
    docs = [(i, rng.choice(base), rng.choice(("s", "t", None, ""))) for i in range(90)]
    docs += [(None, base[0], "s"), (None, None, None), (7, docs[7][1], "t"), (7, base[1], "t"), (200, None, "s"), (201, "", "s"), (202, "big " * 30_000, "t"), (203, "big " * 30_000, "s")]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1))) for i in range(60)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("collide", [False, True])
def test_audit(spark, monkeypatch, collide):
    if collide:  # all texts of one length share all hashes
        monkeypatch.setattr(filter_audit.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    docs, labels = audit_fixture()
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, source string, mask int, least string")
    rows = filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(rows) == len(got) and got == audited_by_hand(docs, labels)


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "a", None)], docs.schema)
    assert filter_audit.audit(one, labels).count() == 600
