"""Quality rules, mixing, token output, language ID and toxicity on small fixtures."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinegrain.llm import language_id, mixing, quality, simple8b, token_output, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_docs(spark, more=()):
    """Nulls, empties, repeated rows, a very long text, and columns with clashing names."""
    rows = [
        (1, None, None, None, None, "x", 1), (2, "", "en", "s", 0, None, 2), (3, " \n\t", "en", None, 3, None, 3), (4, "word", None, "s", 4, None, 4),
        (5, "same text here", "en", "s", 14, None, 5), (5, "same text here", "en", "s", 14, None, 5), (None, "no id", "en", "s", 5, None, 6), (6, "ab " * 60_000, "de", "t", 180_000, None, 7),
    ]
    return spark.createDataFrame(rows + list(more), SCHEMA)


def prose(rng, n):
    return " ".join("".join(rng.choice(("ka", "lo", "mi", "ne", "tu")) for _ in range(rng.randint(1, 4))) for _ in range(n))


def counts_by_hand(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    cover = {i + k for i, g in enumerate(grams) if g in often for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(cover)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n#|\t é", max_size=120))
def test_text_counts(text):
    assert quality.text_counts(text)[:5] == counts_by_hand(text)


def test_quality(spark):
    rng = random.Random(1)
    clean = [(100 + i, prose(rng, 80 + i % 40), "en", "s", 0, None, 0) for i in range(120)]
    junk = [(900, " ".join(w + "###$$$" for w in prose(rng, 90).split()), "en", "s", 0, None, 0)]
    docs = odd_docs(spark, clean + junk)
    got = {(r.doc_id, r.n_words): r for r in quality.quality_verdicts(docs).collect()}
    assert len(quality.quality_verdicts(docs).collect()) == docs.count()
    for r in docs.collect():
        v = got[r.doc_id, len(WORD.findall(r.text or ""))]
        assert (v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words) == counts_by_hand(r.text)
        assert v.base_failed == (v.n_words < 50 or 100 * v.n_repeat_words > 50 * v.n_words)
    assert not got[900, 90].kept and all(got[d[0], len(d[1].split())].kept for d in clean)
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d[0] for d in clean}
    assert quality.quality_verdicts(docs.limit(0)).count() == 0


def test_mcd_is_not_moved_by_outliers(spark):
    rng = np.random.default_rng(0)
    rows = [("m", *map(float, rng.normal(0, 1, 5))) for _ in range(400)] + [("m", *[50.0] * 5) for _ in range(60)]
    model = quality.mcd_models(spark.createDataFrame(rows, "model string, x0 double, x1 double, x2 double, x3 double, x4 double")).first()
    assert np.abs(model["mean"]).max() < 0.3 and 0.4 < np.linalg.inv(np.array(model["inv"]).reshape(5, 5))[0, 0] < 2.5


def fill(sizes, weights, share, epochs):
    """Water-filling by rounds."""
    total, free = share * sum(sizes), set(range(len(sizes)))
    target = [0.0] * len(sizes)
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in free if total * weights[i] / w > epochs * sizes[i]]
        if not over:
            for i in free:
                target[i] = total * weights[i] / w
            break
        for i in over:
            target[i] = epochs * sizes[i]
            total -= target[i]
            free.discard(i)
    return target


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(1, 60)), "en", f"s{i % 7}", 0, None, 0) for i in range(300)]
    docs = odd_docs(spark, rows)
    plan = mixing.mixing_plan(docs).collect()
    assert len(plan) == docs.count() and plan == sorted(plan, key=plan.index)
    by = {}
    for r in plan:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 2 * r.size
    names = sorted((s for s in by if s is not None)) + [None]
    sizes = [sum(r.size for r in by[s]) for s in names]
    want = fill(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2)
    for s, size, target in zip(names, sizes, want):
        assert by[s][0].source_size == size and by[s][0].target == pytest.approx(target)
        assert sum(r.taken for r in by[s]) == round(target)
    again = mixing.mixing_plan(docs.repartition(3)).collect()
    assert sorted(map(str, plan)) == sorted(map(str, again))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    total = sum(len(WORD.findall(r.text or "")) for r in mixed.collect())
    assert abs(total - sum(r.taken for r in plan)) <= 1
    assert mixing.mixing_plan(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


values = st.one_of(st.integers(0, 1), st.integers(0, 60_000), st.integers(0, 2**64 - 1))


@settings(max_examples=60, deadline=None)
@given(st.lists(values, max_size=400), st.integers(0, 300))
def test_simple8b_round_trip(v, zeros):
    a = np.array(v + [0] * zeros + v, np.uint64)
    s = simple8b.encode(a, 128)
    assert (simple8b.decode(s, len(a), block=128) == a).all()
    lo, hi = len(a) // 3, 2 * len(a) // 3
    assert (simple8b.decode(s, len(a), lo, hi, block=128) == a[lo:hi]).all()


def test_simple8b_packs():
    assert len(simple8b.encode(np.zeros(480, np.uint64))["words"]) == 2
    assert len(simple8b.encode(np.ones(60, np.uint64))["words"]) == 1


TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    """The tokenizers library's own object for the file, untouched."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


ODD = st.text(alphabet=" \n\t'sléa1,.\u3000\x1c\x85中²", max_size=20)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), ODD, st.sampled_from(["", " ", "a ", " a", "x <|endoftext|> y", "end.\n\n", "\n\na  b"])), max_size=6))
def test_token_ids_are_the_librarys(library, texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    want = [library.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert [x.tolist() for x in token_output.token_ids(texts, TOKENIZER)] == want


def test_token_ids_after_forgetting(library, monkeypatch):
    monkeypatch.setattr(token_output, "MEMO", 40)
    monkeypatch.setattr(token_output, "_CODERS", {})
    rng = random.Random(4)
    for _ in range(12):
        texts = [prose(rng, rng.randint(0, 30)) for _ in range(5)]
        assert [x.tolist() for x in token_output.token_ids(texts, TOKENIZER)] == [library.encode(t, add_special_tokens=False).ids + [0] for t in texts]


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    texts = ["Hello  World", "", "two words.\n"]
    other = Tokenizer.from_file(path)
    assert [x.tolist() for x in token_output.token_ids(texts, path)] == [other.encode(t, add_special_tokens=False).ids + [0] for t in texts]


def test_token_output(spark, library):
    docs = odd_docs(spark, [(i, f"text {i} it's  two\n\n lines", "en", "s", 0, None, 0) for i in range(50, 20, -1)])
    folder, manifest = token_output.write_token_shards(docs, TOKENIZER, shard_ids=500)
    got = token_output.token_digest(token_output.read_token_shards(spark, folder, manifest)).collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    got.sort(key=lambda r: r.start)
    assert len(got) == len(rows)
    at = 0
    for r, g in zip(rows, got):
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    folder, manifest = token_output.write_token_shards(docs.limit(0), TOKENIZER)
    assert token_output.read_token_shards(spark, folder, manifest).count() == 0


def test_language_id(spark):
    rng = random.Random(3)
    words = {"aa": ("ban", "doro", "ali", "mano"), "bb": ("kri", "zst", "prk", "vlt"), "cc": ("ühe", "öäl", "üss", "äm")}
    text = lambda lang: " ".join(rng.choice(words[lang]) + rng.choice(words[lang]) for _ in range(30))
    rows = [(i, text(k), k) for i, k in enumerate("aa bb cc".split() * 30)]
    docs = spark.createDataFrame([*rows, (500, None, "aa"), (501, "12 _ 3! \u00b2", "aa"), (502, "", None)], "doc_id long, text string, lang string")
    protos = language_id.prototypes(docs.where("doc_id % 4 <> 2"))
    assert list(protos) == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in language_id.detect_language(docs, protos).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows) and all(0 <= g.score <= 1 for g in got.values())
    assert {got[i].lang_pred for i in (500, 501, 502)} == {"und"}
    none = language_id.detect_language(docs, language_id.prototypes(docs.limit(0)))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, new = row, [i]
        for j, y in enumerate(b, 1):
            new.append(min(prev[j] + 1, new[j - 1] + 1, prev[j - 1] + (x != y)))
        row = new
    return row[-1]


TERMS = ["scum", "moron", "stupid", "worthless", "disgusting", "trash"]


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(TERMS), st.lists(st.tuples(st.sampled_from("sdi"), st.integers(0, 9), st.sampled_from("aemrs")), max_size=3))
def test_automaton_is_levenshtein(term, edits):
    word = list(term)
    for kind, at, c in edits:
        at = min(at, len(word))
        if kind == "i":
            word.insert(at, c)
        elif at < len(word):
            if kind == "s":
                word[at] = c
            else:
                del word[at]
    word = "".join(word)
    a = toxicity.LexiconAutomaton(TERMS)
    near = [(levenshtein(word, t), t) for t in TERMS if levenshtein(word, t) <= toxicity.edits_allowed(t)]
    assert a.match(word) == min(near, default=None)


def test_spans_and_quotes():
    a = toxicity.LexiconAutomaton(["idiot", "vequ*"])
    found = toxicity.spans('You idiot! He said "you idoit" and vequanch.', a)
    assert [(t, e, q) for _, _, t, e, q in found] == [("idiot", 0, False), ("vequ*", -1, False)]
    found = toxicity.spans('"you idiiot"', a)
    assert [(t, e, q) for _, _, t, e, q in found] == [("idiot", 1, True)]
    assert toxicity.spans(None, a) == [] and toxicity.spans("", a) == []


def test_toxicity(spark):
    rng = random.Random(4)
    rows = []
    for i in range(240):
        words = prose(rng, 40).split()
        bad = i % 4 == 0
        for _ in range(3 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(("idiot", "worthless", "moron")))
        rows.append((i, " ".join(words), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.where("doc_id % 3 <> 1"))
    assert {"idiot", "worthless", "moron"} <= set(model[0])
    more = spark.createDataFrame([(900, "what a worthles idiiot mess", 1), (901, None, 0), (902, "", 0)], "doc_id long, text string, score int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs.select("doc_id", "text"), model).collect()}
    held = [(got[i].predicted, t) for i, _, t in rows if i % 3 == 1]
    assert sum(p == t for p, t in held) >= 0.97 * len(held)
    odd = {r[0]: r for r in toxicity.score_toxicity(more.select("doc_id", "text"), model).collect()}
    assert odd[900].predicted == 1 and odd[901].score == odd[902].score < 0.7
    # a copy of a clean text a thousand times over makes none of its words a term
    copies = spark.createDataFrame([(i, "unusual words of one text", 1) for i in range(400)] + [(1000 + i, prose(rng, 9), 0) for i in range(400)], "doc_id long, text string, toxic int")
    assert toxicity.learn_lexicon(copies) == []
    assert toxicity.score_toxicity(docs.limit(0).select("doc_id", "text"), toxicity.fit(docs.limit(0))).count() == 0
