"""Scores of toxicity, cosines of language ID and verdicts of quality rules against plain re-computations."""

import random

import numpy as np
import pytest

from kinegrain.llm import language_id, quality, toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def score_by_hand(text, terms, allowed, curve):
    """Every word against every term, and windows walked word by word."""
    text, total, before, quotes, at = text or "", 0.0, [], False, 0
    for m in toxicity.LETTERS.finditer(text.lower()):
        for c in text[at : m.start()]:
            quotes = (not quotes) if c == '"' else True if c in "“„«" else False if c in "”»\n" else quotes
        at, w = m.end(), m.group()
        near = min((distance(w, t) for t in terms if not t.endswith("*") and distance(w, t) <= allowed[t]), default=None)
        stem = any(w.startswith(t[:-1]) for t in terms if t.endswith("*"))
        if near is not None or stem:
            said = bool(set(before[-2:]) & toxicity.SPEECH) or (len(before) > 2 and before[-3] in toxicity.SPEECH and toxicity.WINDOW > 3)
            quoted = quotes or said or bool(set(before[-toxicity.WINDOW :]) & toxicity.SPEECH)
            total += (toxicity.QUOTED if quoted else 1.0) * (1.0 if near == 0 else toxicity.NEAR)
        before.append(w)
    x = min(toxicity.TOP, np.ceil(2 * total) / 2)
    return 1 / (1 + np.exp(-(curve[0] + curve[1] * np.sqrt(x))))


def test_toxicity_scores(spark):
    rng = random.Random(3)
    terms = ["vile", "grubble", "snortwaffle", "flimp*"]
    allowed = {"vile": 0, "grubble": 1, "snortwaffle": 2}
    curve = [-3.0, 2.5]
    words = ["vile", "vil", "grubble", "gruble", "grubbles", "snortwafle", "sortwafle", "flimpish", "flimp", "said", "calm", "sea", "the", "\n", '"', "„", "“", "a" * 40]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(300)] + [None, "", "vile " * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, (terms, allowed, curve)).collect()}
    for k, t in enumerate(texts[:-1]):
        assert got[k].score == pytest.approx(score_by_hand(t, terms, allowed, curve)), t
    assert got[len(texts) - 1].score == pytest.approx(1 / (1 + np.exp(3 - 2.5 * np.sqrt(toxicity.TOP)))) and got[300].predicted == 0


def test_lexicon_keeps_long_and_short_words(spark):
    """No cap on a word's length or on the number of terms."""
    rng = random.Random(1)
    calm = ["sea", "sun", "tree", "hill", "bird", "rain"]
    bad = ["zx", "q" * 60, *(f"{a}{b}{c}nasty" for a in "bcdf" for b in "aeio" for c in "klmn")]
    rows = []
    for i in range(1200):
        w = [rng.choice(calm) for _ in range(12)]
        if i % 4 == 0:
            for k in range(6):
                w.insert(rng.randint(0, len(w)), bad[(i // 4 * 6 + k) % len(bad)])
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    found = toxicity.learn_lexicon(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert "zx" in found and "q" * 60 in found and not {"sea", "sun"} & set(found)
    assert all(b in found or any(t.endswith("*") and b.startswith(t[:-1]) for t in found) for b in bad)


def profile(text, dim, seed):
    """Sum of bound runs of three letters, one after the other."""
    encoder = language_id.Encoder(dim, seed)
    total = np.zeros(dim)
    letters = f" {' '.join(language_id.RUNS.findall(text.lower()))} "
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        total += np.roll(encoder.letter(ord(a)), 2) * np.roll(encoder.letter(ord(b)), 1) * encoder.letter(ord(c)).astype(int)
    return total


def test_language_cosines(spark):
    rng = random.Random(2)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["che", "tion", "ou"], "cc": ["сто", "пра", "ни"]}
    prose = lambda lang: " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(rng.randint(1, 20)))
    rows = [(i, prose(lang), lang) for i, lang in enumerate(rng.choices(list(syllables), k=60))]
    protos = language_id.prototypes(spark.createDataFrame(rows, "doc_id long, text string, lang string"), dim=256)
    unit = lambda v: v / np.linalg.norm(v)
    plain = {x: sum(unit(profile(t, 256, language_id.SEED)) for _, t, lang in rows if lang == x) for x in syllables}
    for x in syllables:
        assert protos[x] == pytest.approx(plain[x], abs=1e-5)
    names = sorted(plain)
    p = np.stack([unit(plain[x]) for x in names])
    p = np.stack([unit(v) for v in p - p.mean(axis=0)])
    tests = [prose(rng.choice(names)) for _ in range(30)] + ["x", "123", ""]
    got = {r.doc_id: r for r in language_id.detect_language(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), protos, dim=256).collect()}
    for k, t in enumerate(tests[:-2]):
        cos = p @ unit(profile(t, 256, language_id.SEED))
        assert got[k].lang_pred == names[int(cos.argmax())] and got[k].score == pytest.approx((1 + cos.max()) / 2, abs=1e-5)
    assert [(got[k].lang_pred, got[k].score) for k in (31, 32)] == [("und", 0.0)] * 2


def mcd_by_hand(x, floor, support=0.75, steps=12):
    """(mean, scatter) by concentration steps from two starts, each to its end."""
    ends = []
    share = lambda v, q: np.sort(v)[max(int(np.ceil(q * len(v))) - 1, 0)]
    middle = np.array([share(c, 0.5) for c in x.T])
    dev = np.array([share(np.abs(c - m), 0.5) for c, m in zip(x.T, middle)])
    for mean, cov in ((middle, np.diag((1.4826 * dev) ** 2 + np.square(floor))), (x.mean(axis=0), np.cov(x.T, bias=True) + np.diag(np.square(floor)))):
        kept = None
        for _ in range(steps):
            d = x - mean
            d2 = np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)
            now = d2 <= share(d2, support)
            mean, cov = x[now].mean(axis=0), 1.6 * np.cov(x[now].T, bias=True) + np.diag(np.square(floor))
            if kept is not None and (now == kept).all():
                break
            kept = now
        ends.append((np.linalg.slogdet(cov)[1], mean, cov))
    return min(ends, key=lambda e: e[0])[1:]


def test_mcd_verdicts(spark):
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for model, n, bad in (("a", 300, 40), ("b", 150, 30), ("c", 90, 0)):
        x = rng.normal(0, 1, (n, 5)) @ rng.normal(0, 1, (5, 5))
        x[:bad] += 30
        rows += [(model, *map(float, v)) for v in x]
        mean, cov = mcd_by_hand(x, quality.FLOOR)
        d = x - mean
        want[model] = (mean, np.linalg.inv(cov), int((np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) > quality.CUTOFF).sum()), bad)
    df = spark.createDataFrame(rows, "model string, x0 double, x1 double, x2 double, x3 double, x4 double").repartition(3)
    for r in quality.mcd_models(df).collect():
        mean, inv, rejected, bad = want[r["model"]]
        assert np.array(r["mean"]) == pytest.approx(mean, rel=1e-6, abs=1e-8) and np.array(r["inv"]).reshape(5, 5) == pytest.approx(inv, rel=1e-5, abs=1e-7)
        assert rejected == bad
