"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A run of
three letters is bound into one vector: the first letter's vector rotated by two
places, the second's by one and the third's, multiplied elementwise. A document is
the bundle (sum) of its runs' vectors; a language's prototype is the bundle of its
training documents, each scaled to length one, so long texts and hot sources weigh
no more than others. A document gets the language whose prototype has the highest
cosine with it, after the mean of all prototypes is taken from them.

Training adds up partial prototypes: a task hands on DIM numbers for each language.
What is kept for scoring is languages x DIM numbers.

Defined cases: null text or text without letters is ``und`` with score 0; without
any training document everything is ``und``; ties go to the first language by name;
repeated rows are predicted alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 1024
SEED = 20
#: Letters and apostrophes between anything else; \W, digits and _ part words.
RUNS = re.compile(r"[^\W\d_]+")
#: A bound on the cached vectors of letter runs, in rows of DIM bytes.
CACHE = 1 << 15


class Encoder:
    """Vectors of letter runs, cached up to CACHE rows."""

    def __init__(self, dim: int = DIM, seed: int = SEED):
        self.dim, self.seed = dim, seed
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.zeros((1024, dim), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.Generator(np.random.Philox(key=[self.seed, code])).integers(0, 2, self.dim, np.int8)
            self.letters[code] = (2 * bits - 1).astype(np.int8)
        return self.letters[code]

    def bound(self, key: int) -> np.ndarray:
        a, b, c = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        """Rows of +1 and -1 for runs of three letters, each 21 bits of a key."""
        if len(self.rows) + len(keys) > CACHE:
            self.rows.clear()
        rows = np.empty(len(keys), np.int64)
        for k, key in enumerate(keys.tolist()):
            row = self.rows.get(key)
            if row is None:
                row = self.rows[key] = len(self.rows)
                if row >= len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[row] = self.bound(key)
            rows[k] = row
        return self.table[rows]

    def bundles(self, texts: list[str]) -> np.ndarray:
        """A row for each text; zeros if it has no letter."""
        out = np.zeros((len(texts), self.dim), np.float32)
        keys, owner = [], []
        for k, text in enumerate(texts):
            letters = " ".join(RUNS.findall(text.lower()))
            if not any(map(str.isalpha, letters)):  # runs may hold numbers that are no digits
                continue
            a = np.frombuffer(f" {letters} ".encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
            key, count = np.unique((a[:-2] << 42) | (a[1:-1] << 21) | a[2:], return_counts=True)
            keys.append(key)
            owner.append((k, count))
        if not keys:
            return out
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        ends = np.cumsum([len(k) for k in keys])
        for at in range(0, len(every), 4096):  # bounded columns at a time
            vec = self.vectors(every[at : at + 4096]).astype(np.float32)
            for lo in range(0, len(owner), 256):
                few = owner[lo : lo + 256]
                m = np.zeros((len(few), len(vec)), np.float32)
                for r, (k, count) in enumerate(few):
                    end = ends[lo + r]
                    p = place[end - len(count) : end] - at
                    ok = (p >= 0) & (p < len(vec))
                    m[r, p[ok]] = count[ok]
                out[[k for k, _ in few]] += m @ vec
        return out


_ENCODERS: dict[tuple[int, int], Encoder] = {}


def encoder(dim: int, seed: int) -> Encoder:
    return _ENCODERS.setdefault((dim, seed), Encoder(dim, seed))


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=-1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def prototypes(labelled: DataFrame, *, dim: int = DIM, seed: int = SEED) -> dict[str, np.ndarray]:
    """Prototype of each language from labelled (text, lang); DIM sums for each language come to the driver."""

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for pdf in parts:
            texts, langs = pdf["text"].tolist(), pdf["lang"].tolist()
            for k in range(0, len(texts), 512):
                v = _unit(encoder(dim, seed).bundles([t or "" for t in texts[k : k + 512]])).astype(np.float64)
                names = np.array(langs[k : k + 512], object)
                for lang in set(langs[k : k + 512]):
                    total[lang] = total.get(lang, 0) + v[names == lang].sum(axis=0)
        for lang, v in total.items():
            yield pd.DataFrame({"lang": lang, "place": np.arange(dim, dtype=np.int32), "value": np.round(v, 9)})

    rows = labelled.where("text is not null and lang is not null").select("text", "lang")
    # decimal sums don't depend on the order in which partial sums arrive
    sums = (
        rows.mapInPandas(add, "lang string, place int, value double")
        .groupBy("lang", "place")
        .agg(F.sum(F.col("value").cast("decimal(28,9)")).alias("value"))
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("place", F.col("value").cast("double").alias("value")))).alias("v"))
        .collect()
    )
    return {r["lang"]: np.array([x["value"] for x in r["v"]]) for r in sorted(sums, key=lambda r: r["lang"])}


def detect_language(docs: DataFrame, protos: dict[str, np.ndarray], *, dim: int = DIM, seed: int = SEED) -> DataFrame:
    """docs without their text, with lang_pred and score (cosine, moved to 0..1); one row for each row; columns of these names give way."""
    langs = sorted(protos)
    kept = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)
    p = np.stack([_unit(protos[x]) for x in langs]) if langs else np.zeros((0, dim))
    if len(langs) > 1:
        p = p - p.mean(axis=0)
    p = _unit(p).astype(np.float32)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((langs, p))

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        langs, p = shared.value
        for pdf in parts:
            texts = [t or "" for t in pdf["text"]]
            pred, score = [], []
            for k in range(0, len(texts), 512):
                v = encoder(dim, seed).bundles(texts[k : k + 512])
                has = np.abs(v).sum(axis=1) > 0
                cos = _unit(v) @ p.T if langs else np.zeros((len(v), 1))
                best = cos.argmax(axis=1)
                for ok, b, c in zip(has, best, cos):
                    pred.append(langs[b] if ok and langs else "und")
                    score.append(float(min(1.0, max(0.0, (1 + c[b]) / 2))) if ok and langs else 0.0)
            out = pdf.drop(columns=["text"])
            out["lang_pred"], out["score"] = pred, score
            yield out

    return docs.select(*kept, "text").mapInPandas(judge, f"{fields}, lang_pred string, score double")
