"""Toxicity: a learned lexicon in a trie, met by Levenshtein automata, scored in context.

Lexicon. Words, and stems of 4 to 6 letters, are learned from labelled texts. Every
neighbourhood (word before, word after) in toxic texts is credited to one text that
has it, and a term's support is the number of texts credited, so a text that was
copied a thousand times supports a term no more than once; a stem also needs FORMS
different words, none of which gives over half of its support. Against it stands the number of clean texts that hold it. A term stays if its
likelihood ratio is beyond what chance gives among all terms tested; all that pass are
kept, words of any length.

Matching. States of the product of the trie and the automaton for up to k edits are
sets of (trie node, edits), made when they are first met and then remembered, so a
word costs one look-up for each letter and most end after two or three. k is 0 for
terms under 5 letters, 1 under 9, else 2, and less for terms whose near words occur
in clean training texts as often as in toxic ones. Stems need their letters exactly,
and match any ending.

Context. Each match is scored in its window: in quotation marks, or shortly after a
verb of speech, it counts ``QUOTED`` of a match; a misspelled word or a stem counts
``NEAR`` of one. A logistic curve over the sum is fitted to the counts of sums of all
training texts; bins are few whatever the corpus holds.

Defined cases: null and empty text has no match and gets the curve's base score;
without labelled texts of both kinds the score is the smoothed base rate; documents
with several labels count as toxic if any is; repeated rows score alike; extra
columns are carried.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, discard, stored

LETTERS = re.compile(r"[^\W_]+(?:['’*@$][^\W_]+)*")
QUOTED = 0.3
NEAR = 0.7
FORMS = 4
WINDOW = 3
#: Fixed words: verbs of speech that make a following term a quotation.
SPEECH = frozenset("said says called calls wrote writes quoted quotes quote word term sagte nannte schrieb wort dit disait mot dijo dice llamó palabra".split())
#: Feature sums count in halves up to this.
TOP = 6.0
MEMO = 1 << 20
STEMS = (4, 5, 6)


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class LexiconAutomaton:
    """Words and stems (given as 'stem*') against which words are matched."""

    def __init__(self, terms: list[str], allowed: dict[str, int] | None = None):
        self.allowed = {t: edits_allowed(t) for t in terms} | (allowed or {})
        self.child: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        for t in terms:
            node = 0
            for c in t.rstrip("*"):
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.word.append(None)
                    self.stem.append(None)
                node = self.child[node][c]
            (self.stem if t.endswith("*") else self.word)[node] = t
        # most edits that any word below a node allows
        self.most = [0] * len(self.child)
        for node in range(len(self.child) - 1, -1, -1):
            own = self.allowed[self.word[node]] if self.word[node] else 0
            self.most[node] = max([own, *(self.most[x] for x in self.child[node].values())])
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.step: list[dict[str, int]] = []
        self.memo: dict[str, tuple[int, str] | None] = {}
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:  # letters of a term that the word lacks
            node, e = todo.pop()
            if e > self.most[node] or best.get(node, 9) <= e:
                continue
            best[node] = e
            if e < 2:
                todo += [(x, e + 1) for x in self.child[node].values()]
        key = frozenset(best.items())
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.step.append({})
        return self.ids[key]

    def _next(self, state: int, c: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, e in self.states[state]:
            if c in self.child[node]:
                out.add((self.child[node][c], e))
            if e < 2:
                out.add((node, e + 1))
                out.update((x, e + 1) for x in self.child[node].values())
        to = self._state(out) if out else -1
        if to >= 0 and not self.states[to]:
            to = -1
        self.step[state][c] = to
        return to

    def match(self, word: str) -> tuple[int, str] | None:
        """(edits, term) of the nearest term; stems count as -1; None if nothing is near."""
        if word in self.memo:
            return self.memo[word]
        if len(self.memo) > MEMO:
            self.memo.clear()
        if len(self.states) > 200_000:
            self.ids, self.states, self.step = {}, [], []
            self.start = self._state({(0, 0)})
        node, stem = 0, None
        for c in word:
            node = self.child[node].get(c, -1)
            if node < 0:
                break
            stem = self.stem[node] or stem
        state = self.start
        for c in word:
            state = self.step[state].get(c) if c in self.step[state] else self._next(state, c)
            if state < 0:
                break
        found = None
        if state >= 0:
            near = [(e, self.word[n]) for n, e in self.states[state] if self.word[n] and e <= self.allowed[self.word[n]]]
            found = min(near, default=None)
        if stem and found is None:
            found = (-1, stem)
        self.memo[word] = found
        return found


def spans(text: str | None, automaton: LexiconAutomaton) -> list[tuple[int, int, str, int, bool]]:
    """(start, end, term, edits, quoted) of every match in a text."""
    text = text or ""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if not any(automaton.match(w) for w in set(LETTERS.findall(low))):
        return []
    out, before = [], []
    quotes, at = False, 0
    for m in LETTERS.finditer(low):
        for c in text[at : m.start()]:
            if c == '"':
                quotes = not quotes
            elif c in "“„«":
                quotes = True
            elif c in "”»\n":
                quotes = False
        at = m.end()
        found = automaton.match(m.group())
        if found:
            out.append((m.start(), m.end(), found[1], found[0], quotes or not SPEECH.isdisjoint(before)))
        before = [*before[1 - WINDOW :], m.group()]
    return out


def feature(found: list[tuple[int, int, str, int, bool]]) -> float:
    """Sum of matches, in halves up to TOP."""
    total = sum((QUOTED if quoted else 1.0) * (NEAR if edits else 1.0) for _, _, _, edits, quoted in found)
    return float(min(TOP, np.ceil(2 * total) / 2))


def _terms(words: list[str]) -> set[str]:
    out = set(words)
    for k in STEMS:
        out.update(w[:k] + "*" for w in words if len(w) > k)
    return out


def learn_lexicon(labelled: DataFrame) -> list[str]:
    """Terms and stems of toxic texts from (doc_id, text, toxic)."""

    def toxic(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                words = LETTERS.findall((text or "").lower())
                rows = set()
                for i, w in enumerate(words):
                    around = f"{words[i - 1] if i else ''} {words[i + 1] if i + 1 < len(words) else ''}"
                    rows.update((t, around, w) for t in _terms([w]))
                if rows:
                    yield pd.DataFrame([(doc, *x) for x in rows], columns=["doc", "term", "around", "word"])

    def clean(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count: Counter[str] = Counter()
        for pdf in parts:
            for text in pdf["text"]:
                count.update(_terms(list(set(LETTERS.findall((text or "").lower())))))
                if len(count) > 500_000:
                    yield pd.DataFrame({"term": list(count), "n": list(count.values())})
                    count.clear()
        if count:
            yield pd.DataFrame({"term": list(count), "n": list(count.values())})

    size = {bool(r["t"]): r["n"] for r in labelled.groupBy((F.col("toxic") == 1).alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = size.get(True, 0), size.get(False, 0)
    if not n1 or not n0:
        return []
    credit = stored(
        labelled.where("toxic = 1").select("doc_id", "text").mapInPandas(toxic, "doc long, term string, around string, word string")
        .groupBy("term", F.xxhash64("around").alias("around")).agg(F.min("doc").alias("doc"), F.min("word").alias("word"))
        .groupBy("term", "doc", "word").agg(F.count(F.lit(1)).alias("n")),
        "credit",
    )
    support = credit.groupBy("term").agg(F.count_distinct("doc").alias("pos"), F.count_distinct("word").alias("forms")).where("pos >= 3")
    stem = F.col("term").endswith("*")
    top = credit.where(stem).groupBy("term", "word").agg(F.count(F.lit(1)).alias("n")).groupBy("term").agg(F.max("n").alias("top"))
    support = support.join(top, "term", "left").where(~stem | ((F.col("forms") >= FORMS) & (2 * F.col("top") <= F.col("pos"))))
    support = stored(support, "support")
    tested = support.count()
    against = labelled.where("toxic <> 1").select("text").mapInPandas(clean, "term string, n long").groupBy("term").agg(F.sum("n").alias("neg"))
    rate = n1 / (n1 + n0)
    both = support.join(against, "term", "left").withColumn("neg", F.coalesce("neg", F.lit(0)))
    share = F.col("pos") / (F.col("pos") + F.col("neg"))
    ratio = 2 * (F.col("pos") * F.log(share / rate) + F.when(F.col("neg") > 0, F.col("neg") * F.log((1 - share) / (1 - rate))).otherwise(0.0))
    least = 10 + 2 * float(np.log(max(tested, 1)))
    kept = both.where((share > max(0.8, (1 + rate) / 2)) & (ratio >= least))
    found = [r["term"] for r in kept.select("term").collect()]
    # a word that a kept stem covers needs no entry of its own, and of nested stems the longer adds nothing
    stems = {t[:-1] for t in found if t.endswith("*")}
    covered = lambda t: any(t[:k] in stems for k in STEMS if k < len(t.rstrip("*")))
    return sorted(t for t in found if not (t.endswith("*") and covered(t)))


def _near_words(terms: list[str]):
    """(term, edits, toxic, n): texts in which a misspelled term was met."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = LexiconAutomaton(terms)
        count: Counter = Counter()
        for pdf in parts:
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                for t, e in {(t, e) for _, _, t, e, _ in spans(text, automaton) if e > 0}:
                    count[t, e, int(toxic == 1)] += 1
        yield pd.DataFrame([(*k, n) for k, n in count.items()], columns=["term", "edits", "toxic", "n"])

    return rows


def _counts(terms: list[str], allowed: dict[str, int]):
    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = LexiconAutomaton(terms, allowed)
        count: Counter = Counter()
        for pdf in parts:
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                count[feature(spans(text, automaton)), int(toxic == 1)] += 1
        yield pd.DataFrame([(*k, n) for k, n in count.items()], columns=["x", "toxic", "n"])

    return rows


def fit_curve(bins: list[tuple[float, int, int]]) -> list[float]:
    """Base and weight of the logistic curve over bins (x, toxic, n), by Newton steps with a small ridge."""
    if not bins:
        return [float(np.log(0.1 / 0.9)), 0.0]
    b = np.array(sorted(bins), float)
    x, y, n = np.c_[np.ones(len(b)), np.sqrt(b[:, 0])], b[:, 1], b[:, 2]
    w, ridge = np.zeros(2), np.diag([1e-3, 0.05])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (y - p)) - ridge @ w
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(hess, grad)
        w = w + step * min(1.0, 3 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    w[1:] = np.maximum(w[1:], 0)
    return w.tolist()


Model = tuple[list[str], dict[str, int], list[float]]


def fit(labelled: DataFrame) -> Model:
    """Lexicon, edits allowed for its words, and curve from (doc_id, text, toxic), which is stored for its passes."""
    labelled = stored(labelled, "labelled")
    terms = learn_lexicon(labelled)
    near = (
        labelled.select("text", "toxic").mapInPandas(_near_words(terms), "term string, edits int, toxic int, n long")
        .groupBy("term", "edits").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum("n").alias("all")).collect()
    )
    allowed = {t: edits_allowed(t) for t in terms if not t.endswith("*")}
    for r in near:
        if 2 * r["pos"] <= r["all"]:
            allowed[r["term"]] = min(allowed[r["term"]], r["edits"] - 1)
    bins = (
        labelled.select("text", "toxic").mapInPandas(_counts(terms, allowed), "x double, toxic int, n long")
        .groupBy("x", "toxic").agg(F.sum("n").alias("n")).collect()
    )
    discard(labelled)
    return terms, allowed, fit_curve([tuple(r) for r in bins])


def score_toxicity(docs: DataFrame, model: Model, *, threshold: float = 0.7) -> DataFrame:
    """docs without their text, with score, predicted and spans; one row for each row; columns of these names give way."""
    terms, allowed, curve = model
    kept = [c for c in docs.columns if c not in ("text", "score", "predicted", "spans")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = LexiconAutomaton(terms, allowed)
        for pdf in parts:
            found = [spans(t, automaton) for t in pdf["text"]]
            z = curve[0] + curve[1] * np.sqrt(np.array([feature(f) for f in found], float))
            out = pdf.drop(columns=["text"])
            out["score"] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            out["predicted"] = (out["score"] >= threshold).astype("int32")
            out["spans"] = [[{"start": a, "end": b, "term": t, "edits": e, "quoted": q} for a, b, t, e, q in f] for f in found]
            yield out

    return docs.select(*kept, "text").mapInPandas(
        judge, f"{fields}, score double, predicted int, spans array<struct<start:int,end:int,term:string,edits:int,quoted:boolean>>"
    )


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of documents with a label; several labels of a document count as one."""
    one = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "text").join(checked_broadcast(stored(one, "labels")), "doc_id")
