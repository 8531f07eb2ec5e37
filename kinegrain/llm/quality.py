"""Quality rules: base rules, then robust multivariate outliers by minimum covariance determinant.

Each text becomes five counts and a vector of transformed statistics. For every
language and source, the minimum-covariance-determinant estimate of centre and
scatter is found by concentration steps over all rows: start from medians and
median deviations, and once more from all rows' mean and scatter, keep the ``support`` share with the least Mahalanobis
distances, re-estimate from those, repeat until the kept rows stay the same; of both ends that with the least determinant
counts. A text is rejected if its distance
from its group's estimate is beyond ``cutoff``. Every step is a grouped sum or
quantile with partial aggregation, so a hot group only costs more map work.

Defined cases: null and empty text have no words and fail the base rules; groups
with fewer than ``min_group`` base-passing rows are pooled by language, then all
together; a pool that stays below ``min_group`` rejects nothing; null lang or
source are a group of their own; repeated rows are judged one by one and alike;
columns beyond doc_id, text, lang, source are kept by ``quality_filter``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_RE, checked_broadcast, discard, stored

SYMBOLS = "#*$%&|<>"
N_STATS = 5
#: Least standard deviation that a transformed statistic is given, in its own unit.
FLOOR = (0.35, 0.10, 0.03, 0.10, 0.12)
#: Squared distance beyond which a text goes. Far above the chi-square quantiles (35.9 at 0.999999): prose has heavy tails,
#: and one repeated line in a short clean text must not reject it.
CUTOFF = 60.0

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def text_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word."""
    text = text or ""
    words = WORD_RE.findall(text)
    n = len(words)
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if WORD_RE.search(line):
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    repeat = 0
    if n >= 3:
        ids: dict[str, int] = {}
        a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        if len(ids) < 2_000_000:
            v = len(ids)
            key = (a[:-2] * v + a[1:-1]) * v + a[2:]
        else:  # three factors would leave 63 bits
            pair = pd.factorize(a[:-1] * len(ids) + a[1:])[0].astype(np.int64)
            key = pair[:-1] * len(ids) + a[2:]
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        often = count[inverse] >= 2
        if often.any():
            cover = np.zeros(n, bool)
            cover[:-2] |= often
            cover[1:-1] |= often
            cover[2:] |= often
            repeat = int(cover.sum())
    symbols = sum(text.count(c) for c in SYMBOLS)
    return n, sum(map(len, words)), symbols, dup, repeat, lines


def _stats(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        rows = [text_counts(t) for t in pdf["text"]]
        c = np.array(rows, np.int64).reshape(-1, 6)
        n, chars, symbols, dup, repeat, lines = (c[:, k] for k in range(6))
        out = pdf.drop(columns=["text"])
        for k, name in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")):
            out[name] = c[:, k]
        one = np.maximum(n, 1)
        out["base_failed"] = (n < 50) | (100 * repeat > 50 * n)
        out["x0"] = np.log1p(n)
        out["x1"] = np.log(np.maximum(chars, 1) / one)
        out["x2"] = np.sqrt(symbols / np.maximum(chars, 1))
        out["x3"] = np.sqrt(dup / np.maximum(lines, 1))
        out["x4"] = np.sqrt(repeat / one)
        yield out


def row_key() -> Column:
    """A hash of all that is judged of a row; equal rows have equal keys."""
    mark = lambda c: F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("n"))
    return F.xxhash64(F.coalesce("text", F.lit("")), mark("lang"), mark("source"))


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, row_key, the five counts, base_failed, and the transformed statistics x0 to x4."""
    lang, source = F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")
    cols = docs.select("doc_id", "text", lang, source, row_key().alias("row_key"))
    kinds = dict(docs.dtypes)
    schema = f"doc_id {kinds['doc_id']}, lang string, source string, row_key long, {BASE}, base_failed boolean, " + ", ".join(
        f"x{k} double" for k in range(N_STATS)
    )
    return cols.mapInPandas(_stats, schema)


_X = [f"x{k}" for k in range(N_STATS)]
_PAIRS = [(i, j) for i in range(N_STATS) for j in range(i, N_STATS)]
_SUMS = [f"s{k}" for k in range(N_STATS)] + [f"p{i}{j}" for i, j in _PAIRS]
_MODEL = "model string, start int, mean array<double>, inv array<double>, det double"


def _sums() -> list[Column]:
    return [F.sum(x).alias(f"s{k}") for k, x in enumerate(_X)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in _PAIRS]


def _scatter(floor: tuple[float, ...], rescale: bool):
    """Pandas step over group rows: from sums to centre, inverse scatter and the logarithm of the scatter's determinant."""

    def step(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for row in pdf.to_dict("records"):
                n = max(row["n"], 1)
                mean = np.array([row[f"s{k}"] for k in range(N_STATS)]) / n
                cov = np.zeros((N_STATS, N_STATS))
                for i, j in _PAIRS:
                    cov[i, j] = cov[j, i] = row[f"p{i}{j}"] / n - mean[i] * mean[j]
                if rescale:  # the kept share's scatter is short by about this factor
                    cov *= 1.6
                cov += np.diag(np.square(floor))
                det = float(np.linalg.slogdet(cov)[1])
                out.append({"model": row["model"], "start": row["start"], "mean": mean.tolist(), "inv": np.linalg.inv(cov).ravel().tolist(), "det": det})
            yield pd.DataFrame(out, columns=["model", "start", "mean", "inv", "det"])

    return step


def _distance(mean: str = "mean", inv: str = "inv"):
    d = [F.col(x) - F.col(mean)[k] for k, x in enumerate(_X)]
    total = F.lit(0.0)
    for i, j in _PAIRS:
        total = total + (1.0 if i == j else 2.0) * F.col(inv)[i * N_STATS + j] * d[i] * d[j]
    return total


def _starts(stats: DataFrame, floor: tuple[float, ...]) -> DataFrame:
    """(model, start, mean, inv) of the starts of each model: 0 from medians and median deviations, 1 from all rows' mean and scatter."""
    med = [F.percentile_approx(x, 0.5, 2000).alias(f"m{k}") for k, x in enumerate(_X)]
    centre = stored(stats.groupBy("model").agg(*med, F.count(F.lit(1)).alias("n"), *_sums()), "mcd")
    dev = (
        stats.join(checked_broadcast(centre), "model")
        .groupBy("model")
        .agg(*[F.percentile_approx(F.abs(F.col(x) - F.col(f"m{k}")), 0.5, 2000).alias(f"d{k}") for k, x in enumerate(_X)])
    )
    inv = [F.lit(0.0)] * (N_STATS * N_STATS)
    for k in range(N_STATS):
        inv[k * N_STATS + k] = 1.0 / (F.pow(1.4826 * F.col(f"d{k}"), 2.0) + floor[k] ** 2)
    robust = centre.join(dev, "model").select("model", F.lit(0).alias("start"), F.array(*[F.col(f"m{k}") for k in range(N_STATS)]).alias("mean"), F.array(*inv).alias("inv"))
    plain = centre.select("model", F.lit(1).alias("start"), "n", *_SUMS).mapInPandas(_scatter(floor, False), _MODEL)
    return stored(robust.unionByName(plain.drop("det")), "mcd")


def mcd_models(stats: DataFrame, *, support: float = 0.75, steps: int = 12, floor: tuple[float, ...] = FLOOR) -> DataFrame:
    """(model, mean, inv) for each model key of stats (model, x0..x4), by concentration steps over all rows.

    Each model has two starts, which go through their steps together until the rows that they keep (told by their number and
    two hashes of them all) stay the same, or at most ``steps`` times. The start whose scatter has the least determinant stays.
    """
    model = _starts(stats, floor)
    last = None
    for _ in range(steps):
        near = stats.join(checked_broadcast(model), "model").select("model", "start", *_X, _distance().alias("d2"))
        cut = stored(near.groupBy("model", "start").agg(F.percentile_approx("d2", support, 2000).alias("cut")), "mcd")
        kept = near.join(checked_broadcast(cut), ["model", "start"]).where("d2 <= cut").groupBy("model", "start")
        marks = [F.bit_xor(F.xxhash64(*_X)).alias("mark"), F.sum(F.xxhash64(F.lit(7), *_X).cast("decimal(38,0)")).alias("mark2")]
        sums = stored(kept.agg(F.count(F.lit(1)).alias("n"), *_sums(), *marks), "mcd")
        new = stored(sums.select("model", "start", "n", *_SUMS).mapInPandas(_scatter(floor, True), _MODEL), "mcd")
        # one row stands for all models, so that only it comes to the driver
        now = sums.agg(F.bit_xor(F.xxhash64("model", "start", "n", "mark", "mark2"))).first()[0]
        discard(model, cut, sums)
        model = new
        if now == last:
            break
        last = now
    return model.groupBy("model").agg(F.min_by(F.struct("mean", "inv"), F.struct("det", "start")).alias("m")).select("model", "m.*")


def quality_verdicts(
    docs: DataFrame,
    *,
    support: float = 0.75,
    steps: int = 12,
    cutoff: float = CUTOFF,
    min_group: int = 50,
    floor: tuple[float, ...] = FLOOR,
) -> DataFrame:
    """doc_id, lang, source, the base counts, base_failed, d2 (null if not judged), kept; a row for each row of docs."""
    stats = stored(text_statistics(docs), "quality")
    null = F.lit("\x00")
    lang, source = F.coalesce("lang", null), F.coalesce("source", null)
    passing = stats.where("not base_failed")
    by_group = passing.groupBy(lang.alias("g_lang"), source.alias("g_source")).agg(F.count(F.lit(1)).alias("n"))
    by_group = stored(by_group, "quality")
    pool = by_group.where(F.col("n") < min_group).groupBy("g_lang").agg(F.sum("n").alias("pool"))
    models = stored(
        by_group.join(pool, "g_lang", "left").select(
            "g_lang",
            "g_source",
            F.when(F.col("n") >= min_group, F.concat_ws("\x1f", "g_lang", "g_source"))
            .when(F.col("pool") >= min_group, F.concat_ws("\x1f", "g_lang", F.lit("\x01")))
            .otherwise(F.lit("\x01"))
            .alias("model"),
        ),
        "quality",
    )
    keyed = passing.withColumns({"g_lang": lang, "g_source": source}).join(
        checked_broadcast(models), ["g_lang", "g_source"]
    )
    size = keyed.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    fit = mcd_models(keyed.select("model", *_X), support=support, steps=steps, floor=floor)
    fit = stored(fit.join(size.where(F.col("n") >= min_group), "model").drop("n"), "quality")
    judged = (
        stats.withColumns({"g_lang": lang, "g_source": source})
        .join(checked_broadcast(models), ["g_lang", "g_source"], "left")
        .join(checked_broadcast(fit), "model", "left")
    )
    d2 = F.when(~F.col("base_failed"), _distance())
    return judged.select(
        "doc_id",
        "lang",
        "source",
        "row_key",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        d2.alias("d2"),
        (~F.col("base_failed") & F.coalesce(d2 <= cutoff, F.lit(True))).alias("kept"),
    )


def quality_filter(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that quality_verdicts keeps, with all their columns.

    Rows are matched by doc_id and a hash of their text, lang and source, so a doc_id
    is dropped only in the rows that were rejected, and equal rows fare alike.
    """
    v = stored(quality_verdicts(docs, **how), "verdicts")
    bad = stored(v.where("not kept").select("doc_id", "row_key").distinct(), "rejected")
    discard(v)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", row_key().alias("row_key")).alias("r")
    on = F.col("r.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("r.row_key") == F.col("b.row_key"))
    return rows.join(checked_broadcast(bad).alias("b"), on, "left_anti").select("row.*")
