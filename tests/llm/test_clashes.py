"""Columns with the operators' own names, repeated rows, empty tables and long texts."""

import random

from kinegrain.llm import decontaminate, language_id, mixing, quality, toxicity
from test_text_ops import prose

EXTRA = "score string, predicted string, spans int, lang_pred long, k string, s long, size string, row_key string, row int, each int, piece int, taken string"
VALUES = ("a", "b", 1, 2, "c", 3, "d", "e", 4, 5, 6, "f")


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, *VALUES) for r in rows], f"doc_id long, text string, lang string, source string, {EXTRA}")


def test_own_names_in_the_input(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 60), "en", f"s{i % 2}") for i in range(12)] + [(1, "short", "en", "s1"), (3, prose(rng, 20_000), "en", None), (None, None, None, None)]
    docs = docs_of(spark, rows + rows[:1])
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and {tuple(r)[4:] for r in mixed.collect()} == {VALUES}
    good = quality.quality_filter(docs)
    assert good.columns == docs.columns and {tuple(r)[4:] for r in good.collect()} == {VALUES}
    # doc 1 stays in the row that is long enough
    assert sorted((r.doc_id, len(r.text) > 100) for r in good.collect()) == sorted([*((i, True) for i in range(12)), (0, True), (3, True)])
    items = spark.createDataFrame([(1, rows[2][1])], "item_id long, text string")
    left = decontaminate.drop_leaks(docs, items)
    assert left.columns == docs.columns and 2 not in {r.doc_id for r in left.collect()}
    model = ([], {}, [0.0, 0.0])
    scored = toxicity.score_toxicity(docs, model)
    assert scored.count() == len(rows) + 1 and dict(scored.dtypes)["score"] == "double" and {r.k for r in scored.collect()} == {"c"}
    protos = language_id.prototypes(docs)
    found = language_id.detect_language(docs, protos).collect()
    assert {r.lang_pred for r in found} == {"en", "und"} and {r.predicted for r in found} == {"b"}
    empty = docs.limit(0)
    assert language_id.detect_language(empty, protos).count() == 0 and toxicity.score_toxicity(empty, model).count() == 0
    assert mixing.mix(empty).count() == 0 and quality.quality_filter(empty).count() == 0 and decontaminate.drop_leaks(empty, items).count() == 0


def test_a_tie_goes_to_the_first_language(spark):
    docs = spark.createDataFrame([(1, "aba aba", "x"), (2, "aba aba", "y"), (3, "aba", None)], "doc_id long, text string, lang string")
    protos = language_id.prototypes(docs)
    assert {r.lang_pred for r in language_id.detect_language(docs, protos).collect()} == {"x"}
