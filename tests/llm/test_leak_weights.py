"""Near copies of items that share their text, or a part of it, with others."""

import random

import pytest

from kinegrain.llm import decontaminate
from test_text_ops import prose


@pytest.mark.parametrize("ids", [1, 2, 10])
def test_near_copy_of_an_item_under_several_ids(spark, ids):
    words = prose(random.Random(12), 60).split()
    bench = spark.createDataFrame([(i, " ".join(words)) for i in range(ids)], "item_id long, text string")
    words[30] = "changed"
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    got = decontaminate.find_leaks(docs, bench).collect()
    assert {r.item_id for r in got} == set(range(ids)) and all(r.similarity == pytest.approx(51 / 61) for r in got)
    assert decontaminate.drop_leaks(docs, bench).count() == 0


def test_near_copy_of_items_with_a_common_preamble(spark):
    rng = random.Random(13)
    common = prose(rng, 40).split()
    items = [(i, common + [f"own{i}x{k}" for k in range(20)]) for i in range(10)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    near = list(items[3][1])
    near[20] = "changed"
    docs = spark.createDataFrame([(1, " ".join(near)), (2, " ".join(common + ["other"] * 20))], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()} == {(1, 3)}
