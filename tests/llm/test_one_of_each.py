"""One row of each component, also where a doc_id repeats."""

import random

from kinegrain.llm import jaccard_join
from test_text_ops import prose


def test_one_of_each_keeps_every_component_of_a_repeated_id(spark):
    rng = random.Random(11)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    rows = [(1, a), (1, b), (1, ""), (1, None), (2, f"{a} more"), (3, a), (3, c), (4, c.upper()), (5, d), (5, d), (None, a)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, _key string")
    left = jaccard_join.one_of_each(docs, size=5, num=80, den=100)
    assert left.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text or "") for r in left.collect())
    assert got == sorted([(0, a), (1, a), (1, b), (1, ""), (3, c), (5, d)])
