"""The pipeline's near-dedup keeps one row of each group where ids repeat or are null."""

import random

import corpus_pipeline


def test_repeated_and_null_ids(spark):
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice("abcdefghij") * rng.randint(1, 5) for _ in range(80))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(7, a)] * 40 + [(7, a + " end"), (9, a), (7, b), (7, b), (None, c), (None, c), (None, c + " end"), (None, d), (20, e), (21, e), (1, ""), (1, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").repartition(3)
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    first = lambda t: sum(x is not None and x in (t, t + " end") for _, x in got)
    assert [first(t) for t in (a, b, c, d, e)] == [1] * 5 and len(got) == 8 and set(got) <= set(rows)
    assert {(7, b), (None, d), (20, e)} <= set(got) and (9, a) not in got and got.count((1, "")) == 2 and got.count((None, None)) == 1
