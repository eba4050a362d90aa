"""The classifier's cut follows all unlabelled training documents, not the sample that it is fitted on."""

import math
import random

import numpy as np

from tessera.llm import quality


def test_cut_of_all_unlabelled(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 40)
    rng = random.Random(2)
    word = lambda bad: "".join(rng.choice("abcdefgh" if rng.random() > bad else "$#%|!9") for _ in range(rng.randint(2, 8)))
    rows = [(i, " ".join(word(i % 7 / 8) for _ in range(60))) for i in range(900)]
    docs = spark.createDataFrame([*rows, *rows[:50]], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 7 < 3), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    ours = {r.doc_id for r in docs.select("doc_id").where(quality.in_training(4, 2)).collect()}
    x = np.sort(model.margin(np.array([np.float32(quality.features(t)) for i, t in rows if i in ours and i >= 200], float)))
    m = len(x) // 200
    lo, hi = int((1 - model.prior - quality.REACH) * len(x)), int((1 - model.prior + quality.REACH) * len(x)) + m
    k = lo + int((x[lo + m : hi + 1] - x[lo : hi + 1 - m]).argmax())
    assert abs(math.log(0.7 / 0.3) - model.shift - (x[k] + x[k + m]) / 2) < 1e-3


def test_prior_of_positives_and_unlabelled(spark):
    """The share of positives is found without a negative label, and the cut leaves that share above it."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    true = labels.agg({"quality": "avg"}).first()[0]
    model = quality.train(docs, labels)
    assert abs(model.prior - true) < 0.04
    score = quality.scorer(model)
    known = docs.join(labels, "doc_id")
    assert abs(known.where(score("text") >= quality.CUT).count() / known.count() - true) < 0.02
    # labelled negatives that count as unlabelled lower the share among the unlabelled
    model = quality.train(docs, labels.where("quality = 1"))
    free, bad = docs.count() - known.count(), known.where("quality = 0").count()
    assert abs(model.prior - free * true / (free + bad)) < 0.04


def test_every_unlabelled_row_counts(spark, monkeypatch):
    """Prototypes stand for all rows: counts add up and their weighted mean is the mean of all."""
    monkeypatch.setattr(quality, "PROTOTYPES", 16)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, quality.FEATURES)).astype(np.float32)
    rows = spark.createDataFrame([(i, bytes(v.tobytes())) for i, v in enumerate(x)], "doc_id long, x binary").repartition(4)
    means, n = quality.summary(rows)
    assert len(n) == 16 and n.sum() == 700 and np.allclose(n @ means / 700, x.mean(axis=0), atol=1e-5)
    monkeypatch.setattr(quality, "PROTOTYPES", 5000)
    means, n = quality.summary(rows)
    assert (n == 1).all() and np.allclose(np.sort(means[:, 0]), np.sort(x[:, 0]))
