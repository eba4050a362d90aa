"""SpotSigs signatures, likeness and groups against brute force."""

import random
import re

import numpy as np
import pytest

from tessera.llm import spotsigs
from tessera.llm.spotsigs import ANCHORS, CHAIN, COMMON, fingerprints, lengths, likeness, read


def chains(text):
    """Signatures as tuples of words."""
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out = set()
    for k, x in enumerate(w):
        if x in ANCHORS:
            after = [y for y in w[k + 1 :] if y not in ANCHORS and y not in COMMON][:CHAIN]
            if len(after) == CHAIN:
                out.add((x, *after))
    return out or {tuple(w[k : k + 2]) for k in range(max(1, len(w) - 1))} if w else set()


def jaccard(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def text_of(rng, n, anchors=0.2):
    return " ".join(rng.choice(ANCHORS) if rng.random() < anchors else rng.choice(COMMON) if rng.random() < 0.1 else f"w{rng.randrange(3000)}" for _ in range(n))


def changed(rng, text, k):
    w = text.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = f"z{rng.randrange(3000)}"
    return " ".join(w)


def corpus(seed=3):
    rng = random.Random(seed)
    rows = [(i, text_of(rng, rng.choice([5, 30, 200, 900]))) for i in range(40)]
    for i in range(12):
        base = text_of(rng, 300)
        rows += [(100 + 20 * i + k, changed(rng, base, k)) for k in range(10)]
    hot = text_of(rng, 60)  # a passage that a third of all texts hold
    rows += [(1000 + k, f"{hot} {text_of(rng, rng.choice([5, 40, 120]))}") for k in range(120)]
    rows += [(2000, None), (2001, ""), (2002, "!? ..."), (2003, "ein"), (2004, "one two three four five six seven eight nine"), (2005, "one two three four five six seven eight ten")]
    rows += [(3000 + k, rows[k * 7][1]) for k in range(10)] + [rows[3], rows[3], (5, "the other text of this id is not the same one"), (None, rows[50][1]), (None, "the quick brown fox jumps over the lazy dog and runs"), (None, "x")]
    return rows


@pytest.mark.parametrize("one_by_one", [False, True])
def test_groups(spark, monkeypatch, one_by_one):
    if one_by_one:
        monkeypatch.setattr(spotsigs, "COMMON_FROM", 3)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, th string, component_id int").repartition(4)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, -1 if r.component_id is None else r.component_id) for r in fingerprints(docs).collect())
    sets, big = [chains(t) for _, t in rows], 1 << 62
    root = [big if i is None else i for i, _ in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.8]
    old = None
    while old != root:
        old = list(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    # rows of one id and text get one result
    want = sorted((-1 if i is None else i, len(t or ""), -1 if r == big else r) for (i, t), r in zip(rows, root))
    assert got == want and len(set(root)) < len(rows) - 60
    assert fingerprints(docs.limit(0)).count() == 0


def test_signatures_and_likeness(spark):
    rows = [r for r in corpus(9) if r[0] is not None and r[0] not in (5, 3)][:150]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in fingerprints(docs).collect():
        after = texts[max((i for i in texts if i < r.doc_id), default=max(texts))]
        own = texts[r.doc_id]
        other = own[: len(own) - len(own) // 2] + after[: len(own) // 2]
        assert len(read(r.fingerprint)) == len(chains(own)) and len(read(r.edited_fingerprint)) == len(chains(other))
        assert r.near_edited == pytest.approx(jaccard(chains(own), chains(other))) and r.near_next == pytest.approx(jaccard(chains(own), chains(after)))


def test_pruned_likeness_and_lengths():
    rng = np.random.default_rng(2)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 1500, rng.integers(0, 900)).astype(np.uint64)) for _ in "xy")
        if rng.random() < 0.5:
            y = np.unique(np.concatenate([x[: int(len(x) * rng.random())], y[: rng.integers(0, 50)]]))
        true = jaccard(set(x.tolist()), set(y.tolist()))
        for least in (0.0, 0.3, 0.8, 1.0):
            assert likeness(x, y, least) == (true if true >= least else 0.0)
    starts = lengths(0.8)
    part = lambda n: int(np.searchsorted(starts, n, "right")) - 1
    assert all(part(y) - part(x) in (0, 1) for x in range(1, 400) for y in range(x, int(x / 0.8 + 1e-9) + 1))


def test_one_id_with_many_texts(spark):
    rng = random.Random(1)
    rows = [(7, text_of(rng, 20)) for _ in range(300)] + [(i, text_of(rng, 20)) for i in range(100, 130)]
    out = fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    sizes = out.rdd.glom().map(len).collect()
    assert sum(sizes) == 330 and max(sizes) < 250
