"""Large families of copies, hot keys, and the ways beyond what is broadcast."""

import random

import pytest

from tessera.llm import common, linking, minhash, substring


@pytest.fixture
def no_broadcast(spark, monkeypatch):
    """As if every table were larger than what executors are sent."""
    monkeypatch.setattr(linking, "SHARE", 16)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def grouped(rows, shingle, numerator):
    sets = []
    for _, t in rows:
        w = t.split()
        sets.append({" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))})
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in enumerate(sets):
        for b in range(a):
            y = sets[b]
            if 100 * min(len(x), len(y)) >= numerator * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= numerator * (len(x) + len(y) - both):
                    p, q = top(a), top(b)
                    root[max(p, q)] = min(p, q)
    return {i: rows[top(k)][0] for k, (i, _) in enumerate(rows)}


def family(rng, n, words, edits, first):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for k in range(n):
        w = list(base)
        for at in rng.sample(range(words), edits):
            w[at] = f"e{rng.randrange(10**6)}"
        out.append((first + k, " ".join(w)))
    return out


def test_families_at_the_threshold(spark, no_broadcast):
    """Two families of copies of texts that are not there: members mostly above the threshold, and mostly below."""
    rng = random.Random(4)
    rows = family(rng, 250, 200, 3, 0) + family(rng, 250, 200, 7, 1000) + family(rng, 250, 200, 8, 2000)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 3, 85).collect()}
    want = grouped(rows, 3, 85)
    assert got == want and 3 < len(set(want.values())) < 700


def test_hot_passage(spark, no_broadcast):
    """A passage that a third of all documents hold, and another that many rows of one id hold."""
    rng = random.Random(6)
    word = lambda: f"v{rng.randrange(10**6)}"
    hot = [word() for _ in range(40)]
    rows = [(i, " ".join([*(word() for _ in range(30)), *(hot if i % 3 == 0 else ()), *(word() for _ in range(10))])) for i in range(300)] + [(7, " ".join([*hot, word()])) for _ in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring.remove_repeats(docs, 35).collect())
    assert got == sorted((i, len(t.split()), 40 if " ".join(hot) in t else 0) for i, t in rows)


def test_component_chain_and_star_without_broadcast(spark, no_broadcast):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 300)] + [(1500, 1100)]
    got = dict((r.node, r.root) for r in linking.connected(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (1000, 1200, 1500)} == {1000} and len(got) == 342


def test_tables_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    docs = spark.createDataFrame([(i, f"a b c d e f g {i // 2}") for i in range(20)], "doc_id long, text string")
    assert minhash.near_duplicates(docs).count() == substring.remove_repeats(docs).count() == 20
    assert len(list(tmp_path.iterdir())) == 2
    with pytest.raises(ZeroDivisionError), common.Scratch() as hold:
        hold(docs)
        raise ZeroDivisionError
    assert len(list(tmp_path.iterdir())) == 2
