"""Benchmark items without an id are hit like any other; as in the query's SQL they count as one item and are not listed."""

import hashlib

from tessera.llm.decontaminate import decontaminate


def test_items_without_id(spark):
    passage = " ".join(f"w{k}" for k in range(14))
    bench = spark.createDataFrame([(None, passage), (None, "only these four words"), (5, passage)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"a {passage} b"), (2, "x only these four words y"), (3, "nothing")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, list(r["items"]), r.items_sha256, r.contaminated) for r in decontaminate(docs, bench).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {1: (14, 2, ["5"], sha("5"), True), 2: (4, 1, [], sha(""), True), 3: (0, 0, [], sha(""), False)}
