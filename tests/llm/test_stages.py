"""Every stage of the pipeline with nulls, empty texts, repeated rows, an empty table, and extra columns whose names clash."""

import pytest

import corpus_pipeline

CLASH = ["gone_id", "gone_th_", "key_id", "key_th", "twice_id", "whole", "masked_id", "masked_cuts_", "th", "n", "start", "root", "kept", "hits", "tessera_id", "w", "x"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("stage")
    spark.createDataFrame([(i, i % 3 // 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (None, "a short item"), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def rows():
    plain = [f"The text of number {i} tells of {i * 7} things and of word{i} word{i + 1} more word{i + 2}." for i in range(40)]
    texts = [(i, t) for i, t in enumerate(plain)] + [(100, None), (101, ""), (102, " \n"), (None, None), (None, "without an id but with password: hunter22x and words"), (7, plain[7]), (7, plain[7]), (None, "without an id but with password: hunter22x and words"), (103, "x one two three four five six seven eight nine ten y"), (104, "there is a short item here"), (105, "long " * 30_000 + "token=abcdef123456")]
    return [(i, t, "en", "s", None if t is None else len(t), *(k for k in range(len(CLASH)))) for i, t in texts]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in CLASH)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage(spark, sf_dir, name, stage):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    out = stage(spark, docs, sf_dir)
    got = out.collect()
    empty = stage(spark, docs.limit(0), sf_dir)
    assert empty.count() == 0 and empty.columns == out.columns
    if name == corpus_pipeline.STAGES[-1][0]:
        assert sorted(str(r.doc_id) for r in got if r.piece == 0) == sorted(str(r[0]) for r in rows())
        return
    assert out.columns == docs.columns
    kept = sorted((str(r.doc_id), str(r.text)) for r in got)
    every = sorted((str(r[0]), str(r[1])) for r in rows())
    if name == "secret scan":
        masked = [(i, t.replace("password: hunter22x", "[SECRET]").replace("token=abcdef123456", "[SECRET]")) for i, t in every]
        assert kept == sorted(masked) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    else:
        assert set(kept) <= set(every) and all(tuple(r)[5:] == tuple(range(len(CLASH))) for r in got)
    if name == "benchmark decontamination":
        assert kept == sorted(x for x in every if x[0] not in ("103", "104"))
    if name == "minhash near-dedup":
        assert kept == sorted({*every, ("None", "None"), ("100", "None")}) and kept.count(every[0]) == 1
