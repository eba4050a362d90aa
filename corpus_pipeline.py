"""A corpus pipeline: quality, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads; all but the last keep the columns of
documents. run() writes each stage's result to the shared folder and reads it again, so a lost executor never costs
more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, materialize, table, unused
from tessera.llm.decontaminate import decontaminate
from tessera.llm.minhash import near_duplicates
from tessera.llm.packing import pack
from tessera.llm.quality import CUT, scorer, train
from tessera.llm.secrets import redact


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but for rows whose doc_id and text hash (th) are in gone."""
    id_, th = unused(docs, "gone_id", "gone_th")
    gone = gone.select(F.col("doc_id").alias(id_), F.col("th").alias(th))
    match = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(F.col("text").cast("string")) == F.col(th))
    return docs.join(gone, match, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.

    Every row is judged by its text alone, so repeated rows share their fate; a null or empty text is judged as an
    empty one, a very long one whole. A score of just the cut is accepted. Without positive labels all stay. Rows
    without doc_id teach nothing. All columns stay; an empty table stays empty.
    """
    score = scorer(train(docs, table(spark, sf_dir, "labels")))
    return docs.where(score("text") >= CUT)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near-duplicates: five words, a similarity of 0.8 or more.

    Of a group's rows with that id (or all without one) the text of least hash stays, in one row, the least by all
    columns. Texts without words, null ones among them, are in no group and all stay. Very long texts are compared
    whole. All columns stay, whatever their names; an empty table stays empty.
    """
    found = materialize(near_duplicates(docs).select("doc_id", "th", "kept", "root"))
    texts = found.where("kept and root is not null").groupBy("root", "doc_id", "th").agg(F.count(F.lit(1)).alias("n"))
    many = texts.groupBy("root").agg(F.min("th").alias("least"), F.sum("n").alias("rows")).where("rows > 1").drop("rows")
    texts = materialize(texts.join(many, "root"))
    twice = texts.where("th = least and n > 1")
    gone = found.where("not kept").select("doc_id", "th").union(texts.where("th != least or n > 1").select("doc_id", "th"))
    id_, th, other_id, other_th, whole = unused(docs, "key_id", "key_th", "twice_id", "twice_th", "whole")
    key = [F.col("doc_id").cast("long").alias(id_), F.xxhash64(F.col("text").cast("string")).alias(th)]
    again = twice.select(F.col("doc_id").alias(other_id), F.col("th").alias(other_th))
    copies = docs.select("*", *key).join(again, F.col(id_).eqNullSafe(F.col(other_id)) & (F.col(th) == F.col(other_th)), "left_semi")
    single = copies.groupBy(id_, th).agg(F.min(F.struct(*docs.columns)).alias(whole)).select(f"{whole}.*")  # one row a key leaves each task
    return _without(docs, gone).unionByName(single)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten words in a row with a benchmark item, nor a whole shorter item.

    Null or empty texts share nothing and stay; repeated rows share their fate; very long texts are read whole. All
    columns stay; an empty table stays empty, and an empty benchmark leaves all.
    """
    return _without(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret masked in text and n_chars of what is left.

    Null and empty texts stay as they are, n_chars of a null text null; repeated rows are masked alike, overlapping
    spans by one mask; very long texts are read whole. All other columns stay; an empty table stays empty.
    """
    masked = redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2048 tokens.

    Null or empty text is its end alone; longer documents are cut into pieces; repeated rows are packed each. Other
    columns are ignored; an empty table gives no pieces.
    """
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("minhash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("secret scan", secret_scan), ("best-fit packing", packing)]

#: SQL can't express the classifier, the tokenizer or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Scratch() as hold:
        for name, stage in STAGES:
            docs = stage(spark, docs, sf_dir)
            if name != STAGES[-1][0]:
                docs = hold(docs)
                hold.drop(*hold.tables[:-1])
        return docs  # packing reads tables of its own
