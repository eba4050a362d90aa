"""Benchmark decontamination by winnowing, in DataFrame functions alone.

A fingerprint is the least hash of the word k-grams of a sliding window. Windows of the asked length hold enough
k-grams that equal windows of a document and of a benchmark item keep the same fingerprint, so joining fingerprints
finds every shared window. Around each hit the item's window is compared word by word with the document's. Items
shorter than a window are one window themselves, with all their words as the gram.

explode_outer keeps the optimizer from pushing a filter on the array below, where it would compute the array anew for
each element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, materialize, same

GRAM = 5
#: Benchmark fingerprints up to this number go to every executor; more are joined by a shuffle.
BROADCAST = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased; null has none."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def n_words_of(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), ""))


def gram_hashes(hashes: Column, n: int) -> Column:
    """Hashes of all runs of n entries, by start."""
    starts = F.when(F.size(hashes) >= n, F.sequence(F.lit(0), F.size(hashes) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.lit(n), *(hashes[i + j] for j in range(n))))


def kept(grams: Column, window: int) -> Column:
    """The least of each run of window entries."""
    starts = F.when(F.size(grams) >= window, F.sequence(F.lit(1), F.size(grams) - window + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.array_min(F.slice(grams, i, window))))


def hit_grams(hashes: Column, n: int, hits: Column) -> Column:
    """Place and hash of the runs of n entries whose hash is among hits."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(hashes) - n, F.lit(0)))
    grams = F.transform(starts, lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(n), *(F.get(hashes, i + j) for j in range(n))).alias("f")))
    return F.filter(grams, lambda p: F.array_contains(hits, p["f"]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated, th: a row for each input row.

    Null or empty text has no words and no hits; an item without words has no window. Items of one id count once,
    those without an id too: n_items counts them as one, items leaves them out. Repeated rows of documents get equal results, extra columns are ignored. An empty benchmark hits nothing, an
    empty table gives no rows.
    """
    gram = min(gram, window)
    source = keyed(docs)
    item_words = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).where("size(w) > 0")
    spans = F.when(F.size("w") >= window, F.transform(F.sequence(F.lit(1), F.size("w") - window + 1), lambda i: F.slice("w", i, window))).otherwise(F.array("w"))
    item_windows = materialize(item_words.select("item_id", F.explode_outer(spans).alias("v")).distinct())
    windows = item_windows.select("v", F.size("v").alias("n"), F.transform("v", lambda x: F.xxhash64(x)).alias("h")).distinct()
    short = sorted(r.n for r in windows.where(F.col("n") < window).select("n").distinct().collect())  # window - 1 numbers at most
    long_ = windows.where(F.col("n") == window).select("v", "n", gram_hashes(F.col("h"), gram).alias("g")).select("v", "n", "g", F.array_min("g").alias("f"))
    marks = long_.select("v", "n", "f", (F.array_position("g", F.col("f")) - 1).cast("int").alias("at"))
    for n in short:
        marks = marks.unionByName(windows.where(F.col("n") == n).select("v", "n", gram_hashes(F.col("h"), n)[0].alias("f"), F.lit(0).alias("at")))
    marks = materialize(marks)
    prints = marks.select("f").distinct()
    small = marks.count() <= BROADCAST
    near = F.broadcast if small else lambda df: df

    hashed = source.select("doc_id", "th", F.transform(words_of(F.col("text")), lambda x: F.xxhash64(x)).alias("h"))
    grams = hashed.select("doc_id", "th", "h", gram_hashes(F.col("h"), gram).alias("g"))
    own = [kept(F.col("g"), window - gram + 1), *(gram_hashes(F.col("h"), n) for n in short)]
    fingerprints = grams.select("doc_id", "th", (F.concat(*own) if short else own[0]).alias("f")).select("doc_id", "th", F.explode_outer("f").alias("f"))
    hits = materialize(fingerprints.join(near(prints), "f").groupBy("doc_id", "th").agg(F.collect_set("f").alias("hits")))

    s, x = source.alias("s"), hits.alias("x")
    joined = s.join(x, same(F.col("s.doc_id"), F.col("x.doc_id")) & (F.col("s.th") == F.col("x.th")), "left").select("s.doc_id", "s.th", n_words_of(F.col("s.text")).cast("long").alias("n_words"), F.when(F.col("x.hits").isNotNull(), words_of(F.col("s.text"))).alias("w"), "x.hits")
    every = [(gram, window), *((n, n) for n in short)]
    placed = joined.withColumn("h", F.transform("w", lambda v: F.xxhash64(v)))
    found = [hit_grams(F.col("h"), n, F.col("hits")) for n in sorted({n for n, _ in every})]
    places = F.transform(F.concat(*found) if len(found) > 1 else found[0], lambda p: F.struct(p["at"].alias("at"), p["f"].alias("f"), F.slice("w", F.greatest(p["at"] - window, F.lit(0)) + 1, 3 * window).alias("near")))
    traced = materialize(placed.select("doc_id", "th", "n_words", F.when(F.col("hits").isNotNull(), places).alias("places")))

    opened = traced.where("places is not null").select("doc_id", "th", F.inline("places")).withColumnRenamed("at", "pos").distinct()
    start = F.col("pos") - F.col("at")
    begins = start - F.greatest(F.col("pos") - window, F.lit(0))
    met = opened.join(near(marks), "f").where((begins >= 0) & (F.slice("near", F.greatest(begins, F.lit(0)) + 1, F.col("n")) == F.col("v")))
    met = materialize(met.select("doc_id", "th", start.alias("start"), "n", "v").distinct())
    covered = met.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "n")).alias("s")).select("doc_id", "th", F.size(F.array_distinct(F.flatten(F.transform("s", lambda x: F.sequence(x["start"], x["start"] + x["n"] - 1))))).cast("long").alias("n_hit"))
    which = met.select("doc_id", "th", "v").distinct().join(item_windows, "v").groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max(F.col("item_id").isNull().cast("long")).alias("nameless"))
    t, c, i = traced.alias("t"), covered.alias("c"), which.alias("i")
    on = lambda y: same(F.col("t.doc_id"), F.col(f"{y}.doc_id")) & (F.col("t.th") == F.col(f"{y}.th"))
    out = t.join(c, on("c"), "left").join(i, on("i"), "left").select("t.doc_id", "t.n_words", F.coalesce("c.n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("i.items", F.array().cast("array<string>")).alias("items"), F.coalesce("i.nameless", F.lit(0)).alias("nameless"), "t.th")
    return out.select("doc_id", "n_words", "n_hit", (F.size("items") + F.col("nameless")).cast("long").alias("n_items"), "items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "th")
