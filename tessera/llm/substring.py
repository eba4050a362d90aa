"""Removal of word windows that occur more than once, by level-wise doubling.

The first level takes short windows, of BASE words, and of these only the ones that are the least hash of some run of
target - BASE + 1 of them: equal target windows pick the same one at the same place, so none is lost, and under a
tenth of all positions is moved. Windows repeated at one length alone are extended, to the right and to the left, to
twice that length, and only those repeated again go on; the last step takes every target window around a survivor.
No text but that of documents with survivors is read again.

Documents of the same word sequence form a class; one of each takes part for all. Lengths double while every target
window around a survivor holds one of its two extensions, which is so for a target of 3 * length - 1 words or more.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, ascii_words, batches, grams, keyed, lean, materialize, mixed, records, same

BASE = 9

_PROFILE = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_words", pa.int64()), ("content", pa.binary()), ("whole_sha256", pa.string()), ("starts", pa.list_(pa.int32())), ("hashes", pa.list_(pa.int64()))])
_WINDOWS = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("starts", pa.list_(pa.int32())), ("hashes", pa.list_(pa.int64())), ("checks", pa.list_(pa.int64()))])
_KEPT = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
_DDL = {id(_PROFILE): "doc_id long, th long, n_words long, content binary, whole_sha256 string, starts array<int>, hashes array<long>", id(_WINDOWS): "doc_id long, th long, starts array<int>, hashes array<long>, checks array<long>", id(_KEPT): "doc_id long, th long, n_removed long, kept_sha256 string"}


def lengths(target: int, base: int = BASE) -> list[int]:
    """Window lengths of the levels, the target last."""
    out = [min(base, target)]
    while out[-1] < target:
        out.append(2 * out[-1] if 3 * out[-1] - 1 <= target else target)
    return out


def picked(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the leftmost least entry of every run of window entries of h."""
    if len(h) < window:
        return np.empty(0, np.int64)
    best, at, span = h.copy(), np.arange(len(h)), 1
    while span < window:  # a run's least entry is that of two overlapping runs of half the length or more
        step = min(span, window - span)
        m = len(best) - step
        take = best[step:] < best[:m]
        best, at, span = np.where(take, best[step:], best[:m]), np.where(take, at[step:], at[:m]), span + step
    return np.unique(at)


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _profiles(target: int, base: int):
    def run(frames):
        cache = WordHashes()

        def rows():
            for doc_id, th, text in records(frames):
                words = ascii_words(text)
                h = cache.of(words)
                g = grams(h, base) if len(h) >= target else h[:0]
                at = picked(g, target - base + 1)
                yield doc_id, th, len(words), xxhash.xxh3_128_digest(b"\n".join(words)) if len(words) >= target else None, _sha(words), at.astype(np.int32), g[at].view(np.int64)

        yield from batches(rows(), _PROFILE)

    return run


def _extend(length: int, longer: int, last: bool):
    """Windows of the longer length around survivors: both extensions, or for the last level all."""

    def run(frames):
        cache = WordHashes()

        def rows():
            for doc_id, th, text, places in records(frames):
                h = cache.of(ascii_words(text))
                q = np.array(places, np.int64)
                shifts = np.arange(longer - length + 1) if last else np.array([0, longer - length])
                starts = np.unique((q[:, None] - shifts[None, :]).ravel())
                starts = starts[(starts >= 0) & (starts + longer <= len(h))]
                if not len(starts):
                    continue
                yield doc_id, th, starts.astype(np.int32), grams(h, longer)[starts].view(np.int64), grams(mixed(h), longer)[starts].view(np.int64)

        yield from batches(rows(), _WINDOWS, 512)

    return run


def _remove(target: int):
    def run(frames):
        def rows():
            for doc_id, th, text, starts in records(frames):
                words = ascii_words(text)
                edge = np.zeros(len(words) + 1, np.int64)
                s = np.unique(np.array(starts, np.int64))
                edge[s] += 1
                edge[s + target] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                yield doc_id, th, int(gone.sum()), _sha([w for w, g in zip(words, gone.tolist()) if not g])

        yield from batches(rows(), _KEPT)

    return run


def remove_repeats(docs: DataFrame, target: int = 35, base: int = BASE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and th, one row for each input row; columns besides doc_id and text are ignored.

    Removed is each word in a window of target words whose sequence also starts elsewhere, in the same document or
    another; repeated rows count as documents of their own, and of equal windows, ties, none is spared. Null or empty
    text: no words, the hash of an empty string. Texts under target words lose nothing; very long ones are taken whole.
    An empty table gives no rows.
    """
    source = keyed(docs)
    levels = lengths(target, base)
    with Scratch() as hold:
        profile = hold(source.mapInArrow(lean(_profiles(target, levels[0])), _DDL[id(_PROFILE)]))
        copies = profile.where("content is not null").groupBy("content").agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("d")).where("n > 1")
        copies = hold(copies)
        twin = profile.where("content is not null").select("doc_id", "th", "content").join(copies, "content")
        twin = hold(twin.select("doc_id", "th", (F.coalesce("doc_id", F.lit(-(2**63))) == F.col("d")).alias("first")).distinct())
        # of each class the rows of the least doc_id take part; where these are several, they only count themselves twice
        others = twin.where("not first").select("doc_id", "th")
        rows = profile.where("size(starts) > 0").select("doc_id", "th", "starts", "hashes")
        rows = rows.alias("r").join(others.alias("o"), same(F.col("r.doc_id"), F.col("o.doc_id")) & (F.col("r.th") == F.col("o.th")), "left_anti")
        windows = rows.select("doc_id", "th", F.arrays_zip("starts", "hashes").alias("w"))
        windows = windows.select("doc_id", "th", F.inline("w")).withColumnsRenamed({"starts": "start", "hashes": "h"}).withColumn("c", F.lit(0).cast("long"))
        texts = source
        for k, length in enumerate(levels):
            # counted in part by each task and written, so that the join reads two plain shuffles and adaptive execution can split a window that many documents hold
            again = hold(windows.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
            found = hold(windows.join(again, ["h", "c"]).groupBy("doc_id", "th").agg(F.collect_set("start").alias("places")))  # repeated rows add nothing
            hold.drop(again, windows)
            held = _of(texts.alias("t"), found.alias("f"))
            if length == target:
                break
            old, held = texts, hold(held)
            hold.drop(old, found)
            texts = held
            last = levels[k + 1] == target
            longer = held.mapInArrow(lean(_extend(length, levels[k + 1], last)), _DDL[id(_WINDOWS)])
            windows = hold(longer.select("doc_id", "th", F.inline(F.arrays_zip("starts", "hashes", "checks"))).toDF("doc_id", "th", "start", "h", "c"))
        kept = held.mapInArrow(lean(_remove(target)), _DDL[id(_KEPT)])
        part = kept.join(twin.withColumn("twin", F.lit(True)).drop("first"), (same(kept.doc_id, twin.doc_id)) & (kept.th == twin.th), "left_anti")
        whole = twin.select("doc_id", "th", F.lit(-1).cast("long").alias("n_removed"), F.sha2(F.lit(""), 256).alias("kept_sha256"))
        changed = part.unionByName(whole)
        p, x = profile.alias("p"), changed.alias("x")
        out = p.join(x, same(F.col("p.doc_id"), F.col("x.doc_id")) & (F.col("p.th") == F.col("x.th")), "left")
        gone = F.when(F.col("x.n_removed") < 0, F.col("p.n_words")).otherwise(F.coalesce("x.n_removed", F.lit(0)))
        return materialize(out.select("p.doc_id", "p.n_words", gone.cast("long").alias("n_removed"), F.coalesce("x.kept_sha256", "p.whole_sha256").alias("kept_sha256"), "p.th"))


def _of(texts: DataFrame, found: DataFrame) -> DataFrame:
    """Texts (alias t) with their places (alias f)."""
    match = same(F.col("t.doc_id"), F.col("f.doc_id")) & (F.col("t.th") == F.col("f.th"))
    return texts.join(found, match).select("t.doc_id", "t.th", "t.text", "f.places")
