"""Near-duplicate documents by circulant MinHash.

Two permutations make the whole signature: sigma places each shingle on a circle of SLOTS slots, and pi, shifted
circularly by k, ranks the slots for coordinate k; the coordinate is the least rank of any shingle. Bands of
coordinates are the candidate keys; links are confirmed on whole shingle sets.

Documents with equal sets form a class, and only one of each class is banded. Members of a bucket are linked through
hubs (see linking); pairs within a component are never enumerated. Before texts are fetched, four bits of each of
COORDINATES coordinates must agree nearly as often as they would at the threshold. A pair at the threshold shares no
bucket, or fails that test, with a probability of about MISS.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, Scratch, WordHashes, ascii_lower, batches, keyed, lean, materialize, mixed, records, shingle_set
from .linking import bucketed, link

#: Slots of the circle; with far longer documents than this the keys select less, but links stay exact.
SLOTS = 1 << 22
#: Coordinates a band has, and the probability of a missed link at the threshold.
ROWS, MISS = 5, 1e-6
#: Coordinates that are compared, by four bits of each, and the standard deviations they may fall short.
COORDINATES, SIGMAS = 128, 5
WORDS = [f"q{i}" for i in range(COORDINATES // 16)]
DIFFERENCE = 512
MAPS = [f"d{i}" for i in range(DIFFERENCE // 64)]


def bands_for(threshold: float) -> int:
    """Bands so that a pair at the threshold meets in none with probability MISS at most."""
    return math.ceil(math.log(MISS) / math.log1p(-(threshold**ROWS)))


def most_differing(threshold: float) -> int:
    """Compared coordinates that may differ in a pair at the threshold."""
    p = (1 - threshold) * 15 / 16
    return math.ceil(COORDINATES * p + SIGMAS * math.sqrt(COORDINATES * p * (1 - p)))


def differing(x: str, y: str):
    """Number of the compared coordinates whose four bits differ between the rows x and y."""
    total = F.lit(0)
    for w in WORDS:
        v = F.col(f"{x}.{w}").bitwiseXOR(F.col(f"{y}.{w}"))
        v = v.bitwiseOR(F.shiftrightunsigned(v, 2))
        v = v.bitwiseOR(F.shiftrightunsigned(v, 1))
        total = total + F.bit_count(v.bitwiseAND(F.lit(0x1111111111111111)))
    return total


@functools.lru_cache(maxsize=2)
def _ranks(width: int) -> np.ndarray:
    """Row i: pi at the slots i, i+1, ... on the circle, thus the ranks of slot i for all coordinates."""
    pi = np.random.default_rng(20240501).permutation(np.arange(SLOTS, dtype=np.uint32))
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:width]]), width)


def signature(shingles: np.ndarray, width: int) -> np.ndarray:
    ranks = _ranks(width)
    slots = (mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - 22)).astype(np.int64)
    least = np.full(width, SLOTS, np.uint32)
    for at in range(0, len(slots), 2048):
        np.minimum(least, ranks[slots[at : at + 2048]].min(axis=0), out=least)
    return least


_SKETCH = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), *((w, pa.int64()) for w in WORDS), ("keys", pa.list_(pa.int64()))])


def _sketches(n: int, bands: int):
    width = max(COORDINATES, bands * ROWS)

    def run(frames):
        words = WordHashes()

        def rows():
            for doc_id, th, text in records(frames):
                s = shingle_set(words.of(ascii_lower(text).split()), n)
                if not len(s):
                    yield doc_id, th, 0, None, *[None] * len(WORDS), None
                    continue
                sig = signature(s, width)
                keys = band_keys(sig, bands)
                low = (sig[:COORDINATES] & 15).astype(np.uint8)
                low = (low[::2] << 4 | low[1::2]).view(np.int64).tolist()
                yield doc_id, th, len(s), xxhash.xxh3_128_digest(s.tobytes()), *low, keys

        yield from batches(rows(), _SKETCH)

    return run


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """One key a band, of its coordinates and its number."""
    parts = sig[: bands * ROWS].reshape(bands, ROWS).astype(np.uint64)
    acc = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        acc = mixed(acc ^ parts[:, j])
    return acc.view(np.int64)


_COMPARED = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("linked", pa.bool_()), *((w, pa.int64()) for w in MAPS)])


def _compare(n: int, numerator: int, denominator: int):
    """Whether denominator * intersection >= numerator * union for whole sets, and the bitmap of their difference."""

    def run(frames):
        words, last = WordHashes(), (None, None)

        def rows():
            nonlocal last
            for a, b, text_a, text_b in records(frames):
                if last[0] != a:
                    last = a, shingle_set(words.of(ascii_lower(text_a).split()), n)
                x, y = last[1], shingle_set(words.of(ascii_lower(text_b).split()), n)
                apart = np.setxor1d(x, y, assume_unique=True)
                both = (len(x) + len(y) - len(apart)) // 2
                bits = np.zeros(DIFFERENCE, bool)
                bits[(mixed(apart) >> np.uint64(55)).astype(np.int64)] = True
                yield a, b, denominator * both >= numerator * (both + len(apart)), *np.packbits(bits).view(np.int64).tolist()

        yield from batches(rows(), _COMPARED, 1024)

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, th and root, one row for each input row; columns besides doc_id and text are ignored.

    Linked are documents whose sets of lower-cased word shingles have denominator * intersection >= numerator * union.
    Null, empty or blank text: no shingles, a component of its own. Fewer words than a shingle: their sequence is the
    one shingle. Very long texts are taken whole. Equal texts, repeated rows included, are linked; rows that tie for a
    group's least doc_id are all marked as kept. A null doc_id counts as larger than any other and comes back as null.
    An empty table gives no rows.

    root tells components apart where ids repeat or are null; it is null for rows without shingles.
    """
    threshold = numerator / denominator
    bands = bands_for(threshold)
    source = keyed(docs)
    texts = source.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    with Scratch() as hold:
        sketches = hold(source.mapInArrow(lean(_sketches(shingle, bands)), f"doc_id long, th long, n_shingles long, set_id binary, {' long, '.join(WORDS)} long, keys array<long>").withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))))
        filled = sketches.where("n_shingles > 0")
        classes = hold(filled.groupBy("set_id").agg(F.min("doc_id").alias("least")))
        picked = filled.join(classes, (filled.set_id == classes.set_id) & (filled.doc_id == classes.least)).select(filled.set_id, "doc_id", "th", "n_shingles", *WORDS, "keys").dropDuplicates(["set_id"])
        picked = hold(picked)

        rows = bucketed(picked.select("set_id", F.explode("keys").alias("key")), picked.select("set_id", "n_shingles", *WORDS), hold)
        # the whole texts move once; later only those of nodes that share a key with another
        where = rows.select("set_id").distinct().join(picked.select("set_id", "doc_id", "th"), "set_id")
        texts = hold(texts.join(where.hint("merge"), ["doc_id", "th"]).select("set_id", "text").dropDuplicates(["set_id"]))

        def may(x: str, y: str) -> Column:
            return differing(x, y) <= most_differing(threshold)

        def verify(pairs: DataFrame) -> DataFrame:
            ends = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
            held = hold(texts.join(ends.hint("merge"), "set_id", "left_semi"))
            left, right = held.select(F.col("set_id").alias("a"), F.col("text").alias("text_a")), held.select(F.col("set_id").alias("b"), F.col("text").alias("text_b"))
            both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
            return both.mapInArrow(lean(_compare(shingle, numerator, denominator)), f"a binary, b binary, linked boolean, {' long, '.join(MAPS)} long")

        def refine(rows: DataFrame, hubs: DataFrame, first: DataFrame) -> tuple[DataFrame, Column]:
            # the first step compared most members of a bucket with its hub; the others have no bitmap and pass
            own = rows.join(hubs, "key").withColumn("a", F.least("hub", "set_id")).withColumn("b", F.greatest("hub", "set_id"))
            own = own.join(first.select("a", "b", *MAPS), ["a", "b"], "left").drop("a", "b", "hub")
            apart = sum((F.bit_count(F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}"))) for w in MAPS), F.lit(0))
            bound = (numerator + denominator) * apart <= (denominator - numerator) * (F.col("x.n_shingles") + F.col("y.n_shingles"))
            return own, F.coalesce(bound, F.lit(True))

        roots = link(rows, ["n_shingles", *WORDS], may, verify, refine, hold)
        labels = classes.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
        least = labels.groupBy("root").agg(F.min("least").alias("component_id"))
        labels = labels.join(least, "root").select("set_id", "component_id", "root")
        real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
        out = sketches.select("doc_id", "th", "n_shingles", "set_id").join(labels, "set_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
        return materialize(out.select(real("doc_id").alias("doc_id"), "n_shingles", real("component_id").alias("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"), "th", "root"))
