"""Document fingerprints by SpotSigs.

After each anchor, a very common word, the next CHAIN content words (neither anchors nor other common words) form a
signature; a document's fingerprint is its set of signatures, sorted. Texts without a full chain are signed by their
pairs of neighbouring words.

Near pairs of the whole corpus are found by length: sets are dealt to partitions whose bounds grow by the threshold,
so that an alike pair lies in one partition or in two that follow each other. Within a partition sets meet by the
signatures of their prefix, rare ones first, and are compared by a Jaccard likeness that stops as soon as what is left
can't reach the threshold.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, NO_ID, Scratch, WordHashes, ascii_lower, batches, grams, lean, mixed, records, slices
from .linking import bucketed, link

CHAIN = 3
# Anchors, and further common words that are no content, of English, German, French and Spanish.
ANCHORS = "the a is was to of der die das ist ein eine le la les est un une el los es una de".split()
COMMON = "and in that it for on with as be by this at are from or an he his und den von zu mit sich des auf für nicht et des que qui dans pour sur au en y que por con para del se al lo".split()
_STRIP = bytes(0x20 if c < 0x80 and not (0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A) else c for c in range(256))


#: Bits of a set's bitmap, and signatures that may be known as frequent (8 MB for every worker).
BITS, FREQUENT = 512, 1_000_000
MAPS = [f"m{i}" for i in range(BITS // 64)]
#: Documents of one prefix signature from which on it may be put behind rarer ones.
COMMON_FROM = 64


class Marked(WordHashes):
    """word -> 64-bit hash; the lowest two bits tell anchors (3) and other common words (1) from content (0)."""

    def __init__(self):
        super().__init__()
        self.marks = {w.encode(): 1 for w in COMMON} | {w.encode(): 3 for w in ANCHORS}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word) & ~3 | self.marks.get(word, 0)
        return h


class Signer:
    """Texts -> sorted signatures of 64 bits. Texts without a full chain are signed by their pairs of words, a lone word by itself; blank ones by nothing."""

    def __init__(self):
        self.words = Marked()

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        parts = [ascii_lower(t).translate(_STRIP).split() for t in texts]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        h = self.words.of([w for p in parts for w in p])
        text = np.repeat(np.arange(len(parts)), sizes)
        plain = h & np.uint64(3) == 0
        content, of_content = h[plain], text[plain]
        at = np.flatnonzero(h & np.uint64(3) == 3)
        start = np.cumsum(plain)[at]
        whole = start + CHAIN <= len(content)
        at, start = at[whole], start[whole]
        whole = of_content[start + CHAIN - 1] == text[at]
        at, start = at[whole], start[whole]
        acc, owner = h[at], text[at]
        for j in range(CHAIN):
            acc = mixed(acc ^ content[start + j])
        bare = sizes > 0
        bare[owner] = False
        after = np.cumsum(sizes)
        for i in np.flatnonzero(bare).tolist():
            pairs = grams(h[after[i] - sizes[i] : after[i]], min(2, int(sizes[i])))
            acc, owner = np.concatenate([acc, pairs]), np.concatenate([owner, np.full(len(pairs), i)])
        order = np.lexsort([acc, owner])
        acc, owner = acc[order], owner[order]
        new = np.ones(len(acc), bool)
        new[1:] = (acc[1:] != acc[:-1]) | (owner[1:] != owner[:-1])
        acc, owner = acc[new], owner[new]
        return np.split(acc, np.searchsorted(owner, np.arange(1, len(parts)))) if parts else []


def short(signatures: np.ndarray) -> np.ndarray:
    """A fingerprint's signatures, of 32 bits."""
    out = (signatures >> np.uint64(32)).astype(np.uint32)
    return out[np.flatnonzero(np.diff(out, prepend=~out[:1]))]


def written(signatures: np.ndarray) -> str:
    return base64.b64encode(signatures.astype(">u4").tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u4").astype(np.uint32)


def likeness(x: np.ndarray, y: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two sorted sets; 0 where it doesn't reach `least`, which sizes or a part of the sets may tell. Two empty sets are alike."""
    if not len(x) and not len(y):
        return 1.0
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    if not len(x) or len(x) < least * len(y) - 1e-9:
        return 0.0
    need, both = least / (1 + least) * (len(x) + len(y)) - 1e-9, 0
    for at in range(0, len(x), 256):
        part = x[at : at + 256]
        both += int((y[np.minimum(np.searchsorted(y, part), len(y) - 1)] == part).sum())
        if both + len(x) - at - len(part) < need:
            return 0.0
    jaccard = both / (len(x) + len(y) - both)
    return jaccard if jaccard >= least else 0.0


def lengths(least: float) -> np.ndarray:
    """Where the partitions by set size begin: an alike pair lies in one or in two that follow each other."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(math.floor(out[-1] / least + 1e-9) + 1)
    return np.array(out)


def prefix(s: np.ndarray, least: float, frequent: np.ndarray) -> np.ndarray:
    """The first signatures, of which two alike sets share one: not frequent ones first, then from the rarest, all by their bits.

    frequent: the known ones in ascending order of bits, and their ranks.
    """
    ids, ranks = frequent
    rank = np.zeros(len(s), np.int64)
    if len(ids):
        at = np.minimum(np.searchsorted(ids, s), len(ids) - 1)
        rank = np.where(ids[at] == s, ranks[at], 0)
    n = len(s) - math.ceil(least * len(s) - 1e-9) + 1
    return s[np.lexsort([s, rank])[:n]]


_SETS = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int32()), ("set_id", pa.binary()), ("s", pa.binary())])
_PREFIX = pa.schema([("set_id", pa.binary()), ("keys", pa.list_(pa.int64()))])
_NODES = pa.schema([("set_id", pa.binary()), ("n", pa.int32()), ("part", pa.int32()), *((m, pa.int64()) for m in MAPS)])


def _sets(frames):
    sign = Signer()

    def rows():
        for ids, hashes, texts in slices(frames):
            for doc_id, th, s in zip(ids, hashes, sign.of(texts)):
                data = s.tobytes()
                yield doc_id, th, len(s), xxhash.xxh3_128_digest(data), data

    yield from batches(rows(), _SETS, 1024)


def _prefixes(least: float, known):
    def run(frames):
        frequent = known.value

        def rows():
            for set_id, data in records(frames):
                yield set_id, prefix(np.frombuffer(data, np.uint64), least, frequent).view(np.int64)

        yield from batches(rows(), _PREFIX, 1024)

    return run


def _nodes(least: float):
    """Size, partition and bitmap of sets."""

    def run(frames):
        starts = lengths(least)

        def rows():
            for set_id, data in records(frames):
                s = np.frombuffer(data, np.uint64)
                bits = np.zeros(BITS, bool)
                bits[(mixed(s) >> np.uint64(55)).astype(np.int64)] = True
                yield set_id, len(s), int(np.searchsorted(starts, len(s), "right")) - 1, *np.packbits(bits).view(np.int64).tolist()

        yield from batches(rows(), _NODES, 1024)

    return run


def _alike(least: float):
    def run(frames):
        def rows():
            for a, b, x, y in records(frames):
                yield a, b, likeness(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least) > 0

        yield from batches(rows(), pa.schema([("a", pa.binary()), ("b", pa.binary()), ("linked", pa.bool_())]))

    return run


def near_groups(rows: DataFrame, hold: Scratch, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """doc_id, th, component_id, one row for each (doc_id, th) of rows whose component has a smaller id than its own.

    Linked are fingerprints of a Jaccard likeness of numerator / denominator or more; component_id is the least doc_id
    reachable. rows: doc_id (not null), th, text. Fingerprints without signatures are linked with nothing.
    """
    least = numerator / denominator
    spark = rows.sparkSession
    sets = hold(rows.select("doc_id", "th", "text").mapInArrow(lean(_sets), "doc_id long, th long, n int, set_id binary, s binary"))
    filled = sets.where("n > 0")
    classes = hold(filled.groupBy("set_id").agg(F.min("doc_id").alias("least")))

    def keys(frequent) -> DataFrame:
        return filled.select("set_id", "s").mapInArrow(lean(_prefixes(least, spark.sparkContext.broadcast(frequent))), "set_id binary, keys array<long>").select("set_id", F.explode("keys").alias("key"))

    none = np.empty(0, np.uint64), np.empty(0, np.int64)
    total = filled.agg(F.coalesce(F.sum(F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1), F.lit(0))).first()[0]
    # at most FREQUENT signatures can stand in more than total / FREQUENT prefixes
    often = keys(none).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(COMMON_FROM, total // FREQUENT)).toArrow()
    ids, counts = often.column("key").to_numpy().view(np.uint64), often.column("n").to_numpy()
    order = np.argsort(ids)
    shared = hold(keys((ids[order], counts[order])))
    several = hold(shared.groupBy("key").agg(F.min(F.xxhash64("set_id")).alias("lo"), F.max(F.xxhash64("set_id")).alias("hi")).where("lo != hi").select("key"))
    met = hold(shared.join(several, "key").distinct())
    hold.drop(shared, several)
    ends = met.select("set_id").distinct()
    # one row of each set, found by its id too, so that a large group of equal sets is not gathered
    first = classes.join(ends, "set_id").select("set_id", F.col("least").alias("doc_id"))
    own = hold(filled.select("set_id", "doc_id", "s").join(first.hint("merge"), ["set_id", "doc_id"]).select("set_id", "s").dropDuplicates(["set_id"]))
    nodes = hold(own.mapInArrow(lean(_nodes(least)), "set_id binary, n int, part int, " + ", ".join(f"{m} long" for m in MAPS)))
    # a set stands in its own partition, and as a guest in the one after
    members = met.join(nodes.select("set_id", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part")), "set_id").select("set_id", F.xxhash64("key", "part").alias("key"))

    def may(x: str, y: str) -> Column:
        apart = sum((F.bit_count(F.col(f"{x}.{m}").bitwiseXOR(F.col(f"{y}.{m}"))) for m in MAPS), F.lit(0))
        size = denominator * F.least(f"{x}.n", f"{y}.n") >= numerator * F.greatest(f"{x}.n", f"{y}.n")
        return size & ((numerator + denominator) * apart <= (denominator - numerator) * (F.col(f"{x}.n") + F.col(f"{y}.n")))

    def verify(pairs: DataFrame) -> DataFrame:
        left, right = own.select(F.col("set_id").alias("a"), F.col("s").alias("x")), own.select(F.col("set_id").alias("b"), F.col("s").alias("y"))
        return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(lean(_alike(least)), "a binary, b binary, linked boolean")

    roots = link(bucketed(members, nodes.drop("part"), hold), ["n", *MAPS], may, verify, write=hold)
    labels = classes.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    labels = hold(labels.join(labels.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("set_id", "component_id"))
    out = hold(filled.select("doc_id", "th", "set_id").join(labels, "set_id").where("component_id != doc_id").select("doc_id", "th", "component_id").distinct())
    hold.drop(sets, classes, met, own, nodes, labels)
    return out


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("component_id", pa.int64())])
_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, component_id long"
_DEALT = "block int, guest boolean, doc_id long, th long, component_id long, data binary"


class Blocks:
    """A number that grows with doc_id, then th: of the different cuts below doc_id, then, for an id that several cuts name, of its share of hashes."""

    def __init__(self, cuts: list[int]):
        self.cuts, self.times = np.unique(np.array(cuts, np.int64), return_counts=True)
        self.width = int(self.times.max(initial=1)) + 1

    def of(self, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.cuts, ids)
        near = np.minimum(at, max(0, len(self.cuts) - 1))
        times = np.where((at < len(self.cuts)) & (self.cuts[near] == ids), self.times[near], 0) if len(self.cuts) else np.zeros(len(ids), np.int64)
        share = np.minimum(((hashes / 2.0**64 + 0.5) * times).astype(np.int64), times - 1)
        return (at * self.width + np.where(times > 1, 1 + share, 0)).astype(np.int32)


def _heads(blocks: Blocks):
    """The greatest doc_id and th of each block in a task."""

    def run(frames):
        held: dict[int, tuple[int, int]] = {}
        for batch in frames:
            ids, hashes = (batch.column(k).to_numpy() for k in (0, 1))
            own = blocks.of(ids, hashes)
            order = np.lexsort([hashes, ids, own])
            last = order[np.flatnonzero(np.diff(own[order], append=-1))]
            for k, i, h in zip(own[last].tolist(), ids[last].tolist(), hashes[last].tolist()):
                held[k] = max(held.get(k, (i, h)), (i, h))
        yield from batches(((k, *x) for k, x in held.items()), pa.schema([("block", pa.int32()), ("doc_id", pa.int64()), ("th", pa.int64())]))

    return run


def _dealt(blocks: Blocks):
    """Rows with their block, if they have none yet, and texts compressed, so that less is shuffled."""

    def run(frames):
        press = zstandard.ZstdCompressor(level=3)
        for batch in frames:
            guest, ids, hashes, component, text = batch.columns[1:]
            block = blocks.of(ids.to_numpy(), hashes.to_numpy())
            block = np.where(guest.to_numpy(zero_copy_only=False), batch.column(0).fill_null(0).to_numpy(), block).astype(np.int32)
            data = pa.array([None if t is None else press.compress(t.encode()) for t in text.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(block), guest, ids, hashes, component, data], names=["block", "guest", "doc_id", "th", "component_id", "data"])

    return run


def _compare(frames):
    """Rows of one block follow each other by descending doc_id, a row's component (without data) before it.

    A guest ends a block and is only the next of the row before.
    """
    sign, press = Signer(), zstandard.ZstdDecompressor()

    def rows():
        last, told = None, None
        for columns in slices(frames):
            held = []  # block, guest, doc_id, component, text, of rows with texts
            for block, guest, doc_id, th, component, data in zip(*columns):
                if data is None:
                    told = doc_id, th, component
                else:
                    held.append((block, guest, doc_id, told[2] if told and told[:2] == (doc_id, th) else doc_id, press.decompress(data).decode()))
            signed = [(row, short(s)) for row, s in zip(held, sign.of([row[4] for row in held]))]
            pairs = []
            for row, own in signed:
                if last is not None and not last[0][1] and last[0][0] == row[0]:
                    pairs.append((*last, row[4], own))
                last = row, own
            texts = [a[4][: len(a[4]) - len(a[4]) // 2] + b[: len(a[4]) // 2] for a, _, b, _ in pairs]
            for (a, own, _, after), edited, s in zip(pairs, texts, sign.of(texts)):
                other = short(s)
                yield a[2], len(a[4]), hashlib.sha256(edited.encode()).hexdigest(), written(own), written(other), likeness(own, other), likeness(own, after), a[3]

    yield from batches(rows(), _OUT, 512)


def fingerprints(docs: DataFrame, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """A row for each input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, component_id.

    The next row is the one with the next smaller doc_id, after the last the first; rows of equal doc_id follow each
    other by their text's hash, and null ids come last. A lone row is its own next. Null text counts as empty; very
    long texts are taken whole. Extra columns are ignored; an empty table gives no rows. component_id: the least doc_id
    of all rows that links of near_groups reach, null where none has an id.

    Blocks of ids (and of the hashes of one id's texts, where it has many rows) are cut at quantiles, and the first
    row of each block also visits the block before as a guest, so that one shuffle brings all neighbours together.
    Rows that repeat both id and text share a block.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = 16 * parts
    cuts = sorted(int(x) for x in rows.agg(F.percentile_approx("doc_id", [k / number for k in range(1, number)], 10000).alias("q")).first().q or [])
    blocks = Blocks(cuts)
    first = rows.select("doc_id", "th").mapInArrow(lean(_heads(blocks)), "block int, doc_id long, th long").groupBy("block").agg(F.max(F.struct("doc_id", "th")).alias("x")).orderBy(F.desc("block")).collect()  # a row a block
    if not first:
        return docs.sparkSession.createDataFrame([], _DDL)
    present = [r.block for r in first]
    visits = [(r.x.doc_id, r.x.th, present[k - 1]) for k, r in enumerate(first)]  # the first block's head visits the last
    hold = Scratch()
    real = rows.withColumn("doc_id", F.when(F.col("doc_id") == -(2**63), NO_ID).otherwise(F.col("doc_id")))
    groups = near_groups(real, hold, numerator, denominator)
    groups = groups.withColumn("doc_id", F.when(F.col("doc_id") == NO_ID, -(2**63)).otherwise(F.col("doc_id")))
    heads = F.broadcast(docs.sparkSession.createDataFrame(visits, "doc_id long, th long, at int"))
    none = F.lit(None).cast("long").alias("component_id")
    of = lambda at, guest: [at.alias("block"), F.lit(guest).alias("guest"), "doc_id", "th"]
    stay = rows.select(*of(F.lit(None).cast("int"), False), none, "text")
    guest = rows.join(heads, ["doc_id", "th"]).select(*of(F.col("at"), True), none, "text").dropDuplicates(["block"])
    told = groups.select(*of(F.lit(None).cast("int"), False), "component_id", F.lit(None).cast("string").alias("text"))
    dealt = stay.unionByName(guest).unionByName(told).mapInArrow(lean(_dealt(blocks)), _DEALT)
    dealt = dealt.repartition(parts, "block").sortWithinPartitions("block", "guest", F.desc("doc_id"), F.desc("th"), F.col("component_id").isNull())
    out = dealt.mapInArrow(lean(_compare), _DDL)
    id_ = lambda c: F.when((F.col(c) != -(2**63)) & (F.col(c) != NO_ID), F.col(c)).alias(c)
    return out.select(id_("doc_id"), *_OUT.names[1:-1], id_("component_id"))
