"""Best-fit packing of token sequences by the linear grouping scheme.

Only the histogram of piece lengths, of at most `capacity` entries, is planned with, so planning costs the same for
any corpus. Long lengths are sorted, dealt to groups of equal cardinality and rounded up to the longest of their
group. A linear program over configurations of these few sizes, solved by column generation with a knapsack, says how
many sequences get each configuration; the whole part of that is used and the rest is packed best-fit. Actual lengths
then take the slots of their group, and short pieces fill what is left best-fit, the longest first.

The plan is a list of sequence kinds, each with its lengths and a multiplicity; a piece finds its place by its rank
among the pieces of its length.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import batches, lean, materialize

#: Sizes of the linear program, and shares of a sequence above which a piece is long; the plan of the fewest sequences is taken.
GROUPS, LONG = 40, (0.5, 0.4, 0.3, 0.2)
#: Units whose ids a worker keeps, and bytes of both.
CACHE, HELD_BYTES = 1_000_000, 64 << 20
#: Bytes of text that are encoded together.
PORTION = 8 << 20
#: Chunks whose ids are gathered together, and new units that are encoded together.
GATHER, ENCODED = 1 << 16, 1 << 12

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])
_PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


#: A chunk that ends in ASCII punctuation (but for the apostrophe) after an ASCII letter or digit: always a token boundary.
_SPLIT = r"(?s)^(?P<core>.*[0-9A-Za-z])(?P<marks>[!-&(-/:-@\[-`{-~]+)$"


def _runs(pool: np.ndarray, first: np.ndarray, size: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of pool that codes name on end, and where each begins, with the end of the last."""
    length = size[codes]
    after = np.concatenate([[0], np.cumsum(length)])
    out = np.empty(after[-1], pool.dtype)
    for at in range(0, len(codes), GATHER):
        begin, stop = after[at], after[min(at + GATHER, len(codes))]
        shift = first[codes[at : at + GATHER]] - after[at : at + GATHER][: len(codes) - at]
        out[begin:stop] = pool[np.arange(begin, stop) + np.repeat(shift, length[at : at + GATHER])]
    return out, after


class Tokens:
    """Texts -> their ids, by way of blank-delimited chunks, each distinct one looked up once.

    The vocabulary drops white space and lower-cases, so chunks are independent of each other and of the case of A-Z,
    unless they may hold a special token's string. A chunk's last punctuation marks are a unit of their own. Units and
    ids are kept in flat arrays; beyond CACHE units or HELD_BYTES only those of the texts at hand are kept.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.encoder = Tokenizer.from_file(path)
        self.units = pa.array([], pa.string())
        self.pool, self.first, self.size = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)
        vocabulary = self.encoder.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        words = ((i, t[:-4]) for t, i in vocabulary.items() if t.endswith("</w>") and t[:-4].isascii() and t[:-4].isalpha())
        self.mark_id, self.mark = next((i, w) for i, w in sorted(words, reverse=True) if self._ids(w).tolist() == [i])

    def of(self, texts: list[str | None]) -> list[bytes]:
        ids, ends = self.joined(pa.array(texts, pa.string()))
        data, ends = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [data[x:y] for x, y in zip(ends, ends[1:])]

    def joined(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, and where each text ends."""
        low = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)).fill_null("")
        chunks = pc.ascii_split_whitespace(low)
        coded = chunks.flatten().dictionary_encode()
        pool, size = self._each(coded.dictionary)
        ids, after = _runs(pool, np.cumsum(size) - size, size, coded.indices.to_numpy(zero_copy_only=False))
        per_text = pc.list_value_length(chunks).to_numpy(zero_copy_only=False)
        return ids, after[np.cumsum(per_text)]

    def _each(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks on end, and how many each has; an empty chunk has none."""
        parts = pc.extract_regex(chunks, _SPLIT)
        core, marks = (pc.if_else(pc.match_substring(chunks, "<|"), None, pc.struct_field(parts, x)) for x in ("core", "marks"))
        units = pa.concat_arrays([pc.coalesce(core, chunks), marks.fill_null("")]).dictionary_encode()
        pool, first, size = self._learnt(units.dictionary)
        both = units.indices.to_numpy(zero_copy_only=False).reshape(2, -1).T.ravel()  # core and marks by turns
        ids, after = _runs(pool, first, size, both)
        return ids, np.diff(after[::2])

    def _learnt(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and of each of distinct units its first place and length there."""
        at = pc.index_in(units, value_set=self.units).fill_null(-1).to_numpy(zero_copy_only=False).copy()
        lacking = np.flatnonzero(at < 0)
        if len(lacking):
            new = units.take(pa.array(lacking))
            kind = np.where(pc.match_substring(new, "<|"), 2, np.where(pc.utf8_is_alpha(new), 0, 1))
            order = np.argsort(kind, kind="stable")
            new, kind = new.take(pa.array(order)), kind[order]
            pools, sizes = [self.pool], [self.size]
            for k, encode in enumerate((self._letters, self._others, self._alone)):
                begin, stop = np.searchsorted(kind, [k, k + 1])
                for x in range(begin, stop, ENCODED):
                    ids, size = encode(new.slice(x, min(ENCODED, stop - x)).to_pylist())
                    pools.append(ids)
                    sizes.append(size)
            at[lacking[order]] = len(self.units) + np.arange(len(new))
            self.units, self.pool, self.size = pa.concat_arrays([self.units, new]), np.concatenate(pools), np.concatenate(sizes)
            self.first = np.cumsum(self.size) - self.size
            if len(self.units) > CACHE or self.units.nbytes + self.pool.nbytes > HELD_BYTES:
                self.units, (self.pool, after) = units, _runs(self.pool, self.first, self.size, at)
                self.first, self.size, at = after[:-1], np.diff(after), slice(None)
        return self.pool, self.first[at], self.size[at]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.encoder.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Runs of letters are one word each, so many are encoded as one text and parted at the tokens that end a word."""
        ids = self._ids(" ".join(words))
        ends = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(words) else self._alone(words)

    def _others(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Other units are parted at a word between them, unless one holds that word itself."""
        ids = self._ids(f" {self.mark} ".join(words))
        at = np.flatnonzero(ids == self.mark_id)
        return (np.delete(ids, at), np.diff(at, prepend=-1, append=len(ids)) - 1) if len(at) == len(words) - 1 else self._alone(words)

    def _alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(e.ids, "<u4") for e in self.encoder.encode_batch_fast(words, add_special_tokens=False)]
        return np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids))


#: Of this Python worker.
_tokens: dict[str, Tokens] = {}


def _portions(frames):
    """Ids and texts of consecutive rows, of PORTION bytes of text or a single row at most."""
    for batch in frames:
        doc_id, text = batch.column(0), batch.column(1)
        size = np.cumsum(pc.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(text):
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + PORTION, "right")))
            yield doc_id.slice(at, to - at).to_pylist(), text.slice(at, to - at)
            at = to


def _pieces(path: str, capacity: int, end: int):
    def run(frames):
        tokens = _tokens[path] = _tokens.get(path) or Tokens(path)
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)

        def rows():
            for doc_ids, texts in _portions(frames):
                ids, ends = tokens.joined(texts)
                data = memoryview(np.insert(ids, ends, end).astype("<u4", copy=False)).cast("B")
                last = 0
                for doc_id, stop in zip(doc_ids, (ends + np.arange(1, len(ends) + 1)).tolist()):
                    for k, at in enumerate(range(last, stop, capacity)):
                        n = min(capacity, stop - at)
                        yield doc_id, k, at - last, n, zlib.crc32(data[4 * at : 4 * (at + n)]), part, seen[n]
                        seen[n] += 1
                    last = stop

        yield from batches(rows(), _PIECES)

    return run


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, float]]:
    """Patterns (copies of each size) and how many sequences get each, by the revised simplex method with generated columns."""
    s, d, k = np.array(sizes), np.array(demand, float), len(sizes)
    basis = np.diag([capacity // x for x in sizes]).astype(float)
    for _ in range(60 * k):
        inverse = np.linalg.inv(basis)
        worth, amount = inverse.sum(axis=0), inverse @ d
        column = _knapsack(s, worth, capacity)
        if column @ worth <= 1 + 1e-7:
            break
        way = inverse @ column
        ratio = np.where(way > 1e-9, np.maximum(amount, 0) / np.where(way > 1e-9, way, 1), np.inf)
        if not np.isfinite(ratio.min()):
            break
        basis[:, int(ratio.argmin())] = column
    amount = np.linalg.inv(basis) @ d
    return [(basis[:, j].astype(int), float(amount[j])) for j in range(k)]


def _knapsack(s: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """Copies of each size that fit the capacity and are worth most, by the number of pieces."""
    from_at = np.arange(capacity + 1)[None, :] - s[:, None]
    fits = from_at >= 0
    from_at = np.where(fits, from_at, 0)
    best, choices = np.zeros(capacity + 1), []
    for _ in range(capacity // s.min()):
        value = np.where(fits, best[from_at] + worth[:, None], 0)
        pick = value.argmax(axis=0)
        top = value[pick, np.arange(capacity + 1)]
        better = top > best + 1e-12
        if not better.any():
            break
        choices.append(np.where(better, pick, -1))
        best = np.where(better, top, best)
    column, c = np.zeros(len(s)), capacity
    for pick in reversed(choices):
        if pick[c] >= 0:
            column[pick[c]] += 1
            c -= s[pick[c]]
    return column


class Plan:
    """Kinds of sequences: [room left, multiplicity, lengths]. Equal room is kept together for best-fit."""

    def __init__(self, capacity: int):
        self.capacity, self.open, self.rooms, self.full = capacity, defaultdict(list), [], []

    def put(self, room: int, times: int, lengths: tuple) -> None:
        if times:
            if room == 0:
                self.full.append((times, lengths))
                return
            if not self.open[room]:
                bisect.insort(self.rooms, room)
            self.open[room].append((times, lengths))

    def fit(self, length: int, count: int) -> None:
        """count pieces of one length, each to the sequence with the least room that holds it; else to new ones."""
        while count:
            at = bisect.bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = self.capacity // length
                whole, rest = divmod(count, each)
                self.put(self.capacity - each * length, whole, (length,) * each)
                self.put(self.capacity - rest * length, 1 if rest else 0, (length,) * rest)
                return
            room = self.rooms[at]
            times, lengths = self.open[room].pop()
            if not self.open[room]:
                del self.rooms[at]
            each = min(room // length, max(1, count // times))
            used = min(times, count // each)
            count -= used * each
            self.put(room, times - used, lengths)
            self.put(room - each * length, used, lengths + (length,) * each)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple]]:
    """(multiplicity, lengths) of the sequences that hold all pieces of the histogram."""
    return min((_plan(histogram, capacity, share) for share in LONG), key=lambda kinds: sum(times for times, _ in kinds))


def _plan(histogram: dict[int, int], capacity: int, above: float) -> list[tuple[int, tuple]]:
    out = Plan(capacity)
    out.put(0, histogram.get(capacity, 0), (capacity,))
    long = sorted((n for n in histogram if above * capacity < n < capacity), reverse=True)
    total = sum(histogram[n] for n in long)
    groups: list[list[list[int]]] = []
    share = -(-total // GROUPS) if total else 0
    for n in long:
        left = histogram[n]
        while left:
            held = sum(c for _, c in groups[-1]) if groups else share
            if held >= share:
                groups.append([])
                held = 0
            take = min(left, share - held)
            groups[-1].append([n, take])
            left -= take
    merged: list[list[list[int]]] = []
    for g in groups:  # a length that fills groups alone is one size
        if merged and merged[-1][0][0] == g[0][0]:
            merged[-1] += g
        else:
            merged.append(g)
    if merged:
        sizes, demand = [g[0][0] for g in merged], [sum(c for _, c in g) for g in merged]
        for pattern, amount in configurations(sizes, demand, capacity):
            slots = [j for j, copies in enumerate(pattern) for _ in range(copies)]
            times = int(amount + 1e-9)
            for j in set(slots):
                times = min(times, sum(c for _, c in merged[j]) // slots.count(j))
            _substitute(out, merged, slots, times, capacity)
    rest: dict[int, int] = defaultdict(int)
    for g in merged:
        for n, c in g:
            rest[n] += c
    for n, c in histogram.items():
        if n <= above * capacity:
            rest[n] += c
    for n in sorted(rest, reverse=True):
        out.fit(n, rest[n])
    return out.full + [x for room in out.rooms for x in out.open[room]]


def _substitute(out: Plan, groups: list, slots: list[int], times: int, capacity: int) -> None:
    """Give `times` sequences of one configuration actual lengths of its groups, the longest first."""
    if times <= 0 or not slots:
        return
    streams = []
    for j in slots:
        own, need = [], times
        while need:
            n, c = groups[j][0]
            take = min(c, need)
            own.append([n, take])
            need -= take
            groups[j][0][1] -= take
            if not groups[j][0][1]:
                groups[j].pop(0)
        streams.append(own)
    while times:
        run = min(s[0][1] for s in streams)
        lengths = tuple(s[0][0] for s in streams)
        out.put(capacity - sum(lengths), run, lengths)
        for s in streams:
            s[0][1] -= run
            if not s[0][1]:
                s.pop(0)
        times -= run


def places(kinds: list[tuple[int, tuple]], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> first ranks of its runs, the sequence of each run's first piece, and its offset there."""
    runs, used, base = defaultdict(list), defaultdict(int), 0
    for times, lengths in kinds:
        at = 0
        for n in lengths:
            runs[n].append((used[n], base, at))
            used[n] += times
            at += n
        base += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*r)) for n, r in runs.items()}


def _place(at: dict):
    out = pa.schema([*list(_PIECES)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(frames):
        for batch in frames:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                first, base, offset = at[int(n)]
                run_of = np.searchsorted(first, rank[own], "right") - 1
                seq[own], off[own] = base[run_of] + rank[own] - first[run_of], offset[run_of]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in out.names[:5]] + [pa.array(seq), pa.array(off)], schema=out)

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of each input row.

    A document is its token ids, then the id `end`; longer than capacity it is cut, shorter never. Null or empty text
    is the end alone. Repeated rows are packed each. Extra columns are ignored; an empty table gives no rows.
    """
    pieces = materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(_pieces(tokenizer, capacity, end)), _PIECES_DDL))
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    at = places(plan(histogram, capacity), capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(starts, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(lean(_place(at)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
