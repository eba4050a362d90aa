"""Language-model scores from a Brown class-based bigram model.

Every training token is counted. Exchange clustering moves the most frequent words between classes while the likelihood
of the class bigrams grows; their number follows the vocabulary. Until then a rarer word stands in the class of its last
two bytes. Each rarer word is then moved to the class under which the classes before and after all its own tokens are
likeliest; these counts meet by word in a shuffle. The class bigrams are counted again over all words' final classes. A
token's probability is that of its class after the class before, smoothed towards the class's own share, times the
word's share of its class, add-one smoothed with one place for unseen words of each ending.

Counts and classes of frequent words (at most LOOKUP) and of the end go to every worker; all other tokens meet theirs in
a join.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, batches, lean, materialize, records

#: Words exchanged on the driver for a vocabulary of VOCABULARY words (more with its fourth root, so that their matrix
#: grows with its square root), ending units and classes.
UNITS, VOCABULARY, ENDINGS, CLASSES = 1024, 400_000, 64, 48
#: Words whose counts and classes every worker holds, and their greatest length in bytes.
LOOKUP, LONGEST = 200_000, 48
SWEEPS, PRIOR = 8, 20.0
CACHE = 300_000
#: Stands for the end of a text; no word holds a line break.
END = b"\n"

_COUNTS = pa.schema([("word", pa.binary()), ("ending", pa.int32()), ("n", pa.int64())])
_PAIRS = pa.schema([("pair", pa.int64()), ("n", pa.int64())])
_NEIGHBOURS = pa.schema([("word", pa.binary()), ("code", pa.int64()), ("side", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))])
_CLASSES = pa.schema([("word", pa.binary()), ("code", pa.int64()), ("n", pa.int64()), ("class", pa.int32())])
_TEXTS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("classes", pa.binary()), ("places", pa.binary()), ("words", pa.list_(pa.binary())), ("times", pa.list_(pa.int32()))])
_MODEL = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("model", pa.float64())])


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


def tokens(text: str | None) -> list[bytes]:
    return [*ascii_lower(text).split(), END]


def _count(frames):
    held: Counter = Counter()

    def rows():
        for (text,) in records(frames):
            held.update(tokens(text))
            if len(held) > CACHE:
                yield from ((w, ending(w), n) for w, n in held.items())
                held.clear()
        yield from ((w, ending(w), n) for w, n in held.items())

    yield from batches(rows(), _COUNTS, 50_000)


class Codes(dict):
    """word -> its place among the looked-up words, or their number plus its ending."""

    def __init__(self, words: list[bytes]):
        super().__init__(zip(words, range(len(words))))
        self.known, self.room = len(words), len(words) + CACHE

    def __missing__(self, word: bytes) -> int:
        code = self.known + ending(word)
        if len(self) < self.room:
            self[word] = code
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _pairs(known, size: int):
    def run(frames):
        words, unit = known.value
        codes, held, waiting = Codes(words), np.zeros(size * size, np.int64), []

        def fold():
            np.add(held, np.bincount(np.concatenate(waiting), minlength=size * size), out=held)
            waiting.clear()

        n = 0
        for (text,) in records(frames):
            u = unit[codes.of([END, *tokens(text)])]
            waiting.append(u[:-1] * size + u[1:])
            n += len(u)
            if n > 2_000_000:
                fold()
                n = 0
        if waiting:
            fold()
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], schema=_PAIRS)

    return run


def _xlogx(x):
    return x * np.log(np.maximum(x, 1))


def exchange(n: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit (unit 0, the end, keeps class 0 for itself) from the matrix of unit bigrams."""
    n = n.astype(float)
    size = len(n)
    own = np.concatenate([[0], 1 + np.arange(size - 1) % (classes - 1)])
    one = np.eye(classes)
    into, out_of = n.T @ one[own], n @ one[own]  # unit after class, unit before class
    m = one[own].T @ out_of
    for _ in range(sweeps):
        moved = 0
        for u in range(1, size):
            a, self_n = own[u], n[u, u]
            left, right = into[u].copy(), out_of[u].copy()
            left[a] -= self_n
            right[a] -= self_n
            if not (left.any() or right.any() or self_n):
                continue
            m[a] -= right
            m[:, a] -= left
            m[a, a] -= self_n
            rows, cols, d = m.sum(axis=1), m.sum(axis=0), m.diagonal()
            gain = (_xlogx(m + right) - _xlogx(m)).sum(axis=1) + (_xlogx(m.T + left) - _xlogx(m.T)).sum(axis=1)
            gain += _xlogx(d + left + right + self_n) + _xlogx(d) - _xlogx(d + right) - _xlogx(d + left)
            gain -= _xlogx(rows + right.sum() + self_n) - _xlogx(rows) + _xlogx(cols + left.sum() + self_n) - _xlogx(cols)
            gain[0] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            m[b] += right
            m[:, b] += left
            m[b, b] += self_n
            if b != a:
                own[u], moved = b, moved + 1
                into[:, a] -= n[u]
                into[:, b] += n[u]
                out_of[:, a] -= n[:, u]
                out_of[:, b] += n[:, u]
        if not moved:
            break
    return own


def best_class(m: np.ndarray, own: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The class, not 0 and not an empty one, under which each word's neighbours are likeliest, from all other words.

    left and right hold the classes before and after its tokens, a row a word; m the class bigrams with each word in own.
    All words move at once, so each meets the classes as they are, smoothed, and without its own part in them.
    """
    w, mine = np.arange(len(own)), own[:, None] == np.arange(len(m))
    log = lambda x: np.log(np.maximum(x, 1e-300))
    gain = np.zeros(mine.shape)
    for side, other, base in ((right, left, m), (left, right, m.T)):  # base: the word's class, its neighbour's
        prior = PRIOR * base.sum(axis=0) / base.sum()
        rest, at = prior[own][:, None], base.T[own]
        part = side @ log(base + prior).T + side[w, own][:, None] * (log(np.maximum(at - other, 0) + rest) - log(at + rest))
        held = base[own] - side
        held[w, own] -= other[w, own]
        part[w, own] = (side * log(np.maximum(held, 0) + prior)).sum(axis=1)
        n = side.sum(axis=1, keepdims=True)
        gain += part - n * np.log(np.maximum(base.sum(axis=1) - other - mine * n, 0) + PRIOR)
    gain[:, m.sum(axis=0) + m.sum(axis=1) == 0] = -np.inf
    gain[:, 0] = -np.inf
    return gain.argmax(axis=1)


def _neighbours(known, units: int, k: int):
    """Words that are not units with the classes before (0 to k - 1) and after (k to 2k - 1) their tokens."""

    def run(frames):
        words, unit, cls = known.value
        codes, top, far, waiting = Codes(words), len(words), {}, []

        def fold():
            keys, times = np.unique(np.concatenate(waiting), return_counts=True)
            ids, names = keys // (2 * k), list(far)
            starts = np.flatnonzero(np.diff(ids, prepend=-1))
            ends = np.append(starts, len(ids))
            for i in range(0, len(starts), 10_000):
                part = ends[i : i + 10_001]
                own, a, b = ids[part[:-1]], part[0], part[-1]
                offsets = pa.array(part - a, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x[a:b], t)) for x, t in ((keys % (2 * k), pa.int32()), (times, pa.int64()))]
                names_of = pa.array([words[j] if j < top else names[j - top] for j in own.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([names_of, pa.array(np.where(own < top, own, -1)), *lists], schema=_NEIGHBOURS)
            far.clear()
            waiting.clear()

        n = 0
        for (text,) in records(frames):
            own = tokens(text)
            c = codes.of(own)
            at = np.flatnonzero(c >= units)
            if not len(at):
                continue
            classes, ids = np.concatenate([[0], cls[unit[c]]]), c[at]
            for j in np.flatnonzero(ids >= top).tolist():
                ids[j] = top + far.setdefault(own[at[j]], len(far))
            waiting += [ids * (2 * k) + classes[at], ids * (2 * k) + k + classes[at + 2]]
            n += len(at)
            if n > 1_000_000:
                yield from fold()
                n = 0
        if waiting:
            yield from fold()

    return run


def _classes(known):
    """The class of each word; rows of a word follow one another."""

    def run(frames):
        m, of_ending = known.value
        k = len(m)

        def placed(words, codes, sides):
            own = of_ending[[ending(w) for w in words]]
            cls = np.concatenate([best_class(m, own[i : i + 256], sides[i : i + 256, :k], sides[i : i + 256, k:]) for i in range(0, len(words), 256)])
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(codes), pa.array(sides[:, :k].sum(axis=1).astype(np.int64)), pa.array(cls.astype(np.int32))], schema=_CLASSES)

        last = None  # the word whose rows may go on in the next batch, its code and sides
        for batch in frames:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                words, codes = part.column(0).to_pylist(), part.column(1).to_numpy()
                first = np.array([a != b for a, b in zip(words, [last and last[0], *words])])
                group = np.cumsum(first) - first[0]
                size = int(group[-1]) + 1
                row = np.repeat(group, part.column(2).value_lengths().to_numpy())
                sides = np.bincount(row * (2 * k) + part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy(), size * 2 * k).reshape(size, 2 * k)
                starts = np.flatnonzero(first) if first[0] else np.concatenate([[0], np.flatnonzero(first)])
                words, codes = [words[i] for i in starts.tolist()], codes[starts]
                if last and first[0]:
                    words, codes, sides = [last[0], *words], np.concatenate([[last[1]], codes]), np.concatenate([last[2][None], sides])
                elif last:
                    sides[0] += last[2]
                if len(words) > 1:
                    yield placed(words[:-1], codes[:-1], sides[:-1])
                last = words[-1], codes[-1], sides[-1]
        if last:
            yield placed([last[0]], np.array([last[1]]), last[2][None])

    return run


def _texts(known, held_out):
    """Counts and classes of looked-up words; any other has the class of its ending, its places and itself for the join."""

    def run(frames):
        words, log_count, cls = known.value
        codes, top = Codes(words), len(words)
        first = TaskContext.get().partitionId() << 40
        ends = int(log_count[0] > 0)  # without training rows the end is new too

        def rows():
            for k, (doc_id, text) in enumerate(records(frames)):
                own = tokens(text)
                c = codes.of(own)
                at = np.flatnonzero(c >= top)
                rare: dict[bytes, int] = {}
                which = np.array([rare.setdefault(own[i], len(rare)) for i in at.tolist()], np.int64)
                places = np.concatenate([at, which]).astype(np.int32).tobytes()
                yield first + k, doc_id, held_out(doc_id), len(own), len(own) - len(at) - 1 + ends, float(log_count[c].sum()), cls[c].tobytes(), places, list(rare), np.bincount(which, minlength=len(rare))

        yield from batches(rows(), _TEXTS, 1024)

    return run


def _joined(frames):
    """Puts the classes that the join found (place among the row's words * 256 + class) into the rows' classes."""
    for batch in frames:
        *kept, classes, places, found = batch.columns
        out = []
        for own, place, got in zip(classes.to_pylist(), places.to_pylist(), found):
            if got.is_valid and len(got.values):
                at, which = np.frombuffer(place, np.int32).reshape(2, -1)
                got = got.values.to_numpy()
                cls = np.full(which.max() + 1, -1)
                cls[got >> 8] = got & 255
                own, known = np.frombuffer(own, np.uint8).copy(), cls[which] >= 0
                own[at[known]] = cls[which[known]]
                own = own.tobytes()
            out.append(own)
        yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.binary())], names=[*batch.schema.names[: len(kept)], "classes"])


def _stream(column):
    """The classes of a batch's rows, and those before: each row ends with class 0, which is also what a row begins after."""
    own = np.frombuffer(b"".join(column.to_pylist()), np.uint8).astype(np.int64)
    return np.concatenate([[0], own[:-1]]), own


def _class_pairs(k: int):
    def run(frames):
        held = np.zeros(k * k, np.int64)
        for batch in frames:
            if batch.num_rows:
                before, own = _stream(batch.column(0))
                held += np.bincount(before * k + own, minlength=k * k)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], schema=_PAIRS)

    return run


def _score(known):
    def run(frames):
        log_step = known.value
        for batch in frames:
            if batch.num_rows:
                *kept, base, classes = batch.columns
                n = kept[2].to_numpy()
                model = np.add.reduceat(log_step[_stream(classes)], np.cumsum(n) - n)
                yield pa.RecordBatch.from_arrays([*kept, base, pa.array(base.to_numpy() + model)], schema=_MODEL)

    return run


def is_held_out(modulus: int, remainder: int):
    """The document ids whose crc32, of their decimal digits, leaves the remainder; a null id is never held out."""
    return lambda doc_id: doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == remainder


def class_scores(docs: DataFrame, modulus: int = 7, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each input row.

    The rows held out teach nothing. Null or empty text is its end alone; every repeated row counts. A null doc_id is
    trained on. Extra columns are ignored; an empty table gives no rows, and without training rows all words are new.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    train = docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus != remainder, F.lit(True))).select("text")
    hold = Scratch()
    counts = hold(train.mapInArrow(lean(_count), "word binary, ending int, n long").groupBy("word", "ending").agg(F.sum("n").alias("n")))
    level = F.floor(F.log2("n") * 16).cast("int")
    by_level = counts.where(F.octet_length("word") <= LONGEST).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("v")).orderBy(F.desc("level")).collect()  # 64 * 16 rows at most
    least, room = None, LOOKUP
    for r in by_level:
        room -= r.v
        if room < 0:
            break
        least = r.level
    frequent = (F.octet_length("word") <= LONGEST) & (level >= F.lit(least)) if least is not None else F.lit(False)
    known = counts.where(frequent | (F.col("word") == F.lit(bytearray(END))))  # the end is never joined, however rare
    known = sorted(zip(*(c.to_pylist() for c in known.select("word", "n").toArrow().columns)), key=lambda x: (x[0] != END, -x[1], x[0]))
    if not known or known[0][0] != END:
        known.insert(0, (END, 0))
    words, n_known = [w for w, _ in known], np.array([n for _, n in known], np.int64)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    units = min(int(UNITS * max(1.0, (total[1] / VOCABULARY) ** 0.25)), len(words))
    size = units + ENDINGS
    rest = np.array([units + ending(w) for w in words[units:]], np.int64)
    unit = np.concatenate([np.arange(units), rest, units + np.arange(ENDINGS)])
    sent = spark.sparkContext.broadcast((words, unit))
    bigrams = train.mapInArrow(lean(_pairs(sent, size)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(size * size, np.int64)
    n[bigrams.column("pair").to_numpy()] = bigrams.column("n").to_numpy()
    n = n.reshape(size, size)
    cls = exchange(n, min(CLASSES, size))
    k = int(cls.max()) + 1
    one = np.eye(k)[cls]
    m, of_ending = one.T @ n @ one, cls[units:]

    sent = spark.sparkContext.broadcast((words, unit, cls))
    around = train.mapInArrow(lean(_neighbours(sent, units, k)), "word binary, code long, side array<int>, times array<long>")
    sent = spark.sparkContext.broadcast((m, of_ending))
    others = hold(around.repartition("word").sortWithinPartitions("word").mapInArrow(lean(_classes(sent)), "word binary, code long, n long, class int"))
    looked_up = others.where("code >= 0").select("code", "class").toArrow()  # LOOKUP rows at most
    of_word = cls[unit].astype(np.uint8)
    of_word[looked_up.column("code").to_numpy()] = looked_up.column("class").to_numpy()
    mass = np.bincount(cls[:units], n_known[:units] + 1, k) + np.bincount(of_ending, minlength=k)
    for r in others.groupBy("class").agg(F.sum(F.col("n") + 1).alias("n")).collect():  # a row a class
        mass[r["class"]] += r.n

    log_count = np.concatenate([np.log10(n_known + 1.0), np.zeros(ENDINGS)])
    sent = spark.sparkContext.broadcast((words, log_count, of_word))
    texts = hold(docs.mapInArrow(lean(_texts(sent, is_held_out(modulus, remainder))), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, classes binary, places binary, words array<binary>, times array<int>"))
    rare = texts.select("row", F.posexplode(F.arrays_zip("words", "times"))).select("row", "pos", "col.words", "col.times").toDF("row", "place", "word", "t")
    found = (F.col("place").cast("long") * 256 + F.col("class")).alias("found")
    met = rare.join(others.where("code < 0"), "word").select("row", "t", "n", found).groupBy("row").agg(F.sum(F.col("t") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("t").cast("long").alias("met"), F.collect_list("found").alias("found"))
    whole = texts.drop("words", "times").join(met, "row", "left").na.fill({"more": 0.0, "met": 0})
    whole = whole.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("met")).alias("n_known"), (F.col("base") + F.col("more")).alias("base"), "classes", "places", "found")
    whole = materialize(whole.mapInArrow(lean(_joined), "doc_id long, held_out boolean, n_tokens long, n_known long, base double, classes binary"))
    hold.drop(counts, others, texts)

    bigrams = whole.where("not held_out").select("classes").mapInArrow(lean(_class_pairs(k)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    m = np.zeros(k * k)
    m[bigrams.column("pair").to_numpy()] = bigrams.column("n").to_numpy()
    m = m.reshape(k, k)
    follow = (m + PRIOR * mass / mass.sum()) / (m.sum(axis=1, keepdims=True) + PRIOR)
    log_step = np.log10(np.maximum(follow, 1e-300)) - np.log10(np.maximum(mass, 1e-300))
    out = whole.mapInArrow(lean(_score(spark.sparkContext.broadcast(log_step))), "doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double")
    less = F.col("n_tokens") * F.lit(float(np.log10(total[0] + total[1] + 1.0)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total[0])).cast("long").alias("train_tokens"), (F.col("base") - less).alias("base_score"), F.col("model").alias("score"))
