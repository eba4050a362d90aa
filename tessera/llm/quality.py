"""Text quality by positive-unlabelled learning.

A small network learns from trusted positives and unlabelled documents by the non-negative unbiased risk
prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)); while the second part is negative, its gradient is followed the
other way.

R_u is of all unlabelled training documents: each is added to the nearest of PROTOTYPES of them, and the risk is the
weighted one of the means. Positives, which are labelled rows, are a sample of about SAMPLE by a hash of doc_id.

The class prior is estimated from positives and unlabelled documents alone: a network trained on one half of both ranks
the other halves. The share of unlabelled documents above a margin c, divided by that of the positives, can only be too
large, by the negatives that lie there too; the prior is the least such ratio, with an allowance for few rows, and the
mean over both ways round.

Scores are calibrated so that CUT lies where unlabelled documents are rarest, within REACH of the quantile that has
the prior's share of them above it: the valley between both classes. Margins of all unlabelled training documents (of
all positives where none is unlabelled) reach the driver as a histogram of BINS.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batches, lean, records, slices

SAMPLE, HIDDEN, EPOCHS, CUT, SEED = 12_000, 24, 250, 0.7, 11
BINS = 1 << 16
#: Shares of documents that the valley is looked for below and above the prior's quantile.
REACH = 0.05
PROTOTYPES = 4096
#: Marks that are counted one by one.
MARKS = b"*$&#%|!.,?;:-_=+/\\<>@(){}[]\"'~^"
FEATURES = 18 + len(MARKS)


def features(text: str | None) -> list[float]:
    """Shares of characters and words that describe a text's form, not its subject."""
    data = text.encode() if text else b""
    n = max(1, len(data))
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    m = max(1, len(words))
    held = Counter(words)
    lines = data.split(b"\n")
    last = Counter(w[-1] for w in words)
    odd = sum(c for b, c in last.items() if b < 0x80 and not chr(b).isalnum() and b not in b".,;:?!")
    return [
        math.log1p(len(words)),
        len(data) / m / 20,
        count[65:91].sum() / n,
        count[97:123].sum() / n,
        count[48:58].sum() / n,
        count[128:].sum() / n,
        count[10] / n * 20,
        len(held) / m,
        max(held.values(), default=0) / m,
        sum(map(eq, words, words[1:])) / m,
        sum(map(bytes.isupper, words)) / m,
        sum(map(bytes.islower, words)) / m,
        odd / m,
        sum(last.get(b, 0) for b in b".,;:?!") / m,
        1 - len(set(lines)) / len(lines),
        sum(len(w) for w in held) / max(1, len(held)) / 20,
        sum(1 for w in words if len(w) < 3) / m,
        sum(1 for w in words if len(w) > 14) / m,
        *(np.sqrt(count[list(MARKS)] / n) * 3).tolist(),
    ]


class Network:
    def __init__(self, width: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.shift, self.prior = np.zeros(width), np.ones(width), 0.0, 0.5
        self.parts = [rng.normal(0, 1 / math.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN), np.zeros(1)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.parts
        return np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ a + b) @ c + d

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x) + self.shift, -30, 30)))

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, weight: np.ndarray, prior: float) -> Network:
        """weight: the documents that each row of unlabelled stands for."""
        every = np.vstack([positive, unlabelled])
        weight = weight / weight.sum()
        both = np.concatenate([np.full(len(positive), 0.5 / len(positive)), 0.5 * weight])
        self.mean = both @ every
        self.scale = np.sqrt(both @ (every - self.mean) ** 2) + 1e-3
        x = np.clip((every - self.mean) / self.scale, -6, 6)
        p = len(positive)
        first, second = [np.zeros_like(w) for w in self.parts], [np.zeros_like(w) for w in self.parts]
        for epoch in range(1, EPOCHS + 1):
            a, b, c, d = self.parts
            h = np.tanh(x @ a + b)
            g = h @ c + d
            s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
            loss_neg = np.logaddexp(0, g)
            rest = weight @ loss_neg[p:] - prior * loss_neg[:p].mean()
            dg = np.zeros(len(x))
            sign = 1.0 if rest >= 0 else -1.0
            dg[:p] = -sign * prior * s[:p] / p
            dg[p:] = sign * s[p:] * weight
            if rest >= 0:
                dg[:p] += prior * (s[:p] - 1) / p
            dh = dg[:, None] * c * (1 - h * h)
            grads = [x.T @ dh + 1e-4 * a, dh.sum(axis=0), h.T @ dg + 1e-4 * c, np.array([dg.sum()])]
            for k, grad in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                self.parts[k] = self.parts[k] - 0.03 * (first[k] / (1 - 0.9**epoch)) / (np.sqrt(second[k] / (1 - 0.999**epoch)) + 1e-8)
        return self

    def bounds(self) -> tuple[float, float]:
        """No margin lies outside."""
        middle, reach = float(self.parts[3][0]), float(np.abs(self.parts[2]).sum()) + 1e-6
        return middle - reach, middle + reach


def _valley(n: np.ndarray, least: np.ndarray, most: np.ndarray, share: float) -> float:
    """The emptiest place of the margins near the quantile of a share, from bins in order: rows, least and greatest margin.

    A bin's rows are taken as evenly spread between its least and its greatest.
    """
    last = np.cumsum(n) - 1
    ranks, values = np.stack([last - n + 1, last], axis=1).ravel(), np.stack([least, most], axis=1).ravel()
    at = lambda k: np.interp(k, ranks, values)
    n = int(last[-1]) + 1
    m = max(1, n // 200)
    lo, hi = max(0, int((share - REACH) * n)), min(n - 1, int((share + REACH) * n) + m)
    if hi - lo <= m:
        return float(at(share * (n - 1)))
    k = np.concatenate([[lo, hi - m], ranks, ranks - m])  # the width is linear between these ranks
    k = np.unique(k[(k >= lo) & (k <= hi - m)])
    k = k[(at(k + m) - at(k)).argmax()]
    return float(at(k) + at(k + m)) / 2


def estimated_prior(positive: np.ndarray, n: np.ndarray, middle: np.ndarray) -> float:
    """The share of positives among unlabelled rows: positive are margins of positives that the model has not seen, n and middle the rows and margins of the unlabelled ones' bins, in order."""
    if not len(positive) or not len(n):
        return 0.5
    cuts, total = np.unique(positive), n.sum()
    above_p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    above_u = 1 - np.concatenate([[0.0], np.cumsum(n)])[np.searchsorted(middle, cuts)] / total
    slack = math.sqrt(math.log(4 / 0.1) / 2) * (1 / math.sqrt(len(positive)) + 1 / math.sqrt(total))
    best = int(((above_u + slack) / above_p).argmin())
    return min(0.99, max(0.01, float(above_u[best] / above_p[best])))


_ROWS = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("x", pa.binary())])
_SUMS = pa.schema([("k", pa.int32()), ("n", pa.int64()), ("x", pa.binary())])


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, FEATURES).astype(float)


def _describe(frames):
    for ids, hashes, texts in slices(frames, 256):
        x = [np.array(features(t), np.float32).tobytes() for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(x, pa.binary())], schema=_ROWS)


def _margins(model: Network):
    def run(frames):
        for batch in frames:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(model.margin(_matrix(batch.column(0))))], names=["margin"])

    return run


def histogram(rows: DataFrame, model: Network) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, least and greatest margin of each of at most BINS bins that have rows, in order."""
    least, most = model.bounds()
    at = F.floor((F.col("margin") - least) / (most - least) * BINS).alias("bin")
    bins = rows.select("x").mapInArrow(lean(_margins(model)), "margin double").groupBy(at).agg(F.count(F.lit(1)).alias("n"), F.min("margin").alias("least"), F.max("margin").alias("most")).orderBy("bin").toArrow()
    return tuple(bins.column(c).to_numpy() for c in ("n", "least", "most"))


def _assign(known):
    """Rows and sums of features by nearest prototype."""

    def run(frames):
        middle, scale, centres = known.value
        c = (centres - middle) / scale
        square = (c * c).sum(axis=1) / 2
        n, total = np.zeros(len(c), np.int64), np.zeros(c.shape)
        for batch in frames:
            for at in range(0, batch.num_rows, 1024):
                x = _matrix(batch.column(0).slice(at, 1024))
                k = ((x - middle) / scale @ c.T - square).argmax(axis=1)
                n += np.bincount(k, minlength=len(c))
                np.add.at(total, k, x)
        yield from batches(((int(k), int(n[k]), total[k].tobytes()) for k in np.flatnonzero(n)), _SUMS)

    return run


def _added(frames):
    held: dict[int, tuple[int, np.ndarray]] = {}
    for k, n, x in records(frames):
        own = held.get(k, (0, 0.0))
        held[k] = own[0] + n, own[1] + np.frombuffer(x)
    yield from batches(((k, n, x.tobytes()) for k, (n, x) in held.items()), _SUMS)


def summary(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most PROTOTYPES mean vectors of rows (doc_id, x), and how many rows each stands for; every row counts."""
    spark = rows.sparkSession
    centres = _matrix(rows.select("x", F.xxhash64("doc_id").alias("h"), "doc_id").orderBy("h", "doc_id").limit(PROTOTYPES).select("x").toArrow().column("x"))
    if not len(centres):
        return centres, np.empty(0)
    known = spark.sparkContext.broadcast((centres.mean(axis=0), centres.std(axis=0) + 1e-3, centres))
    sums = rows.select("x").mapInArrow(lean(_assign(known)), "k int, n long, x binary").repartition("k").mapInArrow(lean(_added), "k int, n long, x binary").toArrow()  # PROTOTYPES rows
    order = np.argsort(sums.column("k").to_numpy())
    n = sums.column("n").to_numpy()[order].astype(float)
    return np.frombuffer(b"".join(sums.column("x").to_pylist())).reshape(-1, FEATURES)[order] / n[:, None], n


def in_training(modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus != remainder, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2) -> Network:
    """Fit on training rows alone. Contradicting labels of a document count as 0; without positives every score is CUT.

    An id teaches once, however many rows it has: by its text of least hash. Labels other than positives only say
    which documents are not unlabelled.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    ours = known.where(in_training(modulus, remainder) & (F.col("quality") == 1)).select("doc_id")
    with Scratch() as hold:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text"))
        rows = hold(rows.where(in_training(modulus, remainder)).mapInArrow(lean(_describe), "doc_id long, th long, x binary"))
        once = rows.groupBy("doc_id").agg(F.min_by("x", "th").alias("x"))
        positive = hold(once.join(ours, "doc_id"))
        free = hold(once.join(known, "doc_id", "left_anti"))
        some = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(math.ceil(SAMPLE / max(1, positive.count()) * (1 << 20)))
        second = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 21)) >= F.lit(1 << 20)  # a bit that the sample doesn't look at
        found = positive.where(some).orderBy("doc_id").select("x", second.alias("second")).toArrow()
        p, half = _matrix(found.column("x")), found.column("second").to_numpy(zero_copy_only=False)
        model = Network(FEATURES)
        if not len(p):
            model.parts = [np.zeros_like(w) for w in model.parts]
            model.shift = math.log(CUT / (1 - CUT))
            return model
        u, weight = summary(free)
        if len(u):
            priors = []
            for own, fold in ((second, half), (~second, ~half)):
                rows_u, n_u = summary(free.where(own))
                if fold.any() and (~fold).any() and len(rows_u):
                    other = Network(FEATURES).fit(p[fold], rows_u, n_u, 0.5)
                    n, least, most = histogram(free.where(~own), other)
                    priors.append(estimated_prior(other.margin(p[~fold]), n, (least + most) / 2))
            prior = float(np.mean(priors)) if priors else 0.5
        else:
            prior, u, weight = 0.5, p, np.ones(len(p))
        model.prior = prior
        model.fit(p, u, weight, prior)
        model.shift = math.log(CUT / (1 - CUT)) - _valley(*histogram(free if free.count() else positive, model), 1 - prior)
        return model


def scorer(model: Network):
    """A function of a text column: its score, from 0 to 1; null and empty texts have one too."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = [model.score(np.array([features(t) for t in texts.slice(at, 256).to_pylist()])) for at in range(0, len(texts), 256)]
        return pa.array(np.concatenate(out) if out else [], pa.float64())

    return lambda text: score(F.col(text).cast("string"))


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each input row, repeated ones too; extra columns are ignored.

    Inputs of a score are the text's form alone; very long texts are read whole, and rows of equal text tie. A null
    doc_id is neither held out nor trained on. An empty table gives no rows; empty labels give every text the score CUT.
    """
    score = scorer(train(docs, labels, modulus, remainder))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score("text").alias("score"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
