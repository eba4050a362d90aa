"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries of a worker's word cache; it is emptied when full, so its memory is bounded.
CACHE_WORDS = 150_000
NO_ID = 9223372036854775807


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share; a local one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}").rstrip("/")


class Scratch:
    """Tables written as Parquet in the shared folder and read again: lineage ends there and survives lost executors.

    At the end of a with block all are deleted but those to keep, which the result still reads.
    """

    def __init__(self):
        self.paths: list[tuple[SparkSession, str, DataFrame]] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
        self.paths.append((spark, path, None))
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
        self.paths[-1] = spark, path, out
        return out

    @property
    def tables(self) -> list[DataFrame]:
        return [x[2] for x in self.paths]

    def keep(self, df: DataFrame) -> DataFrame:
        self.paths = [x for x in self.paths if x[2] is not df]
        return df

    def drop(self, *frames: DataFrame) -> None:
        """Delete these now; nothing reads them any more."""
        gone = [x for x in self.paths if any(x[2] is f for f in frames)]
        self.paths = [x for x in self.paths if x not in gone]
        for spark, path, _ in gone:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for spark, path, _ in self.paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
        self.paths = []


def materialize(df: DataFrame) -> DataFrame:
    """Write df and read it again, for a result: its table stays."""
    hold = Scratch()
    return hold.keep(hold(df))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, th and text: rows that agree in doc_id and th (the text's hash) are copies of one row and get equal results."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text"))


def unused(df: DataFrame, *stems: str) -> list[str]:
    """The stems as names that no column of df has."""
    held = {c.lower() for c in df.columns}
    end = next(e for e in ("_" * k for k in range(1, 10**6)) if not any((s + e).lower() in held for s in stems))
    return [s + end for s in stems]


def same(a, b):
    return a.eqNullSafe(b)


def ascii_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as UTF-8; bytes.split() divides at exactly those six characters."""
    return text.encode().split() if text else []


def ascii_lower(text: str | None) -> bytes:
    """UTF-8 with A-Z alone lower-cased; bytes.lower() leaves all else."""
    return text.encode().lower() if text else b""


#: Bytes outside [0-9a-z\x80-\xff] become blanks.
_LETTERS = bytes(c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c >= 0x80 else 0x20 for c in range(256))


def letter_words(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased."""
    return ascii_lower(text).translate(_LETTERS).split()


class WordHashes(dict):
    """word -> 64-bit hash, computed once for as long as it stays cached."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_MUL, _ADD = np.uint64(0x9FB21C651E98DF25), 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with every output bit depending on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive entries of h, by start."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    acc = np.full(m, (n * _ADD) % 2**64, np.uint64)
    for j in range(n):
        acc = (acc ^ h[j : j + m]) * _MUL
        acc ^= acc >> np.uint64(29)
    return mixed(acc)


def shingle_set(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles; fewer words make one shingle of them all, none make none."""
    return np.unique(grams(h, min(n, len(h)))) if len(h) else h


def lean(run):
    """run, and after it the worker's memory goes back to the system: workers live on, idle, while other stages need it."""

    def wrapped(frames):
        try:
            yield from run(frames)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim:
                trim(0)

    return wrapped


def batches(rows, schema: pa.Schema, size: int = 4096):
    """Row tuples as record batches of at most size rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def slices(frames, size: int = 128):
    """Columns of record batches as lists, of at most size rows at a time."""
    for batch in frames:
        for at in range(0, batch.num_rows, size):
            yield [c.to_pylist() for c in batch.slice(at, size).columns]


def records(frames):
    """Tuples of the rows of record batches."""
    for columns in slices(frames):
        yield from zip(*columns)
