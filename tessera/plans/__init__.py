"""Running plans: options, execute, SQL with arguments, and the ordered, cancellable cursor."""

from __future__ import annotations

import re
import threading
import uuid
import weakref
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession

from ..errors import OperatorError, QueryCancelled
from ..sources import Source

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@dataclass
class Options:
    """Values that aren't positive become the defaults. Workers and queues are Spark's own; both are kept but do nothing."""

    ops: Sequence[Callable[[DataFrame], DataFrame]] = ()
    workers: int = 0
    queue_size: int = 0
    batch_size: int = 0

    def normalized(self, batch: int = 4096) -> Options:
        return Options(tuple(self.ops), self.workers if self.workers > 0 else 4, self.queue_size if self.queue_size > 0 else 16, self.batch_size if self.batch_size > 0 else batch)


_PIECE = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|\$(\d+)", re.S)


def bind(sql: str, args: Sequence | dict | None) -> tuple[str, Sequence | dict | None]:
    """$1, $2, ... outside of strings, quoted names and comments become named markers; other marks stay."""
    found: set[int] = set()

    def mark(m: re.Match) -> str:
        if m[1] is None:
            return m[0]
        found.add(int(m[1]))
        return f":p{m[1]}"

    text = _PIECE.sub(mark, sql)
    if not found:
        return sql, args
    if not isinstance(args, (list, tuple)) or max(found) > len(args) or min(found) < 1:
        raise ValueError(f"the query needs {max(found)} positional arguments")
    return text, {f"p{i}": args[i - 1] for i in found}


def literals(sql: str, args: Sequence | None) -> str:
    """$1, $2, ... outside of strings, quoted names and comments as literals of the arguments."""

    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, (int, float)):
            return repr(v)
        return "'" + str(v).replace("'", "''") + "'"

    def mark(m: re.Match) -> str:
        if m[1] is None:
            return m[0]
        if not args or not 1 <= int(m[1]) <= len(args):
            raise ValueError(f"the query needs {m[1]} positional arguments")
        return one(args[int(m[1]) - 1])

    return _PIECE.sub(mark, sql)


# Type names of the backend's casts, and Spark's.
CASTS = {"text": "string", "varchar": "string", "float8": "double", "float4": "float", "int8": "bigint", "int4": "int", "int2": "smallint", "bool": "boolean", "bytea": "binary", "timestamptz": "timestamp"}
_DISTINCT_ON = re.compile(r"^\s*select\s+distinct\s+on\s*\((.*?)\)\s*(.*?)\s+from\s+(.*?)\s+order\s+by\s+(.*?)(\s+limit\s+.*)?$", re.I | re.S)


def translate(sql: str) -> str:
    """Forms of the backend's dialect that Spark lacks, as Spark's: casts, ~ on patterns, FETCH FIRST, generate_series, DISTINCT ON.

    Strings, quoted names and comments stay as they are.
    """
    held: list[str] = []

    def hide(m: re.Match) -> str:
        if m[1] is not None:
            return m[0]
        held.append(m[0])
        return f"\x00{len(held) - 1}\x00"

    text = _PIECE.sub(hide, sql)
    text = re.sub(r"::\s*(\w+)\b(?!\s*\()", lambda m: f"::{CASTS.get(m[1].lower(), m[1])}", text)

    def pattern(m: re.Match) -> str:
        at = int(m[3])
        if m[2]:
            held[at] = f"'(?i){held[at][1:]}"
        return f"{'not ' if m[1] else ''}rlike \x00{at}\x00"

    text = re.sub(r"(!)?~(\*)?\s*\x00(\d+)\x00", pattern, text)
    text = re.sub(r"\bfetch\s+(?:first|next)\s+(\d+)\s+rows?\s+only\b", r"limit \1", text, flags=re.I)
    text = re.sub(r"\bgenerate_series\s*\(([^()]*)\)", r"(select explode(sequence(\1)) as generate_series)", text, flags=re.I)
    if m := _DISTINCT_ON.match(text):
        on, what, rest, order, limit = m.groups()
        text = f"select {what} from (select *, row_number() over (partition by {on} order by {order}) as tessera_row from {rest}) where tessera_row = 1 order by {order}{limit or ''}"
    return re.sub(r"\x00(\d+)\x00", lambda m: held[int(m[1])], text)


_VIEWS: weakref.WeakKeyDictionary[SparkSession, dict[str, str]] = weakref.WeakKeyDictionary()


def register_tables(spark: SparkSession, sf_dir: str, tables: Sequence[str] = TABLES) -> None:
    """Views of the tables in a folder; each is opened once a session and folder."""
    known = _VIEWS.setdefault(spark, {})
    for name in tables:
        if known.get(name) != sf_dir or not spark.catalog.tableExists(name):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
            known[name] = sf_dir


def named_tables(sql: str) -> list[str]:
    """The tables that a text names."""
    words = {w.lower() for w in re.findall(r"\w+", sql)}
    return [t for t in TABLES if t in words]


def execute(spark: SparkSession, source: Source, options: Options | None = None) -> DataFrame:
    """The source's rows after all operators, in source order as long as no operator shuffles."""
    options = (options or Options()).normalized()
    sized = getattr(source, "set_chunk_size", None)
    if sized:
        sized(options.batch_size)
    df = source.open(spark)
    for op in options.ops:
        df = op(df)
    return df


class Cursor:
    """Rows in order, in chunks; close() and cancel() are idempotent, and the end state stays.

    The error that next() meets first stays, whatever close() or cancel() do later. A call with a timeout that runs out leaves the
    run alive: what it waited for comes with a later call.
    """

    def __init__(self, df: DataFrame, chunk: int = 4096):
        self.schema, self.chunk = df.schema, chunk if chunk > 0 else 4096
        self._df, self._tag = df, f"tessera-{uuid.uuid4().hex}"
        self._rows: Iterator[Row] | None = None
        self._end: BaseException | None = None
        self._over = self._cancelled = False
        self._lock = threading.Lock()
        self._pool = ThreadPoolExecutor(1, thread_name_prefix=self._tag)
        self._pending: Future | None = None

    def _fetch(self) -> list[Row]:
        spark, out = self._df.sparkSession, []
        with self._lock:
            spark.addTag(self._tag)
            try:
                if self._rows is None:
                    self._rows = self._df.toLocalIterator(prefetchPartitions=True)
                while len(out) < self.chunk:
                    row = next(self._rows, None)
                    if row is None:
                        self._over = True
                        break
                    out.append(row)
            finally:
                spark.removeTag(self._tag)
        return out

    def next(self, timeout: float | None = None) -> list[Row] | None:
        """The next chunk, None at the end; a failed run fails again the same way. TimeoutError after so many seconds."""
        if self._end:
            raise self._end
        if self._over and self._pending is None:
            return None
        try:
            self._pending = self._pending or self._pool.submit(self._fetch)
            out = self._pending.result(timeout)
            self._pending = None
            if self._cancelled:
                raise QueryCancelled("the query was cancelled")
        except FutureTimeout:
            if self._pending is not None and not self._pending.done():
                raise TimeoutError(f"no chunk within {timeout} s; the query goes on") from None
            raise
        except QueryCancelled as e:
            self._end, self._over = e, True
            raise
        except Exception as e:
            self._over, self._pending = True, None
            self._end = QueryCancelled("the query was cancelled") if self._cancelled else OperatorError(str(e))
            raise self._end from (e if isinstance(e, PySparkException) else e)
        return out or None

    def cancel(self) -> None:
        """Stop the run; the next call of next() raises QueryCancelled."""
        if not self._over:
            self._cancelled = True
            self._df.sparkSession.interruptTag(self._tag)

    def close(self) -> None:
        """Let go of the run; an error that next() has raised stays, one not yet seen is dropped."""
        if not self._over or self._pending is not None:
            self._over, self._pending = True, None
            self._df.sparkSession.interruptTag(self._tag)
        self._pool.shutdown(wait=False)
        self._rows = None

    def __iter__(self):
        while (chunk := self.next()) is not None:
            yield from chunk

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()
