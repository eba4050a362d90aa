"""Sources: anything with open(spark) -> DataFrame, whose schema is known as soon as it is open."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import SchemaError
from ..functions import DataType, pack_rows, refuse

DEFAULT_CHUNK = 1024


class Source(Protocol):
    def open(self, spark: SparkSession) -> DataFrame: ...


class ChunkSized:
    """Takes a hint of rows a chunk; hints that aren't positive are ignored."""

    chunk_size = DEFAULT_CHUNK

    def set_chunk_size(self, n: int) -> None:
        if n > 0:
            self.chunk_size = n


@dataclass
class FrameSource:
    df: DataFrame

    def open(self, spark: SparkSession) -> DataFrame:
        return self.df


@dataclass
class FileSource:
    """Files of any format that Spark reads: parquet, orc, json, csv, text."""

    path: str
    format: str = "parquet"
    options: dict = field(default_factory=dict)
    schema: str | None = None

    def open(self, spark: SparkSession) -> DataFrame:
        reader = spark.read.format(self.format).options(**self.options)
        return (reader.schema(self.schema) if self.schema else reader).load(self.path)


@dataclass
class RowsSource:
    """Rows in memory, padded or cut to the schema."""

    schema: Sequence[tuple[str, DataType]]
    rows: Sequence[Sequence]

    def open(self, spark: SparkSession) -> DataFrame:
        return pack_rows(spark, self.schema, self.rows)


@dataclass
class RangeSource:
    """first .. last, both included."""

    first: int
    last: int
    name: str = "g"

    def open(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.first, self.last + 1).withColumnRenamed("id", self.name)


@dataclass
class SqlSource(ChunkSized):
    """A SQL text with positional ($1 or ?) or named (:name) arguments, over registered views."""

    sql: str
    args: Sequence | dict | None = None

    def open(self, spark: SparkSession) -> DataFrame:
        from ..plans import bind, translate

        text, args = bind(translate(self.sql), self.args)
        return spark.sql(text, args) if args else spark.sql(text)


@dataclass
class JdbcSource(ChunkSized):
    """A SQL text sent to a JDBC server as it is but for its arguments, which stand in it as literals for $1, $2, ....

    numeric columns load as text where named in numeric; with partition_column the table option is split in parts.
    Times of day and intervals are refused.
    """

    url: str
    sql: str
    numeric: Sequence[str] = ()
    partition_column: str | None = None
    bounds: tuple[int, int] = (0, 0)
    parts: int = 1
    properties: dict = field(default_factory=dict)
    args: Sequence | None = None

    def options(self) -> dict[str, str]:
        from ..plans import literals

        sql = literals(self.sql, self.args)
        out = {"url": self.url, "fetchsize": str(self.chunk_size), "preferTimestampNTZ": "true", **self.properties}
        if self.numeric:
            out["customSchema"] = ", ".join(f"{n} STRING" for n in self.numeric)
        if self.partition_column:
            return out | {"dbtable": f"({sql}) t", "partitionColumn": self.partition_column, "lowerBound": str(self.bounds[0]), "upperBound": str(self.bounds[1]), "numPartitions": str(self.parts)}
        return out | {"query": sql}

    def open(self, spark: SparkSession) -> DataFrame:
        return refuse(spark.read.format("jdbc").options(**self.options()).load())


class _Parts(DataSourceReader):
    def __init__(self, parts: int, read: Callable[[int], Iterator]):
        self.count, self.rows = parts, read

    def partitions(self):
        return [InputPartition(i) for i in range(self.count)]

    def read(self, partition):
        yield from self.rows(partition.value)


@dataclass
class CustomSource:
    """A user's source: read(part) gives that part's rows, as tuples or Arrow record batches, on an executor."""

    name: str
    schema: str
    read: Callable[[int], Iterator]
    parts: int = 1

    def open(self, spark: SparkSession) -> DataFrame:
        if self.parts < 1:
            raise SchemaError("a source has at least one part")
        name, schema, read, parts = self.name, self.schema, self.read, self.parts

        class Own(DataSource):
            @classmethod
            def name(cls):
                return name

            def schema(self):
                return schema

            def reader(self, schema):
                return _Parts(parts, read)

        spark.dataSource.register(Own)
        return spark.read.format(name).load()


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    df.write.format(format).mode(mode).partitionBy(*partition_by).save(path)


def series(spark: SparkSession, n: int) -> DataFrame:
    """The benchmark table: id, f, t and ts for g = 1..n."""
    g = F.col("id")
    return spark.range(1, n + 1).select(g, ((g % 100000) / 100000.0).alias("f"), F.concat(F.lit("txt_"), (g % 1000).cast("string")).alias("t"), F.timestamp_seconds(F.unix_timestamp(F.lit("2020-01-01 00:00:00")) + g).alias("ts"))
