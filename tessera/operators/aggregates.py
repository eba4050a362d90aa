"""Aggregation sinks: rows, count, sum and avg of one float column, in total or by key.

Sums and averages of nothing are 0. Partial results of several inputs merge by adding rows, counts and sums.
"""

from __future__ import annotations

import pickle

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..errors import SchemaError
from ..functions import DataType, by_position, engine_type, positions


def _need(df: DataFrame, col: int, kind: DataType, what: str) -> None:
    positions(df, [col])
    have = engine_type(df.schema.fields[col])
    if have is not kind:
        raise SchemaError(f"{what} column {col} is {have.value}, not {kind.value}")


def _measures(value: Column | None) -> list[Column]:
    if value is None:
        return [F.count(F.lit(1)).alias("rows"), F.lit(0).cast("bigint").alias("count"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("avg")]
    return [F.count(F.lit(1)).alias("rows"), F.count(value).alias("count"), F.coalesce(F.sum(value), F.lit(0.0)).alias("sum"), F.coalesce(F.avg(value), F.lit(0.0)).alias("avg")]


def _merged() -> list[Column]:
    n, s = F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.sum("sum"), F.lit(0.0))
    return [F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), n.alias("count"), s.alias("sum"), F.when(n > 0, s / n).otherwise(0.0).alias("avg")]


def _union(results: list[DataFrame]) -> DataFrame:
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


class GlobalFloatAgg:
    def __init__(self, col: int):
        self.col = col

    def __call__(self, df: DataFrame) -> DataFrame:
        """One row, for empty input too."""
        _need(df, self.col, DataType.FLOAT64, "measure")
        return by_position(df).agg(*_measures(F.col(f"_c{self.col}").cast("double")))

    @staticmethod
    def merge(*results: DataFrame) -> DataFrame:
        return _union(list(results)).agg(*_merged())


class _Grouped:
    kind: DataType

    def __init__(self, key: int, value: int = -1):
        self.key_col, self.value_col = key, value

    def _key(self, c: Column) -> Column:
        return c

    def __call__(self, df: DataFrame) -> DataFrame:
        """key, rows, count, sum, avg: a row for each key, null keys together in one. A negative value column only counts rows."""
        _need(df, self.key_col, self.kind, "key")
        value = None
        if self.value_col >= 0:
            _need(df, self.value_col, DataType.FLOAT64, "measure")
            value = F.col(f"_c{self.value_col}").cast("double")
        return by_position(df).groupBy(self._key(F.col(f"_c{self.key_col}")).alias("key")).agg(*_measures(value))

    @staticmethod
    def merge(*results: DataFrame) -> DataFrame:
        """Groups of several results, united by key as it is."""
        return _union(list(results)).groupBy("key").agg(*_merged())

    @staticmethod
    def sorted_rows(result: DataFrame) -> DataFrame:
        """Groups by ascending key, strings bytewise, without the null group."""
        return result.where("key is not null").orderBy("key")

    @staticmethod
    def null_group(result: DataFrame) -> DataFrame:
        """The null group's measures: one row, or none."""
        return result.where("key is null").drop("key")

    @staticmethod
    def has_null_group(result: DataFrame) -> bool:
        return not result.where("key is null").isEmpty()

    @staticmethod
    def size(result: DataFrame) -> int:
        """Number of groups, the null group among them."""
        return result.count()


class GroupByInt64(_Grouped):
    """By key % mod, with the key's sign; mod 0 is the key itself."""

    kind = DataType.INT64

    def __init__(self, key: int, value: int = -1, mod: int = 0):
        super().__init__(key, value)
        self.mod = mod

    def _key(self, c: Column) -> Column:
        c = c.cast("bigint")
        return c % F.lit(self.mod).cast("bigint") if self.mod else c


class GroupByString(_Grouped):
    kind = DataType.STRING


class UserAgg:
    """A user's aggregate of record batches: add(state, batch) and merge(a, b) give states, result(state) a row's cells.

    Each task adds up its own batches; states, not rows, are then merged, FAN at a time. start() gives an empty state;
    empty input has the result of that. States are pickled and must not depend on the order of rows.
    """

    FAN = 64

    def __init__(self, start, add, merge, result, schema: str):
        self.start, self.add, self.merge, self.result, self.schema = start, add, merge, result, schema

    def __call__(self, df: DataFrame) -> DataFrame:
        start, add, merge, result = self.start, self.add, self.merge, self.result
        spark = df.sparkSession
        fields = spark.createDataFrame([], self.schema).schema

        def partial(frames):
            state = start()
            for batch in frames:
                state = add(state, batch)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], ["state"])

        def merged(frames):
            state = start()
            for batch in frames:
                for x in batch.column(0).to_pylist():
                    state = merge(state, pickle.loads(x))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], ["state"])

        def finished(frames):
            for batch in frames:
                cells = [result(pickle.loads(x)) for x in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(zip(*cells), fields)], fields.names)

        states = by_position(df).mapInArrow(partial, "state binary")
        states = states.repartition(self.FAN).mapInArrow(merged, "state binary")
        return states.repartition(1).mapInArrow(merged, "state binary").mapInArrow(finished, self.schema)
