"""Filters, projections and user operators: checked when built on a DataFrame, then plain Catalyst expressions."""

from __future__ import annotations

import enum
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SchemaError
from ..functions import DataType, by_position, engine_type, is_nan, positions
from .aggregates import GlobalFloatAgg, GroupByInt64, GroupByString, UserAgg

__all__ = ["BoolFilter", "Cmp", "Custom", "Filter", "FilterProject", "Float64Filter", "GlobalFloatAgg", "GroupByInt64", "GroupByString", "Int64Filter", "MapBatches", "Project", "RowFilter", "StringFilter", "UserAgg", "filter_float64_gt_project"]


class Cmp(enum.Enum):
    EQ = "="
    NE = "<>"
    GT = ">"
    GE = ">="
    LT = "<"
    LE = "<="

    def __str__(self) -> str:
        return self.value

    def of(self, c: Column, v) -> Column:
        v = F.lit(v)
        return {"=": c == v, "<>": c != v, ">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[self.value]


@dataclass(frozen=True)
class Filter:
    """Keeps rows whose column compares as asked; null never does. The column's type must be exactly `kind`."""

    col: int
    cmp: Cmp
    value: object
    kind: DataType

    def __call__(self, df: DataFrame) -> DataFrame:
        positions(df, [self.col])
        have = engine_type(df.schema.fields[self.col])
        if have is not self.kind:
            raise SchemaError(f"column {self.col} is {have.value}, the filter is for {self.kind.value}")
        if self.kind not in (DataType.INT64, DataType.FLOAT64, DataType.STRING, DataType.BOOL):
            raise SchemaError(f"{self.kind.value} columns can't be filtered")
        if self.kind is DataType.STRING and self.cmp not in (Cmp.EQ, Cmp.NE):
            raise SchemaError("strings compare by = and <> only")
        if self.kind is DataType.BOOL and self.cmp is not Cmp.EQ:
            raise SchemaError("bools compare by = only")
        names = df.columns
        return by_position(df).where(self.condition(F.col(f"_c{self.col}"))).toDF(*names)

    def condition(self, c: Column) -> Column:
        """Floats compare as IEEE says: NaN only differs. The extra term keeps the comparison pushed to the scan."""
        if is_nan(self.value):
            return c.isNotNull() if self.cmp is Cmp.NE else F.lit(False)
        if self.kind is DataType.FLOAT64 and self.cmp in (Cmp.GT, Cmp.GE):
            return self.cmp.of(c, self.value) & ~F.isnan(c)
        return self.cmp.of(c, self.value)


def Int64Filter(col: int, cmp: Cmp, value: int) -> Filter:
    return Filter(col, cmp, int(value), DataType.INT64)


def Float64Filter(col: int, cmp: Cmp, value: float) -> Filter:
    return Filter(col, cmp, float(value), DataType.FLOAT64)


def StringFilter(col: int, cmp: Cmp, value: str) -> Filter:
    return Filter(col, cmp, value, DataType.STRING)


def BoolFilter(col: int, value: bool) -> Filter:
    return Filter(col, Cmp.EQ, bool(value), DataType.BOOL)


class Project:
    """Columns by position, in any order and as often as asked; names are kept and may repeat."""

    def __init__(self, *indices: int):
        self.indices = indices

    def __call__(self, df: DataFrame) -> DataFrame:
        positions(df, self.indices)
        names = df.columns
        return by_position(df).select(*(F.col(f"_c{i}") for i in self.indices)).toDF(*(names[i] for i in self.indices))


@dataclass(frozen=True)
class FilterProject:
    filter: Filter
    indices: Sequence[int]

    def __call__(self, df: DataFrame) -> DataFrame:
        return Project(*self.indices)(self.filter(df))


def filter_float64_gt_project(col: int, threshold: float, *indices: int) -> FilterProject:
    return FilterProject(Float64Filter(col, Cmp.GT, threshold), indices)


@dataclass(frozen=True)
class RowFilter:
    """Keeps rows for which predicate(list of cells) is true; what it raises fails the query.

    The predicate is Python, called row by row; the typed filters are pushed down to the scan instead.
    """

    predicate: Callable[[list], bool]

    def __call__(self, df: DataFrame) -> DataFrame:
        keep = self.predicate

        def run(frames: Iterable[pa.RecordBatch]):
            for batch in frames:
                rows = zip(*(c.to_pylist() for c in batch.columns)) if batch.num_columns else iter([()] * batch.num_rows)
                yield batch.filter(pa.array([bool(keep(list(r))) for r in rows], pa.bool_()))

        names = df.columns
        flat = by_position(df)
        return flat.mapInArrow(run, flat.schema).toDF(*names)


@dataclass(frozen=True)
class MapBatches:
    """A user operator on Arrow record batches, without state across them."""

    fn: Callable[[pa.RecordBatch], pa.RecordBatch]
    schema: str

    def __call__(self, df: DataFrame) -> DataFrame:
        fn = self.fn
        return df.mapInArrow(lambda frames: (fn(b) for b in frames), self.schema)


@dataclass(frozen=True)
class Custom:
    """Any DataFrame transformation as an operator."""

    fn: Callable[[DataFrame], DataFrame]

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.transform(self.fn)
