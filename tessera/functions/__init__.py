"""The seven engine types, their Spark types, and column helpers."""

from __future__ import annotations

import enum
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError


class DataType(enum.Enum):
    INT64 = "Int64"
    FLOAT64 = "Float64"
    BOOL = "Bool"
    STRING = "String"
    BYTES = "Bytes"
    TIME = "Time"
    NUMERIC = "Numeric"


TAG = "engine_type"
_SPARK = {DataType.INT64: T.LongType(), DataType.FLOAT64: T.DoubleType(), DataType.BOOL: T.BooleanType(), DataType.STRING: T.StringType(), DataType.BYTES: T.BinaryType(), DataType.TIME: T.TimestampType(), DataType.NUMERIC: T.StringType()}
# Names of backend types and the engine types they load as; any other name is a String.
BACKEND = {
    "int2": DataType.INT64, "int4": DataType.INT64, "int8": DataType.INT64, "float4": DataType.FLOAT64, "float8": DataType.FLOAT64,
    "bool": DataType.BOOL, "bytea": DataType.BYTES, "date": DataType.TIME, "time": DataType.TIME, "timetz": DataType.TIME,
    "timestamp": DataType.TIME, "timestamptz": DataType.TIME, "interval": DataType.TIME, "numeric": DataType.NUMERIC,
}


def map_backend_type(name: str) -> DataType:
    return BACKEND.get(name.lower(), DataType.STRING)


def type_name(value) -> str:
    return value.value if isinstance(value, DataType) else "Unknown"


def spark_type(kind: DataType) -> T.DataType:
    return _SPARK[kind]


def engine_type(field: T.StructField) -> DataType:
    """A field's engine type; a metadata tag goes first, unknown Spark types are Strings."""
    if field.metadata.get(TAG):
        return DataType(field.metadata[TAG])
    t = field.dataType
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return DataType.INT64
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return DataType.FLOAT64
    if isinstance(t, T.BooleanType):
        return DataType.BOOL
    if isinstance(t, T.BinaryType):
        return DataType.BYTES
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DataType.TIME
    return DataType.NUMERIC if isinstance(t, T.DecimalType) else DataType.STRING


def refuse(df: DataFrame) -> DataFrame:
    """df, unless it has times of day or intervals, which the typed scan doesn't load."""
    for f in df.schema.fields:
        if f.dataType.typeName().split("(")[0].split(" ")[0] in ("time", "interval") or "interval" in f.dataType.simpleString():
            raise SchemaError(f"column {f.name} is {f.dataType.simpleString()}, which a typed scan can't load")
    return df


def normalize(df: DataFrame) -> DataFrame:
    """Integers widen to bigint, float to double, dates to UTC midnight, decimals to tagged text, arrays, maps and structs to JSON text; all else stays.

    Times of day and intervals are refused.
    """
    refuse(df)
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), engine_type(f)
        if kind is DataType.INT64:
            c = c.cast("bigint")
        elif kind is DataType.FLOAT64:
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        elif kind is DataType.NUMERIC and not isinstance(f.dataType, T.StringType):
            c = c.cast("string")
        out.append(c.alias(f.name, metadata={**f.metadata, TAG: kind.value}))
    return df.select(*out)


def pack_rows(spark: SparkSession, schema: Sequence[tuple[str, DataType]], rows: Sequence[Sequence]) -> DataFrame:
    """Rows as a DataFrame: short rows are filled with null, further cells dropped, wrong types refused."""
    fields = [T.StructField(n, spark_type(k), True, {TAG: k.value}) for n, k in schema]
    width = len(fields)
    padded = [tuple(r[:width]) + (None,) * (width - len(r)) for r in map(tuple, rows)]
    return spark.createDataFrame(padded, T.StructType(fields), verifySchema=True)


def parse_bool(c: Column) -> Column:
    """t true 1 f false 0 as boolean; any other text fails the query."""
    return F.when(c.isin("t", "true", "1"), True).when(c.isin("f", "false", "0"), False).when(c.isNotNull(), F.raise_error(F.concat(F.lit("not a bool: "), c)).cast("boolean"))


def _parsed(c: Column, pattern: str, to: str, what: str) -> Column:
    text = F.trim(c)
    value = F.when(text.rlike(pattern), text).try_cast(to)
    return F.when(value.isNotNull(), value).when(c.isNotNull(), F.raise_error(F.concat(F.lit(f"not {what}: "), c)).cast(to))


def parse_int(c: Column) -> Column:
    """Digits with a sign as bigint; any other text, or too large a number, fails the query."""
    return _parsed(c, r"^[+-]?[0-9]+$", "bigint", "an integer")


def parse_float(c: Column) -> Column:
    """Text as double, NaN and Infinity too; any other text fails the query."""
    return _parsed(c, r"(?i)^([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|nan|[+-]?inf(inity)?)$", "double", "a float")


def parse_numeric(c: Column) -> Column:
    """Numeric text as it is, of any precision; any other text fails the query."""
    return _parsed(c, r"(?i)^([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|nan)$", "string", "a numeric")


def parse_bytes(c: Column) -> Column:
    r"""\x hex text as its bytes, other text as it is."""
    return F.when(c.startswith("\\x"), F.unhex(F.substring(c, 3, 2147483647))).otherwise(c.cast("binary"))


def parse_time(c: Column) -> Column:
    """Text as timestamp; infinite ones fail the query."""
    return F.when(c.isin("infinity", "-infinity"), F.raise_error(F.lit("infinite timestamps are not supported")).cast("timestamp")).otherwise(F.to_timestamp(c))


def positions(df: DataFrame, indices: Sequence[int]) -> None:
    if not indices:
        raise SchemaError("a projection needs at least one column")
    for i in indices:
        if not isinstance(i, int) or isinstance(i, bool) or not 0 <= i < len(df.columns):
            raise SchemaError(f"column index {i} is out of range for {len(df.columns)} columns")


def by_position(df: DataFrame) -> DataFrame:
    """df with columns named _c0, _c1, ... so that equal names can't clash."""
    return df.toDF(*(f"_c{i}" for i in range(len(df.columns))))


def is_nan(v) -> bool:
    return isinstance(v, float) and math.isnan(v)
