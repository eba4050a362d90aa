"""The same operators on unbounded input: filters and projections are stateless, so they apply to streams as they are."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


def stream_files(spark: SparkSession, path: str, schema, format: str = "parquet", files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def apply(stream: DataFrame, ops: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    for op in ops:
        stream = op(stream)
    return stream


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write what is there now as Parquet, exactly once, and stop."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
