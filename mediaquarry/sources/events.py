"""Change events as a stream or, for the batch twins, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions.capture import wall_clock_ms


def read_change_events(
    spark: SparkSession, path: str, source: str = "parquet", files_per_trigger: int | None = None
) -> DataFrame:
    """Stream of ``(root, kind, path, rename_cookie, observed_at)`` with an explicit schema."""
    reader = spark.readStream.format(source).schema(schemas.EVENT)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def batch_change_events(spark: SparkSession, path: str, source: str = "parquet") -> DataFrame:
    return spark.read.format(source).schema(schemas.EVENT).load(path)


def with_observed_ms(events: DataFrame) -> DataFrame:
    """Adds ``t``: milliseconds, the resolution every rule works in."""
    return events.withColumn("t", wall_clock_ms(F.col("observed_at")))
