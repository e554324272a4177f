"""The render cache as a table of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ordering import running_total


def cache_misses(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Distinct requested keys without a non-empty entry; equal content is rendered once."""
    filled = entries.where("size_bytes > 0").select("cache_key")
    return requests.select("cache_key").distinct().join(filled, "cache_key", "left_anti")


def cache_total_size(entries: DataFrame) -> DataFrame:
    return entries.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"))


def cache_trim(entries: DataFrame, limit_bytes: int) -> DataFrame:
    """Adds ``evicted``: the least recently written entries go until the rest fits.

    An entry goes exactly when it and all newer ones exceed the limit; equal times are ordered by
    key. A negative limit turns trimming off.
    """
    if limit_bytes < 0:
        return entries.withColumn("evicted", F.lit(False))
    newest_first = [F.col("last_modified_ms").desc(), F.col("cache_key").desc()]
    return running_total(entries, newest_first, "size_bytes", "kept_bytes").withColumn(
        "evicted", F.col("kept_bytes") > limit_bytes
    )


def invalidate_fingerprint(entries: DataFrame, fingerprint_keys: DataFrame) -> DataFrame:
    """Entries left after dropping those of the given fingerprints; an empty key drops nothing."""
    gone = fingerprint_keys.where("fingerprint_key <> ''").select("fingerprint_key")
    return (
        entries.withColumn("fingerprint_key", F.substring_index("cache_key", "/", 1))
        .join(gone, "fingerprint_key", "left_anti").drop("fingerprint_key")
    )
