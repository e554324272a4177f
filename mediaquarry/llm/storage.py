"""Tables kept in the shared folder between steps, and the hold-out rule of the learning operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_dir


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/llm-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, *parts: str) -> DataFrame:
    """Write the rows as Parquet below ``spark.checkpoint.dir`` and read them back.

    Lineage ends here, so a lost executor costs no recomputation, and the reader has real sizes:
    the planner may broadcast what is under its threshold and split what is skewed. With ``parts``, a
    reader that asks for some values of these columns opens no other files.
    """
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    (df.write.partitionBy(*parts) if parts else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove what ``stored`` kept in this application; call it when no result is read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int) -> tuple[DataFrame, bool]:
    """Store ``df`` and broadcast it if it has at most ``rows`` rows; larger ones stay plain joins."""
    kept = stored(df)
    fits = kept.count() <= rows
    return (F.broadcast(kept) if fits else kept), fits


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns: those given, made longer until the table has no such column."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor
