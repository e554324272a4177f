"""Positions and running sums over one global order, without a single-task window.

Rows are range-partitioned and sorted on the whole order (ties end in a unique key, so even a hot
value spreads over many tasks), checkpointed so that partition contents cannot shift, and numbered
inside each partition. Only one small row per partition, its offset, is broadcast: that side is
bounded by the number of shuffle partitions and does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage, shuffle_width

_ROW_BITS = (1 << 33) - 1


def sorted_once(df: DataFrame, order: list[Column]) -> DataFrame:
    """Globally sorted rows with ``_part`` and ``_row`` (0-based inside the partition)."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    fixed = cut_lineage(ranged)
    return fixed.select(
        "*", F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)).alias("_row"),
    )


def _offsets(parts: DataFrame, amount: str) -> DataFrame:
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return parts.select(
        "_part", F.coalesce(F.sum(amount).over(before), F.lit(0)).alias("_before")
    )


def ordered_positions(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """Adds the 0-based position of each row in ``order``."""
    rows = sorted_once(df, order)
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    placed = rows.join(F.broadcast(_offsets(parts, "_n")), "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")


SALTS = 16


def join_spread(rows: DataFrame, single: DataFrame, keys: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """Joins ``rows`` with a table of one row per key; the rows of a hot key meet it in many tasks.

    The one row is repeated for each salt, and ``by`` deals the rows of a key out to the salts.
    """
    salt = F.pmod(F.hash(*by), F.lit(SALTS))
    repeated = single.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(repeated, [*keys, "_salt"], how).drop("_salt")


def grouped_positions(df: DataFrame, group: list[str], order: list[Column], by: list[str], name: str = "pos") -> DataFrame:
    """Adds the 0-based position of each row inside its group.

    All rows are numbered in one global order, so a group that holds a third of them spans many
    partitions, and the group's first position is subtracted. ``by`` names columns that differ
    inside a group.
    """
    everywhere = ordered_positions(df, [*[F.col(g) for g in group], *order], "_at")
    first = everywhere.groupBy(*group).agg(F.min("_at").alias("_first"))
    joined = join_spread(everywhere, first, group, by)
    return joined.withColumn(name, F.col("_at") - F.col("_first")).drop("_at", "_first")


def running_total(df: DataFrame, order: list[Column], amount: str, name: str) -> DataFrame:
    """Adds the sum of ``amount`` over this row and all rows before it in ``order``."""
    rows = sorted_once(df, order).withColumn("_run", F.col(amount).cast("bigint"))
    parts = rows.groupBy("_part").agg(F.sum("_run").alias("_n"))
    return (
        _summed_inside(rows).join(F.broadcast(_offsets(parts, "_n")), "_part")
        .withColumn(name, F.col("_before") + F.col("_run"))
        .drop("_part", "_row", "_before", "_run")
    )


def _summed_inside(rows: DataFrame) -> DataFrame:
    """``_run`` becomes its sum so far in the partition, without a second shuffle; null before its first value."""
    at = rows.columns.index("_run")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            amounts = batch.column(at)
            met = pa.compute.cumulative_sum_checked(pa.compute.fill_null(amounts, 0), start=total or 0)
            if total is None:
                begun = pa.compute.cumulative_max(pa.compute.cast(pa.compute.is_valid(amounts), pa.int8()))
                met = pa.compute.if_else(pa.compute.equal(begun, 1), met, pa.scalar(None, pa.int64()))
            if len(met) and met[-1].is_valid:
                total = met[-1].as_py()
            yield batch.set_column(at, "_run", met)

    return rows.mapInArrow(run, rows.schema)


def ordered_segments(
    df: DataFrame, order: list[Column], columns: list[str],
    starts: Callable[[Column, Column], Column], name: str = "segment",
) -> DataFrame:
    """Numbers runs of consecutive rows; ``starts(previous, current)`` opens a new run.

    ``previous`` and ``current`` are structs of ``columns``; the first row of all always opens one.
    A partition's first row sees the last row of the partition before it through one summary row.
    """
    here = F.struct(*columns)
    rows = sorted_once(df, order).withColumn("_here", here)
    parts = rows.groupBy("_part").agg(F.max_by("_here", "_row").alias("_tail"))
    carried = parts.select("_part", F.lag("_tail").over(W.orderBy("_part")).alias("_carried"))
    inside = W.partitionBy("_part").orderBy("_row")
    flagged = rows.join(F.broadcast(carried), "_part").withColumn(
        "_prev", F.coalesce(F.lag("_here").over(inside), F.col("_carried"))
    )
    opens = F.when(F.col("_prev").isNull(), True).otherwise(starts(F.col("_prev"), F.col("_here")))
    flagged = flagged.withColumn("_open", F.coalesce(opens, F.lit(True)).cast("bigint"))
    totals = _offsets(flagged.groupBy("_part").agg(F.sum("_open").alias("_n")), "_n")
    run = F.sum("_open").over(inside.rowsBetween(W.unboundedPreceding, 0))
    return (
        flagged.withColumn("_run", run).join(F.broadcast(totals), "_part")
        .withColumn(name, F.col("_before") + F.col("_run"))
        .drop("_part", "_row", "_before", "_run", "_here", "_prev", "_carried", "_open")
    )


def with_previous(df: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    """Adds ``previous``: a struct of ``columns`` of the row before in the global order."""
    rows = sorted_once(df, order).withColumn("_here", F.struct(*columns))
    parts = rows.groupBy("_part").agg(F.max_by("_here", "_row").alias("_tail"))
    carried = parts.select("_part", F.lag("_tail").over(W.orderBy("_part")).alias("_carried"))
    inside = W.partitionBy("_part").orderBy("_row")
    return rows.join(F.broadcast(carried), "_part").withColumn(
        "previous", F.coalesce(F.lag("_here").over(inside), F.col("_carried"))
    ).drop("_part", "_row", "_here", "_carried")
