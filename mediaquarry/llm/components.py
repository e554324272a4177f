"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .storage import stored

_SALTS = 8


def _with_low(edges: DataFrame) -> DataFrame:
    """Each edge with the smallest neighbour of ``a``; a hub's edges are spread over the salts."""
    low = edges.groupBy("a").agg(F.min("b").alias("low")).select(
        "a", F.least("a", "low").alias("low"), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")
    )
    return edges.withColumn("salt", F.pmod(F.hash("b"), F.lit(_SALTS))).join(low, ["a", "salt"])


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    large = _with_low(both).where(F.col("b") > F.col("a")).select(
        F.col("b").alias("a"), F.col("low").alias("b")
    ).distinct()
    return _with_low(large).select(
        F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b")
    ).where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of any ordered type → ``(node, root)``: root is the smallest reachable node.

    Nodes without an edge to another node do not appear. Self loops and repeated edges count
    nothing; rows with a null end are left out. Every round is a table in the shared folder; only
    its row count and hash reach the driver.
    """
    current = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = None
    while True:
        found = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == mark or found[0] == 0:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        mark, current = found, stored(_round(current))
