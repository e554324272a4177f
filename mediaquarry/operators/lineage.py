"""Version histories along their parent links, by pointer doubling."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .ordering import join_spread


def history_links(checkpoints: DataFrame) -> DataFrame:
    """``(library, id, parent_id)`` → the same with what its parent links say, a row per checkpoint.

    ``depth`` counts the links to the start of its line and ``start_id`` names it; ``siblings`` counts the
    checkpoints of the same parent, itself included, so 2 and more is a fork; ``lost`` tells that the
    parent is named but not there, which starts a line of its own. ``cycle`` is ``on`` for a checkpoint
    that is its own ancestor, ``below`` for one whose line ends in such a ring, and null otherwise; both
    have neither depth nor start. Ids are unique within a library; an empty or null parent starts a line.

    Each round doubles the length of every pointer, so the longest history takes as many joins as its
    length has bits. A parent with very many children is met in many tasks.
    """
    named = checkpoints.select("library", "id", F.coalesce("parent_id", F.lit("")).alias("parent_id"))
    children = named.groupBy("library", "parent_id").agg(F.count("*").alias("siblings"))
    here = named.select("library", F.col("id").alias("parent_id"), F.lit(True).alias("_there"))
    links = join_spread(named, children, ["library", "parent_id"], ["id"])
    links = join_spread(links, here, ["library", "parent_id"], ["id"], "left")
    there, wanted = F.coalesce("_there", F.lit(False)), F.col("parent_id") != ""
    rows = cut_lineage(links.select(
        "library", "id", "parent_id", F.when(wanted, F.col("siblings")).otherwise(1).alias("siblings"),
        (wanted & ~there).alias("lost"), F.when(there, F.col("parent_id")).alias("up"),
        F.when(there, 1).otherwise(0).cast("bigint").alias("depth"), F.when(~there, F.col("id")).alias("start_id"),
    ))
    longest = rows.groupBy("library").count().agg(F.max("count")).first()[0] or 1
    for _ in range(ceil(log2(longest)) + 1):
        moving = rows.where("up IS NOT NULL")
        if moving.isEmpty():
            break
        # What has arrived at a start stands still; the others jump as far as the row they point at has come.
        ahead = rows.select(
            "library", F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_more"), F.col("start_id").alias("_start")
        )
        jumped = join_spread(moving, ahead, ["library", "up"], ["id"]).select(
            "library", "id", "parent_id", "siblings", "lost", F.col("_up").alias("up"),
            (F.col("depth") + F.col("_more")).alias("depth"), F.col("_start").alias("start_id"),
        )
        rows = cut_lineage(jumped.unionByName(rows.where("up IS NULL")))
    # Pointers as long as the longest history that still point somewhere lie on rings, and reach all of them.
    ring = rows.where("up IS NOT NULL").select("library", F.col("up").alias("id"), F.lit(True).alias("_on")).distinct()
    endless = F.col("up").isNotNull()
    return rows.join(ring, ["library", "id"], "left").select(
        "library", "id", "parent_id", F.when(~endless, F.col("depth")).alias("depth"), "start_id", "siblings", "lost",
        F.when(F.col("_on"), "on").when(endless, "below").alias("cycle"),
    )
