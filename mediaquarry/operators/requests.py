"""The work-request table: coalescing, claiming and state changes as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import retryable
from .ordering import join_spread

def enqueue_coalesced(queue: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows to insert, mapping id → effective_id)`` for ``incoming`` in ``seq`` order.

    A non-empty key that already has a pending row, in the table or earlier in the batch, adds
    nothing and answers with that row's id. Running rows do not block. One map-side combined
    minimum per key, so a key named by a third of the batch costs one row per task.
    """
    pending = (
        queue.where("state = 'pending' AND coalescing_key <> ''")
        .groupBy("coalescing_key").agg(F.min("id").alias("pending_id"))
    )
    # A request that arrives already running or finished never blocks a later one.
    first = (
        incoming.where("state = 'pending' AND coalescing_key <> ''")
        .groupBy("coalescing_key").agg(F.min_by("id", "seq").alias("first_id"), F.min("seq").alias("first_seq"))
    )
    # Requests without a key never meet another and pass the join by.
    keyed = incoming.where("coalescing_key <> ''")
    known = pending.join(first, "coalescing_key", "full")
    earlier = F.coalesce(F.col("first_seq") < F.col("seq"), F.lit(False))
    effective = F.coalesce("pending_id", F.when(earlier, F.col("first_id")), "id")
    judged = join_spread(keyed, known, ["coalescing_key"], ["id"], "left").withColumn("effective_id", effective)
    alone = incoming.where("coalesce(coalescing_key, '') = ''").withColumn("effective_id", F.col("id"))
    judged = judged.select(*alone.columns).unionByName(alone)
    rows = judged.where("effective_id = id").select(queue.columns)
    return rows, judged.select("id", "effective_id")


def claim_order(nulls_last: bool = False) -> list[Column]:
    created = F.col("created_at_ms")
    return [
        F.col("priority").asc(),
        created.asc_nulls_last() if nulls_last else created.asc_nulls_first(),
        F.col("id").asc(),
    ]


def claimable(queue: DataFrame, now_ms: int, limit: int, nulls_last: bool = False) -> DataFrame:
    """The next rows to work on; a top-k, so only ``limit`` rows per task are kept."""
    ready = (F.col("state") == "pending") & (
        F.col("not_before_ms").isNull() | (F.col("not_before_ms") <= now_ms)
    )
    return queue.where(ready).orderBy(*claim_order(nulls_last)).limit(max(limit, 0))


def list_pending(queue: DataFrame, nulls_last: bool = False) -> DataFrame:
    return queue.where("state = 'pending'").orderBy(*claim_order(nulls_last))


def pending_count(queue: DataFrame) -> DataFrame:
    return queue.agg(F.count_if(F.col("state") == "pending").alias("pending"))


def _step(row: Column, step: Column) -> Column:
    """One outcome applied to the changing part of a request; a step that its state forbids changes nothing."""
    outcome, running = step["outcome"], row["state"] == "running"
    won, lost = (outcome == "succeeded") & running, (outcome == "failed") & running
    tries = row["attempts"] + F.when(won | lost, 1).otherwise(0)
    again = lost & F.coalesce(retryable(step["error"]), F.lit(False)) & (tries < row["max_attempts"])
    state = (
        F.when(again, "pending").when(lost, "failed").when(won, "succeeded")
        .when((outcome == "cancelled") & (running | (row["state"] == "pending")), "cancelled")
        .when((outcome == "claimed") & (row["state"] == "pending"), "running")
        .otherwise(row["state"])
    )
    return F.struct(
        state.alias("state"), tries.alias("attempts"), row["max_attempts"].alias("max_attempts"),
        F.when(again, None).otherwise(row["not_before_ms"]).alias("not_before_ms"),
        F.when(lost, step["error"]).otherwise(row["last_error_code"]).alias("last_error_code"),
    )


def transition(queue: DataFrame, outcomes: DataFrame, order: str | None = None) -> DataFrame:
    """``outcomes(id, outcome, error_code)`` with outcome ``claimed``, ``succeeded``, ``failed`` or
    ``cancelled``; rows whose state does not allow the step stay as they are.

    Several outcomes of one id are applied one after the other, by the column ``order``; without it
    each id must have one. The outcomes of an id are its own short history, so they are gathered in
    one row and the queue keeps exactly one row per id.
    """
    place = F.col(order) if order else F.lit(0)
    steps = outcomes.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(
        place.alias("at"), F.col("outcome").alias("outcome"), F.col("error_code").alias("error")
    ))).alias("_steps"))
    if not order:
        steps = steps.withColumn("_steps", F.when(F.size("_steps") > 1, F.raise_error(
            F.lit("several outcomes for one id need an order")
        )).otherwise(F.col("_steps")))
    parts = ["state", "attempts", "max_attempts", "not_before_ms", "last_error_code"]
    joined = queue.join(steps, "id", "left").withColumn("_row", F.struct(*parts))
    moved = joined.withColumn("_row", F.coalesce(F.aggregate("_steps", F.col("_row"), _step), F.col("_row")))
    return moved.select(*[F.col(f"_row.{c}").alias(c) if c in parts else F.col(c) for c in queue.columns])


def recover_interrupted(queue: DataFrame) -> DataFrame:
    """After a crash every running row is pending again."""
    return queue.withColumn(
        "state", F.when(F.col("state") == "running", "pending").otherwise(F.col("state"))
    )
