"""Change events: debounce batches, rename pairs, overflow, triggers and sweeps."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import requests, versions
from ..session import shared_dir
from ..sources import adapters
from ..streaming import coalesce as rules, live
from . import base_sql as q
from .registry import query

# The supplied events are sparse, so the rules run with hours instead of milliseconds.
_DEBOUNCE = 6 * 3_600_000
_TIMEOUT = 48 * 3_600_000
_SWEEP = 24 * 3_600_000

_BATCHES = f"""{q.EVENTS}, beat AS (SELECT root, t, count(*) AS n, bool_or(kind = 'overflow') AS o FROM ev GROUP BY root, t),
nxt AS (SELECT root, t, min(t) OVER (PARTITION BY root ORDER BY t RANGE BETWEEN {_DEBOUNCE} FOLLOWING AND UNBOUNDED FOLLOWING) AS u FROM beat),
op AS (WITH RECURSIVE r AS (SELECT root, min(t) AS t FROM beat GROUP BY root
  UNION ALL SELECT r.root, nxt.u FROM r JOIN nxt ON nxt.root = r.root AND nxt.t = r.t WHERE nxt.u IS NOT NULL) SELECT * FROM r),
batch AS (SELECT op.root, op.t AS opened_at, op.t + {_DEBOUNCE} AS due_at, CAST(sum(n) AS BIGINT) AS n_events, bool_or(o) AS had_overflow
  FROM op JOIN beat ON beat.root = op.root AND beat.t >= op.t AND beat.t < op.t + {_DEBOUNCE} GROUP BY op.root, op.t)"""

_RUNS = f"""{q.EVENTS}, ep AS (SELECT *, sum(CAST(kind = 'overflow' AS INTEGER)) OVER (PARTITION BY root ORDER BY t, seq) AS epoch FROM ev),
hf AS (SELECT *, t - lag(t) OVER (PARTITION BY root, rename_cookie, epoch ORDER BY t, seq) AS gap FROM ep
  WHERE kind IN ('renamedFrom', 'renamedTo') AND rename_cookie <> 0),
sg AS (SELECT *, sum(CAST(gap IS NULL OR gap >= {_TIMEOUT} AS INTEGER)) OVER (PARTITION BY root, rename_cookie, epoch ORDER BY t, seq) AS run FROM hf),
runs AS (SELECT root, rename_cookie, epoch, run, count(*) AS halves, count(*) // 2 AS pairs, max(t) AS last_at FROM sg GROUP BY ALL)"""


def _events(t):
    return adapters.events(t)


def _batches(t):
    return rules.coalesce_changes(_events(t), _DEBOUNCE)


@query(f"""WITH {q.EVENTS} SELECT root, kind, count(*) AS events, CAST(sum(rename_cookie) AS BIGINT) AS cookies, min(t) AS first_at FROM ev GROUP BY 1, 2""")
def read_change_events(t):
    return _events(t).groupBy("root", "kind").agg(
        F.count("*").alias("events"), F.sum("rename_cookie").alias("cookies"), F.min("t").alias("first_at")
    )


@query(f"WITH {_BATCHES} SELECT * FROM batch")
def coalesce_changes(t):
    return _batches(t)


@query(f"WITH {_RUNS} SELECT root, rename_cookie, CAST(sum(pairs) AS BIGINT) AS pairs FROM runs GROUP BY 1, 2 HAVING sum(pairs) > 0")
def pair_renames(t):
    return rules.pair_renames(_events(t), _TIMEOUT)


@query(f"""WITH {_RUNS} SELECT runs.root, rename_cookie, last_at AS waiting_since FROM runs
LEFT JOIN (SELECT root, epoch - 1 AS epoch, t AS dropped_at FROM ep WHERE kind = 'overflow') o ON o.root = runs.root AND o.epoch = runs.epoch
WHERE halves % 2 = 1 AND 1706000000000 - last_at >= {_TIMEOUT} AND (dropped_at IS NULL OR dropped_at >= last_at + {_TIMEOUT})""")
def expired_halves(t):
    return rules.expired_halves(_events(t), 1_706_000_000_000, _TIMEOUT)


@query(f"""WITH {q.EVENTS}, e AS (SELECT root, seq, CAST(sum(CAST(kind = 'overflow' AS INTEGER)) OVER (PARTITION BY root ORDER BY t, seq) AS BIGINT) AS epoch FROM ev)
SELECT root, epoch, count(*) AS events FROM e GROUP BY 1, 2""")
def overflow_epochs(t):
    """Epochs count from the start of all roots; relative to the root's first they are its own."""
    rows = rules.overflow_epochs(_events(t))
    per_epoch = rows.groupBy("root", "epoch").agg(
        F.count("*").alias("events"), F.count_if(F.col("kind") == "overflow").alias("_o")
    )
    first = per_epoch.groupBy("root").agg(F.min_by(F.struct("epoch", "_o"), "epoch").alias("f"))
    own = F.col("epoch") - F.col("f.epoch") + F.col("f._o")
    return per_epoch.join(first, "root").select("root", own.alias("epoch"), "events")


@query(f"""WITH {_BATCHES}, pr AS (SELECT root, sum(pairs) AS pairs FROM (WITH {_RUNS} SELECT * FROM runs) GROUP BY root)
SELECT root, count(*) AS batches, CAST(sum(n_events) AS BIGINT) AS events, CAST(count(*) FILTER (had_overflow) AS BIGINT) AS overflowed,
  CAST(coalesce(any_value(pairs), 0) AS BIGINT) AS pairs FROM batch LEFT JOIN pr USING (root) GROUP BY root""")
def coalesce_stats(t):
    return rules.coalesce_stats(_batches(t), rules.pair_renames(_events(t), _TIMEOUT))


@query(f"""WITH {_BATCHES} SELECT 'watch-reconcile:' || root AS coalescing_key, opened_at IN (SELECT min(opened_at) FROM batch b2 WHERE b2.root = batch.root) AS inserted,
  due_at AS created_at_ms, had_overflow FROM batch""")
def reconcile_triggers(t):
    """Due batches as work requests, coalesced against an empty queue."""
    incoming = rules.reconcile_triggers(_batches(t))
    queue = incoming.drop("seq").limit(0)
    _, mapping = requests.enqueue_coalesced(queue, incoming)
    return incoming.join(mapping, "id").select(
        "coalescing_key", (F.col("id") == F.col("effective_id")).alias("inserted"), "created_at_ms",
        (F.get_json_object("payload", "$.triggeredByOverflow") == "true").alias("had_overflow"),
    )


@query(f"""WITH {_BATCHES}, g AS (SELECT root, due_at, lag(due_at) OVER (PARTITION BY root ORDER BY due_at) AS after_ms FROM batch)
SELECT root, after_ms, (due_at - after_ms - 1) // {_SWEEP} AS sweeps FROM g WHERE after_ms IS NOT NULL AND (due_at - after_ms - 1) // {_SWEEP} > 0""")
def periodic_sweeps(t):
    return rules.periodic_sweeps(_batches(t), _SWEEP)


@query(f"""WITH {q.EVENTS} SELECT root, max(t) FILTER (kind = 'created') IS NULL OR 1706500000000 - max(t) FILTER (kind = 'created') >= {_SWEEP} AS due FROM ev GROUP BY root""")
def sweep_due(t):
    last = _events(t).groupBy("root").agg(
        F.max(F.when(F.col("kind") == "created", F.col("t"))).alias("last_reconcile_ms")
    )
    return rules.sweep_due(last, 1_706_500_000_000, _SWEEP).select("root", "due")


# --- the same rules as streams ----------------------------------------------------------------

_DELAY_MS = 3_600_000


def _target(t, name):
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def _bounded(t, name, build, hold):
    events = adapters.change_events(t.stream("events"))
    return live.run_bounded(events, build, _target(t, name), _DELAY_MS, hold)


@query(f"WITH {_BATCHES} SELECT * FROM batch")
def coalesce_stream(t):
    """All batches, found by the streaming job; the closing row hands out the last ones."""
    return _bounded(t, "batches", lambda e: live.coalesce_stream(e, _DEBOUNCE, "1 hour"), _DEBOUNCE)


@query(f"WITH {_RUNS} SELECT root, rename_cookie, CAST(sum(pairs) AS BIGINT) AS pairs FROM runs GROUP BY 1, 2 HAVING sum(pairs) > 0")
def rename_stream(t):
    found = _bounded(t, "pairs", lambda e: live.rename_stream(e, _TIMEOUT, "1 hour"), 0)
    return found.groupBy("root", "rename_cookie").agg(F.count("*").alias("pairs"))


@query(f"""WITH {_BATCHES}, clock AS (SELECT max(t) + {_DEBOUNCE + 1} AS now FROM ev),
g AS (SELECT root, due_at, least(coalesce(lead(due_at) OVER (PARTITION BY root ORDER BY due_at) - 1, now), now) AS until FROM batch, clock)
SELECT root, due_at AS after_ms, (until - due_at) // {_SWEEP} AS sweeps FROM g WHERE (until - due_at) // {_SWEEP} > 0""")
def sweep_stream(t):
    """Sweeps of roots that fell silent, up to the clock at which the bounded stream was closed."""
    found = _bounded(t, "sweeps", lambda e: live.reconcile_stream(e, _DEBOUNCE, _SWEEP, "1 hour"), _DEBOUNCE)
    return found.where("cause = 'sweep'").groupBy("root", F.col("since").alias("after_ms")).agg(
        F.count("*").alias("sweeps")
    )


@query(f"""WITH {_BATCHES} SELECT 'watch-reconcile:' || root AS coalescing_key, 'pending' AS state, due_at AS created_at_ms, had_overflow
FROM batch QUALIFY row_number() OVER (PARTITION BY root ORDER BY opened_at) = 1""")
def trigger_stream(t):
    """The request table of the stream's due batches and sweeps: one pending row per root.

    The sink of ``foreachBatch`` is called once here, with all rows that the bounded stream has written.
    """
    table = _target(t, "requests")
    causes = _bounded(t, "causes", lambda e: live.reconcile_stream(e, _DEBOUNCE, _SWEEP, "1 hour"), _DEBOUNCE)
    live.open_requests(t.spark, table)
    live.enqueue_triggers(table)(causes, 0)
    return live.read_requests(t.spark, table).select(
        "coalescing_key", "state", "created_at_ms",
        (F.get_json_object("payload", "$.triggeredByOverflow") == "true").alias("had_overflow"),
    )


@query("""SELECT 'm' || lpad(CAST(doc_id AS VARCHAR), 20, '0') AS id, text, CAST(1 AS INTEGER) AS version FROM documents""")
def progressive_apply(t):
    """Scan batches upserted as they arrive, then the visible table read back."""
    root = _target(t, "progressive")
    rows = lambda df, n: df.select(
        F.concat(F.lit("m"), F.lpad(F.col("doc_id").cast("string"), 20, "0")).alias("id"), "text", F.lit(n).alias("version")
    )
    versions.publish_version(rows(t.documents, 0), root, "token")
    query_ = (
        rows(t.stream("documents"), 1).writeStream.foreachBatch(live.progressive_apply(root))
        .option("checkpointLocation", f"{root}-state").trigger(availableNow=True).start()
    )
    query_.awaitTermination()
    return versions.read_version(t.spark, root)
