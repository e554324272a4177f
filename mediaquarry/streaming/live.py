"""The change-event rules as streaming queries, equal to their batch twins behind the watermark.

Events are buffered until the watermark has passed them and then taken in time order, so the
result does not depend on how they arrived. State per root is the open batch plus the ticks of one
watermark delay. Rows later than the watermark are left to the periodic sweep. ``run_bounded`` ends a
source that has an end, so that nothing stays open.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import schemas
from ..functions import fixed_values as fv
from ..functions.capture import from_wall_clock_ms, wall_clock_ms
from ..operators import requests
from ..operators.versions import Conflict, commit, last_per_id
from ..session import cut_lineage
from . import coalesce as rules

BATCH = "root string, opened_at bigint, due_at bigint, n_events bigint, had_overflow boolean"
TRIGGER = "root string, cause string, at bigint, since bigint, n_events bigint, had_overflow boolean"
PAIR = "root string, rename_cookie bigint, first_at bigint, paired_at bigint"
#: Kind of the control row that ends a bounded stream.
CLOSING = "closing"
#: Parts of a root's cookies that have state of their own. Each is a key that every overflow of the root
#: goes to, and a key costs state calls even if it never sees a half.
_SHARES = 4


class Coalescer(StatefulProcessor):
    """One open debounce batch per root; ticks wait in a list that is read and written once a batch."""

    def __init__(self, debounce_ms: int):
        self.debounce = debounce_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, n long, overflow boolean")
        self.open = handle.getValueState("open", "opened_at long, n long, overflow boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = [
            (int(t), int(n), bool(overflow)) for pdf in rows
            for t, n, overflow in zip(pdf["t"], pdf["n"], pdf["overflow"])
        ]
        yield from self._drain(key, timerValues.getCurrentWatermarkInMs(), fresh)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._drain(key, timerValues.getCurrentWatermarkInMs(), [])

    def _due(self, watermark: int, fresh: list[tuple[int, int, bool]]) -> tuple[list[tuple[int, int, bool]], int | None]:
        """The batches that are due behind the watermark, as ``(opened_at, n, overflow)``, and when to wake.

        Every state call is a round trip to the JVM: fresh ticks that are taken at once are never
        stored, and state is written only where it differs from what was read.
        """
        old = [tuple(row) for row in self.waiting.get()] if self.waiting.exists() else []
        was = self.open.get()
        was = now = tuple(was) if was is not None else None
        ticks = sorted(old + fresh)
        later = [tick for tick in ticks if tick[0] >= watermark]
        done = []
        for t, n, overflow in ticks[: len(ticks) - len(later)]:
            if now is not None and t >= now[0] + self.debounce:
                done.append(now)
                now = None
            now = (t, n, overflow) if now is None else (now[0], now[1] + n, now[2] or overflow)
        if now is not None and now[0] + self.debounce <= watermark:
            done.append(now)
            now = None
        if old and not later:
            self.waiting.clear()
        elif len(later) == len(ticks) and old:
            if fresh:
                self.waiting.appendList(fresh)
        elif later:
            self.waiting.put(later)
        if now is None and was is not None:
            self.open.clear()
        elif now != was:
            self.open.update((int(now[0]), int(now[1]), bool(now[2])))
        wake = now[0] if now is not None else later[0][0] if later else None
        return done, wake if wake is None else wake + self.debounce

    def _drain(self, key, watermark: int, fresh: list[tuple[int, int, bool]]) -> Iterator[pd.DataFrame]:
        done, wake = self._due(watermark, fresh)
        if wake is not None:
            self.handle.registerTimer(wake)
        if done:
            rows = [(key[0], t, t + self.debounce, n, overflow) for t, n, overflow in done]
            yield pd.DataFrame(rows, columns=["root", "opened_at", "due_at", "n_events", "had_overflow"])

    def close(self) -> None:
        pass


class ReconcileClock(Coalescer):
    """Due batches, and the sweeps of a root that goes ``interval`` without one."""

    def __init__(self, debounce_ms: int, interval_ms: int):
        super().__init__(debounce_ms)
        self.interval = interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "due_at long, swept long")

    def _drain(self, key, watermark: int, fresh: list[tuple[int, int, bool]]) -> Iterator[pd.DataFrame]:
        before = self.last.get()
        last, swept = tuple(before) if before is not None else (None, 0)
        before, rows = (last, swept), []

        def sweep(end: int) -> None:
            nonlocal swept
            while last is not None and last + (swept + 1) * self.interval < end:
                swept += 1
                rows.append((key[0], "sweep", last + swept * self.interval, last, 0, False))

        done, wake = self._due(watermark, fresh)
        for opened, n, overflow in done:
            # A sweep that would fall on the next reconcile itself is not needed.
            sweep(opened + self.debounce)
            last, swept = opened + self.debounce, 0
            rows.append((key[0], "due", last, opened, n, overflow))
        sweep(watermark + 1)
        if (last, swept) != before:
            self.last.update((int(last), int(swept)))
        # The earlier of the two is enough: the root is looked at again then, and asks for the other.
        next_sweep = [] if last is None else [last + (swept + 1) * self.interval]
        asked = next_sweep + ([] if wake is None else [wake])
        if asked:
            self.handle.registerTimer(min(asked))
        if rows:
            yield pd.DataFrame(rows, columns=["root", "cause", "at", "since", "n_events", "had_overflow"])


class RenamePairer(StatefulProcessor):
    """Waiting rename halves of a root's share of cookies; an overflow drops them, a timeout expires them."""

    def __init__(self, timeout_ms: int):
        self.timeout = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, seq long, cookie long, overflow boolean")
        self.halves = handle.getListState("halves", "cookie long, t long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = [
            (int(t), int(seq), int(cookie or 0), kind == "overflow") for pdf in rows
            for t, seq, cookie, kind in pdf[["t", "seq", "rename_cookie", "kind"]].itertuples(index=False)
        ]
        if fresh:
            self.waiting.appendList(fresh)
        watermark = timerValues.getCurrentWatermarkInMs()
        if fresh and min(fresh)[0] >= watermark:
            # None is due: a timer takes them, and those before them have theirs.
            self.handle.registerTimer(min(fresh)[0] + 1)
            yield pd.DataFrame([], columns=["root", "rename_cookie", "first_at", "paired_at"])
        else:
            yield self._drain(key, watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._drain(key, timerValues.getCurrentWatermarkInMs())

    def _drain(self, key, watermark: int) -> pd.DataFrame:
        rows = sorted(tuple(row) for row in self.waiting.get()) if self.waiting.exists() else []
        later = [row for row in rows if row[0] >= watermark]
        before = dict(tuple(row) for row in self.halves.get()) if self.halves.exists() else {}
        halves, pairs = dict(before), []
        for t, _, cookie, overflow in rows[: len(rows) - len(later)]:
            if overflow:
                halves.clear()
                continue
            waiting = halves.pop(cookie, None)
            if waiting is not None and t - waiting < self.timeout:
                pairs.append((key[0], cookie, waiting, t))
            else:
                halves[cookie] = t
        halves = {c: t for c, t in halves.items() if watermark - t < self.timeout}
        for state, now, old in ((self.waiting, later, rows), (self.halves, list(halves.items()), list(before.items()))):
            if now != old:
                state.put(now) if now else state.clear()
        wake = [later[0][0] + 1] if later else []
        wake += [min(halves.values()) + self.timeout] if halves else []
        if wake:
            self.handle.registerTimer(min(wake))
        return pd.DataFrame(pairs, columns=["root", "rename_cookie", "first_at", "paired_at"])

    def close(self) -> None:
        pass


def _timed(events: DataFrame, delay: str) -> DataFrame:
    t = wall_clock_ms(F.col("observed_at"))
    return events.withColumn("t", t).withColumn("event_time", F.timestamp_millis("t")).withWatermark(
        "event_time", delay
    )


def _only(events: DataFrame, wanted: Column) -> DataFrame:
    """A filter above the watermark: the rows it drops still move event time forward."""
    return events.where(F.when(F.col("event_time").isNotNull(), wanted).otherwise(False))


def _run_on(stream: DataFrame, target: str) -> int | None:
    """Run a stream over everything new below ``target``; its last event time in ms, if it saw one."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{target}/rows")
        .option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    seen = [p.eventTime["max"] for p in query.recentProgress if "max" in p.eventTime]
    return max((round(datetime.fromisoformat(at).timestamp() * 1000) for at in seen), default=None)


def run_available(stream: DataFrame, target: str) -> DataFrame:
    """Run a stream over everything there is into Parquet files below ``target`` and read them."""
    _run_on(stream, target)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{target}/rows")


def run_bounded(
    events: DataFrame, build: Callable[[DataFrame], DataFrame], target: str, delay_ms: int, hold_ms: int,
) -> DataFrame:
    """Run ``build(events)`` to the end of a bounded source: what is still open is handed out too.

    Beside the events the stream reads a folder of control rows. Once the source is at its end, a
    closing row moves event time ``hold`` beyond the last event, by the watermark's ``delay`` more, and
    the same query runs on from its checkpoint. A source without events is not closed.
    """
    spark, folder = events.sparkSession, f"{target}/closing"
    spark.createDataFrame([], events.schema).write.parquet(folder)
    stream = build(events.unionByName(spark.readStream.schema(events.schema).parquet(folder)))
    last = _run_on(stream, target)
    if last is not None:
        row = {"kind": F.lit(CLOSING), "observed_at": from_wall_clock_ms(F.lit(last + delay_ms + hold_ms + 1))}
        if "t" in events.columns:
            row["t"] = F.lit(last + delay_ms + hold_ms + 1)
        spark.range(1).select(*[
            row.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema
        ]).write.mode("append").parquet(folder)
        _run_on(stream, target)
    return spark.read.schema(stream.schema).parquet(f"{target}/rows")


def _keyed_state(events: DataFrame) -> None:
    """Map and timer state needs the RocksDB store.

    The processors travel by value: the worker that sets up their state does not see shipped files.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    events.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def coalesce_stream(
    events: DataFrame, debounce_ms: int = fv.DEBOUNCE_MS, delay: str = "10 seconds"
) -> DataFrame:
    """Stream of due batches.

    The first aggregation, on (root, millisecond), spreads a hot root over all tasks; the chain
    per root then sees at most one row per millisecond.
    """
    return _beats(events, delay).groupBy("root").transformWithStateInPandas(
        statefulProcessor=Coalescer(debounce_ms), outputStructType=BATCH, outputMode="append",
        timeMode="eventTime",
    )


def _beats(events: DataFrame, delay: str) -> DataFrame:
    """One row per root and millisecond: map-side combined, so a hot root is spread."""
    _keyed_state(events)
    told = _only(_timed(events, delay), ~F.col("kind").eqNullSafe(CLOSING))
    return (
        told.groupBy("root", F.window("event_time", "1 millisecond").alias("w"))
        .agg(F.count("*").alias("n"), F.max(F.col("kind") == "overflow").alias("overflow"))
        .select(
            "root", F.unix_millis("w.start").alias("t"), "n", "overflow",
            F.window_time("w").alias("event_time"),
        )
    )


def reconcile_stream(
    events: DataFrame, debounce_ms: int = fv.DEBOUNCE_MS, interval_ms: int = fv.SWEEP_INTERVAL_MS,
    delay: str = "10 seconds",
) -> DataFrame:
    """Stream of what makes a root be reconciled: ``(root, cause, at, since, n_events, had_overflow)``.

    ``cause`` is ``due`` for a batch, opened at ``since``, or ``sweep`` when the root has gone another
    ``interval`` since its last due batch at ``since``. The clock is event time: timers wake a root that
    has fallen silent, and its state is two values and the ticks of one watermark delay.
    """
    return _beats(events, delay).groupBy("root").transformWithStateInPandas(
        statefulProcessor=ReconcileClock(debounce_ms, interval_ms), outputStructType=TRIGGER,
        outputMode="append", timeMode="eventTime",
    )


def open_requests(spark: SparkSession, table: str) -> None:
    """An empty request table for ``enqueue_triggers``."""
    spark.createDataFrame([], schemas.WORK_REQUEST).write.mode("overwrite").parquet(f"{table}/batch=-1")


def read_requests(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.schema(f"{schemas.WORK_REQUEST}, batch bigint").parquet(table)


def enqueue_triggers(table: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink of ``reconcile_stream``: one pending request per root in the request table.

    A batch adds its own folder of rows, so running it again replaces them, and compares with the
    folders before it.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        queue = read_requests(spark, table).where(F.col("batch") < batch_id).drop("batch")
        due = batch.where("cause = 'due'").select(
            "root", F.col("since").alias("opened_at"), F.col("at").alias("due_at"), "had_overflow"
        )
        sweeps = batch.where("cause = 'sweep'").select("root", "at")
        incoming = rules.reconcile_triggers(due).unionByName(rules.sweep_triggers(sweeps))
        rows, _ = requests.enqueue_coalesced(queue, cut_lineage(incoming))
        rows.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return apply


def rename_stream(
    events: DataFrame, timeout_ms: int = fv.RENAME_TIMEOUT_MS, delay: str = "10 seconds"
) -> DataFrame:
    """Stream of rename pairs; ``seq`` breaks ties between events of one millisecond.

    State is kept by root and share of its cookies, so a hot root spreads over all tasks; an overflow
    concerns all cookies and goes to every share.
    """
    _keyed_state(events)
    half = F.col("kind").isin("renamedFrom", "renamedTo") & (F.col("rename_cookie") != 0)
    overflow = F.col("kind") == "overflow"
    share = F.pmod(F.hash("rename_cookie"), F.lit(_SHARES))
    everywhere = F.array(*[F.lit(n) for n in range(_SHARES)])
    halves = _only(_timed(events, delay), half | overflow).withColumn(
        "share", F.explode(F.when(overflow, everywhere).otherwise(F.array(share)))
    )
    return halves.groupBy("root", "share").transformWithStateInPandas(
        statefulProcessor=RenamePairer(timeout_ms), outputStructType=PAIR, outputMode="append",
        timeMode="eventTime",
    )


def rename_join_stream(
    events: DataFrame, timeout_ms: int = fv.RENAME_TIMEOUT_MS, delay: str = "10 seconds"
) -> DataFrame:
    """Pairs by an interval join on (root, cookie), either half first.

    Cheaper than the stateful form and spread by cookie, for sources that never reuse a cookie
    and report no overflow.
    """
    timed = _timed(events, delay)
    half = lambda kind: (F.col("kind") == kind) & (F.col("rename_cookie") != 0)
    side = lambda kind, mark: _only(timed, half(kind)).select(
        F.col("root").alias(f"{mark}_root"), F.col("rename_cookie").alias(f"{mark}_cookie"),
        F.col("path").alias(f"{mark}_path"), F.col("t").alias(f"{mark}_t"),
        F.col("event_time").alias(f"{mark}_time"),
    )
    wait = F.expr(f"INTERVAL {timeout_ms / 1000} SECONDS")
    near = F.col("to_time").between(F.col("from_time") - wait, F.col("from_time") + wait)
    in_time = F.abs(F.col("to_t") - F.col("from_t")) < timeout_ms
    return side("renamedFrom", "from").join(
        side("renamedTo", "to"),
        (F.col("from_root") == F.col("to_root")) & (F.col("from_cookie") == F.col("to_cookie"))
        & near & in_time,
    ).select(
        F.col("from_root").alias("root"), F.col("from_cookie").alias("rename_cookie"),
        "from_path", "to_path", F.least("from_t", "to_t").alias("first_at"),
        F.greatest("from_t", "to_t").alias("paired_at"),
    )


def progressive_apply(root: str, order: str | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: each committed scan batch is visible at once.

    A batch is written as one small delta over the table. The state token stays as it was, so the
    table counts as provisional until a full rebuild vouches for it. Re-running a batch changes
    nothing.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        rows = last_per_id(batch, order) if order else batch
        try:
            commit(batch.sparkSession, root, rows, rows.limit(0).select("id"), token=None)
        except Conflict:
            pass  # an empty batch

    return apply
