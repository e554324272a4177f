"""Batch twins of the change-event rules: debounce batches, rename pairs, sweeps, triggers.

A debounce batch is anchored at its first event: it holds every event before ``first + debounce``
and the next event opens another one. That is a chain, so a root with a third of all events must
not become one task. The chain is therefore evaluated as a parallel scan:

* events are pre-aggregated to one tick per root and millisecond, combined map-side;
* each (root, time block) reduces its ticks to a step function "entered no earlier than h, the
  last batch opened here is due at x" — at most one step per millisecond of one debounce span;
* step functions are composed block by block up to the whole time range, then entry times are
  handed back down, and every block cuts its own ticks.

Group sizes are bounded by time (block length over one millisecond), never by event counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv
from ..operators.ordering import ordered_segments, running_total, with_previous
from ..session import cut_lineage, ship_package

_SPAN = 64  # debounce spans per block
_FAN = 256  # blocks per block of the next level
_NEVER = -(1 << 62)  # "nothing open yet": any event opens a batch
_STEPS = "root string, block bigint, upto bigint, due bigint"


def ticks(events: DataFrame) -> DataFrame:
    """``(root, kind, t)`` → one row per root and millisecond."""
    return events.groupBy("root", "t").agg(
        F.count("*").alias("n"), F.max(F.col("kind") == "overflow").alias("overflow")
    )


def _whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Re-cut sorted Arrow batches so that every frame holds complete groups."""
    carry = None
    for batch in batches:
        if batch.empty:
            continue
        rows = batch if carry is None else pd.concat([carry, batch], ignore_index=True)
        same = np.ones(len(rows), dtype=bool)
        for key in keys:
            same &= (rows[key] == rows[key].iloc[-1]).to_numpy()
        cut = int(np.argmax(same))
        if cut:
            yield rows.iloc[:cut].reset_index(drop=True)
        carry = rows.iloc[cut:].reset_index(drop=True)
    if carry is not None:
        yield carry


def _number(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """0-based group number of each row; rows are sorted by ``keys``."""
    fresh = np.zeros(len(rows), dtype=bool)
    for key in keys:
        column = rows[key].to_numpy()
        fresh[1:] |= column[1:] != column[:-1]
    return np.cumsum(fresh)


def _starts(number: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, number[1:] != number[:-1]))


def _followers(number: np.ndarray, offset: np.ndarray, debounce: int, length: int) -> np.ndarray:
    """Per tick: the first tick of its block at least ``debounce`` later, or -1."""
    line = number * (length + debounce + 1) + offset
    at = np.searchsorted(line, line + debounce, side="left")
    inside = (at < len(line)) & (number[np.minimum(at, len(line) - 1)] == number)
    return np.where(inside, at, -1)


def _merge_steps(group: np.ndarray, due: np.ndarray) -> np.ndarray:
    """Neighbouring entries of a group with the same exit are one step: keep its last."""
    return np.append((due[1:] != due[:-1]) | (group[1:] != group[:-1]), True)


def _block_steps(debounce: int, length: int):
    """Ticks sorted by (root, block, t) → each block's step function."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_groups(batches, ["root", "block"]):
            number, t = _number(rows, ["root", "block"]), rows["t"].to_numpy()
            offset = t - rows["block"].to_numpy() * length
            following = _followers(number, offset, debounce, length)
            last = np.arange(len(t))
            while True:
                step = following[last]
                if (step < 0).all():
                    break
                last = np.where(step >= 0, step, last)
            # A batch opened before the block is due within one debounce of its start, so only
            # these ticks and the first one behind them can be entered.
            early = offset < debounce - 1
            head = np.append(True, number[1:] != number[:-1])
            enterable = early | head
            enterable[1:] |= early[:-1] & ~head[1:]
            due = (t[last] + debounce)[enterable]
            keep = _merge_steps(number[enterable], due)
            out = rows.loc[enterable, ["root", "block", "t"]][keep]
            yield out.rename(columns={"t": "upto"}).assign(due=due[keep])

    return run


class _Children:
    """Step functions of sorted (root, parent, block, upto) rows, applied block by block."""

    def __init__(self, rows: pd.DataFrame, length: int):
        self.parent = _number(rows, ["root", "parent"])
        self.child = _number(rows, ["root", "parent", "block"])
        self.first = _starts(self.child)
        self.end = np.append(self.first[1:], len(rows))
        self.block = rows["block"].to_numpy()[self.first]
        self.of_parent = self.parent[self.first]
        heads = _starts(self.of_parent)
        self.rank = np.arange(len(self.first)) - np.repeat(heads, np.diff(np.append(heads, len(self.first))))
        self.upto, self.due = rows["upto"].to_numpy(), rows["due"].to_numpy()
        self.width = length + 1
        self.start = self.block * length
        self.line = self.child * self.width + (self.upto - self.start[self.child])

    def at_rank(self, rank: int) -> np.ndarray:
        """Per parent: its child of this rank, or -1."""
        found = np.full(int(self.parent[-1]) + 1, -1)
        chosen = np.flatnonzero(self.rank == rank)
        found[self.of_parent[chosen]] = chosen
        return found

    def through(self, child: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Exits of entry times ``h``; an entry behind the last step passes through."""
        offset = np.clip(h - self.start[child], 0, self.width - 1)
        at = np.searchsorted(self.line, child * self.width + offset, side="left")
        return np.where(at < self.end[child], self.due[np.minimum(at, len(self.due) - 1)], h)


def _compose(length: int):
    """Steps of blocks sorted by (root, parent, block, upto) → steps of their parents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_groups(batches, ["root", "parent"]):
            c = _Children(rows, length)
            rank = c.rank[c.child]
            # Entries come within a debounce of the parent's start: into its first block or, when
            # nothing is left there, at the first step of the second.
            enterable = rank == 0
            second = c.first[c.rank == 1]
            enterable[second] = True
            parent, h = c.parent[enterable], c.upto[enterable].copy()
            for number in range(int(c.rank.max()) + 1):
                child = c.at_rank(number)[parent]
                known = child >= 0
                h[known] = c.through(child[known], h[known])
            keep = _merge_steps(parent, h)
            out = rows.loc[enterable, ["root", "parent", "upto"]][keep]
            yield out.rename(columns={"parent": "block"}).assign(due=h[keep])

    return run


def _hand_down(length: int):
    """Steps with the parent's entry time ``h`` → the entry time of every block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_groups(batches, ["root", "parent"]):
            c = _Children(rows, length)
            now = rows["h"].to_numpy()[_starts(c.parent)].copy()
            entry = np.empty(len(c.first), dtype=np.int64)
            for number in range(int(c.rank.max()) + 1):
                child = c.at_rank(number)
                parent = np.flatnonzero(child >= 0)
                entry[child[parent]] = now[parent]
                now[parent] = c.through(child[parent], now[parent])
            out = rows.iloc[c.first][["root", "block"]]
            yield out.assign(h=entry)

    return run


def _cut(debounce: int, length: int):
    """Ticks with their block's entry time ``h`` → partial batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_groups(batches, ["root", "block"]):
            number, t = _number(rows, ["root", "block"]), rows["t"].to_numpy()
            start = rows["block"].to_numpy() * length
            following = _followers(number, t - start, debounce, length)
            first = _starts(number)
            end = np.append(first[1:], len(t))
            h = rows["h"].to_numpy()
            width = length + debounce + 1
            entry = number[first] * width + np.clip(h[first] - start[first], 0, width - 1)
            at = np.searchsorted(number * width + (t - start), entry, side="left")
            opener = np.zeros(len(t), dtype=bool)
            at = at[at < end]
            while len(at):
                opener[at] = True
                at = following[at]
                at = at[at >= 0]
            seen = np.maximum.accumulate(np.where(opener, np.arange(len(t)), -1))
            inside = (seen >= 0) & (number[np.maximum(seen, 0)] == number)
            opened = np.where(inside, t[np.maximum(seen, 0)], h - debounce)
            edge = _starts(number * 2 * len(t) + np.where(inside, seen + 1, 0))
            yield pd.DataFrame({
                "root": rows["root"].to_numpy()[edge], "opened_at": opened[edge],
                "n": np.add.reduceat(rows["n"].to_numpy(), edge),
                "overflow": np.logical_or.reduceat(rows["overflow"].to_numpy(), edge),
            })

    return run


def _grouped(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Whole groups side by side in sorted partitions; many small ones share a task."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *([order] if order not in keys else []))


def coalesce_changes(events: DataFrame, debounce_ms: int = fv.DEBOUNCE_MS) -> DataFrame:
    """``(root, kind, t)`` → ``(root, opened_at, due_at, n_events, had_overflow)``."""
    ship_package(events.sparkSession)
    length = _SPAN * debounce_ms
    beats = cut_lineage(_grouped(
        ticks(events).withColumn("block", F.floor(F.col("t") / length)), ["root", "block"], "t"
    ))
    low, high = beats.agg(F.min("block"), F.max("block")).first()
    levels = [cut_lineage(beats.mapInPandas(_block_steps(debounce_ms, length), _STEPS))]
    reach, lengths = (high or 0) - (low or 0) + 1, [length]
    while reach > _FAN:
        parents = levels[-1].withColumn("parent", F.floor(F.col("block") / _FAN))
        ranked = parents.repartition("root", "parent").sortWithinPartitions("root", "parent", "block", "upto")
        levels.append(cut_lineage(ranked.mapInPandas(_compose(lengths[-1]), _STEPS)))
        lengths.append(lengths[-1] * _FAN)
        reach = ceil(reach / _FAN) + 1
    entries = levels[-1].select("root").distinct().select(
        "root", F.lit(0).cast("bigint").alias("parent"), F.lit(_NEVER).cast("bigint").alias("h")
    )
    for number in range(len(levels) - 1, -1, -1):
        top = number == len(levels) - 1
        parent = F.lit(0).cast("bigint") if top else F.floor(F.col("block") / _FAN)
        steps = levels[number].withColumn("parent", parent).join(entries, ["root", "parent"])
        ranked = steps.repartition("root", "parent").sortWithinPartitions("root", "parent", "block", "upto")
        entries = ranked.mapInPandas(_hand_down(lengths[number]), "root string, block bigint, h bigint")
        if number:
            entries = entries.withColumnRenamed("block", "parent")
    timed = _grouped(beats.join(entries, ["root", "block"]), ["root", "block"], "t")
    pieces = timed.mapInPandas(
        _cut(debounce_ms, length), "root string, opened_at bigint, n bigint, overflow boolean"
    )
    return pieces.groupBy("root", "opened_at").agg(
        F.sum("n").alias("n_events"), F.max("overflow").alias("had_overflow")
    ).select(
        "root", "opened_at", (F.col("opened_at") + debounce_ms).alias("due_at"),
        "n_events", "had_overflow",
    )


def overflow_epochs(events: DataFrame) -> DataFrame:
    """Adds ``epoch``: overflows seen so far. Rename halves never pair across an epoch."""
    flagged = events.withColumn("_o", (F.col("kind") == "overflow").cast("bigint"))
    order = [F.col("root"), F.col("t"), F.col("seq")]
    return running_total(flagged, order, "_o", "epoch").drop("_o")


def rename_runs(events: DataFrame, timeout_ms: int = fv.RENAME_TIMEOUT_MS) -> DataFrame:
    """Rename halves of one (root, cookie, epoch) with no gap of ``timeout`` as one run.

    Halves toggle in arrival order — a waiting half and the next one make a pair, whichever kinds
    they are — so a run of n halves makes n // 2 pairs and an odd last half waits on.
    """
    return _runs(overflow_epochs(_rename_events(events)), timeout_ms)


def _rename_events(events: DataFrame) -> DataFrame:
    """The events that matter to pairing, narrowed before anything is sorted."""
    half = F.col("kind").isin("renamedFrom", "renamedTo") & (F.col("rename_cookie") != 0)
    return events.where(half | (F.col("kind") == "overflow")).select(
        "root", "kind", "rename_cookie", "t", "seq"
    )


def _runs(events: DataFrame, timeout_ms: int) -> DataFrame:
    halves = events.where("kind <> 'overflow'").drop("kind")
    keys = ["root", "rename_cookie", "epoch"]

    def starts(previous, current):
        same = (
            (previous["root"] == current["root"]) & (previous["epoch"] == current["epoch"])
            & (previous["rename_cookie"] == current["rename_cookie"])
        )
        return ~same | (current["t"] - previous["t"] >= timeout_ms)

    order = [F.col(c) for c in (*keys, "t", "seq")]
    runs = ordered_segments(halves, order, [*keys, "t"], starts, "run")
    return runs.groupBy(*keys, "run").agg(
        F.min("t").alias("first_at"), F.max("t").alias("last_at"), F.count("*").alias("halves")
    ).withColumn("pairs", F.floor(F.col("halves") / 2))


def pair_renames(events: DataFrame, timeout_ms: int = fv.RENAME_TIMEOUT_MS) -> DataFrame:
    """``(root, rename_cookie, pairs)``."""
    return rename_runs(events, timeout_ms).groupBy("root", "rename_cookie").agg(
        F.sum("pairs").alias("pairs")
    ).where("pairs > 0")


def expired_halves(events: DataFrame, now_ms: int, timeout_ms: int = fv.RENAME_TIMEOUT_MS) -> DataFrame:
    """Unpaired halves that have waited ``timeout`` by ``now``; one that an overflow dropped before
    that did not expire."""
    staged = overflow_epochs(_rename_events(events))
    ends = staged.where("kind = 'overflow'").select(
        "root", (F.col("epoch") - 1).alias("epoch"), F.col("t").alias("dropped_at")
    )
    expires = F.col("last_at") + timeout_ms
    return _runs(staged, timeout_ms).where(
        (F.col("halves") % 2 == 1) & (expires <= now_ms)
    ).join(ends, ["root", "epoch"], "left").where(
        F.col("dropped_at").isNull() | (F.col("dropped_at") >= expires)
    ).select("root", "rename_cookie", F.col("last_at").alias("waiting_since"))


def coalesce_stats(batches: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per root: batches, events, overflowed batches and rename pairs."""
    per_root = batches.groupBy("root").agg(
        F.count("*").alias("batches"), F.sum("n_events").alias("events"),
        F.count_if("had_overflow").alias("overflowed"),
    )
    paired = pairs.groupBy("root").agg(F.sum("pairs").alias("pairs"))
    return per_root.join(paired, "root", "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)))


def _requests(rows: DataFrame, since: str, at: str, overflow: Column, periodic: bool) -> DataFrame:
    """Background work requests of roots; ``since`` and the root make the id."""
    payload = F.to_json(F.struct(
        F.col("root"), overflow.alias("triggeredByOverflow"),
        F.lit(periodic).alias("triggeredByPeriodicFallback"),
    ))
    mark = [F.lit("sweep")] if periodic else []
    return rows.select(
        F.sha2(F.concat_ws("|", *mark, F.col("root"), F.col(since).cast("string")), 256).alias("id"),
        F.lit("reconcileRoot").alias("kind"), F.lit(2).alias("priority"),
        F.lit("pending").alias("state"),
        F.concat(F.lit("watch-reconcile:"), F.col("root")).alias("coalescing_key"),
        payload.alias("payload"), F.lit(0).alias("attempts"),
        F.lit(fv.DEFAULT_MAX_ATTEMPTS).alias("max_attempts"),
        F.col(at).alias("created_at_ms"), F.lit(None).cast("bigint").alias("not_before_ms"),
        F.lit("none").alias("last_error_code"), F.col(at).alias("seq"),
    )


def reconcile_triggers(batches: DataFrame) -> DataFrame:
    """One background work request per due batch; pending ones of a root coalesce by key."""
    return _requests(batches, "opened_at", "due_at", F.col("had_overflow"), False)


def sweep_triggers(sweeps: DataFrame) -> DataFrame:
    """``(root, at)`` → one background work request per periodic sweep, under the same key."""
    return _requests(sweeps, "at", "at", F.lit(False), True)


def sweep_due(roots: DataFrame, now_ms: int, interval_ms: int = fv.SWEEP_INTERVAL_MS) -> DataFrame:
    """``(root, last_reconcile_ms)`` → roots whose periodic sweep is due."""
    waited = F.col("last_reconcile_ms").isNull() | (F.lit(now_ms) - F.col("last_reconcile_ms") >= interval_ms)
    return roots.withColumn("due", waited)


def periodic_sweeps(batches: DataFrame, interval_ms: int = fv.SWEEP_INTERVAL_MS) -> DataFrame:
    """Sweeps that fall between successive reconciles of a root: ``(root, after_ms, sweeps)``."""
    rows = with_previous(
        batches.select("root", "due_at"), [F.col("root"), F.col("due_at")], ["root", "due_at"]
    ).where(F.col("previous.root") == F.col("root"))
    gap = F.col("due_at") - F.col("previous.due_at")
    # A sweep that would fall on the next reconcile itself is not needed.
    return rows.select(
        "root", F.col("previous.due_at").alias("after_ms"),
        F.floor((gap - 1) / interval_ms).alias("sweeps"),
    ).where("sweeps > 0")
