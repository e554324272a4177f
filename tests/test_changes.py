"""Debounce, rename and sweep rules: scenarios in virtual time, brute force, streams."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mediaquarry.functions.capture import from_wall_clock_ms
from mediaquarry.sources.events import batch_change_events, read_change_events, with_observed_ms
from mediaquarry.streaming import coalesce as rules, live

T0 = 1_700_000_000_000


def table(spark, rows):
    """``(root, kind, cookie, ms after t0)`` → events."""
    data = [(r, k, f"{r}/{i}", c, T0 + t, i) for i, (r, k, c, t) in enumerate(rows)]
    schema = "root string, kind string, path string, rename_cookie bigint, t bigint, seq bigint"
    return spark.createDataFrame(data, schema)


def batches(spark, rows, debounce):
    found = rules.coalesce_changes(table(spark, rows), debounce).collect()
    return sorted((r.root, r.opened_at - T0, r.due_at - T0, r.n_events, r.had_overflow) for r in found)


def chain(rows, debounce):
    """The rule as a loop."""
    out, open_batch = [], {}
    for root, kind, _, t in sorted(rows, key=lambda r: r[3]):
        now = open_batch.get(root)
        if now is None or t >= now[0] + debounce:
            now = open_batch[root] = [t, 0, False]
            out.append((root, now))
        now[1] += 1
        now[2] |= kind == "overflow"
    return sorted((root, b[0], b[0] + debounce, b[1], b[2]) for root, b in out)


def test_scenarios(spark):
    one = [("a", "created", 0, 0)]
    burst = [("b", "created", 0, i) for i in range(50)]
    apart = [("c", "created", 0, 0), ("c", "created", 0, 10_000)]
    edge = [("d", "created", 0, 0), ("d", "created", 0, 499), ("d", "overflow", 0, 500)]
    assert batches(spark, one + burst + apart + edge, 500) == [
        ("a", 0, 500, 1, False), ("b", 0, 500, 50, False), ("c", 0, 500, 1, False),
        ("c", 10_000, 10_500, 1, False), ("d", 0, 500, 2, False), ("d", 500, 1000, 1, True),
    ]


@pytest.mark.parametrize("seed,span,debounce", [
    (1, 2_000, 5), (2, 400_000, 7), (3, 40_000_000, 500), (4, 3_000_000, 3), (5, 900, 200),
])
def test_chain_equals_the_loop_over_many_blocks(spark, seed, span, debounce):
    rng = random.Random(seed)
    rows = []
    for root in "abcde":
        at = rng.randrange(1000)
        while at < span and len(rows) < 9000:
            rows.append((root, rng.choice(["created", "modified", "overflow"]), 0, at))
            # dense stretches, then a silence that may skip whole blocks
            at += rng.choice([0, 1, 1, 2, debounce - 1, debounce]) if rng.random() < 0.98 else rng.randrange(span // 2)
    assert batches(spark, rows, debounce) == chain(rows, debounce)


def test_one_hot_root(spark):
    rows = [("hot", "modified", 0, t // 3) for t in range(30_000)] + [("cold", "created", 0, 5)]
    assert batches(spark, rows, 4) == chain(rows, 4)


def test_no_events(spark):
    assert rules.coalesce_changes(table(spark, []), 500).count() == 0


def pairs(spark, rows, timeout):
    found = rules.pair_renames(table(spark, rows), timeout).collect()
    return sorted((r.root, r.rename_cookie, r.pairs) for r in found)


def test_rename_scenarios(spark):
    rows = [
        ("a", "renamedFrom", 7, 0), ("a", "renamedTo", 7, 10),
        ("b", "renamedTo", 42, 0), ("b", "renamedFrom", 42, 5),
        ("c", "renamedFrom", 9, 0),
        ("d", "renamedFrom", 3, 0), ("d", "overflow", 0, 10), ("d", "renamedTo", 3, 20),
        ("e", "renamedFrom", 5, 0), ("e", "renamedTo", 5, 1000),
        ("f", "renamedFrom", 0, 0), ("f", "renamedTo", 0, 1),
        ("g", "renamedFrom", 8, 0), ("g", "renamedFrom", 8, 1),
    ]
    assert pairs(spark, rows, 1000) == [("a", 7, 1), ("b", 42, 1), ("g", 8, 1)]
    halves = rules.expired_halves(table(spark, rows), T0 + 1300, 1000)
    # The second half of e came too late to pair; the first half of d was dropped by the overflow.
    waiting = {(r.root, r.rename_cookie, r.waiting_since - T0) for r in halves.collect()}
    assert waiting == {("c", 9, 0), ("d", 3, 20), ("e", 5, 0)}


def pair_loop(rows, timeout):
    waiting, count = {}, {}
    for root, kind, cookie, t in rows:
        if kind == "overflow":
            waiting = {k: v for k, v in waiting.items() if k[0] != root}
        elif kind.startswith("renamed") and cookie:
            first = waiting.pop((root, cookie), None)
            if first is not None and t - first < timeout:
                count[root, cookie] = count.get((root, cookie), 0) + 1
            else:
                waiting[root, cookie] = t
    return sorted((root, cookie, n) for (root, cookie), n in count.items())


def random_renames(seed, n=3000):
    rng = random.Random(seed)
    kinds = ["renamedFrom", "renamedTo", "overflow", "created"]
    rows = [
        (rng.choice("ab") if rng.random() < 0.3 else "hot", rng.choices(kinds, [5, 5, 1, 2])[0], rng.randrange(4), t * 3)
        for t in range(n)
    ]
    return rows


def test_rename_pairs_equal_the_loop(spark):
    rows = random_renames(11)
    assert pairs(spark, rows, 20) == pair_loop(rows, 20)


def test_sweeps(spark):
    roots = spark.createDataFrame(
        [("never", None), ("new", 1_000_000 - 60_000), ("old", 1_000_000 - 900_000)],
        "root string, last_reconcile_ms bigint",
    )
    due = {r.root: r.due for r in rules.sweep_due(roots, 1_000_000).collect()}
    assert due == {"never": True, "new": False, "old": True}
    gaps = spark.createDataFrame([("a", 0), ("a", 900_000), ("a", 2_700_001)], "root string, due_at bigint")
    assert [(r.after_ms, r.sweeps) for r in rules.periodic_sweeps(gaps).collect()] == [(900_000, 2)]


# --- streams ----------------------------------------------------------------------------------


def write_events(spark, rows, folder, parts=3):
    """Unordered within a file, files in time order: what a watermark allows."""
    flush = [("zz", "created", 0, max(r[3] for r in rows) + 100_000_000)]
    ordered = sorted(rows, key=lambda r: r[3])
    size = len(ordered) // parts + 1
    for number in range(0, len(ordered), size):
        piece = ordered[number:number + size]
        random.Random(number).shuffle(piece)
        save(spark, piece, folder)
    save(spark, flush, folder)
    save(spark, [("zz", "created", 0, flush[0][3] + 100_000_000)], folder)


def save(spark, rows, folder):
    table(spark, rows).select(
        "root", "kind", "path", "rename_cookie", from_wall_clock_ms(F.col("t")).alias("observed_at")
    ).coalesce(1).write.mode("append").parquet(folder)


def run_stream(spark, stream, checkpoint, name):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.table(name)


def test_coalesce_stream_equals_the_batch_twin(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.choice(["created", "overflow"]), 0, rng.randrange(60_000)) for _ in range(400)]
    folder = str(tmp_path / "events")
    write_events(spark, rows, folder)
    stream = live.coalesce_stream(read_change_events(spark, folder, files_per_trigger=1), 500, "60 seconds")
    found = run_stream(spark, stream, str(tmp_path / "cp"), "due_batches").where("root <> 'zz'")
    twin = rules.coalesce_changes(with_observed_ms(batch_change_events(spark, folder)).where("root <> 'zz'"), 500)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, twin.collect()))


def test_rename_stream_equals_the_loop(spark, tmp_path):
    rows = [r for r in random_renames(5, 500)]
    folder = str(tmp_path / "events")
    write_events(spark, rows, folder)
    events = read_change_events(spark, folder, files_per_trigger=1)
    seq = F.substring_index("path", "/", -1).cast("bigint")
    stream = live.rename_stream(events.withColumn("seq", seq), 20, "60 seconds")
    found = run_stream(spark, stream, str(tmp_path / "cp"), "rename_pairs")
    counted = found.groupBy("root", "rename_cookie").count().collect()
    assert sorted(map(tuple, counted)) == pair_loop(rows, 20)


def save_plain(spark, rows, folder, parts=4):
    """Events in time order over some files, and nothing after the last one."""
    ordered = sorted(rows, key=lambda r: r[3])
    size = len(ordered) // parts + 1
    for number in range(0, len(ordered), size):
        save(spark, ordered[number:number + size], folder)


def test_bounded_stream_hands_out_the_last_batch(spark, tmp_path):
    """One event and no other: its batch is due although nothing moves time on."""
    folder, target = str(tmp_path / "events"), str(tmp_path / "out")
    save(spark, [("a", "created", 0, 5_000)], folder)
    events = read_change_events(spark, folder)
    found = live.run_bounded(events, lambda e: live.coalesce_stream(e, 500, "60 seconds"), target, 60_000, 500)
    assert [tuple(r) for r in found.collect()] == [("a", T0 + 5_000, T0 + 5_500, 1, False)]


def test_bounded_stream_without_events(spark, tmp_path):
    folder, target = str(tmp_path / "events"), str(tmp_path / "out")
    table(spark, []).select(
        "root", "kind", "path", "rename_cookie", from_wall_clock_ms(F.col("t")).alias("observed_at")
    ).write.parquet(folder)
    events = read_change_events(spark, folder)
    assert live.run_bounded(events, lambda e: live.coalesce_stream(e, 500, "60 seconds"), target, 60_000, 500).count() == 0


def test_bounded_streams_equal_the_batch_twins(spark, tmp_path):
    rng = random.Random(11)
    # Two thirds of all events on one root, one overflow in a hundred.
    rows = [
        (rng.choice("aab"), rng.choices(["renamedFrom", "renamedTo", "overflow"], [50, 50, 1])[0], rng.randrange(1, 60), t)
        for t in sorted(rng.sample(range(40_000), 900))
    ]
    folder = str(tmp_path / "events")
    save_plain(spark, rows, folder)
    events = read_change_events(spark, folder, files_per_trigger=1)
    batch = with_observed_ms(batch_change_events(spark, folder)).withColumn("seq", F.lit(0))
    due = live.run_bounded(events, lambda e: live.coalesce_stream(e, 500, "2 seconds"), str(tmp_path / "due"), 2_000, 500)
    assert sorted(map(tuple, due.collect())) == sorted(map(tuple, rules.coalesce_changes(batch, 500).collect()))
    pairs = live.run_bounded(
        events, lambda e: live.rename_stream(e.withColumn("seq", F.lit(0)), 900, "2 seconds"), str(tmp_path / "pairs"), 2_000, 0
    )
    wanted = rules.pair_renames(batch, 900).collect()
    assert wanted and sorted(map(tuple, pairs.groupBy("root", "rename_cookie").count().collect())) == sorted(map(tuple, wanted))


def test_reconcile_stream_follows_the_clock(spark, tmp_path):
    """Sweeps come while a root is silent, none at the moment of the next batch, and stop at the closing time."""
    folder = str(tmp_path / "events")
    rows = [("a", "created", 0, 1_000), ("a", "created", 0, 4_500), ("b", "overflow", 0, 6_000)]
    for row in rows:
        save(spark, [row], folder)
    events = read_change_events(spark, folder, files_per_trigger=1)
    found = live.run_bounded(
        events, lambda e: live.reconcile_stream(e, 500, 1_000, "1 second"), str(tmp_path / "out"), 1_000, 2_000
    )
    assert sorted((r.root, r.cause, r.at - T0, r.since - T0) for r in found.collect()) == [
        ("a", "due", 1_500, 1_000), ("a", "due", 5_000, 4_500), ("a", "sweep", 2_500, 1_500), ("a", "sweep", 3_500, 1_500),
        ("a", "sweep", 4_500, 1_500), ("a", "sweep", 6_000, 5_000), ("a", "sweep", 7_000, 5_000), ("a", "sweep", 8_000, 5_000),
        ("b", "due", 6_500, 6_000), ("b", "sweep", 7_500, 6_500),
    ]
    twin = rules.periodic_sweeps(found.where("cause = 'due'").select("root", F.col("at").alias("due_at")), 1_000)
    assert [tuple(r) for r in twin.collect()] == [("a", T0 + 1_500, 3)]


def test_triggers_of_a_batch_run_twice(spark, tmp_path):
    """A second run of a batch changes nothing; a root with a pending request gets no other."""
    out = str(tmp_path / "requests")
    live.open_requests(spark, out)
    first = spark.createDataFrame([("a", "due", 500, 0, 1, True), ("a", "sweep", 900, 500, 0, False)], live.TRIGGER)
    later = spark.createDataFrame([("a", "due", 2_500, 2_000, 1, False), ("b", "sweep", 3_000, 100, 0, False)], live.TRIGGER)
    for number, batch in ((0, first), (0, first), (1, later), (1, later)):
        live.enqueue_triggers(out)(batch, number)
    rows = live.read_requests(spark, out).collect()
    assert sorted((r.coalescing_key, r.created_at_ms, r.batch) for r in rows) == [
        ("watch-reconcile:a", 500, 0), ("watch-reconcile:b", 3_000, 1)
    ]
    assert [r.payload for r in rows if r.batch] == ['{"root":"b","triggeredByOverflow":false,"triggeredByPeriodicFallback":true}']


def test_rename_join_stream(spark, tmp_path):
    rows = [
        ("a", "renamedFrom", 7, 0), ("a", "renamedTo", 7, 10), ("b", "renamedTo", 42, 0),
        ("b", "renamedFrom", 42, 5), ("c", "renamedFrom", 9, 0), ("c", "renamedTo", 9, 5000),
    ]
    folder = str(tmp_path / "events")
    write_events(spark, rows, folder, parts=1)
    stream = live.rename_join_stream(read_change_events(spark, folder), 1000)
    found = run_stream(spark, stream, str(tmp_path / "cp"), "joined_pairs").collect()
    assert sorted((r.root, r.rename_cookie, r.paired_at - r.first_at) for r in found) == [("a", 7, 10), ("b", 42, 5)]


def test_rename_rows_that_are_not_due_are_not_read_back():
    calls = []

    class State:
        def __init__(self, name):
            self.name, self.rows = name, []

        def __getattr__(self, call):
            def made(*args):
                calls.append((self.name, call))
                if call in ("appendList", "put"):
                    self.rows = [*(self.rows if call == "appendList" else []), *args[0]]
                elif call == "clear":
                    self.rows = []
                return bool(self.rows) if call == "exists" else iter(list(self.rows))
            return made

    class Handle:
        def getListState(self, name, schema):
            return State(name)

        def registerTimer(self, at):
            calls.append(("timer", at))

    class Clock:
        at = 0

        def getCurrentWatermarkInMs(self):
            return self.at

    pairer, clock = live.RenamePairer(20), Clock()
    pairer.init(Handle())
    half = lambda t: pd.DataFrame({"t": [t], "seq": [t], "rename_cookie": [7], "kind": ["renamedFrom"]})
    for t in (110, 100):
        assert sum(map(len, pairer.handleInputRows(("r", 0), iter([half(t)]), clock))) == 0
    assert calls == [("waiting", "appendList"), ("timer", 111), ("waiting", "appendList"), ("timer", 101)]
    clock.at = 200
    assert [tuple(r) for f in pairer.handleExpiredTimer(("r", 0), clock, None) for r in f.itertuples(index=False)] == [("r", 7, 100, 110)]


class _CountedState:
    """A state variable that counts its calls; every call is a round trip in a stream."""

    def __init__(self):
        self.value, self.calls = None, []

    def __getattr__(self, name):
        def call(*given):
            self.calls.append(name)
            if name == "get":
                return iter(self.value or []) if isinstance(self.value, list) else self.value
            if name == "exists":
                return bool(self.value)
            if name == "appendList":
                self.value = [*(self.value or []), *given[0]]
            elif name in ("put", "update", "clear"):
                self.value = given[0] if given else None
            return None

        return call


def test_ticks_that_are_due_at_once_are_not_stored():
    """Two late ticks make two batches and a sweep without a write of ticks or of the open batch."""
    clock = live.ReconcileClock(10, 100)
    clock.handle = _CountedState()
    clock.waiting, clock.open, clock.last = _CountedState(), _CountedState(), _CountedState()
    rows = [pd.DataFrame({"t": [0, 150], "n": [2, 1], "overflow": [False, True]})]
    watermark = type("Timer", (), {"getCurrentWatermarkInMs": lambda self: 200})()
    found = pd.concat(clock.handleInputRows(("r",), rows, watermark))
    assert found.values.tolist() == [
        ["r", "due", 10, 0, 2, False], ["r", "sweep", 110, 10, 0, False], ["r", "due", 160, 150, 1, True],
    ]
    assert clock.waiting.calls == ["exists"] and clock.open.calls == ["get"]
    assert clock.last.value == (160, 0) and clock.handle.calls == ["registerTimer"]
    late = [pd.DataFrame({"t": [500], "n": [1], "overflow": [False]})]
    assert not len([r for f in clock.handleInputRows(("r",), late, watermark) for r in f.values])
    assert clock.waiting.value == [(500, 1, False)]
