"""Near-duplicate vectors by Euclidean p-stable hashing with exact cosine checks.

Each table hashes a normalised vector by ``m`` Gaussian projections, shifted and quantised to width
``WIDTH``. The number of projections follows the number of vectors so that buckets of unrelated
vectors stay small, and the number of tables follows from the recall wanted at the threshold.
Vectors of one bucket are compared exactly, in blocks; a pair that meets in several tables counts
in the first of them only, so link counts need no table of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import ship_package, shuffle_width
from .components import connected_components
from .storage import stored

COSINE = 0.95
WIDTH = 2.0
#: Chance that a pair at exactly the threshold meets in no table.
MISS = 0.002
#: Vectors of a bucket that one block holds; larger buckets are dealt out as pairs of blocks.
BLOCK = 2048
SEED = 7


def meeting(distance: float) -> float:
    """Chance that one projection puts two vectors at this distance into one cell."""
    r = WIDTH / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tables_for(n: int) -> tuple[int, int]:
    """(projections per table, tables) for ``n`` vectors."""
    near, far = meeting(math.sqrt(2 - 2 * COSINE)), meeting(math.sqrt(2))
    m = max(8, math.ceil(math.log(max(n, 2)) / -math.log(far)) + 2)
    return m, math.ceil(math.log(MISS) / math.log1p(-(near**m)))


class Hasher:
    """The same projections in every task: they follow from the seed and the dimension."""

    def __init__(self, m: int, tables: int):
        self.m, self.tables, self.made = m, tables, {}

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """One 64-bit key per vector and table."""
        dim = vectors.shape[1]
        if dim not in self.made:
            rng = np.random.default_rng([SEED, dim])
            self.made[dim] = (
                rng.standard_normal((dim, self.m * self.tables)), rng.uniform(0, WIDTH, self.m * self.tables),
                rng.integers(1, 1 << 62, (self.tables, self.m), dtype=np.int64) * 2 + 1,
            )
        axes, shifts, mix = self.made[dim]
        cells = np.floor((vectors @ axes + shifts) / WIDTH).astype(np.int64)
        with np.errstate(over="ignore"):
            return (cells.reshape(len(vectors), self.tables, self.m) * mix).sum(axis=2)


def usable(vector: str = "embedding"):
    """Not null, not empty, no null or non-finite component, not all zero."""
    return F.coalesce(
        (F.size(vector) > 0)
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vector, lambda x: x != 0),
        F.lit(False),
    )


def unit(column: pa.Array) -> np.ndarray:
    """Vectors of one length as double rows of norm one; scaled first so that no square overflows."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _buckets(classes: DataFrame, m: int, tables: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(m, tables)
        for batch in batches:
            lengths = np.asarray(pa.compute.list_value_length(batch.column(1)))
            for dim in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dim))
                for at in range(0, part.num_rows, 512):
                    some = part.slice(at, 512)
                    keys = hasher.keys(unit(some.column(1)))
                    yield pa.record_batch([
                        pa.array(np.repeat(some.column(0).to_numpy(), tables)),
                        pa.array(np.full(keys.size, dim, np.int32)),
                        pa.array(np.tile(np.arange(tables, dtype=np.int32), len(keys))), pa.array(keys.ravel()),
                    ], ["uid", "dim", "tab", "bucket"])

    return classes.select("uid", "embedding").mapInArrow(run, "uid long, dim int, tab int, bucket long")


def _pairs(group: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs to compare, in blocks: within a group, or across its two sides."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(group)]):
        rows = np.arange(a, b)
        sides = side[a:b]
        if (sides == 0).all():
            for at in range(a, b, 512):
                block = np.arange(at, min(at + 512, b))
                i, j = np.meshgrid(block, np.arange(at, b), indexing="ij")
                keep = i < j
                yield i[keep], j[keep]
        else:
            left, right = rows[sides == 1], rows[sides == 2]
            for at in range(0, len(left), 512):
                i, j = np.meshgrid(left[at : at + 512], right, indexing="ij")
                yield i.ravel(), j.ravel()


def _compare(m: int, tables: int):
    names = ["a", "b", "links"]

    def block(rows: pa.Table, hasher: Hasher) -> Iterator[pa.RecordBatch]:
        group = rows["group"].to_numpy()
        order = np.argsort(group, kind="stable")
        rows, group = rows.take(pa.array(order)), group[order]
        dims = rows["dim"].to_numpy()
        for dim in np.unique(dims):
            part = rows.filter(pa.array(dims == dim)).combine_chunks()
            vectors = unit(part["embedding"].combine_chunks())
            keys, tab = hasher.keys(vectors), part["tab"].to_numpy()
            uid, weight = part["uid"].to_numpy(), part["n"].to_numpy()
            links, label = np.zeros(len(uid), np.int64), np.arange(len(uid))
            some_i, some_j = [], []

            def settle():
                i, j = np.concatenate(some_i), np.concatenate(some_j)
                for at in range(0, len(i), 1 << 18):
                    x, y = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
                    good = np.einsum("ij,ij->i", vectors[x], vectors[y]) >= COSINE
                    x, y = x[good], y[good]
                    first = np.empty(len(x), bool)
                    for s in range(0, len(x), 1 << 14):
                        e = slice(s, s + (1 << 14))
                        first[e] = (keys[x[e]] == keys[y[e]]).argmax(axis=1) == tab[x[e]]
                    np.add.at(links, x[first], weight[y[first]])
                    np.add.at(links, y[first], weight[x[first]])
                    while len(x):  # labels flow along the links, then jump to the label's label
                        low = np.minimum(label[x], label[y])
                        if (label[x] == low).all() and (label[y] == low).all():
                            break
                        np.minimum.at(label, x, low)
                        np.minimum.at(label, y, low)
                        label[:] = label[label]
                some_i.clear(), some_j.clear()

            for i, j in _pairs(part["group"].to_numpy(), part["side"].to_numpy()):
                some_i.append(i), some_j.append(j)
                if sum(map(len, some_i)) > 1 << 19:
                    settle()
            if some_i:
                settle()
            out = np.flatnonzero((label != np.arange(len(label))) | (links > 0))
            yield pa.record_batch([pa.array(uid[out]), pa.array(uid[label[out]]), pa.array(links[out])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The partition is sorted by group; whole groups are gathered up to some thousand rows."""
        hasher, held = Hasher(m, tables), []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(map(len, held)) >= 4 * BLOCK:
                rows = pa.concat_tables(held)
                last = int(np.searchsorted(rows["group"].to_numpy(), rows["group"][-1].as_py()))
                if last:
                    yield from block(rows.slice(0, last), hasher)
                    held = [rows.slice(last)]
        if held and sum(map(len, held)):
            yield from block(pa.concat_tables(held), hasher)

    return run


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """``(vec_id, embedding)`` → ``(vec_id, n_links, component_id, kept)``, one row per input row.

    Links join vectors of cosine 0.95 or more, in double precision. Null, empty or zero vectors and
    those with null or non-finite components link with nothing; neither do vectors of different
    length. Equal vectors are one class with a count, so a class of any size costs one row.
    Repeated rows (same vec_id and vector) count once; a vec_id with several vectors gets a row
    for each. Rows with a null vec_id link with nothing and are kept. Other columns are ignored.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select("vec_id", "embedding").withColumn("good", usable() & F.col("vec_id").isNotNull())
    good = rows.where("good").select("vec_id", "embedding")
    classes = stored(
        good.distinct().groupBy("embedding").agg(F.min("vec_id").alias("uid"), F.count("*").alias("n"))
        # One id can lead two classes when it has several vectors; the class number tells them apart.
        .withColumn("uid", F.col("uid").cast("bigint"))
    )
    m, tables = tables_for(classes.count())
    buckets = stored(_buckets(classes.repartition(shuffle_width(spark), "uid"), m, tables))
    key = ["dim", "tab", "bucket"]
    shared = buckets.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1").select(
        *key, F.ceil(F.col("rows") / BLOCK).cast("int").alias("slices")
    )
    mine, other = F.col("mine"), F.col("other")
    met = buckets.join(stored(shared), key).withColumn(
        "mine", F.pmod(F.xxhash64("uid"), F.col("slices")).cast("int")
    ).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(
        "uid", "dim", "tab",
        F.xxhash64(*key, F.least(mine, other), F.greatest(mine, other)).alias("group"),
        F.when(mine == other, 0).when(mine < other, 1).otherwise(2).alias("side"),
    )
    full = met.join(classes, "uid").repartition(shuffle_width(spark), "group").sortWithinPartitions("group")
    found = stored(
        full.select("group", "side", "uid", "n", "dim", "tab", "embedding")
        .mapInArrow(_compare(m, tables), "a long, b long, links long")
        .groupBy("a", "b").agg(F.sum("links").alias("links"))
    )
    roots = connected_components(found.select("a", "b"))
    counts = found.groupBy("a").agg(F.sum("links").alias("links"))
    told = stored(
        classes.join(counts, classes["uid"] == counts["a"], "left")
        .join(roots, classes["uid"] == roots["node"], "left")
        .select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                F.coalesce("root", "uid").alias("component_id"))
    )
    linked = good.join(told, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = linked.unionByName(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
