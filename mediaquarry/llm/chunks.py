"""Substring dedup by content-defined chunking with a gear rolling hash.

A gear hash over the last 16 bytes cuts a text where its value falls below a limit, so the cuts
depend on the bytes around them alone: an insertion moves the chunks behind it and changes none.
Chunks are compared by digest across all documents, and neighbouring repeated chunks join into
spans. The hash is computed for whole batches by doubling: the hash of 2n bytes is that of the
later n plus the shifted hash of the n before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import ship_package

HASH_BYTES = 16
#: One position in so many may be cut, and is if no other such position lies close before it.
#: Both conditions look at nearby bytes alone. Chunks come to 30 bytes on average.
ONE_IN, APART = 20, 8
#: Words that a span of repeated chunks must hold to be reported.
MIN_WORDS = 16
_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def cuts(raw: np.ndarray) -> np.ndarray:
    """Positions after which the bytes are cut; the first ``HASH_BYTES - 1`` positions never are."""
    if len(raw) < HASH_BYTES:
        return np.empty(0, np.int64)
    value, width = _GEAR[raw], 1
    while width < HASH_BYTES:
        value[width:] = value[width:] + (value[:-width] << np.uint32(width))
        width *= 2
    # Only the top 17 of 32 bits have seen all 16 bytes.
    low = value >> np.uint32(HASH_BYTES - 1) < np.uint32((1 << 17) // ONE_IN)
    low[: HASH_BYTES - 1] = False
    found = np.flatnonzero(low) + 1
    return found[np.diff(found, prepend=-APART) >= APART]


def _chunks(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """(text number, begin, end, words, digest) of every chunk of every text, in order."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    rows, begins, ends, words, digests = [], [], [], [], []
    digest = xxhash.xxh3_64_intdigest
    for number, raw in enumerate(raws):
        if not raw:
            continue
        data = np.frombuffer(raw, np.uint8)
        edge = np.concatenate([[0], cuts(data), [len(raw)]])
        edge = edge[np.concatenate([[True], edge[1:] > edge[:-1]])]
        # A word counts where it begins.
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        start = ~blank & np.concatenate([[True], blank[:-1]])
        sums = np.concatenate([[0], np.cumsum(start)])[edge]
        marks = edge.tolist()
        digests += [digest(raw[a:b]) for a, b in zip(marks, marks[1:])]
        rows.append(np.full(len(marks) - 1, number)), begins.append(edge[:-1]), ends.append(edge[1:]), words.append(np.diff(sums))
    empty = np.empty(0, np.int64)
    return (*(np.concatenate([empty, *x]) for x in (rows, begins, ends, words)), np.array(digests, np.uint64).view(np.int64))


def chunks(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` → ``(doc_id, begin, end, words, digest)``; offsets count UTF-8 bytes."""
    ship_package(docs.sparkSession)
    names = ["doc_id", "begin", "end", "words", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, begin, end, words, digest = _chunks(part.column(1).to_pylist())
                yield pa.record_batch([
                    part.column(0).take(pa.array(rows)), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(words.astype(np.int32)), pa.array(digest),
                ], names)

    kind = T.IntegerType()
    schema = T.StructType([docs.select("doc_id").schema[0], *(T.StructField(n, kind) for n in names[1:4]), T.StructField("digest", T.LongType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` → ``(doc_id, begin, end, words, first_doc_id, kept)``, a row per span.

    A span is a run of neighbouring chunks that other documents hold too and that has 16 words or
    more; passages of over 50 words come out less the chunk that is cut at either end. ``kept`` is
    true where no document with a smaller id holds any of its chunks. Null, empty and short texts
    have no span; rows that share a doc_id are one document; rows with a null doc_id are left out.
    Other columns are ignored.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    # Counts combine in the map tasks, so a passage that a third of all documents share is as
    # cheap as any other; the join reads two plain shuffles, which adaptive execution may split.
    shared = chunks(docs).groupBy("digest").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("_last"))
    shared = shared.where("first_doc_id < _last").select("digest", "first_doc_id")
    found = chunks(docs).join(shared, "digest").drop("digest").distinct()
    along = Window.partitionBy("doc_id").orderBy("begin")
    opens = F.coalesce(F.lag("end").over(along) != F.col("begin"), F.lit(True)).cast("int")
    return found.withColumn("opens", opens).withColumn("island", F.sum("opens").over(along)).groupBy("doc_id", "island").agg(
        F.min("begin").alias("begin"), F.max("end").alias("end"), F.sum("words").alias("words"),
        F.min("first_doc_id").alias("first_doc_id"),
    ).where(F.col("words") >= MIN_WORDS).drop("island").withColumn("kept", F.col("first_doc_id") == F.col("doc_id"))
