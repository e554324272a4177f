"""Importance resampling towards a target text: hashed word features, histograms, Gumbel draws.

An untrained regular-expression split of the tokenizers library parts the lower-cased text into words
with offsets; windows over the offset pairs are the features, and the CRC of each names its bucket.
The features of a document are kept as their buckets, so texts are parted once: the histograms, the
gains of the buckets and the weights are sums over that table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..operators.ordering import ordered_positions
from ..session import ship_package
from .storage import stored
from .words import slices

#: What parts words: all ASCII signs but digits and lower-case letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Features that a worker remembers with their buckets; beyond it the store starts anew.
KEPT_FEATURES = 200_000


class _Buckets(dict):
    """Feature → bucket, filled as features are met."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: str) -> int:
        if len(self) >= KEPT_FEATURES:
            self.clear()
        found = self[feature] = zlib.crc32(feature.encode()) % self.buckets
        return found


class WordWindows:
    """Features of a text: all runs of ``shortest`` to ``longest`` words, joined by a space."""

    def __init__(self, shortest: int, longest: int):
        from tokenizers import Regex, pre_tokenizers

        self.sizes = range(shortest, longest + 1)
        self.splitter = pre_tokenizers.Split(Regex(SEPARATORS), "removed")

    def words(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        """The words with their offsets in the lower-cased text (A-Z only, so offsets stay)."""
        return self.splitter.pre_tokenize_str(text.encode().lower().decode())

    def features(self, text: str) -> tuple[int, list[str]]:
        """Number of words, and the features of every window of offset pairs."""
        words = self.words(text)
        if self.sizes == range(1, 2):
            return len(words), [word for word, _ in words]
        lowered, found = text.encode().lower().decode(), []
        for size in self.sizes:
            for window in zip(*(words[k:] for k in range(size))):
                found.append(" ".join([lowered[start:end] for _, (start, end) in window]))
        return len(words), found


def bucketed(docs: DataFrame, shortest: int = 1, longest: int = 1, buckets: int = 10_000, key: str = "doc_id") -> DataFrame:
    """``(key, text)`` → ``(key, n_words, found)``: the bucket of every feature, repeats included."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, bucket_of = WordWindows(shortest, longest), _Buckets(buckets)
        for part in slices(batches):
            counts, ends, flat = [], [0], []
            for text in part.column(1).to_pylist():
                n_words, features = windows.features(text or "")
                counts.append(n_words)
                flat.append(np.array([bucket_of[f] for f in features], np.int32))
                ends.append(ends[-1] + len(features))
            found = pa.ListArray.from_arrays(np.array(ends, np.int32), np.concatenate([np.empty(0, np.int32), *flat]))
            yield pa.record_batch([part.column(0), pa.array(counts, pa.int64()), found], [key, "n_words", "found"])

    rows = docs.select(key, "text")
    return rows.mapInArrow(run, T.StructType([
        rows.schema[0], T.StructField("n_words", T.LongType()), T.StructField("found", T.ArrayType(T.IntegerType())),
    ]))


def histogram(features: DataFrame, buckets: int) -> np.ndarray:
    """Counts by bucket. Each task adds up its rows first; ``buckets`` bounds what the driver sees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at])], ["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    for row in features.select("found").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain in thousandths: log of its smoothed share in the target over that in the source."""
    width = len(source)
    ratio = (target + 1.0) * float(source.sum() + width) / ((source + 1.0) * float(target.sum() + width))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """``(…, found)`` → ``found`` replaced by ``n_features`` and ``weight``, the floored mean of the gains."""
    sent = features.sparkSession.sparkContext.broadcast(gain)
    kept = [c for c in features.columns if c != "found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("found"))
            sizes = np.diff(lists.offsets.to_numpy())
            sums = np.concatenate([[0], np.cumsum(sent.value[lists.flatten().to_numpy(zero_copy_only=False)])])
            ends = np.concatenate([[0], np.cumsum(sizes)])
            weight = (sums[ends[1:]] - sums[ends[:-1]]) // np.maximum(sizes, 1)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.record_batch(
                [*columns, pa.array(sizes, pa.int64()), pa.array(weight, pa.int64())], [*kept, "n_features", "weight"]
            )

    fields = [features.schema[c] for c in kept]
    more = [T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType())]
    return features.select(*kept, "found").mapInArrow(run, T.StructType([*fields, *more]))


def gumbel(doc_id: Column, seed: int) -> Column:
    """A draw in thousandths that depends on the id and the seed alone; null ids give null."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, shortest: int = 1, longest: int = 1,
    buckets: int = 10_000, seed: int = 2024,
) -> DataFrame:
    """``docs(doc_id, text)``, ``target(text)`` → ``(doc_id, n_features, weight, score, rank)``, a row per document.

    ``percent`` per cent of the documents with ``least_words`` words are drawn without replacement, the
    highest scores first, ties to the smaller doc_id; the others have a null rank. A null or empty text
    has no features and weight 0. Repeated rows count and are drawn one by one. A null doc_id has
    neither score nor rank and is no candidate, but its text counts. Empty tables: no documents give no
    rows, an empty target gives gains that favour what is rare. Texts of any length are read whole;
    other columns are ignored.
    """
    source = stored(bucketed(docs.select("doc_id", "text"), shortest, longest, buckets))
    aim = bucketed(target.select(F.lit(0).alias("_"), "text"), shortest, longest, buckets, "_")
    gain = gains(histogram(source, buckets), histogram(aim, buckets))
    rows = stored(weighed(source, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    able = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    drawn = rows.where(able).count() * percent // 100
    placed = ordered_positions(rows.where(able), [F.col("score").desc(), F.col("doc_id")], "rank")
    place = F.when(F.col("rank") < drawn, F.col("rank") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*columns, place.cast("bigint").alias("rank")).unionByName(
        rows.where(~able).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    )
