"""Language identification by error-correcting output codes.

Every language has a codeword. One binary classifier per bit sees hashed n-grams of the text and
tells the languages with a one from those with a zero: its weights are log odds of n-gram rates,
counted over all learning texts, every language weighing the same. Decoding sums the logistic loss
of every bit against every codeword, weighted by how well that bit separates the languages, takes
the nearest codeword and flags a runner-up that is close.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import ship_package
from .words import slices

FEATURES = 1 << 15
SMOOTHING = 0.5
#: Sharpness of the logistic loss in units of mean log odds.
SHARPNESS = 4.0
#: Loss difference to the runner-up below which a prediction is ambiguous.
MARGIN = 0.3
_PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def features(text: str) -> np.ndarray:
    """Hashed byte n-grams of length 1 to 3 of the whole lower-cased text, other signs as one space."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()) + b" "
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    grams = [a, a[:-1] << 8 | a[1:] | 1 << 24, a[:-2] << 16 | a[1:-1] << 8 | a[2:] | 2 << 24]
    return (np.concatenate(grams) * np.uint32(2654435761)) >> np.uint32(32 - 15)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def codewords(n: int) -> np.ndarray:
    """±1 matrix, a row per language: all splits in two up to 7 languages, else spread random rows."""
    if n <= 7:
        splits = [s for s in itertools.product((1, -1), repeat=n) if s[0] == 1 and -1 in s] or [(1,) * max(n, 1)]
        return np.array(splits, dtype=np.float64).T[:n]
    rng = np.random.default_rng(5)
    bits = 8 * int(np.ceil(np.log2(n)))
    best, least = None, -1
    for _ in range(64):
        code = rng.choice([-1.0, 1.0], (n, bits))
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if apart > least and all(len(set(col)) == 2 for col in code.T):
            best, least = code, apart
    return best


class Model:
    """``rates``: a row of n-gram rates per language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        if not languages:
            return
        self.code = codewords(len(languages))
        smooth = counts + SMOOTHING
        rates = smooth / smooth.sum(axis=1, keepdims=True)
        ones = (self.code > 0).astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            high = np.log(ones.T @ rates / np.maximum(ones.sum(axis=0), 1)[:, None])
            low = np.log((1 - ones).T @ rates / np.maximum((1 - ones).sum(axis=0), 1)[:, None])
        self.weights = np.nan_to_num((high - low).T, posinf=0, neginf=0).astype(np.float32)
        apart = (self.code * (rates @ self.weights)).min(axis=0)
        self.trust = np.maximum(apart, 1e-3) / np.maximum(apart, 1e-3).mean()

    def predict(self, text: str) -> tuple[str, float, bool]:
        if not self.languages:
            return "und", 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        margins = self.weights[features(text)].mean(axis=0, dtype=np.float64)
        loss = (self.trust * np.logaddexp(0, -SHARPNESS * self.code * margins)).sum(axis=1)
        order = np.argsort(loss, kind="stable")
        chance = np.exp(loss[order[0]] - loss)
        return self.languages[order[0]], float(1 / chance.sum()), bool(loss[order[1]] - loss[order[0]] < MARGIN)


def fit(docs: DataFrame) -> Model:
    """Count n-grams of all rows with a text and a language; only languages × features counts leave the tasks."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = counts.setdefault(lang, np.zeros(FEATURES, np.int64))
                found += np.bincount(features(text), minlength=FEATURES)
        for lang, found in counts.items():
            at = np.flatnonzero(found)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(found[at])], ["lang", "f", "n"])

    rows = docs.where("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    summed = rows.mapInArrow(run, "lang string, f long, n long").groupBy("lang", "f").agg(F.sum("n").alias("n"))
    table = summed.toPandas()
    languages = sorted(table["lang"].unique())
    counts = np.zeros((len(languages), FEATURES))
    np.add.at(counts, (np.searchsorted(languages, table["lang"]) if len(table) else [], table["f"].to_numpy(int)), table["n"].to_numpy(float))
    return Model(languages, counts)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, text)`` → ``(doc_id, lang_pred, score, ambiguous)``.

    A null text or one without a letter is ``und`` with score 0. The whole text counts, however
    long; equal losses go to the first language by name. Repeated rows and null ids are judged one
    by one, other columns are ignored; without any learned language every text is ``und``.
    """
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = sent.value
        for batch in slices(batches):
            found = [judge.predict(t) if has_letter(t) else ("und", 0.0, False) for t in batch.column(1).to_pylist()]
            lang, score, unsure = zip(*found) if found else ((), (), ())
            yield pa.record_batch(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())],
                ["doc_id", "lang_pred", "score", "ambiguous"],
            )

    schema = T.StructType([
        docs.select("doc_id").schema[0], T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType()),
    ])
    return docs.select("doc_id", "text").mapInArrow(run, schema)
