"""BPE encoding and decoding with a word-level merge table.

A word is an array of parts beside an array of the ranks of adjacent parts. The smallest rank is
scanned for, its boundary deleted and the two neighbouring ranks refreshed, until no rank is left.
Both arrays are contiguous and short, so the scan beats a heap; words beyond ``LONG_WORD`` parts
take a heap over the same ranks, which gives the same merges without the square of the length.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame, types as T

from ..session import ship_package

LONG_WORD = 200
#: Words kept per task between batches; beyond it the store starts anew.
KEPT_WORDS = 150_000
_NONE = 1 << 60
_SHIFT = 20
# ``str.split`` parts words here, the tokenizer file does not.
_SEPARATORS = regex.compile(r"[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def token_names(spec: str) -> dict[int, str]:
    """Id → token, the added tokens included: all that decoding needs."""
    read = json.loads(spec)
    return {i: t for t, i in [*read["model"]["vocab"].items(), *((t["content"], t["id"]) for t in read["added_tokens"])]}


class WordTokenizer:
    """The encoder and decoder of one tokenizer file in JSON form."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model, vocab = spec["model"], spec["model"]["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*vocab.items(), *self.added.items()]}
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + end] for c in letters]
        # A pair of ids is one integer: the left id shifted, then the right one.
        self.rank, self.joined = {}, {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            key = vocab[left] << _SHIFT | vocab[right]
            self.rank[key], self.joined[key] = rank, vocab[left + right]
        split = next(s for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))))
        self.store: dict[str, bytes] = {}

    def _rank(self, left: int, right: int) -> int:
        return self.rank.get(left << _SHIFT | right, _NONE)

    def merge(self, parts: list[int]) -> list[int]:
        if len(parts) > LONG_WORD:
            return self._merge_long(parts)
        rank, joined = self.rank.get, self.joined
        ranks = [rank(a << _SHIFT | b, _NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            at = ranks.index(best)
            part = parts[at] = joined[parts[at] << _SHIFT | parts[at + 1]]
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank(part << _SHIFT | parts[at + 1], _NONE)
            if at:
                ranks[at - 1] = rank(parts[at - 1] << _SHIFT | part, _NONE)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        size = len(parts)
        after, before = [*range(1, size), -1], list(range(-1, size - 1))
        heap = [(r, i) for i in range(size - 1) if (r := self._rank(parts[i], parts[i + 1])) != _NONE]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j < 0 or self._rank(parts[i], parts[j]) != rank:
                continue
            parts[i], parts[j] = self.joined[parts[i] << _SHIFT | parts[j]], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (r := self._rank(parts[k], parts[after[k]])) != _NONE:
                    heapq.heappush(heap, (r, k))
        return [p for p in parts if p >= 0]

    def _piece(self, piece: str) -> bytes:
        """The ids of a run of text without white space."""
        words = self.words.findall(piece)
        if len(words) == 1 and words[0] == piece:
            raw = piece.encode()
            parts = [self.inner[b] for b in raw]
            parts[-1] = self.last[raw[-1]]
            return array("i", self.merge(parts)).tobytes()
        return b"".join([self._ids(word) for word in words])

    def _ids(self, piece: str) -> bytes:
        ids = self.store.get(piece)
        if ids is None:
            ids = self._piece(piece)
            if len(piece) <= LONG_WORD:
                self.store[piece] = ids
        return ids

    def _plain(self, text: str) -> list[bytes]:
        """No word spans white space, so a piece between white space is looked up as a whole."""
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        found, store = [], self.store
        for piece in self.words.findall(text) if _SEPARATORS.search(text) else text.split():
            found.append(store.get(piece) or self._ids(piece))
        return found

    def encode(self, text: str) -> np.ndarray:
        found, at = [], 0
        for mark in self.special.finditer(text):
            found += self._plain(text[at:mark.start()])
            found.append(array("i", [self.added[mark.group()]]).tobytes())
            at = mark.end()
        found += self._plain(text[at:] if at else text)
        if len(self.store) > KEPT_WORDS:
            self.store = {}
        return np.frombuffer(b"".join(found), dtype=np.int32)

    def decode(self, ids) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


_LOADED: dict[int, WordTokenizer] = {}


def loaded(spec: str) -> WordTokenizer:
    """The tokenizer of this worker process: parsed once, its words shared by the tasks it runs."""
    if hash(spec) not in _LOADED:
        _LOADED.clear()
        _LOADED[hash(spec)] = WordTokenizer(spec)
    return _LOADED[hash(spec)]


def _listed(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, np.int32), *ids]))


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, text)`` → ``(doc_id, ids)`` with the tokenizer file at ``vocabulary``.

    The file is read on the driver and sent to the tasks; its size is that of the vocabulary.
    A null or empty text has no ids. Repeated rows are encoded one by one, other columns are
    ignored, a null doc_id stays null.
    """
    ship_package(docs.sparkSession)
    with open(vocabulary, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(spec.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = [tokenizer.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), _listed(ids)], ["doc_id", "ids"])

    schema = T.StructType([docs.select("doc_id").schema[0], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, text)`` → ``(doc_id, ids, decoded)``: ``decode`` of ``encode`` in one pass.

    One Python worker a core holds one tokenizer, where the two steps in a row need two of each.
    Nulls, repeats and other columns are treated as by ``encode``.
    """
    ship_package(docs.sparkSession)
    with open(vocabulary, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(spec.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = [tokenizer.encode(t or "") for t in part.column(1).to_pylist()]
                texts = pa.array([tokenizer.decode(i.tolist()) for i in ids], pa.string())
                yield pa.record_batch([part.column(0), _listed(ids), texts], ["doc_id", "ids", "decoded"])

    schema = T.StructType([
        docs.select("doc_id").schema[0], T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("decoded", T.StringType()),
    ])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, ids)`` → the same with ``decoded``: the tokens joined by a space, as without a decoder."""
    ship_package(encoded.sparkSession)
    with open(vocabulary, encoding="utf-8") as file:
        spec = encoded.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_names(spec.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ends = [0, *np.cumsum(pa.compute.list_value_length(part.column(1)).fill_null(0).to_numpy()).tolist()]
                flat = part.column(1).flatten().to_pylist()
                texts = [" ".join([tokens[i] for i in flat[a:b]]) for a, b in zip(ends, ends[1:])]
                yield pa.record_batch([*part.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    kept = encoded.select("doc_id", "ids")
    return kept.mapInArrow(run, T.StructType([*kept.schema, T.StructField("decoded", T.StringType())]))
