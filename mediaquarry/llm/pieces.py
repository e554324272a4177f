"""SentencePiece BPE encoding and decoding by backtracking over the longest matches.

One pass of an Aho-Corasick automaton over the reversed text names, for every position, the pieces
that start there, longest first. Pieces are taken greedily; two neighbours are compatible if merging
their joined letters anew ends in the same two. Where no piece fits, the position is marked as failed
and the last piece gives way to its next shorter one. Every prefix has one encoding, so a failed
position never needs a second visit, and the pieces that reach the end are those of the merges.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import chain, groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

from ..session import ship_package
from .words import slices

SPACE = "▁"
#: Parts of a text, twice, and pairs of pieces that a worker remembers.
KEPT_PARTS, KEPT_PAIRS = 400_000, 500_000
#: Longer parts of a text are encoded each time they occur.
LONG_PART = 60
#: Kinds of a piece and the model type in the model file's public format.
NORMAL, UNKNOWN, CONTROL, BYTE, BPE_MODEL = 1, 2, 3, 6, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The ``(number, value)`` pairs of one protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte, at = data[at], at + 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or number()
        yield tag >> 3, data[at : at + size]
        at += size


class PieceTokenizer:
    """Encoder and decoder of one BPE model file with byte pieces and no text normalisation."""

    def __init__(self, model: bytes):
        rows, trainer, normalizer = [], {}, {}
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                score = struct.unpack("<f", piece.get(2, bytes(4)))[0]
                rows.append((piece[1].decode(), score, piece.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        plain = not normalizer.get(2) and not normalizer.get(4, 1) and normalizer.get(5, 1) and not trainer.get(24, 0)
        if trainer.get(3) != BPE_MODEL or not trainer.get(35) or not plain:
            raise ValueError("only BPE models with byte pieces and without text normalisation are read")
        if {kind for _, _, kind in rows} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("models with user-defined or unused pieces are not read")
        self.prefix = SPACE if normalizer.get(3, 1) else ""
        self.controls = {i for i, (_, _, kind) in enumerate(rows) if kind == CONTROL}
        self.ids = {name: i for i, (name, _, kind) in enumerate(rows) if kind == NORMAL}
        self.scores = {name: score for name, score, kind in rows if kind == NORMAL}
        self.bytes = {int(name[3:-1], 16): i for i, (name, _, kind) in enumerate(rows) if kind == BYTE}
        self.signs = [
            {NORMAL: name.encode(), BYTE: bytes([int(name[3:-1], 16)]) if kind == BYTE else b"", UNKNOWN: " ⁇ ".encode(), CONTROL: b""}[kind]
            for name, _, kind in rows
        ]
        self.sign_bytes = pa.array(self.signs, pa.binary())
        self.is_control = np.array([kind == CONTROL for _, _, kind in rows])
        self.is_spaced = np.array([bool(self.prefix) and kind == NORMAL and name.startswith(SPACE) for name, _, kind in rows])
        self.spaced = {i for name, i in self.ids.items() if self.prefix and name.startswith(SPACE)}
        self.end = next(i for i, (name, _, _) in enumerate(rows) if name == "</s>")
        self.pieces = {i: name for name, i in self.ids.items()}
        self.starts = ahocorasick.Automaton()
        for name, i in self.ids.items():
            self.starts.add_word(name[::-1], (i, len(name)))
        self.starts.make_automaton()
        self.parts = re.compile(self._part_pattern()).findall
        self.pairs: dict[int, bool] = {}
        self.kept: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def _part_pattern(self) -> str:
        """A pattern of parts that no merge crosses: it parts letters that are neighbours in no piece."""
        beside = {name[i : i + 2] for name in self.ids for i in range(len(name) - 1)}
        if any(pair[1] == SPACE != pair[0] for pair in beside):
            return "(?s).+"
        known = {*map(chr, range(128)), *"".join(self.ids)} - {SPACE}
        joined = set("".join(beside))
        alone = "".join(map(re.escape, sorted(known - joined)))
        letters = "".join(sorted({"a", *(c for c in joined if c.isalpha())}))
        after = {pair[1] for pair in beside if pair[0].isalpha()}
        signs = "".join(map(re.escape, sorted(c for c in joined - after if not c.isalpha() and c != SPACE)))
        return (
            f"[{alone}]|{SPACE}*[^{SPACE}{letters}{alone}]*[{letters}]+(?=[{SPACE}{signs}{alone}]|\\Z)"
            f"|{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+"
        )

    def merged(self, letters: str) -> list[str]:
        """The merges by their definition: best score first, then leftmost. For short texts."""
        parts, scores = list(letters), self.scores
        while len(parts) > 1:
            found = [(-scores[both], i) for i, both in enumerate(map(str.__add__, parts, parts[1:])) if both in scores]
            if not found:
                break
            at = min(found)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spelled(self, token: int) -> str:
        """The letters of a piece by its id; a letter without a piece has its negated code for an id."""
        return self.pieces[token] if token >= 0 else chr(~token)

    def compatible(self, left: int | None, right: int) -> bool:
        """Whether the two tokens stay apart and whole when their letters are merged anew."""
        wanted = [self._spelled(token) for token in (left, right) if token is not None]
        return self.merged("".join(wanted)) == wanted

    def split(self, part: str) -> list[int]:
        """The tokens of a part: ids of its pieces, negated codes of letters without one."""
        size, pairs = len(part), self.pairs
        starts: list[list[tuple[int, int]]] = [[] for _ in part]
        for at, found in self.starts.iter(part[::-1]):
            starts[~at].append(found)
        failed, taken, at, choice, left = bytearray(size + 1), [], 0, 0, None
        while at < size:
            options = starts[at]
            if not options or options[-1][1] != 1:
                options.append((~ord(part[at]), 1))
            for token, length in options[choice:] if choice else options:
                if not failed[at + length]:
                    # One number for a pair: ids and negated codes stay below 2^23.
                    pair = ~token if left is None else (left << 24) + token
                    fits = pairs.get(pair)
                    if fits is None:
                        if len(pairs) >= KEPT_PAIRS:
                            pairs.clear()
                        fits = pairs[pair] = self.compatible(left, token)
                    if fits:
                        taken.append((at, choice, token))
                        left, at, choice = token, at + length, 0
                        break
                choice += 1
            else:
                failed[at] = 1
                at, choice, _ = taken.pop()
                choice += 1
                left = taken[-1][2] if taken else None
        return [token for _, _, token in taken]

    def _ids_of(self, part: str) -> list[int]:
        """Ids of a part, its letters without a piece as byte pieces."""
        found = self.older.get(part)
        if found is None:
            found = []
            for token in self.split(part):
                if token >= 0:
                    found.append(token)
                else:
                    found.extend([self.bytes[b] for b in chr(~token).encode()])
        if len(part) <= LONG_PART:
            if len(self.kept) >= KEPT_PARTS:
                # What was not met since the last time is forgotten.
                self.older, self.kept = self.kept, {}
            self.kept[part] = found
        return found

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text and the end id."""
        ids, kept = [], self.kept.get
        if text:
            for part in self.parts(self.prefix + text.replace(" ", SPACE)):
                found = kept(part)
                if found is None:
                    found, kept = self._ids_of(part), self.kept.get
                ids += found
        ids.append(self.end)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: control ids vanish, each byte that belongs to no sign is a replacement sign."""
        signs, runs = self.signs, [ids]
        if not self.controls.isdisjoint(ids[:-1]):
            # A control id ends a run of byte pieces.
            runs = [list(run) for control, run in groupby(ids, self.controls.__contains__) if not control]
        text = "".join([_read(b"".join([signs[i] for i in run])) for run in runs])
        # The added space belongs to the first piece only, a byte piece is none.
        first = next((i for i in ids if i not in self.controls), None)
        return text[first in self.spaced :]

    def decode_all(self, flat: np.ndarray, ends: np.ndarray) -> list[str]:
        """``decode`` of many lists: their ids one after the other, and where each list ends."""
        if not len(flat):
            return [""] * len(ends)
        taken = self.sign_bytes.take(pa.array(flat))
        offsets, data = (np.frombuffer(buffer, kind) for buffer, kind in zip(taken.buffers()[1:], (np.int32, np.uint8)))
        places = np.flatnonzero(self.is_control[flat])
        # Lists with a control id that is not their last are read run by run.
        owner = np.searchsorted(ends, places, "right")
        odd = set(owner[places != ends[owner] - 1].tolist())
        texts, start = [], 0
        for number, end in enumerate(ends.tolist()):
            if number in odd:
                texts.append(self.decode(flat[start:end].tolist()))
            else:
                text = _read(data[offsets[start] : offsets[end]].tobytes())
                texts.append(text[start < end and bool(self.is_spaced[flat[start]]) :])
            start = end
        return texts


def _read(signs: bytes) -> str:
    """Bytes of pieces as text; each byte that belongs to no sign is a replacement sign."""
    text = signs.decode("utf-8", "surrogateescape")
    return text if text.isascii() else re.sub("[\udc80-\udcff]", "�", text.replace(SPACE, " "))


_LOADED: dict[int, PieceTokenizer] = {}


def loaded(model: bytes) -> PieceTokenizer:
    """The tokenizer of this worker process, read once."""
    if hash(model) not in _LOADED:
        _LOADED.clear()
        _LOADED[hash(model)] = PieceTokenizer(model)
    return _LOADED[hash(model)]


def _sent(spark: SparkSession, path: str):
    ship_package(spark)
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([len(row) for row in ids], dtype=np.int32)
    return np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]) if len(ends) else 0), ends


def _listed(flat: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([np.zeros(1, np.int32), ends]), flat)


_IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))
_DECODED = T.StructField("decoded", T.StringType())


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``(doc_id, text)`` → ``(doc_id, ids)`` with the model file at ``model``, the end id last.

    The file is read on the driver and sent to the tasks; its size is that of the vocabulary. A null
    or empty text has the end id alone, an empty table gives no rows, a text of any length is encoded
    whole. Repeated rows are encoded one by one, a null doc_id stays null, other columns are ignored.
    """
    sent = _sent(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(sent.value)
        for part in slices(batches):
            ids = _flat([tokenizer.encode(t or "") for t in part.column(1).to_pylist()])
            yield pa.record_batch([part.column(0), _listed(*ids)], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.select("doc_id").schema[0], _IDS]))


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``(doc_id, ids)`` → the same with ``decoded``; null ids and an empty list give an empty text."""
    sent = _sent(encoded.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(sent.value)
        for part in slices(batches):
            texts = tokenizer.decode_all(*_flat([ids or [] for ids in part.column(1).to_pylist()]))
            yield pa.record_batch([*part.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    kept = encoded.select("doc_id", "ids")
    return kept.mapInArrow(run, T.StructType([*kept.schema, _DECODED]))


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """``(doc_id, text)`` → ``(doc_id, ids, decoded)``: ``decode`` of ``encode`` in one pass.

    One Python worker a core holds one tokenizer, where the two steps in a row need two of each.
    Nulls, repeats, lengths, empty tables and other columns are treated as by ``encode``.
    """
    sent = _sent(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(sent.value)
        for part in slices(batches):
            ids = _flat([tokenizer.encode(t or "") for t in part.column(1).to_pylist()])
            texts = pa.array(tokenizer.decode_all(*ids), pa.string())
            yield pa.record_batch([part.column(0), _listed(*ids), texts], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(
        run, T.StructType([docs.select("doc_id").schema[0], _IDS, _DECODED])
    )
