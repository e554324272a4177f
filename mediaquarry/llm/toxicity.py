"""Toxicity by a learned lexicon, Levenshtein automata over its trie, and context windows.

Terms are words and word beginnings that mark labelled toxic texts. They form one trie; the
automaton that accepts every word within the allowed edits of a term is the trie intersected with
Levenshtein automata, made deterministic state by state as texts need it. A word dies in it after a
few letters unless it is near a term. An edit may fall on any letter, the first as well; a word that is
near a term by edits alone counts for nothing if the labelled clean texts use it and it does not mark
toxic ones as a term must. Each hit is weighed by the words around it: quotation marks
and reporting verbs speak for quotation, second-person words for abuse. The evidence of a text is
turned into a probability by the share of toxic texts at that evidence among the labelled ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import ship_package
from .storage import small, stored
from .words import slices

#: Lengths of the word beginnings that may become terms.
STEMS = (4, 5, 6)
#: A term needs this likelihood ratio (G²) and these log odds for toxic texts.
MIN_RATIO, MIN_ODDS = 25.0, 3.0
#: Bound of the lexicon, strongest terms first; it is all that is sent to the tasks.
LEXICON = 20_000
#: Whole-word terms of at least these lengths are also found with one edit and with two.
EDIT_LENGTHS = (4, 10)
#: Bound of the words near a term that clean texts use, the most frequent first; sent to the tasks as well.
SPARED = 200_000
WINDOW = 6
THRESHOLD = 0.3
#: Width and number of the evidence steps that are calibrated.
STEP, STEPS = 2.0, 16
#: Pieces of text and nodes of automaton states remembered by a worker before it starts anew.
KEPT_PIECES, KEPT_NODES = 200_000, 1_000_000
#: Letters of a beginning that is remembered, and signs around a word that are no part of it.
HEAD, _SIGNS = 4, "\"'.,;:!?()[]{}“”„«»‘’_-"
#: Labels that are broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 5_000_000
ADDRESS = frozenset("you your you're youre yours yourself u ur tu te du dich dein deine sie ihr vous vos votre usted".split())
REPORT = frozenset(
    "said says called calls wrote writes quote quoted quotes word term phrase cited sagte nannte schrieb dit "
    "appelé écrit dijo llamó escribió".split()
)
QUOTES = frozenset("\"“”„«»‘’'")
_WORD = re.compile(r"[^\W_]+")


@dataclass
class Lexicon:
    """``terms``: word or ``stem*`` → weight; ``rates``: probability per evidence step; ``spared``: words
    that are no variant of a term."""

    terms: dict[str, float]
    rates: list[float]
    spared: frozenset[str] = frozenset()


def allowed_edits(word: str) -> int:
    return sum(len(word) >= length for length in EDIT_LENGTHS)


class Automaton:
    """Words within the allowed edits of a term; states are sets of (trie node, edits)."""

    def __init__(self, terms: dict[str, float]):
        self.children, self.whole, self.stem, self.room = [{}], [None], [None], [0]
        for term in sorted(terms):
            stem, word = term.endswith("*"), term.rstrip("*")
            node, path = 0, [0]
            for letter in word:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({}), self.whole.append(None), self.stem.append(None), self.room.append(0)
                node = self.children[node][letter]
                path.append(node)
            (self.stem if stem else self.whole)[node] = (terms[term], 0 if stem else allowed_edits(word))
            if not stem:
                for step in path:
                    self.room[step] = max(self.room[step], allowed_edits(word))
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.sets, self.moves, self.begun, self.ended, self.exact, self.held = {}, [], [], [], [], [], 0
        self.start = self._number(self._closed({(0, 0)}))

    def _number(self, state: frozenset) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.sets)
            self.sets.append(state), self.moves.append({})
            self.held += len(state)
            # What a word is worth that has come here, and that ends here.
            begun = [self.stem[node][0] for node, edits in state if self.stem[node] and edits == 0]
            ended = [
                self.whole[node][0] * (1 - 0.3 * edits) for node, edits in state
                if self.whole[node] and edits <= self.whole[node][1]
            ]
            exact = [self.whole[node][0] for node, edits in state if self.whole[node] and edits == 0]
            self.begun.append(max(begun, default=0.0)), self.ended.append(max(ended, default=0.0))
            self.exact.append(max(exact, default=0.0))
        return self.numbers[state]

    def _closed(self, reached: set[tuple[int, int]]) -> frozenset:
        """With term letters skipped; per node only the fewest edits count."""
        fewest, todo = {}, sorted(reached, key=lambda x: x[1])
        while todo:
            node, edits = todo.pop(0)
            if fewest.get(node, 9) <= edits:
                continue
            fewest[node] = edits
            todo += [(c, edits + 1) for c in self.children[node].values() if edits < self.room[c]]
        return frozenset(fewest.items())

    def _step(self, state: int, letter: str) -> int:
        reached = set()
        for node, edits in self.sets[state]:
            child = self.children[node].get(letter)
            if child is not None:
                reached.add((child, edits))
            if edits < self.room[node]:
                reached.add((node, edits + 1))
                reached |= {(c, edits + 1) for c in self.children[node].values() if edits < self.room[c]}
        found = self._number(self._closed(reached)) if reached else -1
        self.moves[state][letter] = found
        return found

    def dies(self, head: str) -> bool:
        """No word that begins so is near a term."""
        if self.held > KEPT_NODES:
            self._forget()
        state = self.start
        for letter in head:
            to = self.moves[state].get(letter)
            state = self._step(state, letter) if to is None else to
            if state < 0:
                return True
            if self.begun[state]:
                return False
        return False

    def weights(self, word: str) -> tuple[float, float]:
        """Of the best term near the word, less a part for each edit, and of the best without edits; 0 if there is none."""
        if self.held > KEPT_NODES:
            self._forget()
        moves, begun, state, best = self.moves, self.begun, self.start, 0.0
        for letter in word:
            to = moves[state].get(letter)
            state = self._step(state, letter) if to is None else to
            if state < 0:
                return best, best
            if begun[state] > best:
                best = begun[state]
        return max(best, self.ended[state]), max(best, self.exact[state])


class Judge:
    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.automaton, self.clean, self.dead = lexicon, Automaton(lexicon.terms), set(), {}

    def _word(self, word: str) -> float:
        near, exact = self.automaton.weights(word)
        return exact if near != exact and word in self.lexicon.spared else near

    def variants(self, text: str) -> set[str]:
        """Words of the text that are near a term by edits alone."""
        words = set()
        for piece in set(text.lower().split()):
            bare = piece.strip(_SIGNS)
            words.update([bare] if bare.isalpha() else _WORD.findall(piece))
        return {w for w in words if not self._dead(w) and (found := self.automaton.weights(w))[0] and not found[1]}

    def _dead(self, word: str) -> bool:
        head = word[:HEAD]
        dead = self.dead.get(head)
        if dead is None:
            if len(self.dead) >= KEPT_PIECES:
                self.dead.clear()
            dead = self.dead[head] = self.automaton.dies(head)
        return dead

    def _weight(self, piece: str) -> float:
        """Of the best term in a piece between white space.

        A plain word mostly dies within its first letters; whether it does is remembered for each
        beginning, and whole pieces without a term only where the beginning is no reason.
        """
        bare = piece.strip(_SIGNS)
        if bare.isalpha():
            if self._dead(bare):
                return 0.0
            found = self._word(bare)
        else:
            found = max((self._word(w) for w in _WORD.findall(piece)), default=0.0)
        if not found and len(piece) < 100:
            if len(self.clean) >= KEPT_PIECES:
                self.clean.clear()
            self.clean.add(piece)
        return found

    def hits(self, text: str) -> list[tuple[int, float, str]]:
        """(word number, weight, quoted | abuse | plain) of every term in the text."""
        pieces = text.lower().split()
        weights = {}
        for piece in set(pieces) - self.clean:
            if weight := self._weight(piece):
                weights[piece] = weight
        if not weights:
            return []
        found = []
        for at, piece in enumerate(pieces):
            if weight := weights.get(piece):
                before, after = pieces[max(0, at - WINDOW) : at], pieces[at + 1 : at + 1 + WINDOW]
                bare = {w.strip(".,;:!?()\"“”„«»") for w in before + after}
                opened = piece[0] in QUOTES or any(w[0] in QUOTES for w in before)
                closed = piece[-1] in QUOTES or any(w.rstrip(".,;:!?")[-1:] in QUOTES for w in after)
                quoted = (opened and closed) or bool(bare & REPORT and (opened or closed))
                found.append((at, weight, "quoted" if quoted else "abuse" if bare & ADDRESS else "plain"))
        return found

    def evidence(self, text: str | None) -> float:
        weigh = {"quoted": 0.4, "plain": 1.0, "abuse": 1.2}
        return sum(weight * weigh[kind] for _, weight, kind in self.hits(text or ""))

    def score(self, evidence: float) -> float:
        """Between two calibrated steps the score is interpolated, so stronger evidence never scores less."""
        rates, at = self.lexicon.rates, min(evidence / STEP, STEPS - 1.0)
        low = int(at)
        high = min(low + 1, STEPS - 1)
        return rates[low] + (rates[high] - rates[low]) * (at - low)


_JUDGES: dict[tuple, Judge] = {}


def _judge(lexicon: Lexicon) -> Judge:
    """One judge per worker process and lexicon, so that tasks share what it remembers."""
    key = (tuple(lexicon.terms.items()), tuple(lexicon.rates), lexicon.spared)
    if key not in _JUDGES:
        _JUDGES.clear()
        _JUDGES[key] = Judge(lexicon)
    return _JUDGES[key]


def _terms() -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1))
    stems = [F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*"))) for n in STEMS]
    return F.array_distinct(F.concat(words, *stems))


def _odds(pos: int, neg: int) -> Column:
    """Log odds of a word for toxic texts, from the toxic (p) and clean (n) texts that hold it."""
    return F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("n") + 0.5) / (neg + 1))


def _learn_terms(rows: DataFrame, pos: int, neg: int) -> dict[str, float]:
    if not pos or not neg:
        return {}
    counts = rows.select("toxic", F.explode(_terms()).alias("term")).groupBy("term").agg(
        F.sum("toxic").alias("p"), (F.count("*") - F.sum("toxic")).alias("n")
    ).where("p > 2")
    p, n, prior = F.col("p"), F.col("n"), pos / (pos + neg)
    ratio = 2 * (p * F.log(p / ((p + n) * prior)) + F.when(n > 0, n * F.log(n / ((p + n) * (1 - prior)))).otherwise(0.0))
    found = counts.select("term", _odds(pos, neg).alias("odds"), ratio.alias("ratio")).where(
        (F.col("odds") >= MIN_ODDS) & (F.col("ratio") >= MIN_RATIO)
    ).orderBy(F.desc("ratio"), "term").limit(LEXICON).collect()
    terms: dict[str, float] = {}
    # Shorter beginnings first: a longer one under one that is as clear says nothing new. Words that
    # may be misspelled stay, as beginnings are found without edits.
    for row in sorted(found, key=lambda r: (len(r["term"].rstrip("*")) + (not r["term"].endswith("*")), r["term"])):
        bare = row["term"].rstrip("*")
        over = max((terms.get(f"{bare[:n]}*", -9.0) for n in STEMS if n <= len(bare)), default=-9.0)
        if over < row["odds"] - 1.0 or (bare == row["term"] and allowed_edits(bare)):
            terms[row["term"]] = row["odds"]
    return terms


def _learn_spared(rows: DataFrame, lexicon: Lexicon, pos: int, neg: int) -> frozenset[str]:
    """Words near a term that clean texts use and that are no term by their own odds."""
    if not lexicon.terms:
        return frozenset()
    ship_package(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(sent.value)
        for batch in slices(batches):
            texts, marks = (column.to_pylist() for column in batch.columns)
            found = [(word, mark) for text, mark in zip(texts, marks) for word in judge.variants(text)]
            yield pa.record_batch([pa.array([w for w, _ in found], pa.string()), pa.array([m for _, m in found], pa.int32())], ["word", "toxic"])

    counts = rows.mapInArrow(run, "word string, toxic int").groupBy("word").agg(
        F.sum("toxic").alias("p"), (F.count("*") - F.sum("toxic")).alias("n")
    )
    found = counts.where((F.col("n") > 0) & (_odds(pos, neg) < MIN_ODDS)).orderBy(F.desc("n"), "word").limit(SPARED)
    return frozenset(r["word"] for r in found.collect())


def _run(docs: DataFrame, lexicon: Lexicon, column: str, kept: list[str]) -> DataFrame:
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(sent.value)
        for batch in slices(batches):
            found = [judge.evidence(t) for t in batch.column(0).to_pylist()]
            if column == "score":
                found = [judge.score(x) for x in found]
            yield pa.record_batch([*batch.columns[1:], pa.array(found, pa.float64())], [*kept, column])

    rows = docs.select("text", *kept)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[1:], T.StructField(column, T.DoubleType())]))


def fit(rows: DataFrame) -> Lexicon:
    """``(text, toxic)`` → the lexicon and its calibration, counted over all rows.

    Rows with a null text or a label other than 0 or 1 teach nothing.
    """
    rows = rows.where("text is not null and toxic in (0, 1)").select("text", F.col("toxic").cast("int").alias("toxic"))
    total = rows.agg(F.sum("toxic"), F.count("*")).first()
    positive, negative = int(total[0] or 0), int(total[1] or 0) - int(total[0] or 0)
    lexicon = Lexicon(_learn_terms(rows, positive, negative), [])
    lexicon.spared = _learn_spared(rows, lexicon, positive, negative)
    step = F.least(F.floor(F.col("evidence") / STEP + 0.5), F.lit(STEPS - 1)).alias("step")
    cells = _run(rows, lexicon, "evidence", ["toxic"]).groupBy(step).agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).collect()
    pos, n = [0.0] * STEPS, [0.0] * STEPS
    for cell in cells:
        pos[cell["step"]], n[cell["step"]] = float(cell["p"]), float(cell["n"])
    base = (sum(pos) + 0.5) / (sum(n) + 10)
    # Pool neighbours until more evidence never means a smaller rate; thin steps lean on the prior.
    blocks: list[list[float]] = []
    for p, m in zip(pos, n):
        blocks.append([p + base, m + 1.0, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last)]
    lexicon.rates = [b[0] / b[1] for b in blocks for _ in range(int(b[2]))]
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``(doc_id, text)`` → ``(doc_id, score, predicted)``, score 0 to 1, predicted 1 from 0.3.

    Null and empty texts hold no term and get the score of no evidence. The whole text counts.
    Repeated rows and null ids are scored one by one; other columns are ignored.
    """
    return _run(docs, lexicon, "score", ["doc_id"]).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def learning_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts with their label; a doc_id with several labels teaches each of them."""
    marks, few = small(labels.select(F.col("doc_id").alias("_labelled"), "toxic"), BROADCAST_LABELS)
    rows = docs.select("doc_id", "text").join(marks, F.col("doc_id") == F.col("_labelled")).select("doc_id", "text", "toxic")
    return rows if few else stored(rows)


def keep_clean(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows whose text is not predicted toxic, judged row by row where they lie: no shuffle."""
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(sent.value)
        for batch in slices(batches):
            clean = [judge.score(judge.evidence(t)) < THRESHOLD for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
