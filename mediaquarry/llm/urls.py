"""URL filters: rules first, then naive Bayes over the words of the host and the path.

Host labels are split into words by a unigram Viterbi search; word counts come from the visible
text of all pages. Urls that a rule decides are the learning rows of a multinomial naive Bayes over
hashed host and path tokens, which judges the others.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import ship_package

#: (host/path, verdict); the longest that fits wins, block before allow at equal length.
Rules = list[tuple[str, str]]
#: Bound of the words sent to the tasks, most frequent first.
WORDS = 50_000
LONGEST_WORD = 24
#: Hashed token features of the classifier.
FEATURES = 1 << 18
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Rules) -> tuple[Column, Column]:
    """(rule, verdict), both null where no rule fits."""
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[1] != "block", r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def word_counts(pages: DataFrame) -> tuple[dict[str, int], int]:
    """Counts of the most frequent a-z words in the pages' visible text, and of all words."""
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<[^>]*>|&[a-z]+;", " ")
    words = pages.where("html is not null").select(F.explode(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1)).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    top = counts.where(F.length("word") <= LONGEST_WORD).orderBy(F.desc("n"), "word").limit(WORDS).collect()
    return {r["word"]: r["n"] for r in top}, int(total)


class Segmenter:
    """Best split of a name into words; a word outside the counts pays tenfold for each letter."""

    def __init__(self, counts: dict[str, int], total: int):
        total = max(total, 1)
        self.cost = {w: -math.log10(n / total) for w, n in counts.items()}
        self.unknown = math.log10(total) + 1
        self.store: dict[str, list[str]] = {}

    def split(self, name: str) -> list[str]:
        if name not in self.store:
            best = [(0.0, 0)]
            for end in range(1, len(name) + 1):
                best.append(min(
                    (best[at][0] + self.cost.get(name[at:end], self.unknown + (end - at)), at)
                    for at in range(max(0, end - LONGEST_WORD), end)
                ))
            words, end = [], len(name)
            while end:
                words.append(name[best[end][1] : end])
                end = best[end][1]
            if len(self.store) > 100_000:
                self.store.clear()
            self.store[name] = words[::-1]
        return self.store[name]

    def tokens(self, host: str, path: str) -> list[str]:
        found = [f"h:{w}" for label in re.findall(r"[^\W\d_]+", host) for w in self.split(label)]
        return found + [f"p:{'#' if t.isdigit() else t}" for t in re.findall(r"[^\W_]+", path.lower())]


def tokens(urls: DataFrame, segmenter: Segmenter) -> DataFrame:
    """Adds ``tokens`` to ``(page_id, host, path, rule, ruled)``."""
    ship_package(urls.sparkSession)
    sent = urls.sparkSession.sparkContext.broadcast(segmenter)
    names = [*urls.columns, "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = sent.value
        for batch in batches:
            pairs = zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            yield pa.record_batch([*batch.columns, pa.array([splitter.tokens(h, p) for h, p in pairs], pa.list_(pa.string()))], names)

    return urls.mapInArrow(run, urls.withColumn("tokens", F.array().cast("array<string>")).schema)


def judge(pages: DataFrame, rules: Rules) -> DataFrame:
    """``(page_id, url, html)`` → ``(page_id, host, path, rule, verdict, score, tokens)``.

    ``score`` is the probability of block by the classifier; it decides where no rule fits, block
    from one half. A null url or one without ``://`` has an empty host and path and gets the share
    of block among the rows that rules decided; so does every url when nothing was learned.
    Repeated rows are judged one by one; other columns are ignored. A null html only teaches no words.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, ruled = rule_for(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": rule, "ruled": ruled})
    seen = tokens(urls, Segmenter(*word_counts(pages)))
    learned = seen.where("ruled is not null")
    totals = {r["ruled"]: r["n"] for r in learned.groupBy("ruled").agg(F.count("*").alias("n")).collect()}
    feature = F.pmod(F.xxhash64("token"), F.lit(FEATURES))
    counts = learned.select("ruled", F.explode("tokens").alias("token")).groupBy(feature.alias("f"), "ruled").agg(F.count("*").alias("n"))
    table = np.zeros((2, FEATURES))
    for row in counts.collect():  # at most two rows per feature
        table[int(row["ruled"] == "block"), row["f"]] += row["n"]
    rates = (table + 0.1) / (table + 0.1).sum(axis=1, keepdims=True)
    odds = np.log(rates[1]) - np.log(rates[0])
    prior = math.log((totals.get("block", 0) + 1) / (totals.get("allow", 0) + 1))
    sent = pages.sparkSession.sparkContext.broadcast(odds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        for batch in batches:
            score = [1 / (1 + math.exp(-max(-500.0, min(500.0, prior + weights[np.asarray(f, int)].sum())))) for f in batch.column("f").to_pylist()]
            yield pa.record_batch([*batch.columns[:-1], pa.array(score, pa.float64())], [*batch.schema.names[:-1], "score"])

    hashed = seen.withColumn("f", F.transform("tokens", lambda t: F.pmod(F.xxhash64(t), F.lit(FEATURES))))
    scored = hashed.mapInArrow(run, hashed.drop("f").withColumn("score", F.lit(0.0)).schema)
    by_method = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_method).alias("verdict"), "score", "tokens")
