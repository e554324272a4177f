"""Phrase search with prefix matching and BM25 ranking over a token table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions.text import query_terms, token_count, tokenize
from ..session import cut_lineage


def media_tokens(media: DataFrame) -> DataFrame:
    """``(id, length, field, position, token)`` of caption and file name, no shuffle.

    ``length`` repeats the row's token count (it compresses to nothing), so ranking needs no join.
    """
    split = media.select(
        "id", tokenize(F.col("caption")).alias("c"), tokenize(F.col("file_name")).alias("n")
    )
    fields = F.array(
        F.struct(F.lit("caption").alias("field"), F.col("c").alias("tokens")),
        F.struct(F.lit("file_name").alias("field"), F.col("n").alias("tokens")),
    )
    length = (F.size("c") + F.size("n")).alias("length")
    return (
        split.select("id", length, F.explode(fields).alias("f"))
        .select("id", "length", "f.field", F.posexplode("f.tokens").alias("position", "token"))
    )


def media_lengths(media: DataFrame) -> DataFrame:
    """Tokens per row over both fields; a row without tokens counts with 0."""
    return media.select(
        "id",
        (token_count(F.col("caption")) + token_count(F.col("file_name"))).alias("length"),
    )


def phrase_hits(tokens: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """``(id, length, phrase, hits)``: how often each phrase occurs in a row.

    The token predicate is a plain equality or prefix test, so it is pushed to the scan of a
    token-sorted table. A phrase of several tokens lines them up by start position and shuffles its
    matching tokens; one token is a hit by itself, so a row's hits are added up before the shuffle.
    """
    token, at = F.col("token"), F.col("position")
    wanted, needed = [], []
    for number, phrase in enumerate(phrases):
        for offset, word in enumerate(phrase):
            last = offset == len(phrase) - 1
            test = token.startswith(word) if last else token == word
            wanted.append((test, number, offset))
        needed.append(len(phrase))
    candidates = F.filter(
        F.array(*[
            F.when(test, F.struct(F.lit(n).alias("phrase"), F.lit(o).alias("offset")))
            for test, n, o in wanted
        ]),
        lambda c: c.isNotNull(),
    )
    matching = tokens.where(reduce(Column.__or__, [test for test, _, _ in wanted]))
    hits = matching.select("id", "length", "field", at, F.explode(candidates).alias("c")).select(
        "id", "length", "field", F.col("c.phrase").alias("phrase"),
        (at - F.col("c.offset")).alias("start"),
    )
    if max(needed) == 1:
        return hits.groupBy("id", "length", "phrase").agg(F.count("*").alias("hits"))
    lengths = F.element_at(F.array(*[F.lit(n) for n in needed]), F.col("phrase") + 1)
    single = lengths == 1
    lined = hits.select(
        "id", "length", "phrase", F.when(~single, F.col("field")).alias("field"), F.when(~single, F.col("start")).alias("start")
    ).groupBy("id", "length", "phrase", "field", "start").agg(F.count("*").alias("seen"))
    # A start is an occurrence when all of its tokens are there.
    found = F.when(single, F.col("seen")).when(F.col("seen") == lengths, 1)
    return lined.groupBy("id", "length", "phrase").agg(F.sum(found).alias("hits")).where("hits > 0")


def search(tokens: DataFrame, lengths: DataFrame, query: str) -> DataFrame:
    """``(id, score)`` of the rows matching every term; the lowest score is the best.

    Terms are matched by prefix and ANDed over both fields, repeated terms count twice, and a
    query without any token finds nothing.
    """
    phrases = query_terms(query)
    if not phrases:
        return tokens.sparkSession.createDataFrame([], "id string, score double")
    distinct = [list(p) for p in dict.fromkeys(tuple(p) for p in phrases)]
    weights = [sum(1 for p in phrases if p == d) for d in distinct]
    numbers = range(len(distinct))
    # One narrow row per matching item, read for the phrase statistics and for the scores.
    rows = cut_lineage(phrase_hits(tokens, distinct).groupBy("id", "length").agg(*[
        F.sum(F.when(F.col("phrase") == n, F.col("hits")).otherwise(0)).alias(f"f{n}")
        for n in numbers
    ]))
    # Scalar subqueries: corpus size and mean length, and how many rows hold each phrase.
    corpus = lengths.agg(F.struct(
        F.count("*").alias("rows"), F.avg("length").alias("mean_length")
    )).scalar()
    spread = rows.agg(F.struct(*[F.count_if(F.col(f"f{n}") > 0).alias(f"n{n}") for n in numbers])).scalar()
    every = reduce(Column.__and__, [F.col(f"f{n}") > 0 for n in numbers])
    scored = rows.where(every)
    k1, b = fv.BM25_K1, fv.BM25_B
    total = F.lit(0.0)
    for n, weight in enumerate(weights):
        holders = spread[f"n{n}"]
        idf = F.log((corpus["rows"] - holders + 0.5) / (holders + 0.5))
        idf = F.when(idf <= 0, fv.BM25_IDF_FLOOR).otherwise(idf)
        f = F.col(f"f{n}")
        damp = k1 * (1 - b + b * F.col("length") / corpus["mean_length"])
        total = total + weight * idf * (f * (k1 + 1)) / (f + damp)
    return scored.select("id", (-total).alias("score"))


def search_ids(tokens: DataFrame, lengths: DataFrame, query: str) -> DataFrame:
    """Ids best first; equal scores by id."""
    return search(tokens, lengths, query).orderBy("score", "id")
