"""Benchmark decontamination by template windows and slot consistency.

Numbers, units and names become typed placeholders, so a question whose values were changed keeps
its template. Template windows of five words are hash-joined with those of the benchmark. Where
the template has slots, the values are aligned: a passage counts only if each value of the item
stands for one value of the document, as a re-parameterised question does and chance does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .storage import free_names, small, stored

WINDOW = 5
#: Share of an item's windows that a document must hold.
COVERAGE = 0.8
#: Benchmark windows that are broadcast; a larger benchmark is joined by a shuffle.
BROADCAST_WINDOWS = 2_000_000
#: Units that may follow a number.
UNITS = (
    "km|m|cm|mm|mi|miles?|ft|feet|inch(?:es)?|yards?|kg|g|mg|lbs?|pounds?|ounces?|tons?|l|ml|liters?|litres?|gallons?|"
    "s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|mph|kmh|percent|dollars?|cents?|euros?|degrees?"
)
_NUMBER, _UNIT, _NAME = "#n", "#u", "#p"


def template(text: Column) -> Column:
    """Words of the text; a slot is ``#kind=value``, the rest is lower-cased letters.

    A name is a capitalised word behind a lower-case word, a number or a comma, so the first word of
    a sentence is none.
    """
    # Each pattern begins with what it consumes: a look behind is tried only at such signs.
    named = F.regexp_replace(text, r"\p{Lu}(?<=[\p{Ll}\p{N},;]\s\p{Lu})[\p{L}\p{N}]*", f"{_NAME}=$0")
    numbered = F.regexp_replace(named, r"\p{N}(?<![\p{L}\p{N}]\p{N})(?:[.,:/]?\p{N})*", f"{_NUMBER}=$0 ")
    united = F.regexp_replace(F.lower(numbered), rf"({_NUMBER}=\S+\s{{1,3}})({UNITS})(?![\p{{L}}\p{{N}}])", f"$1{_UNIT}=$2")
    # Signs go, but for those inside a number and the marks of the slots.
    plain = F.regexp_replace(united, r"[^\p{L}\p{N}\s#=.,:/]+|[.,:/]+(?!\p{N})", "")
    return F.filter(F.split(plain, r"\s+"), lambda w: w != "")


def kinds(words: Column) -> Column:
    """The template proper: slots without their values."""
    return F.transform(words, lambda w: F.when(w.startswith("#"), F.substring(w, 1, 2)).otherwise(w))


def windows(words: Column) -> Column:
    """Hashes of all runs of five words, in order; fewer words give one hash of them all."""
    count = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(count - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(count > 0, runs).otherwise(F.array().cast("array<bigint>"))


def _placed(rows: DataFrame, key: str, at: str) -> DataFrame:
    """``(key, at, hash)`` of every template window; ``_words`` is computed once."""
    return rows.select(key, F.posexplode(windows(F.col("_kinds"))).alias(at, "hash"))


def _templated(rows: DataFrame, key: str, text: str) -> DataFrame:
    words = rows.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, template(F.col(text)).alias("_words"))
    return words.select(key, "_words", kinds(F.col("_words")).alias("_kinds"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, text)``, ``(item_id, text)`` → ``(doc_id, item_id, windows, coverage)``.

    One row per document and item whose windows it holds to 0.8 or more, over consistent passages.
    Texts of fewer than five words count as one window. Null and empty texts, null ids and empty
    tables give no row. Rows that share an id are one document or item; repeated items
    each count. Other columns are ignored. The whole text is read, however long.
    """
    items = benchmark.select(F.col("item_id").alias("item_id"), F.col("text").alias("_item"))
    items = stored(_templated(items, "item_id", "_item").where(F.size("_words") > 0))
    placed_items = stored(_placed(items, "item_id", "item_at"))
    total = placed_items.groupBy("item_id").agg(F.countDistinct("hash").alias("total"))
    known, _ = small(placed_items.select("hash").distinct(), BROADCAST_WINDOWS)
    texts = docs.select("doc_id", F.col("text").alias("_text"))
    # Only windows that the benchmark holds leave the scan.
    hits = stored(_placed(_templated(texts, "doc_id", "_text"), "doc_id", "at").join(known, "hash", "left_semi"))
    pairs = hits.join(placed_items, "hash").select("doc_id", "item_id", "hash", "at", "item_at")
    # First by template alone; what follows is done for the few that pass.
    likely = pairs.groupBy("doc_id", "item_id").agg(F.countDistinct("hash").alias("n")).join(total, "item_id").where(
        F.col("n") >= COVERAGE * F.col("total")
    ).select("doc_id", "item_id", "total")
    likely = stored(likely)
    passages = pairs.join(likely, ["doc_id", "item_id"]).withColumn("shift", F.col("at") - F.col("item_at"))
    # The slots of the items, met by the words at the same place of the passage.
    slots = items.select("item_id", F.posexplode("_words").alias("slot_at", "value")).where(F.col("value").startswith("#"))
    slotted = likely.join(slots, "item_id").select("doc_id", "item_id", "slot_at", "value")
    spans = passages.select("doc_id", "item_id", "shift").distinct()
    wanted = spans.join(slotted, ["doc_id", "item_id"]).withColumn("word_at", F.col("shift") + F.col("slot_at"))
    marked = likely.select(F.col("doc_id").alias("_id")).distinct()
    words = _templated(texts.join(marked, F.col("doc_id") == F.col("_id"), "left_semi"), "doc_id", "_text").select(
        "doc_id", F.posexplode("_words").alias("word_at", "found")
    ).where(F.col("found").startswith("#"))
    values = wanted.join(words, ["doc_id", "word_at"]).where(F.substring("value", 1, 2) == F.substring("found", 1, 2))
    mixed = values.groupBy("doc_id", "item_id", "shift", "value").agg(F.countDistinct("found").alias("n")).where("n > 1").select(
        "doc_id", "item_id", "shift"
    ).distinct()
    sound = passages.join(mixed, ["doc_id", "item_id", "shift"], "left_anti")
    return sound.groupBy("doc_id", "item_id", "total").agg(F.countDistinct("hash").alias("windows")).where(
        F.col("windows") >= COVERAGE * F.col("total")
    ).select("doc_id", "item_id", "windows", (F.col("windows") / F.col("total")).alias("coverage"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leaked item; rows with a null doc_id can't be named and stay."""
    (name,) = free_names(docs, "_gone")
    gone = leaks(docs, benchmark).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(stored(gone), F.col("doc_id") == F.col(name), "left_anti")
