"""Fuzzy line dedup by MinHash over character shingles, with DataFrame functions only.

Equal lines are one line from the start. A line's shingles are all its runs of nine characters; the
signature holds, for each of 16 masks, the smallest shingle hash under that mask. The masks are the
points of the plane of order four and the bands are lines of it, four masks each, so two bands share
one mask at most. Lines that agree on a band are candidates. A sketch of 1,024 bits rules out pairs and loses
none: a bit is the parity of some shingles, so bits differ in as many places as shingles at most. What is left is compared by the
exact Jaccard similarity of the shingle sets, and one line of every component of linked lines stays: the
first by document and line number. Each line meets two leaders of its buckets first, then all others that
are still apart.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.binding import let
from ..operators.ordering import join_spread
from .components import connected_components
from .storage import free_names, stored

SHINGLE = 9
SIMILARITY = 0.8


def _times(a: int, b: int) -> int:
    """Product in the field of four elements."""
    carried = (a if b & 1 else 0) ^ (a << 1 if b & 2 else 0)
    return carried ^ 7 if carried & 4 else carried


#: Four of the plane's five classes of parallel lines. At similarity 0.8 a pair shares some band with
#: 0.989, at 0.85 with 0.997, at 0.9 with 0.9995; at 0.1 with 0.0016.
BANDS = [[4 * x + (_times(slope, x) ^ at) for x in range(4)] for slope in range(4) for at in range(4)]
_SALTS = 8
#: Slots that bands are counted in, over a share of the documents, to learn which hold a hot bucket.
#: What is learned here decides how rows are dealt out, never which rows meet.
_SLOTS, _SHARE = 4096, 0.02
_random = random.Random(3)
MASKS = [_random.getrandbits(64) - (1 << 63) for _ in range(16)]
#: Words of 64 bits in a sketch, and shingles that one row holds while a line is signed.
_WORDS, _STRIDE = 16, 4


def lines_of(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, line, d1, d2)``: every line that is not blank; d1 and d2 are its digest."""
    lines = docs.where("doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(F.col("line").rlike(r"\S")).select(
        "doc_id", "line_no", "line", F.xxhash64("line").alias("d1"), _digest(F.col("line")).alias("d2")
    )


def _digest(line: Column) -> Column:
    """The second half of a line's digest."""
    return F.xxhash64(F.lit(1), line)


def _wide(line: Column) -> Column:
    """Two bytes for every UTF-16 unit, so that a shingle is a slice at a known place."""
    return F.encode(line, "UTF-16BE")


def _last(wide: Column) -> Column:
    """Number of the last shingle; a line shorter than a shingle is one."""
    return F.greatest(F.shiftright(F.length(wide), 1) - SHINGLE, F.lit(0))


def _shingle(wide: Column, at: Column) -> Column:
    return F.xxhash64(F.substring(wide, F.shiftleft(at, 1) + 1, F.lit(2 * SHINGLE)))


def signatures(lines: DataFrame) -> DataFrame:
    """``(d1, line)``, repeated or not → ``(d1, m0 … m15)``, over all shingles.

    Lines are signed where they are read, so the texts are not shuffled.
    """
    wide = lines.select("d1", _wide(F.col("line")).alias("wide"))
    last, at = _last(F.col("wide")), F.col("at")
    steps = wide.select("d1", "wide", last.alias("last"), F.explode(F.sequence(F.lit(0), last, F.lit(_STRIDE))).alias("at"))
    # The last shingle is repeated to fill its row.
    hashes = steps.select("d1", *[_shingle(F.col("wide"), F.least(at + k, "last")).alias(f"h{k}") for k in range(_STRIDE)])
    low = lambda k, mask: F.shiftright(F.col(f"h{k}").bitwiseXOR(F.lit(mask)), 32).cast("int")
    least = [F.min(F.least(*[low(k, mask) for k in range(_STRIDE)])) for mask in MASKS]
    return hashes.groupBy("d1").agg(*[m.alias(f"m{i}") for i, m in enumerate(least)])


def counted(lines: DataFrame) -> DataFrame:
    """``(d1, line)`` → ``(d1, line, shingles, n)``, hashes of the different shingles and their number."""
    sets = lines.withColumn("shingles", F.array_distinct(_cut("line", F.xxhash64)))
    return sets.withColumn("n", F.size("shingles"))


def sketches(texts: DataFrame) -> DataFrame:
    """``counted`` lines → ``(d1, sketch)``: parities of the shingles by hash, and ``room``, their number.

    Lines that share a digest share a sketch, whose room is so wide that it rules nothing out.
    """
    d2, at = _digest(F.col("line")).alias("d2"), F.col("at")
    steps = texts.select("d1", d2, "n", "shingles", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(_STRIDE))).alias("at"))
    shingles = [F.get("shingles", at + k) for k in range(_STRIDE)]
    rows = steps.select("d1", "d2", "n", *[held.alias(f"h{k}") for k, held in enumerate(shingles)])
    bits = [F.expr(f"shiftleft(1L, cast(shiftright(h{k}, 8) & 63 as int))") for k in range(_STRIDE)]
    words = []
    for word in range(_WORDS):
        mine = [F.when(F.col(f"h{k}").bitwiseAND(_WORDS - 1) == word, bit).otherwise(F.lit(0).cast("bigint")) for k, bit in enumerate(bits)]
        words.append(F.bit_xor(reduce(Column.bitwiseXOR, mine)).alias(f"w{word}"))
    several = F.when(F.min("d2") != F.max("d2"), _BOUND * 64 * _WORDS).otherwise(0)
    return rows.groupBy("d1").agg((F.max("n") + several).alias("room"), *words).select(
        "d1", F.struct("room", *[f"w{word}" for word in range(_WORDS)]).alias("sketch")
    )


#: Sets of a and b shingles with a similarity of 0.8 differ in at most (a + b) / 9 of them.
_BOUND = 9


def _may_link(a: str, b: str) -> Column:
    """Whether the sets of two lines may be similar enough by their sketches; false rules the pair out."""
    a, b = F.col(a), F.col(b)
    differ = sum((F.bit_count(a[f"w{word}"].bitwiseXOR(b[f"w{word}"])) for word in range(_WORDS)), F.lit(0))
    return _BOUND * differ <= a["room"] + b["room"]


def _banded(signed: DataFrame) -> DataFrame:
    """``(d1, band)``: a line with the key of each of its bands."""
    keys = [F.xxhash64(F.lit(b), *[f"m{m}" for m in masks]) for b, masks in enumerate(BANDS)]
    return signed.select("d1", F.explode(F.array(*keys)).alias("band"))


def _slot() -> Column:
    return F.col("band").bitwiseAND(_SLOTS - 1)


def hot_slots(lines: DataFrame) -> list[int]:
    """Slots with more than twice the mean of these lines' bands; at most half of the slots."""
    counts = _banded(signatures(lines)).groupBy(_slot().alias("slot")).count().collect()
    mean = sum(r["count"] for r in counts) / _SLOTS
    return [r["slot"] for r in counts if r["count"] > 2 * mean + 100]


def buckets(signed: DataFrame, hot: list[int]) -> DataFrame:
    """``(d1, band, x, y, n)``: a line in each band bucket it shares, the bucket's leaders and size.

    A key mixes the order of its lines, so the buckets that two lines may share have leaders of their
    own. Most rows meet by one shuffle on the band; rows of hot slots are dealt out by salt.
    """
    banded = _banded(signed)
    if not hot:
        return _met(banded)
    within = _slot().isin(hot)
    return _met(banded.where(~within)).unionByName(_met_by_salt(banded.where(within)))


def _ends(banded: DataFrame, *by: str) -> DataFrame:
    mixed = F.col("d1").bitwiseXOR(F.col("band"))
    return banded.groupBy(*by).agg(F.min(mixed).alias("x"), F.max(mixed).alias("y"), F.count("*").alias("n"))


def _leaders(met: DataFrame) -> DataFrame:
    return met.select("d1", "band", *[F.col(side).bitwiseXOR(F.col("band")).alias(side) for side in ("x", "y")], "n")


def _met(banded: DataFrame) -> DataFrame:
    """The buckets with one shuffle for the leaders and for the join that hands them out."""
    dealt = banded.repartition("band")
    return _leaders(dealt.join(_ends(dealt, "band").where("x < y"), "band"))


def _met_by_salt(banded: DataFrame) -> DataFrame:
    """The same with a bucket's rows in several tasks, whose leaders are found in two steps."""
    dealt = banded.withColumn("salt", _salt()).repartition("band", "salt")
    ends = _ends(dealt, "band", "salt").groupBy("band").agg(F.min("x").alias("x"), F.max("y").alias("y"), F.sum("n").alias("n"))
    return _leaders(dealt.join(ends.where("x < y").withColumn("salt", _salts()), ["band", "salt"]))


def _salt() -> Column:
    return F.col("d1").bitwiseAND(_SALTS - 1)


def _salts() -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(_SALTS - 1).cast("bigint")))


def leader_pairs(met: DataFrame, known: DataFrame) -> DataFrame:
    """``(a, b)``, first digests, a < b: every line with the leaders of its buckets that it may be similar to."""
    pairs = met.select("d1", F.explode(F.array("x", "y")).alias("other")).where("d1 <> other")
    pairs = pairs.select(F.least("d1", "other").alias("a"), F.greatest("d1", "other").alias("b")).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(known.select(F.col("d1").alias(side), F.col("sketch").alias(f"{side}_sketch")), side)
    return pairs.where(_may_link("a_sketch", "b_sketch")).select("a", "b")


def rest_pairs(met: DataFrame, roots: DataFrame, known: DataFrame) -> DataFrame:
    """``(a, b)``, a < b: the lines that share a bucket, may be similar and are not one component yet.

    Leaders have met their whole bucket. Pairs within a component change nothing, so a bucket of
    copies gives none, whatever its size; of other lines only those that may be similar become rows.
    """
    rest = met.where("n > 3 and d1 <> x and d1 <> y").select("band", "d1")
    named = roots.select(F.col("node.d1").alias("d1"), "root")
    alone = F.struct("d1", F.lit(0).cast("bigint").alias("d2"))
    rest = stored(rest.join(named, "d1", "left").select("band", "d1", F.coalesce("root", alone).alias("root")))
    mixed = rest.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
    # Sketches are wide: only lines of buckets that are still apart take theirs along.
    rest = rest.join(mixed, "band", "left_semi").join(known, "d1")
    one, other = (
        rest.select("band", F.col("d1").alias(side), F.col("sketch").alias(f"{side}_sketch"), F.col("root").alias(f"{side}_root"), salt.alias("salt"))
        for side, salt in (("a", _salt()), ("b", _salts()))
    )
    apart = (F.col("a") < F.col("b")) & (F.col("a_root") != F.col("b_root")) & _may_link("a_sketch", "b_sketch")
    return one.join(other, ["band", "salt"]).where(apart).select("a", "b").distinct()


def _cut(line: str, of: Callable[[Column], Column]) -> Column:
    """``of`` each shingle by signs, repeated or not; a line shorter than a shingle is one.

    Four bytes a sign: a shingle is a slice at a known place.
    """
    def cut(codes: Column) -> Column:
        last = F.greatest(F.shiftright(F.length(codes), 2) - SHINGLE, F.lit(0))
        shingle = lambda at: F.substring(codes, F.shiftleft(at, 2) + 1, F.lit(4 * SHINGLE))
        return F.transform(F.sequence(F.lit(0), last), lambda at: of(shingle(at)))

    return let(F.encode(line, "UTF-32"), cut)


def similar(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(a, b)``, structs of digests: those of the pairs whose shingle sets are similar enough.

    ``texts``: ``(d1, line)``.
    """
    for side in ("a", "b"):
        named = texts.select(F.col("d1").alias(side), _digest(F.col("line")).alias(f"{side}2"), F.col("line").alias(f"{side}_line"))
        pairs = pairs.join(named, side)
    # Slices as text, which the set functions hash; bytes they compare one by one.
    a, b = (F.array_distinct(_cut(f"{side}_line", lambda x: x.cast("string"))) for side in ("a", "b"))
    # Exploded, the sets stay behind the join; as plain expressions they would become part of its
    # condition, which builds them again for each of its terms.
    sets = pairs.select("a", "a2", "b", "b2", F.explode(F.array(F.struct(a.alias("a"), b.alias("b")))).alias("of"))
    sized = sets.select(
        "a", "a2", "b", "b2", F.size(F.array_intersect("of.a", "of.b")).alias("both"), (F.size("of.a") + F.size("of.b")).alias("sum")
    )
    return sized.where(F.col("both") >= SIMILARITY * (F.col("sum") - F.col("both"))).select(
        F.struct(F.col("a").alias("d1"), F.col("a2").alias("d2")).alias("a"),
        F.struct(F.col("b").alias("d1"), F.col("b2").alias("d2")).alias("b"),
    )


def _distinct(lines: DataFrame) -> DataFrame:
    """``(d1, line)``; lines that share the first digest are told apart by the line itself."""
    return lines.groupBy("d1").agg(F.collect_set("line").alias("same")).select("d1", F.explode("same").alias("line"))


def components(lines: DataFrame, share: DataFrame) -> DataFrame:
    """``(node, root)``, structs of digests: the components of all similar lines that share a bucket.

    Leaders link most of a bucket; what they leave apart is then compared in full. Texts are fetched
    for the lines that share a bucket only. ``share``: lines that show which buckets are hot.
    """
    met = stored(buckets(signatures(lines), hot_slots(share)))
    texts = stored(_distinct(lines.select("d1", "line").join(met.select("d1").distinct(), "d1", "left_semi")))
    known = stored(sketches(counted(texts)))
    roots = connected_components(similar(texts, stored(leader_pairs(met, known))))
    pairs = stored(rest_pairs(met, roots, known))
    if pairs.isEmpty():
        return roots
    found = similar(texts, pairs)
    return connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` → ``(doc_id, line_no, first_doc_id, first_line_no, kept)``, a row per line.

    Lines are parted at line feeds and counted from 0; the first line of a component by
    (doc_id, line_no) names it and is kept. Blank lines belong to no component and give no row, nor
    do null and empty texts and rows with a null doc_id. Lines shorter than a shingle are one
    shingle, so only equal ones link; long lines are signed and compared whole. An empty table gives no
    rows. Of lines that repeat, ties in (doc_id, line_no) are one place. Rows that share a doc_id are one document: a place that occurs
    in several of them shares one decision. Other columns are ignored.
    """
    lines = lines_of(docs)
    roots = components(lines, lines_of(docs.sample(_SHARE, 7))).select("node.d1", "node.d2", "root")
    seen = lines.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "line_no")).alias("first"))
    # Only lines that occur twice or have a link need a word about their component.
    own = F.struct("d1", "d2")
    named = seen.join(roots, ["d1", "d2"], "left").where("n > 1 or root is not null").withColumn("root", F.coalesce("root", own))
    named = stored(named.select("d1", "d2", "root", "first"))
    heads = named.groupBy("root").agg(F.min("first").alias("head"))
    told = stored(join_spread(named, heads, ["root"], ["d1"]).select("d1", "d2", "head"))
    here = F.struct("doc_id", "line_no")
    head = F.coalesce("head", here)
    return lines.drop("line").join(told, ["d1", "d2"], "left").select(
        "doc_id", "line_no", head["doc_id"].alias("first_doc_id"), head["line_no"].alias("first_line_no"),
        (head == here).alias("kept"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents less the lines that are not kept; every document stays, if only as an empty text.

    ``n_chars``, where there, follows the text of the documents that lost lines. Blank lines stay.
    """
    own_id, gone_at, parts_in, places_of, left = free_names(docs, "_id", "_gone", "_parts", "_places", "_text")
    gone = repeated_lines(docs).where("not kept").groupBy(F.col("doc_id").alias(own_id)).agg(F.collect_set("line_no").alias(gone_at))
    joined = docs.join(gone, F.col("doc_id") == F.col(own_id), "left")
    parts = F.split("text", "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone_at))
    rest = joined.withColumn(parts_in, parts).withColumn(places_of, places).withColumn(
        left, F.array_join(F.transform(places_of, lambda at: F.col(parts_in)[at]), "\n")
    )
    changed = F.col(gone_at).isNotNull()
    new = {"text": F.when(changed, F.col(left)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(changed, F.length(left).cast(kind)).otherwise(F.col("n_chars"))
    return rest.withColumns(new).select(*docs.columns)
