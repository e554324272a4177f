"""The registered queries of the training-text operators and the SQL some of them must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .storage import remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op9_bpe_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    from . import bpe

    return bpe_digests(bpe.round_trip(table(spark, folder, "documents"), tokenizer_file()))


def bpe_digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    from . import simhash

    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op2_embedding_neardup(spark: SparkSession, folder: str) -> DataFrame:
    from . import embeddings

    return embeddings.near_duplicates(table(spark, folder, "embeddings"))


def held_out(divisor: int, rest: int):
    return F.coalesce(remainder(F.col("doc_id"), divisor) == rest, F.lit(False)).alias("held_out")


@query
def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from . import langid

    docs = table(spark, folder, "documents")
    model = langid.fit(docs.where(~held_out(5, 0)))
    return langid.identify(docs, model).withColumn("held_out", held_out(5, 0))


@query
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, folder, "documents")
    rows = toxicity.learning_rows(docs, table(spark, folder, "labels")).where(~held_out(4, 2))
    return toxicity.score(docs, toxicity.fit(rows)).withColumn("held_out", held_out(4, 2))


#: The rules of the query.
RULES = [
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"),
    ("net/fr/", "block"),
]


@query
def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    from . import urls

    return urls.judge(table(spark, folder, "pages"), RULES)


@query
def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from . import chunks

    return chunks.repeated_spans(table(spark, folder, "documents"))


@query
def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from . import decontaminate

    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from . import lines

    return lines.repeated_lines(table(spark, folder, "documents"))


@query
def op4_brown_lm(spark: SparkSession, folder: str) -> DataFrame:
    from . import brown

    docs = table(spark, folder, "documents")
    model, counts = brown.fit(docs.where(~held_out(7, 2)))
    return brown.score(docs, model, counts).withColumn("held_out", held_out(7, 2))


@query
def op11_phrase_mining(spark: SparkSession, folder: str) -> DataFrame:
    from . import phrases

    return phrases.collocations(table(spark, folder, "documents"))


#: The words of the phrase query with their piece and place, per language.
_LANG_WORDS = r"""
    docs AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    pieces AS (SELECT lang, d, generate_subscripts(p, 1) AS piece, unnest(p) AS part
               FROM (SELECT lang, d, string_split_regex(t, '[.,;:!?\x0A-\x0D]') AS p FROM docs)),
    placed AS (SELECT lang, d, piece, generate_subscripts(w, 1) AS place, unnest(w) AS w1
               FROM (SELECT lang, d, piece, regexp_extract_all(part, '[^\x20\x09]+') AS w FROM pieces)),
    runs AS (SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM placed
             WINDOW o AS (PARTITION BY d, piece ORDER BY place))"""

ORACLES["op11_phrase_mining"] = f"""
WITH {_LANG_WORDS},
    counts AS (
        SELECT lang, w1 AS phrase, 1 AS size, count(*)::HUGEINT AS f FROM runs GROUP BY ALL
        UNION ALL SELECT lang, w1 || ' ' || w2, 2, count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY ALL
        UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, 3, count(*) FROM runs WHERE w3 IS NOT NULL GROUP BY ALL),
    totals AS (SELECT lang, sum(f) AS n FROM counts WHERE size = 1 GROUP BY lang),
    cands AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND f >= 10),
    cuts AS (SELECT lang, phrase, size, f AS a, k, array_to_string(w[:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y
             FROM cands, (SELECT unnest([1, 2]) AS k) WHERE k < size),
    valued AS (SELECT c.lang, c.phrase, c.size, c.a, c.k, l.f AS l, r.f AS r, (1000000::HUGEINT * c.a * c.a) // (l.f * r.f) AS score
               FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.x JOIN counts r ON r.lang = c.lang AND r.phrase = c.y),
    lowest AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    kept AS (SELECT * FROM lowest s WHERE NOT EXISTS (
        SELECT 1 FROM cands c WHERE c.size = 3 AND s.size = 2 AND c.lang = s.lang AND 100 * c.f >= 50 * s.a
        AND (array_to_string(c.w[:2], ' ') = s.phrase OR array_to_string(c.w[2:], ' ') = s.phrase))),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query
def op12_piece_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    from . import pieces

    return bpe_digests(pieces.round_trip(table(spark, folder, "documents"), tokenizer_file("piece_bpe_32k.model")))


@query
def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    from . import importance

    return importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


#: Words of a text column, and the CRC-32 of a word by its table of 256 remainders.
_FEATURES = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op13_importance_resampling"] = f"""
WITH RECURSIVE rests(i, k, v) AS (
        SELECT i, 0, i FROM range(256) t(i) UNION ALL
        SELECT i, k + 1, xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END) FROM rests WHERE k < 8),
    crc AS (SELECT list(v ORDER BY i) AS rest FROM rests WHERE k = 8),
    source AS (SELECT doc_id, {_FEATURES} AS f FROM documents),
    aim AS (SELECT {_FEATURES} AS f FROM benchmark),
    words AS (SELECT DISTINCT w FROM (SELECT unnest(f) AS w FROM source UNION ALL SELECT unnest(f) FROM aim)),
    digits AS (SELECT w, hex(encode(w)) AS h FROM words),
    hashed AS (SELECT w, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(h) // 2),
                   lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
                   lambda c, b: xor(c >> 8, rest[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket FROM digits, crc),
    s AS (SELECT bucket, count(*) AS s FROM (SELECT unnest(f) AS w FROM source) JOIN hashed USING (w) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(f) AS w FROM aim) JOIN hashed USING (w) GROUP BY bucket),
    sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS ss, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS tt),
    gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (ss + 10000) / ((s + 1.0::DOUBLE) * (tt + 10000))))::BIGINT AS g
             FROM s LEFT JOIN t USING (bucket), sums),
    summed AS (SELECT doc_id, sum(g)::BIGINT AS g FROM (SELECT doc_id, unnest(f) AS w FROM source) JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
    weighed AS (SELECT doc_id, len(f)::BIGINT AS n_features, CASE WHEN len(f) = 0 THEN 0 ELSE floor(g / len(f)) END::BIGINT AS weight
                FROM source LEFT JOIN summed USING (doc_id)),
    scored AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
               FROM weighed),
    placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 10 * count(*) OVER () // 100 AS drawn
               FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END::BIGINT AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""
