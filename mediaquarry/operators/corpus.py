"""Line, language and comment counts over a corpus of text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed_values as fv
from ..sources.listing import read_files, scan_listing

_SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"



def supported_path(path: Column) -> Column:
    """A relative path that is neither generated, hidden nor in a build folder."""
    name, parts = F.substring_index(path, "/", -1), F.split(path, "/")
    generated = F.lit(False)
    for prefix in fv.EXCLUDED_PREFIXES:
        generated = generated | path.startswith(prefix)
    hidden = name.startswith(".") & ~name.isin(fv.KEPT_DOT_FILES)
    inside = F.arrays_overlap(parts, F.array(*[F.lit(d) for d in fv.EXCLUDED_DIRS]))
    return ~(generated | hidden | inside | F.get(parts, F.lit(0)).isin(fv.EXCLUDED_ROOT_DIRS))


def language_of(path: Column) -> Column:
    """By exact file name, then by suffix; a leading or trailing dot starts no suffix."""
    name = F.substring_index(path, "/", -1)
    lookup = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    tail = F.substring_index(name, ".", -1)
    has_suffix = name.contains(".") & (F.length(tail) > 0) & (F.length(name) > F.length(tail) + 1)
    suffix = F.when(has_suffix, F.concat(F.lit("."), F.lower(tail))).otherwise("")
    return F.coalesce(
        F.try_element_at(lookup(fv.LANGUAGE_BY_NAME), name),
        F.try_element_at(lookup(fv.LANGUAGE_BY_EXTENSION), suffix), F.lit("Other"),
    )


def scan_text_corpus(spark: SparkSession, root: str) -> DataFrame:
    """``(path, text, language)`` of the countable files below ``root``; bad bytes are replaced.

    Names are judged before anything is read; names with a dot or an underscore in front count.
    """
    base = root.rstrip("/")
    relative = F.substring(F.col("path"), F.lit(len(base) + 2), F.length("path"))
    wanted = scan_listing(spark, base).where(supported_path(relative) & (language_of(relative) != "Other"))
    return countable_files(read_files(wanted).where("read_error IS NULL").select(
        relative.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text")
    ))


def countable_files(files: DataFrame) -> DataFrame:
    kept = files.where(supported_path(F.col("path")))
    return kept.withColumn("language", language_of(F.col("path"))).where("language <> 'Other'")


def text_lines(text: Column) -> Column:
    """Lines as universal line ends split them; no empty line after the last break."""
    parts = F.split(text, _BREAK, -1)
    ends_open = F.element_at(parts, -1) == ""
    return F.when(ends_open, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def _count(lines: Column, test) -> Column:
    return F.size(F.filter(lines, test))


def comment_lines(lines: Column, language: Column) -> Column:
    """Comment lines by the language's markers; block state is folded within the one row."""
    bare = lambda line: F.regexp_replace(line, f"^{_SPACE}+", "")
    starred = language.isin(fv.STAR_COMMENT_LANGUAGES)

    def step(state: Column, line: Column) -> Column:
        text = bare(line)
        opens = text.startswith("/*")
        counts = state["inside"] | opens | text.startswith("//") | (starred & text.startswith("*"))
        inside = F.when(state["inside"], ~line.contains("*/")).otherwise(opens & ~text.contains("*/"))
        return F.struct(
            (state["n"] + counts.cast("int")).alias("n"), inside.alias("inside")
        )

    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("inside"))
    block = F.aggregate(lines, start, step)["n"]
    return (
        F.when(language.isin(fv.BLOCK_COMMENT_LANGUAGES), block)
        .when(language.isin(fv.HASH_COMMENT_LANGUAGES), _count(lines, lambda x: bare(x).startswith("#")))
        .when(
            language.isin(fv.MARKUP_COMMENT_LANGUAGES),
            _count(lines, lambda x: bare(x).startswith("#") | bare(x).startswith("<!--")),
        )
        .when(language == "Batch", _count(lines, lambda x: F.upper(bare(x)).startswith("REM")))
        .when(
            language == "SQL",
            _count(lines, lambda x: bare(x).startswith("--") | bare(x).startswith("/*")),
        )
        .otherwise(0)
    )


def file_lines(files: DataFrame) -> DataFrame:
    """``(path, language, lines, blank, comment, code)`` per file: one pass, no shuffle."""
    split = files.select("path", "language", text_lines(F.col("text")).alias("l"))
    counted = split.select(
        "path", "language", F.size("l").alias("lines"),
        _count(F.col("l"), lambda x: x.rlike(f"^{_SPACE}*$")).alias("blank"),
        comment_lines(F.col("l"), F.col("language")).alias("comment"),
    )
    return counted.withColumn(
        "code", F.greatest(F.col("lines") - F.col("blank") - F.col("comment"), F.lit(0))
    )


def corpus_totals(counted: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return counted.agg(F.count("*").alias("files"), *[total(c) for c in ("lines", "code", "blank", "comment")])


def counts_by_group(counted: DataFrame, group: Column, name: str) -> DataFrame:
    return counted.groupBy(group.alias(name)).agg(F.count("*").alias("files")).orderBy(
        F.col("files").desc(), F.col(name)
    )


def top_level(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def largest_files(counted: DataFrame, limit: int = fv.LARGEST_FILES) -> DataFrame:
    return counted.orderBy(F.col("lines").desc(), F.col("path").desc()).limit(limit)
