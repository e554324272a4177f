"""Search tokens, phrase search with ranking, and the text-corpus report."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import query_terms
from ..operators import browse, corpus, projection, search
from ..session import shared_dir
from ..sources import adapters
from . import base_sql as q
from .registry import query

_RUN = "[\\p{L}\\p{N}\\p{Co}][\\p{L}\\p{N}\\p{Co}\\x{0300}-\\x{0331}]*"


def _tokens(text: str) -> str:
    return f"list_transform(regexp_extract_all(lower({text}), '{_RUN}'), lambda w: strip_accents(w))"


_TOKENS = f"""{q.MEDIA}, w AS (SELECT id, {_tokens('caption')} AS c, {_tokens('file_name')} AS n FROM media),
tok AS (SELECT id, 'caption' AS field, unnest(c) AS token, unnest(range(len(c))) AS position FROM w
  UNION ALL SELECT id, 'file_name', unnest(n), unnest(range(len(n))) FROM w),
ln AS (SELECT id, len(c) + len(n) AS length FROM w)"""


@query(f"""WITH {_TOKENS} SELECT token, field, count(*) AS occurrences, count(DISTINCT id) AS rows,
  CAST(sum(position) AS BIGINT) AS positions FROM tok GROUP BY token, field""")
def tokenize(t):
    tokens = search.media_tokens(adapters.media(t))
    per_row = tokens.groupBy("token", "field", "id").agg(F.count("*").alias("n"), F.sum("position").alias("p"))
    return per_row.groupBy("token", "field").agg(
        F.sum("n").alias("occurrences"), F.count("*").alias("rows"), F.sum("p").alias("positions")
    )


@query(f"WITH {_TOKENS} SELECT id, CAST(length AS INTEGER) AS length FROM ln")
def media_lengths(t):
    return search.media_lengths(adapters.media(t))


def _search_sql(text: str) -> str:
    """BM25 of one fixed query restated with self-joins on neighbouring positions."""
    phrases = query_terms(text)
    ctes, score, joins = [], [], []
    for number, phrase in enumerate(phrases):
        last = len(phrase) - 1
        cond = lambda k, alias: (
            f"starts_with({alias}.token, '{phrase[k]}')" if k == last else f"{alias}.token = '{phrase[k]}'"
        )
        chain = "".join(
            f" JOIN tok t{k} ON t{k}.id = t0.id AND t{k}.field = t0.field AND t{k}.position = t0.position + {k} AND {cond(k, f't{k}')}"
            for k in range(1, len(phrase))
        )
        ctes.append(f"h{number} AS (SELECT t0.id, count(*) AS f FROM tok t0{chain} WHERE {cond(0, 't0')} GROUP BY t0.id)")
        idf = f"ln(((SELECT count(*) FROM ln) - (SELECT count(*) FROM h{number}) + 0.5) / ((SELECT count(*) FROM h{number}) + 0.5))"
        idf = f"(CASE WHEN {idf} <= 0 THEN {fv.BM25_IDF_FLOOR} ELSE {idf} END)"
        score.append(
            f"{idf} * (h{number}.f * 2.2) / (h{number}.f + 1.2 * (0.25 + 0.75 * ln.length / (SELECT avg(length) FROM ln)))"
        )
        joins.append(f" JOIN h{number} ON h{number}.id = ln.id")
    return (
        f"WITH {_TOKENS}, {', '.join(ctes)} SELECT ln.id, round(-({' + '.join(score)}), 9) AS score "
        f"FROM ln{''.join(joins)}"
    )


_SEARCHES = {
    "search_terms": "the an", "search_prefix": "thre", "search_phrase": "img_1 the",
    "search_hostile_text": 'AND "the* (of OR:', "search_accents": "cióne",
    "search_repeated_term": "und und der",
}
for _name, _text in _SEARCHES.items():
    def _run(t, text=_text):
        m = adapters.media(t)
        found = search.search(search.media_tokens(m), search.media_lengths(m), text)
        return found.select("id", F.round("score", 9).alias("score"))

    query(_search_sql(_text), _name)(_run)


def _index(t):
    """The projection of ``documents``, written once per session and then searched many times."""
    def build(tables):
        base = f"{shared_dir(tables.spark)}/index-{uuid.uuid4().hex}"
        projection.build_projection(adapters.records(tables), base)
        return projection.open_projection(tables.spark, base)

    return t.plan("search index", build)


@query(_search_sql("the an"))
def search_indexed(t):
    """The same search on stored tokens: only the row groups of its prefixes are read."""
    index = _index(t)
    found = search.search(index["media_token"], index["media_len"], "the an")
    return found.select("id", F.round("score", 9).alias("score"))


@query(_search_sql("img_1 the"))
def search_indexed_phrase(t):
    index = _index(t)
    found = search.search(index["media_token"], index["media_len"], "img_1 the")
    return found.select("id", F.round("score", 9).alias("score"))


@query(f"""WITH {q.MEDIA} SELECT id, capture_sort_key FROM media WHERE kind = 'image' ORDER BY capture_sort_key, id LIMIT 50""")
def capture_page_indexed(t):
    """A page of the stored projection: filter and order columns only."""
    return browse.capture_page(_index(t)["media"].where("kind = 'image'"), 0, 50)


@query("SELECT item_id AS id, CAST(0.0 AS DOUBLE) AS score FROM benchmark WHERE false")
def search_without_tokens(t):
    """A query of separators only finds nothing and raises nothing."""
    rows = t.benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("caption"), F.lit("").alias("file_name"))
    found = search.search(search.media_tokens(rows), search.media_lengths(rows), ' * "" -- ')
    return found.select(F.col("id").cast("bigint").alias("id"), "score")


# --- corpus report ----------------------------------------------------------------------------

_SUFFIXES = [".py", ".cpp", ".css", ".sql", ".bat", ".md", ".json", ".h", ".xyz", ".YML", "", ".ts"]
_MARKERS = ["# ", "// ", "/* ", "-- ", "rem ", "<!-- ", "* ", "  /* x */ ", ""]
_FOLDERS = ["src/", "docs/", "docs/metrics/", "build/", "tests/__pycache__/", "tests/build/", ""]


@adapters.view
def corpus_files(t):
    """``documents`` as a source tree: names, folders and comment markers by number."""
    d = F.col("doc_id")
    pick = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (n % len(words) + 1).cast("int"))
    name = F.when(d % 31 == 30, "Makefile").when(d % 37 == 36, ".gitignore").otherwise(
        F.concat(F.lit("f"), d.cast("string"), pick(_SUFFIXES, d))
    )
    marked = F.replace("text", F.lit(". "), F.concat(F.lit(".\n"), pick(_MARKERS, d)))
    closed = F.when(d % 2 == 0, F.replace(marked, F.lit(", "), F.lit(" */\n"))).otherwise(marked)
    return t.documents.select(F.concat(pick(_FOLDERS, d), name).alias("path"), closed.alias("text"), "doc_id")


def _picked(words: list[str], number: str) -> str:
    listed = ", ".join("'" + w + "'" for w in words)
    return f"([{listed}])[CAST({number} % {len(words)} AS INTEGER) + 1]"


def _language() -> str:
    by_name = " ".join(f"WHEN name = '{k}' THEN '{v}'" for k, v in fv.LANGUAGE_BY_NAME.items())
    by_ext = " ".join(f"WHEN ext = '{k}' THEN '{v}'" for k, v in fv.LANGUAGE_BY_EXTENSION.items())
    return f"CASE {by_name} {by_ext} ELSE 'Other' END"


_SPACE = "[\\s\\pZ\\x0b\\x1c-\\x1f\\x{85}]"
_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"
_CORPUS = f"""c0 AS (SELECT doc_id, {_picked(_FOLDERS, 'doc_id')} || CASE WHEN doc_id % 31 = 30 THEN 'Makefile' WHEN doc_id % 37 = 36 THEN '.gitignore'
    ELSE 'f' || CAST(doc_id AS VARCHAR) || {_picked(_SUFFIXES, 'doc_id')} END AS path,
  replace(text, '. ', '.' || chr(10) || {_picked(_MARKERS, 'doc_id')}) AS marked,
  CASE WHEN doc_id % 2 = 0 THEN replace(marked, ', ', ' */' || chr(10)) ELSE marked END AS text FROM documents),
c1 AS (SELECT *, regexp_extract(path, '[^/]*$') AS name, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]+)$', 1)) AS ext FROM c0),
c2 AS (SELECT path, text, {_language()} AS language FROM c1 WHERE path NOT LIKE 'docs/metrics/%' AND path NOT LIKE 'build/%'
  AND NOT contains(path, '__pycache__/') AND (name NOT LIKE '.%' OR name IN ('.gitignore', '.gitattributes'))),
c3 AS (SELECT path, language, regexp_split_to_array(text, '{_BREAK}') AS l0 FROM c2 WHERE language <> 'Other'),
c4 AS (SELECT path, language, list_transform(CASE WHEN l0[-1] = '' THEN l0[:-2] ELSE l0 END, lambda x: regexp_replace(x, '^{_SPACE}+', '')) AS l,
  language IN ('CSS', 'JavaScript', 'TypeScript') AS star FROM c3),
c5 AS (SELECT path, language, len(l) AS lines, len(list_filter(l, lambda x: x = '')) AS blank,
  CASE WHEN language IN ({q.quoted(fv.BLOCK_COMMENT_LANGUAGES)}) THEN list_reduce(list_transform(l, lambda x: {{'n': 0, 'b': false, 'x': x}}),
      lambda s, r: {{'n': s.n + CAST(s.b OR starts_with(r.x, '/*') OR starts_with(r.x, '//') OR (star AND starts_with(r.x, '*')) AS INTEGER),
        'b': CASE WHEN s.b THEN NOT contains(r.x, '*/') ELSE starts_with(r.x, '/*') AND NOT contains(r.x, '*/') END, 'x': ''}},
      {{'n': 0, 'b': false, 'x': ''}}).n
    WHEN language IN ({q.quoted(fv.HASH_COMMENT_LANGUAGES)}) THEN len(list_filter(l, lambda x: starts_with(x, '#')))
    WHEN language IN ('Text', 'Markdown') THEN len(list_filter(l, lambda x: starts_with(x, '#') OR starts_with(x, '<!--')))
    WHEN language = 'Batch' THEN len(list_filter(l, lambda x: starts_with(upper(x), 'REM')))
    WHEN language = 'SQL' THEN len(list_filter(l, lambda x: starts_with(x, '--') OR starts_with(x, '/*'))) ELSE 0 END AS comment FROM c4),
c AS (SELECT *, greatest(lines - blank - comment, 0) AS code FROM c5)"""


def _counted(t):
    return corpus.file_lines(corpus.countable_files(corpus_files(t)))


@query(f"WITH {_CORPUS} SELECT path, language FROM c")
def scan_text_corpus(t):
    return corpus.countable_files(corpus_files(t)).select("path", "language")


@query(f"""WITH {_CORPUS} SELECT path, language, CAST(lines AS INTEGER) AS lines, CAST(blank AS INTEGER) AS blank,
  CAST(comment AS INTEGER) AS comment, CAST(code AS INTEGER) AS code FROM c""")
def comment_lines(t):
    return _counted(t)


@query(f"""WITH {_CORPUS} SELECT count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(code) AS BIGINT) AS code,
  CAST(sum(blank) AS BIGINT) AS blank, CAST(sum(comment) AS BIGINT) AS comment FROM c""")
def corpus_totals(t):
    return corpus.corpus_totals(_counted(t))


@query(f"WITH {_CORPUS} SELECT language, count(*) AS files FROM c GROUP BY 1")
def counts_by_language(t):
    return corpus.counts_by_group(corpus.countable_files(corpus_files(t)), F.col("language"), "language")


@query(f"WITH {_CORPUS} SELECT split_part(path, '/', 1) AS top_level, count(*) AS files FROM c GROUP BY 1")
def counts_by_top_level(t):
    return corpus.counts_by_group(corpus.countable_files(corpus_files(t)), corpus.top_level(F.col("path")), "top_level")


@query(f"""WITH {_CORPUS} SELECT path, CAST(lines AS INTEGER) AS lines, CAST(code AS INTEGER) AS code, CAST(blank AS INTEGER) AS blank,
  CAST(comment AS INTEGER) AS comment FROM c ORDER BY lines DESC, path DESC LIMIT 15""")
def largest_files(t):
    return corpus.largest_files(_counted(t)).drop("language")


