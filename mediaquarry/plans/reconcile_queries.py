"""Listings against records: diffs, reconciliation, moves, batches and summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.values import fingerprint_cache_key
from ..operators import reconcile as rec
from ..session import shared_dir
from ..sources import adapters, listing
from . import base_sql as q
from .registry import query


@adapters.view
def _names(t):
    d = F.col("doc_id")
    ext = F.element_at(F.array(*[F.lit(e) for e in (".jpg", ".mp4", ".txt", ".PNG")]), (d % 4 + 1).cast("int"))
    name = F.concat(d.cast("string"), ext)
    return t.documents.select(
        "doc_id", "text", "n_chars", ext.alias("ext"),
        F.concat(F.lit("/library/"), F.col("source"), F.lit("/"), name).alias("old_path"),
        F.concat(F.lit("/library/moved/"), F.col("lang"), F.lit("/"), name).alias("new_path"),
    )


@adapters.view
def files(t):
    """What is on disk now; some files moved, changed, stopped being media or cannot be read."""
    d = F.col("doc_id")
    changed = d % 13 == 5
    return _names(t).where(d % 7 != 0).select(
        F.when(d % 11 == 3, F.col("new_path")).otherwise(F.col("old_path")).alias("path"),
        ((F.col("ext") != ".txt") | (d % 3 == 0)).alias("indexable"),
        (F.col("n_chars") + changed.cast("int")).alias("size_bytes"),
        (d * 1000 + changed.cast("int")).alias("last_modified_ms"),
        F.sha2(F.when(changed, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("content_digest"),
        F.when(d % 23 == 0, "permissionDenied").alias("content_error"),
    )


@adapters.view
def stored(t):
    """What the catalogue knows; some paths carry a second record."""
    d = F.col("doc_id")
    number = F.lpad(d.cast("string"), 20, "0")
    ids = F.when(d % 19 == 0, F.array(F.concat(F.lit("r"), number), F.concat(F.lit("z"), number))).otherwise(
        F.array(F.concat(F.lit("r"), number))
    )
    return _names(t).where(d % 5 != 0).select(
        F.explode(ids).alias("id"), F.col("old_path").alias("path"), F.sha2("text", 256).alias("digest"),
        F.col("n_chars").alias("size_bytes"), (d * 1000).alias("last_modified_ms"), (d % 17 != 0).alias("managed"),
    )


@adapters.view
def hashed(t):
    """Digests of exactly the files the first stage asks for."""
    on_disk = files(t)
    wanted = rec.needs_fingerprint(on_disk.drop("content_digest", "content_error"), stored(t))
    return on_disk.join(wanted, "path", "left_semi").select(
        "path", F.when(F.col("content_error").isNull(), F.col("content_digest")).alias("digest"),
        F.col("content_error").alias("read_error"),
    )


def outcomes(t):
    fresh = F.sha2(F.concat_ws("|", "path", "digest"), 256)
    return rec.reconcile(files(t), stored(t), hashed(t), fresh)


_INPUT = """n AS (SELECT doc_id, text, n_chars, (['.jpg', '.mp4', '.txt', '.PNG'])[CAST(doc_id % 4 AS INTEGER) + 1] AS ext,
  '/library/' || source || '/' || CAST(doc_id AS VARCHAR) || ext AS old_path,
  '/library/moved/' || lang || '/' || CAST(doc_id AS VARCHAR) || ext AS new_path FROM documents),
f AS (SELECT CASE WHEN doc_id % 11 = 3 THEN new_path ELSE old_path END AS path, ext <> '.txt' OR doc_id % 3 = 0 AS idx,
  n_chars + CAST(doc_id % 13 = 5 AS INTEGER) AS sz, doc_id * 1000 + CAST(doc_id % 13 = 5 AS INTEGER) AS ms,
  CASE WHEN doc_id % 23 <> 0 THEN sha256(text || CASE WHEN doc_id % 13 = 5 THEN 'x' ELSE '' END) END AS dig,
  doc_id % 23 <> 0 AS ok FROM n WHERE doc_id % 7 <> 0),
r0 AS (SELECT unnest(CASE WHEN doc_id % 19 = 0 THEN ['r', 'z'] ELSE ['r'] END) || lpad(CAST(doc_id AS VARCHAR), 20, '0') AS id,
  old_path AS path, sha256(text) AS dig, n_chars AS sz, doc_id * 1000 AS ms, doc_id % 17 <> 0 AS man FROM n WHERE doc_id % 5 <> 0),
r1 AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY id) AS rn FROM r0)"""

_OUTCOME = f"""{_INPUT},
j AS (SELECT f.path, f.dig, r.id AS rid, CASE WHEN NOT idx THEN 'ignored'
    WHEN r.id IS NOT NULL AND r.sz = f.sz AND r.ms = f.ms AND man THEN 'unchanged'
    WHEN NOT ok THEN 'failed' WHEN r.id IS NOT NULL THEN 'updated' ELSE 'new' END AS k
  FROM f LEFT JOIN (SELECT * FROM r1 WHERE rn = 1) r ON r.path = f.path),
nn AS (SELECT path, dig, row_number() OVER (PARTITION BY dig ORDER BY string_split(path, '/')) AS o FROM j WHERE k = 'new'),
vv AS (SELECT id, dig, row_number() OVER (PARTITION BY dig ORDER BY id) AS o FROM r0 WHERE path NOT IN (SELECT path FROM f)),
out AS (SELECT j.path, CASE WHEN k <> 'new' THEN k WHEN v.id IS NULL THEN 'added' ELSE 'moved' END AS class,
    CASE WHEN k <> 'new' THEN rid WHEN v.id IS NULL THEN sha256(j.path || '|' || j.dig) ELSE v.id END AS id
  FROM j LEFT JOIN nn USING (path) LEFT JOIN vv v ON v.dig = nn.dig AND v.o = nn.o
  UNION ALL SELECT r.path, 'removed', r.id FROM r1 r JOIN j USING (path)
    WHERE k = 'ignored' OR (k IN ('unchanged', 'updated') AND rn > 1)
  UNION ALL SELECT r.path, 'retained', r.id FROM r0 r WHERE r.path NOT IN (SELECT path FROM f)
    AND r.id NOT IN (SELECT v.id FROM vv v JOIN nn ON v.dig = nn.dig AND v.o = nn.o))"""


@query(f"WITH {_OUTCOME} SELECT path, coalesce(id, '') AS id, class FROM out")
def reconcile(t):
    return outcomes(t).select("path", F.coalesce("id", F.lit("")).alias("id"), "class")


@query(f"""WITH {_INPUT} SELECT f.path FROM f LEFT JOIN (SELECT * FROM r1 WHERE rn = 1) r ON r.path = f.path
WHERE idx AND NOT coalesce(r.sz = f.sz AND r.ms = f.ms AND man, false)""")
def needs_fingerprint(t):
    return rec.needs_fingerprint(files(t), stored(t))


@query(f"""WITH {_INPUT}, nf AS (SELECT path, dig, row_number() OVER (PARTITION BY dig ORDER BY string_split(path, '/')) AS o
  FROM f WHERE dig IS NOT NULL AND path NOT IN (SELECT path FROM r0)),
v AS (SELECT id, dig, row_number() OVER (PARTITION BY dig ORDER BY id) AS o FROM r0 WHERE path NOT IN (SELECT path FROM f))
SELECT nf.path, v.id FROM nf JOIN v ON v.dig = nf.dig AND v.o = nf.o""")
def match_moves(t):
    on_disk, known = files(t), stored(t)
    new = on_disk.where("content_error IS NULL").join(known.select("path"), "path", "left_anti").select(
        "path", F.col("content_digest").alias("digest")
    )
    return rec.match_moves(new, known.join(on_disk.select("path"), "path", "left_anti"))


@query(f"WITH {_INPUT} SELECT id, path, rn > 1 AS extra FROM r1")
def keep_first_per_path(t):
    return rec.keep_first_per_path(stored(t)).select("id", "path", "extra")


_SUMMARY = f"""WITH {_OUTCOME} SELECT CAST(count(*) FILTER (class = 'added') AS BIGINT) AS added,
  CAST(count(*) FILTER (class IN ('updated', 'moved')) AS BIGINT) AS updated,
  CAST(count(*) FILTER (class = 'removed') AS BIGINT) AS removed,
  CAST(count(*) FILTER (class = 'unchanged') AS BIGINT) AS unchanged,
  CAST(count(*) FILTER (class = 'failed') AS BIGINT) AS failed,
  CAST(count(*) FILTER (class = 'failed') AS BIGINT) AS warnings FROM out"""


@query(_SUMMARY)
def scan_summary(t):
    out = outcomes(t)
    return rec.scan_summary(out, rec.scan_warnings(out, hashed(t)))


@query(_SUMMARY)
def scan_summary_observed(t):
    """The same counts, taken while the outcomes are written."""
    return rec.write_outcomes(outcomes(t), f"{shared_dir(t.spark)}/outcomes-{uuid.uuid4().hex}")


@query(f"""WITH {_OUTCOME} SELECT path, id, class,
  (row_number() OVER (ORDER BY string_split(path, '/'), id) - 1) // 64 AS batch
FROM out WHERE class IN ('added', 'updated', 'moved')""")
def commit_batches(t):
    return rec.commit_batches(outcomes(t), 64).select("path", "id", "class", "batch")


@query(f"""WITH {_INPUT}, a AS (SELECT path, any_value(sz) AS sz, any_value(ms) AS ms FROM r0 GROUP BY path)
SELECT coalesce(a.path, f.path) AS path, CASE WHEN a.path IS NULL THEN 'created' WHEN f.path IS NULL THEN 'removed' ELSE 'modified' END AS kind
FROM a FULL JOIN f ON a.path = f.path WHERE a.path IS NULL OR f.path IS NULL OR a.sz <> f.sz OR a.ms <> f.ms""")
def listing_diff(t):
    before = stored(t).select("path", "size_bytes", "last_modified_ms").distinct()
    return rec.listing_diff(before, files(t))


@query(f"""WITH {_INPUT} SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS pos FROM f""")
def scan_listing(t):
    """Files in the order a walk by folder and name meets them."""
    return rec.listing_order(files(t).select("path"))


@query(f"""WITH {_INPUT} SELECT path, 'notFound' AS code, 'Cannot read file' AS message FROM f WHERE NOT ok""")
def scan_binary_errors(t):
    on_disk = files(t)
    return listing.read_errors(on_disk, on_disk.where("content_error IS NULL"))


@query(f"""WITH {_INPUT}, a AS (SELECT DISTINCT path, 'sha256-' || dig AS k FROM r0), b AS (SELECT path, 'sha256-' || dig AS k FROM f WHERE ok)
SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS left_only,
  (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS right_only, false AS equivalent""")
def store_equivalence(t):
    key = lambda c: fingerprint_cache_key(F.lit("sha256"), F.col(c)).alias("fingerprint_key")
    left = stored(t).select("path", key("digest")).distinct()
    right = files(t).where("content_error IS NULL").select("path", key("content_digest"))
    return rec.store_equivalence(left, right)


@query(f"""WITH {_INPUT}, a AS (SELECT DISTINCT path, dig FROM r0), b AS (SELECT path, dig FROM r0 GROUP BY ALL)
SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS left_only,
  (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS right_only,
  NOT EXISTS (SELECT * FROM a EXCEPT SELECT * FROM b) AND NOT EXISTS (SELECT * FROM b EXCEPT SELECT * FROM a) AS equivalent""")
def store_equivalence_rebuilt(t):
    """Two catalogues of the same files in another order and under other ids hold the same rows."""
    key = fingerprint_cache_key(F.lit("sha256"), F.col("digest")).alias("fingerprint_key")
    left = stored(t).select("path", key).distinct()
    rebuilt = stored(t).withColumn("id", F.sha2("path", 256)).repartition("id").select("id", "path", key)
    return rec.store_equivalence(left, rebuilt.groupBy("path", "fingerprint_key").agg(F.min("id").alias("id")))


@query(f"""WITH {_OUTCOME} SELECT id, path, class <> 'added' AS metadata_replaced FROM out WHERE class IN ('added', 'updated', 'moved')
UNION ALL SELECT id, path, false FROM r0 WHERE id NOT IN
  (SELECT id FROM out WHERE class IN ('added', 'updated', 'moved', 'removed') AND id IS NOT NULL)""")
def apply_outcomes(t):
    return rec.apply_outcomes(stored(t), outcomes(t), files(t)).select("id", "path", "metadata_replaced")


@query(f"""WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/roots//' ELSE '/roots/./' END
    || split_part(url, '/', 3) || CASE page_id % 2 WHEN 0 THEN '/' ELSE '' END AS root FROM pages)
SELECT {q.clean('root')} AS root, min(page_id) AS position FROM p GROUP BY 1""")
def roots_distinct(t):
    k = F.col("page_id")
    root = F.concat(
        F.when(k % 3 == 0, "/roots//").otherwise("/roots/./"), F.split_part("url", F.lit("/"), F.lit(3)),
        F.when(k % 2 == 0, "/").otherwise(""),
    )
    return rec.roots_distinct(t.pages.select(k.alias("position"), root.alias("root")))


