"""Row-wise rules: paths, capture times, normalisation, keys, enums, JSON members, recipes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import capture, fixed_values as fv, paths, recipe, values
from ..functions.signature import classify_signature
from ..operators.versions import derivative_record as derive
from ..sources import adapters, records as record_files
from . import base_sql as q
from .registry import query


def _wall(t):
    r = adapters.records(t)
    return r.select(
        "id", F.col("metadata.capture_time.wall_clock").alias("wall"),
        F.col("metadata.capture_time.utc_offset_seconds").alias("off"),
    )


@query(f"""WITH {q.DOC} SELECT id, coalesce(wall_ms, {q.NO_KEY}) AS capture_sort_key FROM doc
UNION ALL SELECT 'o' || CAST(o_orderkey AS VARCHAR), (epoch_us(o_orderdate) // 1000) FROM orders""")
def capture_sort_key(t):
    mine = _wall(t).select("id", capture.capture_sort_key(F.col("wall")).alias("capture_sort_key"))
    timeline = t.orders.select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"),
        capture.capture_sort_key(F.col("o_orderdate")).alias("capture_sort_key"),
    )
    return mine.unionByName(timeline)


@query(f"""WITH {q.DOC} SELECT id, coalesce(wall_ms - utc_offset * 1000, {q.NO_KEY}) AS utc_ms FROM doc""")
def capture_to_utc(t):
    utc = capture.capture_to_utc(F.col("wall"), F.col("off"))
    return _wall(t).select("id", capture.capture_sort_key(utc).alias("utc_ms"))


@query(f"""WITH {q.DOC} SELECT id, CASE WHEN wall_ms IS NULL THEN '' ELSE {q.iso('wall_ms')} ||
  CASE WHEN utc_offset IS NULL THEN ' (zone unknown)' ELSE
    (CASE WHEN utc_offset < 0 THEN ' -' ELSE ' +' END) || printf('%02d:%02d', abs(utc_offset) // 3600, abs(utc_offset) // 60 % 60) END
  END AS described FROM doc""")
def describe_capture(t):
    return _wall(t).select("id", capture.describe_capture(F.col("wall"), F.col("off")).alias("described"))


_NAMES = f"""WITH {q.DOC}, names AS (SELECT file_name AS name FROM doc
  UNION SELECT regexp_extract(url, '[^/]*$') FROM pages UNION SELECT url FROM pages)"""


def _names(t):
    urls = t.pages.select("url")
    return (
        adapters.records(t).select(F.col("metadata.file_name").alias("name"))
        .union(urls.select(paths.base_name(F.col("url")))).union(urls).distinct()
    )


@query(f"{_NAMES} SELECT name, {q.extension('name')} AS extension, {q.suffix('name')} AS suffix FROM names")
def file_extension(t):
    n = F.col("name")
    return _names(t).select(
        "name", paths.file_extension(n).alias("extension"), paths.dotted_suffix(n).alias("suffix")
    )


@query(f"{_NAMES} SELECT name, {q.kind('name')} AS kind FROM names")
def kind_from_extension(t):
    return _names(t).select("name", paths.kind_from_extension(F.col("name")).alias("kind"))


@query(f"""WITH {q.DOC} SELECT id,
  CAST((((doc_id % 40 * 23 - 450) % 360 + 360) % 360 + 45) // 90 % 4 * 90 AS INTEGER) AS rotation_degrees,
  CAST(greatest(0, least(5, doc_id % 9 - 2)) AS INTEGER) AS rating,
  CAST(greatest(0, doc_id % 5000 - 5) AS INTEGER) AS pixel_width,
  CAST(greatest(0, doc_id % 3000 - 5) AS INTEGER) AS pixel_height,
  greatest(0, n_chars * 10 - 500) AS duration_ms,
  coalesce(doc_id % 5 <> 0 AND doc_id % 200 - 99 BETWEEN -90 AND 90 AND doc_id % 380 - 190 BETWEEN -180 AND 180, false) AS has_location
FROM doc""")
def normalize_metadata(t):
    m = values.normalize_metadata(F.col("metadata")).alias("m")
    return adapters.records(t).select("id", m).select(
        "id", "m.rotation_degrees", "m.rating", "m.pixel_width", "m.pixel_height", "m.duration_ms",
        F.col("m.location").isNotNull().alias("has_location"),
    )


@query("""SELECT c_custkey, c_acctbal / 100 BETWEEN -90 AND 90 AND c_acctbal / 50 BETWEEN -180 AND 180
  AND c_custkey % 11 <> 0 AS valid,
  CASE WHEN c_acctbal / 100 BETWEEN -90 AND 90 AND c_acctbal / 50 BETWEEN -180 AND 180 AND c_custkey % 11 <> 0
    AND c_custkey % 5 <> 0 THEN c_acctbal ELSE -99999 END AS altitude FROM customer""")
def geo_validate(t):
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    nan = F.lit(float("nan"))
    place = t.customer.select(
        "c_custkey", F.when(k % 11 == 0, nan).otherwise(b / 100).alias("lat"), (b / 50).alias("lon"),
        F.when(k % 5 == 0, F.lit(float("inf"))).otherwise(b).alias("alt"),
    )
    point = values.valid_location(F.col("lat"), F.col("lon"), F.col("alt"))
    return place.select(
        "c_custkey", values.geo_valid(F.col("lat"), F.col("lon")).alias("valid"),
        F.coalesce(point["altitude_metres"], F.lit(-99999.0)).alias("altitude"),
    )


_MESSY = """p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '/lib/./' || url WHEN 1 THEN url || '/../x//y/.'
  WHEN 2 THEN '/a/../../' || url WHEN 3 THEN '../' || url ELSE url END AS path FROM pages)"""


def _messy(t):
    u, k = F.col("url"), F.col("page_id") % 5
    join = lambda a, b, c: F.concat(F.lit(a), b, F.lit(c))
    return t.pages.select(
        "page_id",
        F.when(k == 0, join("/lib/./", u, "")).when(k == 1, join("", u, "/../x//y/."))
        .when(k == 2, join("/a/../../", u, "")).when(k == 3, join("../", u, "")).otherwise(u).alias("path"),
    )


@query(f"WITH {_MESSY} SELECT page_id, {q.clean('path')} AS clean FROM p")
def path_key(t):
    return _messy(t).select("page_id", paths.clean_path(F.col("path")).alias("clean"))


@query(f"""WITH {_MESSY}, c AS (SELECT page_id, {q.clean('path')} AS c FROM p)
SELECT page_id, c = '/lib/https:' OR starts_with(c, '/lib/https:/') AS within FROM c""")
def filter_within_root(t):
    inside = paths.within_root(F.col("path"), F.lit("/lib//x/../https:/"))
    return _messy(t).select("page_id", inside.alias("within"))


@query(f"""WITH {q.DOC} SELECT id, CASE WHEN doc_id % 37 = 0 THEN false ELSE true END AS safe,
  {q.managed('id', 'digest', 'file_name')} AS managed_path FROM doc""")
def managed_path(t):
    r = adapters.records(t)
    return r.select(
        "id", paths.safe_managed_path(F.col("managed_original_path")).alias("safe"),
        paths.managed_path(F.col("id"), F.col("fingerprint.digest"), F.col("metadata.file_name")).alias("managed_path"),
    )


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN false ELSE true END AS safe FROM pages""")
def filter_safe_archive_path(t):
    k, tail = F.col("page_id") % 6, F.regexp_replace("url", "[^a-z0-9/]", "-")
    tail = F.regexp_replace(tail, "/+", "/")
    tail = F.regexp_replace(tail, "/$", "")
    path = (
        F.when(k == 0, F.concat(F.lit("/store/"), tail)).when(k == 1, F.concat(F.lit("store/../"), tail))
        .when(k == 2, F.concat(F.lit("other/"), tail)).otherwise(F.concat(F.lit("store/"), tail))
    )
    return t.pages.select("page_id", paths.safe_archive_path(path).alias("safe"))


@query("""SELECT doc_id, sha256(text) AS digest, 'sha256' AS algorithm,
  CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'sha256-' || sha256(text) END AS cache_key,
  (CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'sha256-' || sha256(text) END) || '/preview/' || CAST(n_chars AS VARCHAR)
    || 'x512/' || CAST(doc_id AS VARCHAR) || '/r2' AS render_key FROM documents""")
def fingerprint_keys(t):
    d = F.col("doc_id")
    fp = values.fingerprint(F.encode("text", "UTF-8"))
    rows = t.documents.select("doc_id", "n_chars", fp.alias("fp"))
    key = values.fingerprint_cache_key(F.when(d % 9 == 0, "").otherwise(F.col("fp.algorithm")), F.col("fp.digest"))
    return rows.select(
        "doc_id", "fp.digest", "fp.algorithm", key.alias("cache_key"),
        values.render_cache_key(key, F.lit("preview"), F.col("n_chars"), F.lit(512), d, F.lit(2)).alias("render_key"),
    )


@query("""SELECT p_partkey, CAST(CASE WHEN p_size * 15 <= 128 THEN 128 WHEN p_size * 15 <= 256 THEN 256 ELSE 512 END AS INTEGER) AS tier FROM part""")
def thumbnail_tier(t):
    return t.part.select("p_partkey", values.thumbnail_tier(F.col("p_size") * 15).alias("tier"))


@query(f"""SELECT event_id,
  CASE WHEN x IN ({q.quoted(fv.REQUEST_STATES)}) THEN x ELSE 'pending' END AS state,
  CASE WHEN x IN ({q.quoted(fv.ERROR_CODES)}) THEN x ELSE 'internal' END AS error,
  CASE WHEN x IN ({q.quoted(fv.MEDIA_KINDS)}) THEN x ELSE 'unknown' END AS kind,
  CASE WHEN x IN ({q.quoted(fv.METADATA_ORIGINS)}) THEN x ELSE 'unknown' END AS origin,
  CASE WHEN x IN ({q.quoted(fv.REQUEST_PRIORITIES)}) THEN x ELSE 'background' END AS priority,
  CASE WHEN x IN ({q.quoted(fv.REQUEST_KINDS)}) THEN x ELSE 'unknown' END AS request,
  CASE WHEN x IN ({q.quoted(fv.OPERATION_KINDS)}) THEN x ELSE 'unknown' END AS operation
FROM (SELECT event_id, (['image', 'timeout', 'running', 'sidecar', 'interactive', 'export', 'crop'])[CAST(event_id % 8 AS INTEGER) + 1] AS y,
  coalesce(y, event_type) AS x FROM events)""")
def decode_enum(t):
    words = ["image", "timeout", "running", "sidecar", "interactive", "export", "crop"]
    x = F.coalesce(F.get(F.array(*[F.lit(w) for w in words]), (F.col("event_id") % 8).cast("int")), F.col("event_type"))
    return t.events.select("event_id", x.alias("x")).select(
        "event_id", values.decode_state(F.col("x")).alias("state"), values.decode_error(F.col("x")).alias("error"),
        values.decode_media_kind(F.col("x")).alias("kind"), values.decode_origin(F.col("x")).alias("origin"),
        values.decode_priority(F.col("x")).alias("priority"), values.decode_request_kind(F.col("x")).alias("request"),
        values.decode_operation(F.col("x")).alias("operation"),
    )


@query("""SELECT event_id, CAST(1 AS INTEGER) AS unknown, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k,
  '{"deep":[1,2]}' AS nested, CASE WHEN event_id % 2 = 0 THEN 'kept' ELSE 'seen' END AS merged,
  CAST(CASE WHEN event_id % 2 = 0 THEN 3 ELSE 3 END AS INTEGER) AS members FROM events""")
def unknown_fields(t):
    """Members this build does not know survive a read and a merge."""
    text = F.concat(
        F.lit('{"schemaVersion":2,"id":"'), F.col("event_id").cast("string"), F.lit('","k":'),
        F.get_json_object("props", "$.k"), F.lit(',"later":{"deep":[1,2]}}'),
    )
    split = t.events.select("event_id", values.split_unknown_fields(text, ["id", "k"]).alias("u"), F.get_json_object(text, "$.k").alias("k"))
    known = F.when(
        F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), F.lit("kept"), F.lit("id"), F.lit("1"))
    ).otherwise(F.create_map(F.lit("id"), F.lit("1"), F.lit("x"), F.lit("seen")))
    merged = values.merge_unknown_fields(known, F.col("u"))
    return split.select(
        "event_id", F.size("u").alias("unknown"), "k", F.col("u")["later"].alias("nested"),
        F.coalesce(merged["k"], merged["x"]).alias("merged"), F.size(merged).alias("members"),
    )


_PREFIX = "mediaquarry-checkpoint-v1:"


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN CASE WHEN turn % 2 = 0 THEN 'mediaquarry-checkpoint-v1:' || text ELSE text END ELSE text END AS message,
  CASE WHEN turn % 3 = 2 THEN 'unknown' ELSE role END AS author_id,
  CASE WHEN turn % 3 = 2 THEN '' ELSE '1.' || CAST(turn AS VARCHAR) END AS application_version,
  CASE WHEN turn % 3 = 2 THEN '' ELSE CAST(conv_id AS VARCHAR) END AS parent_id FROM conversations""")
def provenance_decode(t):
    n = F.col("turn")
    encoded = values.encode_provenance(
        F.col("text"), F.col("role"), F.concat(F.lit("1."), n.cast("string")), F.col("conv_id").cast("string"), _PREFIX
    )
    plain = F.when(n % 2 == 0, F.concat(F.lit(_PREFIX), F.col("text"))).otherwise(F.col("text"))
    message = F.when(n % 3 == 2, plain).otherwise(encoded)
    return t.conversations.select("conv_id", "turn", values.provenance(message, _PREFIX).alias("p")).select("conv_id", "turn", "p.*")


@query(f"""WITH {q.DOC} SELECT id, doc_id % 4 = 0 OR doc_id % 19 <> 0 AS recognized FROM doc""")
def recipe_fully_recognized(t):
    return adapters.records(t).select(
        "id", recipe.recipe_fully_recognized(F.col("recipe.operations")).alias("recognized")
    )


_FOLD = f"""WITH {q.DOC}, s0 AS (SELECT *, CAST(doc_id % 2000 + 1 AS INTEGER) AS w0, CAST(doc_id % 1000 + 1 AS INTEGER) AS h0,
  doc_id % 4 = 0 AS empty FROM doc),
s1 AS (SELECT *, CASE WHEN empty THEN NULL WHEN doc_id % 19 = 0 THEN 'unsupportedMedia' END AS e1,
  CASE WHEN NOT empty AND doc_id % 19 <> 0 AND doc_id % 5 IN (1, 3) THEN h0 ELSE w0 END AS w1,
  CASE WHEN NOT empty AND doc_id % 19 <> 0 AND doc_id % 5 IN (1, 3) THEN w0 ELSE h0 END AS h1 FROM s0),
s2 AS (SELECT *, CASE WHEN empty OR e1 IS NOT NULL THEN e1 WHEN doc_id % 23 = 0 THEN 'unsupportedMedia'
    WHEN doc_id % 1500 > 0 AND doc_id % 1200 > 0 AND doc_id % 7 + doc_id % 1500 <= w1 AND doc_id % 3 + doc_id % 1200 <= h1 THEN NULL
    ELSE 'conflict' END AS e2 FROM s1),
s3 AS (SELECT *, CASE WHEN empty OR e2 IS NOT NULL THEN w1 ELSE doc_id % 1500 END AS w2,
  CASE WHEN empty OR e2 IS NOT NULL THEN h1 ELSE doc_id % 1200 END AS h2 FROM s2),
s4 AS (SELECT *, CASE WHEN empty OR e2 IS NOT NULL THEN e2 WHEN doc_id % 10 BETWEEN 1 AND 8 THEN NULL ELSE 'conflict' END AS e3,
  NOT empty AND e2 IS NULL AND doc_id % 10 BETWEEN 5 AND 8 AS turn FROM s3)"""


def _outcome(t):
    d = F.substring("id", 2, 20).cast("bigint")
    out = recipe.recipe_outcome(
        F.col("recipe.operations"), (d % 2000 + 1).cast("int"), (d % 1000 + 1).cast("int")
    )
    return adapters.records(t).select("id", out.alias("o"))


@query(f"""{_FOLD} SELECT id, CAST(CASE WHEN turn THEN h2 ELSE w2 END AS INTEGER) AS w,
  CAST(CASE WHEN turn THEN w2 ELSE h2 END AS INTEGER) AS h, coalesce(e3, 'none') AS error FROM s4""")
def recipe_outcome(t):
    return _outcome(t).select("id", "o.w", "o.h", F.coalesce("o.error", F.lit("none")).alias("error"))


_BOXED = """CASE WHEN 300 * pw // ph <= 200 THEN greatest(1, 300 * pw // ph) ELSE 200 END"""


@query(f"""WITH p AS (SELECT p_partkey, p_size * 37 AS pw, CAST(p_partkey % 900 + 1 AS BIGINT) AS ph FROM part)
SELECT p_partkey,
  CAST(CASE WHEN pw <= 200 AND ph <= 300 THEN pw WHEN 300 * pw // ph <= 200 THEN greatest(1, 300 * pw // ph) ELSE 200 END AS INTEGER) AS preview_w,
  CAST(CASE WHEN pw <= 200 AND ph <= 300 THEN ph WHEN 300 * pw // ph <= 200 THEN 300 ELSE greatest(1, 200 * ph // pw) END AS INTEGER) AS preview_h,
  CAST({_BOXED} AS INTEGER) AS thumb_w,
  CAST(CASE WHEN 300 * pw // ph <= 200 THEN 300 ELSE greatest(1, 200 * ph // pw) END AS INTEGER) AS thumb_h FROM p""")
def fit_within(t):
    w, h = F.col("p_size") * 37, F.col("p_partkey") % 900 + 1
    fit = recipe.fit_within(w, h, F.lit(200), F.lit(300))
    thumb = recipe.scale_to_box(w, h, F.lit(200), F.lit(300))
    return t.part.select(
        "p_partkey", fit["w"].alias("preview_w"), fit["h"].alias("preview_h"),
        thumb["w"].alias("thumb_w"), thumb["h"].alias("thumb_h"),
    )


@query(f"""WITH {q.DOC} SELECT id, {q.kind('file_name')} <> 'unknown' OR doc_id % 3 = 0 AS indexable FROM doc""")
def filter_indexable(t):
    """A known extension, or content that starts like a readable container."""
    d = F.substring("id", 2, 20).cast("bigint")
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A")), F.encode("metadata.caption", "UTF-8"))
    content = F.when(d % 3 == 0, png).otherwise(F.encode("metadata.caption", "UTF-8"))
    return adapters.records(t).select(
        "id", paths.indexable(F.col("identity.absolute_path"), classify_signature(content)).alias("indexable")
    )


@query(f"""WITH {q.DOC} SELECT id,
  coalesce(size_bytes >= 0 AND last_modified_ms IS NOT NULL AND doc_id % 5 <> 0, false) AS unchanged,
  doc_id % 2 = 0 AND doc_id % 3 <> 0 AS same_file FROM doc""")
def filter_looks_unchanged(t):
    d = F.substring("id", 2, 20).cast("bigint")
    i = F.col("identity")
    other_size = F.when(d % 5 == 0, i["size_bytes"] + 1).otherwise(i["size_bytes"])
    other_file = F.when(d % 3 == 0, "other").otherwise(i["file_id"])
    return adapters.records(t).select(
        "id",
        values.looks_unchanged(i["size_bytes"], i["last_modified_ms"], other_size, i["last_modified_ms"]).alias("unchanged"),
        values.same_file(i["volume_id"], i["file_id"], i["volume_id"], other_file).alias("same_file"),
    )


@query("""SELECT conv_id, turn, conv_id % 4 <> 0 AND role <> '' AND role = CASE conv_id % 3 WHEN 0 THEN 'user' ELSE 'assistant' END AS allowed,
  CASE WHEN turn % 4 = 0 THEN 'Library' ELSE trim(text, ' ') END AS library_name, turn % 2 = 0 AS refused FROM conversations""")
def filter_has_permission(t):
    row = F.struct(
        F.when(F.col("conv_id") % 4 == 0, "").otherwise(F.col("conv_id").cast("string")).alias("id"),
        F.lit("Library").alias("name"), F.lit(1).alias("format_version"), F.lit(0).alias("created_at_ms"),
        F.struct(F.when(F.col("conv_id") % 3 == 0, "user").otherwise("assistant").alias("id")).alias("local_user"),
    )
    allowed = values.has_permission(record_files.library_valid(row), row["local_user"]["id"], F.col("role"))
    wanted = F.when(F.col("turn") % 4 == 0, "  ").otherwise(F.col("text"))
    made = record_files.library_descriptor(wanted, F.lit(0), F.lit("lib"), F.col("role"))
    renamed = record_files.renamed_library(F.lit("old"), F.when(F.col("turn") % 2 == 0, " ").otherwise("new"))
    return t.conversations.select(
        "conv_id", "turn", allowed.alias("allowed"), made["name"].alias("library_name"),
        renamed.isNull().alias("refused"),
    )


@query(f"""WITH {q.REQUESTS} SELECT id, last_error_code IN ({q.quoted(fv.RETRYABLE_ERRORS)}) AS retryable,
  state IN ({q.quoted(fv.TERMINAL_STATES)}) AS terminal,
  state = 'failed' AND last_error_code IN ({q.quoted(fv.RETRYABLE_ERRORS)}) AND attempts < max_attempts AS can_retry FROM job""")
def filter_can_retry(t):
    c = F.col
    return adapters.work_requests(t).select(
        "id", values.retryable(c("last_error_code")).alias("retryable"), values.terminal(c("state")).alias("terminal"),
        values.can_retry(c("state"), c("last_error_code"), c("attempts"), c("max_attempts")).alias("can_retry"),
    )


@query(f"""WITH {q.DOC} SELECT count(*) AS records, CAST(count(*) FILTER (size_bytes < 0) AS BIGINT) AS bad_identity,
  CAST(0 AS BIGINT) AS bad_fingerprint, CAST(count(*) FILTER (doc_id % 10 = 0 AND (doc_id % 3 = 0 OR doc_id % 20 <> 0)) AS BIGINT) AS bad_derivative FROM doc""")
def validity_report(t):
    c = F.col
    derivative = c("derivative")
    return adapters.records(t).agg(
        F.count("*").alias("records"),
        F.count_if(~values.identity_valid(c("identity.absolute_path"), c("identity.size_bytes"))).alias("bad_identity"),
        F.count_if(~values.fingerprint_valid(c("fingerprint.algorithm"), c("fingerprint.digest"))).alias("bad_fingerprint"),
        F.count_if(derivative.isNotNull() & ~values.derivative_valid(
            derivative["source_media_id"], derivative["recipe_revision"], derivative["kind"]
        )).alias("bad_derivative"),
    )


@query(f"""WITH {q.DOC} SELECT id, {q.suffix('file_name')} IN ({q.quoted(fv.EMBEDDED_WRITE_EXTENSIONS)}) AS supported FROM doc""")
def filter_supports_embedded_write(t):
    return adapters.records(t).select(
        "id", paths.supports_embedded_write(F.col("identity.absolute_path")).alias("supported")
    )


@query("""WITH n AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '.' || CAST(page_id AS VARCHAR)
  WHEN 2 THEN 'ab.' || CAST(page_id AS VARCHAR) ELSE CAST(page_id AS VARCHAR) END AS id FROM pages),
f AS (SELECT page_id, CASE WHEN regexp_full_match(id, '[a-z0-9._-]{1,64}') AND id NOT LIKE '.%' THEN id
  ELSE 'x-' || lower(hex(encode(id))) END || '.json' AS record_file FROM n)
SELECT page_id, record_file, rpad(substr(record_file, 1, 2), 2, '_') AS shard FROM f""")
def record_file_names(t):
    k, number = F.col("page_id") % 4, F.col("page_id").cast("string")
    media_id = (
        F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("."), number))
        .when(k == 2, F.concat(F.lit("ab."), number)).otherwise(number)
    )
    name = paths.record_file_name(media_id)
    return t.pages.select("page_id", name.alias("record_file"), paths.shard_for(name).alias("shard"))


@query(f"""WITH {q.DOC} SELECT id, 'e' || CAST(doc_id AS VARCHAR) AS derivative_id, id AS source_media_id,
  CAST(doc_id % 4 AS INTEGER) AS recipe_revision, 'export' AS kind, 'x' || CAST(doc_id AS VARCHAR) || '.png' AS file_name,
  '/exports/' || lang AS folder_path, CAST(0 AS INTEGER) AS rotation_degrees, text AS caption, CAST(0 AS INTEGER) AS new_revision,
  sha256(lang) AS digest FROM doc WHERE {q.kind('file_name')} = 'image'""")
def derivative_record(t):
    r = adapters.records(t)
    d = F.substring("id", 2, 20).cast("bigint").cast("string")
    exports = r.select(
        F.col("id").alias("source_id"),
        F.concat(F.lit("/exports/"), F.col("metadata.tags")[0], F.lit("/x"), d, F.lit(".png")).alias("path"),
        F.col("identity.size_bytes").alias("size_bytes"), F.lit(0).cast("bigint").alias("last_modified_ms"),
        F.sha2(F.col("metadata.tags")[0], 256).alias("digest"),
    )
    fresh = F.concat(F.lit("e"), F.regexp_extract("path", r"/x(\d+)\.png$", 1))
    return derive(exports, r, fresh).select(
        F.col("derivative.source_media_id").alias("id"), F.col("id").alias("derivative_id"),
        F.col("derivative.source_media_id").alias("source_media_id"),
        F.col("derivative.recipe_revision").alias("recipe_revision"), F.col("derivative.kind").alias("kind"),
        "metadata.file_name", "metadata.folder_path", "metadata.rotation_degrees", "metadata.caption",
        F.col("recipe.revision").alias("new_revision"), F.col("fingerprint.digest").alias("digest"),
    )
