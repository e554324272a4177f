"""The table views of the adapters restated in SQL, shared by the reference queries."""

from __future__ import annotations

from ..functions import fixed_values as fv


def quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


IMAGES, VIDEOS = quoted(fv.IMAGE_EXTENSIONS), quoted(fv.VIDEO_EXTENSIONS)
NO_KEY = "CAST('-9223372036854775808' AS BIGINT)"
DAY = 86_400_000


def suffix(name: str) -> str:
    return f"(CASE WHEN contains({name}, '.') THEN lower(regexp_extract({name}, '[^.]*$')) ELSE '' END)"


def extension(name: str) -> str:
    return (
        f"(CASE WHEN regexp_matches({name}, '^.+\\.[^.]+$') "
        f"THEN lower(regexp_extract({name}, '[^.]*$')) ELSE '' END)"
    )


def kind(name: str) -> str:
    s = suffix(name)
    return f"(CASE WHEN {s} IN ({IMAGES}) THEN 'image' WHEN {s} IN ({VIDEOS}) THEN 'video' ELSE 'unknown' END)"


def managed(media_id: str, digest: str, name: str) -> str:
    s = suffix(name)
    return (
        f"('originals/' || substr(sha256({media_id}), 1, 2) || '/' || sha256({media_id}) || '/' || "
        f"sha256({digest}) || CASE WHEN {s} <> '' THEN '.' || {s} ELSE '' END)"
    )


def clean(path: str) -> str:
    """Stack of path parts as a list fold."""
    parts = f"list_filter(string_split({path}, '/'), lambda p: p <> '' AND p <> '.')"
    folded = (
        f"list_reduce(list_transform({parts}, lambda p: [p]), lambda s, p: CASE "
        f"WHEN p[1] <> '..' THEN s || p WHEN len(s) > 0 AND s[-1] <> '..' THEN s[:-2] "
        f"WHEN starts_with({path}, '/') THEN s ELSE s || p END, CAST([] AS VARCHAR[]))"
    )
    joined = f"array_to_string({folded}, '/')"
    return (
        f"(CASE WHEN {path} = '' THEN '' WHEN starts_with({path}, '/') THEN '/' || {joined} "
        f"WHEN {joined} = '' THEN '.' ELSE {joined} END)"
    )


def iso(ms: str) -> str:
    return f"strftime(make_timestamp_ms({ms}), '%Y-%m-%dT%H:%M:%S')"


DOC = """doc AS (
  SELECT doc_id, text, lang, source, n_chars,
    'm' || lpad(CAST(doc_id AS VARCHAR), 20, '0') AS id, sha256(text) AS digest,
    (CASE WHEN doc_id % 29 = 0 THEN '.' ELSE '' END)
    || (CASE doc_id % 3 WHEN 0 THEN 'IMG_' WHEN 1 THEN 'img_' ELSE 'Clip-' END)
    || CAST(doc_id % 997 AS VARCHAR)
    || (['.JPG', '.png', '.jpeg', '.HEIC', '.mp4', '.MOV', '.tif', '.m2ts', '.gif', '', '.txt',
         '.tar.gz', '.'])[CAST(doc_id % 13 AS INTEGER) + 1] AS file_name,
    CASE WHEN doc_id % 11 <> 0 THEN 1500000000000 + doc_id * 7919 % 100003 * 3600000 END AS wall_ms,
    CAST(CASE doc_id % 4 WHEN 1 THEN 3600 WHEN 2 THEN -16200 WHEN 3 THEN 20700 END AS INTEGER) AS utc_offset,
    CASE WHEN doc_id % 17 <> 0 THEN 1600000000000 + doc_id % 211 * 86400000 END AS last_modified_ms,
    CASE WHEN doc_id % 31 = 0 THEN -1 ELSE n_chars END AS size_bytes
  FROM documents)"""

MEDIA = f"""{DOC}, media AS (
  SELECT id, 'sha256' AS fingerprint_algorithm, digest AS fingerprint_digest,
    '/library/' || source || '/' || file_name AS absolute_path,
    CASE WHEN doc_id % 2 = 0 THEN 'vol-1' ELSE '' END AS volume_id,
    CAST(doc_id AS VARCHAR) AS file_id, size_bytes, last_modified_ms,
    {kind('file_name')} AS kind, file_name, {extension('file_name')} AS file_extension,
    '/library/' || source AS folder_path, coalesce(wall_ms, {NO_KEY}) AS capture_sort_key,
    CAST(utc_offset IS NOT NULL AS INTEGER) AS capture_has_offset, 'Make ' || lang AS camera_make,
    CASE WHEN doc_id % 8 = 0 THEN '' ELSE 'Model' END AS camera_model,
    CAST(doc_id % 5000 - 5 AS INTEGER) AS pixel_width, CAST(doc_id % 3000 - 5 AS INTEGER) AS pixel_height,
    n_chars * 10 - 500 AS duration_ms, CAST(doc_id % 9 - 2 AS INTEGER) AS rating, text AS caption,
    CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id % 200 - 99 AS DOUBLE) END AS latitude,
    CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id % 380 - 190 AS DOUBLE) END AS longitude,
    doc_id, lang, source
  FROM doc)"""

EVENTS = """ev AS (
  SELECT '/roots/' || CAST(user_id AS VARCHAR) AS root,
    CASE event_type WHEN 'signup' THEN 'created' WHEN 'click' THEN 'modified'
      WHEN 'view' THEN 'renamedFrom' WHEN 'purchase' THEN 'renamedTo' ELSE 'overflow' END AS kind,
    CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS rename_cookie,
    (epoch_us(ts) // 1000) AS t, event_id AS seq
  FROM events)"""

REQUESTS = """job AS (
  SELECT 'w' || lpad(CAST(event_id AS VARCHAR), 20, '0') AS id,
    (['scanRoot', 'reconcileRoot', 'readMetadata', 'generateThumbnail'])[CAST(event_id % 4 AS INTEGER) + 1] AS kind,
    CAST(event_id % 4 AS INTEGER) AS priority,
    (['pending', 'running', 'pending', 'succeeded', 'failed', 'cancelled'])[CAST(event_id % 6 AS INTEGER) + 1] AS state,
    CASE WHEN event_id % 3 = 0 THEN '' ELSE 'key-' || CAST(user_id AS VARCHAR) END AS coalescing_key,
    CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 AS INTEGER) AS attempts,
    CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 + 1 AS INTEGER) AS max_attempts,
    CASE WHEN event_id % 13 <> 0 THEN (epoch_us(ts) // 1000) END AS created_at_ms,
    CASE WHEN event_id % 5 = 0 THEN (epoch_us(ts) // 1000) + 3600000 END AS not_before_ms,
    (['none', 'timeout', 'corruptData', 'interrupted', 'storageUnavailable'])[CAST(event_id % 5 AS INTEGER) + 1] AS last_error_code,
    event_id, user_id
  FROM events)"""

CACHE = """entry AS (
  SELECT 'sha256-' || sha256(CAST(l_partkey AS VARCHAR)) || '/thumbnail/' || CAST(l_linenumber * 64 AS VARCHAR)
      || 'x' || CAST(l_linenumber * 64 AS VARCHAR) || '/' || CAST(l_orderkey AS VARCHAR) || '/r'
      || CAST(l_suppkey AS VARCHAR) AS cache_key,
    CASE WHEN max(l_quantity) <= 2 THEN 0 ELSE CAST(max(l_quantity) * 100 AS BIGINT) END AS size_bytes,
    (epoch_us(max(l_shipdate)) // 1000) AS last_modified_ms
  FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber)"""
