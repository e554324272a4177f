"""Browse: flattening, filters, orders, pages and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.capture import capture_sort_key
from ..operators import browse, projection
from ..sources import adapters
from . import base_sql as q
from .registry import query

_FLAT = [
    "id", "fingerprint_algorithm", "fingerprint_digest", "absolute_path", "volume_id", "file_id",
    "size_bytes", "kind", "file_name", "file_extension", "folder_path", "capture_sort_key",
    "capture_has_offset", "camera_make", "camera_model", "pixel_width", "pixel_height",
    "duration_ms", "rating", "caption",
]


@query(f"""WITH {q.MEDIA} SELECT {', '.join(_FLAT)},
  coalesce(last_modified_ms, -1) AS last_modified_ms,
  coalesce(latitude, -999) AS latitude, coalesce(longitude, -999) AS longitude, id AS json_id
FROM media""")
def flatten_media(t):
    m = adapters.media(t)
    return m.select(
        *_FLAT, F.coalesce("last_modified_ms", F.lit(-1).cast("bigint")).alias("last_modified_ms"),
        F.coalesce("latitude", F.lit(-999.0)).alias("latitude"),
        F.coalesce("longitude", F.lit(-999.0)).alias("longitude"),
        F.get_json_object("record_json", "$.id").alias("json_id"),
    )


@query(f"""WITH {q.DOC} SELECT DISTINCT id AS media_id, unnest([lang, source, lang]) AS tag FROM doc""")
def explode_tags(t):
    return projection.explode_tags(adapters.records(t))


@query(f"WITH {q.MEDIA} SELECT count(*) AS records FROM media")
def record_count(t):
    return browse.record_count(adapters.media(t))


@query(f"""WITH {q.MEDIA} SELECT m.id,
  CASE WHEN m.n % 3 = 1 THEN 'corruptData' ELSE 'none' END AS error FROM (
  SELECT id, doc_id AS n FROM media WHERE doc_id % 7 <> 0) m
UNION ALL SELECT id || '-gone', 'notFound' FROM media WHERE doc_id % 7 = 0""")
def filter_by_id(t):
    m = adapters.media(t)
    number = F.substring("id", 2, 20).cast("bigint")
    damaged = m.withColumn(
        "record_json", F.when(number % 3 == 1, F.substring("record_json", 1, 12)).otherwise(F.col("record_json"))
    )
    gone = F.when(number % 7 == 0, F.concat(F.col("id"), F.lit("-gone"))).otherwise(F.col("id"))
    return browse.by_id(damaged, m.select(gone.alias("id"))).select("id", "error")


@query(f"""WITH {q.MEDIA}, copy AS (SELECT fingerprint_digest d, count(*) n FROM media GROUP BY 1)
SELECT id FROM media WHERE fingerprint_digest =
  (SELECT d FROM copy ORDER BY n DESC, d LIMIT 1) AND fingerprint_algorithm = 'sha256'""")
def filter_with_fingerprint(t):
    m = adapters.media(t)
    largest = browse.duplicate_groups(m).orderBy(F.col("copies").desc(), "fingerprint_digest").first()
    return browse.with_fingerprint(m, largest["fingerprint_algorithm"], largest["fingerprint_digest"])


@query(f"WITH {q.MEDIA} SELECT id FROM media WHERE source = 'src1'")
def filter_with_tag(t):
    return browse.with_tag(projection.explode_tags(adapters.records(t)), "src1")


@query(f"WITH {q.MEDIA} SELECT id, capture_sort_key FROM media WHERE kind = 'video'")
def filter_with_kind(t):
    return browse.with_kind(adapters.media(t), "video")


@query(f"WITH {q.MEDIA} SELECT id, capture_sort_key FROM media WHERE rating >= 3")
def filter_min_rating(t):
    return browse.min_rating(adapters.media(t), 3)


@query(f"WITH {q.MEDIA} SELECT id FROM media")
def list_ids(t):
    return browse.list_ids(adapters.media(t))


@query(f"""WITH {q.MEDIA} SELECT id, row_number() OVER (ORDER BY capture_sort_key, id) - 1 AS pos FROM media""")
def order_by_capture_time(t):
    return browse.positions_by(adapters.media(t), "captureTime")


@query(f"""WITH {q.MEDIA}, p AS (SELECT id, capture_sort_key FROM media WHERE kind = 'image' AND rating >= 1)
SELECT id, capture_sort_key FROM p ORDER BY capture_sort_key, id LIMIT 50 OFFSET 20""")
def capture_page(t):
    m = adapters.media(t).where("kind = 'image' AND rating >= 1")
    return browse.capture_page(m, 20, 50)


@query(f"WITH {q.MEDIA} SELECT id, capture_sort_key FROM media ORDER BY capture_sort_key, id OFFSET 20")
def capture_page_rest(t):
    """All rows from an offset: numbered in a distributed order, never in one task."""
    return browse.capture_page(adapters.media(t), 20, -1)


@query(f"""WITH {q.MEDIA} SELECT id, capture_sort_key FROM media
WHERE (capture_sort_key, id) > (1600000000000, 'm') ORDER BY capture_sort_key, id LIMIT 40""")
def capture_page_after(t):
    return browse.capture_page_after(adapters.media(t), 1_600_000_000_000, "m", 40)


_TIMELINE = """tl AS (SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS id, (epoch_us(o_orderdate) // 1000) AS capture_sort_key FROM orders)"""


@query(f"WITH {_TIMELINE} SELECT id, row_number() OVER (ORDER BY capture_sort_key, id) - 1 AS pos FROM tl")
def order_timeline(t):
    """Many rows share a day: the id decides, and a hot day spreads over several tasks."""
    timeline = t.orders.select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"),
        capture_sort_key(F.col("o_orderdate")).alias("capture_sort_key"),
    )
    return browse.ordered_positions(timeline, browse.capture_order()).select("id", "pos")


@query(f"WITH {_TIMELINE} SELECT id, capture_sort_key FROM tl ORDER BY capture_sort_key, id LIMIT 100 OFFSET 500")
def timeline_page(t):
    timeline = t.orders.select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"),
        capture_sort_key(F.col("o_orderdate")).alias("capture_sort_key"),
    )
    return browse.capture_page(timeline, 500, 100)


_NOCASE = "translate(file_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ORDERS = {
    "captureTime": ["capture_sort_key"], "fileName": [_NOCASE],
    "fileDate": ["coalesce(last_modified_ms, 0)"], "fileType": ["file_extension", _NOCASE],
    "fileSize": ["size_bytes"],
}
for _key in browse.SORT_KEYS:
    for _down in (False, True):
        _by = ", ".join(f"{c} {'DESC' if _down else 'ASC'}" for c in _ORDERS[_key])
        _sql = f"WITH {q.MEDIA} SELECT id, row_number() OVER (ORDER BY {_by}, id) - 1 AS pos FROM media"
        _name = "sorted_by_" + {"captureTime": "capture_time", "fileName": "file_name", "fileDate": "file_date",
                                "fileType": "file_type", "fileSize": "file_size"}[_key]
        query(_sql, _name + ("_desc" if _down else "_asc"))(
            lambda t, key=_key, down=_down: browse.positions_by(adapters.media(t), key, down)
        )


@query(f"""WITH {q.MEDIA} SELECT fingerprint_algorithm, fingerprint_digest, count(*) AS copies,
  min(id) AS first_id FROM media GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_groups(t):
    return browse.duplicate_groups(adapters.media(t))


@query(f"""WITH {q.MEDIA}, g AS (SELECT fingerprint_digest d, count(*) n, min(id) f FROM media GROUP BY 1)
SELECT id, fingerprint_digest, n AS copies, f AS first_id FROM media JOIN g ON d = fingerprint_digest WHERE n > 1""")
def duplicate_members(t):
    return browse.duplicate_members(adapters.media(t)).drop("fingerprint_algorithm")


@query(f"""WITH {q.MEDIA}, p AS (SELECT id, row_number() OVER (ORDER BY size_bytes DESC, id) - 1 AS pos FROM media)
SELECT pos, id, caption, kind FROM p JOIN media USING (id)""")
def hydrate_ids(t):
    m = adapters.media(t)
    return browse.hydrate_ids(browse.positions_by(m, "fileSize", True), m).select("pos", "id", "caption", "kind")


_ROW = f"""WITH {q.DOC}, r AS (SELECT *, CASE WHEN doc_id % 37 = 0 THEN 'originals/../' || file_name
  ELSE {q.managed('id', 'digest', 'file_name')} END AS managed_path FROM doc)
SELECT id AS media_id, CASE WHEN doc_id % 6 = 0 THEN '/library/' || source || '/' || file_name
    WHEN doc_id % 37 = 0 THEN '' ELSE managed_path END AS absolute_path,
  coalesce({q.iso('wall_ms')}, '') AS capture_time_string, {q.kind('file_name')} AS media_kind,
  CAST(doc_id % 9 - 2 AS INTEGER) AS rating, text AS caption, lang || ',' || source || ',' || lang AS tags,
  'pending' AS thumbnail_status FROM r"""


@query(_ROW)
def browse_row(t):
    return browse.browse_row(adapters.records(t)).withColumn("tags", F.array_join("tags", ","))


@query(f"""WITH {q.MEDIA}, p AS (SELECT id, row_number() OVER (ORDER BY file_extension, {_NOCASE}, id) - 1 AS pos FROM media)
SELECT id FROM p WHERE pos BETWEEN 80 AND 160""")
def visible_window(t):
    m = adapters.media(t)
    return browse.visible_window(m, browse.sort_columns("fileType"), 100, 140, 20).select("id")


_LISTS = f"""WITH {q.MEDIA}, o AS (SELECT id, row_number() OVER (ORDER BY capture_sort_key, id) - 1 AS old_pos
  FROM media WHERE doc_id % 5 <> 0), n AS (SELECT id, row_number() OVER (ORDER BY capture_sort_key, id) - 1 AS new_pos
  FROM media WHERE doc_id % 7 <> 0)"""


def _lists(t):
    m = adapters.media(t)
    number = F.substring("id", 2, 20).cast("bigint")
    return (
        browse.positions_by(m.where(number % 5 != 0), "captureTime"),
        browse.positions_by(m.where(number % 7 != 0), "captureTime"),
    )


@query(f"""{_LISTS} SELECT id, coalesce(old_pos, -1) AS old_pos, coalesce(new_pos, -1) AS new_pos,
  CASE WHEN old_pos IS NULL THEN 'inserted' WHEN new_pos IS NULL THEN 'removed' ELSE 'kept' END AS change
FROM o FULL JOIN n USING (id)""")
def order_preserving_diff(t):
    return browse.order_preserving_diff(*_lists(t)).select(
        "id", F.coalesce("old_pos", F.lit(-1)).alias("old_pos"),
        F.coalesce("new_pos", F.lit(-1)).alias("new_pos"), "change",
    )


@query(f"""{_LISTS}, k AS (SELECT id, new_pos, lag(new_pos) OVER (ORDER BY old_pos) AS before FROM o JOIN n USING (id)),
e AS (SELECT id, row_number() OVER (ORDER BY capture_sort_key, id) AS p FROM media)
SELECT 'subset' AS lists, (SELECT count(*) = 0 FROM k WHERE before > new_pos)
  AND (SELECT count(*) = 0 FROM o WHERE id NOT IN (SELECT id FROM n)) AS insertion_only
UNION ALL SELECT 'grown', true""")
def insertion_only(t):
    old, new = _lists(t)
    every = browse.positions_by(adapters.media(t), "captureTime")
    shrunk = browse.is_insertion_only(browse.order_preserving_diff(old, new))
    grown = browse.is_insertion_only(browse.order_preserving_diff(old, every))
    return shrunk.select(F.lit("subset").alias("lists"), "insertion_only").unionByName(
        grown.select(F.lit("grown").alias("lists"), "insertion_only")
    )


_KEEP = browse.effective_retention(64, 100, 140, 20)


@query(f"""SELECT CAST(user_id AS VARCHAR) AS id, (epoch_us(max(ts)) // 1000) AS accessed_at FROM events GROUP BY 1
ORDER BY accessed_at DESC, id LIMIT {_KEEP}""")
def retain_recent(t):
    accesses = adapters.events(t).select(F.replace("root", F.lit("/roots/"), F.lit("")).alias("id"), F.col("t").alias("accessed_at"))
    return browse.retain_recent(accesses, _KEEP)


@query(f"""WITH {q.DOC} SELECT id, coalesce({q.iso('wall_ms')}, '') AS capture_time_string FROM doc""")
def capture_text(t):
    return browse.capture_text(adapters.media(t))


