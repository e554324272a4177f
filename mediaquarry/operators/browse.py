"""Filters, orders, pages and windows over the ``media`` projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions.capture import from_wall_clock_ms, iso_text
from ..functions.paths import original_path
from ..functions.values import is_json_object
from .ordering import join_spread, ordered_positions, with_previous


def nocase(text: Column) -> Column:
    """ASCII-only case folding; letters beyond ASCII keep their order."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def capture_order() -> list[Column]:
    return [F.col("capture_sort_key"), F.col("id")]


def sort_columns(key: str, descending: bool = False) -> list[Column]:
    """Every sort column follows the direction; ``id`` always ascends."""
    keys = {
        "captureTime": [F.col("capture_sort_key")],
        "fileName": [nocase(F.col("file_name"))],
        "fileDate": [F.coalesce(F.col("last_modified_ms"), F.lit(0))],
        "fileType": [F.col("file_extension"), nocase(F.col("file_name"))],
        "fileSize": [F.col("size_bytes")],
    }
    return [c.desc() if descending else c.asc() for c in keys[key]] + [F.col("id").asc()]


SORT_KEYS = ("captureTime", "fileName", "fileDate", "fileType", "fileSize")


def choose_sort(wanted: str, current: str) -> str:
    """An unknown key keeps the previous choice."""
    return wanted if wanted in SORT_KEYS else current


def sorted_by(media: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """Ids in order. Sort keys travel, the wide record does not."""
    order = sort_columns(key, descending)
    return media.orderBy(*order).select("id")


def positions_by(media: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """The same order as an explicit position column, for joins and paging by position."""
    narrow = media.select("id", "capture_sort_key", "file_name", "file_extension", "last_modified_ms", "size_bytes")
    return ordered_positions(narrow, sort_columns(key, descending)).select("id", "pos")


def list_ids(media: DataFrame) -> DataFrame:
    return media.select("id").orderBy("id")


def by_capture_time(media: DataFrame) -> DataFrame:
    return media.select("id", "capture_sort_key").orderBy(*capture_order())


#: Pages that end within so many rows are a top-k; deeper ones are cut out of numbered rows.
TOP_ROWS = 10_000


def _slice(rows: DataFrame, order: list[Column], start: int, count: int | None) -> DataFrame:
    """``count`` rows from ``start`` of an order, ``None`` for the rest, in that order.

    Neither one task nor the driver ever sees more than ``TOP_ROWS`` rows of it.
    """
    if count is not None and start + count <= TOP_ROWS:
        return rows.orderBy(*order).offset(start).limit(count)
    if start == 0 and count is None:
        return rows.orderBy(*order)
    at = F.col("_pos")
    within = at >= start if count is None else at.between(start, start + count - 1)
    return ordered_positions(rows, order, "_pos").where(within).orderBy("_pos").drop("_pos")


def capture_page(media: DataFrame, offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` … ``offset + limit`` by capture time; a negative limit means the rest.

    ``capture_page_after`` is the way to go on from a known row without numbering what is before.
    """
    rows = media.select("id", "capture_sort_key")
    return _slice(rows, capture_order(), max(0, offset), limit if limit >= 0 else None)


def capture_page_after(media: DataFrame, key: int, media_id: str, limit: int) -> DataFrame:
    """The page behind a known row. The bound is pushed to the scan, so depth costs nothing."""
    later = (F.col("capture_sort_key") > key) | (
        (F.col("capture_sort_key") == key) & (F.col("id") > media_id)
    )
    narrow = media.select("id", "capture_sort_key")
    return narrow.where(F.col("capture_sort_key") >= key).where(later).orderBy(*capture_order()).limit(limit)


def by_id(media: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each wanted id with its record, or why there is none."""
    found = wanted.select("id").distinct().join(media.select("id", "record_json"), "id", "left")
    return found.select(
        "id",
        F.when(F.col("record_json").isNull(), "notFound")
        .when(~is_json_object(F.col("record_json")), "corruptData").otherwise("none").alias("error"),
        "record_json",
    )


def with_fingerprint(media: DataFrame, algorithm: str, digest: str) -> DataFrame:
    same = (F.col("fingerprint_algorithm") == algorithm) & (F.col("fingerprint_digest") == digest)
    return media.where(same).select("id").orderBy("id")


def with_tag(media_tag: DataFrame, tag: str) -> DataFrame:
    return media_tag.where(F.col("tag") == tag).select(F.col("media_id").alias("id")).orderBy("id")


def with_kind(media: DataFrame, kind: str) -> DataFrame:
    return media.where(F.col("kind") == kind).select("id", "capture_sort_key").orderBy(*capture_order())


def min_rating(media: DataFrame, rating: int) -> DataFrame:
    return media.where(F.col("rating") >= rating).select("id", "capture_sort_key").orderBy(*capture_order())


def record_count(media: DataFrame) -> DataFrame:
    return media.agg(F.count("*").alias("records"))


def duplicate_groups(media: DataFrame) -> DataFrame:
    """Digest groups with more than one record: the group and its size.

    Members are rows, not one growing list: see ``duplicate_members``.
    """
    return (
        media.groupBy("fingerprint_algorithm", "fingerprint_digest")
        .agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))
        .where("copies > 1")
    )


def duplicate_members(media: DataFrame) -> DataFrame:
    """Every record of a duplicate group, one row each, so a hot group stays spread."""
    key = ["fingerprint_algorithm", "fingerprint_digest"]
    return join_spread(media.select("id", *key), duplicate_groups(media), key, ["id"])


def hydrate_ids(positions: DataFrame, media: DataFrame) -> DataFrame:
    """``(pos, id)`` → full rows in that order. Join late so wide rows move once."""
    return positions.join(media, "id").orderBy("pos")


def browse_row(records: DataFrame) -> DataFrame:
    """The display fields of an item."""
    m = F.col("metadata")
    path = original_path(
        F.col("original_storage"), F.col("identity.absolute_path"), F.col("managed_original_path")
    )
    return records.select(
        F.col("id").alias("media_id"), F.coalesce(path, F.lit("")).alias("absolute_path"),
        iso_text(m["capture_time"]["wall_clock"]).alias("capture_time_string"),
        m["kind"].alias("media_kind"), m["rating"].alias("rating"), m["caption"].alias("caption"),
        m["tags"].alias("tags"), F.lit("pending").alias("thumbnail_status"),
    )


def capture_text(media: DataFrame) -> DataFrame:
    present = F.col("capture_sort_key") != fv.NO_CAPTURE_KEY
    stamp = iso_text(from_wall_clock_ms(F.col("capture_sort_key")))
    return media.select("id", F.when(present, stamp).otherwise("").alias("capture_time_string"))


def visible_window(
    media: DataFrame, order: list[Column], first: int, last: int, margin: int
) -> DataFrame:
    """Rows ``first`` … ``last`` of an order with ``margin`` rows on both sides.

    Clamping to the end follows from the limit; only the window leaves the executors.
    """
    start = max(0, first - margin)
    rows = max(0, last) + margin + 1 - start
    return _slice(media, order, start, max(0, rows))


def effective_retention(limit: int, first: int, last: int, margin: int) -> int:
    if first < 0 or last < first:
        return limit
    return max(limit, last - first + 1 + 2 * margin + fv.RETENTION_SLACK)


def retain_recent(accesses: DataFrame, keep: int) -> DataFrame:
    """``(id, accessed_at)`` events → the ``keep`` most recently used ids."""
    latest = accesses.groupBy("id").agg(F.max("accessed_at").alias("accessed_at"))
    return latest.orderBy(F.col("accessed_at").desc(), F.col("id")).limit(keep)


def order_preserving_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(id, pos)`` before and after → every id as ``kept``, ``inserted`` or ``removed``."""
    o, n = old.select("id", F.col("pos").alias("old_pos")), new.select("id", F.col("pos").alias("new_pos"))
    change = (
        F.when(F.col("old_pos").isNull(), "inserted")
        .when(F.col("new_pos").isNull(), "removed").otherwise("kept")
    )
    return o.join(n, "id", "full_outer").select("id", "old_pos", "new_pos", change.alias("change"))


def is_insertion_only(diff: DataFrame) -> DataFrame:
    """One row: the old list is a subsequence of the new one.

    True when nothing was removed and, in the order of the old list, no kept id lies in the new one
    before the kept id ahead of it. One distributed sort; no window sees the whole list.
    """
    old = diff.where("change <> 'inserted'").select("change", "old_pos", "new_pos")
    followed = with_previous(old, [F.col("old_pos")], ["new_pos"])
    # A removed id refuses by itself, so a missing position before a kept id need not be bridged.
    refused = (F.col("change") == "removed") | (F.col("previous.new_pos") > F.col("new_pos"))
    return followed.agg((F.count_if(refused) == 0).alias("insertion_only"))
