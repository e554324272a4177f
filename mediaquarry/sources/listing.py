"""Folder listings, file bytes and digests, spread over the executors.

Spark's own file index hides names starting with ``.`` or ``_`` and follows links, so a listing
that must be exact walks the folders itself: one Spark pass per folder depth.
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..session import shared_dir, ship_package

_BATCH = 10_000
_CHUNK = 1 << 20
#: Bytes of whole files held before they are handed on, and the largest file read whole.
_READ, _LARGEST = 8 << 20, (1 << 31) - (1 << 16)
_FILE = {
    "path": pa.string(), "last_modified_ms": pa.int64(), "length": pa.int64(), "content": pa.binary(),
    "read_error": pa.string(),
}


def _list_folders(follow_symlinks: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder, linked in zip(batch["path"], batch["via_link"]):
                rows = []
                try:
                    with os.scandir(folder) as entries:
                        for entry in entries:
                            link = entry.is_symlink()
                            if link and not follow_symlinks:
                                continue
                            try:
                                stat, is_dir = entry.stat(), entry.is_dir()
                                size, ms = stat.st_size, stat.st_mtime_ns // 1_000_000
                                key = _folder_key(stat) if is_dir else None
                            except OSError:
                                is_dir, size, ms, key = False, -1, None, None
                            rows.append((entry.path, entry.name, is_dir, link, size, ms, key, linked or link))
                            if len(rows) >= _BATCH:
                                yield pd.DataFrame(rows, columns=_COLUMNS)
                                rows = []
                except OSError:
                    pass  # an unreadable folder is skipped
                yield pd.DataFrame(rows, columns=_COLUMNS)

    return run


_COLUMNS = [
    "path", "file_name", "is_directory", "is_symlink", "size_bytes", "last_modified_ms", "folder_key", "via_link",
]
_LEVEL = f"{schemas.LISTING}, folder_key string, via_link boolean"
_FOLDER = "path string, folder_key string, via_link boolean"


def _folder_key(stat: os.stat_result) -> str:
    """What a folder is, whatever path leads to it."""
    return f"{stat.st_dev}:{stat.st_ino}"


def _identified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keys = []
        for path in batch["path"]:
            try:
                keys.append(_folder_key(os.stat(path)))
            except OSError:
                keys.append(None)
        yield pd.DataFrame({"path": batch["path"], "folder_key": keys, "via_link": False})


def _to_walk(folders: DataFrame, walked: DataFrame) -> DataFrame:
    """The folders of one depth that are walked, given those of the depths above.

    Folders reached without a link are a tree and all of them are walked. One that a link leads to is
    walked once, by its smallest path, and not at all if any path has led to it before.
    """
    real = folders.where("NOT via_link")
    linked = folders.where("via_link").groupBy("folder_key").agg(F.min("path").alias("path"))
    known = walked.select("folder_key").unionByName(real.select("folder_key")).distinct()
    fresh = linked.join(known, "folder_key", "left_anti").withColumn("via_link", F.lit(True))
    return real.unionByName(fresh)


def _folder_flags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"found": [os.path.isdir(path) for path in batch["path"]]})


def folder_exists(spark: SparkSession, root: str) -> bool:
    """Asked in a task: the driver need not see the folder."""
    ship_package(spark)
    return spark.createDataFrame([(root,)], "path string").mapInPandas(_folder_flags, "found boolean").first()[0]


def scan_listing(spark: SparkSession, root: str, follow_symlinks: bool = False) -> DataFrame:
    """Every file under ``root``, hidden ones included; folders are walked, not listed.

    Each depth is written to the shared folder, so a lost executor never repeats the walk and the
    driver sees only whether another depth exists. Sort on ``path_order(path)`` for walking order.
    With ``follow_symlinks`` a folder behind links is walked once, so links to a folder above end; files
    below the root keep the rows of their own paths whatever links lead there too.
    """
    ship_package(spark)
    base = f"{shared_dir(spark)}/listing-{uuid.uuid4().hex}"
    width = spark.sparkContext.defaultParallelism
    frontier, depth = spark.createDataFrame([(root,)], "path string").mapInPandas(_identified, _FOLDER), 0
    while True:
        if follow_symlinks:
            frontier.write.parquet(f"{base}/walked/depth={depth:05d}")
            frontier = spark.read.schema(_FOLDER).parquet(f"{base}/walked/depth={depth:05d}")
        level = f"{base}/listed/depth={depth:05d}"
        spread = frontier.repartition(width) if depth else frontier
        spread.mapInPandas(_list_folders(follow_symlinks), _LEVEL).write.parquet(level)
        folders = spark.read.schema(_LEVEL).parquet(level).where("is_directory").select("path", "folder_key", "via_link")
        if folders.isEmpty():
            break
        frontier = _to_walk(folders, spark.read.schema(_FOLDER).parquet(f"{base}/walked")) if follow_symlinks else folders
        depth += 1
    return (
        spark.read.schema(schemas.LISTING).parquet(*[f"{base}/listed/depth={d:05d}" for d in range(depth + 1)])
        .where("NOT is_directory")
    )


def _read_whole(path: str) -> tuple:
    try:
        with open(path, "rb") as source:
            stat = os.fstat(source.fileno())
            if stat.st_size > _LARGEST:
                return path, None, stat.st_size, None, "tooLarge"
            content = source.read()
            return path, stat.st_mtime_ns // 1_000_000, len(content), content, None
    except FileNotFoundError:
        return path, None, None, None, "notFound"
    except OSError:
        return path, None, None, None, "permissionDenied"


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(_FILE)
        return pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, _FILE.values())], list(_FILE))

    for batch in batches:
        rows, held = [], 0
        for path in batch.column(0).to_pylist():
            rows.append(_read_whole(path))
            held += len(rows[-1][3] or b"")
            if held >= _READ:
                yield packed(rows)
                rows, held = [], 0
        yield packed(rows)


def read_files(paths: DataFrame) -> DataFrame:
    """``path`` of each row → ``(path, last_modified_ms, length, content, read_error)``, a row per path.

    ``read_error`` is NULL, ``notFound``, ``permissionDenied`` or ``tooLarge`` (beyond a binary
    value; ``hash_files`` streams such files). Few whole files are held at a time.
    """
    spark = paths.sparkSession
    ship_package(spark)
    wanted = paths.where("path IS NOT NULL").select("path").repartition(spark.sparkContext.defaultParallelism * 4)
    return wanted.mapInArrow(_read_batches, schemas.FILE)


def scan_binary(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """The rows of ``read_files`` for every file below ``folder``, hidden ones included.

    ``glob`` is held against the file name. Files without bytes stay as rows with ``read_error``.
    """
    listed = scan_listing(spark, folder)
    return read_files(listed.where(F.col("file_name").rlike(fnmatch.translate(glob))) if glob else listed)


def scan_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    return scan_binary(spark, folder, "*.xmp").where("read_error IS NULL").select("path", "content")


def read_errors(listing: DataFrame, read: DataFrame) -> DataFrame:
    """Listed files that gave no bytes, as warning rows; the scan goes on without them.

    The code is the ``read_error`` of the rows read, where they have one; a path that was not
    read at all is ``notFound``.
    """
    reason = F.col("read_error") if "read_error" in read.columns else F.lit(None).cast("string")
    told = read.select("path", F.coalesce(reason, F.lit("none")).alias("_code"))
    code = F.coalesce("_code", F.lit("notFound"))
    return listing.select("path").join(told, "path", "left").where(code != "none").select(
        "path", code.alias("code"), F.lit("Cannot read file").alias("message")
    )


def _hash_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path in batch["path"]:
            try:
                digest = hashlib.sha256()
                with open(path, "rb") as source:
                    while chunk := source.read(_CHUNK):
                        digest.update(chunk)
                rows.append((path, digest.hexdigest(), None))
            except FileNotFoundError:
                rows.append((path, None, "notFound"))
            except OSError:
                rows.append((path, None, "permissionDenied"))
        yield pd.DataFrame(rows, columns=["path", "digest", "read_error"])


def hash_files(paths: DataFrame) -> DataFrame:
    """SHA-256 of exactly these files, streamed in chunks inside the tasks.

    Content is read only for the paths handed in, which is what makes a rescan cheap, and a file
    of any size fits.
    """
    ship_package(paths.sparkSession)
    width = paths.sparkSession.sparkContext.defaultParallelism
    return paths.select("path").repartition(width * 4).mapInPandas(_hash_batches, schemas.HASHED)
