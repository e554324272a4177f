"""Backup manifests: what a folder holds, and whether a copy still matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions.paths import base_name, safe_archive_path


def backup_manifest(files: DataFrame, lock_name: str = "writer.lock") -> DataFrame:
    """``(path, content)`` → ``(path, size_bytes, sha256)`` by path, the lock file left out."""
    return files.where(base_name(F.col("path")) != lock_name).select(
        "path", F.octet_length("content").cast("bigint").alias("size_bytes"),
        F.sha2("content", 256).alias("sha256"),
    ).orderBy("path")


def check_manifest_size(manifest: DataFrame) -> DataFrame:
    """One row: the entry count, and whether an archive may hold that many."""
    return manifest.agg(F.count("*").alias("entries")).withColumn(
        "within_limit", F.col("entries") <= fv.MAX_ARCHIVE_ENTRIES
    )


def refuse_symlinks(listing: DataFrame) -> DataFrame:
    return listing.where("is_symlink").select("path", F.lit("conflict").alias("code"))


def manifest_verify(listed: DataFrame, present: DataFrame) -> DataFrame:
    """One row per path with ``status``: ``ok`` or the first thing wrong with it."""
    claims = listed.groupBy("path").agg(
        F.count("*").alias("claims"), F.min(F.struct("size_bytes", "sha256")).alias("want")
    )
    found = present.select("path", F.struct("size_bytes", "sha256").alias("got"))
    status = (
        F.when(F.col("want").isNull(), "unlisted")
        .when(~safe_archive_path(F.col("path")), "unsafe")
        .when(F.col("claims") > 1, "duplicate")
        .when(F.col("got").isNull(), "missing")
        .when(F.col("want.size_bytes") != F.col("got.size_bytes"), "size")
        .when(F.col("want.sha256") != F.col("got.sha256"), "digest")
        .otherwise("ok")
    )
    return claims.join(found, "path", "full_outer").select("path", status.alias("status"))
