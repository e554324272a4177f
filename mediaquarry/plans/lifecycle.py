"""A folder to a queryable catalogue: one rescan as Spark jobs end to end."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions.paths import (
    base_name, clean_path, indexable, kind_from_extension, managed_path, parent_dir, within_root,
)
from ..operators import projection, reconcile as rec, versions
from ..operators.resolve import Extraction
from ..session import cut_lineage
from ..sources.containers import read_heads
from ..sources.listing import folder_exists, hash_files, scan_listing

_RECIPE = "struct<revision:int,operations:array<struct<kind:string,parameters:string>>>"


@dataclass
class Rescan:
    """What a rescan did: counts, and everything a user has to know about."""

    version: str | None
    summary: DataFrame
    warnings: DataFrame


def committed_records(spark: SparkSession, store: str) -> DataFrame:
    try:
        return versions.read_version(spark, store)
    except FileNotFoundError:
        return spark.createDataFrame([], schemas.RECORD)


def listed_files(spark: SparkSession, root: str, follow_symlinks: bool = False) -> DataFrame:
    """The listing with ``indexable``; only names without a media extension are opened for it."""
    listing = scan_listing(spark, root, follow_symlinks).withColumn("path", clean_path(F.col("path")))
    named = kind_from_extension(F.col("file_name")) != "unknown"
    probed = read_heads(listing.where(~named)).withColumn(
        "container", F.coalesce("container", F.lit("unknown"))
    )
    known = listing.where(named).withColumn("container", F.lit("unknown"))
    return cut_lineage(known.unionByName(probed).withColumn(
        "indexable", indexable(F.col("path"), F.col("container"))
    ).drop("container"))


def _default_metadata(path):
    text = F.lit("")
    return F.struct(
        kind_from_extension(base_name(path)).alias("kind"), base_name(path).alias("file_name"),
        parent_dir(path).alias("folder_path"), F.lit(None).alias("capture_time"),
        F.lit("unknown").alias("capture_time_origin"), text.alias("camera_make"),
        text.alias("camera_model"), text.alias("lens_model"), F.lit(0).alias("pixel_width"),
        F.lit(0).alias("pixel_height"), F.lit(0).alias("rotation_degrees"),
        F.lit(0).alias("duration_ms"), F.lit(False).alias("has_audio"), F.lit(None).alias("location"),
        F.lit(0).alias("rating"), text.alias("caption"), F.array().alias("tags"),
        F.array().alias("conflicts"),
    ).cast(schemas.METADATA)


def staged_records(
    outcomes: DataFrame, files: DataFrame, records: DataFrame, metadata: DataFrame
) -> DataFrame:
    """Full rows of the added, updated and moved files.

    Metadata that could be read replaces the old one; otherwise the old one stays, and a new file
    gets its kind from the extension. Name and folder always follow the file.
    """
    touched = outcomes.where("class IN ('added', 'updated', 'moved')").select("id", "path", "digest")
    old = records.select(
        "id", F.col("metadata").alias("old_metadata"), F.col("recipe").alias("old_recipe"),
        F.col("derivative").alias("old_derivative"), F.col("extras").alias("old_extras"),
    )
    facts = files.select("path", "size_bytes", "last_modified_ms")
    chosen = F.coalesce("metadata", "old_metadata", _default_metadata(F.col("path")))
    return (
        touched.join(facts, "path").join(metadata.select("path", "metadata"), "path", "left")
        .join(old, "id", "left").select(
            "id",
            F.struct(F.lit("sha256").alias("algorithm"), "digest").alias("fingerprint"),
            F.struct(
                F.col("path").alias("absolute_path"), F.lit("").alias("volume_id"),
                F.lit("").alias("file_id"), "size_bytes", "last_modified_ms",
            ).alias("identity"),
            F.lit("managed").alias("original_storage"),
            managed_path(F.col("id"), F.col("digest"), base_name(F.col("path"))).alias("managed_original_path"),
            chosen.withField("file_name", base_name(F.col("path")))
            .withField("folder_path", parent_dir(F.col("path"))).alias("metadata"),
            F.coalesce("old_recipe", F.struct(F.lit(0).alias("revision"), F.array().alias("operations")).cast(_RECIPE))
            .alias("recipe"),
            F.col("old_derivative").alias("derivative"),
            F.coalesce("old_extras", F.create_map().cast("map<string,string>")).alias("extras"),
        )
    )


def rescan(spark: SparkSession, root: str, store: str, follow_symlinks: bool = False) -> Rescan:
    """List, compare, hash only what changed, match moves, read metadata, commit.

    A scan that changes nothing commits nothing, and a missing root is an error, not an empty
    folder.
    """
    if not folder_exists(spark, root):
        raise FileNotFoundError(f"no folder {root}")
    files = listed_files(spark, root, follow_symlinks)
    records = committed_records(spark, store)
    under = records.where(within_root(F.col("identity.absolute_path"), F.lit(root)))
    known = under.select(
        "id", clean_path(F.col("identity.absolute_path")).alias("path"),
        F.col("fingerprint.digest").alias("digest"), "identity.size_bytes", "identity.last_modified_ms",
        (F.col("original_storage") == "managed").alias("managed"),
    )
    hashed = cut_lineage(hash_files(rec.needs_fingerprint(files, known)))
    outcomes = rec.reconcile(files, known, hashed)
    touched = outcomes.where("class IN ('added', 'updated', 'moved')").select("path")
    sidecars = files.where(F.col("file_name").endswith(".xmp")).select("path")
    extraction = Extraction.of_files(files.join(touched, "path", "left_semi"), sidecars)
    staged = staged_records(outcomes, files, records, extraction.metadata())
    tombstones = outcomes.where("class = 'removed'").select("id")
    try:
        version = versions.commit(spark, store, staged, tombstones, uuid.uuid4().hex)
    except versions.Conflict:
        version = None
    unread = rec.scan_warnings(outcomes, hashed).select(
        "path", F.lit("warning").alias("severity"), "code", F.lit("Cannot read file").alias("message")
    )
    return Rescan(version, rec.scan_summary(outcomes), unread.unionByName(extraction.problems()))


def refresh_projection(spark: SparkSession, store: str, target: str) -> bool:
    """Rebuild the projection if it does not vouch for the committed state; says whether it did."""
    pointer = projection.read_pointer(spark, store)
    current = pointer[1] if pointer else None
    if not projection.is_stale(projection.projected_state_token(spark, target), current):
        return False
    projection.build_projection(committed_records(spark, store), target, current)
    return True
