"""Versioned record tables: upsert, commit, restore, edits and checkpoint history."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.paths import base_name, supports_embedded_write
from ..functions.values import clamp_rating, encode_provenance, normalize_metadata, provenance
from ..session import cut_lineage
from .ordering import with_previous
from .projection import read_pointer, token_after, write_pointer


class Conflict(Exception):
    """A whole batch was refused; nothing was written."""


def last_per_id(batch: DataFrame, order: str) -> DataFrame:
    """The last row per id of a batch, by a map-side combined maximum."""
    rest = [c for c in batch.columns if c not in ("id", order)]
    return batch.groupBy("id").agg(F.max_by(F.struct(*rest), order).alias("_r")).select("id", "_r.*")


def _only_row(batch: DataFrame) -> DataFrame:
    """The batch, refused where an id occurs twice: without an order no row is the last."""
    rest = [c for c in batch.columns if c != "id"]
    twice = F.raise_error(F.lit("a repeated id needs an order"))
    grouped = batch.groupBy("id").agg(F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_r"))
    return grouped.select("id", F.when(F.col("_n") > 1, twice).otherwise(F.col("_r")).alias("_r")).select("id", "_r.*")


def _latest(batch: DataFrame, order: str | None) -> DataFrame:
    return last_per_id(batch, order) if order else _only_row(batch)


def apply_records(base: DataFrame, batch: DataFrame, order: str | None = None) -> DataFrame:
    """Upsert: rows of the batch replace rows with the same id; applying twice changes nothing.

    With ``order``, the last row of an id wins; without it a repeated id is refused.
    """
    latest = _latest(batch, order)
    return base.join(latest.select("id"), "id", "left_anti").unionByName(latest)


def apply_with_token(
    base: DataFrame, batch: DataFrame, token: str, order: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """``apply_records`` beside the state token of its result, made from ``token``, that of ``base``.

    Of ``base`` the new token reads only the rows that the batch replaces.
    """
    latest = cut_lineage(_latest(batch, order))
    replaced = base.join(latest.select("id"), "id", "left_semi")
    return base.join(latest.select("id"), "id", "left_anti").unionByName(latest), token_after(token, replaced, latest)


def commit_staged(committed: DataFrame, staged: DataFrame, tombstones: DataFrame, order: str | None = None) -> DataFrame:
    """Committed rows minus tombstones plus staged rows; a row in both survives as staged.

    A repeated staged id is treated as by ``apply_records``.
    """
    touched = tombstones.select("id").unionByName(staged.select("id"))
    return committed.join(touched, "id", "left_anti").unionByName(_latest(staged, order))


# --- committed versions ---------------------------------------------------------------------
#
# A version is a small manifest: one base folder and the deltas committed since. A commit writes
# only its own rows, so its cost follows the change and not the table; reading lays the deltas
# over the base. ``fold`` writes a new base when reading should not lay over many deltas any more.


def _write_manifest(spark: SparkSession, root: str, base: str, deltas: list[str], token: str) -> str:
    version = f"version-{uuid.uuid4().hex}"
    line = json.dumps({"base": base, "deltas": deltas, "token": token})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{root}/manifests/{version}")
    write_pointer(spark, root, version, token)
    return version


def _manifest(spark: SparkSession, root: str, version: str | None) -> dict | None:
    if version is None:
        pointer = read_pointer(spark, root)
        if pointer is None:
            return None
        version = pointer[0]
    return json.loads(spark.read.text(f"{root}/manifests/{version}").first()[0])


def publish_version(table: DataFrame, root: str, token: str = "") -> str:
    """Write the whole table as a new base, then swap the pointer: readers see all of it or none."""
    base = f"base-{uuid.uuid4().hex}"
    table.write.parquet(f"{root}/{base}")
    return _write_manifest(table.sparkSession, root, base, [], token)


def read_version(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """The committed rows. The base is only filtered by the changed ids, which are few."""
    manifest = _manifest(spark, root, version)
    if manifest is None:
        raise FileNotFoundError(f"nothing committed under {root}")
    base = spark.read.parquet(f"{root}/{manifest['base']}")
    if not manifest["deltas"]:
        return base
    layers = [
        spark.read.parquet(f"{root}/{folder}").withColumn("_seq", F.lit(number))
        for number, folder in enumerate(manifest["deltas"])
    ]
    changes = last_per_id(reduce(DataFrame.unionByName, layers), "_seq")
    kept = changes.where("NOT _deleted").select(base.columns)
    return base.join(changes.select("id"), "id", "left_anti").unionByName(kept)


def commit(
    spark: SparkSession, root: str, staged: DataFrame, tombstones: DataFrame,
    token: str | None = "",
) -> str:
    """Commit staged rows and tombstones onto the current version; ``token=None`` keeps the token.

    An empty commit is a conflict, not a new version. A row in both survives as staged.
    """
    gone = tombstones.select("id").join(staged.select("id"), "id", "left_anti")
    empty = [
        F.lit(None).cast(field.dataType).alias(field.name) for field in staged.schema if field.name != "id"
    ]
    delta = staged.withColumn("_deleted", F.lit(False)).unionByName(
        gone.select("id", *empty, F.lit(True).alias("_deleted"))
    )
    folder = f"delta-{uuid.uuid4().hex}"
    delta.write.parquet(f"{root}/{folder}")
    if spark.read.parquet(f"{root}/{folder}").isEmpty():
        raise Conflict("nothing is staged")
    now = _manifest(spark, root, None)
    if now is None:
        first = spark.read.parquet(f"{root}/{folder}").where("NOT _deleted").drop("_deleted")
        return publish_version(first, root, token or "")
    token = now["token"] if token is None else token
    return _write_manifest(spark, root, now["base"], [*now["deltas"], folder], token)


def fold(spark: SparkSession, root: str) -> str:
    """Write the current version as one new base without deltas; to be run beside the commits."""
    now = _manifest(spark, root, None)
    if now is None:
        raise FileNotFoundError(root)
    return publish_version(read_version(spark, root, None), root, now["token"])


def restore(spark: SparkSession, root: str, version: str) -> None:
    """Point back at an earlier version; staged rows live elsewhere and are simply dropped."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifests/{version}")
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        raise FileNotFoundError(version)
    write_pointer(spark, root, version, _manifest(spark, root, version)["token"])


# --- edits ----------------------------------------------------------------------------------


_BASE = ("base_metadata", "base_recipe", "base_fingerprint", "base_path")


def stage_edits(edits: DataFrame, originals: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """``edits(id, metadata, recipe)`` against records → staged rows with their base snapshot.

    Only managed originals can be edited; metadata is normalised; the recipe revision grows by
    one exactly when the recipe changed. ``problem`` is NULL, ``notFound`` or
    ``unsupportedMedia``. ``earlier`` holds rows staged before: an item that is edited again keeps
    the base snapshot of its first edit, so a change made in between still shows as a conflict.
    """
    base = originals.select(
        "id", "original_storage", F.col("metadata").alias("base_metadata"),
        F.col("recipe").alias("base_recipe"), F.col("fingerprint").alias("base_fingerprint"),
        F.col("managed_original_path").alias("base_path"),
    )
    if earlier is not None:
        first = earlier.where("problem IS NULL").select("id", F.lit("managed").alias("original_storage"), *_BASE)
        base = base.join(first.select("id"), "id", "left_anti").unionByName(first)
    changed = ~F.col("recipe").eqNullSafe(F.col("base_recipe"))
    revision = F.when(changed, F.col("base_recipe.revision") + 1).otherwise(F.col("base_recipe.revision"))
    problem = (
        F.when(F.col("original_storage").isNull(), "notFound")
        .when(F.col("original_storage") != "managed", "unsupportedMedia")
    )
    return edits.join(base, "id", "left").select(
        "id", normalize_metadata(F.col("metadata")).alias("metadata"),
        F.col("recipe").withField("revision", revision).alias("recipe"),
        "base_metadata", "base_recipe", "base_fingerprint", "base_path", problem.alias("problem"),
    )


def edit_conflicts(edits: DataFrame, current: DataFrame, contents: DataFrame) -> DataFrame:
    """Adds ``conflict`` to staged edits: optimistic concurrency against the current table.

    ``missing``, ``changed`` (any field differs from the base snapshot) or ``content`` (the bytes
    no longer have the recorded digest). ``contents`` is ``(id, digest)`` of the stored bytes.
    """
    now = current.select(
        "id", F.lit(True).alias("present"), F.col("metadata").alias("now_metadata"),
        F.col("recipe").alias("now_recipe"), F.col("fingerprint").alias("now_fingerprint"),
    )
    same = (
        F.col("now_metadata").eqNullSafe(F.col("base_metadata"))
        & F.col("now_recipe").eqNullSafe(F.col("base_recipe"))
        & F.col("now_fingerprint").eqNullSafe(F.col("base_fingerprint"))
    )
    stored = contents.select("id", F.col("digest").alias("stored_digest"))
    conflict = (
        F.when(F.col("present").isNull(), "missing")
        .when(~same, "changed")
        .when(~F.col("stored_digest").eqNullSafe(F.col("base_fingerprint.digest")), "content")
    )
    return (
        edits.join(now, "id", "left").join(stored, "id", "left")
        .withColumn("conflict", conflict)
        .drop("present", "now_metadata", "now_recipe", "now_fingerprint", "stored_digest")
    )


def save_gate(checked: DataFrame) -> DataFrame:
    """One row: may the batch be saved, and if not, why. One bad edit refuses all."""
    rewritten = ~F.col("metadata").eqNullSafe(F.col("base_metadata"))
    unsupported = rewritten & ~supports_embedded_write(F.col("base_path"))
    return checked.agg(
        F.count("*").alias("edits"),
        F.count_if(F.col("conflict").isNotNull()).alias("conflicts"),
        F.count_if(F.col("conflict").isNull() & unsupported).alias("unsupported"),
    ).withColumn(
        "error",
        F.when(F.col("edits") == 0, "conflict").when(F.col("conflicts") > 0, "conflict")
        .when(F.col("unsupported") > 0, "unsupportedMedia").otherwise("none"),
    )


def save_edits(
    checked: DataFrame, current: DataFrame, new_digests: DataFrame, pending: DataFrame | None = None
) -> DataFrame:
    """Record table after saving; every row of the batch is applied, or the batch is refused.

    ``new_digests(id, digest)`` holds the digests of rewritten files, ``pending`` the rows that are
    staged by others: while there are any, nothing is saved. ``checkpoint_append`` gives the
    checkpoint row of a batch that was saved.
    """
    if pending is not None and not pending.isEmpty():
        raise Conflict("conflict: other changes are staged")
    verdict = save_gate(checked).first()
    if verdict["error"] != "none":
        raise Conflict(f"{verdict['error']}: {verdict['conflicts']} conflicts, {verdict['unsupported']} unsupported")
    digests = new_digests.select("id", F.col("digest").alias("_d"))
    edits = _only_row(checked.select("id", "metadata", "recipe").join(digests, "id", "left")).select(
        "id", F.struct("metadata", "recipe", "_d").alias("_e")
    )
    # A saved record is its row with other columns, so the table is read and joined once.
    edit, digest = F.col("_e").isNotNull(), F.col("_e._d")
    fresh = {
        "metadata": F.when(edit, F.col("_e.metadata")).otherwise(F.col("metadata")),
        "recipe": F.when(edit, F.col("_e.recipe")).otherwise(F.col("recipe")),
        "fingerprint": F.when(
            digest.isNotNull(), F.struct(F.lit("sha256").alias("algorithm"), digest.alias("digest"))
        ).otherwise(F.col("fingerprint")),
    }
    return current.join(edits, "id", "left").withColumns(fresh).select(current.columns)


def save_with_checkpoint(
    checked: DataFrame, current: DataFrame, new_digests: DataFrame, checkpoints: DataFrame, message: str,
    author: str | None, version: str, checkpoint_id: str, created_at_ms: int, prefix: str,
    pending: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``save_edits`` and the checkpoint table with the row that names the batch.

    A refused batch raises ``Conflict`` before either table is made: the caller keeps both as they were.
    """
    saved = save_edits(checked, current, new_digests, pending)
    return saved, checkpoint_append(checkpoints, message, author, version, checkpoint_id, created_at_ms, prefix)


def verify_written(expected: DataFrame, reread: DataFrame) -> DataFrame:
    """``(path, rating, caption, tags)`` asked for against what the file now says."""
    want = expected.select("path", F.col("rating").alias("r"), F.col("caption").alias("c"), F.col("tags").alias("t"))
    got = reread.select("path", F.col("rating").alias("r2"), F.col("caption").alias("c2"), F.col("tags").alias("t2"))
    matches = (
        (F.col("r2") == clamp_rating(F.col("r"))) & F.col("c2").eqNullSafe(F.col("c"))
        & F.array_distinct("t2").eqNullSafe(F.array_distinct("t"))
    )
    return want.join(got, "path", "left").select(
        "path", F.coalesce(matches, F.lit(False)).alias("verified")
    )


# --- originals --------------------------------------------------------------------------------


def staged_original_check(staged: DataFrame, committed: DataFrame, originals: DataFrame) -> DataFrame:
    """Violations among staged managed records.

    ``staged`` and ``committed`` are ``(id, storage, managed_path, digest)``; ``originals`` is
    ``(area, managed_path, digest)`` with area ``staged`` or ``committed``. A record needs its
    staged original, or an unchanged committed one whose bytes match the record.
    """
    fresh = originals.where("area = 'staged'").select("managed_path", F.lit(True).alias("has_staged"))
    old = originals.where("area = 'committed'").select(
        "managed_path", F.col("digest").alias("stored_digest"), F.lit(True).alias("has_committed")
    )
    was = committed.where("storage = 'managed'").select(
        "id", F.col("managed_path").alias("old_path"), F.col("digest").alias("old_digest")
    )
    keeps = F.coalesce(
        (F.col("old_path") == F.col("managed_path")) & F.col("has_committed"), F.lit(False)
    )
    problem = (
        F.when(F.col("has_staged"), None)
        .when(~keeps, "corruptData")
        .when((F.col("old_digest") != F.col("digest")) & (F.col("stored_digest") != F.col("digest")), "conflict")
    )
    return (
        staged.where("storage = 'managed'").join(fresh, "managed_path", "left")
        .join(old, "managed_path", "left").join(was, "id", "left")
        .select("id", "managed_path", problem.cast("string").alias("problem")).where("problem IS NOT NULL")
    )


def orphan_originals(originals: DataFrame, staged: DataFrame) -> DataFrame:
    """Staged originals (or unfinished ``.part`` files) that no staged record expects."""
    expected = staged.where("storage = 'managed' AND managed_path <> ''").select("managed_path")
    files = originals.select("managed_path")
    partial = files.where(F.col("managed_path").endswith(".part"))
    whole = files.where(~F.col("managed_path").endswith(".part"))
    return whole.join(expected, "managed_path", "left_anti").unionByName(partial)


# --- derivatives ------------------------------------------------------------------------------


def derivative_record(exports: DataFrame, sources: DataFrame, fresh_id: Column | None = None) -> DataFrame:
    """``exports(source_id, path, size_bytes, last_modified_ms, digest)`` → new image records."""
    source = sources.select(F.col("id").alias("source_id"), "metadata", F.col("recipe.revision").alias("revision"))
    name, folder = base_name(F.col("path")), F.regexp_replace("path", "/[^/]*$", "")
    recipe = "struct<revision:int,operations:array<struct<kind:string,parameters:string>>>"
    empty = F.struct(F.lit(0).alias("revision"), F.array().alias("operations")).cast(recipe)
    return exports.join(source, "source_id").where(F.col("metadata.kind") == "image").select(
        (F.expr("uuid()") if fresh_id is None else fresh_id).alias("id"),
        F.struct(F.lit("sha256").alias("algorithm"), F.col("digest").alias("digest")).alias("fingerprint"),
        F.struct(
            F.col("path").alias("absolute_path"), F.lit("").alias("volume_id"), F.lit("").alias("file_id"),
            "size_bytes", "last_modified_ms",
        ).alias("identity"),
        F.lit("referenced").alias("original_storage"), F.lit("").alias("managed_original_path"),
        F.col("metadata").withField("file_name", name).withField("folder_path", folder)
        .withField("rotation_degrees", F.lit(0)).alias("metadata"),
        empty.alias("recipe"),
        F.struct(
            F.col("source_id").alias("source_media_id"), F.col("revision").alias("recipe_revision"),
            F.lit("export").alias("kind"),
        ).alias("derivative"),
        F.create_map().cast("map<string,string>").alias("extras"),
    )


# --- history ----------------------------------------------------------------------------------


def decode_history(checkpoints: DataFrame, prefix: str) -> DataFrame:
    p = provenance(F.col("message"), prefix)
    return checkpoints.select("id", p.alias("p"), "created_at_ms").select("id", "p.*", "created_at_ms")


def history(checkpoints: DataFrame, limit: int) -> DataFrame:
    """Newest first; a negative limit means all."""
    ordered = checkpoints.orderBy(F.col("created_at_ms").desc(), F.col("id").desc())
    return ordered.limit(limit) if limit >= 0 else ordered


def checkpoint_append(
    checkpoints: DataFrame, message: str, author: str | None, version: str,
    checkpoint_id: str, created_at_ms: int, prefix: str,
) -> DataFrame:
    """Appends one checkpoint whose parent is the latest one; without an author it is unknown."""
    latest = checkpoints.agg(
        F.coalesce(F.max_by("id", F.struct("created_at_ms", "id")), F.lit("")).alias("parent")
    )
    fresh = latest.select(
        F.lit(checkpoint_id).alias("id"),
        encode_provenance(
            F.lit(message), F.lit(author or "unknown"), F.lit(version), F.col("parent"), prefix
        ).alias("message"),
        F.lit(created_at_ms).cast("bigint").alias("created_at_ms"),
    )
    return checkpoints.select("id", "message", "created_at_ms").unionByName(fresh)


def history_chain(checkpoints: DataFrame) -> DataFrame:
    """``(library, id, parent_id, created_at_ms)`` plus ``linked``: the parent is the one before.

    One global order over all libraries, so a library with a very long history spreads out too.
    """
    order = [F.col("library"), F.col("created_at_ms"), F.col("id")]
    rows = with_previous(checkpoints, order, ["library", "id"])
    before = F.when(F.col("previous.library") == F.col("library"), F.col("previous.id"))
    return rows.withColumn(
        "linked", F.col("parent_id") == F.coalesce(before, F.lit(""))
    ).drop("previous")
