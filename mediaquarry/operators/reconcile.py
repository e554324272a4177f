"""Bring a folder listing and the stored records together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions.paths import base_name, clean_path, managed_path, path_order
from ..functions.values import looks_unchanged
from ..session import cut_lineage
from .ordering import grouped_positions, join_spread, ordered_positions

# files:   path, indexable, size_bytes, last_modified_ms            (one row per listed path)
# records: id, path, digest, size_bytes, last_modified_ms, managed  (records under the root)
# hashed:  path, digest, read_error                                 (only the paths that needed it)


def keep_first_per_path(records: DataFrame) -> DataFrame:
    """Flags every record but the first id of a path as ``extra``.

    A map-side minimum per path and a join back that spreads the records of a hot path.
    """
    first = records.groupBy("path").agg(F.min("id").alias("_first"))
    return join_spread(records, first, ["path"], ["id"]).withColumn("extra", F.col("id") != F.col("_first")).drop("_first")


def _known(records: DataFrame) -> DataFrame:
    state = F.struct("size_bytes", "last_modified_ms", "managed")
    return records.groupBy("path").agg(
        F.min("id").alias("known_id"), F.min_by(state, "id").alias("known")
    )


def compare_with_known(files: DataFrame, records: DataFrame) -> DataFrame:
    """First stage: ``ignored``, ``unchanged`` or, when the bytes must be read, ``pending``."""
    k = F.col("known")
    same = looks_unchanged(
        F.col("size_bytes"), F.col("last_modified_ms"), k["size_bytes"], k["last_modified_ms"]
    )
    stage = (
        F.when(~F.col("indexable"), "ignored")
        .when(F.col("known_id").isNotNull() & same & k["managed"], "unchanged")
        .otherwise("pending")
    )
    return files.join(_known(records), "path", "left").withColumn("stage", stage)


def needs_fingerprint(files: DataFrame, records: DataFrame) -> DataFrame:
    """Paths whose content has to be hashed: new ones and changed ones only."""
    return compare_with_known(files, records).where("stage = 'pending'").select("path")


def match_moves(new_files: DataFrame, vanished: DataFrame) -> DataFrame:
    """``(path, id)``: new files that take over a vanished record of equal content.

    The n-th file of a digest in walking order takes the n-th record in id order. Rows whose
    digest is on one side only are dropped first, which in a steady state leaves almost nothing;
    both sides are numbered in one pass and joined one to one on (digest, n).
    """
    gone = vanished.select(
        "digest", F.lit(False).alias("is_file"), F.lit(None).cast("string").alias("path"), "id"
    )
    fresh = new_files.select(
        "digest", F.lit(True).alias("is_file"), "path", F.lit(None).cast("string").alias("id")
    )
    both = fresh.unionByName(gone)
    sides = both.groupBy("digest").agg(F.min("is_file").alias("a"), F.max("is_file").alias("b"))
    shared = cut_lineage(join_spread(both, sides.where("a <> b").select("digest"), ["digest"], ["path", "id"], "left_semi"))
    numbered = grouped_positions(
        shared, ["digest", "is_file"], [path_order(F.col("path")), F.col("id")], ["path", "id"], "n"
    )
    files = numbered.where("is_file").select("digest", "n", "path")
    return files.join(numbered.where("NOT is_file").select("digest", "n", "id"), ["digest", "n"]).select("path", "id")


def reconcile(
    files: DataFrame, records: DataFrame, hashed: DataFrame, fresh_id: Column | None = None
) -> DataFrame:
    """Outcome rows ``(path, id, class, digest)``.

    Classes of files: ``ignored``, ``unchanged``, ``updated``, ``moved``, ``added``, ``failed``.
    Classes of records without their own file row: ``removed`` (an extra record of a reconciled
    path, or a path that stopped being media) and ``retained`` (its source vanished).

    ``fresh_id`` names added files; the default is random, so the outcome is checkpointed and
    every reader sees the same ids.
    """
    staged = compare_with_known(files, records).join(hashed, "path", "left")
    usable = F.coalesce(F.col("digest") != "", F.lit(False)) & F.col("read_error").isNull()
    label = (
        F.when(F.col("stage") != "pending", F.col("stage"))
        .when(~usable, "failed")
        .when(F.col("known_id").isNotNull(), "updated").otherwise("new")
    )
    # Read four times below; without the cut every reader would hash the files again.
    judged = cut_lineage(staged.select("path", "known_id", "digest", label.alias("label")))
    new = judged.where("label = 'new'").select("path", "digest")
    valid = F.coalesce(F.col("digest") != "", F.lit(False))
    vanished = records.where(valid).join(files.select("path"), "path", "left_anti")
    moves = match_moves(new, vanished).withColumnRenamed("id", "moved_id")
    random_ids = fresh_id is None
    fresh = F.expr("uuid()") if random_ids else fresh_id
    outcome = judged.join(moves, "path", "left").select(
        "path",
        F.when(F.col("moved_id").isNotNull(), F.col("moved_id"))
        .when(F.col("label") == "new", fresh)
        .otherwise(F.col("known_id")).alias("id"),
        F.when(F.col("moved_id").isNotNull(), "moved")
        .when(F.col("label") == "new", "added").otherwise(F.col("label")).alias("class"),
        "digest",
    )
    on_disk = records.select("id", "path").join(judged.select("path", "known_id", "label"), "path")
    removed = on_disk.where(
        (F.col("label") == "ignored")
        | (F.col("label").isin("unchanged", "updated") & (F.col("id") != F.col("known_id")))
    ).select("path", "id", F.lit("removed").alias("class"), F.lit(None).cast("string").alias("digest"))
    retained = (
        records.select("id", "path").join(files.select("path"), "path", "left_anti")
        .join(moves.select(F.col("moved_id").alias("id")), "id", "left_anti")
        .select("path", "id", F.lit("retained").alias("class"), F.lit(None).cast("string").alias("digest"))
    )
    result = outcome.unionByName(removed).unionByName(retained)
    return cut_lineage(result) if random_ids else result


def apply_outcomes(records: DataFrame, outcomes: DataFrame, files: DataFrame) -> DataFrame:
    """The record rows after a scan; adds ``managed_path`` and ``metadata_replaced``.

    A rescan overwrites the metadata of a changed file; the flag says where that happened.
    """
    touched = outcomes.where("class IN ('updated', 'moved', 'added')")
    gone = outcomes.where("class = 'removed'").select("id")
    written = touched.join(
        files.select("path", "size_bytes", "last_modified_ms"), "path"
    ).select(
        "id", "path", "digest", "size_bytes", "last_modified_ms", F.lit(True).alias("managed"),
        managed_path(F.col("id"), F.col("digest"), base_name(F.col("path"))).alias("managed_path"),
        (F.col("class") != "added").alias("metadata_replaced"),
    )
    kept = records.join(touched.select("id").union(gone), "id", "left_anti")
    if "managed_path" not in kept.columns:
        kept = kept.withColumn("managed_path", F.lit(None).cast("string"))
    kept = kept.withColumn("metadata_replaced", F.lit(False))
    return kept.select(written.columns).unionByName(written)


def commit_batches(outcomes: DataFrame, size: int) -> DataFrame:
    """Numbers the changed files in walking order, a commit after every ``size`` of them."""
    changed = outcomes.where("class IN ('updated', 'moved', 'added')").select("path", "id", "class")
    if size <= 0:
        return changed.withColumn("batch", F.lit(0).cast("bigint"))
    placed = ordered_positions(changed, [path_order(F.col("path")), F.col("id")])
    return placed.withColumn("batch", F.floor(F.col("pos") / size).cast("bigint"))


def _class_counts() -> list[Column]:
    c = F.col("class")
    return [
        F.count_if(c == "added").alias("added"),
        F.count_if(c.isin("updated", "moved")).alias("updated"),
        F.count_if(c == "removed").alias("removed"),
        F.count_if(c == "unchanged").alias("unchanged"),
        F.count_if(c == "failed").alias("failed"),
    ]


def scan_summary(outcomes: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """One row of counts; a moved file counts as updated. Warnings stay a table of their own."""
    counts = outcomes.agg(*_class_counts())
    if warnings is None:
        return counts
    return counts.withColumn("warnings", warnings.agg(F.count("*")).scalar())


def write_outcomes(outcomes: DataFrame, path: str) -> DataFrame:
    """Writes the outcomes as Parquet; the ``scan_summary`` of what was written, without a second pass.

    The counts are observed while the rows go by. Failed files are the warnings of a scan.
    """
    seen = Observation()
    outcomes.observe(seen, *_class_counts()).write.parquet(path)
    counts = seen.get
    names = ["added", "updated", "removed", "unchanged", "failed"]
    row = [int(counts[n]) for n in names]
    return outcomes.sparkSession.createDataFrame([(*row, row[-1])], ", ".join(f"{n} bigint" for n in [*names, "warnings"]))


def scan_warnings(outcomes: DataFrame, hashed: DataFrame) -> DataFrame:
    return outcomes.where("class = 'failed'").join(hashed, "path").select(
        "path", F.col("read_error").alias("code")
    )


def listing_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """``(path, kind)`` events between two snapshots ``(path, size_bytes, last_modified_ms)``."""
    state = F.struct("size_bytes", "last_modified_ms")
    before = previous.select("path", state.alias("before"))
    after = current.select("path", state.alias("after"))
    kind = (
        F.when(F.col("before").isNull(), "created")
        .when(F.col("after").isNull(), "removed")
        .when(~F.col("before").eqNullSafe(F.col("after")), "modified")
    )
    return before.join(after, "path", "full_outer").select("path", kind.alias("kind")).where("kind IS NOT NULL")


def listing_order(files: DataFrame) -> DataFrame:
    """Files numbered as a walk in name order would meet them."""
    return ordered_positions(files, [path_order(F.col("path"))])


def store_equivalence(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: do two catalogues hold the same (path, fingerprint key) rows, whatever their ids?

    One signed count per pair, combined map-side: one shuffle, no matter how the ids differ.
    """
    signed = left.select("path", "fingerprint_key", F.lit(1).alias("side")).unionByName(
        right.select("path", "fingerprint_key", F.lit(-1).alias("side"))
    )
    pairs = signed.groupBy("path", "fingerprint_key").agg(F.sum("side").alias("balance"))
    return pairs.agg(
        F.count_if(F.col("balance") > 0).alias("left_only"),
        F.count_if(F.col("balance") < 0).alias("right_only"),
    ).withColumn("equivalent", (F.col("left_only") == 0) & (F.col("right_only") == 0))


def roots_distinct(roots: DataFrame) -> DataFrame:
    """``(position, root)`` → cleaned roots, first occurrence kept."""
    return roots.select("position", clean_path(F.col("root")).alias("root")).groupBy("root").agg(
        F.min("position").alias("position")
    )
