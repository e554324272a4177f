"""The disposable projection: records flattened to typed rows, tags and search tokens."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions.capture import capture_sort_key
from ..functions.paths import file_extension
from ..sources.records import record_json
from .search import media_lengths, media_tokens


def flatten_media(records: DataFrame) -> DataFrame:
    """One typed row per record, the record JSON kept beside it; a row → row projection."""
    text = lambda path: F.coalesce(F.col(path), F.lit(""))
    return records.select(
        "id", record_json().alias("record_json"),
        text("fingerprint.algorithm").alias("fingerprint_algorithm"),
        text("fingerprint.digest").alias("fingerprint_digest"),
        text("identity.absolute_path").alias("absolute_path"),
        text("identity.volume_id").alias("volume_id"), text("identity.file_id").alias("file_id"),
        "identity.size_bytes", "identity.last_modified_ms", "metadata.kind",
        text("metadata.file_name").alias("file_name"),
        file_extension(text("metadata.file_name")).alias("file_extension"),
        text("metadata.folder_path").alias("folder_path"),
        capture_sort_key(F.col("metadata.capture_time.wall_clock")).alias("capture_sort_key"),
        F.col("metadata.capture_time.utc_offset_seconds").isNotNull().cast("int")
        .alias("capture_has_offset"),
        text("metadata.camera_make").alias("camera_make"),
        text("metadata.camera_model").alias("camera_model"),
        "metadata.pixel_width", "metadata.pixel_height", "metadata.duration_ms", "metadata.rating",
        text("metadata.caption").alias("caption"),
        "metadata.location.latitude", "metadata.location.longitude",
    )


def explode_tags(records: DataFrame) -> DataFrame:
    """Distinct ``(media_id, tag)`` pairs; ids are unique, so no shuffle is needed."""
    return records.select(
        F.col("id").alias("media_id"), F.explode(F.array_distinct("metadata.tags")).alias("tag")
    )


def state_token(records: DataFrame) -> DataFrame:
    """One row naming the committed contents, whatever the row order.

    Counts and sums of two independent 64-bit hashes: partial sums combine map-side, and unlike a
    xor they tell a doubled row from a missing one.
    """
    return _token(_hashes(records, 1), "0:0:0")


def _hashes(records: DataFrame, sign: int) -> DataFrame:
    return _body_hashes(records.select(record_json().alias("record_json")), sign)


def _body_hashes(bodies: DataFrame, sign: int) -> DataFrame:
    """The signed rows of a token. The JSON text is a column here, so it is made once for both hashes.

    The second hash starts from another seed: that costs a fraction of hashing the text backwards.
    """
    body = F.col("record_json")
    exact = lambda column: (F.lit(sign) * column.cast("decimal(37,0)")).cast("decimal(38,0)")
    return bodies.select(
        F.lit(sign).cast("decimal(38,0)").alias("n"), exact(F.xxhash64(body)).alias("a"), exact(F.xxhash64(F.lit("b"), body)).alias("b")
    )


def _token(rows: DataFrame, token: str) -> DataFrame:
    """``token`` after the signed rows ``(n, a, b)``."""
    parts = [
        (F.lit(part).cast("decimal(38,0)") + F.coalesce(F.sum(c), F.lit(0))).cast("decimal(38,0)").cast("string")
        for c, part in zip(("n", "a", "b"), token.split(":"))
    ]
    return rows.agg(F.concat_ws(":", *parts).alias("state_token"))


def token_after(token: str, gone: DataFrame, come: DataFrame) -> DataFrame:
    """The token once the records of ``gone`` have left and those of ``come`` have been added.

    Counts and sums of hashes can be added to and taken from, so a commit names its new contents from
    its own rows: the cost follows the change, not the table. A replaced record is in both frames, as
    it was and as it is; a record that never was in the table must not be in ``gone``.
    """
    return _token(_hashes(come, 1).unionByName(_hashes(gone, -1)), token)


def is_stale(projected: str | None, current: str | None) -> bool:
    """An unanswered token counts as stale: that is the safe direction."""
    return not projected or not current or projected != current


def write_pointer(spark: SparkSession, base: str, snapshot: str, token: str) -> None:
    """Swap the one-line pointer by an atomic rename; readers see the old or the new snapshot."""
    hadoop = spark._jvm.org.apache.hadoop
    conf = spark._jsc.hadoopConfiguration()
    target = hadoop.fs.Path(f"{base}/CURRENT")
    fresh = hadoop.fs.Path(f"{base}/CURRENT.{uuid.uuid4().hex}")
    context = hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
    out = target.getFileSystem(conf).create(fresh, True)
    out.write(bytearray(f"{snapshot}\n{token}", "utf-8"))
    out.close()
    rename = getattr(hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(fresh, target, options)


def read_pointer(spark: SparkSession, base: str) -> tuple[str, str] | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/CURRENT")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    lines = [row[0] for row in spark.read.text(f"{base}/CURRENT").collect()]
    return lines[0], lines[1] if len(lines) > 1 else ""


def build_projection(records: DataFrame, base: str, token: str | None = None) -> str:
    """Write media, tags, tokens and lengths as a new snapshot, then swap the pointer.

    Without a ``token`` the snapshot carries that of the media rows it holds, so a race errs to stale.
    A failure leaves the old snapshot in place. ``media`` is range-partitioned on the capture key, so
    time pages prune row groups by their statistics; records are dealt out before they are flattened,
    as sampling a range runs everything below it. ``media_token`` is sorted by token inside each file:
    a prefix is a few pages of every file, read by as many tasks as there are files.
    """
    spark = records.sparkSession
    snapshot = f"snapshot-{uuid.uuid4().hex}"
    target = f"{base}/{snapshot}"
    keyed = records.withColumn("_key", capture_sort_key(F.col("metadata.capture_time.wall_clock")))
    flatten_media(keyed.repartitionByRange("_key", "id").sortWithinPartitions("_key", "id")).write.parquet(
        f"{target}/media"
    )
    media = spark.read.schema(schemas.MEDIA).parquet(f"{target}/media")
    token = token if token is not None else _token(_body_hashes(media, 1), "0:0:0").first()[0]
    explode_tags(records).repartitionByRange("tag", "media_id").sortWithinPartitions(
        "tag", "media_id"
    ).write.parquet(f"{target}/media_tag")
    media_tokens(media).sortWithinPartitions("token").write.parquet(f"{target}/media_token")
    media_lengths(media).write.parquet(f"{target}/media_len")
    write_pointer(spark, base, snapshot, token)
    return snapshot


def open_projection(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    pointer = read_pointer(spark, base)
    if pointer is None:
        raise FileNotFoundError(f"no projection under {base}")
    tables = ("media", "media_tag", "media_token", "media_len")
    return {name: spark.read.parquet(f"{base}/{pointer[0]}/{name}") for name in tables}


def projected_state_token(spark: SparkSession, base: str) -> str | None:
    pointer = read_pointer(spark, base)
    return pointer[1] if pointer else None
