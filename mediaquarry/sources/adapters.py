"""The supplied tables seen as a media catalogue, its listing, its events and its requests.

Everything is derived row by row with Spark, so the work of a query grows with its table. The
derivations are plain arithmetic on keys; the reference results restate them in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions.capture import from_wall_clock_ms, wall_clock_ms
from ..functions.paths import kind_from_extension, managed_path
from ..operators.projection import flatten_media

T = TypeVar("T")
_EXT = [".JPG", ".png", ".jpeg", ".HEIC", ".mp4", ".MOV", ".tif", ".m2ts", ".gif", "", ".txt", ".tar.gz", "."]


class Tables:
    """Lazy access to one folder of the supplied parquet tables.

    Plans are kept, not data: a view asked for twice is analysed once.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._plans = spark, folder, {}

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> Tables:
        key = (spark.sparkContext.applicationId, id(spark), folder)
        if key not in _OPEN:
            _OPEN[key] = cls(spark, folder)
        return _OPEN[key]

    def plan(self, name: str, build: Callable[[Tables], T]) -> T:
        if name not in self._plans:
            self._plans[name] = build(self)
        return self._plans[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.plan(
            f"table {name}", lambda t: spread(t.spark.read.parquet(f"{t.folder}/{name}.parquet"))
        )

    def stream(self, name: str) -> DataFrame:
        """One table as a file stream; a table is one file or a folder of files.

        A stream takes a single file only by a pattern, and a filter of file names would miss the parts of a folder.
        """
        schema = self.spark.read.parquet(f"{self.folder}/{name}.parquet").schema
        return self.spark.readStream.schema(schema).parquet(f"{self.folder}/{{{name}}}.parquet")


_OPEN: dict[tuple, Tables] = {}


def view(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """A derived table whose plan is built once per folder."""
    return lambda t: t.plan(f"{build.__module__}.{build.__name__}", build)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows out to ``spark.mediaquarry.inputPartitions`` tasks, where the session sets it.

    One Parquet row group is one task, however many cores wait: a session over small files may ask
    for more. Without the setting the files' own splits stand and nothing is shuffled.
    """
    wanted = int(df.sparkSession.conf.get("spark.mediaquarry.inputPartitions", "0"))
    return df.repartition(wanted) if wanted else df


def _key(column: str = "doc_id", mark: str = "m") -> Column:
    return F.concat(F.lit(mark), F.lpad(F.col(column).cast("string"), 20, "0"))


def document_file_name(doc: Column) -> Column:
    stem = F.when(doc % 3 == 0, "IMG_").when(doc % 3 == 1, "img_").otherwise("Clip-")
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXT]), (doc % 13 + 1).cast("int"))
    dot = F.when(doc % 29 == 0, ".").otherwise("")
    return F.concat(dot, stem, (doc % 997).cast("string"), ext)


@view
def records(t: Tables) -> DataFrame:
    """``documents`` as catalogue records: the text is the caption, its hash the fingerprint."""
    d = F.col("doc_id")
    name = document_file_name(d)
    digest = F.sha2("text", 256)
    day = 86_400_000
    modified = F.when(d % 17 != 0, F.lit(1_600_000_000_000) + d % 211 * day)
    wall = F.when(d % 11 != 0, F.lit(1_500_000_000_000) + d * 7919 % 100_003 * 3_600_000)
    offset = F.when(d % 4 == 1, 3600).when(d % 4 == 2, -16200).when(d % 4 == 3, 20700)
    location = F.when(d % 5 != 0, F.struct(
        ((d % 200) - 99).cast("double").alias("latitude"), ((d % 380) - 190).cast("double").alias("longitude"),
        (d % 1000).cast("double").alias("altitude_metres"),
    ))
    operations = F.when(d % 4 == 0, F.array().cast("array<struct<kind:string,parameters:string>>")).otherwise(
        F.array(
            F.struct(
                F.when(d % 19 == 0, "sharpen").otherwise("rotate").alias("kind"),
                F.concat(F.lit('{"degrees":'), (d % 5 * 90).cast("string"), F.lit("}")).alias("parameters"),
            ),
            F.struct(
                F.when(d % 23 == 0, "trim").otherwise("crop").alias("kind"),
                F.concat(
                    F.lit('{"x":'), (d % 7).cast("string"), F.lit(',"y":'), (d % 3).cast("string"),
                    F.lit(',"width":'), (d % 1500).cast("string"), F.lit(',"height":'),
                    (d % 1200).cast("string"), F.lit("}"),
                ).alias("parameters"),
            ),
            F.struct(
                F.lit("orientation").alias("kind"),
                F.concat(F.lit('{"value":'), (d % 10).cast("string"), F.lit("}")).alias("parameters"),
            ),
        )
    )
    conflicts = F.when(d % 6 == 0, F.array(F.struct(
        F.when(d % 12 == 0, "caption").otherwise("rating").alias("field"),
        F.lit("sidecar").alias("preferred_origin"), F.lit("embedded").alias("conflicting_origin"),
        F.col("lang").alias("preferred_value"), F.col("source").alias("conflicting_value"),
    ))).otherwise(F.array().cast(f"array<{schemas.CONFLICT}>"))
    return t.documents.select(
        _key().alias("id"),
        F.struct(F.lit("sha256").alias("algorithm"), digest.alias("digest")).alias("fingerprint"),
        F.struct(
            F.concat(F.lit("/library/"), F.col("source"), F.lit("/"), name).alias("absolute_path"),
            F.when(d % 2 == 0, "vol-1").otherwise("").alias("volume_id"),
            d.cast("string").alias("file_id"),
            F.when(d % 31 == 0, F.lit(-1).cast("bigint")).otherwise(F.col("n_chars")).alias("size_bytes"),
            modified.alias("last_modified_ms"),
        ).alias("identity"),
        F.when(d % 6 == 0, "referenced").otherwise("managed").alias("original_storage"),
        F.when(d % 37 == 0, F.concat(F.lit("originals/../"), name))
        .otherwise(managed_path(_key(), digest, name)).alias("managed_original_path"),
        F.struct(
            kind_from_extension(name).alias("kind"), name.alias("file_name"),
            F.concat(F.lit("/library/"), F.col("source")).alias("folder_path"),
            F.struct(
                from_wall_clock_ms(wall).alias("wall_clock"), offset.cast("int").alias("utc_offset_seconds")
            ).alias("capture_time"),
            F.when(wall.isNull(), "unknown").otherwise("embedded").alias("capture_time_origin"),
            F.concat(F.lit("Make "), F.col("lang")).alias("camera_make"),
            F.when(d % 8 == 0, None).otherwise("Model").alias("camera_model"), F.lit("").alias("lens_model"),
            (d % 5000 - 5).cast("int").alias("pixel_width"), (d % 3000 - 5).cast("int").alias("pixel_height"),
            (d % 40 * 23 - 450).cast("int").alias("rotation_degrees"),
            (F.col("n_chars") * 10 - 500).cast("bigint").alias("duration_ms"),
            (d % 2 == 0).alias("has_audio"), location.alias("location"),
            (d % 9 - 2).cast("int").alias("rating"), F.col("text").alias("caption"),
            F.array("lang", "source", "lang").alias("tags"), conflicts.alias("conflicts"),
        ).alias("metadata"),
        F.struct((d % 4).cast("int").alias("revision"), operations.alias("operations")).alias("recipe"),
        F.when(d % 10 == 0, F.struct(
            F.concat(F.lit("m"), F.lpad((d + 1).cast("string"), 20, "0")).alias("source_media_id"),
            (d % 3 - 1).cast("int").alias("recipe_revision"),
            F.when(d % 20 == 0, "export").otherwise("").alias("kind"),
        )).alias("derivative"),
        F.when(d % 3 == 0, F.create_map(F.lit("x-lang"), F.to_json(F.struct("lang"))))
        .otherwise(F.create_map().cast("map<string,string>")).alias("extras"),
    )


@view
def media(t: Tables) -> DataFrame:
    return flatten_media(records(t))


@view
def events(t: Tables) -> DataFrame:
    return change_events(t.events)


def change_events(events: DataFrame) -> DataFrame:
    """``events`` as change events: the user is the root, an error an overflow."""
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in {
        "signup": "created", "click": "modified", "view": "renamedFrom", "purchase": "renamedTo",
        "error": "overflow",
    }.items() for x in kv]), F.col("event_type"))
    return events.select(
        F.concat(F.lit("/roots/"), F.col("user_id").cast("string")).alias("root"), kind.alias("kind"),
        F.concat(F.lit("/roots/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_id").cast("string")).alias("path"),
        (F.get_json_object("props", "$.k").cast("bigint") % 5).alias("rename_cookie"),
        F.col("ts").alias("observed_at"), wall_clock_ms(F.col("ts")).alias("t"),
        F.col("event_id").alias("seq"),
    )


@view
def work_requests(t: Tables) -> DataFrame:
    """``events`` as the request table: some pending, some running or ended."""
    e, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (n % len(names) + 1).cast("int"))
    return t.events.select(
        F.concat(F.lit("w"), F.lpad(e.cast("string"), 20, "0")).alias("id"),
        pick(["scanRoot", "reconcileRoot", "readMetadata", "generateThumbnail"], e).alias("kind"),
        (e % 4).cast("int").alias("priority"),
        pick(["pending", "running", "pending", "succeeded", "failed", "cancelled"], e).alias("state"),
        F.when(e % 3 == 0, "").otherwise(F.concat(F.lit("key-"), F.col("user_id").cast("string"))).alias("coalescing_key"),
        F.col("props").alias("payload"), (k % 3).cast("int").alias("attempts"),
        (k % 4 + 1).cast("int").alias("max_attempts"),
        F.when(e % 13 != 0, wall_clock_ms(F.col("ts"))).alias("created_at_ms"),
        F.when(e % 5 == 0, wall_clock_ms(F.col("ts")) + 3_600_000).alias("not_before_ms"),
        pick(["none", "timeout", "corruptData", "interrupted", "storageUnavailable"], e).alias("last_error_code"),
    )


@view
def cache_entries(t: Tables) -> DataFrame:
    """``lineitem`` as render-cache entries, many sharing a write time."""
    key = F.concat(
        F.lit("sha256-"), F.sha2((F.col("l_partkey")).cast("string"), 256), F.lit("/thumbnail/"),
        (F.col("l_linenumber") * 64).cast("string"), F.lit("x"), (F.col("l_linenumber") * 64).cast("string"),
        F.lit("/"), F.col("l_orderkey").cast("string"), F.lit("/r"), F.col("l_suppkey").cast("string"),
    )
    return t.lineitem.groupBy("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").agg(
        F.max("l_quantity").alias("q"), F.max("l_shipdate").alias("d")
    ).select(
        key.alias("cache_key"),
        F.when(F.col("q") <= 2, F.lit(0).cast("bigint")).otherwise((F.col("q") * 100).cast("bigint")).alias("size_bytes"),
        wall_clock_ms(F.col("d")).alias("last_modified_ms"),
    )
