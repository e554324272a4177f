"""Record files: one JSON object per file, read with an explicit schema and kept open-world."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions.capture import iso_ms_text, iso_with_ms, parse_iso, wall_clock_ms
from ..functions.paths import base_name, record_file_name, shard_for
from ..functions.values import (
    decode_media_kind, decode_origin, is_json_object, unknown_members,
)
from .listing import scan_binary


_JSON_CONFLICTS = (
    "array<struct<field:string,preferredOrigin:string,conflictingOrigin:string,"
    "preferredValue:string,conflictingValue:string>>"
)


def _text(column):
    return F.coalesce(column, F.lit(""))


def _number(column, kind="int"):
    return F.coalesce(column.try_cast(kind), F.lit(0).cast(kind))


def parse_records(texts: DataFrame, column: str = "json") -> DataFrame:
    """JSON text → record columns plus ``problem`` (``corruptData`` / ``invalidId`` / NULL).

    Absent numbers read as 0, absent text as ``''``, an absent size as -1; members this build
    does not know are kept in ``extras``.
    """
    raw = F.col(column)
    is_object = is_json_object(raw)
    # Edit parameters stay JSON text, so the recipe is read as text too.
    r = F.from_json(raw, schemas.RECORD_JSON)
    parsed = texts.withColumn("_ok", is_object).select(
        "*", F.when(F.col("_ok"), r).alias("_r"), F.when(F.col("_ok"), F.try_parse_json(raw)).alias("_v")
    )
    m, i, rec = F.col("_r.metadata"), F.col("_r.identity"), F.col("_r")
    wall = parse_iso(m["captureTime"]["wallClock"])["wall_clock"]
    modified = parse_iso(i["lastModified"])["wall_clock"]
    place = m["location"]
    # A location without both numbers is no location.
    location = F.when(
        place["latitude"].isNotNull() & place["longitude"].isNotNull(),
        F.struct(
            place["latitude"].alias("latitude"), place["longitude"].alias("longitude"),
            place["altitudeMetres"].alias("altitude_metres"),
        ),
    )
    conflicts = F.transform(
        F.coalesce(m["conflicts"], F.array().cast(_JSON_CONFLICTS)),
        lambda c: F.struct(
            _text(c["field"]).alias("field"),
            decode_origin(_text(c["preferredOrigin"])).alias("preferred_origin"),
            decode_origin(_text(c["conflictingOrigin"])).alias("conflicting_origin"),
            _text(c["preferredValue"]).alias("preferred_value"),
            _text(c["conflictingValue"]).alias("conflicting_value"),
        ),
    )
    metadata = F.struct(
        decode_media_kind(_text(m["kind"])).alias("kind"),
        _text(m["fileName"]).alias("file_name"), _text(m["folderPath"]).alias("folder_path"),
        F.struct(
            wall.alias("wall_clock"), m["captureTime"]["utcOffsetSeconds"].alias("utc_offset_seconds")
        ).alias("capture_time"),
        decode_origin(_text(m["captureTimeOrigin"])).alias("capture_time_origin"),
        _text(m["cameraMake"]).alias("camera_make"), _text(m["cameraModel"]).alias("camera_model"),
        _text(m["lensModel"]).alias("lens_model"),
        _number(m["pixelWidth"]).alias("pixel_width"), _number(m["pixelHeight"]).alias("pixel_height"),
        _number(m["rotationDegrees"]).alias("rotation_degrees"),
        _number(m["durationMs"], "bigint").alias("duration_ms"),
        F.coalesce(m["hasAudio"], F.lit(False)).alias("has_audio"),
        location.alias("location"), _number(m["rating"]).alias("rating"),
        _text(m["caption"]).alias("caption"),
        F.coalesce(m["tags"], F.array().cast("array<string>")).alias("tags"),
        conflicts.alias("conflicts"),
    )
    derivative = F.when(
        rec["derivative"].isNotNull(),
        F.struct(
            _text(rec["derivative"]["sourceMediaId"]).alias("source_media_id"),
            _number(rec["derivative"]["recipeRevision"]).alias("recipe_revision"),
            _text(rec["derivative"]["kind"]).alias("kind"),
        ),
    )
    media_id = _text(rec["id"])
    return parsed.select(
        *texts.columns,
        F.when(~F.col("_ok"), "corruptData").when(media_id == "", "invalidId").alias("problem"),
        media_id.alias("id"),
        F.struct(
            _text(rec["fingerprintAlgorithm"]).alias("algorithm"),
            _text(rec["fingerprintDigest"]).alias("digest"),
        ).alias("fingerprint"),
        F.struct(
            _text(i["absolutePath"]).alias("absolute_path"), _text(i["volumeId"]).alias("volume_id"),
            _text(i["fileId"]).alias("file_id"),
            F.coalesce(i["sizeBytes"].try_cast("bigint"), F.lit(-1).cast("bigint")).alias("size_bytes"),
            wall_clock_ms(modified).alias("last_modified_ms"),
        ).alias("identity"),
        F.when(rec["originalStorage"] == "managed", "managed").otherwise("referenced")
        .alias("original_storage"),
        _text(rec["managedOriginalPath"]).alias("managed_original_path"),
        metadata.alias("metadata"),
        F.struct(
            _number(rec["recipe"]["revision"]).alias("revision"),
            F.coalesce(
                rec["recipe"]["operations"],
                F.array().cast("array<struct<kind:string,parameters:string>>"),
            ).alias("operations"),
        ).alias("recipe"),
        derivative.alias("derivative"),
        F.map_concat(
            unknown_members(_object("$"), schemas.RECORD_JSON_KEYS),
            _nested_unknown("metadata", schemas.METADATA_JSON_KEYS),
            _nested_unknown("recipe", schemas.RECIPE_JSON_KEYS),
        ).alias("extras"),
    )


def _object(path: str):
    members = F.try_variant_get(F.col("_v"), path, "map<string,variant>")
    return F.coalesce(members, F.create_map().cast("map<string,variant>"))


def _nested_unknown(member: str, known: list[str]):
    """Unknown members of a nested object, keyed ``member/name``."""
    return F.transform_keys(
        unknown_members(_object(f"$.{member}"), known), lambda k, _: F.concat(F.lit(f"{member}/"), k)
    )


def scan_records(spark: SparkSession, folder: str, packed: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(records, problems)`` of a folder of record files, or of the table of ``write_records``.

    Record names never begin with a dot, so such names, the library descriptor among them, are no
    records; every other ``*.json`` is one. A file that cannot be read is a problem row too.
    Listing order is a sort on ``id`` by whoever needs it.
    """
    if packed:
        files = spark.read.schema(schemas.RECORD_TABLE).parquet(folder).withColumn("read_error", F.lit(None).cast("string"))
    else:
        found = scan_binary(spark, folder, "*.json").where(~base_name(F.col("path")).startswith("."))
        files = found.select(
            F.col("path").alias("record_file"), F.make_valid_utf8(F.col("content").cast("string")).alias("json"), "read_error"
        )
    parsed = parse_records(files.select("record_file", "json", "read_error"))
    problem = F.coalesce("read_error", "problem")
    good = parsed.where(problem.isNull()).drop("problem", "json", "record_file", "read_error")
    bad = parsed.where(problem.isNotNull()).select("record_file", problem.alias("problem"))
    return good, bad


def record_json():
    """Record columns → the JSON text of a record file; unknown members are written back."""
    m, i = F.col("metadata"), F.col("identity")
    location = F.when(
        m["location"].isNotNull(),
        F.struct(
            m["location"]["latitude"].alias("latitude"), m["location"]["longitude"].alias("longitude"),
            m["location"]["altitude_metres"].alias("altitudeMetres"),
        ),
    )
    metadata = F.to_json(F.struct(
        _text(m["kind"]).alias("kind"), _text(m["file_name"]).alias("fileName"),
        _text(m["folder_path"]).alias("folderPath"),
        F.struct(
            iso_with_ms(m["capture_time"]["wall_clock"]).alias("wallClock"),
            m["capture_time"]["utc_offset_seconds"].alias("utcOffsetSeconds"),
        ).alias("captureTime"),
        _text(m["capture_time_origin"]).alias("captureTimeOrigin"),
        _text(m["camera_make"]).alias("cameraMake"), _text(m["camera_model"]).alias("cameraModel"),
        _text(m["lens_model"]).alias("lensModel"), m["pixel_width"].alias("pixelWidth"),
        m["pixel_height"].alias("pixelHeight"), m["rotation_degrees"].alias("rotationDegrees"),
        m["duration_ms"].alias("durationMs"), m["has_audio"].alias("hasAudio"),
        location.alias("location"), m["rating"].alias("rating"), _text(m["caption"]).alias("caption"),
        m["tags"].alias("tags"),
        F.transform(m["conflicts"], lambda c: F.struct(
            c["field"].alias("field"), c["preferred_origin"].alias("preferredOrigin"),
            c["conflicting_origin"].alias("conflictingOrigin"),
            c["preferred_value"].alias("preferredValue"),
            c["conflicting_value"].alias("conflictingValue"),
        )).alias("conflicts"),
    ))
    operations = F.transform(
        F.col("recipe.operations"),
        lambda o: F.concat(
            F.lit('{"kind":'), _quoted(o["kind"]), F.lit(',"parameters":'),
            F.coalesce(o["parameters"], F.lit("{}")), F.lit("}"),
        ),
    )
    recipe = F.concat(
        F.lit('{"revision":'), F.col("recipe.revision").cast("string"),
        F.lit(',"operations":['), F.array_join(operations, ","), F.lit("]}"),
    )
    body = F.to_json(F.struct(
        F.lit(schemas.RECORD_SCHEMA_VERSION).alias("schemaVersion"), "id",
        _text(F.col("fingerprint.algorithm")).alias("fingerprintAlgorithm"),
        _text(F.col("fingerprint.digest")).alias("fingerprintDigest"),
        F.struct(
            _text(i["absolute_path"]).alias("absolutePath"), _text(i["volume_id"]).alias("volumeId"),
            _text(i["file_id"]).alias("fileId"), i["size_bytes"].alias("sizeBytes"),
            iso_ms_text(i["last_modified_ms"]).alias("lastModified"),
        ).alias("identity"),
        _text(F.col("original_storage")).alias("originalStorage"),
        _text(F.col("managed_original_path")).alias("managedOriginalPath"),
        F.when(F.col("derivative").isNotNull(), F.struct(
            F.col("derivative.source_media_id").alias("sourceMediaId"),
            F.col("derivative.recipe_revision").alias("recipeRevision"),
            F.col("derivative.kind").alias("kind"),
        )).alias("derivative"),
    ))
    nested = F.concat(
        F.lit(',"metadata":'), _with_members(metadata, _members("metadata/")),
        F.lit(',"recipe":'), _with_members(recipe, _members("recipe/")), F.lit("}"),
    )
    whole = F.concat(F.substring(body, F.lit(1), F.length(body) - 1), nested)
    return _with_members(whole, _members(""))


def _quoted(text):
    """A string as a JSON literal."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("k"))), r'(?s)^\{"k":(.*)\}$', 1)


def _members(prefix: str):
    """Preserved unknown members of one level as ``"name":value`` texts."""
    entries = F.map_entries(F.coalesce(F.col("extras"), F.create_map().cast("map<string,string>")))
    here = F.filter(entries, lambda e: (
        e["key"].startswith(prefix) if prefix else ~e["key"].rlike("^(metadata|recipe)/")
    ))
    return F.transform(here, lambda e: F.concat(
        _quoted(F.substring(e["key"], F.lit(len(prefix) + 1), F.length(e["key"]))), F.lit(":"),
        e["value"],
    ))


def _with_members(json_object, members):
    """Append members to an object that is not empty."""
    return F.when(F.size(members) == 0, json_object).otherwise(F.concat(
        F.substring(json_object, F.lit(1), F.length(json_object) - 1), F.lit(","),
        F.array_join(members, ","), F.lit("}"),
    ))


def write_records(records: DataFrame, folder: str) -> None:
    """Write one packed table of record texts; ``scan_records(..., packed=True)`` reads it back.

    ``record_file`` and its two-character ``shard`` say where the record lies as a loose file. The
    shard is a column and no folder: ids share their beginnings, so one folder could hold all rows.
    """
    named = records.withColumn("record_file", record_file_name(F.col("id"))).select(
        "record_file", shard_for(F.col("record_file")).alias("shard"), record_json().alias("json")
    )
    named.write.mode("overwrite").parquet(folder)


def library_descriptor(name, created_at_ms, library_id, user_id):
    """Descriptor row of a new library: the name is trimmed, an empty one becomes ``Library``."""
    trimmed = F.trim(name)
    return F.struct(
        library_id.alias("id"),
        F.when(trimmed == "", "Library").otherwise(trimmed).alias("name"),
        F.lit(1).alias("format_version"), created_at_ms.alias("created_at_ms"),
        F.struct(user_id.alias("id"), F.lit("Local user").alias("display_name")).alias("local_user"),
    )


def renamed_library(current, wanted):
    """New name, or NULL when the rename is refused because the name is empty."""
    trimmed = F.trim(wanted)
    return F.when(trimmed != "", trimmed)


def library_valid(row):
    return F.coalesce(
        (row["id"] != "") & (row["name"] != "") & (row["format_version"] > 0)
        & row["created_at_ms"].isNotNull() & (row["local_user"]["id"] != ""),
        F.lit(False),
    )

