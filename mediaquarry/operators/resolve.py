"""Metadata from several sources: precedence, recorded conflicts, errors and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.binding import let
from ..functions.capture import describe_capture, from_wall_clock_ms
from ..functions.containers import CAPTURE_TYPE, embedded_fields, interpret_xmp
from ..functions.paths import base_name, kind_from_extension, parent_dir, sidecar_candidates
from ..functions.signature import kind_from_signature
from ..functions.values import normalize_metadata
from ..sources.containers import (
    read_container_files, read_containers, read_heads, read_sidecar_files, read_sidecars,
)


def attach_sidecar(media: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Adds ``sidecar_path``: ``<path>.xmp`` if present, else ``<stem>.xmp``, else NULL."""
    appended, replaced = sidecar_candidates(F.col("path"))
    present = sidecars.select("path").distinct()
    first = present.select(F.col("path").alias("_appended"), F.lit(True).alias("_has_first"))
    second = present.select(F.col("path").alias("_replaced"), F.lit(True).alias("_has_second"))
    return (
        media.withColumn("_appended", appended).withColumn("_replaced", replaced)
        .join(first, "_appended", "left").join(second, "_replaced", "left")
        .withColumn(
            "sidecar_path",
            F.when(F.col("_has_first"), F.col("_appended")).when(F.col("_has_second"), F.col("_replaced")),
        )
        .drop("_appended", "_replaced", "_has_first", "_has_second")
    )


def _conflict(field: str, low: Column, high: Column, describe) -> Column:
    disagree = low.isNotNull() & high.isNotNull() & ~low.eqNullSafe(high)
    return F.when(disagree, F.struct(
        F.lit(field).alias("field"), F.lit("sidecar").alias("preferred_origin"),
        F.lit("embedded").alias("conflicting_origin"),
        describe(high).alias("preferred_value"), describe(low).alias("conflicting_value"),
    ))


def resolved_metadata(
    embedded: Column, sidecar: Column, path: Column, kind: Column, modified_ms: Column
) -> Column:
    """The sidecar speaks for a person and wins over the camera; the loser is kept as a conflict.

    NULL means a source says nothing, an empty text is a deliberate erasure. Without any capture
    time the file date stands in, labelled as such.
    """
    return let(embedded, lambda e: let(sidecar, lambda s: _resolved(e, s, path, kind, modified_ms)))


def _resolved(
    embedded: Column, sidecar: Column, path: Column, kind: Column, modified_ms: Column
) -> Column:
    capture = lambda c: describe_capture(c["wall_clock"], c["utc_offset_seconds"])
    conflicts = F.filter(F.array(
        _conflict("captureTime", embedded["capture_time"], sidecar["capture_time"], capture),
        _conflict("caption", embedded["caption"], sidecar["caption"], lambda c: c),
        _conflict("rating", embedded["rating"], sidecar["rating"], lambda c: c.cast("string")),
        _conflict("tags", embedded["tags"], sidecar["tags"], lambda c: F.array_join(c, ",")),
    ), lambda c: c.isNotNull())
    fallback = F.when(modified_ms.isNotNull(), F.struct(
        from_wall_clock_ms(modified_ms).alias("wall_clock"), F.lit(0).alias("utc_offset_seconds")
    ).cast(CAPTURE_TYPE))
    origin = (
        F.when(sidecar["capture_time"].isNotNull(), "sidecar")
        .when(embedded["capture_time"].isNotNull(), "embedded")
        .when(fallback.isNotNull(), "fileSystem").otherwise("unknown")
    )
    text = lambda c: F.coalesce(c, F.lit(""))
    zero = lambda c, t="int": F.coalesce(c, F.lit(0)).cast(t)
    return normalize_metadata(F.struct(
        kind.alias("kind"), base_name(path).alias("file_name"), parent_dir(path).alias("folder_path"),
        F.coalesce(sidecar["capture_time"], embedded["capture_time"], fallback).alias("capture_time"),
        origin.alias("capture_time_origin"),
        text(embedded["camera_make"]).alias("camera_make"),
        text(embedded["camera_model"]).alias("camera_model"),
        text(embedded["lens_model"]).alias("lens_model"),
        zero(embedded["pixel_width"]).alias("pixel_width"),
        zero(embedded["pixel_height"]).alias("pixel_height"),
        zero(embedded["rotation_degrees"]).alias("rotation_degrees"),
        zero(embedded["duration_ms"], "bigint").alias("duration_ms"),
        F.coalesce(embedded["has_audio"], F.lit(False)).alias("has_audio"),
        embedded["location"].alias("location"),
        zero(F.coalesce(sidecar["rating"], embedded["rating"])).alias("rating"),
        text(F.coalesce(sidecar["caption"], embedded["caption"])).alias("caption"),
        F.coalesce(sidecar["tags"], embedded["tags"], F.array().cast("array<string>")).alias("tags"),
        conflicts.alias("conflicts"),
    ))


def _warnings(blocks: Column) -> Column:
    return F.transform(F.filter(blocks, lambda b: b["kind"] == "warning"), lambda b: b["text"])


class Extraction:
    """Metadata and problems of decoded files with their sidecars.

    ``blocks`` is ``(path, last_modified_ms, container, damaged, blocks, sidecar_path,
    side_blocks)``; a listed sidecar without ``side_blocks`` could not be read. The bytes are
    decoded once per result asked for.
    """

    def __init__(self, blocks: DataFrame):
        self.blocks = blocks

    @classmethod
    def of_bytes(
        cls, files: DataFrame, sidecars: DataFrame, listed: DataFrame | None = None
    ) -> Extraction:
        """From ``files(path, content, last_modified_ms)`` and readable ``sidecars(path, content)``.

        ``listed(path)`` may name more sidecars than could be read.
        """
        raw = read_containers(files.select("path", "content", "last_modified_ms"))
        packets = read_sidecars(sidecars).select(
            F.col("path").alias("sidecar_path"), F.col("blocks").alias("side_blocks")
        )
        named = attach_sidecar(raw, (sidecars if listed is None else listed).select("path"))
        return cls(named.join(packets, "sidecar_path", "left"))

    @classmethod
    def of_files(cls, files: DataFrame, listed: DataFrame) -> Extraction:
        """From ``files(path, last_modified_ms)`` and ``listed(path)`` that executors can open.

        Only paths are joined; a task then opens a file and its sidecar side by side.
        """
        named = attach_sidecar(files.select("path", "last_modified_ms"), listed.select("path"))
        both = read_sidecar_files(read_container_files(read_heads(named)))
        readable = F.col("sidecar_path").isNotNull() & F.col("side_damaged").isNull()
        return cls(both.withColumn("side_blocks", F.when(readable, F.col("side_blocks"))))

    def metadata(self) -> DataFrame:
        """``(path, metadata, used_sidecar)`` of every readable file."""
        packet = F.get(F.filter("side_blocks", lambda b: (b["kind"] == "xmp") & b["ok"]), F.lit(0))
        return self.blocks.where("container <> 'unknown' AND damaged IS NULL").select(
            "path",
            resolved_metadata(
                embedded_fields(F.col("container"), F.col("blocks")),
                let(packet, lambda b: F.when(b.isNotNull(), interpret_xmp(b["props"]))),
                F.col("path"), kind_from_signature(F.col("container")), F.col("last_modified_ms"),
            ).alias("metadata"),
            packet.isNotNull().alias("used_sidecar"),
        )

    def problems(self) -> DataFrame:
        return extraction_errors(self.blocks)


def extraction_errors(rows: DataFrame) -> DataFrame:
    """``(path, severity, code, message)``: unknown format, broken structure, recovered damage."""
    unsupported = F.struct(
        F.lit("error").alias("severity"), F.lit("unsupportedMedia").alias("code"),
        F.lit("Not a media format this build can read.").alias("message"),
    )
    corrupt = F.struct(
        F.lit("error").alias("severity"), F.lit("corruptData").alias("code"),
        F.col("damaged").alias("message"),
    )
    as_warning = lambda text: F.struct(
        F.lit("warning").alias("severity"), F.lit("corruptData").alias("code"), text.alias("message")
    )
    kind = "array<struct<severity:string,code:string,message:string>>"
    none = F.array().cast(kind)
    unread = F.col("side_blocks").isNull()
    side = F.when(unread, F.array(as_warning(F.lit("The sidecar cannot be read.")))).otherwise(
        F.transform(_warnings(F.col("side_blocks")), as_warning)
    )
    found = (
        F.when(F.col("container") == "unknown", F.array(unsupported))
        .when(F.col("damaged").isNotNull(), F.array(corrupt))
        .otherwise(F.concat(
            F.transform(_warnings(F.col("blocks")), as_warning),
            F.when(F.col("sidecar_path").isNotNull(), side).otherwise(none),
        ))
    )
    return rows.select("path", F.explode(found).alias("p")).select("path", "p.*")


def kind_without_reader(path: Column) -> Column:
    """Without a metadata reader the kind still comes from the extension."""
    return kind_from_extension(base_name(path))


def conflict_report(records: DataFrame) -> DataFrame:
    """Disagreements by field and pair of origins."""
    return (
        records.select(F.explode("metadata.conflicts").alias("c"))
        .groupBy(F.col("c.field").alias("field"), F.col("c.preferred_origin").alias("preferred_origin"),
                 F.col("c.conflicting_origin").alias("conflicting_origin"))
        .agg(F.count("*").alias("records"))
    )
