"""Scalar rules on metadata, fingerprints, enums and open JSON objects."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed_values as fv
from .binding import let


def quarter_turn(degrees: Column) -> Column:
    turned = F.pmod(degrees, F.lit(360)) + 45
    return (F.floor(turned / 90) % 4 * 90).cast("int")


def clamp_rating(rating: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(5), rating))


def not_negative(value: Column) -> Column:
    return F.greatest(value, F.lit(0))


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def geo_valid(latitude: Column, longitude: Column) -> Column:
    return (
        finite(latitude) & finite(longitude)
        & latitude.between(-90.0, 90.0) & longitude.between(-180.0, 180.0)
    )


def valid_location(latitude: Column, longitude: Column, altitude: Column) -> Column:
    point = F.struct(
        latitude.alias("latitude"), longitude.alias("longitude"),
        F.when(finite(altitude), altitude).alias("altitude_metres"),
    )
    return F.when(geo_valid(latitude, longitude), point)


def normalize_metadata(metadata: Column) -> Column:
    """Rotation to a quarter turn, rating to 0–5, sizes to ≥ 0, invalid location dropped."""
    return let(metadata, _normalized)


def _normalized(m: Column) -> Column:
    place = m["location"]
    return (
        m.withField("rotation_degrees", quarter_turn(m["rotation_degrees"]))
        .withField("rating", clamp_rating(m["rating"]))
        .withField("pixel_width", not_negative(m["pixel_width"]))
        .withField("pixel_height", not_negative(m["pixel_height"]))
        .withField("duration_ms", not_negative(m["duration_ms"]))
        .withField(
            "location",
            valid_location(place["latitude"], place["longitude"], place["altitude_metres"]),
        )
    )


def fingerprint(content: Column) -> Column:
    return F.struct(F.lit("sha256").alias("algorithm"), F.sha2(content, 256).alias("digest"))


def fingerprint_valid(algorithm: Column, digest: Column) -> Column:
    return (F.coalesce(algorithm, F.lit("")) != "") & (F.coalesce(digest, F.lit("")) != "")


def fingerprint_cache_key(algorithm: Column, digest: Column) -> Column:
    return F.when(
        fingerprint_valid(algorithm, digest), F.concat_ws("-", algorithm, digest)
    ).otherwise("")


def render_cache_key(
    fingerprint_key: Column, kind: Column, width: Column, height: Column,
    position_ms: Column, recipe_revision: Column,
) -> Column:
    """Names the bytes, not the item, so equal content shares one entry."""
    return F.concat(
        fingerprint_key, F.lit("/"), kind, F.lit("/"), width.cast("string"), F.lit("x"),
        height.cast("string"), F.lit("/"), position_ms.cast("string"), F.lit("/r"),
        recipe_revision.cast("string"),
    )


def thumbnail_tier(pixels: Column) -> Column:
    out = F.lit(fv.THUMBNAIL_TIERS[-1])
    for tier in reversed(fv.THUMBNAIL_TIERS):
        out = F.when(pixels <= tier, tier).otherwise(out)
    return out


def decode_enum(text: Column, names: list[str], fallback: str) -> Column:
    return F.when(text.isin(names), text).otherwise(fallback)


def decode_media_kind(text: Column) -> Column:
    return decode_enum(text, fv.MEDIA_KINDS, "unknown")


def decode_origin(text: Column) -> Column:
    return decode_enum(text, fv.METADATA_ORIGINS, "unknown")


def decode_operation(text: Column) -> Column:
    return decode_enum(text, fv.OPERATION_KINDS, "unknown")


def decode_request_kind(text: Column) -> Column:
    return decode_enum(text, fv.REQUEST_KINDS, "unknown")


def decode_priority(text: Column) -> Column:
    return decode_enum(text, fv.REQUEST_PRIORITIES, "background")


def decode_state(text: Column) -> Column:
    return decode_enum(text, fv.REQUEST_STATES, "pending")


def decode_error(text: Column) -> Column:
    return decode_enum(text, fv.ERROR_CODES, "internal")


def retryable(error_code: Column) -> Column:
    return error_code.isin(fv.RETRYABLE_ERRORS)


def terminal(state: Column) -> Column:
    return state.isin(fv.TERMINAL_STATES)


def can_retry(state: Column, error_code: Column, attempts: Column, max_attempts: Column) -> Column:
    return (state == "failed") & retryable(error_code) & (attempts < max_attempts)


def looks_unchanged(size_a: Column, ms_a: Column, size_b: Column, ms_b: Column) -> Column:
    same = (size_a >= 0) & (size_b >= 0) & (size_a == size_b) & (ms_a == ms_b)
    return F.coalesce(same, F.lit(False))


def same_file(volume_a: Column, file_a: Column, volume_b: Column, file_b: Column) -> Column:
    same = (volume_a != "") & (file_a != "") & (volume_a == volume_b) & (file_a == file_b)
    return F.coalesce(same, F.lit(False))


def identity_valid(path: Column, size_bytes: Column) -> Column:
    return F.coalesce((path != "") & (size_bytes >= 0), F.lit(False))


def derivative_valid(source_id: Column, revision: Column, kind: Column) -> Column:
    return F.coalesce((source_id != "") & (revision >= 0) & (kind != ""), F.lit(False))


def has_permission(library_valid: Column, local_user: Column, user: Column) -> Column:
    return F.coalesce(library_valid & (user != "") & (user == local_user), F.lit(False))


def is_json_object(text: Column) -> Column:
    """Exactly one JSON object and nothing behind it.

    The parsers stop at the end of the first value, so the text is read inside an array and inside
    an object: trailing text breaks one of the two.
    """
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    inside = F.json_object_keys(F.concat(F.lit('{"r":'), text, F.lit("}"))).isNotNull()
    return F.coalesce(text.rlike(r"^\s*\{") & alone & inside, F.lit(False))


def split_unknown_fields(json_text: Column, known: list[str]) -> Column:
    """Members a build does not know, each kept as the JSON text of its value."""
    return unknown_members(F.from_json(json_text, "map<string,variant>"), known)


def unknown_members(members: Column, known: list[str]) -> Column:
    """The same on members already parsed to ``map<string,variant>``."""
    keep = F.array(*[F.lit(k) for k in [*known, "schemaVersion"]])
    unknown = F.map_filter(members, lambda k, v: ~F.array_contains(keep, k))
    return F.transform_values(unknown, lambda k, v: F.to_json(v))


def merge_unknown_fields(known: Column, unknown: Column) -> Column:
    """Add unknown members without overwriting a known one."""
    keys = F.map_keys(known)
    extra = F.map_filter(unknown, lambda k, v: ~F.array_contains(keys, k))
    return F.map_concat(known, extra)


def provenance(message: Column, prefix: str) -> Column:
    """Checkpoint messages carry their provenance as JSON behind a prefix; others stay as text."""
    body = F.substring(message, F.lit(len(prefix) + 1), F.length(message))
    parsed = F.from_json(
        body, "message string, authorId string, applicationVersion string, parentId string"
    )
    is_object = F.coalesce(message.startswith(prefix), F.lit(False)) & is_json_object(body)
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.struct(
        F.when(is_object, text(parsed["message"])).otherwise(message).alias("message"),
        F.when(is_object, F.coalesce(parsed["authorId"], F.lit(fv.UNKNOWN_AUTHOR)))
        .otherwise(fv.UNKNOWN_AUTHOR).alias("author_id"),
        F.when(is_object, text(parsed["applicationVersion"])).otherwise("")
        .alias("application_version"),
        F.when(is_object, text(parsed["parentId"])).otherwise("").alias("parent_id"),
    )


def encode_provenance(
    message: Column, author: Column, version: Column, parent: Column, prefix: str
) -> Column:
    body = F.to_json(F.struct(
        message.alias("message"), author.alias("authorId"),
        version.alias("applicationVersion"), parent.alias("parentId"),
    ))
    return F.concat(F.lit(prefix), body)
