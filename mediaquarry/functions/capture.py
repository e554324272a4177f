"""Wall-clock capture times. They carry no zone, so nothing here reads the session zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed_values as fv
from .binding import let

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def wall_clock_ms(wall: Column) -> Column:
    """Milliseconds since 1970 as if the wall clock were UTC (exact in any session zone)."""
    whole = (
        F.unix_date(wall.cast("date")).cast("bigint") * 86400
        + F.hour(wall) * 3600 + F.minute(wall) * 60
    )
    return whole * 1000 + F.floor(F.extract(F.lit("SECOND"), wall) * 1000).cast("bigint")


def from_wall_clock_ms(ms: Column) -> Column:
    return F.timestamp_add("MILLISECOND", ms, F.expr(_EPOCH))


def capture_sort_key(wall: Column) -> Column:
    """The offset is ignored; a missing time sorts before every other."""
    return F.coalesce(wall_clock_ms(wall), F.lit(fv.NO_CAPTURE_KEY).cast("bigint"))


def capture_to_utc(wall: Column, offset_seconds: Column) -> Column:
    """Known only when the offset is known."""
    return F.timestamp_add("SECOND", -offset_seconds, wall)


def iso_text(wall: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss``, or empty. Formatting by pattern would go through the session zone."""
    return F.coalesce(F.replace(F.substring(wall.cast("string"), 1, 19), F.lit(" "), F.lit("T")), F.lit(""))


def iso_with_ms(wall: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss.SSS``, or empty."""
    fraction = F.substring(F.rpad(F.substring(wall.cast("string"), 21, 6), 3, "0"), 1, 3)
    return F.when(wall.isNotNull(), F.concat(iso_text(wall), F.lit("."), fraction)).otherwise("")


def _two(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def describe_capture(wall: Column, offset_seconds: Column) -> Column:
    """``2019-05-04T11:45:12 +02:00``, ``… (zone unknown)``, or empty."""
    size = F.abs(offset_seconds)
    minutes = F.floor(size / 60)
    sign = F.when(offset_seconds <= -60, "-").otherwise("+")
    zone = F.concat(
        F.lit(" "), sign, _two(F.floor(minutes / 60)), F.lit(":"), _two(minutes % 60)
    )
    text = F.concat(iso_text(wall), F.coalesce(zone, F.lit(" (zone unknown)")))
    return F.when(wall.isNotNull(), text).otherwise("")


def iso_ms_text(ms: Column) -> Column:
    """An instant in milliseconds as ISO text in UTC, or empty."""
    return F.when(
        ms.isNotNull(), F.concat(iso_with_ms(from_wall_clock_ms(ms)), F.lit("Z"))
    ).otherwise("")


def parse_iso(text: Column) -> Column:
    """ISO 8601 text → ``struct(wall_clock, utc_offset_seconds)``; NULL when invalid."""
    pattern = (
        r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(:\d{2})?(?:[.,](\d{1,9}))?"
        r"(Z|[+-]\d{2}(?::?\d{2})?)?)?$"
    )
    return let(
        F.transform(F.array(*[F.lit(i) for i in range(1, 6)]), lambda i: F.call_function("regexp_extract", text, F.lit(pattern), i)),
        lambda p: let(_parsed(p, text.rlike(pattern)), lambda c: F.when(c["wall_clock"].isNotNull(), c)),
    )


def _parsed(parts: Column, shaped: Column) -> Column:
    """Date, hours and minutes, seconds, fraction, zone → wall clock and offset."""
    part = lambda i: F.get(parts, F.lit(i))
    or_else = lambda i, default: F.coalesce(F.nullif(part(i), F.lit("")), F.lit(default))
    wall = F.when(shaped, F.concat(
        part(0), F.lit(" "), or_else(1, "00:00"), or_else(2, ":00"), F.lit("."),
        F.substring(F.rpad(part(3), 3, "0"), 1, 3),
    )).try_cast("timestamp_ntz")
    digits = F.rpad(F.regexp_replace(part(4), "[^0-9]", ""), 4, "0")
    seconds = let(digits, lambda d: (
        F.substring(d, 1, 2).try_cast("int") * 3600 + F.substring(d, 3, 2).try_cast("int") * 60
    ))
    offset = (
        F.when(part(4) == "Z", 0).when(part(4).startswith("-"), -seconds)
        .when(part(4).startswith("+"), seconds)
    )
    return F.struct(wall.alias("wall_clock"), offset.cast("int").alias("utc_offset_seconds"))
