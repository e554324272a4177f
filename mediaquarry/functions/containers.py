"""Meaning of the raw blocks read from media files: EXIF, movie boxes and XMP as expressions.

The extraction job only reports what bytes say; precedence, units and validity are here.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed_values as fv
from .binding import let
from .capture import from_wall_clock_ms, parse_iso
from .values import clamp_rating, valid_location

CAPTURE_TYPE = "struct<wall_clock:timestamp_ntz,utc_offset_seconds:int>"


def _first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def _last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def _present(items: Column) -> Column:
    return F.filter(items, lambda item: item.isNotNull())


# --- EXIF ---------------------------------------------------------------------------------


def tag_of(tags: Column, directory: str, number: int) -> Column:
    return _first(F.filter(tags, lambda t: (t["dir"] == directory) & (t["tag"] == number)))


def tag_text(tag: Column) -> Column:
    return F.when(tag["type"] == 2, F.regexp_replace(tag["text"], r"^\s+|\s+$", ""))


def tag_integer(tag: Column) -> Column:
    return F.when(tag["type"].isin(1, 3, 4, 9), _first(tag["nums"]))


def tag_rational(tag: Column, index: int) -> Column:
    top, bottom = F.get(tag["nums"], F.lit(2 * index)), F.get(tag["nums"], F.lit(2 * index + 1))
    return F.when(tag["type"].isin(5, 10) & (bottom != 0), top.cast("double") / bottom)


def exif_date(text: Column) -> Column:
    shaped = text.rlike(r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$") & ~text.startswith("0000")
    iso = F.concat(F.replace(F.substring(text, 1, 10), F.lit(":"), F.lit("-")), F.substring(text, 11, 9))
    return F.when(shaped, iso).try_cast("timestamp_ntz")


def exif_offset(text: Column) -> Column:
    hours = F.substring(text, 2, 2).try_cast("int")
    minutes = F.substring(text, 5, 2).try_cast("int")
    usable = text.rlike(r"^[+-]\d{2}.\d{2}") & (hours <= 23) & (minutes <= 59)
    sign = F.when(text.startswith("-"), -1).otherwise(1)
    return F.when(usable, sign * (hours * 3600 + minutes * 60))


def rotation_for_orientation(value: Column) -> Column:
    return (
        F.when(value.isin(3, 4), 180).when(value.isin(5, 6), 90).when(value.isin(7, 8), 270)
        .when(value.isNotNull(), 0)
    )


def _degrees(tag: Column, reference: Column, negative: str) -> Column:
    parts = [tag_rational(tag, i) for i in range(3)]
    sign = F.when(F.coalesce(tag_text(reference).startswith(negative), F.lit(False)), -1.0).otherwise(1.0)
    return F.when(tag["count"] >= 3, sign * (parts[0] + parts[1] / 60.0 + parts[2] / 3600.0))


def _positive_int(value: Column) -> Column:
    return F.when((value > 0) & (value <= 2147483647), value.cast("int"))


# Name → (directory, tag number) of every entry the rules read.
EXIF_TAGS = {
    "make": ("ifd0", fv.TAG_MAKE), "model": ("ifd0", fv.TAG_MODEL),
    "orientation": ("ifd0", fv.TAG_ORIENTATION), "changed": ("ifd0", fv.TAG_DATE_TIME),
    "width": ("ifd0", fv.TAG_WIDTH), "height": ("ifd0", fv.TAG_HEIGHT),
    "taken": ("exif", fv.TAG_DATE_ORIGINAL), "zone_taken": ("exif", fv.TAG_OFFSET_ORIGINAL),
    "zone": ("exif", fv.TAG_OFFSET), "claimed_width": ("exif", fv.TAG_EXIF_WIDTH),
    "claimed_height": ("exif", fv.TAG_EXIF_HEIGHT), "lens": ("exif", fv.TAG_LENS),
    "lat": ("gps", fv.GPS_LAT), "lat_ref": ("gps", fv.GPS_LAT_REF), "lon": ("gps", fv.GPS_LON),
    "lon_ref": ("gps", fv.GPS_LON_REF), "alt": ("gps", fv.GPS_ALT), "alt_ref": ("gps", fv.GPS_ALT_REF),
}


def interpret_exif(tags: Column) -> Column:
    """One EXIF block's tag list → struct of fields; an absent field is NULL."""
    entries = F.struct(*[tag_of(tags, *where).alias(name) for name, where in EXIF_TAGS.items()])
    return let(entries, _exif_fields)


def _exif_fields(e: Column) -> Column:
    text = lambda name: F.nullif(tag_text(e[name]), F.lit(""))
    number = lambda name: let(tag_integer(e[name]), _positive_int)
    wall = F.coalesce(exif_date(tag_text(e["taken"])), exif_date(tag_text(e["changed"])))
    offset = F.coalesce(exif_offset(tag_text(e["zone_taken"])), exif_offset(tag_text(e["zone"])))
    capture = let(
        F.struct(wall.alias("wall_clock"), offset.cast("int").alias("utc_offset_seconds")),
        lambda c: F.when(c["wall_clock"].isNotNull(), c),
    )
    below = F.when(tag_integer(e["alt_ref"]) == 1, -1.0).otherwise(1.0)
    place = let(
        F.struct(
            _degrees(e["lat"], e["lat_ref"], "S").alias("lat"),
            _degrees(e["lon"], e["lon_ref"], "W").alias("lon"),
            (below * tag_rational(e["alt"], 0)).alias("alt"),
        ),
        lambda p: valid_location(p["lat"], p["lon"], p["alt"]),
    )
    return F.struct(
        capture.alias("capture_time"),
        text("make").alias("camera_make"), text("model").alias("camera_model"),
        text("lens").alias("lens_model"),
        number("claimed_width").alias("pixel_width"), number("claimed_height").alias("pixel_height"),
        number("width").alias("primary_width"), number("height").alias("primary_height"),
        let(tag_integer(e["orientation"]), rotation_for_orientation).alias("rotation_degrees"),
        place.alias("location"),
    )


# --- movie boxes ----------------------------------------------------------------------------


def movie_duration_ms(timescale: Column, duration: Column) -> Column:
    usable = (timescale > 0) & (duration > 0)
    return F.when(usable, F.floor(F.try_multiply(duration, F.lit(1000).cast("bigint")) / timescale))


def movie_capture(creation_seconds: Column) -> Column:
    """Seconds since 1904 in UTC; 0 means not recorded."""
    ms = (creation_seconds - fv.MOVIE_EPOCH_SECONDS) * 1000
    return F.when(
        creation_seconds > 0,
        F.struct(
            from_wall_clock_ms(ms).alias("wall_clock"), F.lit(0).alias("utc_offset_seconds")
        ),
    )


def interpret_movie(blocks: Column) -> Column:
    at = lambda b, i: F.get(b["nums"], F.lit(i))
    last = lambda kind, test: _last(F.filter(blocks, lambda b: (b["kind"] == kind) & test(b)))
    # Display sizes are 16.16 fixed point; a sound track has none.
    shown = lambda b: (b["kind"] == "tkhd") & (at(b, 0) >= 65536) & (at(b, 1) >= 65536)
    whole = lambda n: F.floor(n / 65536).cast("int")
    frame = let(_first(F.filter(blocks, shown)), lambda b: F.struct(
        whole(at(b, 0)).alias("w"), whole(at(b, 1)).alias("h")
    ))
    sound = F.exists(blocks, lambda b: (b["kind"] == "hdlr") & (b["text"] == "soun"))
    return let(frame, lambda f: F.struct(
        let(last("mvhd", lambda b: at(b, 0) > 0), lambda b: movie_capture(at(b, 0))).alias("capture_time"),
        f["w"].alias("pixel_width"), f["h"].alias("pixel_height"),
        let(
            last("mvhd", lambda b: (at(b, 1) > 0) & (at(b, 2) > 0)),
            lambda b: movie_duration_ms(at(b, 1), at(b, 2)),
        ).alias("duration_ms"),
        F.when(sound, True).when(F.exists(blocks, lambda b: b["kind"] == "trak"), False).alias("has_audio"),
    ))


# --- XMP --------------------------------------------------------------------------------------


def _whole_number(text: Column) -> Column:
    return let(
        F.regexp_replace(text, r"^\s+|\s+$", ""),
        lambda x: F.when(x.rlike(r"^[+-]?\d+$"), x.try_cast("int")),
    )


def interpret_xmp(props: Column) -> Column:
    """One packet's properties → struct of fields; an absent field is NULL."""
    of = lambda name: F.filter(props, lambda p: p["name"] == name)
    head = lambda p: _first(p["items"])
    lists = F.struct(
        _present(F.transform(of("CreateDate"), lambda p: let(head(p), parse_iso))).alias("dates"),
        _present(F.transform(of("Rating"), lambda p: _whole_number(head(p)))).alias("ratings"),
        of("title").alias("titles"), of("subject").alias("subjects"),
        _first(of("description")).alias("description"),
    )
    return let(lists, lambda v: F.struct(
        _last(v["dates"]).alias("capture_time"),
        let(_last(v["ratings"]), clamp_present).alias("rating"),
        F.coalesce(head(_last(v["titles"])), head(v["description"])).alias("caption"),
        _last(v["subjects"])["items"].alias("tags"),
    ))


def clamp_present(rating: Column) -> Column:
    return F.when(rating.isNotNull(), clamp_rating(rating))


# --- one file ---------------------------------------------------------------------------------


def embedded_fields(container: Column, blocks: Column) -> Column:
    """All blocks of one file → the embedded field set.

    A readable EXIF block replaces everything read before it, earlier XMP included; XMP after it
    is laid on top, packet by packet. Frame dimensions describe the stored picture and win.
    """
    is_exif = F.reverse(F.transform(blocks, lambda b: (b["kind"] == "exif") & b["ok"]))
    behind = F.array_position(is_exif, True)
    start = F.greatest(F.size(blocks) - behind + 1, F.lit(1)).cast("int")
    live = F.when(behind > 0, F.slice(blocks, start, behind.cast("int"))).otherwise(blocks)
    readable = lambda items, kind: F.filter(items, lambda b: (b["kind"] == kind) & b["ok"])
    parts = let(live, lambda now: F.struct(
        let(_last(readable(now, "exif")), lambda b: interpret_exif(b["tags"])).alias("exif"),
        F.transform(readable(now, "xmp"), lambda b: interpret_xmp(b["props"])).alias("packets"),
        interpret_movie(blocks).alias("movie"),
        _last(F.filter(blocks, lambda b: b["kind"] == "frame"))["nums"].alias("frame"),
        _first(F.filter(blocks, lambda b: b["kind"] == "ispe"))["nums"].alias("extent"),
    ))
    return let(parts, lambda p: _fields_of(container, p))


def _fields_of(container: Column, p: Column) -> Column:
    exif, movie = p["exif"], p["movie"]
    from_xmp = lambda name: let(
        _present(F.transform(p["packets"], lambda x: x[name])), _last
    )
    is_movie = container == "isobmff"
    side = lambda i, primary, claimed: (
        F.when(container.isin("jpeg", "png"), F.get(p["frame"], F.lit(i)).cast("int"))
        .when(container == "tiff", F.coalesce(exif[primary], exif[claimed]))
        .when(container == "heif", F.get(p["extent"], F.lit(i)).cast("int"))
        .otherwise(movie[claimed])
    )
    return F.struct(
        F.coalesce(
            from_xmp("capture_time").cast(CAPTURE_TYPE), exif["capture_time"].cast(CAPTURE_TYPE),
            F.when(is_movie, movie["capture_time"]).cast(CAPTURE_TYPE),
        ).alias("capture_time"),
        exif["camera_make"].alias("camera_make"), exif["camera_model"].alias("camera_model"),
        exif["lens_model"].alias("lens_model"),
        side(0, "primary_width", "pixel_width").alias("pixel_width"),
        side(1, "primary_height", "pixel_height").alias("pixel_height"),
        exif["rotation_degrees"].alias("rotation_degrees"),
        F.when(is_movie, movie["duration_ms"]).alias("duration_ms"),
        F.when(is_movie, movie["has_audio"]).alias("has_audio"),
        exif["location"].alias("location"),
        from_xmp("rating").alias("rating"), from_xmp("caption").alias("caption"),
        from_xmp("tags").alias("tags"),
    )
