"""Signatures, containers, EXIF, movies, XMP and the resolution of sources."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import containers as meaning
from ..functions.binding import let
from ..functions.capture import describe_capture, iso_text, wall_clock_ms
from ..functions.signature import classify_signature, kind_from_signature
from ..operators import resolve
from ..sources import adapters, containers as decoder
from . import base_sql as q
from .registry import query


def _hex(number: Column, digits: int) -> Column:
    return F.lpad(F.hex(number.cast("bigint")), digits, "0")


def _ascii(text: Column) -> Column:
    return F.hex(F.encode(text, "US-ASCII"))


def _entry(tag: str, kind: int, count: Column | int, value: Column) -> Column:
    n = F.lit(count) if isinstance(count, int) else count
    return F.concat(F.lit(tag), F.lit(f"{kind:04X}"), _hex(n, 8), value)


def _tiff(d: Column, lang: Column) -> Column:
    """A big-endian TIFF as hex: make, orientation, date, offset and position."""
    date = F.concat(F.lit("20"), F.lpad((d % 24).cast("string"), 2, "0"), F.lit(":0"), (d % 9 + 1).cast("string"),
                    F.lit(":1"), (d % 10).cast("string"), F.lit(" 0"), (d % 10).cast("string"), F.lit(":30:1"),
                    (d % 10).cast("string"))
    offset = F.concat(F.when(d % 2 == 0, "+").otherwise("-"), F.lit("0"), (d % 10).cast("string"), F.lit(":30"))
    south = F.when(d % 3 == 0, _ascii(F.lit("S"))).otherwise(_ascii(F.lit("N")))
    west = F.when(d % 4 == 0, _ascii(F.lit("W"))).otherwise(_ascii(F.lit("E")))
    ratio = lambda n, of: F.concat(_hex(n, 8), _hex(of, 8))
    one, none = F.lit(1), F.lit(0)
    at = lambda n: _hex(F.lit(n), 8)
    return F.concat(
        F.lit("4D4D002A00000008"),
        F.lit("0004"), _entry("010F", 2, 3, F.concat(_ascii(lang), F.lit("0000"))),
        _entry("0112", 3, 1, F.concat(_hex(d % 9, 4), F.lit("0000"))),
        _entry("8769", 4, 1, at(62)), _entry("8825", 4, 1, at(92)), F.lit("00000000"),
        F.lit("0002"), _entry("9003", 2, 20, at(146)), _entry("9011", 2, 7, at(166)), F.lit("00000000"),
        F.lit("0004"), _entry("0001", 2, 2, F.concat(south, F.lit("000000"))), _entry("0002", 5, 3, at(174)),
        _entry("0003", 2, 2, F.concat(west, F.lit("000000"))), _entry("0004", 5, 3, at(198)), F.lit("00000000"),
        _ascii(date), F.lit("00"), _ascii(offset), F.lit("0000"),
        ratio(d % 100, one), ratio(d % 60, F.lit(2)), ratio(none, F.when(d % 25 == 0, 0).otherwise(1)),
        ratio(d % 170, one), ratio(d % 50, one), ratio(F.lit(36), F.lit(10)),
    )


def _jpeg(d: Column, lang: Column, body: Column) -> Column:
    exif = F.concat(F.lit("457869660000"), _tiff(d, lang))
    segment = let(exif, lambda x: F.concat(_hex(F.length(x) / 2 + 2, 4), x))
    return F.concat(
        F.lit("FFD8FFE1"), segment, F.lit("FFC0000B08"),
        _hex(d % 3000 + 1, 4), _hex(d % 4000 + 1, 4), F.lit("01011100FFDA"), body,
    )


def _png(d: Column, body: Column) -> Column:
    return F.concat(
        F.lit("89504E470D0A1A0A0000000D49484452"), _hex(d % 640 + 1, 8), _hex(d % 480 + 1, 8), F.lit("080200000000000000"),
        _hex(F.length(body) / 2, 8), F.lit("74455874"), body, F.lit("00000000"), F.lit("0000000049454E44AE426082"),
    )


def _box(kind: str, *payload: Column) -> Column:
    name = F.lit(kind.encode().hex().upper())
    return let(F.concat(*payload), lambda body: F.concat(_hex(F.length(body) / 2 + 8, 8), name, body))


def _movie(d: Column, body: Column) -> Column:
    mvhd = _box("mvhd", F.lit("00000000"), _hex(F.when(d % 4 == 0, 0).otherwise(d + 3_600_000_000), 8), F.lit("00000000"),
                _hex(F.lit(600), 8), _hex(d * 7, 8), F.lit("00" * 80))
    tkhd = _box("tkhd", F.lit("00" * 76), _hex((d % 1920) * 65536, 8), _hex((d % 1080) * 65536, 8))
    handler = _box("hdlr", F.lit("00" * 8), F.when(d % 3 == 0, _ascii(F.lit("soun"))).otherwise(_ascii(F.lit("vide"))), F.lit("00" * 12))
    return F.concat(
        _box("ftyp", _ascii(F.lit("isom")), F.lit("00000200"), _ascii(F.lit("mp41"))), _box("mdat", body),
        _box("moov", mvhd, _box("trak", tkhd, _box("mdia", handler))),
    )


def _heif(d: Column) -> Column:
    ispe = _box("ispe", F.lit("00000000"), _hex(d % 800 + 1, 8), _hex(d % 600 + 1, 8))
    return F.concat(
        _box("ftyp", _ascii(F.lit("mif1")), F.lit("00000000"), _ascii(F.lit("heic"))),
        _box("meta", F.lit("00000000"), _box("iprp", _box("ipco", ispe))),
    )


@adapters.view
def files(t):
    """``documents`` as media files of six kinds; the whole text is their payload."""
    d = F.col("doc_id")
    body = F.hex(F.encode("text", "UTF-8"))
    kind = d % 7
    content = (
        F.when(kind == 0, _jpeg(d, F.col("lang"), body)).when(kind == 1, _png(d, body)).when(kind == 2, _movie(d, body))
        .when(kind == 3, _heif(d)).when(kind == 4, F.concat(_tiff(d, F.col("lang")), body))
        .when(kind == 5, body).otherwise(F.concat(F.lit("FFD8FFE1FFFF"), body))
    )
    ext = F.element_at(F.array(*[F.lit(e) for e in (".jpg", ".png", ".mp4", ".heic", ".tif", ".jpg", ".jpeg")]), (kind + 1).cast("int"))
    return t.documents.select(
        "doc_id", F.concat(F.lit("/media/"), "source", F.lit("/"), d.cast("string"), ext).alias("path"),
        F.unhex(content).alias("content"), (d * 1_000_003 + 1_500_000_000_000).alias("last_modified_ms"),
    )


def _escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


@adapters.view
def sidecars(t):
    """XMP sidecars of every third document, under the appended or the replaced name."""
    d = F.col("doc_id")
    stem = F.concat(F.lit("/media/"), "source", F.lit("/"), d.cast("string"))
    ext = F.element_at(F.array(*[F.lit(e) for e in (".jpg", ".png", ".mp4", ".heic", ".tif", ".jpg", ".jpeg")]), (d % 7 + 1).cast("int"))
    clean = F.regexp_replace("text", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "")
    title = F.when(d % 2 == 0, F.concat(
        F.lit("<dc:title><rdf:Alt><rdf:li xml:lang='x-default'>"), _escape(clean), F.lit("</rdf:li></rdf:Alt></dc:title>")
    )).otherwise("")
    packet = F.concat(
        F.lit("<x:xmpmeta xmlns:x='adobe:ns:meta/'><rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#'>"
              "<rdf:Description xmlns:xmp='http://ns.adobe.com/xap/1.0/' xmlns:dc='http://purl.org/dc/elements/1.1/' xmp:CreateDate='2019-05-0"),
        (d % 9 + 1).cast("string"), F.lit("T11:45:12"), F.when(d % 4 == 0, "Z").when(d % 4 == 1, "+02:00").otherwise(""),
        F.lit("'><dc:description><rdf:Alt><rdf:li>about "), d.cast("string"), F.lit("</rdf:li></rdf:Alt></dc:description>"),
        title, F.lit("<xmp:Rating>"), (d % 9 - 1).cast("string"), F.lit("</xmp:Rating><dc:subject><rdf:Bag><rdf:li>"),
        F.col("lang"), F.lit("</rdf:li><rdf:li> "), F.col("source"), F.lit(" </rdf:li></rdf:Bag></dc:subject>"),
        F.when(d % 27 == 0, "<broken>").otherwise("</rdf:Description>"), F.lit("</rdf:RDF></x:xmpmeta>"),
    )
    return t.documents.where(d % 3 == 0).select(
        "doc_id", F.concat(stem, F.when(d % 2 == 0, ext).otherwise(""), F.lit(".xmp")).alias("path"),
        F.encode(packet, "UTF-8").alias("content"),
    )


_PATH = """(['.jpg', '.png', '.mp4', '.heic', '.tif', '.jpg', '.jpeg'])[CAST(doc_id % 7 AS INTEGER) + 1] AS ext,
  '/media/' || source || '/' || CAST(doc_id AS VARCHAR) || ext AS path"""

# The expected metadata of every file, from the numbers that went into its bytes.
_FACTS = f"""x AS (SELECT *, {_PATH}, doc_id % 7 AS k, doc_id % 7 IN (0, 4) AS has_exif,
  make_timestamp(2000 + doc_id % 24, doc_id % 9 + 1, 10 + doc_id % 10, doc_id % 10, 30, 10.0 + doc_id % 10) AS exif_wall,
  (CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END) * (doc_id % 10 * 3600 + 1800) AS exif_offset,
  doc_id % 100 + (doc_id % 60) / 2.0 / 60 + 0.0 AS lat0, doc_id % 170 + (doc_id % 50) / 60.0 + 3.6 / 3600 AS lon0
FROM documents),
m AS (SELECT *, CASE WHEN NOT has_exif OR doc_id % 25 = 0 OR lat0 > 90 THEN NULL ELSE CASE WHEN doc_id % 3 = 0 THEN -lat0 ELSE lat0 END END AS lat,
  CASE WHEN NOT has_exif OR doc_id % 25 = 0 OR lat0 > 90 THEN NULL ELSE CASE WHEN doc_id % 4 = 0 THEN -lon0 ELSE lon0 END END AS lon,
  CASE WHEN has_exif THEN exif_wall WHEN k = 2 AND doc_id % 4 <> 0 THEN make_timestamp_ms((doc_id + 3600000000 - 2082844800) * 1000) END AS own_wall,
  CASE WHEN has_exif THEN exif_offset WHEN k = 2 THEN 0 END AS own_offset,
  doc_id % 3 = 0 AND doc_id % 27 <> 0 AS side,
  make_timestamp(2019, 5, doc_id % 9 + 1, 11, 45, 12.0) AS side_wall,
  CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 7200 END AS side_offset,
  CASE k WHEN 0 THEN doc_id % 4000 + 1 WHEN 1 THEN doc_id % 640 + 1 WHEN 3 THEN doc_id % 800 + 1
    WHEN 2 THEN CASE WHEN doc_id % 1920 > 0 AND doc_id % 1080 > 0 THEN doc_id % 1920 ELSE 0 END ELSE 0 END AS w,
  CASE k WHEN 0 THEN doc_id % 3000 + 1 WHEN 1 THEN doc_id % 480 + 1 WHEN 3 THEN doc_id % 600 + 1
    WHEN 2 THEN CASE WHEN doc_id % 1920 > 0 AND doc_id % 1080 > 0 THEN doc_id % 1080 ELSE 0 END ELSE 0 END AS h,
  regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '\\r\\n?', chr(10), 'g') AS clean
FROM x)"""


def _iso(stamp: str) -> str:
    return f"strftime({stamp}, '%Y-%m-%dT%H:%M:%S')"


def _described(stamp: str, offset: str) -> str:
    return (
        f"{_iso(stamp)} || CASE WHEN {offset} IS NULL THEN ' (zone unknown)' ELSE (CASE WHEN {offset} < 0 THEN ' -' ELSE ' +' END)"
        f" || printf('%02d:%02d', abs({offset}) // 3600, abs({offset}) // 60 % 60) END"
    )


def _seen(metadata: Column) -> list[Column]:
    """Resolved metadata as plain columns."""
    c, p = metadata["capture_time"], metadata["location"]
    return [
        metadata["kind"].alias("kind"), metadata["file_name"].alias("file_name"),
        describe_capture(c["wall_clock"], c["utc_offset_seconds"]).alias("captured"),
        metadata["capture_time_origin"].alias("origin"), metadata["camera_make"].alias("make"),
        metadata["pixel_width"].alias("w"), metadata["pixel_height"].alias("h"),
        metadata["rotation_degrees"].alias("rotation"), metadata["duration_ms"].alias("duration_ms"),
        metadata["has_audio"].alias("has_audio"),
        F.round(F.coalesce(p["latitude"], F.lit(-999.0)), 6).alias("latitude"),
        F.round(F.coalesce(p["longitude"], F.lit(-999.0)), 6).alias("longitude"),
        metadata["rating"].alias("rating"), metadata["caption"].alias("caption"),
        F.array_join(metadata["tags"], "|").alias("tags"),
        F.array_join(F.transform(metadata["conflicts"], lambda x: F.concat_ws(
            "~", x["field"], x["preferred_value"], x["conflicting_value"]
        )), "|").alias("conflicts"),
    ]


@query(f"""WITH {_FACTS} SELECT path, CASE WHEN k = 2 THEN 'video' ELSE 'image' END AS kind, CAST(doc_id AS VARCHAR) || ext AS file_name,
  CASE WHEN side THEN {_described('side_wall', 'side_offset')} WHEN own_wall IS NOT NULL THEN {_described('own_wall', 'own_offset')}
    ELSE {_described('make_timestamp_ms(doc_id * 1000003 + 1500000000000)', '0')} END AS captured,
  CASE WHEN side THEN 'sidecar' WHEN own_wall IS NOT NULL THEN 'embedded' ELSE 'fileSystem' END AS origin,
  CASE WHEN has_exif THEN lang ELSE '' END AS make, CAST(w AS INTEGER) AS w, CAST(h AS INTEGER) AS h,
  CAST(CASE WHEN NOT has_exif THEN 0 ELSE CASE doc_id % 9 WHEN 3 THEN 180 WHEN 4 THEN 180 WHEN 5 THEN 90 WHEN 6 THEN 90 WHEN 7 THEN 270 WHEN 8 THEN 270 ELSE 0 END END AS INTEGER) AS rotation,
  CASE WHEN k = 2 THEN doc_id * 7000 // 600 ELSE 0 END AS duration_ms, k = 2 AND doc_id % 3 = 0 AS has_audio,
  round(coalesce(lat, -999), 6) + 0.0 AS latitude, round(coalesce(lon, -999), 6) + 0.0 AS longitude,
  CAST(CASE WHEN side THEN greatest(0, least(5, doc_id % 9 - 1)) ELSE 0 END AS INTEGER) AS rating,
  CASE WHEN NOT side THEN '' WHEN doc_id % 2 = 0 THEN trim(clean, ' ' || chr(9) || chr(10)) ELSE 'about ' || CAST(doc_id AS VARCHAR) END AS caption,
  CASE WHEN side THEN lang || '|' || source ELSE '' END AS tags,
  CASE WHEN side AND own_wall IS NOT NULL THEN 'captureTime~' || {_described('side_wall', 'side_offset')} || '~' || {_described('own_wall', 'own_offset')} ELSE '' END AS conflicts
FROM m WHERE k < 5""")
def extract_metadata(t):
    """Bytes → blocks → fields → sidecars → resolved metadata, end to end."""
    found = resolve.Extraction.of_bytes(files(t), sidecars(t)).metadata()
    return found.select("path", *_seen(F.col("metadata")))


@query(f"""WITH {_FACTS}, p AS (SELECT path, 'error' AS severity, 'unsupportedMedia' AS code FROM m WHERE k = 5
  UNION ALL SELECT path, 'error', 'corruptData' FROM m WHERE k = 6
  UNION ALL SELECT path, 'warning', 'corruptData' FROM m WHERE k = 2 AND doc_id = 0
  UNION ALL SELECT path, 'warning', 'corruptData' FROM m WHERE k < 5 AND doc_id % 27 = 0)
SELECT path, severity, code, count(*) AS n FROM p GROUP BY ALL""")
def extraction_errors(t):
    problems = resolve.Extraction.of_bytes(files(t), sidecars(t)).problems()
    return problems.groupBy("path", "severity", "code").agg(F.count("*").alias("n"))


@query(f"""SELECT * EXCLUDE (ext) FROM (SELECT {_PATH}, (['jpeg', 'png', 'isobmff', 'heif', 'tiff', 'unknown', 'jpeg'])[CAST(doc_id % 7 AS INTEGER) + 1] AS container,
  (['image', 'image', 'video', 'image', 'image', 'unknown', 'image'])[CAST(doc_id % 7 AS INTEGER) + 1] AS kind FROM documents)""")
def classify_signature_of_files(t):
    container = classify_signature(F.col("content"))
    return files(t).select("path", container.alias("container"), kind_from_signature(container).alias("kind"))


@query(f"""WITH {_FACTS} SELECT path, (['jpeg', 'png', 'isobmff', 'heif', 'tiff', 'unknown', 'jpeg'])[CAST(k AS INTEGER) + 1] AS container,
  CAST((['2', '1', '4', '1', '1', '0', '0'])[CAST(k AS INTEGER) + 1] AS INTEGER) + CAST(k = 2 AND doc_id = 2 * 0 AS INTEGER) AS blocks, k = 6 AS damaged FROM m""")
def read_containers(t):
    return decoder.read_containers(files(t)).select(
        "path", "container", F.size("blocks").alias("blocks"), F.col("damaged").isNotNull().alias("damaged")
    )


@query(f"""WITH {_FACTS} SELECT path || '' AS path, CASE WHEN doc_id % 2 = 0 THEN path || '.xmp' ELSE regexp_replace(path, '\\.[a-z0-9]*$', '') || '.xmp' END AS sidecar_path FROM m WHERE doc_id % 3 = 0
UNION ALL SELECT path, '' FROM m WHERE doc_id % 3 <> 0""")
def attach_sidecar(t):
    found = resolve.attach_sidecar(files(t).select("path"), sidecars(t))
    return found.select("path", F.coalesce("sidecar_path", F.lit("")).alias("sidecar_path"))


@query(f"""WITH {_FACTS} SELECT doc_id, doc_id % 27 <> 0 AS readable,
  CASE WHEN doc_id % 27 = 0 THEN '' ELSE {_iso('side_wall')} END AS created,
  CAST(CASE WHEN doc_id % 27 = 0 THEN -1 ELSE greatest(0, least(5, doc_id % 9 - 1)) END AS INTEGER) AS rating,
  CASE WHEN doc_id % 27 = 0 THEN '' WHEN doc_id % 2 = 0 THEN trim(clean, ' ' || chr(9) || chr(10)) ELSE 'about ' || CAST(doc_id AS VARCHAR) END AS caption,
  CASE WHEN doc_id % 27 = 0 THEN '' ELSE lang || '|' || source END AS tags FROM m WHERE doc_id % 3 = 0""")
def read_xmp(t):
    """Sidecar packets; one that is not well-formed is refused whole."""
    packets = sidecars(t)
    read = decoder.read_sidecars(packets).join(packets.select("doc_id", "path"), "path")
    block = F.get(F.filter("blocks", lambda b: (b["kind"] == "xmp") & b["ok"]), F.lit(0))
    fields = F.when(block.isNotNull(), meaning.interpret_xmp(block["props"])).alias("f")
    return read.select("doc_id", block.isNotNull().alias("readable"), fields).select(
        "doc_id", "readable", iso_text(F.col("f.capture_time.wall_clock")).alias("created"),
        F.coalesce("f.rating", F.lit(-1)).alias("rating"), F.coalesce("f.caption", F.lit("")).alias("caption"),
        F.coalesce(F.array_join("f.tags", "|"), F.lit("")).alias("tags"),
    )


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%dT') || printf('%02d:%02d:00', o_orderkey % 24, o_orderkey % 60)
    || CASE WHEN o_orderkey % 5 = 0 THEN ' (zone unknown)' WHEN o_orderkey % 5 = 1 THEN ' (zone unknown)' ELSE (CASE WHEN o_orderkey % 2 = 0 THEN ' +' ELSE ' -' END) || printf('%02d:%02d', o_orderkey % 24, o_orderkey % 60) END END AS captured,
  CAST((['0', '0', '0', '180', '180', '90', '90', '270', '270', '0'])[CAST(o_orderkey % 10 AS INTEGER) + 1] AS INTEGER) AS rotation,
  CASE WHEN o_orderkey % 6 = 0 OR o_custkey % 100 + (o_custkey % 60) / 60.0 > 90 THEN -999 ELSE round((CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END) * (o_custkey % 100 + (o_custkey % 60) / 60.0), 6) + 0.0 END AS latitude,
  CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END AS make FROM orders""")
def interpret_exif(t):
    """``orders`` as EXIF tag lists: dates, offsets, orientation and positions."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    nums = lambda *xs: F.array(*[x.cast("bigint") for x in xs])

    def tag(folder, number, kind, count, text=None, numbers=None):
        return F.struct(
            F.lit(folder).alias("dir"), F.lit(number).alias("tag"), F.lit(kind).alias("type"),
            F.lit(count).cast("bigint").alias("count"), (F.lit(None).cast("string") if text is None else text).alias("text"),
            (F.array().cast("array<bigint>") if numbers is None else numbers).alias("nums"),
        )

    date = F.concat(F.date_format("o_orderdate", "yyyy:MM:dd"), F.lit(" "), two(k % 24), F.lit(":"), two(k % 60), F.lit(":00"))
    offset = F.concat(F.when(k % 2 == 0, "+").otherwise("-"), two(k % 24), F.lit(":"), two(k % 60))
    zero = F.lit("0000:00:00 00:00:00")
    tags = F.array(
        tag("ifd0", 0x010F, 2, 1, F.when(k % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "o_orderpriority"))),
        tag("ifd0", 0x0112, 3, 1, None, nums(k % 10)),
        tag("exif", 0x9003, 2, 20, F.when(k % 7 == 0, zero).when(k % 3 == 0, "garbage").otherwise(date)),
        tag("ifd0", 0x0132, 2, 20, F.when(k % 7 == 0, zero).otherwise(date)),
        tag("exif", 0x9011, 2, 7, F.when(k % 5 == 0, "?").when(k % 5 == 1, "+99:00").otherwise(offset)),
        tag("gps", 1, 2, 2, F.when(k % 3 == 0, "S").otherwise("N")),
        tag("gps", 2, 5, 3, None, nums(c % 100, F.lit(1), c % 60, F.lit(1), F.lit(0), F.when(k % 6 == 0, 0).otherwise(1))),
        tag("gps", 4, 5, 3, None, nums(F.lit(10), F.lit(1), F.lit(0), F.lit(1), F.lit(0), F.lit(1))),
    )
    f = meaning.interpret_exif(F.col("tags")).alias("f")
    return t.orders.select("o_orderkey", tags.alias("tags")).select("o_orderkey", f).select(
        "o_orderkey",
        describe_capture(F.col("f.capture_time.wall_clock"), F.col("f.capture_time.utc_offset_seconds")).alias("captured"),
        F.col("f.rotation_degrees").alias("rotation"),
        F.round(F.coalesce("f.location.latitude", F.lit(-999.0)), 6).alias("latitude"),
        F.coalesce("f.camera_make", F.lit("")).alias("make"),
    )


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_orderkey % 5 = 0 THEN -1 ELSE CAST(l_quantity AS BIGINT) * 1000 // (l_suppkey % 50 + 1) END AS duration_ms,
  CASE WHEN l_orderkey % 4 = 0 THEN -1 ELSE (l_orderkey + 2500000000 - 2082844800) * 1000 END AS captured_ms,
  CAST(CASE WHEN l_linenumber % 2 = 0 AND l_partkey % 300 > 0 THEN l_partkey % 300 ELSE 640 END AS INTEGER) AS w,
  CASE WHEN l_linenumber = 7 THEN 'unknown' WHEN l_returnflag = 'R' THEN 'yes' ELSE 'no' END AS audio FROM lineitem""")
def interpret_movie(t):
    """``lineitem`` as movie boxes."""
    k = F.col("l_orderkey")

    def block(kind, *numbers, text=None):
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(True).alias("ok"),
            F.array(*[n.cast("bigint") for n in numbers]).cast("array<bigint>").alias("nums"),
            (F.lit(None).cast("string") if text is None else text).alias("text"),
        )

    blocks = F.filter(F.array(
        block("mvhd", F.when(k % 4 == 0, 0).otherwise(k + 2_500_000_000), F.col("l_suppkey") % 50 + 1,
              F.when(k % 5 == 0, 0).otherwise(F.col("l_quantity").cast("bigint"))),
        F.when(F.col("l_linenumber") != 7, block("trak")),
        block("tkhd", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey") % 300 * 65536).otherwise(0), F.lit(480 * 65536)),
        block("tkhd", F.lit(640 * 65536), F.lit(480 * 65536)),
        F.when(F.col("l_linenumber") != 7, block("hdlr", text=F.when(F.col("l_returnflag") == "R", "soun").otherwise("vide"))),
    ), lambda b: b.isNotNull())
    f = meaning.interpret_movie(F.col("b")).alias("f")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return t.lineitem.select(*keys, blocks.alias("b")).select(*keys, f).select(
        *keys, F.coalesce("f.duration_ms", F.lit(-1)).alias("duration_ms"),
        F.coalesce(wall_clock_ms(F.col("f.capture_time.wall_clock")), F.lit(-1)).alias("captured_ms"),
        F.col("f.pixel_width").alias("w"),
        F.when(F.col("f.has_audio"), "yes").when(~F.col("f.has_audio"), "no").otherwise("unknown").alias("audio"),
    )


@query(f"""WITH {q.DOC}, s AS (SELECT id, doc_id, text, lang, source, doc_id % 3 <> 0 AS has_cap, doc_id % 5 <> 0 AS side_cap,
  CAST(doc_id % 6 AS INTEGER) AS r1, CAST(doc_id % 4 AS INTEGER) AS r2 FROM doc)
SELECT id, CASE WHEN side_cap THEN CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END WHEN has_cap THEN text ELSE '' END AS caption,
  CASE WHEN doc_id % 2 = 0 THEN r2 ELSE r1 END AS rating,
  CASE WHEN has_cap AND side_cap THEN 1 ELSE 0 END + CASE WHEN doc_id % 2 = 0 AND r1 <> r2 THEN 1 ELSE 0 END + CASE WHEN lang <> source THEN 1 ELSE 0 END AS conflicts,
  source AS tags FROM s""")
def resolve_sources(t):
    """Embedded against sidecar values, absent and erased ones included."""
    d = F.col("doc_id")
    capture = F.lit(None).cast(meaning.CAPTURE_TYPE).alias("capture_time")
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    embedded = F.struct(
        capture, null("string", "camera_make"), null("string", "camera_model"), null("string", "lens_model"),
        null("int", "pixel_width"), null("int", "pixel_height"), null("int", "rotation_degrees"),
        null("bigint", "duration_ms"), null("boolean", "has_audio"),
        null("struct<latitude:double,longitude:double,altitude_metres:double>", "location"),
        (d % 6).cast("int").alias("rating"), F.when(d % 3 != 0, F.col("text")).alias("caption"), F.array("lang").alias("tags"),
    )
    side = F.struct(
        capture, F.when(d % 2 == 0, (d % 4).cast("int")).alias("rating"),
        F.when(d % 5 != 0, F.when(d % 7 == 0, "").otherwise(F.col("source"))).alias("caption"), F.array("source").alias("tags"),
    )
    rows = t.documents.select(
        F.concat(F.lit("m"), F.lpad(d.cast("string"), 20, "0")).alias("id"), embedded.alias("e"), side.alias("s")
    )
    m = resolve.resolved_metadata(F.col("e"), F.col("s"), F.col("id"), F.lit("image"), F.lit(0).cast("bigint")).alias("m")
    return rows.select("id", m).select(
        "id", "m.caption", "m.rating", F.size("m.conflicts").alias("conflicts"), F.array_join("m.tags", "|").alias("tags")
    )


@query(f"""WITH {q.DOC} SELECT CASE WHEN doc_id % 12 = 0 THEN 'caption' ELSE 'rating' END AS field, 'sidecar' AS preferred_origin,
  'embedded' AS conflicting_origin, count(*) AS records FROM doc WHERE doc_id % 6 = 0 GROUP BY 1""")
def conflict_report(t):
    return resolve.conflict_report(adapters.records(t))
