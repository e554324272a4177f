"""Container decoding and the meaning of what was read."""

import datetime as dt
import struct

import pytest
from pyspark.sql import functions as F

from mediaquarry.functions import capture, containers as meaning, recipe, signature, values
from mediaquarry.operators import resolve
from mediaquarry.sources.containers import decode

FILES = "path string, content binary, last_modified_ms bigint"


def tiff(entries, order="<", extra=b""):
    """``entries``: (tag, type, count, four bytes) of one directory, then ``extra``."""
    body = struct.pack(order + "H", len(entries))
    for tag, kind, count, value in entries:
        body += struct.pack(order + "HHI", tag, kind, count) + value.ljust(4, b"\0")
    head = b"II" if order == "<" else b"MM"
    return head + struct.pack(order + "HI", 42, 8) + body + b"\0\0\0\0" + extra


def segment(marker, payload):
    return bytes([0xFF, marker]) + struct.pack(">H", len(payload) + 2) + payload


def jpeg(*segments, frame=True, tail=b"\xff\xd9"):
    sof = segment(0xC0, struct.pack(">BHHB", 8, 30, 40, 1) + b"\x01\x11\x00") if frame else b""
    return b"\xff\xd8" + b"".join(segments) + sof + tail


def xmp(body="", attributes=""):
    return (
        "<x:xmpmeta xmlns:x='adobe:ns:meta/'><rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#'>"
        "<rdf:Description xmlns:xmp='http://ns.adobe.com/xap/1.0/' xmlns:dc='http://purl.org/dc/elements/1.1/' "
        f"{attributes}>{body}</rdf:Description></rdf:RDF></x:xmpmeta>"
    ).encode()


def alt(name, *items, holder="Alt"):
    listed = "".join(f"<rdf:li>{i}</rdf:li>" for i in items)
    return f"<dc:{name}><rdf:{holder}>{listed}</rdf:{holder}></dc:{name}>"


def app1(packet):
    return segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + packet)


def exif(*entries, extra=b""):
    return segment(0xE1, b"Exif\0\0" + tiff(list(entries), extra=extra))


def date_entry(at=64):
    return (0x0132, 2, 20, struct.pack("<I", at))


def extract(spark, files, sidecars=(), listed=None):
    rows = spark.createDataFrame([(p, c, 1_000) for p, c in files], FILES)
    side = spark.createDataFrame([(p, c) for p, c in sidecars], "path string, content binary")
    names = None if listed is None else spark.createDataFrame([(p,) for p in listed], "path string")
    found = resolve.Extraction.of_bytes(rows, side, names)
    bad = sorted((r.path, r.severity, r.code) for r in found.problems().collect())
    return {r.path: r.metadata for r in found.metadata().collect()}, bad


def test_signatures(spark):
    cases = {
        b"\xff\xd8\xff\xe0": "jpeg", b"\x89PNG\r\n\x1a\n": "png", b"II*\0": "tiff", b"MM\0*": "tiff",
        b"\0\0\0\x18ftypisom\0\0\0\0mp41": "isobmff", b"\0\0\0\x18ftypmif1\0\0\0\0heic": "heif",
        b"\0\0\0\x18ftypisom\0\0\0\0avif": "heif", b"\0\0\0\x18ftypisomavif": "isobmff",
        b"\0\0\0\x18ftypisom\0\0\0\0mp41mp42iso2iso3heic": "isobmff", b"": "unknown", b"\xff\xd8": "unknown",
        b"\0\0\0\x18ftyp": "isobmff", b"hello": "unknown",
    }
    rows = spark.createDataFrame(list(cases.items()), "content binary, want string")
    found = rows.select("want", signature.classify_signature(F.col("content")).alias("got")).collect()
    assert [(r.got, r.want) for r in found if r.got != r.want] == []


def test_jpeg_exif_and_fallback_date(spark):
    date = b"2020:02:29 23:59:58\0"
    dated = jpeg(exif((0x010F, 2, 4, b"Abc\0"), (0x0112, 3, 1, b"\x06\0"), date_entry(8 + 2 + 36 + 4), extra=date))
    found, bad = extract(spark, [("/m/a.jpg", dated), ("/m/b.jpg", jpeg())])
    a, b = found["/m/a.jpg"], found["/m/b.jpg"]
    assert (a.camera_make, a.rotation_degrees, a.pixel_width, a.pixel_height) == ("Abc", 90, 40, 30)
    assert a.capture_time.wall_clock == dt.datetime(2020, 2, 29, 23, 59, 58)
    assert (a.capture_time.utc_offset_seconds, a.capture_time_origin) == (None, "embedded")
    assert (b.capture_time.wall_clock, b.capture_time_origin) == (dt.datetime(1970, 1, 1, 0, 0, 1), "fileSystem")
    assert bad == []


def test_order_of_exif_and_xmp_segments(spark):
    packet = xmp(alt("title", "early") + alt("subject", "x", "y", holder="Bag"), "xmp:Rating='4'")
    after = jpeg(exif((0x010F, 2, 4, b"Abc\0")), app1(packet))
    before = jpeg(app1(packet), exif((0x010F, 2, 4, b"Abc\0")))
    damaged = jpeg(app1(packet), segment(0xE1, b"Exif\0\0XX"))
    found, bad = extract(spark, [("/a.jpg", after), ("/b.jpg", before), ("/c.jpg", damaged)])
    assert (found["/a.jpg"].caption, found["/a.jpg"].rating, found["/a.jpg"].tags) == ("early", 4, ["x", "y"])
    assert (found["/b.jpg"].caption, found["/b.jpg"].rating, found["/b.jpg"].tags) == ("", 0, [])
    assert found["/c.jpg"].caption == "early"
    assert bad == [("/c.jpg", "warning", "corruptData")]


def test_damage(spark):
    files = [
        ("/cut.jpg", jpeg(frame=False)), ("/late.jpg", jpeg(tail=b"\xff\xe1\xff\xff")), ("/empty.jpg", b""),
        ("/text.jpg", b"not a picture"), ("/bare.png", b"\x89PNG\r\n\x1a\n"), ("/bad.tif", b"II*\0\xff\xff\xff\xff"),
        ("/x.mp4", b"\0\0\0\x10ftypisom\0\0\0\0"),
    ]
    found, bad = extract(spark, files)
    assert set(found) == {"/late.jpg", "/x.mp4"}
    assert bad == [
        ("/bad.tif", "error", "corruptData"), ("/bare.png", "error", "corruptData"),
        ("/cut.jpg", "error", "corruptData"), ("/empty.jpg", "error", "unsupportedMedia"),
        ("/late.jpg", "warning", "corruptData"), ("/text.jpg", "error", "unsupportedMedia"),
        ("/x.mp4", "warning", "corruptData"),
    ]
    assert found["/x.mp4"].kind == "video"


@pytest.mark.parametrize("container", ["jpeg", "png", "tiff", "heif", "isobmff"])
def test_any_cut_or_flipped_byte_is_survived(container):
    box = lambda kind, body: struct.pack(">I4s", len(body) + 8, kind) + body
    whole = {
        "jpeg": jpeg(exif((0x010F, 2, 4, b"Abc\0"), (0x8769, 4, 1, struct.pack("<I", 8))), app1(xmp())),
        "png": b"\x89PNG\r\n\x1a\n" + b"\0\0\0\x0dIHDR" + struct.pack(">II", 3, 4) + b"\0" * 9 + b"\0\0\0\x04eXIfMM\0*" + b"\0" * 4,
        "tiff": tiff([(0x0100, 3, 1, b"\x05\0"), (0x8825, 4, 1, struct.pack("<I", 8))]),
        "heif": box(b"ftyp", b"mif1\0\0\0\0") + box(b"meta", b"\0" * 4 + box(b"iprp", box(b"ipco", box(b"ispe", b"\0" * 12)))),
        "isobmff": box(b"ftyp", b"isom\0\0\0\0") + box(b"moov", box(b"mvhd", b"\0" * 100) + box(b"trak", box(b"tkhd", b"\0" * 84))),
    }[container]
    for at in range(len(whole)):
        decode(container, whole[:at])
        for value in (0x00, 0x7F, 0xFF):
            decode(container, whole[:at] + bytes([value]) + whole[at + 1:])


def test_sidecar_wins_and_conflicts_are_kept(spark):
    embedded = app1(xmp(alt("title", "camera"), "xmp:Rating='2' xmp:CreateDate='2019-05-04T11:45:12Z'"))
    side = xmp(alt("title", "person"), "xmp:Rating='5' xmp:CreateDate='2019-05-04T13:45:12+02:00'")
    files = [("/d/a.jpg", jpeg(embedded)), ("/d/b.jpg", jpeg(embedded)), ("/d/c.jpg", jpeg(embedded)), ("/d/e.jpg", jpeg(embedded))]
    sidecars = [("/d/a.jpg.xmp", side), ("/d/a.xmp", xmp(alt("title", "never"))), ("/d/b.xmp", side), ("/d/c.xmp", b"<broken")]
    listed = [p for p, _ in sidecars] + ["/d/e.jpg.xmp"]
    found, bad = extract(spark, files, sidecars, listed)
    for name in ("/d/a.jpg", "/d/b.jpg"):
        assert (found[name].caption, found[name].rating, found[name].capture_time_origin) == ("person", 5, "sidecar")
        assert [tuple(c) for c in found[name].conflicts] == [
            ("captureTime", "sidecar", "embedded", "2019-05-04T13:45:12 +02:00", "2019-05-04T11:45:12 +00:00"),
            ("caption", "sidecar", "embedded", "person", "camera"), ("rating", "sidecar", "embedded", "5", "2"),
        ]
    assert (found["/d/c.jpg"].caption, found["/d/c.jpg"].conflicts) == ("camera", [])
    assert bad == [("/d/c.jpg", "warning", "corruptData"), ("/d/e.jpg", "warning", "corruptData")]


def test_xmp_rules(spark):
    cases = {
        "last rating wins": (xmp("<xmp:Rating>3</xmp:Rating>", "xmp:Rating='1'"), (3, None)),
        "not a number": (xmp("<xmp:Rating>x</xmp:Rating>", "xmp:Rating='1'"), (1, None)),
        "clamped": (xmp(attributes="xmp:Rating='-7'"), (0, None)),
        "title over description": (xmp(alt("description", "d") + alt("title", "t")), (None, "t")),
        "description alone": (xmp(alt("description", "d", "e")), (None, "d")),
        "empty title is an erasure": (xmp(attributes="dc:title=''"), (None, "")),
    }
    blocks = [(name, decode("jpeg", jpeg(app1(packet)))[1]) for name, (packet, _) in cases.items()]
    from mediaquarry import schemas

    rows = spark.createDataFrame(blocks, f"name string, blocks array<{schemas.BLOCK}>")
    e = meaning.embedded_fields(F.lit("jpeg"), F.col("blocks")).alias("e")
    found = {r.name: (r.e.rating, r.e.caption) for r in rows.select("name", e).collect()}
    assert found == {name: want for name, (_, want) in cases.items()}


def test_dates(spark):
    texts = ["2019-05-04T11:45:12Z", "2019-05-04T11:45:12.5-04:30", "2019-05-04", "2019-05-04T11:45", "2019-02-30T00:00:00", "x", "2021-03-28T02:30:00"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", capture.parse_iso(F.col("t")).alias("c")).collect()
    found = {r.t: None if r.c is None else (r.c.wall_clock, r.c.utc_offset_seconds) for r in rows}
    assert found == {
        texts[0]: (dt.datetime(2019, 5, 4, 11, 45, 12), 0),
        texts[1]: (dt.datetime(2019, 5, 4, 11, 45, 12, 500000), -16200),
        texts[2]: (dt.datetime(2019, 5, 4), None), texts[3]: (dt.datetime(2019, 5, 4, 11, 45), None),
        texts[4]: None, texts[5]: None, texts[6]: (dt.datetime(2021, 3, 28, 2, 30), None),
    }


def test_wall_clock_key_ignores_offset_and_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            row = spark.range(1).select(
                capture.capture_sort_key(F.expr("TIMESTAMP_NTZ'2021-03-14 02:30:00.123'")).alias("gap"),
                capture.capture_sort_key(F.expr("CAST(NULL AS TIMESTAMP_NTZ)")).alias("none"),
            ).first()
            assert (row.gap, row.none) == (1_615_689_000_123, -(1 << 63))
            gap = F.expr("TIMESTAMP_NTZ'2021-03-14 02:30:00.12'")
            texts = spark.range(1).select(
                capture.iso_with_ms(gap), capture.iso_ms_text(F.lit(1_615_689_000_123)), capture.describe_capture(gap, F.lit(-1800))
            ).first()
            assert tuple(texts) == ("2021-03-14T02:30:00.120", "2021-03-14T02:30:00.123Z", "2021-03-14T02:30:00 -00:30")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_normalise(spark):
    rows = spark.createDataFrame([(-90,), (450,), (316,), (44,), (45,), (-1,)], "d int")
    assert [r[0] for r in rows.select(values.quarter_turn(F.col("d"))).collect()] == [270, 90, 0, 0, 90, 0]


def test_recipe_outcomes(spark):
    op = lambda kind, text: (kind, text)
    cases = [
        ([op("crop", '{"x":0,"y":0,"width":10,"height":20}')], (10, 20, None)),
        ([op("crop", '{"x":1,"y":0,"width":100,"height":20}')], (100, 50, "conflict")),
        ([op("crop", '{"x":"0","y":0,"width":10,"height":20}')], (100, 50, "conflict")),
        ([op("rotate", '{"degrees":90}'), op("orientation", '{"value":6}')], (100, 50, None)),
        ([op("rotate", '{"degrees":-270}')], (50, 100, None)), ([op("rotate", '{"degrees":45}')], (100, 50, "conflict")),
        ([op("orientation", '{"value":9}')], (100, 50, "conflict")), ([op("trim", "{}")], (100, 50, "unsupportedMedia")),
        ([op("rotate", '{"degrees":90}'), op("later", "{}")], (100, 50, "unsupportedMedia")), ([], (100, 50, None)),
    ]
    schema = "n int, ops array<struct<kind:string,parameters:string>>"
    rows = spark.createDataFrame([(i, ops) for i, (ops, _) in enumerate(cases)], schema)
    out = recipe.recipe_outcome(F.col("ops"), F.lit(100), F.lit(50)).alias("o")
    assert [tuple(r.o) for r in rows.select("n", out).orderBy("n").collect()] == [want for _, want in cases]


def test_parsed_packets_leave_a_worker_in_small_parts():
    """An Arrow batch of many packets is answered in parts, in order and whole."""
    import pandas as pd

    from mediaquarry.sources import containers

    batch = pd.DataFrame({"path": [str(n) for n in range(1000)], "content": [b"<x/>"] * 1000})
    parts = list(containers._parse_packets(iter([batch])))
    assert max(len(p) for p in parts) <= 256
    assert [path for p in parts for path in p["path"]] == list(batch["path"])
