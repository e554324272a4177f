"""A folder of real files, rescanned as it changes, up to browse and search."""

import os

import pytest
from test_media import alt, app1, exif, jpeg, xmp

from mediaquarry.operators import browse, projection, search
from mediaquarry.plans import lifecycle


def counts(result):
    return {k: v for k, v in result.summary.first().asDict().items() if v}


def by_name(spark, store):
    return {r.metadata.file_name: r for r in lifecycle.committed_records(spark, store).collect()}


def test_a_folder_becomes_a_catalogue(spark, tmp_path):
    root, store, target = tmp_path / "photos", str(tmp_path / "store"), str(tmp_path / "projection")
    (root / "trip").mkdir(parents=True)
    (root / "trip" / "a.jpg").write_bytes(jpeg(exif((0x010F, 2, 4, b"Abc\0")), app1(xmp(alt("title", "Golden Gate")))))
    (root / "trip" / "a.jpg.xmp").write_bytes(xmp(alt("title", "Golden Gate sunset"), "xmp:Rating='4'"))
    (root / "b.jpg").write_bytes(b"not a picture")
    (root / "noext").write_bytes(jpeg())
    (root / ".DS_Store").write_bytes(b"junk")
    (root / "copy1.jpg").write_bytes(jpeg(tail=b"\xff\xd9same"))
    (root / "copy1.xmp").write_bytes(b"<broken")
    (root / "copy2.jpg").write_bytes(jpeg(tail=b"\xff\xd9same"))

    with pytest.raises(FileNotFoundError):
        lifecycle.rescan(spark, str(tmp_path / "nowhere"), store)
    first = lifecycle.rescan(spark, str(root), store)
    assert counts(first) == {"added": 5} and first.version
    assert sorted((os.path.basename(r.path), r.code) for r in first.warnings.collect()) == [
        ("b.jpg", "unsupportedMedia"), ("copy1.jpg", "corruptData"),
    ]
    rows = by_name(spark, store)
    a = rows["a.jpg"]
    assert (a.metadata.caption, a.metadata.rating, a.metadata.camera_make, a.metadata.pixel_width) == ("Golden Gate sunset", 4, "Abc", 40)
    assert [c.field for c in a.metadata.conflicts] == ["caption"]
    assert rows["b.jpg"].metadata.kind == "image" and rows["noext"].metadata.kind == "image"
    assert a.managed_original_path.startswith("originals/") and len({r.id for r in rows.values()}) == 5

    assert lifecycle.refresh_projection(spark, store, target)
    assert not lifecycle.refresh_projection(spark, store, target)
    tables = projection.open_projection(spark, target)
    found = search.search_ids(tables["media_token"], tables["media_len"], "gate gold")
    assert [r.id for r in found.collect()] == [a.id]
    assert browse.duplicate_groups(tables["media"]).first().copies == 2

    again = lifecycle.rescan(spark, str(root), store)
    assert counts(again) == {"unchanged": 5} and again.version is None

    (root / "trip" / "a.jpg").rename(root / "moved.jpg")
    (root / "copy2.jpg").write_bytes(jpeg(tail=b"\xff\xd9other"))
    (root / "copy1.jpg").unlink()
    (root / "noext").write_bytes(b"no longer a picture")
    third = lifecycle.rescan(spark, str(root), store)
    assert counts(third) == {"updated": 2, "removed": 1, "unchanged": 1}
    after = by_name(spark, store)
    assert set(after) == {"moved.jpg", "b.jpg", "copy1.jpg", "copy2.jpg"}
    assert after["moved.jpg"].id == a.id and after["copy2.jpg"].id == rows["copy2.jpg"].id
    assert after["copy2.jpg"].fingerprint != rows["copy2.jpg"].fingerprint
    # The sidecar stayed behind, so the moved file speaks for itself again.
    assert after["moved.jpg"].metadata.caption == "Golden Gate"
    assert lifecycle.refresh_projection(spark, store, target)
