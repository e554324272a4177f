"""Reconciliation scenarios, brute force on random input, and convergence."""

import random

import pytest
from pyspark.sql import functions as F

from mediaquarry.operators import reconcile as rec

FILES = "path string, indexable boolean, size_bytes bigint, last_modified_ms bigint, digest string, read_error string"
RECORDS = "id string, path string, digest string, size_bytes bigint, last_modified_ms bigint, managed boolean"


def run(spark, files, records):
    listed = spark.createDataFrame(files, FILES)
    known = spark.createDataFrame(records, RECORDS)
    bare = listed.drop("digest", "read_error")
    hashed = listed.select("path", "digest", "read_error").join(
        rec.needs_fingerprint(bare, known), "path", "left_semi"
    )
    out = rec.reconcile(bare, known, hashed, F.concat(F.lit("new:"), "path"))
    return listed, known, out


def outcome(spark, files, records):
    return sorted((r.path, r.id, r["class"]) for r in run(spark, files, records)[2].collect())


def file(path, digest="d", size=1, ms=1, ok=True, indexable=True):
    return (path, indexable, size, ms, digest if ok else None, None if ok else "permissionDenied")


def loop(files, records):
    """The rules one file at a time."""
    known, by_digest = {}, {}
    for r in sorted(records):
        known.setdefault(r[1], []).append(r)
        if r[2]:
            by_digest.setdefault(r[2], []).append(r)
    found, out, seen, failed = {f[0] for f in files}, [], set(), set()
    for path, indexable, size, ms, digest, error in sorted(files, key=lambda f: f[0].split("/")):
        if not indexable:
            out.append((path, known[path][0][0] if path in known else None, "ignored"))
        elif path in known:
            first = known[path][0]
            if size >= 0 and (first[3], first[4]) == (size, ms) and first[5]:
                out.append((path, first[0], "unchanged"))
                seen.add(first[0])
            elif error:
                out.append((path, first[0], "failed"))
                failed.add(path)
            else:
                out.append((path, first[0], "updated"))
                seen.add(first[0])
        elif error:
            out.append((path, None, "failed"))
            failed.add(path)
        else:
            free = [r for r in by_digest.get(digest, []) if r[1] not in found and r[0] not in seen]
            if free:
                out.append((path, free[0][0], "moved"))
                seen.add(free[0][0])
            else:
                out.append((path, "new:" + path, "added"))
    for r in records:
        if r[0] not in seen:
            if r[1] in found and r[1] not in failed:
                out.append((r[1], r[0], "removed"))
            elif r[1] not in found:
                out.append((r[1], r[0], "retained"))
    return sorted(out, key=str)


def test_scenarios(spark):
    files = [
        file("/r/new.jpg", "n"), file("/r/same.jpg", "s"), file("/r/twice.jpg", "t", ms=2),
        file("/r/changed.jpg", "c2", size=9), file("/r/broken.jpg", ok=False, ms=5),
        file("/r/moved/m.jpg", "m"), file("/r/copy1.jpg", "x"), file("/r/copy2.jpg", "x"),
        file("/r/.DS_Store", "z", indexable=False), file("/r/legacy.jpg", "l"),
    ]
    records = [
        ("1", "/r/same.jpg", "s", 1, 1, True), ("2", "/r/twice.jpg", "t", 1, 1, True),
        ("3", "/r/twice.jpg", "t", 1, 1, True), ("4", "/r/changed.jpg", "c1", 1, 1, True),
        ("5", "/r/broken.jpg", "b", 1, 1, True), ("6", "/r/m.jpg", "m", 1, 1, True),
        ("7", "/r/gone.jpg", "g", 1, 1, True), ("8", "/r/.DS_Store", "z", 1, 1, True),
        ("9", "/r/legacy.jpg", "l", 1, 1, False),
    ]
    assert outcome(spark, files, records) == sorted([
        ("/r/new.jpg", "new:/r/new.jpg", "added"), ("/r/same.jpg", "1", "unchanged"),
        ("/r/twice.jpg", "2", "updated"), ("/r/twice.jpg", "3", "removed"),
        ("/r/changed.jpg", "4", "updated"), ("/r/broken.jpg", "5", "failed"),
        ("/r/moved/m.jpg", "6", "moved"), ("/r/copy1.jpg", "new:/r/copy1.jpg", "added"),
        ("/r/copy2.jpg", "new:/r/copy2.jpg", "added"), ("/r/gone.jpg", "7", "retained"),
        ("/r/.DS_Store", "8", "ignored"), ("/r/.DS_Store", "8", "removed"),
        ("/r/legacy.jpg", "9", "updated"),
    ])


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    names = [f"/r/{a}/{b}.jpg" for a in ("a", "a-b", "b") for b in range(12)] + [f"/r/{i}.png" for i in range(20)]
    digests = ["empty"] * 6 + [f"d{i}" for i in range(5)]
    files = [
        file(p, rng.choice(digests), rng.randrange(2), rng.randrange(2), rng.random() > 0.1, rng.random() > 0.1)
        for p in rng.sample(names, 35)
    ]
    records = [
        (f"{i:03d}", rng.choice(names), rng.choice(digests + [""]), rng.randrange(2), rng.randrange(2), rng.random() > 0.2)
        for i in range(60)
    ]
    found = sorted(((r.path, r.id, r["class"]) for r in run(spark, files, records)[2].collect()), key=str)
    assert found == loop(files, records)


def test_many_small_passes_equal_one_clean_pass(spark):
    """Random edit script: listing after listing, the catalogue follows the disk."""
    rng = random.Random(7)
    disk, records = {}, spark.createDataFrame([], RECORDS)
    for step in range(4):
        for _ in range(6):
            action, name = rng.random(), f"/r/{rng.randrange(12)}.jpg"
            if action < 0.6 or not disk:
                disk[name] = (f"d{rng.randrange(6)}", step * 100 + rng.randrange(50))
            elif action < 0.8:
                disk[name] = disk.pop(rng.choice(sorted(disk)))
        files = [file(p, d, 1, ms) for p, (d, ms) in disk.items()]
        listed = spark.createDataFrame(files, FILES)
        bare = listed.drop("digest", "read_error")
        hashed = listed.select("path", "digest", "read_error")
        out = rec.reconcile(bare, records, hashed)
        after = rec.apply_outcomes(records, out, bare)
        kept = after.drop("managed_path", "metadata_replaced")
        records = spark.createDataFrame([tuple(r) for r in kept.select(records.columns).collect()], RECORDS)
    key = lambda df: df.select("path", F.col("digest").alias("fingerprint_key"))
    on_disk = records.join(listed.select("path"), "path", "left_semi")
    assert rec.store_equivalence(key(on_disk), key(listed)).first()["equivalent"]
    assert records.count() == records.select("id").distinct().count()


def test_random_ids_are_settled_once(spark):
    _, known, _ = run(spark, [], [])
    files = spark.createDataFrame([file(f"/r/{i}.jpg", f"d{i}") for i in range(5)], FILES)
    out = rec.reconcile(files.drop("digest", "read_error"), known, files.select("path", "digest", "read_error"))
    assert sorted(r.id for r in out.collect()) == sorted(r.id for r in out.collect())


def test_batches_and_summary(spark):
    _, _, out = run(spark, [file(f"/r/{i:02d}.jpg", f"d{i}") for i in range(10)], [])
    assert sorted(r.batch for r in rec.commit_batches(out, 4).collect()) == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]
    assert {r.batch for r in rec.commit_batches(out, 0).collect()} == {0}
    assert rec.scan_summary(out).first().asDict() == {"added": 10, "updated": 0, "removed": 0, "unchanged": 0, "failed": 0}


def test_store_equivalence_sees_a_double(spark):
    one = spark.createDataFrame([("/a", "k")], "path string, fingerprint_key string")
    row = rec.store_equivalence(one, one.union(one)).first()
    assert (row.left_only, row.right_only, row.equivalent) == (0, 1, False)


def test_a_hot_digest_is_numbered_over_many_tasks(spark):
    """Files and records of a digest pair up in order, however many there are."""
    paths = [(f"/r/{i % 7}/{i:03d}.jpg", "empty" if i % 3 else f"d{i % 5}") for i in range(300)]
    olds = [(f"id{i:03d}", "empty" if i % 4 else f"d{i % 5}") for i in range(250)]
    new = spark.createDataFrame(paths, "path string, digest string")
    gone = spark.createDataFrame(olds, "id string, digest string")
    found = sorted(map(tuple, rec.match_moves(new, gone).collect()))
    want = []
    for digest in {d for _, d in paths}:
        left = sorted((p for p, d in paths if d == digest), key=lambda p: p.split("/"))
        want += zip(left, sorted(i for i, d in olds if d == digest))
    assert found == sorted(want)


def test_written_outcomes_are_counted_on_the_way(spark, tmp_path):
    classes = ["added", "added", "moved", "updated", "removed", "unchanged", "failed", "retained", None]
    rows = spark.createDataFrame([(f"/p/{i}", f"r{i}", c) for i, c in enumerate(classes)], "path string, id string, class string")
    for folder, part in (("all", rows), ("none", rows.where("false"))):
        told = rec.write_outcomes(part, str(tmp_path / folder))
        assert told.drop("warnings").collect() == rec.scan_summary(part).collect()
        assert told.first()["warnings"] == rec.scan_summary(part).first()["failed"]
        assert spark.read.parquet(str(tmp_path / folder)).count() == part.count()
