"""Browse orders, search, projection, versions, requests, cache and sources on small fixtures."""

import os

import pytest
from pyspark.sql import functions as F

from mediaquarry import schemas
from mediaquarry.operators import browse, cache, corpus, projection, requests, search, versions
from mediaquarry.sources import listing, records as files
from mediaquarry.streaming import live

DAY = 86_400_000


def media(spark, rows):
    """``(id, file_name, size, file day, capture day, rating, kind, caption)``."""
    data = [
        (i, "{}", "sha256", i, "/p/" + n, "", "", s, None if f is None else f * DAY, k, n, "", "/p",
         -(1 << 63) if c is None else c * DAY, 0, "", "", 0, 0, 0, r, cap, None, None)
        for i, n, s, f, c, r, k, cap in rows
    ]
    from mediaquarry.functions.paths import file_extension

    return spark.createDataFrame(data, schemas.MEDIA).withColumn("file_extension", file_extension(F.col("file_name")))


def item(i, name="x.jpg", size=1, file=1, capture=1, rating=0, kind="image", caption=""):
    return (i, name, size, file, capture, rating, kind, caption)


def ids(df):
    return [r.id for r in df.collect()]


def test_sort_orders(spark):
    m = media(spark, [item("1", "beta.png", 300, 3, 2), item("2", "Alpha.jpg", 100, 1, 3), item("3", "gamma.jpeg", 200, 2, 1)])
    want = {"captureTime": "312", "fileName": "213", "fileDate": "231", "fileType": "321", "fileSize": "231"}
    for key, order in want.items():
        assert "".join(ids(browse.sorted_by(m, key))) == order
        assert "".join(ids(browse.sorted_by(m, key, True))) == order[::-1]
        positions = browse.positions_by(m, key).orderBy("pos").collect()
        assert "".join(r.id for r in positions) == order and [r.pos for r in positions] == [0, 1, 2]


def test_ties_and_missing_values(spark):
    same = media(spark, [item("id-zzz"), item("id-aaa")])
    for key in browse.SORT_KEYS:
        for down in (False, True):
            assert ids(browse.sorted_by(same, key, down)) == ["id-aaa", "id-zzz"]
    undated = media(spark, [item("dated", file=5, capture=5), item("bbb", file=None, capture=None), item("aaa", file=None, capture=None)])
    assert ids(browse.by_capture_time(undated)) == ["aaa", "bbb", "dated"]
    assert ids(browse.sorted_by(undated, "fileDate")) == ["aaa", "bbb", "dated"]
    names = media(spark, [item("hidden", ".hidden"), item("image", "photo.JPG"), item("plain", "README")])
    assert ids(browse.sorted_by(names, "fileType")) == ["hidden", "plain", "image"]
    assert browse.choose_sort("nonsense", "fileSize") == "fileSize"


def test_pages_filters_and_windows(spark):
    m = media(spark, [item(str(i), capture=i, rating=r, kind=k) for i, (r, k) in enumerate([(0, "image"), (3, "image"), (5, "video"), (1, "video"), (2, "image")])])
    assert ids(browse.capture_page(m, 0, 3)) == ["0", "1", "2"]
    assert ids(browse.capture_page(m, 3, 2)) == ["3", "4"]
    assert ids(browse.capture_page(m, 10, 5)) == [] and len(ids(browse.capture_page(m, 2, -1))) == 3
    assert ids(browse.capture_page_after(m, 1 * DAY, "1", 2)) == ["2", "3"]
    assert ids(browse.with_kind(m, "video")) == ["2", "3"] and ids(browse.min_rating(m, 3)) == ["1", "2"]
    assert ids(browse.visible_window(m, browse.capture_order(), 2, 2, 1)) == ["1", "2", "3"]
    assert ids(browse.visible_window(m, browse.capture_order(), 4, 90, 1)) == ["3", "4"]
    assert browse.effective_retention(10, 0, 9, 5) == 36 and browse.effective_retention(10, -1, -1, 5) == 10


def test_deep_pages_are_cut_from_positions(spark, monkeypatch):
    m = media(spark, [item(f"{i:02d}", capture=i // 3) for i in range(30)])
    monkeypatch.setattr(browse, "TOP_ROWS", 4)
    names = [f"{i:02d}" for i in range(30)]
    for offset, limit in [(0, 3), (2, 9), (25, 90), (30, 2), (0, -1), (7, -1), (40, -1), (5, 0)]:
        page = browse.capture_page(m, offset, limit)
        assert ids(page) == names[offset:][: limit if limit >= 0 else None], (offset, limit)
        if offset and (limit < 0 or offset + limit > 4):
            # Neither a limit nor an offset, which gather rows in one task or on the driver.
            plan = page._jdf.queryExecution().executedPlan().toString()
            assert "Limit" not in plan and "TakeOrdered" not in plan


def test_insertion_only(spark):
    order = lambda text: spark.createDataFrame([(c, i) for i, c in enumerate(text)], "id string, pos bigint")
    for old, new, want in [("abc", "xaybzc", True), ("abc", "acb", False), ("abc", "ab", False), ("", "ab", True), ("ab", "ab", True)]:
        diff = browse.order_preserving_diff(order(old), order(new))
        assert browse.is_insertion_only(diff).first()["insertion_only"] is want


# --- search -----------------------------------------------------------------------------------


def find(spark, rows, query):
    m = media(spark, [item(i, n, caption=c) for i, c, n in rows])
    return [r.id for r in search.search_ids(search.media_tokens(m), search.media_lengths(m), query).collect()]


def test_search_scenarios(spark):
    rows = [("1", "Golden Gate sunset", "DSC_0042.jpg"), ("2", "Golden retriever", "holiday.jpg"),
            ("3", "東京タワー", "c.jpg"), ("4", 'say "hello" loud', "d.jpg"), ("5", "Élan décidé", "e.jpg")]
    want = {
        "golden": {"1", "2"}, "golden gate": {"1"}, "DSC_0042": {"1"}, "0042 dsc": {"1"}, "東京": {"3"},
        '"hello': {"4"}, "": set(), "   ": set(), "zzznomatch": set(), "*": set(), "golden *": {"1", "2"},
        "AND": set(), "gate:sunset": {"1"}, "foo(bar": set(), "-golden": {"1", "2"}, "^golden": {"1", "2"},
        "sunset_gate": set(), "elan DECIDE": {"5"}, "golden jpg": {"1", "2"},
    }
    for query, expected in want.items():
        assert set(find(spark, rows, query)) == expected, query


def test_projection_round_trip(spark, tmp_path):
    from conftest import SMALL
    from mediaquarry.sources import adapters

    r = adapters.records(adapters.Tables(spark, SMALL)).where("id < 'm00000000000000000040'")
    base = str(tmp_path / "projection")
    assert projection.is_stale(projection.projected_state_token(spark, base), "t")
    first = projection.build_projection(r, base)
    tables = projection.open_projection(spark, base)
    assert tables["media"].count() == 40
    token = projection.state_token(r).first()[0]
    assert not projection.is_stale(projection.projected_state_token(spark, base), token)
    broken = r.withColumn("id", F.raise_error(F.lit("boom")))
    with pytest.raises(Exception):
        projection.build_projection(broken, base, "other")
    assert projection.read_pointer(spark, base) == (first, token)
    hits = search.search_ids(tables["media_token"], tables["media_len"], "img_1")
    assert "m00000000000000000001" in ids(hits)


def test_record_files_round_trip(spark, tmp_path):
    from conftest import SMALL
    from mediaquarry.sources import adapters

    r = adapters.records(adapters.Tables(spark, SMALL)).where("id < 'm00000000000000000030'")
    folder = str(tmp_path / "records")
    os.makedirs(folder)
    for row in r.select("id", files.record_json().alias("j")).collect():
        with open(f"{folder}/{row.id}.json", "w") as out:
            out.write(row.j)
    os.makedirs(f"{folder}/_a/.b")
    os.rename(f"{folder}/m00000000000000000003.json", f"{folder}/_a/.b/_x.json")
    for name, text in {"bad.json": "{", "tail.json": '{"id":"x"} y', "list.json": "[1]", "noid.json": "{}", ".library.json": "{}"}.items():
        with open(f"{folder}/{name}", "w") as out:
            out.write(text)
    good, bad = files.scan_records(spark, folder)
    assert projection.state_token(good).first()[0] == projection.state_token(r).first()[0]
    assert sorted(x.problem for x in bad.collect()) == ["corruptData", "corruptData", "corruptData", "invalidId"]
    files.write_records(r, str(tmp_path / "written"))
    rows = spark.read.parquet(str(tmp_path / "written")).collect()
    assert len(rows) == 30 and {x.shard for x in rows} == {"m0"} and all(x.record_file.endswith(".json") for x in rows)
    good, bad = files.scan_records(spark, str(tmp_path / "written"), packed=True)
    assert projection.state_token(good).first()[0] == projection.state_token(r).first()[0] and bad.isEmpty()


def test_legacy_defaults(spark):
    texts = spark.createDataFrame([('{"id":"a","later":{"x":[1]}}',)], "json string")
    row = files.parse_records(texts).first()
    assert (row.identity.size_bytes, row.identity.last_modified_ms, row.metadata.kind) == (-1, None, "unknown")
    assert (row.metadata.rating, row.metadata.tags, row.recipe.revision, row.original_storage) == (0, [], 0, "referenced")
    assert row.extras == {"later": '{"x":[1]}'} and row.problem is None


def test_unknown_members_survive_at_every_level(spark):
    text = (
        '{"id":"a","later":{"x":[1]},"word":"7 up","metadata":{"caption":"c","mood":"calm","n":[1,{"a":"b"}]},'
        '"recipe":{"revision":3,"operations":[{"kind":"new","parameters":{"p":"q"}}],"hint":5}}'
    )
    rows = files.parse_records(spark.createDataFrame([(text,)], "json string")).drop("problem", "json")
    again = files.parse_records(rows.select(files.record_json().alias("json"))).first()
    want = {
        "later": '{"x":[1]}', "word": '"7 up"', "metadata/mood": '"calm"', "metadata/n": '[1,{"a":"b"}]', "recipe/hint": "5",
    }
    assert again.extras == want == rows.first().extras
    assert (again.recipe.revision, again.recipe.operations[0].kind) == (3, "new")
    assert again.recipe.operations[0].parameters == '{"p":"q"}'


# --- versions, requests, cache ----------------------------------------------------------------


def test_commit_restore_and_empty_commit(spark, tmp_path):
    base = str(tmp_path / "store")
    row = lambda *rows: spark.createDataFrame(list(rows), "id string, v int")
    none = row().select("id")
    first = versions.commit(spark, base, row(("a", 1), ("b", 1)), none)
    versions.commit(spark, base, row(("a", 2), ("c", 2)), row(("a", 0), ("b", 0)).select("id"))
    assert sorted(map(tuple, versions.read_version(spark, base).collect())) == [("a", 2), ("c", 2)]
    with pytest.raises(versions.Conflict):
        versions.commit(spark, base, row(), none)
    versions.restore(spark, base, first)
    assert sorted(map(tuple, versions.read_version(spark, base).collect())) == [("a", 1), ("b", 1)]
    with pytest.raises(FileNotFoundError):
        versions.restore(spark, base, "version-none")


def test_deltas_fold_into_a_new_base(spark, tmp_path):
    base, want = str(tmp_path / "store"), {}
    for step in range(6):
        rows = [(f"k{i}", step) for i in range(step, step + 3)]
        gone = [(f"k{step - 1}",)] if step else []
        versions.commit(
            spark, base, spark.createDataFrame(rows, "id string, v int"), spark.createDataFrame(gone, "id string")
        )
        want.update(rows)
        for (name,) in gone:
            want.pop(name)
        if step % 3 == 2:
            versions.fold(spark, base)
        assert dict(map(tuple, versions.read_version(spark, base).collect())) == want


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    batch = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("d", 4, 3)], "id string, v int, seq int")
    once = versions.apply_records(base, batch, "seq")
    twice = versions.apply_records(once, batch, "seq")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("a", 1), ("b", 3), ("d", 4)]


def test_progressive_apply(spark, tmp_path):
    base, source = str(tmp_path / "t"), str(tmp_path / "in")
    versions.publish_version(spark.createDataFrame([("a", 1)], "id string, v int"), base, "token-1")
    for rows in ([("a", 2), ("b", 2)], [("b", 3)]):
        spark.createDataFrame(rows, "id string, v int").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id string, v int").option("maxFilesPerTrigger", 1).parquet(source)
    sink = live.progressive_apply(base)
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, versions.read_version(spark, base).collect())) == [("a", 2), ("b", 3)]
    assert projection.read_pointer(spark, base)[1] == "token-1"


def test_progressive_apply_reads_a_folder_of_parts(spark, tmp_path):
    """A table in several files is streamed whole, like a table in one."""
    from mediaquarry.plans import queries

    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries()["progressive_apply"](spark, str(tmp_path)).collect()
    assert sorted((r.id[-1], r.text, r.version) for r in found) == [("1", "a", 1), ("2", "b", 1), ("3", None, 1)]


def queue(spark, rows):
    return spark.createDataFrame(rows, schemas.WORK_REQUEST)


def job(i, state="pending", key="", priority=2, attempts=0, created=1, not_before=None):
    return (i, "scanRoot", priority, state, key, "{}", attempts, 3, created, not_before, "none")


def test_requests(spark):
    q = queue(spark, [job("1", key="k"), job("2", "running", key="r"), job("3", priority=0), job("4", created=None), job("5", not_before=99)])
    new = queue(spark, [job("n1", key="k"), job("n2", key="r"), job("n3", key="r"), job("n4"), job("n5", "running", key="z"), job("n6", key="z")])
    rows, mapping = requests.enqueue_coalesced(q, new.withColumn("seq", F.col("id")))
    assert sorted(ids(rows)) == ["n2", "n4", "n5", "n6"]
    assert {r.id: r.effective_id for r in mapping.collect()} == {"n1": "1", "n2": "n2", "n3": "n2", "n4": "n4", "n5": "n5", "n6": "n6"}
    assert ids(requests.claimable(q, 50, 10)) == ["3", "4", "1"] and ids(requests.claimable(q, 50, 0)) == []
    assert ids(requests.claimable(q, 50, 10, nulls_last=True)) == ["3", "1", "4"]
    assert ids(requests.list_pending(q)) == ["3", "4", "1", "5"]
    ended = spark.createDataFrame([("2", "failed", "timeout"), ("1", "succeeded", None), ("3", "cancelled", None)], "id string, outcome string, error_code string")
    state = {r.id: (r.state, r.attempts) for r in requests.transition(q, ended).collect()}
    assert state == {"1": ("pending", 0), "2": ("pending", 1), "3": ("cancelled", 0), "4": ("pending", 0), "5": ("pending", 0)}


def test_running_total_shuffles_its_rows_once(spark):
    from mediaquarry.operators.ordering import running_total

    rows = [(i, None if i < 40 or i % 7 == 0 else i * 10**9) for i in range(500)]
    table = spark.createDataFrame(rows, "k long, v long").repartition(5)
    summed = running_total(table, [table["k"]], "v", "so_far")
    so_far, want = None, {}
    for k, v in rows:
        so_far = so_far if v is None else (so_far or 0) + v
        want[k] = so_far
    found = {r["k"]: r["so_far"] for r in summed.collect()}
    # A partition whose first values are null has none until its first value; before, too.
    assert all(found[k] in (w, None) for k, w in want.items()) and all(found[k] == want[k] for k, v in rows if v is not None)
    assert "currentrow" not in summed._jdf.queryExecution().executedPlan().toString()


def test_cache_trim(spark):
    entries = spark.createDataFrame([("a", 10, 1), ("b", 10, 2), ("c", 0, 2), ("d", 10, 3)], schemas.CACHE_ENTRY)
    gone = lambda limit: sorted(r.cache_key for r in cache.cache_trim(entries, limit).where("evicted").collect())
    assert gone(30) == [] and gone(20) == ["a"] and gone(19) == ["a", "b"] and gone(-1) == [] and gone(0) == ["a", "b", "c", "d"]
    wanted = spark.createDataFrame([("a",), ("c",), ("c",), ("e",)], "cache_key string")
    assert sorted(r.cache_key for r in cache.cache_misses(wanted, entries).collect()) == ["c", "e"]


# --- sources ----------------------------------------------------------------------------------


def test_listing_and_hashes(spark, tmp_path):
    root = tmp_path / "lib"
    (root / "a-b").mkdir(parents=True)
    (root / "a" / "deep").mkdir(parents=True)
    for name in (".hidden.jpg", "_x.jpg", "a/1.jpg", "a/deep/2.jpg", "a-b/3.jpg", "a b+c%.jpg"):
        (root / name).write_bytes(name.encode())
    (root / "link.jpg").symlink_to(root / "a" / "1.jpg")
    found = listing.scan_listing(spark, str(root))
    names = [r.path[len(str(root)) + 1:] for r in found.orderBy(F.split("path", "/")).collect()]
    assert names == [".hidden.jpg", "_x.jpg", "a/1.jpg", "a/deep/2.jpg", "a b+c%.jpg", "a-b/3.jpg"]
    assert listing.scan_listing(spark, str(root), follow_symlinks=True).where("is_symlink").count() == 1
    asked = found.select("path").union(spark.createDataFrame([(str(root / "gone.jpg"),)], "path string"))
    hashed = {r.path: (r.digest, r.read_error) for r in listing.hash_files(asked).collect()}
    assert hashed[str(root / "gone.jpg")] == (None, "notFound")
    read = listing.scan_binary(spark, str(root))
    whole = {r.path: r.d for r in read.select("path", F.sha2("content", 256).alias("d")).collect()}
    assert whole[str(root / "a" / "1.jpg")] == hashed[str(root / "a" / "1.jpg")][0]
    assert listing.read_errors(asked, read).where("path LIKE '%gone.jpg' AND code = 'notFound'").count() == 1
    tried = spark.createDataFrame([(str(root),), (str(root / "gone.jpg"),), (None,)], "path string")
    codes = {r.path: r.code for r in listing.read_errors(tried, listing.read_files(tried)).collect()}
    assert codes[str(root)] == "permissionDenied" and codes[str(root / "gone.jpg")] == "notFound"


def test_text_corpus(spark, tmp_path):
    root = tmp_path / "tree"
    for name, text in {
        "src/a b+c.py": "# one\n\nx = 1\r\ny = 2\x0c", "src/b.cpp": "/* a\nb */ c\n// d\nint x;\n", "build/no.py": "x\n",
        "docs/metrics/no.md": "x\n", "x.unknown": "x\n", "Makefile": "#a\n\tb\n", "c.css": "* star\n/* one */\n",
        "src/__init__.py": "", "_util.py": "y = 1\n", ".gitignore": "*.o\n", ".hidden.py": "x\n",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text, newline="")
    rows = corpus.file_lines(corpus.scan_text_corpus(spark, str(root)))
    found = {r.path: (r.language, r.lines, r.blank, r.comment, r.code) for r in rows.collect()}
    assert found == {
        "src/a b+c.py": ("Python", 4, 1, 1, 2), "src/b.cpp": ("C++", 4, 0, 3, 1), "Makefile": ("Make", 2, 0, 1, 1),
        "c.css": ("CSS", 2, 0, 2, 0), "src/__init__.py": ("Python", 0, 0, 0, 0), "_util.py": ("Python", 1, 0, 0, 1),
    }




def test_a_second_edit_keeps_the_first_base(spark):
    from conftest import SMALL
    from mediaquarry.sources import adapters

    r = adapters.records(adapters.Tables(spark, SMALL)).where("original_storage = 'managed'").limit(3).cache()
    ask = lambda rating: r.select("id", F.col("metadata").withField("rating", F.lit(rating)).alias("metadata"), "recipe")
    first = versions.stage_edits(ask(1), r)
    moved = r.withColumn("metadata", F.col("metadata").withField("caption", F.lit("changed meanwhile")))
    again = versions.stage_edits(ask(2), moved, first)
    bases = {x.id: x.base_metadata for x in first.collect()}
    assert {x.id: x.base_metadata for x in again.collect()} == bases and {x.metadata.rating for x in again.collect()} == {2}
    contents = r.select("id", F.col("fingerprint.digest").alias("digest"))
    late = versions.edit_conflicts(again, moved, contents)
    assert {x.conflict for x in late.collect()} == {"changed"}
    good = versions.edit_conflicts(versions.stage_edits(ask(2), r, first), r, contents)
    digests = r.limit(0).select("id", F.lit("d").alias("digest"))
    with pytest.raises(versions.Conflict):
        versions.save_edits(good, r, digests, pending=r.select("id"))
    with pytest.raises(versions.Conflict):
        versions.save_edits(late, moved, digests)


def test_outcomes_of_one_id_apply_in_order(spark):
    queue = spark.createDataFrame(
        [("a", "pending", 0, 3, 5, "none"), ("b", "running", 2, 3, 5, "none")],
        "id string, state string, attempts int, max_attempts int, not_before_ms long, last_error_code string",
    )
    steps = spark.createDataFrame(
        [("a", "claimed", None, 1), ("a", "failed", "timeout", 2), ("a", "cancelled", None, 3), ("b", "failed", "timeout", 1), ("b", "claimed", None, 2)],
        "id string, outcome string, error_code string, n int",
    )
    moved = requests.transition(queue, steps, "n").orderBy("id").collect()
    assert [tuple(r) for r in moved] == [("a", "cancelled", 1, 3, None, "timeout"), ("b", "failed", 3, 3, 5, "timeout")]
    with pytest.raises(Exception, match="need an order"):
        requests.transition(queue, steps).collect()


def test_a_repeated_id_needs_an_order(spark):
    base = spark.createDataFrame([("a", 0)], "id string, v int")
    twice = spark.createDataFrame([("a", 1, 1), ("a", 2, 2)], "id string, v int, n int")
    assert [tuple(r) for r in versions.apply_records(base, twice, "n").collect()] == [("a", 2)]
    with pytest.raises(Exception, match="needs an order"):
        versions.apply_records(base, twice.drop("n")).collect()


def test_ids_keep_every_digit(spark):
    from mediaquarry.sources import adapters

    rows = spark.createDataFrame([(1234567890,), (1234567891,)], "doc_id long")
    assert sorted(r[0] for r in rows.select(adapters._key()).collect()) == ["m00000000001234567890", "m00000000001234567891"]


def test_links_to_folders_end(spark, tmp_path):
    """Links up, across and to each other: each folder behind links is walked once, real paths always."""
    root = tmp_path / "root"
    (root / "a" / "b").mkdir(parents=True)
    outside = tmp_path / "outside"
    outside.mkdir()
    for path in (root / "top.jpg", root / "a" / "b" / "deep.jpg", outside / "far.jpg"):
        path.write_bytes(b"x")
    (root / "a" / "up").symlink_to(root)
    (root / "a" / "b" / "self").symlink_to(root / "a" / "b")
    (root / "z").symlink_to(outside)
    (root / "a" / "z2").symlink_to(outside)
    (outside / "back").symlink_to(root / "a")
    found = listing.scan_listing(spark, str(root), follow_symlinks=True).collect()
    paths = sorted(r.path.removeprefix(f"{root}/") for r in found)
    assert paths == ["a/b/deep.jpg", "top.jpg", "z/far.jpg"]
    assert sorted(r.path for r in listing.scan_listing(spark, str(root)).collect()) == sorted([f"{root}/a/b/deep.jpg", f"{root}/top.jpg"])


def test_links_between_two_depths(spark, tmp_path):
    """A link met before the real folder hides none of the real folder's files."""
    root = tmp_path / "root"
    (root / "x" / "y" / "real").mkdir(parents=True)
    (root / "x" / "y" / "real" / "f.jpg").write_bytes(b"x")
    (root / "link").symlink_to(root / "x" / "y" / "real")
    paths = {r.path.removeprefix(f"{root}/") for r in listing.scan_listing(spark, str(root), True).collect()}
    assert paths == {"x/y/real/f.jpg", "link/f.jpg"}


def test_history_links(spark):
    from mediaquarry.operators import lineage

    chain = [("long", f"{n:04d}", f"{n - 1:04d}" if n else None) for n in range(300)]
    rows = chain + [
        ("fork", "r", ""), ("fork", "a", "r"), ("fork", "b", "r"), ("fork", "c", "b"),
        ("lost", "a", "gone"), ("lost", "b", "a"),
        ("ring", "a", "c"), ("ring", "b", "a"), ("ring", "c", "b"), ("ring", "d", "c"), ("ring", "e", "d"), ("ring", "s", "s"), ("ring", "free", ""),
    ]
    found = {
        (r.library, r.id): (r.depth, r.start_id, r.siblings, r.lost, r.cycle)
        for r in lineage.history_links(spark.createDataFrame(rows, "library string, id string, parent_id string")).collect()
    }
    assert len(found) == len(rows)
    assert found["long", "0000"] == (0, "0000", 1, False, None) and found["long", "0299"] == (299, "0000", 1, False, None)
    assert found["fork", "a"] == (1, "r", 2, False, None) and found["fork", "c"] == (2, "r", 1, False, None)
    assert found["lost", "a"] == (0, "a", 1, True, None) and found["lost", "b"] == (1, "a", 1, False, None)
    assert [found["ring", i][4] for i in "abcdes"] == ["on", "on", "on", "below", "below", "on"]
    assert found["ring", "d"][:3] == (None, None, 2) and found["ring", "free"] == (0, "free", 1, False, None)
    assert lineage.history_links(spark.createDataFrame([], "library string, id string, parent_id string")).count() == 0


def test_token_follows_its_deltas(spark):
    """Edits, new records, an empty batch and leaving records: always the token of the whole table."""
    from mediaquarry.sources import adapters

    r = adapters.records(adapters.Tables.of(spark, "/root/testdata/sf0.001")).limit(40).cache()
    table = r.where(F.substring("id", 2, 20).cast("bigint") % 3 != 0)
    token = projection.state_token(table).first()[0]
    for batch in (
        r.where("false"), r.withColumn("original_storage", F.lit("x")),
        table.withColumn("managed_original_path", F.lit("p")).unionByName(r.where("false")),
    ):
        table, after = versions.apply_with_token(table, batch, token)
        token = after.first()[0]
        assert token == projection.state_token(table).first()[0]
    gone = table.where(F.substring("id", 2, 20).cast("bigint") % 5 == 0)
    left = projection.token_after(token, gone, r.where("false")).first()[0]
    assert left == projection.state_token(table.join(gone.select("id"), "id", "left_anti")).first()[0] != token
