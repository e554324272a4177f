"""What the physical plans must look like, whatever the data size."""

import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from mediaquarry.operators import browse, ordering, projection, search, versions
from mediaquarry.sources import adapters


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("plans") / "projection")
    projection.build_projection(adapters.records(adapters.Tables(spark, SMALL)), base)
    return projection.open_projection(spark, base)


def columns_read(text: str) -> set[str]:
    return set(re.findall(r"(\w+):", " ".join(re.findall(r"ReadSchema: struct<(.*)>", text))))


def test_filters_reach_the_scan_and_columns_are_pruned(tables):
    text = plan(browse.with_kind(tables["media"], "video"))
    assert "EqualTo(kind,video)" in text
    assert columns_read(text) == {"id", "kind", "capture_sort_key"}
    text = plan(browse.min_rating(tables["media"], 3))
    assert "GreaterThanOrEqual(rating,3)" in text and "record_json" not in text
    assert "EqualTo(tag,src1)" in plan(browse.with_tag(tables["media_tag"], "src1"))
    text = plan(browse.with_fingerprint(tables["media"], "sha256", "x"))
    assert "EqualTo(fingerprint_algorithm,s" in text and columns_read(text) == {"id", "fingerprint_algorithm", "fingerprint_digest"}


def test_pages_keep_only_the_page(tables):
    text = plan(browse.capture_page(tables["media"], 10, 20))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text
    text = plan(browse.capture_page_after(tables["media"], 5, "m", 20))
    assert "GreaterThanOrEqual(capture_sort_key,5)" in text and "TakeOrderedAndProject" in text


def test_search_prunes_the_token_table(tables):
    text = plan(search.phrase_hits(tables["media_token"], [["golden"], ["ga"]]))
    assert "StringStartsWith(token,golden)" in text and "StringStartsWith(token,ga)" in text
    assert "Join" not in text


def shuffled(df) -> int:
    """Rows that all shuffles of ``df`` have written."""
    df.collect()

    def walk(node) -> int:
        name = node.getClass().getSimpleName()
        inner = {"AdaptiveSparkPlanExec": "executedPlan", "ShuffleQueryStageExec": "plan"}.get(name)
        if inner:
            return walk(getattr(node, inner)())
        own = node.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
        return own + sum(walk(node.children().apply(i)) for i in range(node.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_a_frequent_word_beside_a_phrase_is_added_up_before_the_shuffle(spark):
    media = spark.range(0, 3, 1, 1).selectExpr("CAST(id AS STRING) AS id", "repeat('the ', 400) AS caption", "'img_1.jpg' AS file_name")
    hits = search.phrase_hits(search.media_tokens(media), [["img", "1"], ["the"]])
    assert sorted((r.id, r.phrase, r.hits) for r in hits.collect()) == [(str(i), p, n) for i in range(3) for p, n in ((0, 1), (1, 400))]
    assert shuffled(hits) <= 20


def test_a_frequent_token_lies_in_every_file_and_each_file_is_sorted(spark, tmp_path):
    """The tokens of a row stay in one file, so a prefix that all rows hold is read by many tasks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        projection.build_projection(adapters.records(adapters.Tables(spark, SMALL)), f"{tmp_path}/p")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tokens = projection.open_projection(spark, f"{tmp_path}/p")["media_token"].withColumn("file", F.input_file_name())
    assert tokens.select("file").distinct().count() > 1
    assert tokens.groupBy("id").agg(F.count_distinct("file").alias("n")).where("n > 1").isEmpty()
    for (file,) in tokens.select("file").distinct().collect():
        read = [r.token for r in spark.read.parquet(file).collect()]
        assert read == sorted(read)


def test_the_state_token_makes_each_record_text_once(spark):
    text = plan(projection.state_token(adapters.records(adapters.Tables(spark, SMALL))))
    assert "xxhash64(record_json#" in text and "xxhash64(b, record_json#" in text and "reverse" not in text


def test_row_rules_do_not_shuffle(tables, spark):
    media = tables["media"]
    for df in (search.media_tokens(media), search.media_lengths(media), browse.capture_text(media)):
        assert "Exchange" not in plan(df)
    records = adapters.records(adapters.Tables(spark, SMALL))
    for df in (projection.flatten_media(records), projection.explode_tags(records), browse.browse_row(records)):
        # One exchange deals out the single row group of the small input; the rules add none.
        assert plan(df).count("Exchange") == 1


def test_positions_have_no_single_task_over_the_rows(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("k"), "id")
    text = plan(ordering.ordered_positions(df, [F.col("k"), F.col("id")]))
    # The only unpartitioned window runs over one summary row per partition.
    for line in text.splitlines():
        if "Window" in line and "windowspecdefinition" in line:
            assert "_part" in line


def test_saving_joins_the_table_once(spark):
    r = adapters.records(adapters.Tables(spark, SMALL))
    picked = r.where(F.col("id") < "m00000000000000000005")
    checked = picked.select(
        "id", F.col("metadata").withField("rating", F.lit(5)).alias("metadata"), F.col("metadata").alias("base_metadata"),
        "recipe", F.lit(None).cast("string").alias("conflict"), F.lit("/library/a.jpg").alias("base_path"),
    )
    saved = versions.save_edits(checked, r, picked.select("id", F.lit("new").alias("digest")))
    assert len(re.findall("Join", plan(saved).split("Initial Plan")[-1])) == 2
    rows = saved.select("id", "metadata.rating", "fingerprint.digest").collect()
    assert len(rows) == r.count()
    assert all((row.digest == "new" and row.rating == 5) == (row.id < "m00000000000000000005") for row in rows)
