"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from mediaquarry.llm import bpe, brown, chunks, decontaminate, embeddings, langid, lines, simhash, toxicity, urls
from mediaquarry.llm.queries import tokenizer_file

LABELS = "doc_id long, quality int, toxic int"


def both(odd_docs, no_docs):
    return [odd_docs, no_docs]


def test_bpe(odd_docs, no_docs):
    rows = bpe.decode(bpe.encode(odd_docs, tokenizer_file()), tokenizer_file()).collect()
    assert len(rows) == 12
    assert {r["doc_id"]: r["decoded"] for r in rows}[3] == ""
    assert sorted(map(str, bpe.round_trip(odd_docs, tokenizer_file()).collect())) == sorted(map(str, rows))
    assert bpe.decode(bpe.encode(no_docs, tokenizer_file()), tokenizer_file()).count() == 0
    assert bpe.round_trip(no_docs, tokenizer_file()).count() == 0


def test_simhash(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    found = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert len(rows) == 12
    assert found[2]["fp"] == found[3]["fp"] == found[4]["fp"] == 0 and found[4]["component_id"] == 2
    assert found[6]["component_id"] == 5
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 2, 5, 7, 7, 8, 9]
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0


def test_lines(odd_docs, no_docs):
    rows = lines.repeated_lines(odd_docs).collect()
    found = {(r["doc_id"], r["line_no"]): r for r in rows}
    assert not {2, 3, 4, None} & {r["doc_id"] for r in rows}
    assert found[7, 0]["first_doc_id"] == 1 and not found[7, 0]["kept"] and found[7, 1]["kept"]
    assert not found[6, 0]["kept"] and found[6, 0]["first_doc_id"] == 5
    clean = lines.without_repeats(odd_docs)
    assert clean.columns == odd_docs.columns
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert clean.count() == 12 and texts[6] == "" and texts[7].startswith("Something") and texts[2] is None and texts[4] == " \n\t\n"
    assert lines.repeated_lines(no_docs).count() == 0 and lines.without_repeats(no_docs).count() == 0


def test_chunks(odd_docs, no_docs):
    spans = chunks.repeated_spans(odd_docs).collect()
    assert {r["doc_id"] for r in spans} == {5, 6}
    assert all(r["first_doc_id"] == 5 and r["kept"] == (r["doc_id"] == 5) for r in spans)
    assert chunks.repeated_spans(no_docs).count() == 0


def test_decontamination(spark, odd_docs, no_docs):
    items = spark.createDataFrame(
        [(1, "The dog sat on the mat and looked at the quiet grey sea."), (1, None), (None, "a b c"), (2, ""), (3, "x" * 5000), (4, "unseen")],
        "item_id long, text string",
    ).withColumn("total", F.lit(1)).withColumn("hash", F.lit(2))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(odd_docs, items).collect()}
    assert found == {(8, 3)}
    assert decontaminate.keep_clean(odd_docs, items).count() == 11
    assert decontaminate.leaks(no_docs, items).count() == 0 == decontaminate.leaks(odd_docs, items.where("false")).count()


@pytest.mark.parametrize("labelled", [True, False])
def test_toxicity(spark, odd_docs, no_docs, labelled):
    texts = [(i, ("such a total idiot here" if i % 3 == 0 else f"such a total calm here number {i}"), i % 3 == 0) for i in range(90)]
    rows = spark.createDataFrame([(i, t, int(x)) for i, t, x in texts] + [(None, None, 1), (1, "a", None)], "doc_id long, text string, toxic int")
    lexicon = toxicity.fit(rows if labelled else rows.where("false"))
    scored = toxicity.score(odd_docs.unionByName(odd_docs.limit(1).withColumn("text", F.lit("an IDIOT, an idiott, an idiot"))), lexicon)
    found = scored.collect()
    assert len(found) == 13 and all(0 <= r["score"] <= 1 for r in found)
    assert max(r["predicted"] for r in found) == int(labelled)
    assert toxicity.score(no_docs, lexicon).count() == 0
    kept = toxicity.keep_clean(odd_docs, lexicon)
    assert kept.columns == odd_docs.columns and kept.count() == 12
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (None, 1, 1)], LABELS)
    assert toxicity.learning_rows(odd_docs, labels).count() == 2


def test_langid(odd_docs, no_docs):
    taught = odd_docs.withColumn("lang", F.when(F.col("doc_id") < 7, "en").when(F.col("doc_id") == 8, "xx"))
    for model in (langid.fit(taught), langid.fit(no_docs)):
        rows = {r["doc_id"]: r for r in langid.identify(odd_docs, model).collect()}
        assert rows[2]["lang_pred"] == rows[4]["lang_pred"] == "und" and rows[2]["score"] == 0
        assert langid.identify(no_docs, model).count() == 0
    assert langid.identify(odd_docs.where("doc_id = 8"), langid.fit(taught)).first()["lang_pred"] == "xx"


@pytest.mark.parametrize("n", [1, 2, 5, 7, 8, 20])
def test_codewords_differ(n):
    code = langid.codewords(n)
    assert len({tuple(row) for row in code}) == n


def test_brown(odd_docs, no_docs):
    for taught in (odd_docs, no_docs):
        model, counts = brown.fit(taught)
        rows = brown.score(odd_docs, model, counts).collect()
        assert len(rows) == 12
        empty = {r["doc_id"]: r for r in rows}[3]
        assert empty["n_tokens"] == 1 and empty["n_known"] == (taught is odd_docs)
        assert brown.score(no_docs, model, counts).count() == 0


def test_brown_clusters_the_first_words_whatever_the_head_holds(spark, monkeypatch):
    docs = spark.createDataFrame([(1, " ".join(f"w{i:02}" for i in range(20))), (2, "w03 w07 w07")], "doc_id long, text string")
    whole = brown.fit(docs)
    monkeypatch.setattr(brown, "HEAD", 5)  # the words seen once are one step and do not fit
    short = brown.fit(docs)
    assert len(whole[0].classes) == len(short[0].classes) == 21 and len(short[0].head) < 5
    assert short[0].classes == whole[0].classes
    scores = [{r["doc_id"]: r["score"] for r in brown.score(docs, *fitted).collect()} for fitted in (whole, short)]
    assert scores[0] == pytest.approx(scores[1])


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, "HTTP://A.Example.com/en/x?y", "<p>free bets</p>"), (2, None, None), (3, "no scheme", ""), (4, "http://b.org", "x"), (4, "http://b.org", "x"),
         (None, "http://WWW.example.com/en/", None), (5, "http://c.net/fr/a#b", None), (6, "x://?q", "<b>")], "page_id long, url string, html string",
    ).withColumn("rule", F.lit("r")).withColumn("score", F.lit(3))
    rules = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/fr/", "block")]
    rows = {r["page_id"]: r for r in urls.judge(pages, rules).collect()}
    assert (rows[1]["host"], rows[1]["path"], rows[1]["rule"], rows[1]["verdict"]) == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert rows[None]["rule"] == "www.example.com/en/" and rows[5]["rule"] == "net/fr/"
    assert (rows[2]["host"], rows[2]["path"], rows[2]["rule"]) == ("", "", None) and rows[6]["host"] == ""
    assert urls.judge(pages, rules).count() == 8 and urls.judge(pages.where("false"), rules).count() == 0
    assert urls.judge(pages, []).where("rule is null").count() == 8


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]),
            (8, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 0.0]), (10, [1.0, 0.1, 0.0]), (11, [1.0, 0.0]), (12, [1e30, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("uid", F.lit(1)).withColumn("n", F.lit(1))
    found = embeddings.near_duplicates(vectors).collect()
    assert len(found) == 14
    by = {r["vec_id"]: r for r in found}
    assert [by[i]["n_links"] for i in (1, 2, 11, 12)] == [3, 3, 3, 3] and by[12]["component_id"] == 1
    assert all(by[i]["n_links"] == 0 and by[i]["kept"] for i in (3, 4, 5, 6, 7, 8, 9, 10, None))
    assert embeddings.near_duplicates(vectors.where("false")).count() == 0


def test_filters_leave_columns_of_any_name(spark, odd_docs):
    """Columns named like the helpers of the filters come out as they went in."""
    names = ["_id", "_gone", "_parts", "_places", "_text", "_GONE_"]
    docs = odd_docs.select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    items = spark.createDataFrame([(1, "The cat sat on the mat and looked at the quiet grey sea.")], "item_id long, text string")
    for kept, plain in (
        (lines.without_repeats(docs), lines.without_repeats(odd_docs)),
        (decontaminate.keep_clean(docs, items), decontaminate.keep_clean(odd_docs, items)),
        (simhash.keep_one(docs), simhash.keep_one(odd_docs)),
    ):
        assert kept.columns == docs.columns
        assert sorted(map(str, kept.select(*odd_docs.columns).collect())) == sorted(map(str, plain.collect()))
        assert all(row[n] == f"own {n}" for row in kept.collect() for n in names)
