"""The operators against plain loops over small tables, and exact round trips."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from conftest import SMALL
from tokenizers import Tokenizer

from mediaquarry.llm import bpe, components, lines, queries, simhash, toxicity, urls


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(0, i) for i in range(400, 460)] + [(i, i + 1) for i in range(500, 530)]
    want = groups({n for link in links for n in link}, links)
    found = components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in found} == {n: r for n, r in want.items() if sum(x == r for x in want.values()) > 1}


def test_bpe_is_the_library(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation(), library.no_padding()
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        mine = bpe.WordTokenizer(file.read())
    extra = ["", "<|endoftext|>x<|startoftext|>", "ab" * 2000, "!?" * 900, "It's WE'LL 'S 12 \x1c\x1f\x85 ÀΣς İ ﬁ e\u0301", "日本語 😀 ½ ٣"]
    for text in [*docs.values(), *extra]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert mine.encode(text).tolist() == ids and mine.decode(ids) == library.decode(ids, skip_special_tokens=False)
    rows = queries.op9_bpe_roundtrip(spark, SMALL).collect()
    assert len(rows) == len(docs) and all(r["n_tokens"] == len(library.encode(docs[r["doc_id"]], add_special_tokens=False).ids) for r in rows)


def test_simhash_is_brute_force(spark, docs):
    def plain(text):
        words = text.encode().lower().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), seed=42) for i in range(max(1, len(words) - 3))] if words else []
        return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))

    prints = {d: plain(t) for d, t in docs.items()}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    want = groups(prints, links)
    rows = queries.op10_simhash(spark, SMALL).collect()
    assert {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in rows} == {d: (prints[d], want[d]) for d in prints}


def test_anchors_miss_no_pair():
    rng = random.Random(9)
    patterns = simhash.coset_patterns()
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4)))
        one, two = (np.array([x], np.uint64).view(np.int64) for x in (a, b))
        home = {int(k) for _, keys in simhash.anchors(one, ((0, 0),), patterns) for k in keys}
        near = {int(k) for _, keys in simhash.anchors(two, simhash.EXCESSES, patterns) for k in keys}
        assert len(home) == 3 and home & near


def test_line_links_have_high_recall_and_no_false_link(spark, docs):
    def shingles(line):
        return {line[i : i + lines.SHINGLE] for i in range(max(1, len(line) - lines.SHINGLE + 1))}

    every = sorted({line for t in docs.values() for line in t.split("\n") if line.strip()})
    sets = [shingles(line) for line in every]
    want = {(a, b) for a in range(len(every)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    root = {(r["doc_id"], r["line_no"]): (r["first_doc_id"], r["first_line_no"]) for r in lines.repeated_lines(table).collect()}
    of = {line: root[d, i] for d, t in docs.items() for i, line in enumerate(t.split("\n")) if line.strip()}
    together = sum(of[every[a]] == of[every[b]] for a, b in want)
    assert together >= 0.9 * len(want)
    true = groups(range(len(every)), want)
    first = {}
    for a, line in enumerate(every):
        assert first.setdefault(of[line], true[a]) == true[a]


def test_line_components_are_those_of_all_pairs_in_shared_buckets(spark):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz "
    word = lambda n: "".join(rng.choices(letters, k=n))
    header, every = word(68), set()
    for _ in range(150):
        tail = word(8)
        every |= {f"{header}{tail}{x}" for x in (word(1), word(2))}
    every = sorted(every)
    table = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    named = lines.lines_of(table).select("doc_id", "d1", "line")
    number = {r["d1"]: r["doc_id"] for r in named.collect()}
    met = {}
    for r in lines.signatures(named.select("d1", "line")).collect():
        row = r.asDict()
        for b, masks in enumerate(lines.BANDS):
            key = (b, *[row[f"m{m}"] for m in masks])
            met.setdefault(key, set()).add(number[row["d1"]])
    sets = [{x[i : i + lines.SHINGLE] for i in range(len(x) - lines.SHINGLE + 1)} for x in every]
    pairs = {(a, b) for bucket in met.values() for a in bucket for b in bucket if a < b}
    want = groups(range(len(every)), [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    assert max(map(len, met.values())) > 100 and len(set(want.values())) < len(every)
    assert {r["doc_id"]: r["first_doc_id"] for r in lines.repeated_lines(table).collect()} == want


def test_similar_lines_are_those_of_brute_force_and_sketches_keep_them(spark):
    rng = random.Random(8)
    every = set()
    for _ in range(25):
        line = "".join(rng.choices("ab c😀é", k=rng.randint(5, 300))) * rng.choice([1, 1, 4])
        every |= {line, line + "ab c" * rng.randint(1, 9), line[rng.randint(0, len(line) // 5) :]}
    every = sorted(x for x in every if x.strip())
    sets = [{x[i : i + lines.SHINGLE] for i in range(max(1, len(x) - lines.SHINGLE + 1))} for x in every]
    table = lines.counted(spark.createDataFrame(list(enumerate(every)), "d1 long, line string"))
    some = [(a, b) for b in range(len(every)) for a in range(b)]
    pairs = spark.createDataFrame(some, "a long, b long")
    found = {(r["a"]["d1"], r["b"]["d1"]) for r in lines.similar(table, pairs).collect()}
    assert found == {(a, b) for a, b in some if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])} and len(found) > 20
    known = lines.sketches(table)
    met = pairs.selectExpr("a d1", "b x", "b y")
    agreed = {(r["a"], r["b"]) for r in lines.leader_pairs(met, known).collect()}
    assert len(found & agreed) >= 0.97 * len(found) and len(agreed) < len(some) / 2


def test_line_sketches_lose_no_similar_pair_and_rule_out_nearly_similar_ones(spark):
    rng = random.Random(12)
    every = []
    for i in range(400):
        line = "".join(rng.choices("abcdefghij 😀", k=400)) + "ab" * (i % 3 * 20)
        at = rng.randint(100, 300)
        every += [line, line[:at] + "".join(rng.choices("xyz", k=rng.choice([30, 60, 75, 110]))) + line[at:]]
        every[-1] = every[-1][: rng.choice([len(every[-1]), 400])]
    sets = [{x[i : i + lines.SHINGLE] for i in range(max(1, len(x) - lines.SHINGLE + 1))} for x in every]
    alike = {i: len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, len(every), 2)}
    known = lines.sketches(lines.counted(spark.createDataFrame(list(enumerate(every)), "d1 long, line string")))
    met = spark.createDataFrame([(i, i + 1, i) for i in alike], "d1 long, x long, y long")
    agreed = {r["a"] for r in lines.leader_pairs(met, known).collect()}
    assert {i for i, j in alike.items() if j >= 0.8} <= agreed
    below = [i for i, j in alike.items() if 0.65 <= j < 0.72]
    assert len(below) > 40 and len(agreed.intersection(below)) < 0.2 * len(below)
    # Two lines under one digest: nothing is ruled out.
    both = lines.sketches(lines.counted(spark.createDataFrame([(1, every[0]), (1, every[2]), (2, every[0])], "d1 long, line string")))
    assert lines.leader_pairs(met.limit(1).selectExpr("1L d1", "2L x", "2L y"), both).count() == 1


def test_line_sketches_go_along_only_where_a_bucket_is_still_apart(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(lines, "stored", lambda df, *parts: kept.append(df.columns) or df)
    header = "".join(random.Random(4).choices("abcdefgh ", k=200))
    every = [f"{header}{i} {i}" for i in range(6)]
    known = lines.sketches(lines.counted(spark.createDataFrame(list(enumerate(every)), "d1 long, line string")))
    met = spark.createDataFrame([(i, band, 0, 5, 6) for band in (1, 2) for i in range(6)], "d1 long, band long, x long, y long, n long")
    met = met.where("band = 1 or d1 < 3")
    node = spark.createDataFrame([((i, 0), (1, 0)) for i in (1, 2)], "node struct<d1: long, d2: long>, root struct<d1: long, d2: long>")
    found = {(r["a"], r["b"]) for r in lines.rest_pairs(met, node, known).collect()}
    assert found == {(1, 3), (1, 4), (2, 3), (2, 4), (3, 4)}
    assert kept and not any("sketch" in columns for columns in kept)


def test_hot_slots_change_no_bucket(spark):
    rng = random.Random(6)
    header = "".join(rng.choices("abcdefgh ", k=90))
    every = [(i, f"{header}{rng.randint(0, 99)}" if i % 3 else f"{i} {rng.random()} {rng.random()}") for i in range(300)]
    signed = lines.signatures(spark.createDataFrame(every, "d1 long, line string"))
    cold, warm, hot = (
        {tuple(r) for r in lines.buckets(signed, slots).select("d1", "band", "x", "y", "n").collect()}
        for slots in ([], list(range(0, 4096, 2)), list(range(4096)))
    )
    assert cold == warm == hot and len(cold) > 300


def test_lines_of_equal_shingles_link_at_any_length(spark):
    every = [sign * n for sign in "-=*_~" for n in (40, 100, 400)] + ["ab " * 20, "ab " * 60]
    table = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    first = {r["doc_id"]: r["first_doc_id"] for r in lines.repeated_lines(table).collect()}
    assert first == {i: 15 if i > 14 else i // 3 * 3 for i in range(17)}


def test_base_scores(spark, docs):
    tokens = {d: [*t.encode().lower().split(), b" "] for d, t in docs.items()}
    counts = Counter(w for d, ws in tokens.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    held, score = 0.0, 0.0
    for r in queries.op4_brown_lm(spark, SMALL).collect():
        words = tokens[r["doc_id"]]
        base = sum(math.log10((counts[w] + 1) / (total + 1 * (distinct + 1))) for w in words)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(w in counts for w in words), total)
        assert r["base_score"] == pytest.approx(base) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        if r["held_out"]:
            held, score = held + r["base_score"], score + r["score"]
    assert score > held


def test_embedding_links(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    unit = np.array([r["embedding"] for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    ids = [r["vec_id"] for r in rows]
    want = groups(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(near)) if i < j])
    found = {r["vec_id"]: r for r in queries.op2_embedding_neardup(spark, SMALL).collect()}
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in found.items()} == {
        i: (int(near[k].sum()) - 1, want[i], want[i] == i) for k, i in enumerate(ids)
    }


def test_language_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = [r for r in queries.op6_language_id(spark, SMALL).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) >= 0.95 * len(rows)


def test_planted_passages(spark, docs):
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    text = lambda n: " ".join("".join(rng.choices(letters, k=rng.randint(3, 8))) for _ in range(n))
    passages = [text(55) for _ in range(40)]
    rows = [(i, f"{text(rng.randint(20, 90))} {p} {text(30)}") for i, p in enumerate(passages * 2)] + [(1000 + i, text(200)) for i in range(40)]
    from mediaquarry.llm import chunks

    found = {r["doc_id"] for r in chunks.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found <= set(range(80)) and len(found) >= 78


def test_leaks_are_brute_force_and_slots_agree(spark, docs):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    inside = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    found = {(r["doc_id"], r["item_id"]) for r in queries.op7_decontamination(spark, SMALL).collect()}
    assert inside <= found
    from mediaquarry.llm import decontaminate

    item = spark.createDataFrame([(7, "Then Mary buys 20 apples for 7 dollars and gives Paul 20 km of 9 apples to the other farm near Paris")], "item_id long, text string")
    told = spark.createDataFrame([
        (1, "So it went. Then Anna buys 12 apples for 3.50 dollars and gives Tom 12 km, of 5 apples, to the other farm near Berlin."),
        (2, "Then Zed buys 20 apples for 7 dollars and gives Kim 33 km of 9 apples to the other farm near Rome"),
        (3, "Then nobody buys apples for dollars and gives a farm to the other side of the river near here"),
    ], "doc_id long, text string")
    assert [r["doc_id"] for r in decontaminate.leaks(told, item).collect()] == [1]


def test_automaton_is_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(3)
    terms = {"idiot": 5.0, "worthless": 4.0, "scum": 3.0, "disgusting": 6.0}
    machine = toxicity.Automaton(terms)
    for _ in range(3000):
        word = list(rng.choice(sorted(terms)))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "t", "s"])
        word = "".join(word)
        best = max([0.0] + [w * (1 - 0.3 * d) for t, w in terms.items() if (d := distance(t, word)) <= (len(t) >= 4) + (len(t) >= 10)])
        assert machine.weights(word) == (pytest.approx(best), terms.get(word, 0.0)), word
    assert all(machine.weights(w)[0] for w in ("xdiot", "1diot", "diot", "scvm", "vorthless"))


def test_variants_that_clean_texts_use_are_spared(spark):
    rows = [(f"you are a moron {i}", 1) for i in range(40)] + [(f"the maron is a fruit {i}", 0) for i in range(200)]
    rows += [("a xoron indeed", 1), ("what a goron", 1), ("the goron again", 0)]
    lexicon = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"))
    assert {"moron", "moro*"} <= set(lexicon.terms) and "maron" in lexicon.spared and not {"xoron", "moron"} & lexicon.spared
    judge = toxicity.Judge(toxicity.Lexicon({"moron": 5.0}, lexicon.rates, lexicon.spared))
    assert judge.hits("maron") == [] and [w for _, w, _ in judge.hits("xoron moron")] == [pytest.approx(3.5), 5.0]
    assert judge.variants("Maron, moron (xoron) apple") == {"maron", "xoron"}


def test_quotation_weighs_less():
    judge = toxicity.Judge(toxicity.Lexicon({"idiot": 5.0}, [0.0] * 16))
    assert [k for _, _, k in judge.hits('he said "what an idiot" to them')] == ["quoted"]
    assert [k for _, _, k in judge.hits("you are an idiot")] == ["abuse"]


def test_segmentation():
    counts = {"free": 50, "bets": 20, "casino": 30, "win": 40, "in": 400}
    assert urls.Segmenter(counts, 1000).split("freecasinowin") == ["free", "casino", "win"]


def test_pipeline_runs(spark, docs):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) and 0.5 * len(docs) < len(rows) < len(docs)
