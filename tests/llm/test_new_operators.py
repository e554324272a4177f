"""Phrase mining, SentencePiece and importance resampling: edges, and against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from compare import connect, differences
from mediaquarry.llm import importance, phrases, pieces
from mediaquarry.llm.queries import ORACLES, QUERIES, tokenizer_file

MODEL = tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def tokenizer():
    with open(MODEL, "rb") as file:
        return pieces.PieceTokenizer(file.read())


@pytest.mark.parametrize("name", ["op11_phrase_mining", "op13_importance_resampling"])
def test_same_as_sql(spark, name):
    found = QUERIES[name](spark, SMALL)
    assert differences(found, connect(SMALL), ORACLES[name]) == []
    assert found.count() > 100


# Pieces


def test_pieces_of_random_texts(library, tokenizer):
    draw = random.Random(12)
    letters = ["ab cdeinthr", "▁ \n\t\x00ab", "日本東京 语é", "😀é⁇<s></s><0x41>", "xyz012 ", "   　a",
               "".join(chr(draw.randrange(32, 0x3000)) for _ in range(200))]
    for _ in range(3000):
        alphabet = draw.choice(letters) + draw.choice(letters)
        text = "".join(draw.choice(alphabet) for _ in range(draw.randrange(60)))
        ids = library.encode(text, add_eos=True)
        assert tokenizer.encode(text) == ids
        assert tokenizer.decode(ids) == library.decode(ids)


def test_pieces_of_long_parts(library, tokenizer):
    for text in ["x" * 5000, " " * 3000, "ab" * 4000, "日" * 1000, "the" * 3000, "e" * 7001]:
        assert tokenizer.encode(text) == library.encode(text, add_eos=True)
        assert tokenizer.decode(tokenizer.encode(text)) == text


def test_backtracking_equals_the_merges(tokenizer):
    draw = random.Random(5)
    for _ in range(2000):
        part = "▁" + "".join(draw.choice("aeinrstxq") for _ in range(draw.randrange(1, 25)))
        assert [tokenizer._spelled(token) for token in tokenizer.split(part)] == tokenizer.merged(part)


def test_decoding_any_ids(library, tokenizer):
    draw = random.Random(7)
    for _ in range(3000):
        ids = [draw.choice([draw.randrange(32000), draw.randrange(3, 259), 28705, 2]) for _ in range(draw.randrange(8))]
        assert tokenizer.decode(ids) == library.decode(ids)
        lists = [ids, [], ids[::-1], [2], ids + [2]]
        ends = np.cumsum([len(one) for one in lists])
        assert tokenizer.decode_all(np.array(sum(lists, []), np.int32), ends) == [library.decode(one) for one in lists]


def test_decoding_nothing(tokenizer):
    assert tokenizer.decode_all(np.empty(0, np.int32), np.zeros(2, np.int32)) == ["", ""]


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.PieceTokenizer(b"\x12\x02\x18\x01")  # a unigram model


def test_pieces_query(spark, library):
    rows = {r["doc_id"]: r for r in QUERIES["op12_piece_roundtrip"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(docs) == len(rows)
    for doc in docs:
        ids = library.encode(doc["text"] or "", add_eos=True)
        row = rows[doc["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_edges(odd_docs, no_docs, library):
    rows = pieces.round_trip(odd_docs, MODEL).collect()
    assert len(rows) == 12
    for row, doc in zip(rows, odd_docs.collect()):
        assert row["doc_id"] == doc["doc_id"] and row["ids"] == library.encode(doc["text"] or "", add_eos=True)
        assert row["decoded"] == (doc["text"] or "")
    assert sorted(map(str, pieces.decode(pieces.encode(odd_docs, MODEL), MODEL).collect())) == sorted(map(str, rows))
    assert pieces.round_trip(no_docs, MODEL).count() == 0 and pieces.decode(pieces.encode(no_docs, MODEL), MODEL).count() == 0


# Phrases


def plain_collocations(docs, shortest, longest, threshold, cover, best):
    f, total = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = lang or "und"
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for size in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    rows = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if shortest <= len(p) and a >= threshold}
        covered = defaultdict(int)
        for phrase, a in found.items():
            for size in range(shortest, len(phrase)):
                for i in range(len(phrase) - size + 1):
                    covered[phrase[i : i + size]] = max(covered[phrase[i : i + size]], a)
        scored = []
        for phrase, a in found.items():
            cut = min((10**6 * a * a // (counts[phrase[:k]] * counts[phrase[k:]]), k) for k in range(1, len(phrase)))
            if 100 * covered[phrase] < cover * a:
                k = cut[1]
                scored.append((-cut[0], -a, " ".join(phrase).encode(), counts[phrase[:k]], counts[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:best], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(rows)


@pytest.mark.parametrize("shards,bits,longest", [(1, 16, 3), (3, 20, 4), (5, 10, 3), (2, 2, 3)])
def test_phrases_of_random_texts(spark, shards, bits, longest):
    draw = random.Random(shards)
    words = ["a", "B", "c", "dé", "日本", "e1", "f'", "G", "rare1", "rare2"]
    weights = [9, 8, 7, 5, 4, 4, 3, 3, 1, 1]
    docs = [
        (draw.choice(["en", None, "de"]), "".join(w + draw.choice([" ", " ", "  ", "\t", " ", ", ", ".", "\n"])
                                                 for w in draw.choices(words, weights, k=draw.randrange(60))))
        for _ in range(120)
    ]
    table = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    found = phrases.collocations(table, 2, longest, 10, 50, 40, shards, bits)
    wanted = plain_collocations(docs, 2, longest, 10, 50, 40)
    assert sorted(map(tuple, found.collect())) == wanted and len(wanted) > 60


def test_langs_that_differ_in_a_last_character_only(spark):
    """Trailing NULs tell languages apart, as every other character does."""
    docs = [("a", "x y z")] * 12 + [("a\0", "x y q")] * 11 + [("", "x y")] * 10 + [(None, "x y")] * 10
    found = phrases.collocations(spark.createDataFrame(docs, "lang string, text string").repartition(2))
    assert {(r["lang"], r["phrase"], r["a"], r["n"]) for r in found.collect()} == {
        ("a", "x y z", 12, 36), ("a\0", "x y q", 11, 33), ("", "x y", 10, 20), ("und", "x y", 10, 20),
    }


def test_late_phrases_get_a_full_circle(spark):
    """A phrase whose words become frequent in the last shard only is still counted in all of them."""
    docs = [("en", "x y z")] * 3 + [("en", "filler")] * 2 + [("en", "x y z " * 9)]
    found = phrases.counted(spark.createDataFrame(docs, "lang string, text string").coalesce(1), 3, 10, 6)
    assert {r["phrase"]: r["f"] for r in found.where("size > 1").collect()} == {"x y": 12, "y z": 12, "x y z": 12}


def test_scores_beyond_64_bits(spark, monkeypatch):
    many = 4 * 10**15
    counts = [("en", "", 0, 2 * many), ("en", "a", 1, many), ("en", "b", 1, many), ("en", "a b", 2, many - 1)]
    table = spark.createDataFrame(counts, "lang string, phrase string, size int, f long")
    monkeypatch.setattr(phrases, "counted", lambda *_: table)
    assert phrases.collocations(table, 2, 3).first()["score"] == 10**6 * (many - 1) ** 2 // many**2


def test_phrases_edges(odd_docs, no_docs, spark):
    found = phrases.collocations(odd_docs).collect()
    assert found and {r["lang"] for r in found} == {"und"} and {r["n"] for r in found} == {r["n"] for r in found[:1]}
    assert [r["rank"] for r in sorted(found, key=lambda r: r["rank"])] == list(range(1, len(found) + 1))
    assert phrases.collocations(no_docs).count() == 0
    assert phrases.collocations(odd_docs.where("text is null or text = ''")).count() == 0


# Importance


def plain_resample(docs, target, percent, least, shortest, longest, buckets, seed):
    def features(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        runs = [" ".join(words[i : i + n]) for n in range(shortest, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(f.encode()) % buckets for f in runs]

    own = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for text in target for b in features(text)[1])
    ss, tt = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in s}
    rows = []
    for doc_id, n_words, f in own:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, n_words, len(f), weight, score))
    able = sorted((-r[4], r[0]) for r in rows if r[1] >= least and r[0] is not None)
    place = {i: rank for rank, (_, i) in enumerate(able[: len(able) * percent // 100], 1)}
    return [(r[0], r[2], r[3], r[4], place.get(r[0])) for r in rows]


@pytest.mark.parametrize("shortest,longest,buckets", [(1, 1, 10_000), (1, 2, 500), (2, 3, 64)])
def test_importance_of_random_texts(spark, shortest, longest, buckets):
    draw = random.Random(longest)
    words = ["Alpha", "beta", "gamma3", "é", "日本", "x_y", "don't", "Z"]
    docs = [(i, " ".join(draw.choices(words, k=draw.randrange(30)))) for i in range(300)] + [(300, None), (301, ""), (None, "beta " * 25)]
    target = [" ".join(draw.choices(words[:3], k=12)) for _ in range(20)] + [None]
    found = importance.resample(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame([(t,) for t in target], "text string"), 25, 5, shortest, longest, buckets, 7,
    )
    wanted = plain_resample(docs, target, 25, 5, shortest, longest, buckets, 7)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, wanted))


def test_offsets_point_at_the_words():
    windows = importance.WordWindows(1, 2)
    text = "Ünder THE sea, 日本-12 \x00İx"
    assert [text.encode().lower().decode()[a:b] for _, (a, b) in windows.words(text)] == [w for w, _ in windows.words(text)]
    assert windows.features("One two,three")[1] == ["one", "two", "three", "one two", "two three"]


def test_importance_edges(odd_docs, no_docs, spark):
    target = spark.createDataFrame([(1, "the cat sat"), (2, None)], "item_id long, text string")
    rows = importance.resample(odd_docs, target, 50, 3).collect()
    assert len(rows) == 12
    for row in rows:
        assert (row["score"] is None) == (row["doc_id"] is None)
        assert row["doc_id"] not in (2, 3, 4) or (row["n_features"], row["weight"], row["rank"]) == (0, 0, None)
    assert sorted(r["rank"] for r in rows if r["rank"]) == [1, 2, 3]
    assert importance.resample(odd_docs, target.where("false")).count() == 12
    assert importance.resample(no_docs, target).count() == 0
    assert np.all(importance.gains(np.zeros(4, np.int64), np.zeros(4, np.int64)) == 0)


def test_every_candidate_drawn(spark):
    docs = spark.createDataFrame([(i, "one two three") for i in range(20)], "doc_id long, text string")
    rows = importance.resample(docs, docs, 100, 1).orderBy(F.desc("score"), "doc_id").collect()
    assert [r["rank"] for r in rows] == list(range(1, 21))
