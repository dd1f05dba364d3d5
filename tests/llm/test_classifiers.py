import random
import zlib

import numpy as np
import pytest

from quillon.llm import lang_id as L
from quillon.llm import quality as Q
from quillon.llm import toxicity as T


def made(lang, r, n=30):
    parts = {"xx": ("ka", "lo", "mi", "tu"), "yy": ("sch", "er", "ung", "ein"), "zz": ("eau", "ion", "que", "ré")}[lang]
    return " ".join("".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(n))


def test_language_held_out_and_edges(spark):
    r = random.Random(1)
    rows = [(i, made(lang := r.choice(("xx", "yy", "zz")), r), lang) for i in range(300)]
    rows += [(1000, None, "xx"), (1001, "123 !!", "yy"), (None, made("zz", r), None), (1002, "", None)]
    docs = spark.createDataFrame([(*x, "s", 0.1) for x in rows], "doc_id long, text string, lang string, source string, score double")
    got = {x.doc_id: x for x in L.identify(spark, docs).collect()}
    assert len(got) == len(rows)
    held = [(i, lang) for i, _, lang in rows if i is not None and i < 1000 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i, _ in held) and all(got[i].lang_pred == lang for i, lang in held) and len(held) > 30
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert got[None].lang_pred == "zz" and not got[None].held_out and all(0 <= x.score <= 1 for x in got.values())
    kept = L.keep_identified(spark, docs)
    assert kept.columns == docs.columns and kept.count() == 301
    none = docs.withColumn("lang", docs.lang.substr(9, 1)).filter("lang is null")
    assert {x.lang_pred for x in L.identify(spark, none).collect()} == {"und"}
    assert L.identify(spark, docs.limit(0)).count() == 0


def test_backoff_goes_to_shorter_grams():
    model = L.Model(["a", "b"], np.zeros(2), L.Table(["abc"], [[-1, -5]]), L.Table(["<xyz", "yz", "z", "q"], [[-1, -9], [-2, -8], [-3, -7], [-4, -6]]))
    assert model.rows_of(["xyz", "yz", "mz", "q", "é", "abc"]).tolist() == [[-1, -9], [-2, -8], [-3, -7], [-4, -6], [0, 0], [-1, -5]]
    assert model.predict("ABC", model.memory())[0] == "a" and model.predict("5", model.memory()) == ("und", 0.0)


def test_letters_by_category():
    import unicodedata

    assert L.words_of("½ ² Ⅷ ① 5 _ ٣ Straße日本 aª·é") == ["straße日本", "aª", "é"]
    for c in map(chr, range(0x3000)):
        if c.lower() == c:
            assert bool(L.words_of(c)) == unicodedata.category(c).startswith("L"), hex(ord(c))


def test_word_memory_forgets_without_changing_results():
    from quillon.llm._common import WordMemory

    m = WordMemory({"a": 0}, np.array([[1.0]], np.float32), lambda ws: np.array([[float(len(w))] for w in ws]), limit=5)
    for _ in range(3):
        words = ["a", *("b" * k for k in range(1, 20))]
        assert m.table[m.rows(words)][:, 0].tolist() == [1.0, *map(float, range(1, 20))]


def toxic_rows(n, seed):
    r, rows = random.Random(seed), []
    bad = ["idiot", "moron", "worthless", "scumbag"]
    for i in range(n):
        words = ["".join(r.choices(("th", "er", "on", "an", "re", "he", "in"), k=r.randint(1, 4))) for _ in range(r.randint(20, 200))]
        y = int(r.random() < 0.25)
        if y:
            for _ in range(2):
                w = r.choice(bad)
                if r.random() < 0.2:
                    k = r.randrange(1, len(w) - 1)
                    w = w[:k] + w[k] + w[k:]  # a misspelling
                words[r.randrange(len(words))] = w
        rows.append((i, " ".join(words), y))
    return rows


def test_toxicity_held_out_and_edges(spark):
    rows = toxic_rows(900, 3)
    docs = spark.createDataFrame([(i, t, "c") for i, t, _ in rows] + [(5000, None, "c"), (5001, "!!", "c"), (None, "idiot", "c"), (5002, "1234 55", "c")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5000, None)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in T.toxicity(spark, docs, labels).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i, _ in held)
    assert np.mean([got[i].predicted == y for i, y in held]) > 0.97
    assert all(got[i].predicted == 0 and 0 <= got[i].score <= 1 for i in (5000, 5001, 5002)) and got[None].predicted == 1
    assert {x.score < 0.01 for x in T.toxicity(spark, docs, labels.limit(0)).collect()} == {True}
    assert T.toxicity(spark, docs.limit(0), labels).count() == 0


def test_unseen_misspelling_shares_vectors():
    rows = toxic_rows(500, 4)
    model = T.train([t.encode() for _, t, _ in rows], np.array([y for _, _, y in rows]))
    (a, n), (b, m) = model.word_sums([b"worthlesss", b"thereon"])
    assert a / n > b / m + 0.01
    memory = model.memory()
    texts = [" ".join(["thereon other inan"] * 12), " ".join(["thereon other inan"] * 12 + ["worthlesss"])]
    assert model.raw(texts[1].encode(), memory) > model.raw(texts[0].encode(), memory) + 1


def test_text_logit_is_the_average_of_its_subwords():
    """Brute force: each subword of each word, hashed one at a time, averaged with the zero vectors."""
    r = np.random.default_rng(2)
    model = T.Model(r.normal(size=T.BUCKETS), -1.5, 1.0, 0.0)
    for raw in (b"Aa, bcd! 77 bcd \xc3\xa9t\xc3\xa9 x9", b"word " * 300, b"", b"12 34"):
        values = [model.logit[b] for w in T.words_of(raw) for b in T.bags([w])[0]]
        want = T.SCALE * sum(map(float, values)) / (len(values) + T.SHRINK) - 1.5
        assert model.raw(raw, model.memory()) == pytest.approx(want, rel=1e-5)
    w = b"abcd"
    assert len(T.bags([w])[0]) == sum(len(w) + 2 - n + 1 for n in range(3, 7)) + 1


def test_sampling_keeps_the_labels_shares(spark):
    """A model of a sample with other shares is calibrated back to those of the table."""
    rows = toxic_rows(900, 5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = T.toxicity(spark, docs, labels, (120, 120)).collect()
    y = dict((i, y) for i, _, y in rows)
    assert abs(np.mean([x.score for x in got]) - np.mean(list(y.values()))) < 0.1


def test_ordinal_regression_orders_grades(spark):
    r, rows = random.Random(6), []
    for i in range(600):
        g = r.randrange(3)
        rows.append((i, " ".join(r.choices(("bad", "junk", "$$$") if g == 0 else ("plain", "word", "bad") if g == 1 else ("fine", "plain", "lucid"), k=40)), g))
    docs = spark.createDataFrame([(i, t, True) for i, t, _ in rows] + [(9000, None, True)], "doc_id long, text string, selected boolean")
    labels = spark.createDataFrame([(i, int(g > 0), int(g == 1)) for i, _, g in rows] + [(9000, None, 0)], "doc_id long, quality int, toxic int")
    model = Q.train([t.encode() for _, t, _ in rows[:400]], np.array([g for _, _, g in rows[:400]]))
    assert (np.diff(model.thresholds) > 0).all()
    got = {x.doc_id: x for x in Q.quality(spark, docs, Q.graded(labels)).collect()}
    held = [(i, g) for i, _, g in rows if zlib.crc32(str(i).encode()) % 5 == 2]
    assert np.mean([got[i].selected == (g > 0) for i, g in held]) > 0.95
    means = [np.mean([got[i].expected_grade for i, g in held if g == k]) for k in range(3)]
    assert means[0] < means[1] < means[2]
    assert 0 <= got[9000].tail <= 1 and len(got) == 601
    assert Q.quality(spark, docs, Q.graded(labels.filter("quality is null"))).count() == 601
    assert Q.quality(spark, docs.limit(0), Q.graded(labels)).count() == 0
