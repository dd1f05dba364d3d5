"""The same awkward rows for every operator and stage: nulls, empty and very long texts, ties, repeated rows, no rows, clashing columns."""

import math
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from quillon.llm import decontaminate as D
from quillon.llm import lang_id as L
from quillon.llm import matroska as M
from quillon.llm import near_dup as N
from quillon.llm import packing as K
from quillon.llm import quality as Q
from quillon.llm import sstable as S
from quillon.llm import toxicity as T

LONG = " ".join(f"word{i % 977}, (more) Text-{i}!" for i in range(12_000))


def awkward(spark, clash):
    """Rows with every case, and a column with a name that the operator uses itself."""
    texts = ["the cat sat on the mat", None, "", "  \n", LONG, "the cat sat on the mat", "é ½ 12 !!", "a@b.org +49 30 1234567"]
    rows = [(i, t, ("en", "de", None)[i % 3], "s", len(t or ""), 7) for i, t in enumerate(texts)]
    rows += [(None, "no id here", "en", "s", 10, 7), rows[0], rows[0], (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {clash} int")


def same(rows):
    """Values of equal (doc_id, text) rows are equal, so a set has one each."""
    return Counter(map(str, rows))


def test_op1_words_before_their_marked_forms():
    """What was met alone before changes nothing: each word is encoded first, then with each ending, and a fresh encoder agrees."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(S.default_tokenizer())
    e = S.WordEncoder(S.default_tokenizer())
    words = ['-', '"', ")", "%", ">", "(", "*", "#", "5", "½", "é", "abc", "a-b", "don't", "Ünder", "ﬁ", "日", "_", "́", "--", "x1", "naïve"]
    for w in words:
        e.encode_batch([w.encode()])
    marked = [w + m for w in words for m in (":", ",", ".", "!", "?", ";", ".,", "?!", "...", "'s")]
    got = [np.frombuffer(g, "<u2").tolist() for g in e.encode_batch([m.encode() for m in marked])]
    assert got == [whole.encode(m, add_special_tokens=False).ids for m in marked]


def test_op1_long_texts(spark):
    from tokenizers import Tokenizer

    got = {r.doc_id: r for r in S.token_shards(spark, awkward(spark, "start")).collect() if r.doc_id is not None}
    ids = [*Tokenizer.from_file(S.default_tokenizer()).encode(LONG, add_special_tokens=False).ids, 1]
    assert got[4].n_tokens == len(ids) and got[4].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and len(LONG) > 200_000


def test_op2_cases(spark):
    item = "which river runs past the old stone bridge of the town answer: the blue danube river itself"
    items = spark.createDataFrame([(1, item), (2, item), (3, None), (None, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, LONG + " " + item + " " + LONG), (2, item), (2, item), (3, None), (None, item), (4, LONG)], "doc_id long, text string").selectExpr("*", "1.5 as score")
    got = D.contaminated(spark, docs, items).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == Counter([(1, 1), (1, 2), (2, 1), (2, 2), (2, 1), (2, 2), (None, 1), (None, 2)])
    kept = D.decontaminate(spark, docs, items)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter([3, 4])
    assert D.contaminated(spark, docs.limit(0), items).count() == 0 == D.contaminated(spark, docs, items.limit(0)).count()


def test_op2_blocks_do_not_change_scores(spark):
    r = np.random.default_rng(3)
    texts = [" ".join(f"t{k}" for k in r.integers(0, 60, 20)) for _ in range(60)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(["x"] * 3 + texts[i].split()[3:])) for i in range(60)], "doc_id long, text string")
    rows = lambda size: sorted((x.doc_id, x.item_id, round(x.score, 9)) for x in D.contaminated(spark, docs, items, size).collect())
    assert rows(1000) == rows(9) and len(rows(1000)) > 10


def test_op3_cases(spark):
    docs = awkward(spark, "copy")
    pieces = K.pack_documents(spark, docs, (64, 128, 1024)).collect()
    lengths = Counter()
    for p in pieces:
        lengths[p.doc_id, p.copy] += p.length
    n = {r.doc_id: r.n_tokens for r in K.token_lengths(docs).collect() if r.doc_id is not None}
    assert all(lengths[i, c] == n[i] for i, c in lengths if i is not None) and {c for i, c in lengths if i == 0} == {0, 1, 2}
    assert [b.members for b in K.pack([5, 5, 5, 5], (10,))] == [[0, 1], [2, 3]]  # ties in the order given
    many = spark.createDataFrame([(1, "a b")] * 2500, "doc_id long, text string")
    got = K.pack_documents(spark, many, (64, 128, 1024)).collect()
    assert sorted(p.copy for p in got) == list(range(2500))  # more than one stretch of copies


def test_op6_cases(spark):
    docs = awkward(spark, "media")
    got = M.media_digests(M.to_media(docs)).collect()
    assert len(got) == 12 and Counter(r.doc_id for r in got)[None] == 2
    by = {(r.doc_id, r.n_bytes): r for r in got}
    assert by[4, len(LONG.encode())].payload_bytes == len(M.pad(LONG.encode())) and by[1, 0].payload_bytes == 64
    assert len({r.media_sha256 for r in got if r.doc_id == 0}) == 1 and M.to_media(docs.limit(0)).count() == 0


@pytest.mark.parametrize("body", [b"", b"\x81", b"\x81\x00", b"\x81\x00\x00\x04", b"\x81\x00\x00\x04\x07abc", b"\x81\x00\x00\x02\x02\xff\xff", b"\x81\x00\x00\x06\x03\x41"])
def test_op6_broken_blocks_are_refused(body):
    data = M._HEADER + M.element(M.SEGMENT, M._TRACKS + M.element(M.CLUSTER, M.uint(M.TIMESTAMP, 0) + M.element(M.SIMPLE, body)))
    with pytest.raises(ValueError):
        M.demux(data)
    with pytest.raises(ValueError):
        M.demux(M.mux(bytes(64))[:-3])
    assert struct.calcsize(">hB") == 3


def test_op7_cases(spark):
    docs = awkward(spark, "class_id")
    got = N.near_duplicates(spark, docs).collect()
    groups = {}
    for r in got:
        groups.setdefault((r.class_id, r.class_size), []).append(r)
    assert len(got) == 12 and sum(r.kept for r in got) == len(groups)
    assert {r.class_id for r in got if r.doc_id in (0, 5)} == {0} and {r.class_size for r in got if r.doc_id == 0} == {4}
    assert {r.class_id for r in got if r.doc_id == 1} == {1} and next(r for r in got if r.doc_id == 4).class_size == 1


def brute_language(train, text):
    """Posterior by plain dictionaries."""
    langs = sorted({lang for _, lang in train})
    words, grams = {lang: Counter() for lang in langs}, {lang: Counter() for lang in langs}
    for t, lang in train:
        for w in L.words_of(t):
            words[lang][w] += 1
            for n in range(1, 5):
                for g in L.grams_of(w, n):
                    grams[lang][g] += 1
    keys, gram_keys = set().union(*words.values()), set().union(*grams.values())
    log = lambda table, keys, k, lang: math.log((table[lang][k] + 0.1) / (sum(table[lang].values()) + 0.1 * (len(keys) + 1)))
    total = {lang: math.log(sum(x == lang for _, x in train) / len(train)) for lang in langs}
    for w in L.words_of(text):
        for lang in langs:
            if w in keys:
                total[lang] += log(words, keys, w, lang)
                continue
            for n in range(4, 0, -1):
                found = [g for g in L.grams_of(w, n) if g in gram_keys]
                if found:
                    total[lang] += sum(log(grams, gram_keys, g, lang) for g in found) / len(found)
                    break
    best = min(langs, key=lambda x: (-total[x], x))
    return best, 1 / sum(math.exp(total[x] - total[best]) for x in langs)


def test_op8_equals_brute_force(spark):
    texts = ["the cat and the dog", "der Hund und die Katze", "le chat et le chien", "the end of the road", "das Ende der Straße", "la fin de la route", "cats", "Hunde", "unseen zebra", "½ ²", None, "the die le", LONG]
    rows = [(i, texts[i % 13], ("en", "de", "fr")[i % 3] if i % 13 < 6 else None) for i in range(60)] + [(3, texts[3], "en")] * 5
    docs = spark.createDataFrame([(*x, 0.5) for x in rows], "doc_id long, text string, lang string, score double")
    train = sorted({(t, lang) for i, t, lang in rows if lang and t and zlib.crc32(str(i).encode()) % 5 != 0})
    got = L.identify(spark, docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t, _ in rows if i == r.doc_id)
        if not L.words_of(text):
            assert (r.lang_pred, r.score) == ("und", 0)
        else:
            lang, score = brute_language(train, text)
            assert r.lang_pred == lang and r.score == pytest.approx(score, rel=1e-3)
    tie = spark.createDataFrame([(1, "same words", "zz"), (2, "same words", "aa"), (5, "same words", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in L.identify(spark, tie).collect()} == {"aa"}


def test_op9_equals_brute_force(spark):
    """The tail of every text from the weights, feature by feature; nulls, repeated rows, long texts."""
    docs = awkward(spark, "tail")
    labels = spark.createDataFrame([(i, (i or 0) % 2, 0) for i in (0, 1, 2, 3, 4, 5, 6, 7, None)], "doc_id long, quality int, toxic int")
    model = Q.fit(docs, Q.graded(labels))
    got = Q.quality(spark, docs, Q.graded(labels)).collect()
    assert len(got) == 12 and len({r.tail for r in got if r.doc_id == 0}) == 1
    for r in got:
        text = next(x.text for x in docs.collect() if x.doc_id == r.doc_id) if r.doc_id is not None else None
        if r.doc_id is None:
            continue
        raw = (text or "").encode()
        tokens = raw.split()
        own = np.mean([model.weights[f] for f in Q.text_features(raw, tokens)])
        words = np.mean([np.mean([model.weights[f] for f in Q.token_features(t)]) for t in tokens]) if tokens else 0.0
        s = (1 - Q.TEXT_SHARE) * words + Q.TEXT_SHARE * own
        tails = [1 / (1 + math.exp(-(s - t))) for t in model.thresholds]
        assert r.tail == pytest.approx(tails[0], abs=1e-4) and r.expected_grade == pytest.approx(sum(tails), abs=1e-4)


def test_op10_cases(spark):
    docs = awkward(spark, "score")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)] + [(0, 0), (None, 1)], "doc_id long, toxic int")
    got = T.toxicity(spark, docs, labels).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id == 0}) == 1
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1  # null, empty and blank texts alike


def test_stages_in_sequence(spark, small):
    import importlib

    pipeline = importlib.import_module("corpus_pipeline")
    from quillon.llm._common import materialise

    docs = materialise(spark, awkward(spark, "_row").selectExpr("*", "1.5 as digest", "'x' as _t"), "awkward")
    columns, before = docs.columns, {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        none = stage(spark, docs.limit(0), small)
        assert none.count() == 0
        docs = materialise(spark, stage(spark, docs, small), f"edge-{k}")
        if k < 4:
            assert docs.columns == columns and none.columns == columns
        before[name] = Counter(r.doc_id for r in docs.collect())
    assert before["language ID"][0] == 3 and 1 not in before["language ID"]
    assert before["MinHash near-dedup"][0] == 1 and 5 not in before["MinHash near-dedup"] and 4 in before["MinHash near-dedup"]
    assert set(before["best-fit packing"]) == set(before["PII"])
