import math
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from quillon.llm import ctw as C


def brute_model(train):
    count = {}
    for raw in train:
        b = C.PAD + raw + b"\xff"
        for i in range(C.DEPTH, len(b)):
            for k in range(8):
                prefix, bit = b[i] >> (8 - k), b[i] >> (7 - k) & 1
                for d in range(C.DEPTH + 1):
                    count.setdefault((k, prefix, b[i - d : i]), [0, 0])[bit] += 1
    children = {}
    for k, prefix, context in count:
        if context:
            children.setdefault((k, prefix, context[1:]), []).append((k, prefix, context))

    def kt(n):
        a, b = count.get(n, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @lru_cache(None)
    def weighted(n):
        return kt(n) if len(n[2]) == C.DEPTH else math.log(0.5) + float(np.logaddexp(kt(n), sum(map(weighted, children.get(n, ())))))

    def one(k, prefix, context, d=0):
        n = (k, prefix, context[C.DEPTH - d :])
        a, b = count.get(n, (0, 0))
        if d == C.DEPTH:
            return (b + 0.5) / (a + b + 1)
        stop = math.exp(math.log(0.5) + kt(n) - weighted(n))
        return stop * (b + 0.5) / (a + b + 1) + (1 - stop) * one(k, prefix, context, d + 1)

    def score(raw):
        b, total = C.PAD + raw + b"\xff", 0.0
        for i in range(C.DEPTH, len(b)):
            for k in range(8):
                p = one(k, b[i] >> (8 - k), b[i - C.DEPTH : i])
                total += math.log10(p if b[i] >> (7 - k) & 1 else 1 - p)
        return total

    return score


def test_log_gamma():
    x = np.array([0.5, 1.0, 2.5, 17.0, 1e6])
    assert np.allclose(C.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-9)


def test_probabilities_sum_to_one():
    """Over all bytes after one context, seen in training or not."""
    train = [b"the cat", b"a dog", b"", b"the dog ate"]
    seen = np.concatenate([k for k, _ in C.grams_of(train)])
    context = int(seen[5]) >> 8
    for c in (context, context ^ 0x7F000000, context ^ 0x7F7F0000):  # as it is, unknown at depth 4, unknown at depth 3
        every = np.array([c << 8 | b for b in range(256)], np.uint64)
        keys = np.unique(np.concatenate([seen, every]))
        n = (keys[:, None] == seen[None, :]).sum(1)
        counts, below, ones = np.zeros((256, 256)), np.zeros((256, 255)), np.zeros((len(keys), 8))
        for s in np.unique(keys >> np.uint64(8) & np.uint64(65535)):
            pick = (keys >> np.uint64(8) & np.uint64(65535)) == s
            ones[pick], a, b = C.subtree(keys[pick], n[pick])
            counts[int(s) & 255] += a
            below[int(s) & 255] += b
        p = 10 ** C.log10_of(keys, ones, *C.top(counts, below))
        assert p[np.isin(keys, every)].sum() == pytest.approx(1)


def test_pieces_of_texts():
    raws = [b"", b"abc", b"x" * 50, b"y" * 9]
    for size in (1, 4, 16, 1000):
        got = {}
        for keys, owners in C.grams_of(raws, size):
            for k, o in zip(keys.tolist(), owners.tolist()):
                got.setdefault(o, []).append(k & 255)
        assert [bytes(got[i]) for i in range(4)] == [r + C.END for r in raws]


def test_query_equals_brute_force(spark):
    texts = ["The cat sat on the mat", "a Dog\tate the cat", None, "é ñ cat", "the cat sat on the mat", "zzz\n the " + "long" * 30, "x" * 3000, ""]
    rows = [(i, texts[i % len(texts)]) for i in range(24)] + [(None, "cat"), (3, "é ñ cat")]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    lower = lambda t: (t or "").encode().lower()
    train = [lower(t) for i, t in rows if not held(i)]
    count = Counter(w for t in train for w in t.split())
    n, v, ends = sum(count.values()) + len(train), len(count) + 1, len(train)
    model = brute_model(train)
    for head, most in ((100, 1000), (0, 0), (5, 40)):  # all words and grams broadcast, all joined, some of each
        got = C.lm_scores(spark, docs, head, most).collect()
        assert len(got) == len(rows)
        by = {}
        for r in got:
            by.setdefault(r.doc_id, r)
        for i, t in rows:
            r, w = by[i], lower(t).split()
            base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w) + math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w) + 1, sum(count[x] > 0 for x in w) + 1, n)
            assert r.base_score == pytest.approx(base, rel=1e-7)
            assert r.score == pytest.approx(model(lower(t)), rel=1e-7)


def test_pieces_of_long_texts_count_each_byte_once(spark):
    text = ("ab cd " * 400_000)[: 2_100_001]
    docs = spark.createDataFrame([(2, text)], "doc_id long, text string")
    rows = C.corpus_counts(docs, 2, 3).filter("kind = 0").collect()
    whole = C.PAD + text.encode() + C.END
    assert {r.gram: r.n_train for r in rows} == Counter(int.from_bytes(whole[i : i + C.DEPTH + 1], "big") for i in range(len(text) + 1))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert C.lm_scores(spark, empty).count() == 0
    only_held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = C.lm_scores(spark, spark.createDataFrame([(only_held, "a b")], "doc_id long, text string")).first()
    assert r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score)
