import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import packing as P


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_bins_hold_every_piece_once(lengths):
    lengths.sort(reverse=True)
    bins = P.pack(lengths, (16, 32, 64), 4)
    assert sorted(i for b in bins for i in b.members) == list(range(len(lengths)))
    for b in bins:
        assert b.used == sum(lengths[i] for i in b.members) <= b.capacity and b.capacity in (16, 32, 64)
        assert b.capacity == 16 or b.used > b.capacity // 2  # downsized


def brute(lengths, capacities, overhead):
    """The same rules, looked up the plain way."""
    bins = []
    for i, n in enumerate(lengths):
        fits = [(c - sum(lengths[j] for j in m), k) for k, (c, m) in enumerate(bins) if c - sum(lengths[j] for j in m) >= n]
        if fits:
            bins[min(fits)[1]][1].append(i)
            continue
        options = []
        for c in capacities:
            if c >= n:
                rest = sum(x for x in lengths[i + 1 :] if x <= c - n)
                options.append(((c + overhead) / min(c, n + rest), c))
        bins.append((min(options)[1], [i]))
    return [(next(c for c in capacities if c >= sum(lengths[j] for j in m)), m) for _, m in bins]


def test_equals_brute_force():
    r = random.Random(4)
    for _ in range(60):
        lengths = sorted((r.randint(1, 64) for _ in range(r.randint(0, 60))), reverse=True)
        assert [(b.capacity, b.members) for b in P.pack(lengths, (16, 32, 64), 4)] == brute(lengths, (16, 32, 64), 4)


def test_fill_beats_one_size():
    r = random.Random(5)
    lengths = sorted((min(8192, int(r.paretovariate(1.2) * 150)) for _ in range(3000)), reverse=True)
    bins = P.pack(lengths)
    assert sum(lengths) / sum(b.capacity for b in bins) > 0.99
    with pytest.raises(ValueError):
        P.pack([9], (8,))


def test_documents(spark):
    rows = [(1, "one two three"), (2, None), (3, "word " * 40), (3, "word " * 40), (None, "x"), (4, "")]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, length int")
    got = P.pack_documents(spark, docs, (8, 16), 2, shard=3).collect()
    want = {1: 4, 2: 1, 4: 1, None: 2}
    for i, n in want.items():
        assert sum(r.length for r in got if r.doc_id == i) == n
    assert sorted((r.copy, r.piece, r.start, r.length) for r in got if r.doc_id == 3) == [(c, p, p * 16, n) for c in (0, 1) for p, n in ((0, 16), (1, 16), (2, 9))]
    bins = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r)
    for members in bins.values():
        members.sort(key=lambda r: r.bin_offset)
        at = 0
        for r in members:
            assert r.bin_offset == at and r.used <= r.capacity
            at += r.length
        assert at == members[0].used
    assert P.pack_documents(spark, docs.limit(0)).count() == 0
