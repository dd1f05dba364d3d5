import itertools
import random

import numpy as np
import pytest

from quillon.llm import near_dup as N

SCHEMA = "doc_id long, text string"


def words(r, n):
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def jp(a, wa, b, wb):
    x, y = dict(zip(a.tolist(), wa.tolist())), dict(zip(b.tolist(), wb.tolist()))
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())


def test_shingles_ignore_place_case_and_signs():
    a, b = N.shingles(b"One two, three FOUR five six"), N.shingles(b"one two three four five six")
    assert a[0].tolist() == b[0].tolist() and len(a[0]) == 2
    many = N.shingle_sets([b"x y", b"", b"one two three four five six", b"..."], piece=4)
    assert [len(e) for e, _ in many] == [1, 0, 2, 0] and many[2][0].tolist() == b[0].tolist()


def test_estimates_follow_probability_jaccard():
    r, gaps = random.Random(1), []
    for _ in range(40):
        w = [f"v{r.randrange(60)}" for _ in range(300)]
        z = list(w)
        for _ in range(r.randrange(1, 25)):
            z[r.randrange(300)] = f"u{r.random()}"
        a, b = N.shingles(" ".join(w).encode()), N.shingles(" ".join(z).encode())
        exact = N.similarity(*a, *b)[1]
        assert exact == pytest.approx(jp(*a, *b), abs=1e-9)
        gaps.append((N.prob_minhash(*a) == N.prob_minhash(*b)).mean() - exact)
    assert abs(np.mean(gaps)) < 0.02 and np.std(gaps) < 0.06


def test_batched_signatures_equal_single_ones():
    r = random.Random(2)
    sets = [N.shingles(" ".join(words(r, n)).encode()) for n in (3, 20, 130, 400, 2000)]
    many = N.prob_minhash_many(sets)
    assert all((many[i] == N.prob_minhash(*s)).all() for i, s in enumerate(sets))


def brute_classes(rows):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [N.shingles((t or "").encode()) for _, t in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (rows[i][1] or "") == (rows[j][1] or "") or max(N.similarity(*sets[i], *sets[j])) >= N.LEAST:
            root[find(j)] = find(i)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), 10**9), i)
    return {i: least[find(k)] for k, (i, _) in enumerate(rows)}


def fixture():
    r, rows = random.Random(7), []
    for _ in range(8):
        base = words(r, 150)
        for c in range(7):
            w = list(base)
            for _ in range(r.choice((0, 0, 1, 2, 6, 12))):
                w[r.randrange(len(w))] = f"z{r.random()}"
            rows.append(" ".join(w))
    chain = words(r, 200)
    for c in range(6):  # each is near the one before only
        chain = chain[:]
        chain[c * 10] = f"c{c}"
        chain[c * 10 + 100] = f"d{c}"
        rows.append(" ".join(chain))
    rows += ["", "", "short text", "short text", "Short, text!", "other"]
    r.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


def test_classes_equal_brute_force(spark):
    rows = fixture()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA + ", digest string")
    got = N.near_duplicates(spark, docs).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows)
    sizes = {}
    for r in got:
        sizes.setdefault(r.class_id, []).append(r)
    assert all(len(v) == v[0].class_size and sum(r.kept for r in v) == 1 for v in sizes.values())


def test_a_large_group_and_its_rest(spark):
    """Copies so far from the hub that only the comparison with all candidates links them."""
    r = random.Random(3)
    base, rows = words(r, 120), []
    for k in range(60):
        w = list(base)
        for _ in range(k % 6):
            w[r.randrange(120)] = f"q{r.random()}"
        rows.append((k, " ".join(w)))
        rows.append((k + 100, " ".join(w) + " tail"))
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {x.doc_id: x.class_id for x in N.near_duplicates(spark, docs).collect()} == brute_classes(rows)


def test_chains_of_versions_stay_whole(spark):
    """Texts that each have a link elsewhere are still compared with the others of their buckets."""
    r, rows = random.Random(11), []
    for _ in range(16):
        w = words(r, 200)
        for _ in range(40):
            w = w[16:] + words(r, 16)  # 180 of 212 shingles in common: 0.85
            rows.append(" ".join(w))
    r.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for x in N.near_duplicates(spark, docs).collect():
        got.setdefault(x.class_id, []).append(x.doc_id)
    assert sorted(map(len, got.values())) == [40] * 16


def test_equal_sets_share_bands_whatever_repeats():
    r = random.Random(5)
    for _ in range(40):
        e = N.shingles(" ".join(words(r, 204)).encode())[0]
        w = np.ones(len(e), np.int64)
        w[r.sample(range(len(e)), 20)] = 20
        assert N.similarity(e, w, e, np.ones_like(w))[0] == 1
        one, two = N.all_bands([(e, w), (e, np.ones_like(w))])
        assert len(set(one) & set(two)) == N.BANDS


def test_components(spark):
    r = random.Random(9)
    rows = [tuple(sorted((bytes([r.randrange(200)]), bytes([r.randrange(200)])))) for _ in range(150)]
    rows = [x for x in rows if x[0] != x[1]]
    root = {x: x for pair in rows for x in pair}
    for _ in range(200):
        for a, b in rows:
            root[a] = root[b] = min(root[a], root[b])
    got = {bytes(x.digest): bytes(x.root) for x in N.components(spark, spark.createDataFrame(rows, "a binary, b binary")).collect()}
    assert got == root


def test_prefixes_meet_whenever_texts_are_alike():
    """The first common element lies in both prefixes, and its shares bound the similarity from above."""
    r = np.random.default_rng(4)
    met = 0
    for _ in range(400):
        base = r.choice(10**6, 120, replace=False).astype(np.uint64)
        sides = []
        for _ in range(2):
            e = np.unique(np.concatenate([base[r.random(120) < 0.95], r.choice(10**6, r.integers(0, 12)).astype(np.uint64)]))
            sides.append((e, np.where(r.random(len(e)) < 0.1, r.integers(1, 9, len(e)), 1)))
        best = max(N.similarity(*sides[0], *sides[1]))
        if best < N.LEAST:
            continue
        met += 1
        first, second = (dict(zip(*(x.tolist() for x in N.prefixes(e, w, (e % np.uint64(7)).astype(np.int64))))) for e, w in sides)
        shared = [k for k in first if k in second]
        (a, _), (b, _) = sides
        order = lambda e: [int(x) for x in e[np.lexsort((e, e % np.uint64(7)))]]
        i, j = order(a).index(shared[0]), order(b).index(shared[0])
        most = min(len(a) - i, len(b) - j)
        assert max(most / (len(a) + len(b) - most), 1 / (1 / first[shared[0]] + 1 / second[shared[0]] - 1)) >= best - 1e-9
    assert met > 100


def test_parities_never_rule_out_an_alike_pair():
    r = np.random.default_rng(4)
    ruled = 0
    for _ in range(600):
        n = int(r.choice([5, 40, 200, 1500]))
        base = r.integers(0, 2**63, n).astype(np.uint64)
        sides = []
        for _ in range(2):
            e = np.unique(np.concatenate([base[r.random(n) < r.choice([0.9, 0.97, 1])], r.integers(0, 2**63, r.integers(0, n // 8 + 2)).astype(np.uint64)]))
            sides.append((e, np.where(r.random(len(e)) < r.choice([0, 0.2]), r.integers(1, 9, len(e)), 1)))
        bits = [np.frombuffer(x, np.uint64)[None, :] for x in N.parities(sides)]
        room = N.possible(*[y for b, (e, w) in zip(bits, sides) for y in (b, np.array([len(e)]), np.array([w.sum()]))])[0]
        if max(N.similarity(*sides[0], *sides[1])) >= N.LEAST:
            assert room >= 0
        ruled += room < 0
    assert ruled > 100


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    """With limits so low that every path is taken: copies, buckets, pairs and shingles beyond them."""
    from quillon.llm import _common

    monkeypatch.setattr(_common, "LEAST_HOT", 3)
    monkeypatch.setattr(N, "NEAREST", 1)
    r = random.Random(13)
    base, rows = words(r, 100), []
    for k in range(70):
        w = list(base)
        for _ in range(r.choice((0, 1, 2, 3, 4, 5))):
            w[r.randrange(100)] = f"q{r.random()}"
        rows.append((k, " ".join(w)))
    rows += [(200 + k, rows[0][1]) for k in range(12)] + [(None, rows[1][1]), (5, rows[5][1]), (5, rows[5][1])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA + ", digest string")
    got = N.near_duplicates(spark, docs).collect()
    want = brute_classes([(i, t) for i, t in rows if i is not None])
    assert {x.doc_id: x.class_id for x in got if x.doc_id is not None} == want and len(got) == len(rows)
    assert sum(x.kept for x in got) == len(set(want.values())) == N.one_of_each(spark, docs).count()


@pytest.mark.parametrize("pairs", (0, 40, 1 << 28))
def test_unlike_members_of_buckets_make_no_prefix_rows(spark, monkeypatch, pairs):
    """Texts that share buckets and are no copies meet bucket by bucket; the prefix filter is for buckets beyond the limit alone. Either way gives all links."""
    monkeypatch.setattr(N, "PAIRS", pairs)
    asked, by_prefix = [], N._by_prefix
    monkeypatch.setattr(N, "_by_prefix", lambda *a: asked.append(1) or by_prefix(*a))
    r = random.Random(17)
    rows = fixture()
    for _ in range(6):
        base = words(r, 150)
        for _ in range(10):  # about 0.7 alike, so that most pairs share a bucket and have no link
            w = list(base)
            for k in r.sample(range(150), 3):
                w[k] = f"y{r.random()}"
            rows.append((len(rows), " ".join(w)))
    got = N.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    assert {x.doc_id: x.class_id for x in got} == brute_classes(rows)
    assert bool(asked) == (pairs < 1 << 28)


def test_one_of_each_keeps_columns_and_one_row(spark):
    rows = [(4, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (None, "alone here"), (9, None), (7, "")]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], SCHEMA + ", rows int, _row string")
    out = N.one_of_each(spark, docs)
    assert out.schema == docs.schema or out.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 2), (False, 7), (True, 0)]
    assert N.one_of_each(spark, docs.limit(0)).count() == 0 and N.near_duplicates(spark, docs.limit(0)).count() == 0


def test_no_table_has_a_row_a_pair(spark, monkeypatch):
    """Texts of one often repeated line share buckets and pass the parity bound, alike or not; no table on the way may have more rows than there are texts in buckets."""
    made, write = [], N.materialise

    def counted(spark, df, name):
        out = write(spark, df, name)
        made.append((out.count(), name))
        return out

    monkeypatch.setattr(N, "materialise", counted)
    r = random.Random(19)
    line, rows = " ".join(words(r, 9)) + " ", []
    for k in range(300):  # those of 12 lines are alike to none, those of 60 to one another
        rows.append((k, line * (12, 60)[k % 2] + " ".join(words(r, 34))))
    got = N.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    assert {x.doc_id: x.class_id for x in got} == brute_classes(rows)
    assert max(made)[0] <= dict((name, n) for n, name in made)["weights"] * 2


def test_finer_parities_never_rule_out_an_alike_pair():
    r = np.random.default_rng(6)
    ruled = 0
    for _ in range(120):
        base = r.integers(0, 2**63, int(r.choice([1000, 1100, 2100, 9000]))).astype(np.uint64)
        keep, sides = r.choice([0.75, 0.9, 0.97]), []
        for _ in range(2):
            e = np.unique(np.concatenate([base[r.random(len(base)) < keep], r.integers(0, 2**63, r.integers(0, 60)).astype(np.uint64)]))
            sides.append((e, np.where(r.random(len(e)) < r.choice([0, 0.2]), r.integers(1, 9, len(e)), 1)))
        fine = N.finer_parities(sides)
        may = N.possible_finely(*[y for b, (e, w) in zip(fine, sides) for y in (b, len(e), int(w.sum()))])
        if max(N.similarity(*sides[0], *sides[1])) >= N.LEAST:
            assert may
        ruled += not may
    assert ruled > 10


def test_a_filter_has_all_its_keys_and_few_others(spark):
    r = np.random.default_rng(8)
    keys, others = r.integers(-(2**63), 2**63, (2, 20000))
    known = N.Filter(spark, spark.createDataFrame([(int(k),) for k in keys[:3000]], "key long"))
    assert known.has(keys[:3000]).all() and known.has(others).mean() < 0.01
    rows = spark.createDataFrame([(int(k), "t") for k in keys[2000:4000]], "k long, t string")
    kept, left = ({x.k for x in known.rows(rows, N.F.col("k"), wanted).collect()} for wanted in (True, False))
    assert kept >= set(keys[2000:3000].tolist()) and kept | left == set(keys[2000:4000].tolist()) and not kept & left and len(kept) < 1050
    none = N.Filter(spark, spark.createDataFrame([], "key long"))
    assert not none.has(keys).any()


def test_full_filters_change_no_class(spark, monkeypatch):
    monkeypatch.setattr(N, "FILTER_BITS", 32)
    monkeypatch.setattr(N, "MOST_FILTER_BITS", 32)
    rows = fixture()
    docs = spark.createDataFrame(rows + [(None, rows[0][1]), (3, rows[3][1])], SCHEMA)
    got = N.near_duplicates(spark, docs).collect()
    want = brute_classes(rows)
    assert {x.doc_id: x.class_id for x in got if x.doc_id is not None} == want and len(got) == len(rows) + 2
    assert [x.class_id for x in got if x.doc_id is None] == [want[rows[0][0]]]


def test_buckets_of_one_text_are_shuffled_once(spark):
    """Where no join is small enough for a broadcast, as in a large corpus, texts that share nothing send their 25 buckets once, to be counted."""
    r = random.Random(23)
    rows = [(k, " ".join(words(r, 40))) for k in range(4000)]
    rows += [(5000 + k, rows[k][1] + " more") for k in range(40)] + [(6000 + k, rows[k][1]) for k in range(100, 140)]
    docs, written = spark.createDataFrame(rows, SCHEMA), lambda: sum(x.totalShuffleWrite() for x in executors())
    store = spark.sparkContext._jsc.sc().statusStore()
    executors = lambda: [store.executorList(False).apply(i) for i in range(store.executorList(False).size())]
    before, limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(limit, "-1")
    try:
        at = written()
        got = {x.doc_id: x.class_id for x in N.near_duplicates(spark, docs).collect()}
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        sent = (written() - at) / len(rows)
    finally:
        spark.conf.set(limit, before)
    assert all(got[5000 + k] == k for k in range(40)) and all(got[6000 + k] == k for k in range(100, 140)) and len(set(got.values())) == 4000
    print("bytes shuffled a text:", round(sent))
    assert sent < 800
