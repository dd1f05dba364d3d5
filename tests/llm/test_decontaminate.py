import random

import numpy as np
import pytest

from quillon.llm import decontaminate as D

ITEMS = [(1, "What is the tallest mountain in the whole range of hills? Answer: mount keld of the north"), (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"), (3, None), (4, "!!!"), (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi")]


def test_wand_equals_exhaustive_scores():
    r = random.Random(5)
    items = [(i, " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") * r.randint(1, 2) for _ in range(r.randint(5, 40)))) for i in range(150)]
    index = D.Index(items)
    for _ in range(200):
        query = r.sample(range(len(index.terms)), r.randint(1, len(index.terms)))
        score = np.zeros(len(index.ids))
        for t in query:
            score[index.docs[t]] += index.impacts[t]
        for least in (0.05, 0.3, 0.6, 0.95):
            assert {i for _, i in index.search(sorted(query), least)} == set(np.flatnonzero(score >= least - 1e-12).tolist())


def test_scores_are_shares_and_bound_loses_nothing():
    r = random.Random(6)
    vocabulary = [f"t{i}" for i in range(300)]
    items = [(i, " ".join(r.choices(vocabulary, k=30))) for i in range(60)]
    index = D.Index(items)
    full = np.zeros(len(index.ids))
    for docs, impacts in zip(index.docs, index.impacts):
        full[docs] += impacts
    assert np.allclose(full, 1)
    for _ in range(100):
        words = r.choices(vocabulary, k=100) + items[r.randrange(60)][1].split()[: r.randint(5, 30)]
        terms = sorted({index.terms[w] for w in words if w in index.terms})
        used = [t for t in terms if index.essential[t]]
        if index.search(terms):
            assert 0 in index.possible(np.zeros(len(used), np.int64), np.array(used, np.int64))


def test_hits(spark):
    filler = " ".join(f"f{i}" for i in range(500))
    question = ITEMS[0][1]
    near = ITEMS[1][1].replace("kappa", "changed")
    docs = [(1, f"{filler} {question} {filler}"), (2, filler), (3, f"{near.upper()}!"), (4, None), (None, ITEMS[1][1]), (6, ""), (7, question.split(" Answer")[0]), (8, " ".join(sorted(ITEMS[1][1].split())))]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, doc_id string")
    for size in (100, 2):
        got = sorted(((r.doc_id is None, r.doc_id or 0, r.item_id) for r in D.contaminated(spark, df, items, size).collect()))
        assert got == [(False, 1, 1), (False, 3, 2), (False, 3, 5), (True, 0, 2), (True, 0, 5)]
        kept = D.decontaminate(spark, df, items, size)
        assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 4, 6, 7, 8]
    assert D.contaminated(spark, df.limit(0), items).count() == 0
    assert D.decontaminate(spark, df, items.limit(0)).count() == len(docs)


@pytest.mark.parametrize("offset", [0, 1, 63, 64, 65, 127, 128, 200])
def test_item_is_found_wherever_it_lies(offset):
    index = D.Index([(9, ITEMS[1][1])])
    assert index.hits([" ".join(["zz"] * offset) + " " + ITEMS[1][1] + " yy" * offset])[0][0][0] == 9


def test_planted_passages_of_the_table(spark, small):
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    flat = lambda t: " " + " ".join(D.words_of(t)) + " "
    whole = {(d.doc_id, i.item_id) for i in items.collect() for d in docs.collect() if flat(i.text) in flat(d.text)}
    got = {(r.doc_id, r.item_id) for r in D.contaminated(spark, docs, items).collect()}
    assert whole <= got and len(got) <= len(whole) + 2
