import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions.vectors import Metric
from quillon.operators import hybrid as H
from quillon.operators.fusion import ReciprocalRank
from quillon.operators.text import matches, parse_query, query_tokens, stem, tokens, with_terms


def lists(spark, *ids):
    rows = [(k, i, r + 1) for k, one in enumerate(ids) for r, i in enumerate(one)]
    return spark.createDataFrame(rows, "list_id int, id long, rank int")


def test_rrf_scores_ties_and_duplicates(spark):
    out = ReciprocalRank(60).top(lists(spark, [10, 20, 30], [20, 40, 10]), 10).collect()
    assert [r.id for r in out] == [20, 10, 40, 30]
    assert out[0].score == pytest.approx(1 / 62 + 1 / 61)
    assert [r.id for r in ReciprocalRank(60).top(lists(spark, [5, -5], [-5, 5]), 5).collect()] == [-5, 5]
    twice = ReciprocalRank(0).fuse(lists(spark, [7, 8, 7])).collect()
    assert {r.id: r.score for r in twice} == {7: 1.0, 8: 0.5}


@pytest.mark.parametrize("k", [float("nan"), float("inf"), -1.0])
def test_rrf_refuses(k):
    with pytest.raises(ValueError, match="invalid RRF k"):
        ReciprocalRank(k)


def test_query_language(spark):
    rows = spark.createDataFrame([(1, "red fox jumps"), (2, "fox red"), (3, "blue whale"), (4, None)], "id int, body string").select("id", tokens("body").alias("t"))
    got = lambda q: sorted(r.id for r in rows.filter(matches(parse_query(q), F.col("t"))).collect())
    assert got("red fox") == [1, 2]
    assert got('"red fox"') == [1]
    assert got("whale OR jumps") == [1, 3]
    assert got("fox -jumps") == [2]
    assert got("") == []
    assert query_tokens("The Headphones are", "english") == ["headphon" + "e"]


def test_words_of_any_language_and_stems(spark):
    texts = ["Été à l'École_No5 Straße", "running hopped agreed flies caresses sky's studying plastered motoring trees ties feed sing falling hissing filing", "日本語 текст", "is was", ""]
    words = "running hopped agreed caresses skies happy falling hissing filing conflated troubled sized bled sing".split()
    assert [stem(w) for w in words] == "run hop agree caress ski happi fall hiss file conflate trouble size bled sing".split()
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    for config in ("simple", "english"):
        got = {r.id: r.t for r in rows.select("id", tokens("body", config).alias("t")).collect()}
        assert got == {i: query_tokens(t, config) for i, t in enumerate(texts)}
    assert query_tokens(texts[0]) == ["été", "à", "l", "école", "no5", "straße"]
    hits = with_terms(rows, "body", "t", "english")
    assert [r.id for r in hits.filter(matches(parse_query("run -blue", "english"), F.col("t"))).collect()] == [1]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_query_language_never_raises(text):
    parse_query(text)


def test_hybrid_errors(spark):
    df = spark.createDataFrame([(1, [1.0], "x", "y")], "id long, v array<float>, t string, s string")
    for args, text in (
        (("nope", "v", "t"), 'id column "nope" does not exist'), (("s", "v", "t"), 'id column "s" is string, but must be an integer type'), (("id", "t", "t"), 'vector column "t" is string'), (("id", "v", "id"), 'text column "id" is bigint'),
    ):
        with pytest.raises(H.HybridError) as e:
            H.hybrid_search(df, *args, "x", [1.0])
        assert text in str(e.value)
    with pytest.raises(H.HybridError, match="k must be at least 1, got 0"):
        H.hybrid_search(df, "id", "v", "t", "x", [1.0], k=0)
    with pytest.raises(H.HybridError, match="different"):
        H.infer_metric("v", [0, 1])
    with pytest.raises(H.HybridError, match="needs an index"):
        H.infer_metric("v", [])
    assert H.infer_metric("v", [1, 1]) is Metric.COSINE
    assert (H.default_depth(5), H.default_depth(20)) == (40, 80)


def test_hybrid_null_vectors_and_signed_ties(spark):
    df = spark.createDataFrame([(-100, [1.0], "other"), (100, None, "word")], "id long, v array<float>, t string")
    out = H.hybrid_search(df, "id", "v", "t", "word", [1.0]).collect()
    assert [(r.id, r.vector_rank, r.text_rank) for r in out] == [(-100, 1, None), (100, None, 1)]


def test_hybrid_uses_the_index(spark, tmp_path):
    from quillon.operators.index import VectorIndex

    df = spark.range(300).select("id", F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("v"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("t"))
    index = VectorIndex.build(spark, df, f"file://{tmp_path}/a", "id", "v", metric=Metric.COSINE, shards=1)
    got, want = (H.hybrid_search(df, "id", "v", "t", "299", [1.0, 0.2], 5, metric=Metric.COSINE, indexes=x).collect() for x in ([index], None))
    assert got == want and any(r.text_rank for r in got)
    assert H.hybrid_search(df, "id", "v", "t", "", [1.0, 0.2], 5, indexes=[index]).collect()[0].vector_rank == 1
    with pytest.raises(H.HybridError, match="needs an index"):
        H.hybrid_search(df, "id", "v", "t", "x", [1.0, 0.2], indexes=[])
    with pytest.raises(H.HybridError, match="ranks by COSINE, not by L2"):
        H.hybrid_search(df, "id", "v", "t", "x", [1.0, 0.2], metric=Metric.L2, indexes=[index])
