import duckdb
import pytest

import __spark_entry__ as entry
from quillon.operators import evaluation as E
from quillon.plans import reference
from quillon.sources.tables import TABLES, read_csv, write_csv


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


def rounded(rows):
    return sorted((tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(reference.oracle_sql()))
def test_oracle(spark, small, con, name):
    got = reference.queries()[name](spark, small)
    found = con.execute(reference.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(columns)
    assert rounded(tuple(r) for r in got.select(*columns).collect()) == rounded(found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "id int, s string")
    write_csv(df, str(tmp_path / "c"))
    assert sorted(read_csv(spark, str(tmp_path / "c"), "id int, s string").collect()) == sorted(df.collect())


def test_recall_counts_missing_queries(spark):
    truth = spark.createDataFrame([(1, [1, 2]), (2, [3, 4])], "query_id long, ids array<long>")
    found = spark.createDataFrame([(1, [2, 9])], "query_id long, ids array<long>")
    assert {r.query_id: r.recall for r in E.recall(found, truth).collect()} == {1: 0.5, 2: 0.0}


def test_ranks_equal_windows(spark):
    """Ties, nulls, groups and hot values, over more partitions than one."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    df = spark.range(500).select("id", F.expr("case when id % 7 = 0 then null else id % 3 end").alias("g"), F.expr("case when id % 11 = 0 then null when id % 3 = 0 then 5 else id * 37 % 101 end").alias("v"))
    order = [F.col("v").asc_nulls_last(), F.col("id")]
    got = E.ranked(df, order, ("g",), "r", "n")
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(*order)).cast("long")).withColumn("n", F.count("*").over(Window.partitionBy("g")))
    assert sorted(map(tuple, got.select("id", "r", "n").collect())) == sorted(map(tuple, want.select("id", "r", "n").collect()))
    whole = E.ranked(df, order)
    assert sorted(r["rank"] for r in whole.collect()) == list(range(1, 501))
    a = {r.g: (r.n, r.p50, r.p95) for r in E.percentiles(df, "v", ["g"]).collect()}
    b = {r.g: (r.n, r.p50, r.p95) for r in df.groupBy("g").agg(F.count("v").alias("n"), F.percentile("v", 0.5).alias("p50"), F.percentile("v", 0.95).alias("p95")).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    assert E.percentiles(df.limit(0), "v", ["g"]).count() == 0
