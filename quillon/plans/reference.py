"""Queries over the driver tables that exercise the engine, each with its SQL oracle.

Distances are shown to 6 decimals and ranked on 9, then on the id, in both engines.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.functions.vectors import Metric
from quillon.operators import evaluation as E
from quillon.operators import hybrid as H
from quillon.operators.fusion import ReciprocalRank
from quillon.operators.graph import Options
from quillon.operators.index import VectorIndex
from quillon.operators.knn import distance_concentration, knn, knn_batch, knn_per_group, post_filter
from quillon.operators.text import bm25, matches, parse_query, tokens, with_terms
from quillon.sources.scratch import scratch_uri
from quillon.sources.tables import table

_Q, _SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries():
    return dict(_Q)


def oracle_sql():
    return dict(_SQL)


def embeddings(spark, d):
    return table(spark, d, "embeddings")


def vector_of(spark, d, vec_id: int) -> list[float]:
    """One row's vector, as a constant of the plan."""
    row = embeddings(spark, d).filter(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row.embedding]


def search(spark, d, k, metric=Metric.L2, where=None, ef=None, vec=0, columns=("vec_id",)):
    out = knn(embeddings(spark, d), vector_of(spark, d, vec), k, metric, where, "vec_id", ef=ef)
    return out.select(*columns, F.round("distance", 6).alias("distance"))


def search_sql(k, distance="list_distance(embedding::DOUBLE[], q)", rank="power({d}, 2)", where="true", vec=0, columns="vec_id"):
    r = rank.format(d=distance)
    return f"""SELECT {columns}, round({distance}, 6) AS distance FROM embeddings, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = {vec})
        WHERE {where} ORDER BY round({r}, 9), vec_id LIMIT {k}"""


def entry(spark, d):
    """The flagship: nearest neighbours under a predicate."""
    return knn_filtered_eq(spark, d)


# --- distances ---------------------------------------------------------------------------------


def _distances(spark, d, f):
    return embeddings(spark, d).select("vec_id", F.round(f("embedding", V.vector_literal(vector_of(spark, d, 0))), 6).alias("distance"))


def _distances_sql(expression):
    return f"SELECT vec_id, round({expression}, 6) AS distance FROM embeddings, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"


@query(_distances_sql("list_distance(embedding::DOUBLE[], q)"))
def l2_distance(spark, d):
    return _distances(spark, d, V.l2_distance)


@query(_distances_sql("list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"))
def l2_squared_distance(spark, d):
    return _distances(spark, d, V.l2_squared_distance)


@query(_distances_sql("list_cosine_distance(embedding::DOUBLE[], q)"))
def cosine_distance(spark, d):
    return _distances(spark, d, V.cosine_distance)


@query(_distances_sql("list_inner_product(embedding::DOUBLE[], q)"))
def inner_product(spark, d):
    return _distances(spark, d, V.inner_product)


@query(_distances_sql("list_negative_inner_product(embedding::DOUBLE[], q)"))
def negative_inner_product(spark, d):
    return _distances(spark, d, V.negative_inner_product)


@query("SELECT vec_id, isnan(list_cosine_distance(embedding::DOUBLE[], list_transform(embedding::DOUBLE[], lambda x: 0.0::DOUBLE))) AS is_nan FROM embeddings")
def cosine_zero_vector_nan(spark, d):
    zero = F.transform("embedding", lambda x: F.lit(0.0))
    return embeddings(spark, d).select("vec_id", F.isnan(V.cosine_distance("embedding", zero)).alias("is_nan"))


@query("SELECT vec_id, len(v) AS n, round(list_sum(v), 6) AS total FROM (SELECT vec_id, ('[' || array_to_string(list_transform(embedding, lambda x: round(x::DOUBLE, 3)), ', ') || ']')::DOUBLE[] AS v FROM embeddings)")
def parse_vector_literal(spark, d):
    text = F.concat(F.lit(" [ "), F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double"), 3).cast("string")), " , "), F.lit(" ] "))
    v = V.parse_vector(text)
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.round(x.cast("double"), 3))
    return embeddings(spark, d).select("vec_id", F.size(v).cast("long").alias("n"), F.round(total, 6).alias("total"))


@query("SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 'vector must have at least one dimension' WHEN 1 THEN 'vector element 1 must be a finite number' WHEN 2 THEN 'vector element 0 must be a finite number' END AS problem FROM embeddings")
def validate_vectors(spark, d):
    broken = (
        F.when(F.col("vec_id") % 4 == 0, F.array().cast("array<float>"))
        .when(F.col("vec_id") % 4 == 1, F.array(F.lit(1.0), F.lit(float("nan"))).cast("array<float>"))
        .when(F.col("vec_id") % 4 == 2, F.array(F.lit(float("inf")), F.lit(1.0)).cast("array<float>"))
        .otherwise(F.col("embedding"))
    )
    return embeddings(spark, d).select("vec_id", V.vector_problem(broken).alias("problem"))


@query("SELECT vec_id, '[' || (vec_id % 7) || ',' || (vec_id % 4) / 4 || ',-0.5]' AS text FROM embeddings WHERE vec_id % 4 <> 0")
def format_vectors(spark, d):
    v = F.array(F.col("vec_id") % 7, (F.col("vec_id") % 4) / 4, F.lit(-0.5)).cast("array<float>")
    return embeddings(spark, d).filter("vec_id % 4 <> 0").select("vec_id", V.format_vector(v).alias("text"))


@query("SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN 'malformed vector literal: expected ''['' at the start' WHEN 1 THEN 'malformed vector literal: expected '']'' at the end' WHEN 2 THEN 'vector must have at least one dimension' WHEN 3 THEN 'vector element 1 is not a number' END AS problem FROM embeddings")
def literal_problems(spark, d):
    text = F.element_at(F.array(*[F.lit(x) for x in ("1,2]", "[1,2", "[ ]", "[1,x]", "[1,2e3]")]), (F.col("vec_id") % 5 + 1).cast("int"))
    return embeddings(spark, d).select("vec_id", V.literal_problem(text).alias("problem"))


@query("SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def cast_round_trip(spark, d):
    """An array cast to a vector, which checks it, and back."""
    v = V.to_array(V.validated(F.col("embedding").cast("array<double>")))
    return embeddings(spark, d).select("vec_id", F.size(v).cast("long").alias("n"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


# --- exact search ------------------------------------------------------------------------------


@query(search_sql(10))
def knn_l2(spark, d):
    return search(spark, d, 10)


@query(search_sql(10, "list_cosine_distance(embedding::DOUBLE[], q)", "{d}"))
def knn_cosine(spark, d):
    return search(spark, d, 10, Metric.COSINE)


@query(search_sql(10, "list_negative_inner_product(embedding::DOUBLE[], q)", "{d}"))
def knn_inner_product(spark, d):
    return search(spark, d, 10, Metric.INNER_PRODUCT)


@query(search_sql(10, where="label = 3"))
def knn_filtered_eq(spark, d):
    return search(spark, d, 10, where="label = 3")


@query(search_sql(10, where="label BETWEEN 2 AND 5"))
def knn_filtered_range(spark, d):
    return search(spark, d, 10, where=F.col("label").between(2, 5))


@query(search_sql(10, where="label >= 2 AND label < 6 AND vec_id % 3 = 1", columns="vec_id, label"))
def knn_filtered_conjunction(spark, d):
    return search(spark, d, 10, where="label >= 2 AND label < 6 AND vec_id % 3 = 1", columns=("vec_id", "label"))


@query(search_sql(10, where="label = 1 OR NOT (vec_id < 300)", columns="vec_id, label"))
def knn_filtered_disjunction(spark, d):
    return search(spark, d, 10, where="label = 1 OR NOT (vec_id < 300)", columns=("vec_id", "label"))


@query(search_sql(10, where="label = 6"))
def knn_prepared(spark, d):
    """A prepared statement: the vector and the bound are parameters of SQL text."""
    text = """SELECT vec_id, round(sqrt(r), 6) AS distance FROM (SELECT vec_id, aggregate(zip_with(embedding, :q, (x, y) -> (double(x) - y) * (double(x) - y)), 0D, (s, v) -> s + v) AS r FROM {e} WHERE label = :label)
        ORDER BY round(r, 9), vec_id LIMIT 10"""
    return spark.sql(text, args={"q": F.array(*[F.lit(x) for x in vector_of(spark, d, 0)]), "label": 6}, e=embeddings(spark, d))


@query(search_sql(64))
def knn_ef_ceiling(spark, d):
    return search(spark, d, 500, ef=64)


@query(search_sql(15, where="vec_id % 3 <> 0"))
def knn_null_vectors_omitted(spark, d):
    rows = embeddings(spark, d).withColumn("embedding", F.when(F.col("vec_id") % 3 != 0, F.col("embedding")))
    return knn(rows, vector_of(spark, d, 0), 15, id_col="vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@query("SELECT vec_id, 0.0::DOUBLE AS distance FROM embeddings WHERE false")
def knn_null_query(spark, d):
    return knn(embeddings(spark, d), None, 10, id_col="vec_id").select("vec_id", "distance")


@query("""SELECT query_id, rank, id, round(dist, 6) AS distance FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY round(power(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2), 9), b.vec_id) AS rank
    FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND b.label <= 4) WHERE rank <= 10""")
def knn_batch_filtered(spark, d):
    return knn_batch(spark, embeddings(spark, d), _asked(spark, d), 10, where="label <= 4", id_col="vec_id").withColumn("distance", F.round("distance", 6))


@query("""SELECT label, rank, vec_id, round(dist, 6) AS distance FROM (SELECT label, vec_id, list_distance(embedding::DOUBLE[], q) AS dist,
    row_number() OVER (PARTITION BY label ORDER BY round(power(list_distance(embedding::DOUBLE[], q), 2), 9), vec_id) AS rank
    FROM embeddings, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)) WHERE rank <= 3""")
def knn_grouped(spark, d):
    out = knn_per_group(embeddings(spark, d), vector_of(spark, d, 0), 3, "label", id_col="vec_id")
    return out.select("label", "rank", "vec_id", F.round("distance", 6).alias("distance"))


@query("""SELECT d.doc_id, d.lang, k.distance FROM (""" + search_sql(10, where="label = 3") + """) k JOIN documents d ON d.doc_id = k.vec_id""")
def knn_joined_to_rows(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return docs.join(F.broadcast(search(spark, d, 10, where="label = 3")), F.col("doc_id") == F.col("vec_id")).select("doc_id", "lang", "distance")  # ten rows


@query("SELECT doc_id FROM documents WHERE lang = 'en'")
def filter_scan_keeps_null_vectors(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(embeddings(spark, d).select("vec_id", "embedding"), F.col("doc_id") == F.col("vec_id"), "left")
    return rows.filter("lang = 'en'").select("doc_id")


_NAN = "CASE WHEN vec_id % 20 = 0 THEN 'nan'::DOUBLE ELSE (vec_id % 100)::DOUBLE END"


@query(f"SELECT vec_id FROM (SELECT vec_id, {_NAN} AS score FROM embeddings) WHERE score >= 90 AND NOT (score < 95) OR score = 'nan'::DOUBLE")
def filter_nan_total_order(spark, d):
    rows = embeddings(spark, d).select("vec_id", F.when(F.col("vec_id") % 20 == 0, F.lit(float("nan"))).otherwise((F.col("vec_id") % 100).cast("double")).alias("score"))
    return rows.filter((F.col("score") >= 90) & ~(F.col("score") < 95) | (F.col("score") == float("nan"))).select("vec_id")


@query("SELECT vec_id FROM embeddings WHERE (vec_id % 300)::SMALLINT = 7::BIGINT OR (vec_id % 500)::BIGINT = 9::SMALLINT OR (vec_id % 100)::FLOAT = 50::DOUBLE OR (vec_id / 10)::FLOAT = 0.1::DOUBLE")
def filter_cross_width(spark, d):
    return embeddings(spark, d).filter("cast(vec_id % 300 as smallint) = 7L OR vec_id % 500 = 9S OR cast(vec_id % 100 as float) = 50D OR cast(vec_id / 10 as float) = 0.1D").select("vec_id")


@query("SELECT vec_id FROM embeddings WHERE label IN (1, 4) AND label NOT IN (4) AND label IS DISTINCT FROM 2 AND CAST(vec_id AS VARCHAR) LIKE '%1'")
def filter_predicates(spark, d):
    label = F.col("label")
    return embeddings(spark, d).filter(label.isin(1, 4) & ~label.isin(4) & ~label.eqNullSafe(2) & F.col("vec_id").cast("string").like("%1")).select("vec_id")


@query("SELECT vec_id FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM embeddings f WHERE f.vec_id = e.vec_id AND f.label >= 3)")
def anti_join_negation(spark, d):
    e = embeddings(spark, d).select("vec_id", "label")
    return e.join(e.filter("label >= 3").select("vec_id"), "vec_id", "left_anti").select("vec_id")


@query("SELECT vec_id FROM embeddings WHERE label = (SELECT max(label) FROM embeddings WHERE label < 0) OR label >= (SELECT min(label) FROM embeddings WHERE label < 0)")
def filter_null_bound(spark, d):
    """Bounds that turn out to be null at run time match nothing."""
    e = embeddings(spark, d)
    bounds = e.filter("label < 0").agg(F.max("label").alias("high"), F.min("label").alias("low"))  # one row
    return e.crossJoin(F.broadcast(bounds)).filter("label = high or label >= low").select("vec_id")


_NOT_IN = "SELECT vec_id, {kind} AS kind FROM (SELECT vec_id, CASE WHEN label <> 5 THEN label END AS label FROM embeddings) WHERE label NOT IN (SELECT {value} FROM embeddings WHERE {where})"


@query(" UNION ALL ".join(_NOT_IN.format(kind=k, value=v, where=w) for k, (v, w) in enumerate((("CASE WHEN vec_id % 3 = 0 THEN label END", "label < 3"), ("label", "label < 3"), ("label", "label < 0")))))
def not_in_with_nulls(spark, d):
    """A null among the values, none among them, and no values."""
    e = embeddings(spark, d)
    left = e.select("vec_id", F.expr("case when label <> 5 then label end").alias("label"))
    arms = (e.filter("label < 3").select(F.expr("case when vec_id % 3 = 0 then label end").alias("v")), e.filter("label < 3").select(F.col("label").alias("v")), e.filter("label < 0").select(F.col("label").alias("v")))
    out = None
    for k, values in enumerate(arms):
        part = E.not_in(left, "label", values, "v").select("vec_id", F.lit(k).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT count(*) AS n FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE label = 2)")
def semi_join_count(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return docs.join(embeddings(spark, d).filter("label = 2"), F.col("doc_id") == F.col("vec_id"), "left_semi").agg(F.count("*").alias("n"))


@query("SELECT * FROM (SELECT vec_id, distance FROM (" + search_sql(64, columns="vec_id, label") + ") t WHERE label = 3 ORDER BY distance, vec_id LIMIT 10)")
def post_filter_baseline(spark, d):
    out = post_filter(embeddings(spark, d), vector_of(spark, d, 0), 10, 64, "label = 3", id_col="vec_id")
    return out.select("vec_id", F.round("distance", 6).alias("distance"))


# --- evaluation --------------------------------------------------------------------------------

def _hash():
    return (F.col("vec_id") * 2654435761) % 4294967296


@query("SELECT vec_id, ntile(100) OVER (ORDER BY (vec_id * 2654435761) % 4294967296, vec_id)::INTEGER AS label FROM embeddings")
def selectivity_labels(spark, d):
    return E.ntile_labels(embeddings(spark, d).select("vec_id"), [_hash(), F.col("vec_id")])


@query("SELECT vec_id, ntile(7) OVER (ORDER BY (vec_id * 2654435761) % 4294967296, vec_id)::INTEGER AS label FROM embeddings")
def selectivity_labels_scaled(spark, d):
    return E.ntile_labels(embeddings(spark, d).select("vec_id"), [_hash(), F.col("vec_id")], 7)


_TRUTH = """SELECT a.vec_id AS query_id, b.vec_id AS id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(power(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2), 9), b.vec_id) AS rank
    FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0"""


def _asked(spark, d):
    """The query set: a table."""
    return embeddings(spark, d).filter("vec_id % 50 = 0").select("vec_id", "embedding")


@query(f"SELECT query_id, array_to_string(list(id ORDER BY rank), ',') AS ids FROM ({_TRUTH}) WHERE rank <= 10 GROUP BY query_id")
def exact_truth_table(spark, d):
    t = E.truth_table(knn_batch(spark, embeddings(spark, d), _asked(spark, d), 10, id_col="vec_id"))
    return t.select("query_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


def _recall(spark, d):
    near = knn_batch(spark, embeddings(spark, d), _asked(spark, d), 40, id_col="vec_id").join(embeddings(spark, d).select(F.col("vec_id").alias("id"), "label"), "id")
    found = near.filter("label <= 4").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter("rank <= 10")
    truth = knn_batch(spark, embeddings(spark, d), _asked(spark, d), 10, where="label <= 4", id_col="vec_id")
    return E.recall(E.truth_table(found), E.truth_table(truth))


_RECALL = f"""WITH t AS ({_TRUTH}), truth AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM t WHERE label <= 4) WHERE r <= 10),
    found AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM t WHERE rank <= 40 AND label <= 4) WHERE r <= 10),
    r AS (SELECT t.query_id, count(f.id) AS hits, count(*) AS k, count(f.id) / count(*) AS recall FROM truth t LEFT JOIN found f ON f.query_id = t.query_id AND f.id = t.id GROUP BY t.query_id)"""


@query(_RECALL + " SELECT query_id, hits, k, round(recall, 6) AS recall FROM r")
def recall_report(spark, d):
    return _recall(spark, d).withColumn("recall", F.round("recall", 6))


@query("SELECT label, avg(v) FILTER (WHERE arm = 0) AS arm_0, avg(v) FILTER (WHERE arm = 1) AS arm_1 FROM (SELECT label, vec_id % 2 AS arm, (vec_id % 10)::DOUBLE AS v FROM embeddings) GROUP BY label")
def recall_pivot(spark, d):
    rows = embeddings(spark, d).select("label", (F.col("vec_id") % 2).alias("arm"), (F.col("vec_id") % 10).cast("double").alias("v"))
    return E.pivot_mean(rows, "label", "arm", [0, 1], "v", "arm_")


@query("SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    out = E.percentiles(table(spark, d, "events"), "value", ["event_type"])
    return out.withColumns({c: F.round(c, 6) for c in ("p50", "p95", "mean")})


@query("""WITH r AS (SELECT dist, row_number() OVER (ORDER BY round(dist, 9), vec_id) AS r FROM (SELECT vec_id, list_distance(embedding::DOUBLE[], q) AS dist FROM embeddings, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)))
    SELECT round(a, 6) AS near_distance, round(b, 6) AS far_distance, round(b / a, 6) AS ratio FROM (SELECT max(dist) FILTER (WHERE r = 2) AS a, max(dist) FILTER (WHERE r = 400) AS b FROM r)""")
def concentration(spark, d):
    out = distance_concentration(embeddings(spark, d), vector_of(spark, d, 0), 2, 400, id_col="vec_id")
    return out.select(*[F.round(c, 6).alias(c) for c in ("near_distance", "far_distance", "ratio")])


@query("""WITH t AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY ALL), b AS (SELECT min(event_type) AS base FROM events)
    SELECT a.event_type, count(*) AS n, round(avg(a.v - c.v), 6) AS mean_delta FROM t a JOIN t c ON a.user_id = c.user_id, b WHERE c.event_type = b.base AND a.event_type <> b.base GROUP BY a.event_type""")
def paired_delta(spark, d):
    t = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    base = table(spark, d, "events").agg(F.min("event_type")).first()[0]
    return E.paired_delta(t, "user_id", "event_type", "v", base).withColumn("mean_delta", F.round("mean_delta", 6))


@query("SELECT true AS ordered")
def distances_in_order(spark, d):
    return E.in_order(search(spark, d, 50), "distance", [F.col("distance"), F.col("vec_id")])


@query("""SELECT label, count(*) AS n, count(DISTINCT vec_id % 7) AS kinds, string_agg(DISTINCT (vec_id % 7)::VARCHAR, ',' ORDER BY (vec_id % 7)::VARCHAR) AS names, min(vec_id) AS least, max(vec_id) AS most
    FROM embeddings GROUP BY label HAVING count(*) > 3 UNION ALL SELECT -1, (SELECT count(*) FROM embeddings), 0, '', 0, 0""")
def grouped_summary(spark, d):
    e = embeddings(spark, d)
    seven = F.col("vec_id") % 7
    groups = e.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct(seven).alias("kinds"), F.array_join(F.array_sort(F.collect_set(seven.cast("string"))), ",").alias("names"), F.min("vec_id").alias("least"), F.max("vec_id").alias("most")).filter("n > 3")
    total = e.agg(F.lit(-1).alias("label"), F.count("*").alias("n"), F.lit(0).cast("long").alias("kinds"), F.lit("").alias("names"), F.lit(0).cast("long").alias("least"), F.lit(0).cast("long").alias("most"))
    return groups.unionByName(total)


@query("SELECT e.vec_id, coalesce(l.quality, -1) AS quality FROM embeddings e LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = e.vec_id")
def label_backfill(spark, d):
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return embeddings(spark, d).join(labels, F.col("doc_id") == F.col("vec_id"), "left").select("vec_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("SELECT vec_id, i::INTEGER AS place, round(embedding[i]::DOUBLE, 6) AS value FROM embeddings, (SELECT unnest([1, 2, 3]) AS i) WHERE label = 1")
def unnest_with_ordinality(spark, d):
    rows = embeddings(spark, d).filter("label = 1").select("vec_id", F.posexplode(F.slice("embedding", 1, 3)).alias("p", "v"))
    return rows.select("vec_id", (F.col("p") + 1).alias("place"), F.round(F.col("v").cast("double"), 6).alias("value"))


@query("WITH sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT label, n FROM sizes WHERE n >= (SELECT avg(n) FROM sizes)")
def common_table_and_scalar(spark, d):
    """A common table expression read twice, once as a scalar."""
    sizes = embeddings(spark, d).groupBy("label").agg(F.count("*").alias("n"))
    return sizes.crossJoin(F.broadcast(sizes.agg(F.avg("n").alias("mean")))).filter("n >= mean").select("label", "n")  # one row


# --- fusion and hybrid -------------------------------------------------------------------------

_LISTS = "(SELECT 0 AS list_id, vec_id AS id, row_number() OVER (ORDER BY (vec_id * 7919) % 1009, vec_id) AS rank FROM embeddings UNION ALL SELECT 1, vec_id, row_number() OVER (ORDER BY (vec_id * 104729) % 1013, vec_id) FROM embeddings WHERE label <= 4)"


def _lists(spark, d):
    e = embeddings(spark, d)
    one = E.ranked(e.select("vec_id"), [(F.col("vec_id") * 7919) % 1009, F.col("vec_id")])
    two = E.ranked(e.filter("label <= 4").select("vec_id"), [(F.col("vec_id") * 104729) % 1013, F.col("vec_id")])
    return one.select(F.lit(0).alias("list_id"), F.col("vec_id").alias("id"), "rank").unionByName(two.select(F.lit(1).alias("list_id"), F.col("vec_id").alias("id"), "rank"))


@query(f"SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM {_LISTS} GROUP BY id ORDER BY round(sum(1.0::DOUBLE / (60 + rank)), 12) DESC, id LIMIT 20")
def rrf_fuse(spark, d):
    return ReciprocalRank(60).top(_lists(spark, d), 20).select("id", F.round("score", 9).alias("score"))


@query(f"SELECT id, round(sum(1.0::DOUBLE / (0 + rank)), 9) AS score FROM (SELECT list_id, id % 50 AS id, min(rank) AS rank FROM {_LISTS} GROUP BY ALL) GROUP BY id")
def rrf_duplicates(spark, d):
    return ReciprocalRank(0).fuse(_lists(spark, d).withColumn("id", F.col("id") % 50)).select("id", F.round("score", 9).alias("score"))


@query(f"SELECT id, round(sum(1.0::DOUBLE / (0 + rank)), 9) AS score FROM (SELECT list_id, CASE WHEN id % 2 = 0 THEN id ELSE -id END AS id, rank // 2 + 1 AS rank FROM {_LISTS}) GROUP BY id ORDER BY round(sum(1.0::DOUBLE / (0 + rank)), 12) DESC, id LIMIT 40")
def rrf_signed_ids(spark, d):
    """Pairs of equal ranks, so that ties go by the signed id."""
    signed = _lists(spark, d).withColumn("id", F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(-F.col("id"))).withColumn("rank", F.expr("rank div 2 + 1"))
    return ReciprocalRank(0).top(signed, 40).select("id", F.round("score", 9).alias("score"))


_WORDS = ("the", "of", "and")
_TERMS = "(SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents)"
_BM25 = (
    f"SELECT doc_id AS id, " + " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * size / mean))" for i in range(3)) + " AS score FROM (SELECT doc_id, len(w) AS size, "
    + ", ".join(f"len(list_filter(w, lambda x: x = '{w}'))::DOUBLE AS tf{i}" for i, w in enumerate(_WORDS)) + f" FROM {_TERMS}), (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS mean, "
    + ", ".join(f"sum(list_contains(w, '{w}')::INT)::DOUBLE AS df{i}" for i, w in enumerate(_WORDS)) + f" FROM {_TERMS}) WHERE tf0 > 0 AND tf1 > 0 AND tf2 > 0"
)


@query(f"SELECT id, round(score, 6) AS score FROM ({_BM25})")
def lexical_rank(spark, d):
    terms = with_terms(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "text", "terms").drop("text")
    return bm25(terms, parse_query("the of and"), "terms").select("id", F.round("score", 6).alias("score"))


@query("SELECT doc_id FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents) WHERE (list_contains(w, 'the') AND NOT list_contains(w, 'of')) OR (' ' || array_to_string(w, ' ') || ' ') LIKE '% of the %'")
def web_query_match(spark, d):
    terms = with_terms(table(spark, d, "documents").select("doc_id", "text"), "text", "terms")
    return terms.filter(matches(parse_query('the -of OR "of the"'), F.col("terms"))).select("doc_id")


def _pairs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text").join(embeddings(spark, d).select("vec_id", "embedding"), F.col("doc_id") == F.col("vec_id"), "left")


def _hybrid(spark, d, text, k=10, n=None):
    out = H.hybrid_search(_pairs(spark, d), "doc_id", "embedding", "text", text, vector_of(spark, d, 7), k, n)
    return out.select("id", F.round("score", 9).alias("score"), "vector_rank", "text_rank")


def _hybrid_sql(k, vector_depth, text_depth, text=True):
    t = f"SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM ({_BM25})" if text else "SELECT 0::BIGINT AS id, 0::BIGINT AS rank WHERE false"
    return f"""WITH v AS (SELECT * FROM (SELECT doc_id AS id, row_number() OVER (ORDER BY round(list_distance(embedding::DOUBLE[], q), 9), doc_id) AS rank FROM documents JOIN embeddings ON vec_id = doc_id, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7)) WHERE rank <= {vector_depth}),
        t AS (SELECT * FROM ({t}) WHERE rank <= {text_depth})
        SELECT id, round(s, 9) AS score, vector_rank, text_rank FROM (SELECT coalesce(v.id, t.id) AS id, coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + t.rank), 0) AS s, v.rank::INTEGER AS vector_rank, t.rank::INTEGER AS text_rank FROM v FULL OUTER JOIN t ON v.id = t.id)
        ORDER BY round(s, 12) DESC, id LIMIT {k}"""


@query(_hybrid_sql(10, 40, 40))
def hybrid_search(spark, d):
    return _hybrid(spark, d, "the of and")


@query(_hybrid_sql(10, 40, 40, text=False))
def hybrid_vector_only(spark, d):
    return _hybrid(spark, d, "   ")


@query(_hybrid_sql(30, 5, 5))
def hybrid_text_only_ranks(spark, d):
    return _hybrid(spark, d, "the of and", 30, 5)


# --- index -------------------------------------------------------------------------------------


def _index(spark, d, **more):
    return VectorIndex.build(spark, embeddings(spark, d), scratch_uri(spark, "index"), "vec_id", attributes=["label"], shards=2, **more)


def _top(spark, d, found, columns=("vec_id",)):
    """An index's answer in the shape of the exact search: its own distances are sums in single precision."""
    return found.select(F.col("id").alias("vec_id"), F.round("distance", 4).alias("distance"))


@query(search_sql(10, where="vec_id % 2 = 1").replace("round(list_distance(embedding::DOUBLE[], q), 6) AS", "round(list_distance(embedding::DOUBLE[], q), 4) AS"))
def tombstoned_search(spark, d):
    """Half of the rows deleted; the shards' live rows are scored whole, so the answer is exact."""
    index = _index(spark, d, options=Options(m=8, ef_construction=32)).delete(embeddings(spark, d).filter("vec_id % 2 = 0").select("vec_id"))
    return _top(spark, d, index.search(vector_of(spark, d, 0), 10, scan_below=1 << 30))


@query(search_sql(10, where="label <= 4").replace("round(list_distance(embedding::DOUBLE[], q), 6) AS", "round(list_distance(embedding::DOUBLE[], q), 4) AS"))
def partial_index_search(spark, d):
    """An index of the rows that pass a predicate, scored whole."""
    return _top(spark, d, _index(spark, d, where="label <= 4").search(vector_of(spark, d, 0), 10, scan_below=1 << 30))


@query("SELECT vec_id AS id, label FROM embeddings WHERE label = 3")
def index_unordered_scan(spark, d):
    return _index(spark, d).scan("label = 3")


@query("SELECT vec_id AS id, label FROM embeddings WHERE label = 3 AND vec_id % 5 <> 0 UNION ALL SELECT vec_id + 100000, label FROM embeddings WHERE vec_id < 20 AND label = 3 UNION ALL SELECT vec_id + 200000, label FROM embeddings WHERE vec_id < 40 AND label = 3")
def index_lifecycle(spark, d):
    """Insert, delete, compact, insert from an older generation, reopen, then an unordered scan."""
    e = embeddings(spark, d)
    shifted = lambda most, by: e.filter(F.col("vec_id") < most).withColumn("vec_id", F.col("vec_id") + by)
    index = _index(spark, d).insert(shifted(20, 100000)).delete(e.filter("vec_id % 5 = 0").select("vec_id"))
    index.compact()
    index.insert(shifted(40, 200000))
    return VectorIndex.open(spark, index.uri).scan("label = 3")


@query("SELECT vec_id AS id, label, 0 AS step FROM embeddings WHERE label <> 2 UNION ALL SELECT vec_id, label, 1 FROM embeddings WHERE label < 5")
def index_vacuum_and_reindex(spark, d):
    """Rows that the source lost go by a vacuum, after a compaction; a reindex then reads another state of the source."""
    e = embeddings(spark, d)
    index = _index(spark, d).compact().vacuum(e.filter("label <> 2"))
    return index.scan().withColumn("step", F.lit(0)).unionByName(index.reindex(e.filter("label < 5")).scan().withColumn("step", F.lit(1)))


def _judged(spark, d, found, truth, violations):
    """One row: how many queries and rows, what breaks the contract of a search, and whether recall reaches 0.9."""
    lag = F.lag("distance").over(Window.partitionBy("query_id").orderBy("rank"))
    rows = found.withColumn("_falls", F.coalesce(F.col("distance") < lag - 1e-6, F.lit(False))).join(embeddings(spark, d).select(F.col("vec_id").alias("id"), "label"), "id")
    hits = truth.select("query_id", "id").join(found.select("query_id", "id"), ["query_id", "id"], "left_semi")
    figures = rows.agg(
        F.countDistinct("query_id").alias("queries"), F.count("*").alias("n"), (F.count("*") - F.countDistinct("query_id", "id")).alias("repeated"), F.sum(F.expr(violations).cast("long")).alias("violations"), F.sum(F.col("_falls").cast("long")).alias("falls"),
        F.sum(F.when(F.col("rank") > 10, 1).otherwise(0)).alias("beyond"),
    )
    return figures.crossJoin(hits.agg(F.count("*").alias("_hits"))).crossJoin(truth.agg(F.count("*").alias("_all"))).select("queries", "n", "repeated", "violations", "falls", "beyond", (F.col("_hits") >= 0.9 * F.col("_all")).alias("recalled"))


_JUDGED = "SELECT count(*) AS queries, 10 * count(*) AS n, 0::BIGINT AS repeated, 0::BIGINT AS violations, 0::BIGINT AS falls, 0::BIGINT AS beyond, true AS recalled FROM embeddings WHERE vec_id % 50 = 0"


def _walked(spark, d, where, violations):
    """All queries by walks through the graphs, never by scoring a shard whole, against the exact answers."""
    found = _index(spark, d).search_batch(_asked(spark, d), 10, where=where, scan_below=0, with_cost=True)
    return _judged(spark, d, found, knn_batch(spark, embeddings(spark, d), _asked(spark, d), 10, where=where, id_col="vec_id"), violations)


@query(_JUDGED)
def ann_search(spark, d):
    return _walked(spark, d, None, "expansions = 0")


@query(_JUDGED)
def ann_filtered(spark, d):
    """One label of ten: the walk has to cross what does not match."""
    return _walked(spark, d, "label = 3", "label <> 3 or expansions = 0 or expansions > 16 * 64 + 64")


@query(_JUDGED)
def ann_batch(spark, d):
    return _walked(spark, d, "label <= 4", "label > 4 or expansions = 0 or expansions > 16 * 64 + 64")
