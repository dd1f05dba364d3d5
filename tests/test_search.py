import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions.vectors import Metric
from quillon.operators.knn import check_ef, knn, knn_batch, knn_per_group, post_filter
from quillon.sources.tables import generated_vectors

# The public walkthrough's corpus, (id, name, category, price, text, vector).
PRODUCTS = [
    (1, "Studio Wireless Headphones", 1, 89.99, "Closed-back wireless headphones tuned for focused studio listening at a desk.", [0.9, 0.3, 0.0, 0.0, 0.0, 0.6, 0.0, 0.7]),
    (2, "Reference Studio Monitors", 1, 149.0, "Over-ear studio monitors with a flat response and Bluetooth for critical desk mixing.", [0.95, 0.1, 0.0, 0.0, 0.0, 0.6, 0.0, 0.5]),
    (3, "Sport Wireless Earbuds", 1, 59.99, "Sweatproof wireless earbuds that stay put during runs and gym workouts.", [0.7, 0.8, 0.1, 0.5, 0.0, 0.0, 0.8, 0.7]),
    (4, "Noise-Cancelling Earbuds", 1, 129.0, "Active noise-cancelling earbuds with a wireless charging case for commutes.", [0.85, 0.7, 0.0, 0.0, 0.0, 0.2, 0.1, 0.8]),
    (5, "Waterproof Shower Speaker", 1, 24.99, "Compact waterproof Bluetooth speaker with a suction mount for the shower.", [0.7, 0.0, 0.3, 0.9, 0.0, 0.0, 0.0, 0.6]),
    (6, "Trail Running Vest", 2, 74.99, "Lightweight hydration vest for trail running with a weatherproof shell.", [0.0, 0.7, 0.8, 0.6, 0.0, 0.0, 0.8, 0.0]),
    (7, "Waterproof Hiking Jacket", 2, 159.0, "Breathable waterproof shell jacket for hiking in heavy rain.", [0.0, 0.6, 0.9, 0.95, 0.0, 0.0, 0.2, 0.0]),
    (8, "Rugged Wireless Headphones", 2, 45.0, "Rugged wireless headphones with a weatherproof, sweat-resistant build for the outdoors.", [0.5, 0.4, 0.8, 0.7, 0.0, 0.0, 0.3, 0.6]),
    (9, "Insulated Water Bottle", 2, 19.99, "Vacuum-insulated stainless steel water bottle that keeps drinks cold on the trail.", [0.0, 0.4, 0.7, 0.8, 0.3, 0.0, 0.5, 0.0]),
    (10, "Camping Lantern", 2, 34.99, "Rechargeable LED camping lantern with a collapsible, weather-resistant body.", [0.0, 0.1, 0.9, 0.3, 0.0, 0.1, 0.0, 0.2]),
    (11, "Chef's Knife", 3, 79.0, "Forged high-carbon chef's knife balanced for everyday kitchen prep.", [0.0, 0.0, 0.0, 0.0, 0.95, 0.1, 0.0, 0.0]),
    (12, "Espresso Machine", 3, 249.0, "Compact espresso machine with a steam wand for lattes at home.", [0.0, 0.0, 0.0, 0.2, 0.9, 0.1, 0.0, 0.1]),
    (13, "Cast-Iron Skillet", 3, 39.99, "Pre-seasoned cast-iron skillet that moves from stovetop to oven to campfire.", [0.0, 0.0, 0.2, 0.0, 0.9, 0.0, 0.0, 0.0]),
    (14, "Standing Desk", 4, 329.0, "Electric height-adjustable standing desk for a healthier home office.", [0.0, 0.0, 0.0, 0.0, 0.0, 0.95, 0.2, 0.0]),
    (15, "Ergonomic Office Chair", 4, 199.0, "Mesh-back ergonomic office chair with lumbar support for long work sessions.", [0.0, 0.2, 0.0, 0.0, 0.0, 0.9, 0.3, 0.0]),
    (16, "Wireless Mechanical Keyboard", 4, 99.0, "Low-profile wireless mechanical keyboard for a tidy desk setup.", [0.0, 0.1, 0.0, 0.0, 0.0, 0.8, 0.0, 0.7]),
]


@pytest.fixture(scope="module")
def products(spark):
    rows = [(i, n, c, p, f"{n} {t}", [float(x) for x in v]) for i, n, c, p, t, v in PRODUCTS]
    return spark.createDataFrame(rows, "id long, name string, category_id int, price double, body string, embedding array<float>").cache()


EARBUDS = [0.7, 0.8, 0, 0, 0, 0, 0.8, 0.7]


def test_walkthrough_distances(products):
    top = [(r.id, round(r.distance, 4)) for r in knn(products, EARBUDS, 5, Metric.COSINE).collect()]
    assert top == [(3, 0.053), (4, 0.1343), (1, 0.3161), (8, 0.3729), (2, 0.4097)]
    some = [(r.id, round(r.distance, 4)) for r in knn(products, EARBUDS, 5, Metric.COSINE, "category_id = 1 AND price < 100").collect()]
    assert some == [(3, 0.053), (1, 0.3161), (5, 0.5424)]


def test_walkthrough_hybrid(products):
    from quillon.operators.hybrid import hybrid_search

    out = hybrid_search(products, "id", "embedding", "body", "wireless headphones", [0, 0.7, 0.9, 0.6, 0, 0, 0.8, 0], 5, config="english", metric=Metric.COSINE)
    assert [(r.id, round(r.score, 5), r.vector_rank, r.text_rank) for r in out.collect()] == [(8, 0.03202, 4, 1), (1, 0.03002, 12, 2), (6, 0.01639, 1, None), (9, 0.01613, 2, None), (7, 0.01587, 3, None)]


def test_quickstart(spark):
    rows = spark.range(1, 5001).select("id", (F.col("id") % 10).cast("int").alias("tenant_id"), (F.col("id") % 100).cast("double").alias("price"), F.array((F.col("id") % 500).cast("float"), F.floor(F.col("id") / 500).cast("float")).alias("embedding"))
    out = knn(rows, [250.0, 10.0], 10, where="tenant_id = 7 AND price < 50").collect()
    assert len(out) == 10 and all(r.tenant_id == 7 and r.price < 50 for r in out)
    assert [r.distance for r in out] == sorted(r.distance for r in out)


def test_plan_has_no_join_and_pushes_the_filter(spark, small):
    from quillon.plans.reference import knn_filtered_eq

    plan = knn_filtered_eq(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Join" not in plan and "EqualTo(label,3)" in plan


def test_null_query_ceiling_and_ties(spark):
    rows = spark.createDataFrame([(3, [1.0]), (1, [1.0]), (2, None), (4, [5.0])], "id long, embedding array<float>")
    assert knn(rows, None, 3).count() == 0
    assert [r.id for r in knn(rows, [1.0], 10).collect()] == [1, 3, 4]
    assert knn(rows, [1.0], 10, ef=2).count() == 2
    with pytest.raises(ValueError):
        check_ef(0)


def test_batch_and_groups_agree_with_single(spark):
    rows = generated_vectors(spark, 400, 8, clusters=5).withColumn("g", F.col("id") % 3).cache()
    asked = [(int(r.id), list(map(float, r.embedding))) for r in rows.filter("id % 100 = 0").collect()]
    for metric in Metric:
        got = {}
        for r in knn_batch(spark, rows, asked, 5, metric, where="g = 1", block=2).orderBy("rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        for i, q in asked:
            assert got[i] == [r.id for r in knn(rows, q, 5, metric, "g = 1").collect()]
    q = asked[0][1]
    for g in range(3):
        assert [r.id for r in knn_per_group(rows, q, 4, "g").filter(F.col("g") == g).orderBy("rank").collect()] == [r.id for r in knn(rows, q, 4, where=f"g = {g}").collect()]
    assert post_filter(rows, q, 10, 6, "g = 1").count() <= 6


def test_generated_rows_are_repeatable(spark):
    a = generated_vectors(spark, 50, 4, seed=3).repartition(7).orderBy("id").collect()
    assert a == generated_vectors(spark, 50, 4, seed=3).orderBy("id").collect()
    assert np.abs(np.array([r.embedding for r in a])).max() <= 0.5


def test_own_metric(spark):
    from quillon.functions.vectors import register_metric

    taxi = register_metric("taxicab", lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, v: s + v))
    df = spark.createDataFrame([(1, [0.0, 3.0]), (2, [2.0, 2.0]), (3, None)], "id long, embedding array<float>")
    assert [(r.id, r.distance) for r in knn(df, [0.0, 0.0], 5, taxi).collect()] == [(1, 3.0), (2, 4.0)]
    with pytest.raises(Exception, match="dimension mismatch"):
        knn(df, [0.0], 5, taxi).collect()
