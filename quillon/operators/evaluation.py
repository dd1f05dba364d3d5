"""Measuring searches: labels, truth tables, recall, latency and cost summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.scratch import scratch_uri


def ranked(df: DataFrame, order: list[Column], by: tuple = (), name: str = "rank", total: str | None = None) -> DataFrame:
    """1-based positions in the given order, within groups or over the whole table, without sorting a group in one task.

    Rows are range-partitioned by group and order and written, so that every later step sees the same partitions; each numbers its own
    rows, and the counts of the partitions before it (a row a partition and group) give where its numbers start.
    """
    spark, by = df.sparkSession, list(by)
    uri = scratch_uri(spark, "ranges")
    parts = df.withColumn("_tie", F.monotonically_increasing_id())  # equal rows are parted too
    parts = parts.repartitionByRange(*by, *order, "_tie").withColumn("_p", F.spark_partition_id())
    parts.write.parquet(uri)
    parts = spark.read.schema(parts.schema).parquet(uri)
    sizes = parts.groupBy("_p", *by).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if total:
        starts = starts.withColumn(total, F.sum("_n").over(Window.partitionBy(*by)))
    own = F.row_number().over(Window.partitionBy("_p", *by).orderBy(*order, "_tie"))
    numbered = parts.withColumn("_r", own)
    starts = starts.select(*[F.col(c).alias(f"_s{c}") for c in ("_p", *by)], "_before", *([total] if total else []))
    test = F.col("_p") == F.col("_s_p")
    for c in by:
        test = test & F.col(c).eqNullSafe(F.col(f"_s{c}"))
    out = numbered.join(starts if by else F.broadcast(starts), test)  # without groups a row a partition
    return out.withColumn(name, F.col("_r") + F.col("_before")).drop("_p", "_r", "_before", "_tie", *[f"_s{c}" for c in ("_p", *by)])


def ntile_labels(df: DataFrame, order: list[Column], tiles: int = 100, name: str = "label") -> DataFrame:
    """1-based equal shares in the given order, the first ones larger by one row where it does not come out even."""
    row = ranked(df, order, name="_i", total="_total")
    i, big, size = F.col("_i") - 1, F.col("_total") % tiles, F.floor(F.col("_total") / tiles)
    label = F.when(i < big * (size + 1), F.floor(i / (size + 1))).otherwise(big + F.floor((i - big * (size + 1)) / F.greatest(size, F.lit(1))))
    return row.withColumn(name, (label + 1).cast("int")).drop("_i", "_total")


def truth_table(ranked: DataFrame) -> DataFrame:
    """(query_id, ids): the ids of each query in rank order."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "id")))
    return ranked.groupBy("query_id").agg(F.transform(ordered, lambda x: x["id"]).alias("ids"))


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, hits, k, recall) from two tables of (query_id, ids)."""
    both = truth.select("query_id", F.col("ids").alias("_truth")).join(found.select("query_id", F.col("ids").alias("_found")), "query_id", "left")
    hits = F.size(F.array_intersect(F.coalesce("_found", F.array().cast("array<bigint>")), "_truth"))
    return both.select("query_id", hits.cast("long").alias("hits"), F.size("_truth").cast("long").alias("k"), (hits / F.size("_truth")).alias("recall"))


def percentiles(df: DataFrame, value: str, by: list[str], shares: tuple = (0.5, 0.95)) -> DataFrame:
    """count, exact p50, p95, min, max and mean of a column by groups, interpolated between neighbours; nulls do not count.

    Positions come from range partitions, so a group of any size needs no buffer of its values: only the two rows beside each
    position are left when the groups come together.
    """
    rows = ranked(df.select(*by, F.col(value).alias("_v")).filter("_v is not null"), [F.col("_v")], tuple(by), "_i", "_total")
    out = []
    for q in shares:
        at = F.lit(q) * (F.col("_total") - 1) + 1
        near = F.greatest(F.lit(0.0), 1 - F.abs(F.col("_i") - at))  # its weight; 0 for all rows but the two beside the position
        out.append(F.sum(F.when(near > 0, near * F.col("_v"))).alias(f"p{round(100 * q)}"))
    n, least, most, mean = F.count("_v").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"), F.avg("_v").alias("mean")
    found = rows.groupBy(*by).agg(n, *out, least, most, mean)
    empty = df.select(*by).distinct().withColumnsRenamed({c: f"_g{c}" for c in by})  # groups with nulls only
    test = F.lit(True)
    for c in by:
        test = test & F.col(c).eqNullSafe(F.col(f"_g{c}"))
    return empty.join(found, test, "left").select(*[F.col(f"_g{c}").alias(c) for c in by], F.coalesce("n", F.lit(0)).alias("n"), *[f"p{round(100 * q)}" for q in shares], "least", "most", "mean")


def not_in(df: DataFrame, column: str, values: DataFrame, value: str) -> DataFrame:
    """Rows whose column is NOT IN the values, with SQL's nulls: one null among the values leaves no row, and a null column is
    kept only where there are no values at all. An anti-join by key and one row of figures, whatever the size of either side."""
    figures = values.agg(F.count("*").alias("_all"), F.count(value).alias("_some"))
    left = df.join(values.filter(F.col(value).isNotNull()).select(F.col(value).alias("_v")).distinct(), F.col(column) == F.col("_v"), "left_anti")
    kept = (F.col("_all") == 0) | (F.col("_all") == F.col("_some")) & F.col(column).isNotNull()
    return left.crossJoin(F.broadcast(figures)).filter(kept).drop("_all", "_some")  # one row


def paired_delta(df: DataFrame, unit: str, arm: str, value: str, base) -> DataFrame:
    """(arm, n, mean_delta): each arm against the base arm on the same units: a self-join."""
    a, b = df.alias("a"), df.filter(F.col(arm) == base).alias("b")
    both = a.join(b, F.col(f"a.{unit}") == F.col(f"b.{unit}")).filter(F.col(f"a.{arm}") != base)
    return both.groupBy(F.col(f"a.{arm}").alias(arm)).agg(F.count("*").alias("n"), F.avg(F.col(f"a.{value}") - F.col(f"b.{value}")).alias("mean_delta"))


def pivot_mean(df: DataFrame, row: str, column: str, columns: list, value: str, prefix: str = "") -> DataFrame:
    """Means of a value, a column for each listed arm."""
    return df.groupBy(row).agg(*[F.avg(F.when(F.col(column) == c, F.col(value))).alias(f"{prefix}{c}") for c in columns])


def in_order(df: DataFrame, distance: str, order: list[Column]) -> DataFrame:
    """(ordered): whether the distances never fall along the order."""
    w = Window.orderBy(*order)
    step = df.select((F.col(distance) >= F.lag(distance).over(w)).alias("up"))
    return step.agg(F.bool_and(F.coalesce("up", F.lit(True))).alias("ordered"))
