"""Exact nearest neighbours: one query, many queries, per group; the filter always comes before the ranking."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.vectors import RANKING, Metric, shown, vector_literal
from quillon.sources.scratch import scratch_uri

DEFAULT_EF, MAX_EF = 64, 10_000
#: Query vectors, and their bytes, that one pass over the table serves: bounds of what is broadcast.
QUERY_BLOCK, QUERY_BYTES = 4096, 1 << 25


def check_ef(ef: int) -> int:
    if not 1 <= ef <= MAX_EF:
        raise ValueError(f"ef_search must be between 1 and {MAX_EF}, got {ef}")
    return ef


def knn(df: DataFrame, query, k: int | None, metric: Metric = Metric.L2, where: Column | str | None = None, id_col: str = "id", vector_col: str = "embedding", ef: int | None = None) -> DataFrame:
    """The k rows nearest to a query vector among those that match, nearest first, with ``distance``.

    ``ef`` bounds the rows as an index scan's budget does; without it all k are given. A null query gives no
    rows; a null vector is never ranked; ties go to the least id. The plan is a pushed-down filter and a bounded
    top-k: no join and no full sort.
    """
    rows = df if where is None else df.filter(where)
    if query is None:
        return rows.limit(0).withColumn("distance", F.lit(None).cast("double"))
    n = k if ef is None else min(k if k is not None else check_ef(ef), check_ef(ef))
    ranked = rows.filter(F.col(vector_col).isNotNull()).withColumn("_rank", RANKING[metric](F.col(vector_col), vector_literal(query)))
    order = [F.round("_rank", 9).asc_nulls_last(), F.col(id_col).asc()]
    top = ranked.orderBy(*order) if n is None else ranked.orderBy(*order).limit(n)
    return top.withColumn("distance", shown(metric, F.col("_rank"))).drop("_rank")


def post_filter(df: DataFrame, query, k: int, ef: int, where, metric: Metric = Metric.L2, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The baseline that filters after the search: of the ef nearest rows those that match, k at most; it may come short."""
    return knn(df, query, ef, metric, None, id_col, vector_col).filter(where).orderBy(F.round("distance", 9), id_col).limit(k)


@dataclass
class _Top:
    """The k nearest rows of a partition for every query, kept while batches stream by."""

    k: int
    metric: Metric
    queries: np.ndarray

    def ranks(self, x: np.ndarray) -> np.ndarray:
        q = self.queries
        dot = q @ x.T
        if self.metric is Metric.INNER_PRODUCT:
            return -dot
        qq, xx = (q * q).sum(1), (x * x).sum(1)
        if self.metric is Metric.L2:
            return np.maximum(qq[:, None] + xx[None, :] - 2 * dot, 0)
        norm = np.sqrt(qq[:, None] * xx[None, :])
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(norm == 0, np.nan, 1 - dot / norm)

    def slack(self, x: np.ndarray) -> np.ndarray:
        """A bound of how far ``ranks`` may be off, from the rounding of sums of products (queries, rows)."""
        q, unit = self.queries, 8 * (x.shape[1] + 8) * np.finfo(float).eps
        with np.errstate(invalid="ignore", over="ignore"):
            qq, xx = (q * q).sum(1)[:, None], (x * x).sum(1)[None, :]
            if self.metric is Metric.COSINE:
                return np.broadcast_to(unit, (len(q), len(x)))
            return unit * (qq + xx)

    def exact(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Rank values of rows x for one query, summed the plain way."""
        if self.metric is Metric.L2:
            return ((x - q) ** 2).sum(1)
        if self.metric is Metric.INNER_PRODUCT:
            return -(x * q).sum(1)
        norm = np.sqrt((q * q).sum() * (x * x).sum(1))
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(norm == 0, np.nan, 1 - (x * q).sum(1) / norm)


def query_blocks(spark: SparkSession, queries, block: int = QUERY_BLOCK):
    """Queries as lists [(query_id, vector)] of a bounded size, one at a time; from a list, or from a table (query_id, vector)
    that may be larger than the driver: a block is dealt by the hash of its ids."""
    if isinstance(queries, DataFrame):
        rows = queries.select(F.col(queries.columns[0]).cast("long").alias("query_id"), F.col(queries.columns[1]).cast("array<double>").alias("v")).filter("v is not null")
        size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
        each = max(1, min(block, QUERY_BYTES // (8 * (size.d or 1))))
        blocks = max(1, -(-size.n * 5 // (4 * each))) if size.n > each else 1  # a fifth more, as hashes deal unevenly
        for k in range(blocks):
            part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
            yield [(r.query_id, list(r.v)) for r in part.collect()]
        return
    each = max(1, min(block, QUERY_BYTES // (8 * max([1, *(len(v) for _, v in queries)]))))
    for at in range(0, max(1, len(queries)), each):
        yield queries[at : at + each]


def rank_partitions(spark: SparkSession, rows: DataFrame, part: list[tuple[int, list[float]]], k: int, metric: Metric) -> DataFrame:
    """(query_id, id, _rank): each partition's k nearest of (id, v) for every query of one block.

    Rows are chosen by a product formula with a bound of its error, and then ranked by the plain sums, so the result is exact.
    """
    if not part:
        return spark.createDataFrame([], "query_id long, id long, _rank double")
    if len({len(v) for _, v in part}) > 1:
        raise ValueError("query vectors have different dimensions")
    sent = spark.sparkContext.broadcast((np.array([i for i, _ in part], np.int64), np.array([v for _, v in part], float).reshape(len(part), -1)))

    def run(batches):
        names, q = sent.value
        top = _Top(k, metric, q)
        kept = [(np.empty(0), np.empty(0, np.int64)) for _ in names]
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(1)
            x = column.flatten().to_numpy().reshape(batch.num_rows, -1) if len(column.flatten()) == batch.num_rows * q.shape[1] else None
            if x is None:
                wrong = next(n for n in (len(v) for v in column.to_pylist()) if n != q.shape[1])
                raise ValueError(f"vector dimension mismatch: expected {q.shape[1]}, got {wrong}")
            ids = batch.column(0).to_numpy()
            rough, slack = np.nan_to_num(top.ranks(x), nan=np.inf, posinf=np.inf), np.nan_to_num(top.slack(x), nan=np.inf, posinf=np.inf)
            near = min(k, len(ids))
            for i in range(len(names)):
                if near < len(ids):  # what may be among the k best, or tie with the last of them at nine decimals
                    worst = np.partition(rough[i] + slack[i], near - 1)[near - 1]
                    pick = np.flatnonzero(~(rough[i] - slack[i] > worst + 2e-9))
                else:
                    pick = np.arange(len(ids))
                d = np.concatenate((kept[i][0], top.exact(q[i], x[pick])))
                who = np.concatenate((kept[i][1], ids[pick]))
                best = np.lexsort((who, np.round(d, 9)))[:k]
                kept[i] = (d[best], who[best])
        for i, (d, who) in enumerate(kept):
            if len(who):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), names[i])), pa.array(who), pa.array(d)], ["query_id", "id", "_rank"])

    return rows.mapInArrow(run, "query_id long, id long, _rank double")


def knn_batch(spark: SparkSession, df: DataFrame, queries, k: int, metric: Metric = Metric.L2, where=None, id_col: str = "id", vector_col: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest rows of each of many queries, a list or a table (query_id, vector).

    Each partition keeps its own k best for every query (numpy on Arrow batches), so the shuffle carries k rows a query and
    partition, however large the table is. Queries go out in blocks of a fixed size, one pass each; with several blocks each one's
    answers are written before the next is read, so neither driver nor executors hold more than one.
    """
    rows = (df if where is None else df.filter(where)).filter(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    by_query = Window.partitionBy("query_id").orderBy(F.round("_rank", 9).asc_nulls_last(), F.col("id"))
    waiting, out = None, None

    def best(part):
        return rank_partitions(spark, rows, part, k, metric).withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)

    for part in query_blocks(spark, queries, block):
        if waiting is not None:
            uri = scratch_uri(spark, "neighbours")
            waiting.write.parquet(uri)
            done = spark.read.schema(waiting.schema).parquet(uri)
            out = done if out is None else out.union(done)
        waiting = best(part)
    out = waiting if out is None else out.union(waiting)
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "id", shown(metric, F.col("_rank")).alias("distance"))


def knn_per_group(df: DataFrame, query, k: int, group_col: str, metric: Metric = Metric.L2, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows of each group with their ``rank``: a window with a group limit, which prunes before the shuffle."""
    ranked = df.filter(F.col(vector_col).isNotNull()).withColumn("_rank", RANKING[metric](F.col(vector_col), vector_literal(query)))
    by_group = Window.partitionBy(group_col).orderBy(F.round("_rank", 9).asc_nulls_last(), F.col(id_col))
    out = ranked.withColumn("rank", F.row_number().over(by_group)).filter(F.col("rank") <= k)
    return out.withColumn("distance", shown(metric, F.col("_rank"))).withColumn("rank", F.col("rank").cast("long")).drop("_rank")


def distance_concentration(df: DataFrame, query, near: int, far: int, metric: Metric = Metric.L2, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(near_distance, far_distance, ratio) of the near-th and the far-th neighbour of a query."""
    top = knn(df, query, far, metric, None, id_col, vector_col).select("distance", F.row_number().over(Window.orderBy(F.round("distance", 9), F.col(id_col))).alias("r"))
    return top.agg(F.max(F.when(F.col("r") == near, F.col("distance"))).alias("near_distance"), F.max(F.when(F.col("r") == far, F.col("distance"))).alias("far_distance")).withColumn("ratio", F.col("far_distance") / F.col("near_distance"))
