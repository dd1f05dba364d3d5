"""Hybrid search: the nearest vectors and the best text matches, fused by reciprocal ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.vectors import Metric
from quillon.operators.fusion import ReciprocalRank, fuse_two
from quillon.operators.knn import DEFAULT_EF, knn
from quillon.operators.text import bm25, parse_query, with_terms


class HybridError(ValueError):
    """A hybrid search's arguments are refused."""


def _check(df: DataFrame, id_col: str, vector_col: str, text_col: str, k: int, n: int | None) -> None:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for role, column in (("id", id_col), ("vector", vector_col), ("text", text_col)):
        if column not in kinds:
            raise HybridError(f'{role} column "{column}" does not exist on the relation')
    if not isinstance(kinds[id_col], (T.ShortType, T.IntegerType, T.LongType)):
        raise HybridError(f'id column "{id_col}" is {kinds[id_col].simpleString()}, but must be an integer type (smallint, integer, or bigint)')
    v = kinds[vector_col]
    if not (isinstance(v, T.ArrayType) and isinstance(v.elementType, (T.FloatType, T.DoubleType))):
        raise HybridError(f'vector column "{vector_col}" is {v.simpleString()}, but must be a vector')
    t = kinds[text_col]
    if not (isinstance(t, T.StringType) or isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType)):
        raise HybridError(f'text column "{text_col}" is {t.simpleString()}, but must be text or an array of tokens')
    for name, value in (("k", k), ("n", n)):
        if value is not None and value < 1:
            raise HybridError(f"{name} must be at least 1, got {value}")


def infer_metric(column: str, metrics) -> Metric:
    """The one metric of the indexes that cover a column."""
    found = sorted({Metric(m) for m in metrics}, key=lambda m: m.value)
    if not found:
        raise HybridError(f'hybrid search needs an index on vector column "{column}" (its operator class selects the distance metric)')
    if len(found) > 1:
        raise HybridError(f'vector column "{column}" has indexes with different metrics ({", ".join(m.name for m in found)}); drop one so the metric is unambiguous')
    return found[0]


def default_depth(k: int) -> int:
    return max(4 * k, 40)


def _ranked(top: DataFrame, order: list) -> DataFrame:
    return top.select("id", F.row_number().over(Window.orderBy(*order)).alias("rank"))  # depth rows at most


def vector_side(df: DataFrame, query, depth: int, metric: Metric, id_col: str, vector_col: str, index=None) -> DataFrame:
    """(id, rank) of the nearest vectors: by an index where there is one, else exactly."""
    if index is not None:
        top = index.search(query, depth, max(depth, DEFAULT_EF))
    else:
        top = knn(df, query, depth, metric, None, id_col, vector_col).select(F.col(id_col).cast("long").alias("id"), "distance")
    return _ranked(top, [F.round("distance", 9), F.col("id")])


def text_side(df: DataFrame, text: str, depth: int, id_col: str, text_col: str, config: str = "simple") -> DataFrame:
    """(id, rank) of the best text matches."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text"))
    if isinstance(df.schema[text_col].dataType, T.StringType):
        rows = with_terms(rows, "_text", "_terms", config).drop("_text")
    else:
        rows = rows.withColumnRenamed("_text", "_terms")
    order = [F.round("score", 9).desc(), F.col("id")]
    top = bm25(rows, parse_query(text, config), "_terms").select("id", "score").orderBy(*order).limit(depth)
    return _ranked(top, order)


def hybrid_search(df: DataFrame, id_col: str, vector_col: str, text_col: str, query_text: str, query_vector, k: int = 10, n: int | None = None, rrf_k: float = 60.0, config: str = "simple", metric: Metric | None = None, ef: int = DEFAULT_EF, indexes: list | None = None) -> DataFrame:
    """(id, score, vector_rank, text_rank), the k best by reciprocal ranks; ids must be unique.

    Each side goes ``n`` deep (``max(4 k, 40)``), the vector side no deeper than ``ef``. Blank text leaves the vector side alone.
    ``indexes`` are the relation's vector indexes: the one on the vector column is searched and tells the metric, and it is an error if
    there is none or if several disagree. Without them the search is exact by ``metric`` (L2).
    """
    _check(df, id_col, vector_col, text_col, k, n)
    ReciprocalRank(rrf_k)
    index = None
    if indexes is not None:
        there = [x for x in indexes if x.manifest.vector_col == vector_col and x.manifest.id_col == id_col and x.manifest.predicate is None]
        found = infer_metric(vector_col, [x.manifest.metric for x in there])
        if metric is not None and metric is not found:
            raise HybridError(f"the index on {vector_col!r} ranks by {found.name}, not by {metric.name}")
        index = max(there, key=lambda x: x.manifest.generation)
        metric = found
    depth = default_depth(k) if n is None else n
    vector = vector_side(df, query_vector, min(depth, ef), metric or Metric.L2, id_col, vector_col, index)
    if query_text is None or not query_text.strip():
        text = vector.limit(0)
    else:
        text = text_side(df, query_text, depth, id_col, text_col, config)
    return fuse_two(vector, text, k, rrf_k)
