"""Reciprocal Rank Fusion of ranked lists, with the rank each source gave."""

from __future__ import annotations

import math
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class FusionStrategy(Protocol):
    """Anything that makes (id, score) from (list_id, id, rank)."""

    def fuse(self, lists: DataFrame) -> DataFrame: ...


class ReciprocalRank:
    """score = sum over lists of 1 / (k + rank); ids by descending score, then ascending id."""

    def __init__(self, k: float = 60.0):
        if not math.isfinite(k) or k < 0:
            raise ValueError(f"invalid RRF k: {k} (must be finite and >= 0)")
        self.k = float(k)

    def fuse(self, lists: DataFrame) -> DataFrame:
        """An id that a list holds more than once counts once, at its best rank."""
        best = lists.filter(F.col("id").isNotNull()).groupBy("list_id", "id").agg(F.min("rank").alias("rank"))
        return best.groupBy("id").agg(F.sum(F.lit(1.0) / (F.lit(self.k) + F.col("rank"))).alias("score"))

    def top(self, lists: DataFrame, k: int) -> DataFrame:
        return self.fuse(lists).orderBy(F.round("score", 12).desc(), F.col("id").asc()).limit(k)


def fuse_two(vector: DataFrame, text: DataFrame, k: int, rrf_k: float = 60.0) -> DataFrame:
    """(id, score, vector_rank, text_rank) of the k best; a rank is null where the source missed the id."""
    strategy = ReciprocalRank(rrf_k)
    both = vector.select("id", "rank", F.lit(0).alias("list_id")).unionByName(text.select("id", "rank", F.lit(1).alias("list_id")))
    best = both.groupBy("list_id", "id").agg(F.min("rank").alias("rank"))
    out = best.groupBy("id").agg(
        F.sum(F.lit(1.0) / (F.lit(strategy.k) + F.col("rank"))).alias("score"),
        F.min(F.when(F.col("list_id") == 0, F.col("rank"))).cast("int").alias("vector_rank"),
        F.min(F.when(F.col("list_id") == 1, F.col("rank"))).cast("int").alias("text_rank"),
    )
    return out.orderBy(F.round("score", 12).desc(), F.col("id").asc()).limit(k)
