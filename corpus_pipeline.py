"""The corpus pipeline: language, near duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; ``run`` applies them to ``documents`` one after the
other, each stage's rows written to the shared checkpoint folder as Parquet and read again as the next one's input. All
stages but the last give the columns of ``documents``.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from quillon.llm._common import documents, materialise
from quillon.llm.decontaminate import decontaminate
from quillon.llm.lang_id import keep_identified
from quillon.llm.near_dup import one_of_each
from quillon.llm.packing import pack_documents
from quillon.llm.pii import redact
from quillon.sources.ship import ship


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the others go."""
    return keep_identified(spark, docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the least id."""
    return one_of_each(spark, docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return redact(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The segments of the training sequences."""
    return pack_documents(spark, docs)


def _shipped(stage):
    """The stage, with the package sent to the executors first."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [("language ID", identified), ("MinHash near-dedup", deduplicated), ("benchmark decontamination", decontaminated), ("PII", redacted), ("best-fit packing", packed)]
STAGES = [(name, _shipped(stage)) for name, stage in STAGES]

#: SQL expresses neither the trained stages nor the packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(spark, stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
