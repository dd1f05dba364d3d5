"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from ._common import documents


def op1_sstable_shards(spark, sf_dir):
    from .sstable import token_shards

    return token_shards(spark, documents(spark, sf_dir))


def op2_bm25_decontamination(spark, sf_dir):
    from .decontaminate import contaminated

    return contaminated(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_best_fit_packing(spark, sf_dir):
    from .packing import pack_documents

    return pack_documents(spark, documents(spark, sf_dir))


def op4_pii_boosted_spans(spark, sf_dir):
    from .pii import find_spans

    return find_spans(spark, documents(spark, sf_dir))


def op5_context_tree_weighting(spark, sf_dir):
    from .ctw import lm_scores

    return lm_scores(spark, documents(spark, sf_dir))


def op6_matroska(spark, sf_dir):
    from .matroska import media_digests, to_media

    return media_digests(to_media(documents(spark, sf_dir)))


def op7_prob_minhash(spark, sf_dir):
    from .near_dup import near_duplicates

    return near_duplicates(spark, documents(spark, sf_dir)).drop("digest")


def op8_language_id(spark, sf_dir):
    from .lang_id import identify

    return identify(spark, documents(spark, sf_dir))


def op9_ordinal_quality(spark, sf_dir):
    from .quality import graded, quality

    return quality(spark, documents(spark, sf_dir), graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_toxicity(spark, sf_dir):
    from .toxicity import toxicity

    return toxicity(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql():
    return {}
