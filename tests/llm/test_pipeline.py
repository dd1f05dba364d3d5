import importlib

import pytest


def test_stages_chain_and_keep_columns(spark, small):
    pipeline = importlib.import_module("corpus_pipeline")
    from quillon.llm._common import documents, materialise
    from quillon.llm.decontaminate import contaminated
    from quillon.llm.near_dup import near_duplicates

    docs = documents(spark, small)
    columns, ids, items = docs.columns, docs.count(), spark.read.parquet(f"{small}/benchmark.parquet")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = docs
        docs = materialise(spark, stage(spark, docs, small), f"test-{k}")
        if k < 4:
            assert docs.columns == columns and docs.count() <= ids
        if name == "MinHash near-dedup":
            kept = {r.doc_id for r in near_duplicates(spark, before).filter("kept").collect()}
            assert {r.doc_id for r in docs.collect()} == kept
        if name == "benchmark decontamination":
            bad = {r.doc_id for r in contaminated(spark, before, items).collect()}
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()} - bad and bad
        if name == "PII":
            assert docs.count() == before.count() and docs.filter("text like '%[EMAIL]%' or text like '%[IP]%' or text like '%[PHONE]%'").count() > 0
        if k == 4:
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()}
        ids = docs.count() if k < 4 else ids


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_registered_once(name):
    import __spark_entry__

    assert len([q for q in __spark_entry__.queries() if q.startswith(f"{name}_")]) == 1


def test_a_worker_keeps_no_memory_of_a_stage_before(spark, small):
    """Packing's encoder and its words are gone from every worker when near-dedup has run."""
    import gc

    import pyarrow as pa
    from pyspark.sql import functions as F

    from quillon.llm._common import documents
    from quillon.llm.near_dup import signatures
    from quillon.llm.packing import token_lengths

    def left(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(type(x).__name__ == "WordEncoder" for x in gc.get_objects())])], ["n"])

    docs = documents(spark, small).repartition(16)
    encoders = lambda: spark.range(0, 16, 1, 16).mapInArrow(left, "n long").agg(F.sum("n")).first()[0]
    token_lengths(docs).write.format("noop").mode("overwrite").save()
    assert encoders() > 0
    signatures(docs).write.format("noop").mode("overwrite").save()
    assert encoders() == 0


def test_texts_of_near_dedup_need_one_worker_a_task(spark):
    from quillon.llm import near_dup as N
    from quillon.llm._common import materialise

    docs = spark.createDataFrame([(i, f"text {i // 2} of some few words") for i in range(8)], "doc_id long, text string")
    signed = materialise(spark, N.signatures(docs), "signatures")
    texts = signed.groupBy("digest").count().withColumnRenamed("count", "copies")
    once = N._each_once(spark, signed, texts)
    assert once.count() == 4 and "MapInArrow" not in once._jdf.queryExecution().executedPlan().toString()
