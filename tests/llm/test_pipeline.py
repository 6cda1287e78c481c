"""The corpus pipeline: each stage against its operator on the smallest table, and the whole run."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from alphaloom.llm import decontaminate, neardup  # noqa: E402
from alphaloom.llm.common import table, text_key, written  # noqa: E402
from tests_llm_brute import brute_components, brute_decontaminate  # noqa: E402


def test_stages_keep_clean_documents(spark, tiny):
    docs = table(spark, tiny, "documents")
    start = docs.count()
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, tiny), name)
        sizes.append(docs.count())
        if name == "minhash_near_dedup":
            rows = before.orderBy("doc_id").collect()
            want = brute_components([r["text"] for r in rows], neardup.SHINGLE)
            assert sorted(r["doc_id"] for r in docs.collect()) == [rows[i]["doc_id"] for i in want if want[i][2]]
        if name == "benchmark_decontamination":
            rows = before.orderBy("doc_id").collect()
            want = brute_decontaminate([r["text"] for r in rows], [tuple(r) for r in table(spark, tiny, "benchmark").select("item_id", "text").collect()])
            assert sorted(r["doc_id"] for r in docs.collect()) == [rows[i]["doc_id"] for i in want if not want[i][4]]
    assert sizes[0] >= 0.98 * start and sizes[1] >= 0.9 * sizes[0]


def test_run_packs_what_is_left(spark, tiny):
    out = corpus_pipeline.run(spark, tiny)
    assert out.groupBy("block", "bin").agg(F.sum("n_words").alias("n")).agg(F.max("n")).first()[0] <= 2048


def test_stages_take_odd_rows(spark, tiny):
    rows = [(1, None), (2, ""), (None, "the words of a text that has no id but some words"), (3, "the same text with several words"), (3, "the same text with several words")]
    docs = spark.createDataFrame([(i, t, "en", None, 0, 5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, h int")
    for _, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, docs, tiny)
        assert out.count() >= 4
    assert neardup.near_dedup(docs).count() == 5 and decontaminate.decontaminate(docs.withColumn("k", text_key()), table(spark, tiny, "benchmark")).count() == 5
