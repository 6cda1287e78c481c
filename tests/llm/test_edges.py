"""Odd rows that the other tests leave out: clashing names in search, odd rows under trained models, stages on an empty table."""

import pytest
from pyspark.sql import functions as F

from alphaloom.llm import quality, topk

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_search_takes_clashing_names(spark):
    rows = [(i, [float(i % 7), 1.0, float(-i)]) for i in range(120)] + [(200, None), (201, []), (202, [1.0, None, 2.0])]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    named = plain.withColumns({c: F.lit(3) for c in ("v", "query_id", "score", "rank", "h", "node", "cell", "block", "label")})
    key = lambda d: sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(d).collect())
    assert key(named) == key(plain) and len(key(plain)) == 5 * 3


def test_a_trained_model_takes_odd_rows(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{tiny}/labels.parquet"))
    odd = spark.createDataFrame([(1, None), (2, ""), (None, " \n"), (3, "x" * 50_000), (3, "x" * 50_000)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("score", "features", "h", "predicted")})
    out = quality.score(odd, model).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)


def test_stages_take_an_empty_table(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tiny).count() == 0, name
