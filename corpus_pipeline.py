"""A corpus pipeline of five stages; each reads what the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm import decontaminate, langid, linededup, neardup, packing
from alphaloom.llm.common import bounded, table, text_key, written

#: Mean probability of the predicted language below which a text is in no language that was learned.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts of no learned language."""
    found = langid.identify(docs.select("*"), langid.train(docs))
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated runs of lines whole, as op8 does; a document that loses all its lines goes."""
    out = linededup.line_dedup(docs)
    out = out.filter((F.col("n_removed_lines") == 0) | (F.col("n_removed_lines") < F.col("n_lines"))).select(docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near-duplicates, and rows without an id."""
    gone = neardup.near_dedup(docs).filter(F.col("doc_id").isNotNull() & ~F.col("kept"))
    gone = written(gone.select(F.col("doc_id").alias("x_id"), F.col("h").alias("x_h")).distinct(), "pipeline-gone")
    return docs.join(bounded(gone), (F.col("doc_id") == F.col("x_id")) & (text_key() == F.col("x_h")), "left_anti").select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that benchmark windows cover to a twentieth or more."""
    dirty = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select(F.col("doc_id").alias("x_id"), F.col("h").alias("x_h"))
    return docs.join(bounded(written(dirty.distinct(), "pipeline-dirty")), F.col("doc_id").eqNullSafe(F.col("x_id")) & (text_key() == F.col("x_h")), "left_anti").select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the remaining documents into sequences."""
    return packing.pack(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("minhash_near_dedup", near_duplicates), ("benchmark_decontamination", benchmark), ("best_fit_packing", sequences)]
#: The network, the signatures and best-fit have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
