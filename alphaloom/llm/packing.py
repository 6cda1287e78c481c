"""Conflict-constrained best-fit packing of documents into sequences.

A document of more than ``capacity`` words is cut into pieces. The pieces are dealt at random into blocks of ``block``
items (row numbers permuted as in sharding, so block sizes are exact and a hot source is spread evenly), and each block is
packed by itself, longest first: bins are ordered by residual space and carry bitmaps of the sources and duplicate
clusters (equal texts) inside; the search starts at the first bin that is large enough and goes on to its successors until
it finds the tightest bin without the item's source and cluster. If there is none, a new bin is opened.

Defined results: null, empty and wordless texts take one word's space as piece 0; a null source never conflicts, nor does
the cluster of a null text; a null id is allowed; repeated rows are items each; an empty table gives no rows. Texts are
not shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm.common import table, text_key
from alphaloom.llm.sharding import numbered, permuted

CAPACITY, BLOCK = 2048, 4096


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], list[int]]:
    """Bin of each item and its start in the bin; items are taken in the given order."""
    bits: dict = {}
    bit = lambda kind, x: 0 if pd.isna(x) else 1 << bits.setdefault((kind, x), len(bits))
    spaces: list[tuple[int, int]] = []  # (residual, bin), ordered
    inside: list[int] = []  # bitmaps of sources and clusters
    bins, starts = [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        mine = bit("source", source) | bit("cluster", cluster)
        at = bisect_left(spaces, (size, -1))
        while at < len(spaces) and inside[spaces[at][1]] & mine:
            at += 1
        if at < len(spaces):
            space, b = spaces.pop(at)
        else:
            space, b = capacity, len(inside)
            inside.append(0)
        inside[b] |= mine
        bins.append(b)
        starts.append(capacity - space)
        if space > size:
            insort(spaces, (space - size, b))
    return bins, starts


def items(docs: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, source, cluster, piece, n_words) of every piece."""
    text = F.col("text").cast("string")
    words = F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), ""))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.when(F.col("text").isNotNull(), text_key()).alias("cluster"), F.greatest(words, F.lit(1)).alias("n"))
    last = F.call_function("div", F.col("n") - 1, F.lit(capacity)).cast("int")
    rows = rows.select("doc_id", "source", "cluster", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    return rows.select("doc_id", "source", "cluster", "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int").alias("n_words"))


def pack(docs: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """(doc_id, piece, n_words, block, bin, start) of every piece: its place in bin ``bin`` of block ``block``."""
    rows, n = numbered(items(docs, capacity), ["doc_id", "cluster", "piece", "source", "n_words"])
    rows = rows.withColumn("block", F.call_function("div", permuted(F.col("row_no"), max(n, 1)), F.lit(block)).cast("long")).drop("row_no")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_words", "doc_id", "piece", "cluster", "source"], ascending=[False, True, True, True, True], kind="stable")
        bins, starts = best_fit(pdf["n_words"].tolist(), pdf["source"].tolist(), pdf["cluster"].tolist(), capacity)
        return pdf.assign(bin=bins, start=starts)[["doc_id", "piece", "n_words", "block", "bin", "start"]]

    return rows.groupBy("block").applyInPandas(run, f"doc_id {kind}, piece int, n_words int, block long, bin int, start int")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
