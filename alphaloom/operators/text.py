"""Document ingestion: chunks, lexicon scores, similarity search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Default scorer's words.
POSITIVE = ("good", "gain", "growth", "profit", "strong", "the")
NEGATIVE = ("bad", "loss", "weak", "decline", "risk", "of")


def chunks(docs: DataFrame, key: str, text: str = "text", size: int = 512, overlap: int = 64) -> DataFrame:
    """(key, chunk, n_words, chunk_text): sliding windows of words; the last may be shorter, empty texts give none."""
    words = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[ \t\n\x0B\f\r]+"), "")
    d = docs.select(key, words.alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - size) / (size - overlap)).cast("int"))
    d = d.select(key, "w", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    part = F.slice("w", F.col("chunk") * (size - overlap) + 1, size)
    return d.select(key, "chunk", F.size(part).alias("n_words"), F.array_join(part, " ").alias("chunk_text"))


def section_chunks(docs: DataFrame, key: str, text: str = "text", keep: tuple = ("1", "1A", "7", "7A"), size: int = 512, overlap: int = 64) -> DataFrame:
    """(key, section, chunk, n_words, chunk_text): windows within the kept items of a filing.

    A line that begins with ``ITEM`` and a number opens a section; what stands before the first heading, and items not in
    ``keep``, are left out; parts of one item are joined.
    """
    head = r"(?im)^[ \t]*item[ \t]+(\d+[a-z]?)[.:]?[ \t]*$"
    t = F.coalesce(F.col(text), F.lit(""))
    names = F.transform(F.regexp_extract_all(t, F.lit(head), F.lit(1)), lambda x: F.upper(x))
    parts = F.split(t, head)
    d = docs.select(key, F.posexplode(F.arrays_zip(names.alias("n"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))).alias("t"))).alias("at", "s"))
    d = d.select(key, "at", F.col("s.n").alias("section"), F.col("s.t").alias("t")).filter(F.col("section").isin(*keep))
    joined = d.groupBy(key, "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda x: x["t"]), "\n").alias(text))
    both = chunks(joined.withColumn("_key", F.struct(key, "section")), "_key", text, size, overlap)
    return both.select(f"_key.{key}", "_key.section", "chunk", "n_words", "chunk_text")


def lexicon_scores(rows: DataFrame, text: str, positive: tuple = POSITIVE, negative: tuple = NEGATIVE) -> DataFrame:
    """``rows`` with positive, negative, neutral and compound shares by word counts."""
    words = F.split(F.lower(text), r"[^a-z]+")
    hit = lambda names: F.size(F.filter(words, lambda w: w.isin(*names))).cast("double")
    total = F.size(F.array_remove(words, "")).cast("double")
    d = rows.withColumns({"positive": F.try_divide(hit(positive), total), "negative": F.try_divide(hit(negative), total)})
    return d.withColumns({"neutral": 1 - F.col("positive") - F.col("negative"), "compound": F.col("positive") - F.col("negative")})


def term_scores(rows: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, n_words, positive, negative, neutral, compound) by a table of weighted terms (term, weight), one row a term.

    Shares are sums of the weights of a text's words over its words; a text without words has NULL.
    """
    words = F.filter(F.split(F.coalesce(F.lower(text), F.lit("")), r"[^a-z]+"), lambda w: w != "")
    d = rows.select(key, F.explode_outer(words).alias("term")).groupBy(key, "term").agg(F.count("term").alias("n"))
    x = F.coalesce(F.col("weight"), F.lit(0.0)) * F.col("n")
    g = d.join(terms, "term", "left").groupBy(key).agg(F.sum("n").alias("n_words"), F.sum(F.greatest(x, F.lit(0.0))).alias("_p"), F.sum(F.greatest(-x, F.lit(0.0))).alias("_n"))
    share = lambda c: F.try_divide(F.col(c), F.col("n_words"))
    g = g.select(key, "n_words", share("_p").alias("positive"), share("_n").alias("negative"))
    return g.withColumns({"neutral": 1 - F.col("positive") - F.col("negative"), "compound": F.col("positive") - F.col("negative")})


def model_scores(rows: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[tuple[float, float, float]]]]) -> DataFrame:
    """The same columns from a model that ``load`` brings up once per task and that scores Arrow batches of texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            s = pd.DataFrame(model(pdf[text].fillna("").tolist()), columns=["positive", "negative", "neutral"], index=pdf.index)
            yield pdf.assign(**s, compound=s["positive"] - s["negative"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, fields + ", positive double, negative double, neutral double, compound double")


def label(compound, at: float = 0.3):
    return F.when(compound > at, "positive").when(compound < -at, "negative").otherwise("neutral")


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, limit: int = 10_000, slices: int = 64) -> DataFrame:
    """(query_id, vec_id, similarity, pos): exact brute force of the stated ``queries`` (query_id, q) against all vectors.

    Up to ``limit`` queries are broadcast; more go in blocks, each joined to slices of the vectors, so no task holds all of either.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    v = vectors.select("vec_id", "embedding", F.sqrt(dot("embedding", "embedding")).alias("norm"))
    q = queries.select("query_id", "q", F.sqrt(dot("q", "q")).alias("q_norm"))
    blocks = -(-queries.count() // limit)
    if blocks <= 1:
        both = v.crossJoin(F.broadcast(q))
    else:
        part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        v = v.withColumn("_slice", part("vec_id", slices)).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        q = q.withColumn("_block", part("query_id", blocks)).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        both = v.join(q, ["_block", "_slice"])
    sim = F.try_divide(dot("embedding", "q"), F.col("norm") * F.col("q_norm"))
    both = both.select("query_id", "vec_id", F.round(sim, 9).alias("similarity"))
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc_nulls_last(), "vec_id")
    return both.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)
