"""Sharding: a reproducible global shuffle with computable shard and slot (native expressions only).

Rows get gapless global numbers from a fixed number of hash buckets (bucket counts are added up, rows are numbered
within their bucket), a Feistel network over Z_a x Z_b permutes the numbers, and cycle walking repeats it until the
result is a row number again. ``shard = p mod shards`` and ``slot = p div shards`` then follow from the permuted
number alone: shard sizes differ by one row at most and slots have no gaps (law ``rows``).

Defined results: ids keep their type; null ids sort first, a null text has size 1 and the checksum of the empty text, an empty table gives
no rows; repeated rows get numbers of their own. Only id, size and checksum are shuffled, never the texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alphaloom.llm.common import table

#: Multipliers and increments of the round functions.
ROUND_KEYS = ((1103515245, 12345), (69069, 1), (1664525, 1013904223), (22695477, 7), (134775813, 3), (214013, 2531011))
#: Numbers outside the table in the grid of a permutation, and so the steps of a walk, at most.
WALK = 64


def _round(x: Column, key: Column) -> Column:
    """Round function: a 31-bit mixture of x; plain integer arithmetic that any SQL engine repeats."""
    y = (x * key["k"] + key["c"]) % F.lit(2147483647)
    return (y.bitwiseXOR(F.shiftright(y, 15)) * F.lit(48271) + F.lit(11)) % F.lit(2147483647)


def feistel(x: Column, a: int, b: int, seed: int = 0) -> Column:
    """One pass of the permutation of 0 .. a*b-1; rounds change the left half (mod a) and the right half (mod b) in turn.

    The rounds are one ``aggregate`` over the round keys, so the expression stays small.
    """
    keys = F.array(*(F.struct(F.lit(k[0]).cast("long").alias("k"), F.lit(k[1] + seed).cast("long").alias("c"), F.lit(i % 2 == 0).alias("even")) for i, k in enumerate(ROUND_KEYS)))
    halves = lambda left, right: F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(acc: Column, key: Column) -> Column:
        other = F.when(key["even"], acc["r"]).otherwise(acc["l"])
        mixed = _round(other, key)
        return halves(F.when(key["even"], (acc["l"] + mixed) % F.lit(a)).otherwise(acc["l"]), F.when(key["even"], acc["r"]).otherwise((acc["r"] + mixed) % F.lit(b)))

    return F.aggregate(keys, halves(F.call_function("div", x, F.lit(b)), x % F.lit(b)), step, lambda acc: acc["l"] * F.lit(b) + acc["r"])


def grid(n: int) -> tuple[int, int]:
    """(a, b), both about sqrt(n), such that a*b exceeds n by ``WALK`` at most.

    About one in a/WALK numbers a fits; where none from sqrt(n) to its 16-fold does, a = WALK always does.
    """
    least = math.isqrt(max(n - 1, 0)) + 1
    a = next((a for a in range(least, 16 * least + 1) if -n % a <= WALK), WALK)
    return a, max(1, -(-n // a))


def permuted(x: Column, n: int, seed: int = 0) -> Column:
    """Position of row number ``x`` among ``n`` in the shuffle.

    A walk visits each of the a*b - n numbers outside at most once, so it ends within WALK steps.
    """
    a, b = grid(n)
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), feistel(x, a, b, seed), lambda acc, _: F.when(acc < F.lit(n), acc).otherwise(feistel(acc, a, b, seed)))


def numbered(df: DataFrame, keys: list[str], buckets: int = 4096) -> tuple[DataFrame, int]:
    """``df`` with a gapless ``row_no`` from 0, and its row count; no global sort and no single task.

    Only the bucket counts (at most ``buckets`` rows) reach the driver.
    """
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    counts = sorted((r["_bucket"], r["n"]) for r in df.groupBy("_bucket").agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for bucket, n in counts:
        offsets.append((bucket, total))
        total += n
    if not total:
        return df.drop("_bucket").withColumn("row_no", F.lit(0).cast("long")), 0
    starts = df.sparkSession.createDataFrame(offsets, "_bucket int, _start long")
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys))
    return df.withColumn("_rank", rank).join(F.broadcast(starts), "_bucket").withColumn("row_no", F.col("_start") + F.col("_rank") - 1).drop("_bucket", "_start", "_rank"), total


def shard(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """Return doc_id, size, text_crc32, law, shard, slot and grown_shard for every row of ``docs``."""
    text = F.col("text").cast("string")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows, n = numbered(rows, ["doc_id", "size", "text_crc32"])
    at = permuted(F.col("row_no"), max(n, 1), seed)
    return rows.withColumn("_at", at).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_at") % shards).cast("int").alias("shard"),
        F.call_function("div", F.col("_at"), F.lit(shards)).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
