"""Benchmark decontamination as a prefix-filtered set join (native expressions only).

Every benchmark item is cut into windows of 13 consecutive words (an item with fewer words is one window). A window is
treated as the set of its 4-word shingles:

1. all document shingles that occur in any window are found by a hash join and counted over all documents;
2. shingles are ordered by that rarity. Exact containment needs every shingle of a window, so its rarest shingle is a
   sufficient prefix, and a window with a shingle that no document has is dropped;
3. prefix hits give candidate places, bounded by position (the window may not start before the text) and length (nor end
   after it);
4. candidates are verified word by word, and the union of the verified intervals counts the hit words.

Defined results: null and empty texts have no words and are clean; null or wordless items have no windows; rows that
repeat an id and text get the same result each; extra columns are ignored. The benchmark is broadcast only below
``BROADCAST_TOKENS`` distinct shingles, ``BROADCAST_WINDOWS`` windows and ``BROADCAST_BYTES`` bytes of these; beyond, the same
joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alphaloom.llm.common import ascii_lower, forget, table, text_key, written

WINDOW, SHINGLE, BROADCAST_TOKENS, BROADCAST_WINDOWS, BROADCAST_BYTES = 13, 4, 1_000_000, 200_000, 32 << 20
#: ASCII characters that end a word, before and after lower-casing A-Z.
_CUT_RAW = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _raw_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), _CUT_RAW), "")


def _words(text: Column) -> Column:
    return _raw_words(ascii_lower(text))


def _shingles(hashes: Column, n: Column, size: Column) -> Column:
    """Hash of the ``size`` words from each place on; ``hashes`` are word hashes."""
    return F.when(n >= size, F.transform(
        F.sequence(F.lit(0), n - size),
        lambda i: F.xxhash64(*(F.when(F.lit(j) < size, F.get(hashes, i + F.lit(j))) for j in range(SHINGLE))),
    )).otherwise(F.array().cast("array<bigint>"))


def _word_hashes(words: Column) -> Column:
    """Hashes of fully lower-cased words: equal wherever the A-Z lower-cased words are equal."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item_id, win, len): the windows of the items; ``win`` holds the words, joined by blanks."""
    w = items.select("item_id", _words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    w = w.withColumn("len", F.least(F.size("words"), F.lit(window)))
    starts = F.explode(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1))
    return w.select("item_id", "words", "len", starts.alias("s")).select("item_id", F.array_join(F.slice("words", F.col("s"), F.col("len")), " ").alias("win"), "len").distinct()


def occurrences(docs: DataFrame, wins: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Verified places (doc_id, h, start, len, win) of the windows in the documents, and the scratch tables behind them."""
    wins = wins.select("win", "len").distinct()
    tokens = (
        wins.withColumn("q", F.least("len", F.lit(SHINGLE))).withColumn("hashes", _word_hashes(F.split("win", " ")))
        .select("win", "len", "q", F.posexplode(_shingles(F.col("hashes"), F.col("len"), F.col("q"))).alias("off", "token"))
    )
    tokens = written(tokens, "decontam-tokens")
    sizes = sorted(r["q"] for r in tokens.select("q").distinct().collect())  # SHINGLE values at most
    near = F.broadcast if tokens.select("token").distinct().count() <= BROADCAST_TOKENS else (lambda df: df)

    words = docs.select("doc_id", text_key().alias("h"), _word_hashes(_raw_words(F.col("text"))).alias("hashes"))
    words = words.withColumn("n", F.size("hashes"))
    found = None
    for q in sizes:
        part = words.select("doc_id", "h", "n", F.posexplode(_shingles(F.col("hashes"), F.col("n"), F.lit(q))).alias("pos", "token"))
        part = part.join(near(tokens.filter(F.col("q") == q).select("token").distinct()), "token")
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = words.select(F.lit(0).cast("long").alias("token"), "doc_id", "h", "n", F.lit(0).alias("pos")).limit(0)
    found = written(found.select("token", "doc_id", "h", "n", "pos"), "decontam-found")

    rarity = found.groupBy("token").agg(F.count("*").alias("times"))
    ranked = tokens.join(rarity, "token", "left").withColumn("times", F.coalesce("times", F.lit(0)))
    prefix = ranked.groupBy("win", "len").agg(F.min(F.struct("times", "off", "token")).alias("p")).filter("p.times > 0")
    prefix = written(prefix.select("win", "len", "p.off", "p.token"), "decontam-prefixes")
    count, size = prefix.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("win")), F.lit(0))).first()
    small = count <= BROADCAST_WINDOWS and size <= BROADCAST_BYTES
    places = found.join(F.broadcast(prefix) if small else prefix, "token").withColumn("start", F.col("pos") - F.col("off"))
    places = places.filter((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n")))
    per_doc = places.groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "len", "win")).alias("places"))

    d = docs.select(F.col("doc_id").alias("d_id"), text_key().alias("d_h"), "text")
    d = d.join(per_doc, F.col("d_id").eqNullSafe(F.col("doc_id")) & (F.col("d_h") == F.col("h")))
    d = d.select("doc_id", "h", _words(F.col("text")).alias("words"), "places")
    d = d.select("doc_id", "h", "words", F.explode("places").alias("p")).select("doc_id", "h", "words", "p.*")
    exact = d.filter(F.array_join(F.slice("words", F.col("start") + 1, F.col("len")), " ") == F.col("win"))
    return exact.select("doc_id", "h", "start", "len", "win").distinct(), [tokens, found, prefix]


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (and its text key ``h``)."""
    wins = windows(items, window)
    occ, scratch = occurrences(docs, wins)
    occ = written(occ, "decontam-occurrences")
    forget(*scratch)
    at = Window.partitionBy("doc_id", "h").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    spans = occ.select("doc_id", "h", "start", "len").distinct().withColumn("reach", F.coalesce(F.max(end).over(at), F.lit(0)))
    hits = spans.groupBy("doc_id", "h").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "reach"))).cast("long").alias("n_hit"))
    named = occ.select("doc_id", "h", "win").distinct().join(wins.select("win", F.col("item_id").cast("string").alias("item")), "win")
    named = named.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("item")).alias("items"))
    hits = hits.join(named, hits.doc_id.eqNullSafe(named.doc_id) & (hits.h == named.h), "left").select(
        hits.doc_id.alias("r_id"), hits.h.alias("r_h"), "n_hit", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    )
    all_docs = docs.select(F.col("doc_id"), text_key().alias("h"), F.size(_raw_words(F.col("text"))).cast("long").alias("n_words"))
    out = all_docs.join(hits, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("h") == F.col("r_h")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.lit(_EMPTY_SHA)).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "h",
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("h")


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s:s+least(len(w),13)-1], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w),13) + 2)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s+n-1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
occ AS (SELECT DISTINCT doc_id, s, dw.n AS n, item_id FROM dw JOIN bw USING (win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM occ) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit,0) AS BIGINT) AS n_hit, CAST(coalesce(n_items,0) AS BIGINT) AS n_items,
 sha256(coalesce(items,'')) AS items_sha256, coalesce(n_hit,0) > 0 AND 20 * coalesce(n_hit,0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
