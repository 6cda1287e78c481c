"""Line dedup over content-defined line chunks (native expressions only).

Every two neighbouring lines that stand at an earlier place too (smaller doc_id, text key, line number) are removed, so any run of two
or more repeated lines goes whole at each later place, whatever is around it. Two equal lines that overlap their own first
place (three equal lines) stay. Each removed line still stands at an earlier place.

It is found in two steps. A rolling hash over the hashes of a line and the line after it begins a chunk wherever it is 0 modulo
``divisor``: a boundary hangs on the lines that follow it, so a repeated passage is cut alike wherever it stands. A chunk
reaches over the first line of the next, and chunks that repeat are removed but for their first place. What is left of a
repeated passage are its rims, in chunks that reach out of it: the chunks left are opened into their neighbouring lines, which
are matched in the same way. The result is the same for every ``divisor``; it decides how much the first step folds.

Equal hashes only propose; chunks are grouped by their bytes before anything is removed. At every size alike texts are hashed
once, and read once more at each step for the chunks whose hash repeats; a hot chunk is grouped with map-side partial minima and
joined as two scans, so Spark can split it.

Defined results: null text stays null with no lines; an empty text is one empty line; rows that repeat an id and text are
judged as one document (all keep or all lose the same lines); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm.common import forget, table, text_key, written

DIVISOR = 4


def _chunks(docs: DataFrame, divisor: int) -> DataFrame:
    """(doc_id, h, start, keys): chunks of two or more lines, with a 64-bit key of every two neighbouring lines; ``start`` is a line number."""
    d = docs.filter(F.col("text").isNotNull()).select("doc_id", text_key().alias("h"), F.split("text", "\n").alias("lines")).filter(F.size("lines") > 1)
    d = d.withColumn("hashes", F.transform("lines", lambda x: F.xxhash64(x))).drop("lines")
    low = lambda i: F.get("hashes", i).bitwiseAND(F.lit(0xFFFFFFFF))
    pairs = F.sequence(F.lit(0), F.size("hashes") - 2)
    d = d.withColumn("starts", F.filter(pairs, lambda i: (i == 0) | ((low(i) + F.lit(31) * low(i + 1)) % F.lit(divisor) == 0)))
    d = d.withColumn("keys", F.transform(pairs, lambda i: F.xxhash64(F.get("hashes", i), F.get("hashes", i + 1)))).drop("hashes")
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("keys")))
    spans = F.zip_with("starts", ends, lambda s, e: F.struct(s.alias("start"), F.slice("keys", s + 1, e - s).alias("keys")))
    return d.select("doc_id", "h", F.explode(spans).alias("c")).select("doc_id", "h", "c.start", "c.keys")


def _repeats(docs: DataFrame, places: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, h, start, n) of the ``places`` (doc_id, h, start, n, ck; from a written table) whose lines stand at an earlier place
    too, and the scratch tables behind it. Lines are read once more, for places whose key repeats, and compared by bytes."""
    place, spot = F.struct("doc_id", "h", "start"), F.xxhash64("doc_id", "h", "start")
    twice = places.groupBy("ck").agg(F.min(spot).alias("lo"), F.max(spot).alias("hi")).filter(F.col("lo") != F.col("hi"))
    twice = written(twice.select("ck"), "lines-keys")
    asked = written(places.join(twice.hint("merge"), "ck"), "lines-asked")
    per_doc = asked.groupBy(F.col("doc_id").alias("a_id"), F.col("h").alias("a_h")).agg(F.collect_set(F.struct("start", "n", "ck")).alias("asked"))
    per_doc = written(per_doc, "lines-asked-of")
    again = docs.select("doc_id", text_key().alias("h"), "text").join(per_doc.hint("merge"), F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("h") == F.col("a_h")))
    body = lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n"), x["ck"].alias("ck"), F.array_join(F.slice("lines", x["start"] + 1, x["n"]), "\n").alias("body"))
    again = again.withColumn("lines", F.split("text", "\n")).select("doc_id", "h", F.explode(F.transform("asked", body)).alias("p")).select("doc_id", "h", "p.*")
    again = written(again, "lines-bodies")
    # tables of their own, so that the join is one of two scans, whose hot keys Spark can split
    first = written(again.groupBy("ck", "body").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(~F.col("first").eqNullSafe(F.col("last"))).drop("last"), "lines-first")
    forget(twice, asked, per_doc)
    here = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))
    found = again.join(first.hint("merge"), ["ck", "body"]).filter(~here | (F.col("start") > F.col("first.start") + 1))
    return found.select("doc_id", "h", "start", "n"), [again, first]


def repeated(docs: DataFrame, divisor: int = DIVISOR) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, h, start, n) of every run to remove, and the scratch tables behind it."""
    chunks = written(_chunks(docs, divisor), "lines-chunks")
    whole, scratch = _repeats(docs, chunks.select("doc_id", "h", "start", (F.size("keys") + 1).alias("n"), F.xxhash64("keys").alias("ck")))
    whole = written(whole.distinct(), "lines-whole")
    forget(*scratch)
    gone = whole.select(F.col("doc_id").alias("w_id"), F.col("h").alias("w_h"), F.col("start").alias("w_start"))
    left = chunks.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("h") == F.col("w_h")) & (F.col("start") == F.col("w_start")), "left_anti")
    left = written(left, "lines-left")
    forget(chunks)
    pairs = left.select("doc_id", "h", "start", F.posexplode("keys").alias("at", "ck")).select("doc_id", "h", (F.col("start") + F.col("at")).alias("start"), F.lit(2).alias("n"), "ck")
    rims, scratch = _repeats(docs, pairs)
    spans = whole.unionByName(rims).groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "n")).alias("s"))
    lines = F.array_sort(F.array_distinct(F.flatten(F.transform("s", lambda x: F.sequence(x["start"], x["start"] + x["n"] - 1)))))
    # lines of one run have one difference to their number in the list
    runs = F.transform(lines, lambda x, i: F.struct(x.alias("at"), (x - i).alias("run")))
    runs = spans.select("doc_id", "h", F.explode(runs).alias("r")).groupBy("doc_id", "h", "r.run").agg(F.min("r.at").alias("start"), F.count("*").cast("int").alias("n"))
    return runs.select("doc_id", "h", "start", "n"), [whole, left, *scratch]


def line_dedup(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """``docs`` with the repeated runs cut out of ``text``, plus n_lines, n_removed_lines and n_removed_chunks (runs)."""
    return _without(docs, *repeated(docs, divisor))


def _without(docs: DataFrame, gone: DataFrame, scratch: list[DataFrame]) -> DataFrame:
    gone = written(gone.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("gone")), "lines-gone")
    forget(*scratch)
    # names that no column of ``docs`` has
    free = lambda name: name if name not in docs.columns else free(f"_{name}")
    g_id, g_h, g, h = (free(f"_line_{x}") for x in ("id", "hash", "gone", "key"))
    gone = gone.select(F.col("doc_id").alias(g_id), F.col("h").alias(g_h), F.col("gone").alias(g))
    out = docs.withColumn(h, text_key()).join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col(g_id)) & (F.col(h) == F.col(g_h)), "left")
    lines = F.split("text", "\n")
    drop = F.flatten(F.transform(g, lambda x: F.sequence(x["start"], x["start"] + x["n"] - 1)))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop), lambda i: F.get(lines, i))
    counts = {
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)),
        "n_removed_lines": F.coalesce(F.aggregate(g, F.lit(0), lambda acc, x: acc + x["n"]), F.lit(0)),
        "n_removed_chunks": F.coalesce(F.when(F.col(g).isNotNull(), F.size(g)), F.lit(0)),
    }
    return out.select(
        *(F.when(F.col(g).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias(c) if c == "text" else F.col(c) for c in docs.columns if c not in counts),
        *(v.cast("long").alias(k) for k, v in counts.items()),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: Rows that repeat an id and text do not occur in the tables that the SQL is checked on.
ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, l, unnest(range(1, len(l))) AS i FROM d),
b AS (SELECT doc_id, i - 1 AS i, l[i] || chr(10) || l[i+1] AS body FROM p),
f AS (SELECT doc_id, i, first_value(doc_id) OVER w AS first_id, first_value(i) OVER w AS first_i FROM b WINDOW w AS (PARTITION BY body ORDER BY doc_id, i)),
g AS (SELECT DISTINCT doc_id, unnest([i, i + 1]) AS i FROM f WHERE first_id <> doc_id OR i > first_i + 1),
r AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
x AS (SELECT doc_id, count(*) AS lines, count(DISTINCT run) AS chunks, list(i) AS gone FROM r GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(len(d.l), 0) AS BIGINT) AS n_lines, CAST(coalesce(x.lines, 0) AS BIGINT) AS n_removed_lines, CAST(coalesce(x.chunks, 0) AS BIGINT) AS n_removed_chunks,
 sha256(CASE WHEN x.gone IS NULL THEN coalesce(t.text, '') ELSE array_to_string(list_transform(list_filter(range(0, len(d.l)), lambda i: NOT list_contains(x.gone, i)), lambda i: d.l[i+1]), chr(10)) END) AS kept_sha256
FROM documents t LEFT JOIN d USING (doc_id) LEFT JOIN x USING (doc_id)
"""
