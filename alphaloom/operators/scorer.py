"""A trained scorer of texts: a multinomial logistic model over terms, fitted by distributed aggregates.

A text is its terms (runs of a-z of the lower-cased text) with counts scaled to unit length, and a constant. Every step is two joins and
two aggregates: weights meet terms and sum up to each text's logits, probabilities meet terms and sum up to each weight's gradient. The
weights are a table (term, pos, neg, common), the third class being the reference. Weights of the ``COMMON`` terms that most texts have are
broadcast, as are the errors of up to ``ERRORS`` texts, so their rows stay where they are and only sums are shuffled; all other terms, and errors
beyond that count, go through shuffle joins.

Defined results: a text without terms is scored by the constant alone; unknown terms weigh nothing; a null text has no terms; without
labelled rows the table is empty and every class has a third.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.session import staged

STEPS, RATE, DECAY = 8, 6.0, 1e-3
COMMON, ERRORS = 200_000, 2_000_000


def terms(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, x): unit-length term counts of every row, and the constant, whose term is the empty string; a key's rows lie together."""
    words = F.filter(F.split(F.coalesce(F.lower(text), F.lit("")), r"[^a-z]+"), lambda w: w != "")
    whole = rows.select(key, text).repartition(key)  # the one shuffle: counts and norms follow its partitions
    counts = whole.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").cast("double").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    return counts.select(key, "term", (F.col("n") / norm).alias("x")).unionByName(rows.select(key, F.lit("").alias("term"), F.lit(1.0).alias("x")))


def logits(common: DataFrame, rare: DataFrame, key: str, weights: DataFrame) -> DataFrame:
    """(key, p, q) of the positive and the negative class, from the rows of common and of all other terms."""
    own = lambda c: weights.filter(F.col("common") == c).select("term", "pos", "neg")
    sums = lambda d: d.groupBy(key).agg(*(F.sum(F.col("x") * F.coalesce(c, F.lit(0.0))).alias(f"z_{c}") for c in ("pos", "neg")))
    z = sums(common.join(F.broadcast(own(True)), "term")).unionAll(sums(rare.join(own(False), "term", "left")))  # at most COMMON rows
    z = z.groupBy(key).agg(F.sum("z_pos").alias("z_pos"), F.sum("z_neg").alias("z_neg"))
    total = 1 + F.exp("z_pos") + F.exp("z_neg")
    return z.select(key, (F.exp("z_pos") / total).alias("p"), (F.exp("z_neg") / total).alias("q"))


def split(x: DataFrame, common: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``x`` with a term of the bounded table ``common``, and all others."""
    names = F.broadcast(common.select("term"))
    return x.join(names, "term", "left_semi"), x.join(names, "term", "left_anti")


def fit(rows: DataFrame, key: str, text: str, target: str, steps: int = STEPS, rate: float = RATE, decay: float = DECAY, most: int = COMMON, errors: int = ERRORS) -> DataFrame:
    """(term, pos, neg, common) after ``steps`` steps down the mean gradient; ``target``: 1 positive, -1 negative, 0 neither, null: not used."""
    known = rows.filter(F.col(target).isNotNull())
    x = staged(terms(known, key, text), "scorer-terms")
    y = staged(known.select(key, (F.col(target) > 0).cast("double").alias("yp"), (F.col(target) < 0).cast("double").alias("yn")), "scorer-labels")
    count = y.count()
    n, near = max(count, 1), (F.broadcast if count <= errors else lambda d: d)
    vocabulary = staged(x.groupBy("term").agg(F.count("*").alias("texts")), "scorer-vocabulary")
    top = staged(vocabulary.orderBy(F.col("texts").desc(), "term").limit(most).select("term", F.lit(True).alias("common")), "scorer-common")
    common, rare = split(x, top)
    rare = staged(rare, "scorer-rare")
    start = vocabulary.join(F.broadcast(top), "term", "left").select("term", F.lit(0.0).alias("pos"), F.lit(0.0).alias("neg"), F.coalesce("common", F.lit(False)).alias("common"))
    weights = staged(start, "scorer-weights")
    common = staged(common, "scorer-shared")
    for _ in range(steps):
        miss = staged(logits(common, rare, key, weights).join(y, key).select(key, (F.col("yp") - F.col("p")).alias("dp"), (F.col("yn") - F.col("q")).alias("dn")), "scorer-errors")
        sums = lambda d: d.join(near(miss), key).groupBy("term").agg(*(F.sum(F.col("x") * F.col(c)).alias(c) for c in ("dp", "dn")))  # noqa: E731, B023
        slope = sums(common).unionAll(sums(rare))  # no term is in both
        step = lambda w, d: (F.col(w) + rate * (F.col(d) / n - decay * F.col(w))).alias(w)
        weights = staged(weights.join(slope, "term").select("term", step("pos", "dp"), step("neg", "dn"), "common"), "scorer-weights")
    return weights


def scores(rows: DataFrame, key: str, text: str, weights: DataFrame) -> DataFrame:
    """(key, positive, negative, neutral, compound) of every row."""
    x = staged(terms(rows, key, text), "scorer-terms")
    # the constant is a row of every text, whatever the weights hold
    p = logits(*split(x, weights.filter("common")), key, weights)
    return p.select(key, F.col("p").alias("positive"), F.col("q").alias("negative"), (1 - F.col("p") - F.col("q")).alias("neutral"), (F.col("p") - F.col("q")).alias("compound"))


def oracle(docs: str, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> str:
    """DuckDB SQL of the scores of ``docs`` (k, t, y), fitted on its rows with a label."""
    term = "SELECT k, term, n / sqrt(sum(n * n) OVER (PARTITION BY k)) AS x FROM (SELECT k, term, CAST(count(*) AS DOUBLE) AS n FROM (SELECT k, unnest(regexp_split_to_array(lower(coalesce(t, '')), '[^a-z]+')) AS term FROM docs) WHERE term <> '' GROUP BY 1, 2) UNION ALL SELECT k, '', 1.0 FROM docs"
    prob = lambda x, w: f"SELECT k, exp(zp) / (1 + exp(zp) + exp(zn)) AS p, exp(zn) / (1 + exp(zp) + exp(zn)) AS q FROM (SELECT k, sum(x * coalesce(pos, 0)) AS zp, sum(x * coalesce(neg, 0)) AS zn FROM {x} LEFT JOIN {w} USING (term) GROUP BY 1)"
    parts = [f"docs AS MATERIALIZED ({docs})", f"every AS MATERIALIZED ({term})", "known AS MATERIALIZED (SELECT every.* FROM every JOIN docs USING (k) WHERE y IS NOT NULL)", "m AS (SELECT greatest(count(*), 1) AS m FROM docs WHERE y IS NOT NULL)",
             "w0 AS MATERIALIZED (SELECT DISTINCT term, CAST(0 AS DOUBLE) AS pos, CAST(0 AS DOUBLE) AS neg FROM known)"]
    for j in range(steps):
        parts += [f"d{j} AS MATERIALIZED (SELECT k, CAST(y > 0 AS DOUBLE) - p AS dp, CAST(y < 0 AS DOUBLE) - q AS dn FROM ({prob('known', f'w{j}')}) JOIN docs USING (k))",
                  f"w{j + 1} AS MATERIALIZED (SELECT term, pos + {rate} * (dp / m - {decay} * pos) AS pos, neg + {rate} * (dn / m - {decay} * neg) AS neg FROM w{j} JOIN (SELECT term, sum(x * dp) AS dp, sum(x * dn) AS dn FROM known JOIN d{j} USING (k) GROUP BY 1) USING (term), m)"]
    return "WITH " + ",\n".join(parts) + f" SELECT k AS doc_id, round(p, 6) AS positive, round(q, 6) AS negative, round(1 - p - q, 6) AS neutral, round(p - q, 6) AS compound FROM ({prob('every', f'w{steps}')})"
