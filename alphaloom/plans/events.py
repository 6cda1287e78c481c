"""Event studies, order-flow labels, text ingestion: queries."""

from __future__ import annotations

import uuid
from contextvars import ContextVar

from pyspark.sql import functions as F

from alphaloom.functions.expr import by_ticker, forward_return, ratio
from alphaloom.operators import align, factors, information, micro, ranking, stats, text, vectorindex
from alphaloom.registry import query
from alphaloom.session import scratch_root, staged
from alphaloom.sources import tables
from alphaloom.sql import corr, rank, sql

HORIZONS = (1, 3, 5, 10, 20)
FIXED = (0.4, 0.4, 10.0, 20.0)  # alpha, delta, mu, eps


#: Where the studies below take their labels from; None: the fixed parameters.
_LABELS: ContextVar = ContextVar("labels", default=None)


def fitted(study_):
    """The query ``study_`` on labels of yearly fits instead of fixed parameters."""

    def run(spark, sf_dir):
        flow = factors.buy_sell_volume(tables.bars(spark, sf_dir))
        fit = micro.ekop_factor(flow, "annual").select("date", "ticker", F.col("event_label").alias("label"))
        mark = _LABELS.set(staged(flow.join(fit, ["date", "ticker"]), "fitted-labels"))
        try:
            return study_(spark, sf_dir)
        finally:
            _LABELS.reset(mark)

    return run


def labelled(spark, sf_dir):
    """(date, ticker, label, close): labels at fixed parameters, or those that ``fitted`` has set."""
    if _LABELS.get() is not None:
        return _LABELS.get()
    d = factors.buy_sell_volume(tables.bars(spark, sf_dir))
    return d.withColumn("label", micro.event_label(F.col("buys"), F.col("sells"), *map(F.lit, FIXED)))


def study(spark, sf_dir):
    """Labels with complete forward returns, long: (date, ticker, label, horizon, ret)."""
    w = by_ticker()
    d = labelled(spark, sf_dir).select("date", "ticker", "label", *(forward_return(F.col("close"), h, w).alias(str(h)) for h in HORIZONS))
    d = d.dropna(subset=[str(h) for h in HORIZONS])
    return d.unpivot(["date", "ticker", "label"], [str(h) for h in HORIZONS], "horizon", "ret").withColumn("horizon", F.col("horizon").cast("int"))


@query("r15_event_labels", sql("date ticker label", "FROM lab"))
def r15(spark, sf_dir):
    return labelled(spark, sf_dir).select("date", "ticker", "label")


@query("b07_event_study", sql("date ticker label horizon ~ret", "FROM evl"))
def b07(spark, sf_dir):
    return study(spark, sf_dir)


@query("a10_label_returns", sql("label horizon #n ~mean_ ~median_ ~sd ~sem", "FROM (SELECT label, horizon, count(*) AS n, avg(ret) AS mean_, median(ret) AS median_, stddev_samp(ret) AS sd, stddev_samp(ret) / sqrt(count(*)) AS sem FROM evl GROUP BY 1, 2)"))
def a10(spark, sf_dir):
    return stats.describe(study(spark, sf_dir), "ret", "label", "horizon")


@query("a11_spread", sql("label #n ~mean_ ~median_ ~sd_pop ~q25 ~q75", "FROM (SELECT label, count(*) AS n, avg(ret) AS mean_, median(ret) AS median_, stddev_pop(ret) AS sd_pop, quantile_cont(ret, 0.25) AS q25, quantile_cont(ret, 0.75) AS q75 FROM evl WHERE horizon = 5 GROUP BY 1)"))
def a11(spark, sf_dir):
    return stats.spread(study(spark, sf_dir).filter("horizon = 5"), "ret", "label")


@query("a12_label_counts", sql("ticker #good #none_ #bad first_ last_", "FROM (SELECT ticker, count(*) FILTER (label = 1) AS good, count(*) FILTER (label = 0) AS none_, count(*) FILTER (label = -1) AS bad, min(date) AS first_, max(date) AS last_ FROM lab GROUP BY 1)"))
def a12(spark, sf_dir):
    n = lambda v: F.count(F.when(F.col("label") == v, 1))
    return labelled(spark, sf_dir).groupBy("ticker").agg(n(1).alias("good"), n(0).alias("none_"), n(-1).alias("bad"), F.min("date").alias("first_"), F.max("date").alias("last_"))


@query("a13_qualified_symbols", sql("symbol #months", "FROM (SELECT symbol, count(*) AS months FROM (SELECT symbol, date_trunc('month', date) AS ym FROM lines GROUP BY 1, 2 HAVING count(*) >= 15 AND avg(dbuys + dsells) >= 1) GROUP BY 1 HAVING count(*) >= 12)"))
def a13(spark, sf_dir):
    return micro.qualified(tables.line_counts(spark, sf_dir), 15, 1.0, 12)


_TL = "(SELECT ticker, horizon, CASE WHEN count(*) FILTER (label = 1) >= 2 AND count(*) FILTER (label = -1) >= 2 THEN avg(ret) FILTER (label = 1) - avg(ret) FILTER (label = -1) END AS diff FROM evl GROUP BY 1, 2)"


def good_minus_bad(spark, sf_dir):
    """(ticker, horizon, diff): mean return after good minus after bad news, with two of each at least."""
    of = lambda f, v: f(F.when(F.col("label") == v, F.col("ret")))
    g = study(spark, sf_dir).groupBy("ticker", "horizon").agg(of(F.avg, 1).alias("g"), of(F.avg, -1).alias("b"), of(F.count, 1).alias("ng"), of(F.count, -1).alias("nb"))
    return g.select("ticker", "horizon", F.when((F.col("ng") >= 2) & (F.col("nb") >= 2), F.col("g") - F.col("b")).alias("diff"))


@query("a14_two_layer", sql("horizon #n ~mean_ ~t_stat ~cohen_dz", f"FROM (SELECT horizon, count(diff) AS n, avg(diff) AS mean_, avg(diff) * sqrt(count(diff)) / nullif(stddev_samp(diff), 0) AS t_stat, avg(diff) / nullif(stddev_samp(diff), 0) AS cohen_dz FROM {_TL} WHERE diff IS NOT NULL GROUP BY 1)"))
def a14(spark, sf_dir):
    return stats.paired(good_minus_bad(spark, sf_dir), "diff", "horizon")


@query("a15_sign_consistency", sql("horizon #good_above #bad_above ~share ~median_", f"FROM (SELECT horizon, count(*) FILTER (diff > 0) AS good_above, count(*) FILTER (diff < 0) AS bad_above, avg(CAST(diff > 0 AS DOUBLE)) AS share, median(diff) AS median_ FROM {_TL} WHERE diff IS NOT NULL GROUP BY 1)"))
def a15(spark, sf_dir):
    d = good_minus_bad(spark, sf_dir).filter("diff IS NOT NULL")
    n = lambda c: F.count(F.when(c, 1))
    return d.groupBy("horizon").agg(n(F.col("diff") > 0).alias("good_above"), n(F.col("diff") < 0).alias("bad_above"), F.avg((F.col("diff") > 0).cast("double")).alias("share"), F.median("diff").alias("median_"))


@query("a16_risk_adjusted", sql("label horizon ~annual ~vol ~sharpe", "FROM (SELECT label, horizon, avg(ret) * 252 / horizon AS annual, stddev_samp(ret) * sqrt(252.0 / horizon) AS vol, (avg(ret) * 252 / horizon) / nullif(stddev_samp(ret) * sqrt(252.0 / horizon), 0) AS sharpe FROM evl GROUP BY 1, horizon)"))
def a16(spark, sf_dir):
    h = F.col("horizon")
    g = study(spark, sf_dir).groupBy("label", "horizon").agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("sd"))
    d = g.select("label", "horizon", (F.col("m") * 252 / h).alias("annual"), (F.col("sd") * F.sqrt(252.0 / h)).alias("vol"))
    return d.withColumn("sharpe", ratio(F.col("annual"), F.col("vol")))


@query("a21_event_paths", sql("label day #n ~mean_ ~se", """FROM (SELECT label, day, count(*) AS n, avg(p) AS mean_, stddev_pop(p) / sqrt(count(*)) AS se FROM (SELECT label, unnest(range(21)) AS day, unnest(path) / path[1] AS p FROM
 (SELECT label, list(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING) AS path FROM lab) WHERE len(path) = 21 AND path[1] <> 0) GROUP BY 1, 2)"""))
def a21(spark, sf_dir):
    path = F.collect_list("close").over(by_ticker().rowsBetween(0, 20))
    d = labelled(spark, sf_dir).select("label", path.alias("path")).filter((F.size("path") == 21) & (F.col("path")[0] != 0))
    d = d.select("label", F.col("path")[0].alias("p0"), F.posexplode("path").alias("day", "p"))
    return d.groupBy("label", F.col("day").cast("long").alias("day")).agg(F.count("*").alias("n"), F.avg(F.col("p") / F.col("p0")).alias("mean_"), (F.stddev_pop(F.col("p") / F.col("p0")) / F.sqrt(F.count("*"))).alias("se"))


@query("w15_streaks", sql("date ticker label #streak streak_bucket", """FROM (SELECT *, CASE WHEN streak >= 5 THEN '5+' ELSE CAST(streak AS VARCHAR) END AS streak_bucket FROM (SELECT *, row_number() OVER (PARTITION BY ticker, run ORDER BY date) AS streak FROM
 (SELECT *, sum(nw) OVER (PARTITION BY ticker ORDER BY date) AS run FROM (SELECT date, ticker, label, CASE WHEN label = lag(label) OVER (PARTITION BY ticker ORDER BY date) THEN 0 ELSE 1 END AS nw FROM ev))))"""))
def w15(spark, sf_dir):
    d = study(spark, sf_dir).filter("horizon = 1").select("date", "ticker", "label")
    return ranking.streaks(d, "label").select("date", "ticker", "label", F.col("streak").cast("long").alias("streak"), "streak_bucket")


KRUSKAL = f"""SELECT * FROM (SELECT n, k, h, (h - k + 1) / (n - k) AS eta2 FROM (SELECT n, k, (12 * q / (n * (n + 1.0)) - 3 * (n + 1.0)) / (1 - ties / (n * 1.0 * n * n - n)) AS h FROM
 (SELECT sum(c) AS n, count(*) AS k, sum(s * s / c) AS q FROM (SELECT label, sum(r) AS s, CAST(count(*) AS DOUBLE) AS c FROM (SELECT label, {rank('ret', 'horizon')} AS r FROM evl WHERE horizon = 5) GROUP BY 1)),
 (SELECT sum(t * t * t - t) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM evl WHERE horizon = 5 GROUP BY ret))))"""


@query("r07_kruskal", sql("#n #k ~h ~eta2", KRUSKAL.removeprefix("SELECT * ")))
def r07(spark, sf_dir):
    return stats.kruskal(study(spark, sf_dir).filter("horizon = 5"), "ret", "label")


_MW = f"(SELECT label, {rank('ret', 'horizon')} AS r, CAST(count(*) OVER (PARTITION BY horizon, ret) AS DOUBLE) AS t FROM evl WHERE horizon = 5 AND label IN (1, -1))"


@query("r08_mann_whitney", sql("#na #nb ~u ~z", f"""FROM (SELECT na, nb, u, (abs(u - na * nb / 2) - 0.5) / sqrt(na * nb / 12 * ((na + nb + 1) - ties / ((na + nb) * (na + nb - 1)))) * sign(u - na * nb / 2) AS z FROM
 (SELECT na, nb, ties, ra - na * (na + 1) / 2 AS u FROM (SELECT CAST(count(*) FILTER (label = 1) AS DOUBLE) AS na, CAST(count(*) FILTER (label = -1) AS DOUBLE) AS nb, sum(r) FILTER (label = 1) AS ra, sum(t * t - 1) AS ties FROM {_MW})))"""))
def r08(spark, sf_dir):
    return rank_test(study(spark, sf_dir).filter("horizon = 5"), 1, -1)


def rank_test(s, a, b):
    """The rank test of two labels; a deviate of 0 / 0 (a missing label b, or all rows tied) is NaN here, as in its SQL."""
    z = F.when(F.col("na") > 0, F.coalesce("z", F.lit(float("nan")))).alias("z")
    return stats.mann_whitney(s, "ret", "label", a, b).select("na", "nb", "u", z)


def rank_pair(s, name, a, b):
    """(pair, na, nb, u, z, diff, r): one row, also where a label has no rows."""
    means = s.agg((F.avg(F.when(F.col("label") == a, F.col("ret"))) - F.avg(F.when(F.col("label") == b, F.col("ret")))).alias("diff"))
    one = rank_test(s, a, b).crossJoin(F.broadcast(means))  # one row each
    return one.select(F.lit(name).alias("pair"), "na", "nb", "u", "z", "diff", ratio(F.abs("z"), F.sqrt(F.col("na") + F.col("nb"))).alias("r"))


_PAIRS = (("good_bad", 1, -1), ("good_none", 1, 0), ("bad_none", -1, 0))


def _mw_pair(name: str, a: int, b: int) -> str:
    rows = _MW.replace("label IN (1, -1)", f"label IN ({a}, {b})")
    return f"""SELECT pair, na, nb, u, z, diff, abs(z) / sqrt(na + nb) AS r FROM (SELECT '{name}' AS pair, na, nb, u, diff, (abs(u - na * nb / 2) - 0.5) / sqrt(na * nb / 12 * ((na + nb + 1) - ties / ((na + nb) * (na + nb - 1)))) * sign(u - na * nb / 2) AS z FROM
 (SELECT na, nb, ties, diff, ra - na * (na + 1) / 2 AS u FROM (SELECT CAST(count(*) FILTER (label = {a}) AS DOUBLE) AS na, CAST(count(*) FILTER (label = {b}) AS DOUBLE) AS nb, sum(r) FILTER (label = {a}) AS ra, sum(t * t - 1) AS ties FROM {rows}),
 (SELECT avg(ret) FILTER (label = {a}) - avg(ret) FILTER (label = {b}) AS diff FROM evl WHERE horizon = 5)))"""


@query("r08_label_pairs", sql("pair #na #nb ~u ~z ~diff ~r", "FROM (" + " UNION ALL ".join(_mw_pair(*p) for p in _PAIRS) + ")"))
def r08_pairs(spark, sf_dir):
    """Rank tests of all three pairs of labels at five days, with the difference of means and the effect size."""
    s, out = study(spark, sf_dir).filter("horizon = 5"), None
    s = staged(s, "pair-rows")
    for name, a, b in _PAIRS:
        one = rank_pair(s, name, a, b)
        out = one if out is None else out.unionAll(one)
    return out


@query("r09_welch", sql("horizon #na #nb ~diff ~t_stat ~dof ~cohen_d", """FROM (SELECT horizon, na, nb, ma - mb AS diff, (ma - mb) / sqrt(va / na + vb / nb) AS t_stat, pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS dof,
 (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS cohen_d FROM (SELECT horizon, count(*) FILTER (label = 1) AS na, count(*) FILTER (label = -1) AS nb, avg(ret) FILTER (label = 1) AS ma, avg(ret) FILTER (label = -1) AS mb,
 var_samp(ret) FILTER (label = 1) AS va, var_samp(ret) FILTER (label = -1) AS vb FROM evl GROUP BY 1))"""))
def r09(spark, sf_dir):
    return stats.welch(study(spark, sf_dir), "ret", "label", 1, -1, "horizon")


@query("r02_pooled_correlation", sql("#n ~spearman ~pearson", f"FROM (SELECT count(*) AS n, {corr('rx', 'ry')} AS spearman, {corr('volatility_20d', 'fwd')} AS pearson FROM (SELECT volatility_20d, fwd, {rank('volatility_20d', 'k')} AS rx, {rank('fwd', 'k')} AS ry FROM (SELECT *, 1 AS k FROM zs JOIN fwd USING (date, ticker) WHERE volatility_20d IS NOT NULL AND fwd IS NOT NULL)))"))
def r02(spark, sf_dir):
    from alphaloom.plans.panel import w14, z_panel

    return stats.spearman(z_panel(spark, sf_dir).join(w14(spark, sf_dir), ["date", "ticker"]), "volatility_20d", "fwd")


@query("r11_line_fit", sql("ticker #n ~slope ~intercept ~r", f"FROM (SELECT ticker, count(*) AS n, regr_slope(buys, sells) AS slope, regr_intercept(buys, sells) AS intercept, {corr('sells', 'buys')} AS r FROM flow GROUP BY 1)"))
def r11(spark, sf_dir):
    return stats.line_fit(factors.buy_sell_volume(tables.bars(spark, sf_dir)), "sells", "buys", "ticker")


@query("r12_log_poisson", sql("symbol date ~logp", "FROM (SELECT symbol, date, dbuys * ln(3.5 + 1e-300) - 3.5 - lgamma(dbuys + 1) AS logp FROM lines)"))
def r12(spark, sf_dir):
    from alphaloom.functions.special import lgamma

    k = F.col("dbuys")
    return tables.line_counts(spark, sf_dir).select("symbol", "date", (k * F.log(F.lit(3.5 + 1e-300)) - 3.5 - lgamma(k + 1)).alias("logp"))


@query("j05_next_trading_day", sql("ticker date chunk_id day", "FROM (SELECT s.ticker, s.date, s.chunk_id, o.date AS day FROM (SELECT * FROM sen WHERE doc_type = '8-K') s ASOF LEFT JOIN ohlcv o ON s.ticker = o.ticker AND s.date <= o.date)"))
def j05(spark, sf_dir):
    s = tables.sentiment(spark, sf_dir).filter("doc_type = '8-K'").select("ticker", "date", "chunk_id")
    return align.asof_forward(s, tables.bars(spark, sf_dir), "ticker", "date", "day")


@query("s16_chunks", sql("doc_id #chunk #n_words chunk_text", """FROM (SELECT doc_id, c AS chunk, len(w[c * 448 + 1 : c * 448 + 512]) AS n_words, array_to_string(w[c * 448 + 1 : c * 448 + 512], ' ') AS chunk_text FROM
 (SELECT doc_id, w, unnest(range(0, 1 + greatest(0, CAST(ceil((len(w) - 512) / 448.0) AS INT)))) AS c FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0))"""))
def s16(spark, sf_dir):
    d = text.chunks(tables.read(spark, sf_dir, "documents"), "doc_id")
    return d.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("n_words").cast("long").alias("n_words"), "chunk_text")


@query("s17_lexicon_scores", sql("doc_id ~positive ~negative ~neutral ~compound", """FROM (SELECT doc_id, positive, negative, 1 - positive - negative AS neutral, positive - negative AS compound FROM (SELECT doc_id, len(list_filter(w, lambda x: x IN ('good','gain','growth','profit','strong','the'))) / nullif(CAST(len(list_filter(w, lambda x: x <> '')) AS DOUBLE), 0) AS positive,
 len(list_filter(w, lambda x: x IN ('bad','loss','weak','decline','risk','of'))) / nullif(CAST(len(list_filter(w, lambda x: x <> '')) AS DOUBLE), 0) AS negative FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^a-z]+') AS w FROM documents)))"""))
def s17(spark, sf_dir):
    return text.lexicon_scores(tables.read(spark, sf_dir, "documents"), "text").select("doc_id", "positive", "negative", "neutral", "compound")


_SIMILAR = sql("#query_id #vec_id pos", """FROM (SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC NULLS LAST, vec_id) AS INT) AS pos FROM (SELECT q.label AS query_id, e.vec_id,
 round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / nullif(sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * x))), 0), 9) AS similarity
 FROM embeddings e, (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1) q)) WHERE pos <= 5""")


@query("s19_similar_vectors", _SIMILAR)
def s19(spark, sf_dir):
    v = tables.read(spark, sf_dir, "embeddings")
    q = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q")).select(F.col("label").cast("long").alias("query_id"), "q")
    return text.cosine_top_k(v, q, 5).select("query_id", "vec_id", "pos")


@query("s19_index_search", _SIMILAR)
def s19_index(spark, sf_dir):
    """The same through the persisted index: built from most vectors, the rest upserted, lists cut by their bounds."""
    v = tables.read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    path, late = f"{scratch_root(spark)}/index-{uuid.uuid4().hex}", F.col("vec_id") % 10 == 7
    vectorindex.build(v.filter(~late), path)
    vectorindex.upsert(v.filter(late), path)
    q = tables.read(spark, sf_dir, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q")).select(F.col("label").cast("long").alias("query_id"), "q")
    return vectorindex.search(spark, path, q, 5)[0].select("query_id", "vec_id", "pos")


@query("r16_ekop_factor", sql("date ticker period ~pin event_label", "FROM ekop"))
def r16(spark, sf_dir):
    return micro.ekop_factor(factors.buy_sell_volume(tables.bars(spark, sf_dir)), "both")


@query("r23_vdj_monthly")
def r23(spark, sf_dir):
    return micro.vdj_parameters(tables.trade_counts(spark, sf_dir), F.date_format("date", "yyyy-MM"), 15, 1.0)


def lag_pairs(d, lags=range(-5, 6)):
    """(date, ticker, lag, ret, label): ret at a date and label ``lag`` dates later, on the grid of all dates and tickers."""
    grid = d.select("date").distinct().crossJoin(F.broadcast(d.select("ticker").distinct())).join(d, ["date", "ticker"], "left")  # a row for each date and ticker
    shifted = grid.select("date", "ticker", "ret", *(F.lead("label", k).over(by_ticker()).alias(str(k)) for k in lags))
    return shifted.unpivot(["date", "ticker", "ret"], [str(k) for k in lags], "lag", "label").dropna(subset=["ret", "label"])


def lag_profile(d, lags=range(-5, 6), least=50):
    """(lag, n, spearman, pearson, mi) of ret at a date and label at ``lag`` dates later, pooled over tickers.

    ``d``: (date, ticker, label, ret). Dates are those of any ticker; fewer than ``least`` pairs give NULL.
    """
    names = [str(k) for k in lags]
    pairs = staged(lag_pairs(d, lags), "lag-pairs")
    mi = information.discrete(pairs, ["lag"], "ret", "label", ["date", "ticker"], least=least).select("lag", "n", "mi")
    enough = lambda c: F.when(F.col("n") >= least, F.col(c)).alias(c)
    all_lags = d.sparkSession.createDataFrame([(k,) for k in names], "lag string")
    both = all_lags.join(mi, "lag", "left").join(stats.spearman(pairs, "label", "ret", "lag").select("lag", "spearman", "pearson"), "lag", "left")
    return both.select("lag", F.coalesce("n", F.lit(0)).alias("n"), enough("spearman"), enough("pearson"), "mi")


@query("r06_lag_profile")
def r06(spark, sf_dir):
    """Correlation and mutual information of labels and daily returns at lags -5 .. 5 on the common date grid."""
    d = labelled(spark, sf_dir).select("date", "ticker", "label", (F.col("close") / F.lag("close").over(by_ticker()) - 1).alias("ret"))
    return lag_profile(d)


@query("r04_label_information")
def r04(spark, sf_dir):
    """Mutual information of five-day returns and labels for each ticker."""
    d = study(spark, sf_dir).filter("horizon = 5")
    return information.discrete(d, ["ticker"], "ret", "label", ["date"]).select("ticker", "mi", "n")


@query("w18_smoother", sql("#row_no ~x ~y", """FROM (WITH o AS (SELECT spx_close AS x, vix_close AS y, row_number() OVER (ORDER BY spx_close, date) AS r, greatest(30, count(*) OVER () // 15) AS w FROM idx WHERE spx_close IS NOT NULL AND vix_close IS NOT NULL)
 SELECT a.r AS row_no, avg(b.x) AS x, avg(b.y) AS y FROM o a JOIN o b ON b.r >= a.r AND b.r < a.r + a.w WHERE (a.r - 1) % 5 = 0 GROUP BY a.r, a.w HAVING count(*) = a.w)"""))
def w18(spark, sf_dir):
    return ranking.smoothed(tables.index_prices(spark, sf_dir), "spx_close", "vix_close", None, 5, "date")


