"""DuckDB SQL that repeats the library's queries: shared table expressions and a small composer."""

from __future__ import annotations

import re
from functools import cache

W = "(PARTITION BY ticker ORDER BY date)"
FACTORS = ["momentum_21d", "momentum_63d", "momentum_252d", "rsi_5d", "price_zscore_20d", "volatility_20d", "volume_zscore_20d", "amihud_20d"]
FUNDAMENTAL = ["pe_ratio", "pb_ratio", "roe", "roa"]


def roll(x: str, n: int, agg: str, least: int | None = None) -> str:
    f = f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {f} >= {n if least is None else least} THEN {agg}({x}) {f} END"


def z(x: str, part: str, least: int = 1) -> str:
    o = f"OVER (PARTITION BY {part})"
    return f"CASE WHEN count({x}) {o} >= {least} THEN CASE WHEN stddev_samp({x}) {o} = 0 THEN 0.0 ELSE ({x} - avg({x}) {o}) / stddev_samp({x}) {o} END END"


def rank(x: str, keys: str, desc: str = "") -> str:
    return f"(rank() OVER (PARTITION BY {keys} ORDER BY {x} {desc}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0)"


def corr(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


ORD = "(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"
CTES = {
    "ohlcv": f"""SELECT CAST(l_shipdate AS DATE) AS date, p_brand AS ticker, arg_min(l_extendedprice / l_quantity, {ORD}) AS open, max(l_extendedprice / l_quantity) AS high,
        min(l_extendedprice / l_quantity) AS low, arg_max(l_extendedprice / l_quantity, {ORD}) AS close, sum(l_quantity) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "idx": "SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS spx_close, 20.0::DOUBLE + count(*) % 12 AS vix_close FROM orders GROUP BY 1",
    "stm": """SELECT ticker, make_date(y, 12, 31) AS fiscal_date, ni, equity, assets, CASE ticker WHEN 'Brand#11' THEN NULL WHEN 'Brand#12' THEN 0 ELSE n END AS shares FROM (
        SELECT p_brand AS ticker, year(l_shipdate) AS y, sum(l_extendedprice * (1 - l_discount)) - 1e6 * (year(l_shipdate) % 3) AS ni, sum(l_extendedprice) AS equity, sum(l_extendedprice * (1 + l_tax)) AS assets,
        CAST(count(*) AS DOUBLE) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)""",
    "sec": "SELECT DISTINCT p_brand AS ticker, CAST(CAST(substr(p_brand, 7) AS INT) % 5 AS VARCHAR) AS sector FROM part WHERE CAST(substr(p_brand, 7) AS INT) < 24",
    "taq": """SELECT 'S' || (user_id % 10) AS symbol, CAST(ts AS DATE) AS date, CAST(sum(CAST(event_type IN ('purchase', 'signup') AS INT)) AS DOUBLE) AS dbuys,
        CAST(sum(CAST(event_type IN ('click', 'error') AS INT)) AS DOUBLE) AS dsells FROM events GROUP BY 1, 2""",
    "lines": "SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date, CAST(count(*) FILTER (l_returnflag <> 'N') AS DOUBLE) AS dbuys, CAST(count(*) FILTER (l_returnflag = 'N') AS DOUBLE) AS dsells FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "sen": """SELECT 'Brand#' || (d.doc_id % 25 + 1) AS ticker, DATE '1995-01-02' + CAST(d.doc_id * 37 % 2499 AS INT) AS date, ['10-K', '10-Q', '8-K', 'news'][CAST(substr(source, 4) AS INT) % 4 + 1] AS doc_type,
        d.doc_id AS chunk_id, CAST(quality AS DOUBLE) AS positive, CAST(toxic AS DOUBLE) AS negative, CAST(quality - toxic AS DOUBLE) AS compound FROM documents d LEFT JOIN labels USING (doc_id)""",
    "t0": f"""SELECT *, close / nullif(lag(close) OVER {W}, 0) - 1 AS ret, close - lag(close) OVER {W} AS delta FROM ohlcv""",
    "t1": f"""SELECT *, CASE WHEN delta > 0 THEN delta ELSE 0 END AS gain, CASE WHEN -delta > 0 THEN -delta ELSE 0 END AS loss, abs(ret) / nullif(close * volume, 0) AS illiq FROM t0""",
    "t2": f"""SELECT *, {roll("gain", 5, "avg")} AS g5, {roll("loss", 5, "avg")} AS l5 FROM t1""",
    "tech": f"""SELECT date, ticker, open, high, low, close, volume, ret, """
    + ", ".join(f"lag(close, 1) OVER {W} / nullif(lag(close, {n}) OVER {W}, 0) - 1 AS momentum_{n}d" for n in (21, 63, 252))
    + f""", CASE WHEN l5 > 0 THEN 100 - 100 / (1 + g5 / l5) WHEN g5 > 0 THEN 100 END AS rsi_5d, (close - {roll("close", 20, "avg")}) / nullif({roll("close", 20, "stddev_samp")}, 0) AS price_zscore_20d,
        {roll("ret", 20, "stddev_samp")} AS volatility_20d, (volume - {roll("volume", 20, "avg")}) / nullif({roll("volume", 20, "stddev_samp")}, 0) AS volume_zscore_20d, ({roll("illiq", 20, "avg")}) * 1e6 AS amihud_20d FROM t2""",
    "facts": "SELECT ticker, fiscal_date + 60 AS known, ni / nullif(shares, 0) AS eps, equity / nullif(shares, 0) AS bvps, ni / nullif(equity, 0) AS roe, ni / nullif(assets, 0) AS roa FROM stm",
    "full0": """SELECT t.*, e.eps, b.bvps, r.roe, a.roa FROM tech t ASOF LEFT JOIN (SELECT * FROM facts WHERE eps IS NOT NULL) e ON t.ticker = e.ticker AND t.date >= e.known
        ASOF LEFT JOIN (SELECT * FROM facts WHERE bvps IS NOT NULL) b ON t.ticker = b.ticker AND t.date >= b.known ASOF LEFT JOIN (SELECT * FROM facts WHERE roe IS NOT NULL) r ON t.ticker = r.ticker AND t.date >= r.known
        ASOF LEFT JOIN (SELECT * FROM facts WHERE roa IS NOT NULL) a ON t.ticker = a.ticker AND t.date >= a.known""",
    "full_panel": "SELECT * EXCLUDE (eps, bvps), close / nullif(CASE WHEN eps > 0 THEN eps END, 0) AS pe_ratio, close / nullif(bvps, 0) AS pb_ratio FROM full0",
    "panel": "SELECT * FROM full_panel WHERE " + " AND ".join(f"{f} IS NOT NULL" for f in FACTORS),
    "zs": "SELECT date, ticker, close, " + ", ".join(f"{z(f, 'date')} AS {f}" for f in FACTORS + FUNDAMENTAL) + " FROM panel",
    "zsec": "SELECT date, ticker, " + ", ".join(f"{z(f, 'date, sector', 2)} AS {f}" for f in FACTORS + FUNDAMENTAL) + " FROM (SELECT panel.*, coalesce(sector, 'Unknown') AS sector FROM panel LEFT JOIN sec USING (ticker))",
    "score": "SELECT date, ticker, round(coalesce(momentum_252d, 0) + coalesce(volatility_20d, 0) - coalesce(volume_zscore_20d, 0) - coalesce(amihud_20d, 0) + coalesce(pb_ratio, 0), 9) AS score FROM zs",
    "fwd": f"SELECT date, ticker, lead(close, 21) OVER {W} / nullif(close, 0) - 1 AS fwd FROM ohlcv",
    "longz": "SELECT date, ticker, factor, value FROM (UNPIVOT zs ON " + ", ".join(FACTORS + FUNDAMENTAL) + " INTO NAME factor VALUE value)",
    "pairs": f"SELECT factor, date, {rank('value', 'factor, date')} AS rv, {rank('fwd', 'factor, date')} AS rf FROM longz JOIN fwd USING (date, ticker) WHERE value IS NOT NULL AND fwd IS NOT NULL",
    "ic": f"SELECT factor, date, CASE WHEN count(*) >= 3 THEN {corr('rv', 'rf')} END AS ic, count(*) AS n FROM pairs GROUP BY 1, 2",
    "icsum": """SELECT factor, count(ic) AS n, avg(ic) AS mean_ic, stddev_samp(ic) AS std_ic, avg(CASE WHEN ic IS NOT NULL THEN CAST(ic > 1e-12 AS DOUBLE) END) AS positive,
        avg(ic) / nullif(stddev_samp(ic), 0) AS icir, avg(ic) * sqrt(count(ic)) / nullif(stddev_samp(ic), 0) AS t_stat FROM ic GROUP BY 1""",
    "rd0": """SELECT *, CASE WHEN count(spx_close) OVER (ORDER BY date ROWS 199 PRECEDING) >= 100 THEN avg(spx_close) OVER (ORDER BY date ROWS 199 PRECEDING) END AS ma200,
        spx_close / nullif(lag(spx_close, 252) OVER (ORDER BY date), 0) - 1 AS mom_12m FROM idx""",
    "rd": "SELECT *, vix_high + below_ma + falling AS bear_count FROM (SELECT *, CAST(coalesce(vix_close > 25, false) AS INT) AS vix_high, CAST(coalesce(spx_close < ma200, false) AS INT) AS below_ma, CAST(coalesce(mom_12m < 0, false) AS INT) AS falling FROM rd0)",
    "bdays": "SELECT CAST(d AS DATE) AS date FROM (SELECT unnest(generate_series((SELECT min(date) FROM rd), (SELECT max(date) FROM rd), INTERVAL 1 DAY)) AS d) WHERE isodow(d) < 6",
    "mult": "SELECT b.date, CASE WHEN bear_count >= 3 THEN 1.0 WHEN bear_count = 2 THEN 0.5 ELSE 0.0 END::DOUBLE AS multiplier, bear_count AS bear_score FROM bdays b ASOF JOIN rd r ON b.date >= r.date",
    "cdates": "SELECT date, row_number() OVER (ORDER BY date) AS no FROM (SELECT DISTINCT date FROM score WHERE date IN (SELECT date FROM ohlcv))",
    "rets": "SELECT date, ticker, no, CASE WHEN lag(no) OVER w = no - 1 THEN close / nullif(lag(close) OVER w, 0) - 1 END AS ret FROM ohlcv JOIN cdates USING (date) WINDOW w AS (PARTITION BY ticker ORDER BY date)",
    "bdv": "SELECT c.date, count(score) AS valid, count(s.date) AS rows_ FROM cdates c LEFT JOIN score s USING (date) GROUP BY 1",
    "bruns": "SELECT *, sum(nw) OVER (ORDER BY date) AS run FROM (SELECT *, CASE WHEN month(date) = lag(month(date)) OVER (ORDER BY date) THEN 0 ELSE 1 END AS nw FROM bdv)",
    "breb": "SELECT *, coalesce(date = min(CASE WHEN valid >= 5 THEN date END) OVER (PARTITION BY run), false) AS reb FROM bruns",
    "bheld": "SELECT *, max(CASE WHEN reb THEN date END) OVER (ORDER BY date) AS lf, max(CASE WHEN reb AND valid >= 10 THEN date END) OVER (ORDER BY date) AS sf FROM breb",
    "picks": "SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY score DESC NULLS LAST, ticker) AS hi, row_number() OVER (PARTITION BY date ORDER BY score, ticker DESC) AS lo FROM score WHERE date IN (SELECT date FROM breb WHERE reb)",
    "oheld": "SELECT date, min(date) OVER (PARTITION BY run) AS lf FROM bruns",
    "opicks": "SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY score DESC NULLS LAST, ticker) AS hi FROM score WHERE date IN (SELECT lf FROM oheld)",
    "oleg": "SELECT h.date, coalesce(avg(ret), 0) AS ret FROM oheld h LEFT JOIN opicks p ON p.date = h.lf AND hi <= 5 LEFT JOIN rets r ON r.date = h.date AND r.ticker = p.ticker GROUP BY 1",
    "lleg": "SELECT h.date, coalesce(avg(ret), 0) AS ret FROM bheld h LEFT JOIN picks p ON p.date = h.lf AND hi <= 5 LEFT JOIN rets r ON r.date = h.date AND r.ticker = p.ticker GROUP BY 1",
    "sleg": "SELECT h.date, coalesce(avg(ret), 0) AS ret FROM bheld h LEFT JOIN picks p ON p.date = h.sf AND lo <= 5 LEFT JOIN rets r ON r.date = h.date AND r.ticker = p.ticker GROUP BY 1",
    "sleg2": "SELECT s.date, 0.0 - ret * coalesce(multiplier, 0) AS ret FROM sleg s ASOF LEFT JOIN mult m ON s.date >= m.date",
    "legs": "SELECT date, 'long' AS leg, ret FROM lleg UNION ALL SELECT date, 'short', ret FROM sleg2 UNION ALL SELECT date, 'ls', l.ret + s.ret FROM lleg l JOIN sleg2 s USING (date)",
    "eq": "SELECT *, (equity - peak) / nullif(peak, 0) AS drawdown FROM (SELECT *, max(equity) OVER (PARTITION BY leg ORDER BY date) AS peak FROM (SELECT *, product(1 + ret) OVER (PARTITION BY leg ORDER BY date) AS equity FROM legs))",
    "ieq": "SELECT *, (equity - peak) / nullif(peak, 0) AS drawdown FROM (SELECT *, max(equity) OVER (ORDER BY date) AS peak FROM (SELECT date, product(1 + coalesce(ret, 0)) OVER (ORDER BY date) AS equity FROM (SELECT date, spx_close / nullif(lag(spx_close) OVER (ORDER BY date), 0) - 1 AS ret FROM idx)))",
    "perf": """SELECT leg, count(*) AS n, CASE WHEN count(r) = 0 OR stddev_samp(r) = 0 THEN 0 ELSE avg(r) * 252 / (stddev_samp(r) * sqrt(252)) END AS sharpe,
        CASE WHEN count(*) < 2 THEN 0 WHEN arg_max(equity, date) / arg_min(equity, date) > 0 THEN pow(arg_max(equity, date) / arg_min(equity, date), 252.0 / count(*)) - 1 END AS annual_return, min(drawdown) AS max_drawdown
        FROM (SELECT *, CASE WHEN ret <> 0 THEN ret END AS r FROM eq) GROUP BY 1""",
    # event labels at fixed order-flow parameters
    "flow": "SELECT *, volume * least(greatest((close - low) / (high - low + 1e-10), 0), 1) AS buys, volume * (1 - least(greatest((close - low) / (high - low + 1e-10), 0), 1)) AS sells FROM ohlcv",
    "lab0": "SELECT *, ln(0.4 * 0.6 / 0.6) + buys * ln(1 + 10.0 / 20) - 10.0 AS good, ln(0.4 * 0.4 / 0.6) + sells * ln(1 + 10.0 / 20) - 10.0 AS bad FROM flow",
    "lab": "SELECT *, CASE WHEN good >= bad AND good >= 0 THEN 1 WHEN bad >= 0 THEN -1 ELSE 0 END AS label FROM lab0",
    "ev0": "SELECT date, ticker, label, close, " + ", ".join(f"lead(close, {h}) OVER {W} / nullif(close, 0) - 1 AS ret_{h}d" for h in (1, 3, 5, 10, 20)) + " FROM lab",
    "ev": "SELECT * FROM ev0 WHERE " + " AND ".join(f"ret_{h}d IS NOT NULL" for h in (1, 3, 5, 10, 20)),
    "evl": "SELECT date, ticker, label, CAST(replace(replace(h, 'ret_', ''), 'd', '') AS INT) AS horizon, ret FROM (UNPIVOT ev ON ret_1d, ret_3d, ret_5d, ret_10d, ret_20d INTO NAME h VALUE ret)",
}


_span = lambda a, b, c: f"make_date(CAST(y0 + k + {a} AS INT), {b}, {c})"
CTES |= {
    "span0": "SELECT year(min(l_shipdate)) AS y0, CAST(max(l_shipdate) AS DATE) AS d1 FROM lineitem",
    "folds": f"SELECT CAST(k AS INT) AS fold, {_span(0, 1, 1)} AS train_start, {_span(1, 12, 31)} AS train_end, {_span(2, 1, 1)} AS test_start, {_span(2, 12, 31)} AS test_end FROM (SELECT y0, d1, unnest(range(0, 60)) AS k FROM span0) WHERE {_span(2, 12, 31)} <= d1",
    "spans": "SELECT fold, 'train' AS sample, train_start AS a, train_end AS b FROM folds UNION ALL SELECT fold, 'test', test_start, test_end FROM folds",
    "fic": f"""SELECT fold, factor, date, CASE WHEN count(*) >= 3 THEN {corr('rv', 'rf')} END AS ic FROM (SELECT fold, factor, date, {rank('value', 'fold, factor, date')} AS rv, {rank('fwd', 'fold, factor, date')} AS rf
        FROM longz JOIN fwd USING (date, ticker) JOIN spans ON date BETWEEN a AND b WHERE sample = 'train' AND value IS NOT NULL AND fwd IS NOT NULL) GROUP BY 1, 2, 3""",
    "fsel": """SELECT fold, factor, t_stat, CASE WHEN t_stat IS NULL OR abs(t_stat) < 2 THEN 0 WHEN icir >= 0 THEN 1 ELSE -1 END AS weight FROM (SELECT fold, factor, avg(ic) / nullif(stddev_samp(ic), 0) AS icir,
        avg(ic) * sqrt(count(ic)) / nullif(stddev_samp(ic), 0) AS t_stat FROM fic GROUP BY 1, 2)""",
    "fz": "SELECT fold, sample, zs.* EXCLUDE (close) FROM zs JOIN spans ON date BETWEEN a AND b",
    "fenough": "SELECT fold FROM (SELECT fold, sample, count(DISTINCT date) AS d FROM fz GROUP BY 1, 2) GROUP BY 1 HAVING max(CASE WHEN sample = 'train' THEN d END) >= 30 AND max(CASE WHEN sample = 'test' THEN d END) >= 10",
    "fchosen": "SELECT fold, factor, weight FROM fsel WHERE weight <> 0 AND fold IN (SELECT fold FROM fenough)",
    "regw": "SELECT * FROM (VALUES REGIMES) AS v(bs, factor, w)",
    "fboth": "SELECT fold, bs, factor, w FROM fchosen JOIN regw USING (factor) WHERE w <> 0",
    "fw": """SELECT 'plain' AS variant, fold, bs, factor, weight AS w FROM (SELECT *, unnest(range(4)) AS bs FROM fchosen) UNION ALL SELECT 'regime', fold, bs, factor, w FROM fboth
        UNION ALL SELECT 'regime', fold, bs, factor, weight FROM (SELECT *, unnest(range(4)) AS bs FROM fchosen) WHERE (fold, bs) NOT IN (SELECT (fold, bs) FROM fboth)""",
    "flong": "SELECT * FROM fz UNPIVOT INCLUDE NULLS (value FOR factor IN (" + ", ".join(FACTORS + FUNDAMENTAL) + "))",
    "fscore": """SELECT variant, l.fold, sample, l.date, ticker, round(sum(w * coalesce(value, 0)), 9) AS score FROM flong l LEFT JOIN mult m ON l.date = m.date JOIN fw ON fw.fold = l.fold AND fw.factor = l.factor AND fw.bs = coalesce(bear_score, 0)
        GROUP BY 1, 2, 3, 4, 5""",
    "fdates": "SELECT variant, fold, sample, date, row_number() OVER (PARTITION BY variant, fold, sample ORDER BY date) AS no FROM (SELECT DISTINCT variant, fold, sample, date FROM fscore WHERE date IN (SELECT date FROM ohlcv))",
    "frets": "SELECT variant, fold, sample, date, ticker, CASE WHEN lag(no) OVER w = no - 1 THEN close / nullif(lag(close) OVER w, 0) - 1 END AS ret FROM ohlcv JOIN fdates USING (date) WINDOW w AS (PARTITION BY variant, fold, sample, ticker ORDER BY date)",
    "fdv": "SELECT variant, fold, sample, date, count(score) AS valid FROM fdates LEFT JOIN fscore USING (variant, fold, sample, date) GROUP BY 1, 2, 3, 4",
    "fruns": "SELECT *, sum(nw) OVER (PARTITION BY variant, fold, sample ORDER BY date) AS run FROM (SELECT *, CASE WHEN month(date) = lag(month(date)) OVER (PARTITION BY variant, fold, sample ORDER BY date) THEN 0 ELSE 1 END AS nw FROM fdv)",
    "freb": "SELECT *, coalesce(date = min(CASE WHEN valid >= 5 THEN date END) OVER (PARTITION BY variant, fold, sample, run), false) AS reb FROM fruns",
    "fheld": "SELECT *, max(CASE WHEN reb THEN date END) OVER w AS lf, max(CASE WHEN reb AND valid >= 10 THEN date END) OVER w AS sf FROM freb WINDOW w AS (PARTITION BY variant, fold, sample ORDER BY date)",
    "fpicks": """SELECT variant, fold, sample, date, ticker, row_number() OVER (PARTITION BY variant, fold, sample, date ORDER BY score DESC NULLS LAST, ticker) AS hi, row_number() OVER (PARTITION BY variant, fold, sample, date ORDER BY score, ticker DESC) AS lo
        FROM fscore JOIN (SELECT variant, fold, sample, date FROM freb WHERE reb) USING (variant, fold, sample, date)""",
    "flleg": "SELECT h.variant, h.fold, h.sample, h.date, coalesce(avg(ret), 0) AS ret FROM fheld h LEFT JOIN fpicks p ON (p.variant, p.fold, p.sample, p.date) = (h.variant, h.fold, h.sample, h.lf) AND hi <= 5 LEFT JOIN frets r ON (r.variant, r.fold, r.sample, r.date, r.ticker) = (h.variant, h.fold, h.sample, h.date, p.ticker) GROUP BY 1, 2, 3, 4",
    "fsleg": "SELECT h.variant, h.fold, h.sample, h.date, coalesce(avg(ret), 0) AS ret FROM fheld h LEFT JOIN fpicks p ON (p.variant, p.fold, p.sample, p.date) = (h.variant, h.fold, h.sample, h.sf) AND lo <= 5 LEFT JOIN frets r ON (r.variant, r.fold, r.sample, r.date, r.ticker) = (h.variant, h.fold, h.sample, h.date, p.ticker) GROUP BY 1, 2, 3, 4",
    "fsleg2": "SELECT s.variant, s.fold, s.sample, s.date, 0.0 - ret * coalesce(multiplier, 0) AS ret FROM fsleg s ASOF LEFT JOIN mult m ON s.date >= m.date",
    "flegs": "SELECT *, 'long' AS leg FROM flleg UNION ALL SELECT *, 'short' FROM fsleg2 UNION ALL SELECT variant, fold, sample, date, l.ret + s.ret, 'ls' FROM flleg l JOIN fsleg2 s USING (variant, fold, sample, date)",
    "feq": """SELECT *, (equity - peak) / nullif(peak, 0) AS drawdown FROM (SELECT *, max(equity) OVER (PARTITION BY variant, fold, sample, leg ORDER BY date) AS peak FROM (SELECT *, product(1 + ret) OVER (PARTITION BY variant, fold, sample, leg ORDER BY date) AS equity FROM flegs))""",
    "fperf": """SELECT variant, fold, sample, leg, count(*) AS n, CASE WHEN count(r) = 0 OR stddev_samp(r) = 0 THEN 0 ELSE avg(r) * 252 / (stddev_samp(r) * sqrt(252)) END AS sharpe,
        CASE WHEN count(*) < 2 THEN 0 WHEN arg_max(equity, date) / arg_min(equity, date) > 0 THEN pow(arg_max(equity, date) / arg_min(equity, date), 252.0 / count(*)) - 1 END AS annual_return, min(drawdown) AS max_drawdown
        FROM (SELECT *, CASE WHEN ret <> 0 THEN ret END AS r FROM feq) GROUP BY 1, 2, 3, 4""",
}


_EM = "ticker, period, win, st, n, mean, step"
CTES |= {
    # order-flow fits: EM from every start, a step per recursion, finished fits drop out
    "emdays": """SELECT ticker, period, CASE period WHEN 'annual' THEN strftime(date, '%Y') ELSE strftime(date, '%Y-%m') END AS win, date, buys AS b, sells AS s FROM flow CROSS JOIN (VALUES ('annual'), ('monthly')) AS v(period) WHERE buys IS NOT NULL AND sells IS NOT NULL""",
    "emkeys": "SELECT ticker, period, win, count(*) AS n, greatest(avg(b + s) / 2, 1e-6) AS mean FROM emdays GROUP BY ALL HAVING count(*) >= 5",
    "em": f"""SELECT ticker, period, win, st, n, mean, 0 AS step, alpha, delta, greatest(mean * share, 1e-6) AS mu, greatest(mean * (1 - 0.4 * share), 1e-6) AS eps, CAST('-infinity' AS DOUBLE) AS total, false AS done FROM emkeys CROSS JOIN (VALUES STARTS) AS v(st, alpha, delta, share)
 UNION ALL SELECT ticker, period, win, st, n, mean, step + 1, a2, d2, CASE WHEN news > 1e-12 THEN greatest((CASE WHEN rate < e2 THEN mean ELSE rate END) - (CASE WHEN rate < e2 THEN mean ELSE e2 END), 1e-6) ELSE mu END, CASE WHEN news > 1e-12 THEN CASE WHEN rate < e2 THEN mean ELSE e2 END ELSE eps END,
 total, total - last <= 1e-9 * (1 + abs(total)) OR step >= 499 FROM (SELECT *, least(greatest(news / n, 1e-6), 1 - 1e-6) AS a2, least(greatest(CASE WHEN news > 0 THEN srb / news ELSE delta END, 1e-6), 1 - 1e-6) AS d2, srate / nullif(news, 0) AS rate, greatest(seps / (2 * s0 + news), 1e-6) AS e2 FROM
 (SELECT {_EM}, alpha, delta, mu, eps, last, sum(lk) AS total, sum(exp(wg - lk) + exp(wb - lk)) AS news, sum(exp(wb - lk)) AS srb, sum(exp(w0 - lk)) AS s0, sum(exp(wg - lk) * b + exp(wb - lk) * s) AS srate, sum(exp(w0 - lk) * (b + s) + exp(wg - lk) * s + exp(wb - lk) * b) AS seps FROM
 (SELECT *, greatest(w0, wg, wb) + ln(exp(w0 - greatest(w0, wg, wb)) + exp(wg - greatest(w0, wg, wb)) + exp(wb - greatest(w0, wg, wb))) AS lk FROM
 (SELECT {_EM}, alpha, delta, mu, eps, total AS last, b, s, ln(1 - alpha) + (b + s) * ln(eps) - 2 * eps AS w0, ln(alpha * (1 - delta)) + b * ln(mu + eps) + s * ln(eps) - 2 * eps - mu AS wg, ln(alpha * delta) + b * ln(eps) + s * ln(mu + eps) - 2 * eps - mu AS wb
 FROM em JOIN emdays USING (ticker, period, win) WHERE NOT done)) GROUP BY {_EM}, alpha, delta, mu, eps, last))""",
    "emfit": """SELECT * FROM (SELECT *, max(total) OVER (PARTITION BY ticker, period, win) AS best FROM em WHERE done) WHERE total >= best - 1e-9 * (1 + abs(best)) QUALIFY row_number() OVER (PARTITION BY ticker, period, win ORDER BY st) = 1""",
    "ekop": """SELECT date, ticker, period, pin, CASE WHEN good >= bad AND good >= 0 THEN 1 WHEN bad >= 0 THEN -1 ELSE 0 END AS event_label FROM (SELECT date, ticker, period, alpha * mu / (alpha * mu + 2 * eps) AS pin,
 ln(alpha * (1 - delta) / (1 - alpha)) + b * ln(1 + mu / eps) - mu AS good, ln(alpha * delta / (1 - alpha)) + s * ln(1 + mu / eps) - mu AS bad FROM emdays JOIN emfit USING (ticker, period, win))""",
}


def _regimes() -> str:
    from alphaloom.operators.regime import REGIME_WEIGHTS

    return ", ".join(f"({s}, '{f}', {w})" for s in range(4) for f, w in REGIME_WEIGHTS[min(s, 2)].items())


def _starts() -> str:
    from alphaloom.operators.micro import STARTS

    return ", ".join(f"({i}, {float(a)}::DOUBLE, {float(d)}::DOUBLE, {float(share)}::DOUBLE)" for i, (a, d, share) in enumerate(STARTS))


CTES["regw"] = CTES["regw"].replace("REGIMES", _regimes())
CTES["em"] = CTES["em"].replace("STARTS", _starts())


@cache
def needs(text: str) -> tuple[str, ...]:
    """Names of the shared expressions that ``text`` reads, in an order that defines before use."""
    used = {x for x in re.findall(r"(?:FROM|JOIN|UNPIVOT)\s+(\w+)", text) if x in CTES}
    return tuple(n for n in CTES if n in used.union(*(needs(CTES[x].replace("FROM em JOIN", "FROM prior JOIN")) for x in used)))  # em reads itself


def sql(columns: str, body: str) -> str:
    """SELECT of ``columns`` (blank-separated; ~name is rounded to 6 digits, ^name written with 7, #name a BIGINT) over ``body``."""
    def one(c: str) -> str:
        if c[0] == "^":
            return f"CASE WHEN {c[1:]} IS NOT NULL THEN printf('%.6e', CAST({c[1:]} + 0.0 AS DOUBLE)) END AS {c[1:]}"
        return f"round({c[1:]}, 6) + 0.0 AS {c[1:]}" if c[0] == "~" else f"CAST({c[1:]} AS BIGINT) AS {c[1:]}" if c[0] == "#" else c

    names = needs(body)
    head = ("WITH RECURSIVE " if "em" in names else "WITH ") + ",\n".join(f"{n} AS ({CTES[n]})" for n in names) + "\n" if names else ""
    return f"{head}SELECT {', '.join(map(one, columns.split()))} {body}"


def on_fitted_labels(text: str) -> str:
    """A composed query with ``lab`` taken from the yearly fits."""
    fits = ",\n".join(f"{n} AS ({CTES[n]})" for n in ("emdays", "emkeys", "em", "emfit", "ekop"))
    text = text.replace(f"lab0 AS ({CTES['lab0']})", fits, 1)
    text = text.replace(f"lab AS ({CTES['lab']})", "lab AS (SELECT f.*, event_label AS label FROM flow f JOIN (SELECT date, ticker, event_label FROM ekop WHERE period = 'annual') USING (date, ticker))", 1)
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


def on_full_panel(text: str, panel: str, names: list[str], score: str) -> str:
    """A composed query over the factors ``names`` of ``panel`` (SQL) in place of ``zs``, with composites ``score``."""
    more = [n for n in needs(panel) if not re.search(rf"\b{n} AS \(", text)]
    add = ",\n".join([*(f"{n} AS ({CTES[n]})" for n in more), f"fullz AS MATERIALIZED ({panel})"])
    zs = f"zs AS ({CTES['zs']})"
    text = text.replace(zs, f"{zs},\n{add}", 1)
    new = {
        "score": f"SELECT date, ticker, round({score}, 9) AS score FROM fullz",
        "longz": "SELECT date, ticker, factor, value FROM (UNPIVOT fullz ON " + ", ".join(names) + " INTO NAME factor VALUE value)",
        "fz": "SELECT fold, sample, fullz.* EXCLUDE (close) FROM fullz JOIN spans ON date BETWEEN a AND b",
        "flong": "SELECT * FROM fz UNPIVOT INCLUDE NULLS (value FOR factor IN (" + ", ".join(names) + "))",
    }
    for n, body in new.items():
        text = text.replace(f"{n} AS ({CTES[n]})", f"{n} AS ({body})", 1)
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


def live_fit_sql(columns: str, body: str, before: list[str], days: str) -> str:
    """A query over ``livefit`` (date, ticker, pin): the fits of ``days``, which reads the expressions ``before``."""
    fits = [f"emdays AS ({days})", f"emkeys AS ({CTES['emkeys']} AND avg(b) >= 1 AND avg(s) >= 1)", *(f"{n} AS ({CTES[n]})" for n in ("em", "emfit")),
            "livefit AS (SELECT CAST(win AS DATE) AS date, ticker, alpha * mu / (alpha * mu + 2 * eps) AS pin FROM emfit)"]
    text = sql(columns, body + " WHERE 1 = 1")
    head, _, rest = text.rpartition("\nSELECT ")
    return head.replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + ",\n".join([*before, *fits]) + "\nSELECT " + rest.removesuffix(" WHERE 1 = 1")
