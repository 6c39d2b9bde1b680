"""Queries over performance, time-series and cross-section statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.windows import by, simple_return
from tickloom.operators import crosssection as xs
from tickloom.operators import factors, performance, stationarity, universe
from tickloom.operators.screener import Screen, screen_universe
from tickloom.plans import tables as t
from tickloom.plans.registry import query
from tickloom.plans.tables import oracle, present, r, rows
from tickloom.session import checkpointed

W = "OVER (PARTITION BY symbol ORDER BY event_time)"
NAMES = 12

EXTRA = {
    "rets": f"SELECT * FROM (SELECT symbol, event_time, session, close, volume, close / lag(close) {W} - 1 AS ret FROM panel_smooth) WHERE ret IS NOT NULL",
    "market": "SELECT event_time, avg(ret) AS market_ret FROM rets GROUP BY 1",
    "mret": "SELECT rets.*, market_ret FROM rets JOIN market USING (event_time)",
    "curve": f"""SELECT *, greatest(1.0, max(equity) {W}) AS peak FROM (
        SELECT symbol, event_time, ret, exp(sum(ln(1 + ret)) {W}) AS equity FROM rets)""",
}


def rets(spark, d):
    return performance.returns_of(t.panel_smooth(spark, d))


def mrets(spark, d):
    df = factors.add_market_return(t.panel_smooth(spark, d), rows(spark, d))
    return df.where(F.col("ret").isNotNull())


# ---- performance ----------------------------------------------------------------

_MOMENT = "avg((ret - m) ** {k}) / nullif(stddev_pop(ret) ** {k}, 0)"
PERF = f"""
    SELECT symbol, count(*) AS n_periods, exp(sum(ln(1 + ret))) - 1 AS total_return, stddev_samp(ret) * sqrt(252) AS volatility,
           avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe,
           avg(ret) / sqrt(avg(ret * ret) FILTER (ret < 0)) * sqrt(252) AS sortino,
           avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate,
           {_MOMENT.format(k=3)} AS skewness, {_MOMENT.format(k=4)} AS kurtosis, min(equity / peak - 1) AS max_drawdown
    FROM (SELECT *, avg(ret) OVER (PARTITION BY symbol) AS m FROM curve) GROUP BY symbol"""
EXTRA["perf"] = f"SELECT *, (total_return + 1) ** (252.0 / n_periods) - 1 AS cagr FROM ({PERF})"
_PERF_COLS = ["total_return", "volatility", "sharpe", "sortino", "hit_rate", "skewness", "kurtosis", "max_drawdown", "cagr"]


@query(
    "pf_summary",
    "PF2 PF3 PF4 PF5 PF6 PF7 PF8 PF9",
    oracle(
        f"""SELECT symbol, n_periods, {', '.join(f'{r(c)} AS {c}' for c in _PERF_COLS)},
            {r('cagr / abs(max_drawdown)')} AS calmar FROM perf""",
        EXTRA,
    ),
)
def summary(spark, d):
    return present(performance.summarise(rets(spark, d), ["symbol"]))


@query(
    "pf1_returns_drawdown",
    "PF1 PF4 W5",
    oracle(
        f"""SELECT symbol, strftime(event_time, '%Y-%m-%d') AS session, {r('ret')} AS ret, {r('equity')} AS equity,
            {r('equity / peak - 1')} AS drawdown FROM curve""",
        EXTRA,
    ),
)
def drawdowns(spark, d):
    df = performance.with_curve(rets(spark, d), ["symbol"])
    return present(df.select("symbol", F.to_date("event_time").alias("session"), "ret", "equity", "drawdown"))


@query(
    "pf10_tails",
    "PF10",
    oracle(
        f"""SELECT symbol, {r('max(v)')} AS var_5, {r('avg(ret) FILTER (ret <= v)')} AS cvar_5,
            {r('abs(quantile_cont(ret, 0.95)) / abs(quantile_cont(ret, 0.05))')} AS tail_ratio
        FROM (SELECT *, quantile_cont(ret, 0.05) OVER (PARTITION BY symbol) AS v FROM rets) GROUP BY symbol""",
        EXTRA,
    ),
)
def tails(spark, d):
    return present(performance.tails(rets(spark, d), ["symbol"]))


@query(
    "pf11_horizon_returns",
    "PF11",
    oracle(
        "SELECT symbol, "
        + ", ".join(
            r(f"max(close) FILTER (k = 0) / max(close) FILTER (k = {k}) - 1") + f' AS "ret_{n}"'
            for n, k in performance.HORIZONS.items()
        )
        + " FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY event_time DESC) - 1 AS k FROM panel_smooth) GROUP BY symbol"
    ),
)
def horizon_returns(spark, d):
    return present(performance.horizon_returns(t.panel_smooth(spark, d)))


_ACF = {
    k: f"covar_pop(ret, l{k}) / (sqrt(var_pop(CASE WHEN l{k} IS NOT NULL THEN ret END)) * sqrt(var_pop(l{k})))"
    for k in performance.LAGS
}


@query(
    "pf12_autocorrelation",
    "PF12",
    oracle(
        f"""SELECT symbol, {', '.join(f'{r(x)} AS acf_{k}' for k, x in _ACF.items())} FROM (
            SELECT symbol, ret, {', '.join(f'lag(ret, {k}) {W} AS l{k}' for k in performance.LAGS)} FROM rets) GROUP BY symbol""",
        EXTRA,
    ),
)
def autocorrelation(spark, d):
    return present(performance.autocorrelations(rets(spark, d)))


@query(
    "pf13_price_levels",
    "PF13",
    oracle(
        f"""SELECT symbol, count(*) AS observations, {r('min_by(close, event_time)')} AS first_close, {r('max_by(close, event_time)')} AS last_close,
            {r('max(close) FILTER (k <= 252)')} AS high_52w, {r('min(close) FILTER (k <= 252)')} AS low_52w, {r('avg(close * volume)', 4)} AS adv_value,
            {r('max_by(close, event_time) / max(close) FILTER (k <= 252) - 1')} AS off_high, {r('max_by(close, event_time) / max(close) - 1')} AS current_drawdown
        FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY event_time DESC) AS k FROM panel_smooth) GROUP BY symbol"""
    ),
)
def price_levels(spark, d):
    return present(performance.levels(t.panel_smooth(spark, d)), adv_value=4)


_VOLS = """
    SELECT symbol, stddev_samp(ret) AS realised_daily,
           sqrt(0.94 ** (max(n) - 20) * var_samp(ret) FILTER (i <= 20) + coalesce(sum(0.06 * 0.94 ** (n - i) * ret * ret) FILTER (i > 20), 0)) AS ewma_daily
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY event_time) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM rets) GROUP BY symbol"""


@query(
    "ts6_volatility",
    "TS6",
    oracle(
        f"""SELECT symbol, {r('realised_daily')} AS realised_daily, {r('ewma_daily')} AS ewma_daily, {r('realised_daily * sqrt(252)')} AS realised_vol,
            {r('ewma_daily * sqrt(252)')} AS ewma_vol, {r('least(0.15 / (ewma_daily * sqrt(252)), 3.0)')} AS scale FROM vols""",
        {**EXTRA, "vols": _VOLS},
    ),
)
def volatility(spark, d):
    df = performance.volatilities(rets(spark, d))
    return present(df.withColumn("scale", performance.vol_scale(F.col("ewma_vol"), 0.15)))


@query(
    "pf14_flags",
    "PF14",
    oracle(
        """SELECT symbol, CASE WHEN realised_daily <= 0 THEN 'unknown' WHEN ewma_daily / realised_daily > 1.3 THEN 'elevated'
             WHEN ewma_daily / realised_daily < 0.7 THEN 'compressed' ELSE 'normal' END AS vol_regime,
           volatility <= 1e-6 AS has_no_variance, sharpe > 2.5 OR volatility <= 1e-6 AS is_implausible,
           skewness < -0.5 AND kurtosis > 5 AS fat_left_tail FROM perf JOIN vols USING (symbol)""",
        {**EXTRA, "vols": _VOLS},
    ),
)
def smell_tests(spark, d):
    rs = rets(spark, d)
    df = performance.flags(performance.summarise(rs, ["symbol"]).join(performance.volatilities(rs), "symbol"))
    return present(df.select("symbol", "vol_regime", "has_no_variance", "is_implausible", "fat_left_tail"))


@query("pf15_security_profile", "PF15")
def profile(spark, d):
    return present(performance.profile(t.panel_smooth(spark, d)))


_F = "OVER (PARTITION BY symbol ORDER BY event_time ROWS BETWEEN 125 PRECEDING AND CURRENT ROW)"
ROLL = {
    **EXTRA,
    "roll": f"""SELECT symbol, event_time, avg(ret) {_F} / nullif(stddev_samp(ret) {_F}, 0) * sqrt(252) AS rolling_sharpe,
        stddev_samp(ret) {_F} * sqrt(252) AS rolling_volatility,
        covar_pop(ret, market_ret) {_F} / nullif(var_pop(market_ret) {_F}, 0) AS rolling_beta, count(ret) {_F} AS n FROM mret""",
}


@query(
    "w10_rolling_stats",
    "W10",
    oracle(
        f"""SELECT symbol, strftime(event_time, '%Y-%m-%d') AS session, {r('rolling_sharpe', 6)} AS rolling_sharpe,
            {r('rolling_volatility', 6)} AS rolling_volatility, {r('rolling_beta', 6)} AS rolling_beta FROM roll WHERE n = 126""",
        ROLL,
    ),
)
def rolling(spark, d):
    df = performance.rolling_stats(mrets(spark, d)).where("rolling_volatility IS NOT NULL")
    cols = ["rolling_sharpe", "rolling_volatility", "rolling_beta"]
    return present(df.select("symbol", F.to_date("event_time").alias("session"), *cols), 6)


@query(
    "w11_rolling_summary",
    "W11",
    oracle(
        f"""SELECT symbol, {r('max_by(rolling_sharpe, event_time)')} AS last, {r('min(rolling_sharpe)')} AS worst, {r('max(rolling_sharpe)')} AS best,
            {r('avg(CASE WHEN rolling_sharpe > 0 THEN 1.0 ELSE 0.0 END)')} AS fraction_positive FROM roll WHERE n = 126 GROUP BY symbol""",
        ROLL,
    ),
)
def rolling_summary(spark, d):
    df = performance.rolling_stats(rets(spark, d), market=None)
    return present(performance.rolling_summary(df, "rolling_sharpe"))


# ---- time series ------------------------------------------------------------------

_LAGS = range(2, 40)


@query(
    "ts1_hurst",
    "TS1",
    oracle(
        f"""SELECT symbol, {r('CASE WHEN n >= 60 AND count(*) >= 2 THEN least(greatest(regr_slope(ln(v), ln(k)) / 2, 0), 1) ELSE 0.5 END')} AS hurst FROM (
            {' UNION ALL '.join(f'SELECT symbol, {k} AS k, var_pop(close - l) AS v, count(*) AS n FROM (SELECT symbol, close, lag(close, {k}) {W} AS l FROM panel_smooth) GROUP BY symbol' for k in _LAGS)})
            WHERE v > 0 AND k < greatest(3, least(n // 10, 40)) GROUP BY symbol, n"""
    ),
)
def hurst(spark, d):
    return present(stationarity.hurst(t.panel_smooth(spark, d), ["symbol"]))


@query(
    "ts2_half_life",
    "TS2",
    oracle(
        f"""SELECT symbol, {r('CASE WHEN lam < 0 THEN -ln(2) / lam END', 4)} AS half_life FROM (
            SELECT symbol, regr_slope(close - l, l) AS lam FROM (SELECT symbol, close, lag(close) {W} AS l FROM panel_smooth) GROUP BY symbol)"""
    ),
)
def half_life(spark, d):
    return present(stationarity.half_life(t.panel_smooth(spark, d), ["symbol"]), 4)


@query("ts3_unit_root_tests", "TS3 TS4")
def unit_roots(spark, d):
    return present(stationarity.unit_root_tests(t.panel_smooth(spark, d), ["symbol"]), 6)


_STEPS = f"""SELECT symbol, d, x, lag(d) {W} AS z, n FROM (SELECT symbol, event_time, close - lag(close) {W} AS d, lag(close) {W} AS x,
    count(*) OVER (PARTITION BY symbol) AS n FROM panel_smooth)"""


@query(
    "ts3_fixed_order",
    "TS3",
    oracle(
        f"""SELECT symbol, CAST(n AS BIGINT) AS n, {r('b / sqrt((yy - b * xy - (xx * zy - xz * xy) / det * zy) / (m - 3) * zz / det)', 6)} AS statistic
        FROM (SELECT *, xx * zz - xz * xz AS det, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b FROM (
            SELECT symbol, max(n) AS n, count(*) AS m, regr_sxx(d, x) AS xx, regr_sxx(d, z) AS zz, regr_sxy(z, x) AS xz, regr_sxy(d, x) AS xy,
                regr_sxy(d, z) AS zy, regr_syy(d, x) AS yy FROM steps WHERE z IS NOT NULL GROUP BY symbol))""",
        {"steps": _STEPS},
    ),
)
def fixed_order(spark, d):
    return present(stationarity.adf_fixed(t.panel_smooth(spark, d), ["symbol"], 1), 6)


@query(
    "ts4_kpss",
    "TS4",
    oracle(
        """SELECT symbol, round(CASE WHEN s <= 0.347 THEN 0.10 WHEN s <= 0.463 THEN 0.10 + (s - 0.347) * (0.05 - 0.10) / (0.463 - 0.347)
            WHEN s <= 0.574 THEN 0.05 + (s - 0.463) * (0.025 - 0.05) / (0.574 - 0.463)
            WHEN s <= 0.739 THEN 0.025 + (s - 0.574) * (0.01 - 0.025) / (0.739 - 0.574) ELSE 0.01 END, 8) AS kpss_pvalue
        FROM (SELECT symbol, sum(c * c) / max(n) / max(l) AS s FROM (SELECT *, sum(e) OVER (PARTITION BY symbol ORDER BY t) AS c FROM ks) JOIN lr USING (symbol) GROUP BY symbol)""",
        {
            "ks": f"SELECT symbol, row_number() {W} - 1 AS t, count(*) OVER (PARTITION BY symbol) AS n, close - avg(close) OVER (PARTITION BY symbol) AS e FROM panel_smooth",
            "cv": "SELECT a.symbol, a.n, a.t - b.t AS i, sum(a.e * b.e) AS g FROM ks a JOIN ks b ON a.symbol = b.symbol AND b.t BETWEEN a.t - 120 AND a.t GROUP BY 1, 2, 3",
            "near": """SELECT symbol, n, sum(CASE WHEN i = 0 THEN g / n WHEN i <= floor(n ** (2.0 / 9)) THEN 2 * g / n ELSE 0 END) AS s0,
                sum(CASE WHEN i <= floor(n ** (2.0 / 9)) THEN i * 2 * g / n ELSE 0 END) AS s1 FROM cv GROUP BY 1, 2""",
            "bw": "SELECT symbol, least(floor(1.1447 * ((s1 / s0) ** 2) ** (1.0 / 3) * n ** (1.0 / 3)), n - 1) AS b FROM near",
            "lr": "SELECT symbol, sum(CASE WHEN i = 0 THEN g WHEN i <= b THEN 2 * g * (1 - i / (b + 1)) ELSE 0 END) AS l FROM cv JOIN bw USING (symbol) GROUP BY 1",
        },
    ),
)
def kpss(spark, d):
    return present(stationarity.unit_root_tests(t.panel_smooth(spark, d), ["symbol"]).drop("adf_pvalue"))


@query("ts5_stationarity", "TS5")
def stationary(spark, d):
    return present(stationarity.assess(t.panel_smooth(spark, d)), 6)


@query("ts7_garch", "TS7")
def garch(spark, d):
    return present(stationarity.garch(rets(spark, d)), 6)


_TOP = "SELECT symbol FROM panel_smooth GROUP BY symbol ORDER BY median(close * volume) DESC, symbol LIMIT {n}"
PAIRS = {
    "top5": _TOP.format(n=5),
    "pairs": "SELECT a.symbol AS l, b.symbol AS r FROM top5 a JOIN top5 b ON a.symbol < b.symbol",
    "pair_rows": """SELECT l, r, y.event_time, y.close AS y, x.close AS x FROM pairs JOIN panel_smooth y ON y.symbol = l
        JOIN panel_smooth x ON x.symbol = r AND x.event_time = y.event_time""",
}


def top_pairs(spark, d, k=5):
    """Every pair of the ``k`` most liquid names: the report's subject."""
    top = universe.most_liquid(t.panel_smooth(spark, d), k, "symbol").select("symbol")
    return top.select(F.col("symbol").alias("left")).join(top.select(F.col("symbol").alias("right")), F.col("left") < F.col("right"))


@query(
    "ts8_hedge_ratios",
    "TS8",
    oracle(
        f"""SELECT l AS "left", r AS "right", count(*) AS observations, {r('CASE WHEN count(*) >= 60 THEN regr_slope(y, x) ELSE 0 END')} AS hedge_ratio,
            {r('CASE WHEN count(*) >= 60 THEN regr_intercept(y, x) ELSE 0 END', 6)} AS intercept, {r('covar_pop(y, x) / (sqrt(var_pop(y)) * sqrt(var_pop(x)))')} AS correlation
        FROM pair_rows GROUP BY 1, 2""",
        PAIRS,
    ),
)
def hedges(spark, d):
    aligned = stationarity.pair_series(t.panel_smooth(spark, d), top_pairs(spark, d))
    return present(stationarity.hedge_ratios(aligned), intercept=6)


@query("ts8_cointegration", "TS8")
def cointegration(spark, d):
    return present(stationarity.engle_granger(t.panel_smooth(spark, d), top_pairs(spark, d)), 6)


_R = "OVER (PARTITION BY symbol ORDER BY event_time ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
REGIME = {
    **EXTRA,
    "trail": f"SELECT *, round(sum(market_ret) {_R}, 12) AS s, round(stddev_pop(market_ret) {_R}, 12) AS v, count(*) {_R} AS n FROM mret",
    "cut": "SELECT *, quantile_cont(v, 2.0 / 3) OVER (PARTITION BY symbol) AS c FROM trail WHERE n = 60",
    "labelled": """SELECT symbol, ret, 'bull' AS regime FROM cut WHERE s > 0 UNION ALL SELECT symbol, ret, 'bear' FROM cut WHERE s < 0
        UNION ALL SELECT symbol, ret, 'high_vol' FROM cut WHERE v >= c - 1e-13""",
}


@query(
    "ts9_regimes",
    "TS9",
    oracle(
        f"""SELECT symbol, regime, count(*) AS bars, {r('avg(ret)')} AS mean_return FROM labelled GROUP BY 1, 2 HAVING count(*) >= 60""",
        REGIME,
    ),
)
def regimes(spark, d):
    sliced = stationarity.regime_slices(mrets(spark, d), ["symbol"])
    return present(sliced.groupBy("symbol", "regime").agg(F.count(F.lit(1)).alias("bars"), F.avg("ret").alias("mean_return")))


# ---- cross-section -----------------------------------------------------------------

XS = {
    "top": _TOP.format(n=NAMES),
    "listed": "SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS idx FROM top",
    "xr": f"SELECT * FROM (SELECT symbol, event_time, close / lag(close) {W} - 1 AS ret FROM panel_smooth) JOIN listed USING (symbol) WHERE ret IS NOT NULL",
    "grid": "SELECT e.event_time, l.idx, coalesce(x.ret, 0) AS ret FROM (SELECT DISTINCT event_time FROM xr) e CROSS JOIN listed l LEFT JOIN xr x ON x.event_time = e.event_time AND x.idx = l.idx",
    "sized": "SELECT count(DISTINCT event_time) AS periods FROM grid",
    "centred": "SELECT event_time, idx, ret, ret - avg(ret) OVER (PARTITION BY idx) AS c FROM grid",
    "cells": """SELECT a.idx AS i, b.idx AS j, avg(a.c * b.c) AS s, avg(a.c * a.c * b.c * b.c) - avg(a.c * b.c) ** 2 AS phi,
        sqrt(avg(a.c * a.c)) AS di, sqrt(avg(b.c * b.c)) AS dj, covar_samp(a.ret, b.ret) AS sample
        FROM centred a JOIN centred b USING (event_time) GROUP BY 1, 2""",
    "aimed": """SELECT *, CASE WHEN i = j THEN s ELSE (SELECT avg(s / (di * dj)) FROM cells WHERE i <> j) * di * dj END AS target FROM cells""",
    "strength": "SELECT greatest(0, least(1, sum(phi) / (sum((target - s) ** 2) * (SELECT periods FROM sized)))) AS intensity FROM aimed",
    "shrunk": "SELECT i, j, intensity, intensity * target + (1 - intensity) * s AS value FROM aimed, strength",
    "diag": "SELECT i AS k, sqrt(value) AS d FROM shrunk WHERE i = j",
    "corr": "SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE value / (a.d * b.d) END AS value FROM shrunk JOIN diag a ON a.k = i JOIN diag b ON b.k = j",
}


def listed(spark, d):
    top = universe.most_liquid(t.panel_smooth(spark, d), NAMES, "symbol")
    return xs.chosen(top, NAMES)


def moments(spark, d):
    names = checkpointed(listed(spark, d))  # a row per chosen name, read twice
    returns = t.panel_smooth(spark, d).withColumn("ret", simple_return(window=by()))
    return checkpointed(xs.moment_table(returns, names))  # a row per pair, read more than once


@query("x1_sample_covariance", "X1", oracle(f"SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, {r('sample', 12)} AS value FROM cells", XS))
def covariance(spark, d):
    return present(xs.sample_covariance(moments(spark, d)), 12)


@query(
    "x2_ledoit_wolf",
    "X2",
    oracle(f"SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, {r('value', 12)} AS value, {r('intensity')} AS intensity FROM shrunk", XS),
)
def shrinkage(spark, d):
    return present(xs.ledoit_wolf(moments(spark, d)), value=12)


@query("x3_correlation", "X3", oracle(f"SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, {r('value')} AS value FROM corr", XS))
def correlation(spark, d):
    return present(xs.correlation(xs.ledoit_wolf(moments(spark, d))))


@query(
    "x4_effective_bets",
    "X4 X11",
    oracle(
        f"""SELECT count(*) FILTER (i = j) AS names, {r('(count(*) FILTER (i = j)) ** 2 / sum(value * value)')} AS effective_bets,
            {r('avg(value) FILTER (i <> j)')} AS mean_correlation FROM corr""",
        XS,
    ),
)
def effective(spark, d):
    return present(xs.effective_bets(xs.correlation(xs.ledoit_wolf(moments(spark, d)))))


CUT = 0.69


@query(
    "x6_clusters",
    "X6",
    oracle(
        f"""WITH RECURSIVE reach(i, j) AS (SELECT i, j FROM edges UNION SELECT reach.i, edges.j FROM reach JOIN edges ON reach.j = edges.i)
            SELECT CAST(i AS BIGINT) AS i, CAST(min(j) AS BIGINT) AS label FROM reach GROUP BY i""".replace("WITH RECURSIVE reach", "@@"),
        {**XS, "edges": f"SELECT i, j FROM corr WHERE i = j OR sqrt((1 - value) / 2) <= {CUT}"},
    ).replace("WITH", "WITH RECURSIVE", 1).replace("\n@@", ",\nreach"),
)
def clusters(spark, d):
    return present(xs.clusters(xs.correlation(xs.ledoit_wolf(moments(spark, d))), CUT))


@query(
    "x7_inverse_variance",
    "X7",
    oracle(f"SELECT CAST(i AS BIGINT) AS i, {r('(1 / value) / sum(1 / value) OVER ()')} AS weight FROM shrunk WHERE i = j", XS),
)
def inverse_variance(spark, d):
    return present(xs.inverse_variance(xs.ledoit_wolf(moments(spark, d))))


MERGES = {
    **XS,
    "edges": "SELECT row_number() OVER (ORDER BY round(sqrt(greatest((1 - value) / 2, 0)), 12), i, j) AS k, i, j FROM corr WHERE i < j",
    "merged": f"""SELECT 0::BIGINT AS k, {NAMES}::BIGINT AS born, range({NAMES}) AS ids, list_transform(range({NAMES}), lambda x: [x]) AS br
        UNION ALL SELECT m.k + 1, born + (ids[i + 1] <> ids[j + 1])::BIGINT,
            CASE WHEN ids[i + 1] = ids[j + 1] THEN ids ELSE list_transform(ids, lambda x: CASE WHEN x IN (ids[i + 1], ids[j + 1]) THEN born ELSE x END) END,
            CASE WHEN ids[i + 1] = ids[j + 1] THEN br ELSE list_transform(range({NAMES}), lambda x: CASE WHEN ids[x + 1] NOT IN (ids[i + 1], ids[j + 1])
                THEN br[x + 1] WHEN ids[i + 1] < ids[j + 1] THEN br[i + 1] || br[j + 1] ELSE br[j + 1] || br[i + 1] END) END
        FROM merged m JOIN edges e ON e.k = m.k + 1""",
    "leaves": "SELECT unnest(l) AS i, generate_subscripts(l, 1) - 1 AS position FROM (SELECT arg_max(br[1], k) AS l FROM merged)",
}


@query(
    "x9_leaf_order",
    "X9",
    # shrunk correlations of these names are all the same, those of the sample differ
    oracle("SELECT CAST(i AS INT) AS i, CAST(position AS INT) AS position FROM leaves", {**MERGES, "shrunk": "SELECT i, j, sample AS value FROM cells"}).replace("WITH", "WITH RECURSIVE", 1),
)
def leaf_order(spark, d):
    return xs.leaf_order(xs.spanning_tree(xs.correlation(xs.sample_covariance(moments(spark, d)))))


HALVES = {
    **MERGES,
    "inv": "SELECT l.i, position AS p, 1 / value AS s FROM leaves l JOIN shrunk c ON c.i = l.i AND c.j = l.i",
    "halves": """SELECT 0::BIGINT AS b, (SELECT count(*) FROM leaves) AS e, -1::BIGINT AS pb, -1::BIGINT AS pe UNION ALL
        SELECT CASE WHEN h = 0 THEN b ELSE b + (e - b) // 2 END, CASE WHEN h = 0 THEN b + (e - b) // 2 ELSE e END, b, e
        FROM halves, (SELECT unnest([0, 1]) AS h) WHERE e - b > 1""",
    "risk": """SELECT b, e, pb, pe, sum(value * x.s * y.s) / (sum(CASE WHEN x.i = y.i THEN x.s ELSE 0 END) ** 2) AS v FROM halves
        JOIN inv x ON x.p >= b AND x.p < e JOIN inv y ON y.p >= b AND y.p < e JOIN shrunk c ON c.i = x.i AND c.j = y.i GROUP BY 1, 2, 3, 4""",
    "share": """SELECT a.b, a.e, z.v / (a.v + z.v) AS f FROM risk a JOIN risk z ON z.pb = a.pb AND z.pe = a.pe AND z.b <> a.b WHERE a.pb >= 0""",
    "hrp": "SELECT i, exp(sum(ln(f))) AS w FROM inv JOIN share ON p >= b AND p < e GROUP BY i",
}


@query(
    "x9_hierarchical_weights",
    "X9",
    oracle(f"SELECT CAST(i AS INT) AS i, {r('w / sum(w) OVER ()')} AS weight_hrp FROM hrp", HALVES).replace("WITH", "WITH RECURSIVE", 1),
)
def hierarchical_weights(spark, d):
    cov = xs.ledoit_wolf(moments(spark, d))
    order = checkpointed(xs.leaf_order(xs.spanning_tree(xs.correlation(cov))))
    return present(xs.hierarchical_weights(cov, order))


@query("x8_risk_parity", "X5 X8 X9")
def risk_parity(spark, d):
    return present(xs.allocations(xs.ledoit_wolf(moments(spark, d))), 6)


@query(
    "x10_name_statistics",
    "X10",
    oracle(
        f"""SELECT symbol, count(*) AS sessions, {r('exp(sum(ln(1 + g.ret))) - 1')} AS total_return, {r('stddev_samp(g.ret) * sqrt(252)')} AS annual_volatility,
            {r('avg(g.ret) / stddev_samp(g.ret) * sqrt(252)')} AS sharpe, {r('covar_samp(g.ret, m) / var_samp(m)')} AS beta,
            {r('covar_samp(g.ret, m) / (stddev_samp(g.ret) * stddev_samp(m))')} AS correlation_to_market
        FROM grid g JOIN (SELECT event_time, avg(ret) AS m FROM grid GROUP BY 1) USING (event_time) JOIN listed USING (idx) GROUP BY symbol""",
        XS,
    ),
)
def name_statistics(spark, d):
    names = checkpointed(listed(spark, d))
    returns = t.panel_smooth(spark, d).withColumn("ret", simple_return(window=by()))
    return present(xs.name_statistics(xs.session_vectors(returns, names), names))


@query(
    "x11_diversification",
    "X11",
    oracle(
        f"""SELECT {r('sum(CASE WHEN i = j THEN a.w * sqrt(value) ELSE 0 END) / sqrt(sum(a.w * b.w * value))')} AS diversification_ratio
            FROM shrunk JOIN ivw a ON a.k = i JOIN ivw b ON b.k = j""",
        {**XS, "ivw": "SELECT i AS k, (1 / value) / sum(1 / value) OVER () AS w FROM shrunk WHERE i = j"},
    ),
)
def diversification(spark, d):
    cov = checkpointed(xs.ledoit_wolf(moments(spark, d)))
    return present(xs.diversification(cov, xs.inverse_variance(cov), "weight"))


@query("x12_cross_section", "X12 X5 X9 T2")
def cross_section(spark, d):
    panel = t.panel_smooth(spark, d)
    returns = panel.withColumn("ret", simple_return(window=by()))
    top = universe.most_liquid(panel, NAMES, "symbol")
    return present(xs.analyse(returns, top, NAMES).orderBy(F.desc("sharpe")), 6)


@query("a5_deep_screen", "A5 PF15 TS5")
def deep_screen(spark, d):
    screen = Screen(window=1900, min_adv=30000.0, min_bars=120, sort_by="momentum", limit=15)
    return present(screen_universe(t.panel_smooth(spark, d), screen), 6)
