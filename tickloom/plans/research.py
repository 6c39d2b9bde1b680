"""Queries over the factor library and its scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tickloom.functions import windows
from tickloom.operators import composite, factors, pit, scoring
from tickloom.operators.corpactions import COMMON_RATIOS
from tickloom.plans.registry import query
from tickloom.plans.tables import oracle, panel_raw, panel_smooth, panel_split, present, r, rows

ADV = 40000.0
YEAR_SHORT = 126
#: Least share of rows with a signal: rarer factors leave hardly a complete row to a composite.
LEAST_SIGNALS = 0.25
#: Factors that reach it on the given panel, as the SQL twins list them.
MIX = [f for f in factors.FACTORS if f not in ("residual_momentum", "seasonality")]
_mixes: dict[tuple[str, str], list[str]] = {}


# ---- SQL twins -------------------------------------------------------------

_W = "OVER (PARTITION BY symbol ORDER BY event_time)"


def lag(x: str, k: int) -> str:
    return f"lag({x}, {k}) {_W}"


def full(agg: str, x: str, n: int, need: int | None = None) -> str:
    frame = f"OVER (PARTITION BY symbol ORDER BY event_time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} >= {need or n} THEN {agg}({x}) {frame} END"


_RATIO = " ".join(f"WHEN abs(step - {x!r}::DOUBLE) / {x!r}::DOUBLE <= 0.02 THEN {x!r}::DOUBLE" for x in COMMON_RATIOS)

SPLIT_FACTORED = f"""
    SELECT *, exp(coalesce(sum(ln(f)) OVER (PARTITION BY symbol ORDER BY event_time
                 ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)) AS split_factor
    FROM (SELECT *, CASE WHEN step > 0 AND abs(step - 1) > 0.35
                         THEN (CASE {_RATIO} ELSE 1.0::DOUBLE END) ELSE 1.0::DOUBLE END AS f
          FROM (SELECT *, close / {lag('close', 1)} AS step FROM panel_split))"""

ADJUSTED = """
    SELECT symbol, instrument_id, event_time, open * split_factor AS open, high * split_factor AS high,
           low * split_factor AS low, close * split_factor AS close, volume / split_factor AS volume
    FROM split_factored"""


def prepared_sql(adv: float = ADV) -> str:
    return f"""
    SELECT * FROM (SELECT *, median(close * volume) OVER (PARTITION BY symbol) AS adv,
                          count(*) OVER (PARTITION BY symbol) AS bars
                   FROM adjusted WHERE contains(instrument_id, ':INE'))
    WHERE bars >= 273 AND adv >= {adv}"""


_BETA = {
    name: f"sum({x}) OVER (PARTITION BY symbol ORDER BY event_time ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) / 252"
    for name, x in {"mx": "x", "my": "y", "mxx": "x * x", "mxy": "x * y"}.items()
}
_DOWN = {
    name: full("avg", x, 252, 30)
    for name, x in {"dr": "d_r", "dm": "d_m", "drm": "d_rm", "dmm": "d_mm"}.items()
}

EXTRA = {
    "split_factored": SPLIT_FACTORED,
    "adjusted": ADJUSTED,
    "prepared": prepared_sql(),
    "with_ret": f"SELECT *, close / {lag('close', 1)} - 1 AS ret, close / {lag('close', 21)} - 1 AS monthly FROM prepared",
    "market": "SELECT event_time, avg(ret) AS market_ret FROM with_ret WHERE ret IS NOT NULL GROUP BY 1",
    "residuals": f"""
        SELECT *, CASE WHEN rn >= 252 AND mxx - mx * mx > 0 THEN (mxy - mx * my) / (mxx - mx * mx) END AS beta,
               ret - (CASE WHEN rn >= 252 AND mxx - mx * mx > 0 THEN (mxy - mx * my) / (mxx - mx * mx) END) * market_ret
                 AS residual
        FROM (SELECT *, row_number() {_W} AS rn, {_BETA['mx']} AS mx, {_BETA['my']} AS my,
                     {_BETA['mxx']} AS mxx, {_BETA['mxy']} AS mxy
              FROM (SELECT w.*, m.market_ret, coalesce(m.market_ret, 0) AS x, coalesce(w.ret, 0) AS y
                    FROM with_ret w LEFT JOIN market m USING (event_time)))""",
    "resid2": f"""
        SELECT *, {full('sum', 'residual', 231)} AS resid_231, {_DOWN['dr']} AS dr, {_DOWN['dm']} AS dm,
               {_DOWN['drm']} AS drm, {_DOWN['dmm']} AS dmm
        FROM (SELECT *, CASE WHEN market_ret < 0 THEN ret END AS d_r,
                     CASE WHEN market_ret < 0 THEN market_ret END AS d_m,
                     CASE WHEN market_ret < 0 THEN ret * market_ret END AS d_rm,
                     CASE WHEN market_ret < 0 THEN market_ret * market_ret END AS d_mm FROM residuals)""",
}

FACTOR_SQL = {
    "momentum_12_1": f"{lag('close', 21)} / {lag('close', 252)} - 1",
    "momentum_6_1": f"{lag('close', 21)} / {lag('close', 126)} - 1",
    "momentum_1m": f"close / {lag('close', 21)} - 1",
    "momentum_12_7": f"{lag('close', 126)} / {lag('close', 252)} - 1",
    "reversal_1d": f"-(close / {lag('close', 1)} - 1)",
    "reversal_5d": f"-(close / {lag('close', 5)} - 1)",
    "volatility_60": f"-({full('stddev_samp', 'ret', 60)})",
    "max_return": f"-({full('max', 'ret', 21)})",
    "high_52w_proximity": f"close / ({full('max', 'close', 252)})",
    "seasonality": f"({lag('monthly', YEAR_SHORT)} + {lag('monthly', 2 * YEAR_SHORT)} + {lag('monthly', 3 * YEAR_SHORT)}) / 3",
    "volume_shock": f"volume / ({full('avg', 'volume', 21)})",
    "illiquidity": f"-({full('avg', '(abs(ret) / (close * volume))', 21)})",
    "beta": "-beta",
    "residual_momentum": lag("resid_231", 21),
    "idiosyncratic_vol": f"-({full('stddev_samp', 'residual', 60)})",
    "downside_beta": "-(CASE WHEN dmm - dm * dm > 0 THEN (drm - dr * dm) / (dmm - dm * dm) END)",
}
FWD_SQL = ", ".join(f"lead(close, {h}) {_W} / close - 1 AS fwd_{h}" for h in (1, 5, 21, 63))


def factor_source(name: str) -> str:
    return "resid2" if name in factors.RESIDUAL_FACTORS else "with_ret"


def scored_sql(name: str) -> str:
    return f"""SELECT event_time, symbol, signal, fwd_1, fwd_5, fwd_21, fwd_63
        FROM (SELECT *, {FACTOR_SQL[name]} AS signal, {FWD_SQL} FROM {factor_source(name)})
        WHERE signal IS NOT NULL"""


def table_sql(names: list[str]) -> str:
    cols = ", ".join(f"{FACTOR_SQL[n]} AS {n}" for n in names)
    source = "resid2" if any(n in factors.RESIDUAL_FACTORS for n in names) else "with_ret"
    return f"SELECT event_time, symbol, {cols}, {FWD_SQL} FROM {source}"


def avg_rank(col: str, session: str) -> str:
    return (
        f"(rank() OVER (PARTITION BY {session} ORDER BY {col}) + "
        f"(count(*) OVER (PARTITION BY {session}, {col}) - 1) / 2.0)"
    )


def rank_corr_sql(a: str, b: str) -> str:
    return (
        f"(count(*) * sum({a} * {b}) - sum({a}) * sum({b})) / nullif("
        f"sqrt(count(*) * sum({a} * {a}) - sum({a}) * sum({a})) * "
        f"sqrt(count(*) * sum({b} * {b}) - sum({b}) * sum({b})), 0)"
    )


def corr_sql(a: str, b: str) -> str:
    return f"covar_pop({a}, {b}) / nullif(sqrt(var_pop({a})) * sqrt(var_pop({b})), 0)"


def session_ic_sql(scored: str, fwd: str, keys: str = "", min_names: int = 20) -> str:
    session = f"{keys}event_time"
    return f"""SELECT * FROM (
        SELECT {session}, {rank_corr_sql('rs', 'rf')} AS ic, count(*) AS names
        FROM (SELECT {session}, CAST({avg_rank('signal', session)} AS DOUBLE) AS rs,
                     CAST({avg_rank(fwd, session)} AS DOUBLE) AS rf
              FROM {scored} WHERE signal IS NOT NULL AND {fwd} IS NOT NULL)
        GROUP BY {session}) WHERE names >= {min_names} AND ic IS NOT NULL"""


def _two(expr: str) -> str:
    return r(f"coalesce(CASE WHEN count(*) >= 2 THEN {expr} END, 0)")


IC_STATS = f"""{_two('avg(ic)')} AS mean, {_two('stddev_samp(ic)')} AS std,
    {_two('avg(ic) / nullif(stddev_samp(ic), 0)')} AS information_ratio,
    {_two('avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(*))')} AS t_stat,
    {_two('avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END)')} AS hit_rate, count(*) AS sessions"""


# ---- panels ----------------------------------------------------------------


def prepared(spark: SparkSession, d: str) -> DataFrame:
    return pit.prepare_panel(panel_split(spark, d), min_adv=ADV)


def scored(spark: SparkSession, d: str, name: str) -> DataFrame:
    return factors.build_factor(prepared(spark, d), name, year=YEAR_SHORT, sessions=rows(spark, d))


def table(spark: SparkSession, d: str, names) -> DataFrame:
    return factors.factor_table(prepared(spark, d), tuple(names), year=YEAR_SHORT, sessions=rows(spark, d))


def mixed(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """Factors with enough signals on the whole panel, and their table."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _mixes:
        _mixes[key] = composite.covered_factors(table(spark, d, factors.FACTORS), list(factors.FACTORS), LEAST_SIGNALS)
    return table(spark, d, _mixes[key]), _mixes[key]


# ---- flagship --------------------------------------------------------------


def reversal_ic(spark: SparkSession, d: str, min_names: int = 20) -> DataFrame:
    """IC of one-day reversal for the next five sessions on the raw panel."""
    long = factors.add_forward_returns(factors.with_factors(panel_raw(spark, d), ("reversal_1d",)), (5,))
    signal = long.select("event_time", "symbol", F.col("reversal_1d").alias("signal"), "fwd_5")
    return present(scoring.information_coefficient(signal, "fwd_5", min_names=min_names, rows=rows(spark, d)))


query(
    "r1_reversal_ic",
    "S8 P1 W1 W6 K5 K18 R1",
    oracle(
        f"SELECT {IC_STATS} FROM ({session_ic_sql('raw_scored', 'fwd_5')})",
        {
            "raw_scored": f"""SELECT event_time, symbol, -(close / {lag('close', 1)} - 1) AS signal,
                lead(close, 5) {_W} / close - 1 AS fwd_5 FROM panel_raw"""
        },
    ),
)(reversal_ic)

# ---- panel preparation and the sixteen factors ------------------------------


@query(
    "p6_prepared_panel",
    "P2 P3 P4 P5 P6 C4",
    oracle(
        f"""SELECT symbol, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time,
            {r('close')} AS close, {r('volume')} AS volume FROM windowed_prepared""",
        {
            **EXTRA,
            "windowed": """SELECT * FROM panel_split WHERE event_time IN
                (SELECT DISTINCT event_time FROM panel_split ORDER BY 1 DESC LIMIT 1900)""",
            "w_factored": SPLIT_FACTORED.replace("panel_split", "windowed"),
            "w_adjusted": ADJUSTED.replace("split_factored", "w_factored"),
            "windowed_prepared": prepared_sql().replace("adjusted", "w_adjusted"),
        },
    ),
)
def prepared_panel(spark, d):
    df = pit.prepare_panel(panel_split(spark, d), window=1900, min_adv=ADV)
    return present(df.select("symbol", "event_time", "close", "volume"))


@query(
    "p4_liquid_names",
    "P3 P4 P5 J7",
    oracle(
        """SELECT symbol, count(*) AS bars FROM panel_smooth WHERE contains(instrument_id, ':INE')
           GROUP BY symbol HAVING median(close * volume) >= 42000 AND count(*) >= 450"""
    ),
)
def liquid(spark, d):
    panel = panel_smooth(spark, d).where(F.col("instrument_id").contains(pit.COMPANY_MARKER))
    kept = pit.long_enough(pit.liquid_names(panel, 42000.0), 450)
    return present(kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars")))


def _register_factor(number: int, name: str) -> None:
    @query(
        f"k{number}_{name}",
        f"K{number}",
        oracle(
            f"""SELECT strftime(event_time, '%Y-%m-%d') AS session, symbol, {r('signal')} AS signal,
                {r('fwd_5')} AS fwd_5 FROM ({scored_sql(name)})""",
            EXTRA,
        ),
    )
    def run(spark, d):
        df = scored(spark, d, name)
        return present(df.select(F.to_date("event_time").alias("session"), "symbol", "signal", "fwd_5"))


for _i, _name in enumerate(factors.FACTORS, 1):
    _register_factor(_i, _name)


@query(
    "k17_market_residuals",
    "J3 K17 A9",
    oracle(
        f"""SELECT strftime(event_time, '%Y-%m-%d') AS session, symbol, {r('market_ret')} AS market_ret,
            {r('beta')} AS beta, {r('residual')} AS residual FROM residuals WHERE beta IS NOT NULL""",
        EXTRA,
    ),
)
def residuals(spark, d):
    df = factors.add_residuals(prepared(spark, d), sessions=rows(spark, d)).where("beta IS NOT NULL")
    return present(df.select(F.to_date("event_time").alias("session"), "symbol", "market_ret", "beta", "residual"))


@query(
    "k18_forward_returns",
    "K18 W1",
    oracle(
        f"""SELECT symbol, {', '.join(f"count(fwd_{h}) AS n_{h}, {r(f'avg(fwd_{h})')} AS mean_{h}" for h in (1, 5, 21, 63))}
            FROM (SELECT symbol, {FWD_SQL} FROM prepared) GROUP BY symbol""",
        EXTRA,
    ),
)
def forward_returns(spark, d):
    df = factors.add_forward_returns(prepared(spark, d))
    cells = [c for h in factors.HORIZONS for c in (F.count(f"fwd_{h}").alias(f"n_{h}"), F.avg(f"fwd_{h}").alias(f"mean_{h}"))]
    return present(df.groupBy("symbol").agg(*cells))


# ---- scoring ---------------------------------------------------------------

SCORED5 = {**EXTRA, "scored": scored_sql("reversal_5d")}


@query(
    "r2_quantile_returns",
    "W7 R2 R3",
    oracle(
        f"""SELECT CAST(bucket + 1 AS BIGINT) AS quantile, {r('avg(fwd_21)')} AS mean_forward_return, count(*) AS names
        FROM (SELECT fwd_21, (row_number() OVER (PARTITION BY event_time ORDER BY signal, symbol) - 1) * 5
                     // count(*) OVER (PARTITION BY event_time) AS bucket
              FROM scored WHERE fwd_21 IS NOT NULL) GROUP BY bucket""",
        SCORED5,
    ),
)
def quantiles(spark, d):
    return present(scoring.quantile_returns(scored(spark, d, "reversal_5d"), "fwd_21", rows=rows(spark, d)))


@query(
    "r3_spread_shape",
    "R3",
    oracle(
        f"""SELECT {r('max_by(m, q) - min_by(m, q)')} AS spread, bool_and(coalesce(m >= p, true)) AS is_monotonic
        FROM (SELECT q, m, lag(m) OVER (ORDER BY q) AS p FROM (
          SELECT bucket AS q, avg(fwd_21) AS m
          FROM (SELECT fwd_21, (row_number() OVER (PARTITION BY event_time ORDER BY signal, symbol) - 1) * 5
                     // count(*) OVER (PARTITION BY event_time) AS bucket
              FROM scored WHERE fwd_21 IS NOT NULL) GROUP BY bucket))""",
        SCORED5,
    ),
)
def spread_shape(spark, d):
    q = scoring.quantile_returns(scored(spark, d, "reversal_5d"), "fwd_21", rows=rows(spark, d))
    return present(scoring.spread_and_shape(q))


TURNOVER = """SELECT 2 * avg(abs(pct - prev)) AS turnover FROM (
    SELECT pct, lag(pct) OVER (PARTITION BY symbol ORDER BY event_time) AS prev FROM (
      SELECT symbol, event_time, (row_number() OVER (PARTITION BY event_time ORDER BY signal, symbol) - 1)
             / CAST(greatest(count(*) OVER (PARTITION BY event_time) - 1, 1) AS DOUBLE) AS pct FROM scored))"""


@query("r4_signal_turnover", "R4", oracle(f"SELECT {r('turnover')} AS turnover FROM ({TURNOVER})", SCORED5))
def turnover(spark, d):
    return present(scoring.signal_turnover(scored(spark, d, "reversal_5d"), rows=rows(spark, d)))


@query(
    "r5_ic_by_horizon",
    "R1 R5",
    oracle(
        f"SELECT CAST(horizon AS BIGINT) AS horizon, {IC_STATS} FROM ({session_ic_sql('long', 'fwd', 'horizon, ')}) GROUP BY horizon",
        {
            **SCORED5,
            "long": " UNION ALL ".join(f"SELECT event_time, symbol, signal, {h} AS horizon, fwd_{h} AS fwd FROM scored" for h in (1, 5, 21, 63)),
        },
    ),
)
def horizons(spark, d):
    df = scoring.ic_by_horizon(scored(spark, d, "reversal_5d"), factors.HORIZONS, rows=rows(spark, d))
    return present(df)


@query(
    "w12_rolling_ic",
    "W2 W12",
    oracle(
        f"""SELECT strftime(event_time, '%Y-%m-%d %H:%M:%S') AS "end", {r('m')} AS rolling_ic, CAST(252 AS BIGINT) AS sessions
        FROM (SELECT event_time, avg(ic) OVER w AS m, count(*) OVER w AS n FROM ({session_ic_sql('scored', 'fwd_5', '', 10)})
              WINDOW w AS (ORDER BY event_time ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)) WHERE n = 252""",
        SCORED5,
    ),
)
def rolling(spark, d):
    return present(scoring.rolling_ic(scored(spark, d, "reversal_5d"), "fwd_5", min_names=10, rows=rows(spark, d)))


ROUND_TRIP = 0.0033


@query(
    "r6_cost_verdict",
    "R1 R2 R3 R4 R6",
    oracle(
        f"""SELECT factor, mean, std, information_ratio, t_stat, hit_rate, sessions, {r('spread')} AS spread, is_monotonic,
            {r('turnover')} AS turnover, {r('least(1.0, turnover * 21)')} AS per_rebalance,
            {r(f'spread - least(1.0, turnover * 21) * {ROUND_TRIP}')} AS net_spread,
            spread - least(1.0, turnover * 21) * {ROUND_TRIP} > 0 AS survives
        FROM (SELECT factor, {IC_STATS} FROM ({session_ic_sql('long', 'fwd_21', 'factor, ')}) GROUP BY factor)
        JOIN (SELECT factor, max_by(m, q) - min_by(m, q) AS spread, bool_and(coalesce(m >= p, true)) AS is_monotonic
              FROM (SELECT *, lag(m) OVER (PARTITION BY factor ORDER BY q) AS p FROM (
                SELECT factor, bucket AS q, avg(fwd_21) AS m FROM (
                  SELECT factor, fwd_21, (row_number() OVER (PARTITION BY factor, event_time ORDER BY signal, symbol) - 1) * 5
                     // count(*) OVER (PARTITION BY factor, event_time) AS bucket
                  FROM long WHERE fwd_21 IS NOT NULL) GROUP BY 1, 2)) GROUP BY factor) USING (factor)
        JOIN (SELECT factor, 2 * avg(abs(pct - prev)) AS turnover FROM (
                SELECT factor, pct, lag(pct) OVER (PARTITION BY factor, symbol ORDER BY event_time) AS prev FROM (
                  SELECT factor, symbol, event_time,
                     (row_number() OVER (PARTITION BY factor, event_time ORDER BY signal, symbol) - 1)
                     / CAST(greatest(count(*) OVER (PARTITION BY factor, event_time) - 1, 1) AS DOUBLE) AS pct FROM long))
              GROUP BY factor) USING (factor)""",
        {
            **EXTRA,
            "wide": table_sql(list(factors.FACTORS)),
            "long": " UNION ALL ".join(f"SELECT '{n}' AS factor, event_time, symbol, {n} AS signal, fwd_21 FROM wide WHERE {n} IS NOT NULL" for n in factors.FACTORS),
        },
    ),
)
def verdicts(spark, d):
    wide = table(spark, d, factors.FACTORS)
    return present(scoring.factor_reports(wide, list(factors.FACTORS), 21, ROUND_TRIP, rows=rows(spark, d)))


@query(
    "r7_all_factors",
    "R7 K1 K2 K3 K4 K5 K6 K7 K8 K9 K10 K11 K12 K13 K14 K15 K16",
    oracle(
        f"SELECT factor, {IC_STATS} FROM ({session_ic_sql('long', 'fwd_21', 'factor, ', 10)}) GROUP BY factor",
        {
            **EXTRA,
            "wide": table_sql(list(factors.FACTORS)),
            "long": " UNION ALL ".join(f"SELECT '{n}' AS factor, event_time, symbol, {n} AS signal, fwd_21 FROM wide WHERE {n} IS NOT NULL" for n in factors.FACTORS),
        },
    ),
)
def every_factor(spark, d):
    wide = table(spark, d, factors.FACTORS)
    return present(scoring.factor_ics(wide, list(factors.FACTORS), "fwd_21", 10, rows(spark, d)))


# ---- composites ------------------------------------------------------------

@query(
    "w3_falling_market_means",
    "W3 J3",
    oracle(
        f"""SELECT symbol, strftime(event_time, '%Y-%m-%d') AS session, {r('mean_down')} AS mean_down FROM (
            SELECT symbol, event_time, {full('avg', 'd_r', 252, 30)} AS mean_down FROM (
                SELECT s.symbol, s.event_time, CASE WHEN market_ret < 0 THEN ret END AS d_r FROM smooth_ret s LEFT JOIN smooth_market USING (event_time)))""",
        {
            "smooth_ret": f"SELECT symbol, event_time, close / {lag('close', 1)} - 1 AS ret FROM panel_smooth",
            "smooth_market": "SELECT event_time, avg(ret) AS market_ret FROM smooth_ret WHERE ret IS NOT NULL GROUP BY 1",
        },
    ),
)
def falling_market_means(spark, d):
    df = factors.add_market_return(panel_smooth(spark, d), rows(spark, d))
    down = F.when(F.col("market_ret") < 0, F.col("ret"))
    means = windows.rolling(F.avg, down, 252, min_samples=30).alias("mean_down")
    return present(df.select("symbol", F.to_date("event_time").alias("session"), means))


@query(
    "p12_signals_alone",
    "P12 P3",
    oracle(f"SELECT strftime(event_time, '%Y-%m-%d') AS session, symbol, {r('signal')} AS signal FROM ({scored_sql('reversal_5d')})", EXTRA),
)
def signals_alone(spark, d):
    """What a strategy may see of a scored panel: it is refused while forward returns are in it."""
    df = scored(spark, d, "reversal_5d")
    blind = pit.refuse_forward_columns(df.drop(*[c for c in df.columns if c.startswith("fwd_")]))
    return present(blind.select(F.to_date("event_time").alias("session"), "symbol", "signal"))


SESSION = "event_time"
_COMPLETE = " AND ".join(f"{n} IS NOT NULL" for n in MIX)
COMPLETE = {**EXTRA, "wide": table_sql(MIX), "complete": f"SELECT * FROM wide WHERE {_COMPLETE}"}
_RANKED = f"SELECT {', '.join(f'CAST({avg_rank(n, SESSION)} AS DOUBLE) AS {n}' for n in MIX)} FROM complete"
PAIRS_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {corr_sql(a, b)} AS rho, count(*) AS observations FROM ranked"
    for i, a in enumerate(MIX)
    for b in MIX[i:]
)
RANKED = {**COMPLETE, "ranked": _RANKED}


@query(
    "r8_factor_overlap",
    "J4 R8",
    oracle(f'SELECT "left", "right", {r("rho")} AS rho, observations FROM ({PAIRS_SQL})', RANKED),
)
def overlap(spark, d):
    return present(composite.factor_correlations(*mixed(spark, d), rows(spark, d)))


@query(
    "r8_effective_factors",
    "R8 X4",
    oracle(
        f"""SELECT CAST({len(MIX)} AS BIGINT) AS factors, {r(f'CAST({len(MIX) ** 2} AS DOUBLE) / sum(CASE WHEN "left" = "right" THEN rho * rho ELSE 2 * rho * rho END)')} AS effective_factors
            FROM ({PAIRS_SQL})""",
        RANKED,
    ),
)
def effective(spark, d):
    pairs = composite.factor_correlations(*mixed(spark, d), rows(spark, d))
    return present(composite.overlap_summary(pairs).drop("first_component"))


@query("r8_first_component", "R8 X4")
def first_component(spark, d):
    pairs = composite.factor_correlations(*mixed(spark, d), rows(spark, d))
    return present(composite.overlap_summary(pairs).select("first_component"))


@query(
    "r8_redundant_pairs",
    "R8",
    oracle(f'SELECT "left", "right", {r("rho")} AS rho FROM ({PAIRS_SQL}) WHERE "left" <> "right" AND abs(rho) >= 0.05', RANKED),
)
def redundant(spark, d):
    pairs = composite.factor_correlations(*mixed(spark, d), rows(spark, d))
    return present(composite.redundant_pairs(pairs, 0.05))


@query(
    "r8_skipped_factors",
    "R8",
    oracle(
        " UNION ALL ".join(f"SELECT '{n}' AS factor, count({n}) AS signals, count({n}) = 0 AS skipped FROM wide" for n in factors.FACTORS),
        {**EXTRA, "wide": table_sql(list(factors.FACTORS))},
    ),
)
def skipped(spark, d):
    counts = composite.signal_counts(table(spark, d, factors.FACTORS), list(factors.FACTORS))
    return present(counts.withColumn("skipped", F.col("signals") == 0).drop("rows"))


Z_SQL = "SELECT event_time, symbol, fwd_1, fwd_5, fwd_21, fwd_63, " + ", ".join(
    f"greatest(least(CASE WHEN stddev_samp({n}) OVER s > 0 THEN ({n} - avg({n}) OVER s) / stddev_samp({n}) OVER s ELSE 0 END, 3.0), -3.0) AS {n}"
    for n in MIX
) + " FROM complete WINDOW s AS (PARTITION BY event_time)"


@query(
    "w8_session_zscores",
    "W8",
    oracle(
        f"SELECT strftime(event_time, '%Y-%m-%d') AS session, symbol, {', '.join(f'{r(n)} AS {n}' for n in MIX)} FROM zscored",
        {**COMPLETE, "zscored": Z_SQL},
    ),
)
def zscores(spark, d):
    wide, names = mixed(spark, d)
    df = composite.zscore_by_session(composite.complete_rows(wide, names), names, rows(spark, d))
    return present(df.select(F.to_date("event_time").alias("session"), "symbol", *names))


def _gram_schmidt_ctes(names: list[str]) -> dict[str, str]:
    """Modified Gram-Schmidt, one step per factor, as stacked windows."""
    out, source = {}, "zscored"
    for i, name in enumerate(names):
        cols = []
        for j in range(i + 1, len(names)):
            x = names[j]
            cols.append(
                f"{x} - coalesce(sum({x} * {name}) OVER s / nullif(sum({name} * {name}) OVER s, 0), 0) * {name} AS {x}"
            )
        kept = ", ".join(names[: i + 1])
        body = ", ".join([kept, *cols])
        out[f"gs{i}"] = f"SELECT event_time, symbol, fwd_21, {body} FROM {source} WINDOW s AS (PARTITION BY event_time)"
        source = f"gs{i}"
    scaled = ", ".join(
        f"CASE WHEN stddev_pop({n}) OVER s > 1e-12 THEN {n} / stddev_pop({n}) OVER s ELSE {n} END AS {n}" for n in names
    )
    raw = ", ".join(names)
    out["ortho"] = f"""
        SELECT event_time, symbol, fwd_21, {scaled} FROM (SELECT *, count(*) OVER (PARTITION BY event_time) AS n_session FROM {source})
          WHERE n_session >= 20 WINDOW s AS (PARTITION BY event_time)
        UNION ALL
        SELECT event_time, symbol, fwd_21, {raw} FROM (SELECT *, count(*) OVER (PARTITION BY event_time) AS n_session FROM zscored)
          WHERE n_session < 20"""
    return out


ORTHO = {**COMPLETE, "zscored": Z_SQL, **_gram_schmidt_ctes(MIX)}


@query(
    "r9_orthogonalised",
    "R9",
    oracle(
        f"SELECT strftime(event_time, '%Y-%m-%d') AS session, symbol, {', '.join(f'{r(n, 6)} AS {n}' for n in MIX)} FROM ortho",
        ORTHO,
    ),
)
def orthogonal(spark, d):
    n = rows(spark, d)
    wide, names = mixed(spark, d)
    df = composite.zscore_by_session(composite.complete_rows(wide, names), names, n)
    df = composite.orthogonalise(df, names, sessions=n)
    return present(df.select(F.to_date("event_time").alias("session"), "symbol", *names), 6)


WEIGHTS = {
    **ORTHO,
    "long": " UNION ALL ".join(f"SELECT '{n}' AS factor, event_time, symbol, {n} AS signal, fwd_21 FROM complete" for n in MIX),
    "scores": f"""SELECT factor, greatest(avg(ic), 0) AS score FROM ({session_ic_sql('long', 'fwd_21', 'factor, ')}) GROUP BY factor""",
    "weights": f"""SELECT factor, CASE WHEN sum(score) OVER () > 0 THEN score / sum(score) OVER () ELSE 1.0 / {len(MIX)} END AS weight FROM scores""",
}


@query("r10_ic_weights", "R10", oracle(f"SELECT factor, {r('weight')} AS weight FROM weights", WEIGHTS))
def weights(spark, d):
    wide, names = mixed(spark, d)
    found = composite.ic_weights(composite.complete_rows(wide, names), names, 21, rows=rows(spark, d))
    return present(found.unpivot([], names, "factor", "weight"))


_COMPOSITE = " + ".join(f"{n} * (SELECT weight FROM weights WHERE factor = '{n}')" for n in MIX)


@query(
    "r11_composite",
    "R11",
    oracle(
        f"SELECT strftime(event_time, '%Y-%m-%d') AS session, symbol, {r(_COMPOSITE, 6)} AS signal, {r('fwd_21', 6)} AS fwd_21 FROM ortho",
        WEIGHTS,
    ),
)
def combined(spark, d):
    n = rows(spark, d)
    # read by the weights and by the scores; lost blocks are recomputed
    wide, names = mixed(spark, d)
    df = composite.combine_factors(wide.persist(StorageLevel.DISK_ONLY), names, 21, rows=n, sessions=n)
    return present(df.select(F.to_date("event_time").alias("session"), "symbol", "signal", "fwd_21"), 6)
