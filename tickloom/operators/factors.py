"""The factor library: sixteen signals, high is preferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.stats import finite
from tickloom.functions.windows import by, rolling, running_sums, simple_return, trailing
from tickloom.sizing import small

MONTH, HALF, YEAR = 21, 126, 252
HORIZONS = (1, 5, 21, 63)
BETA_WINDOW = 252
DOWN_SAMPLES = 30
SEASON_YEARS = 3


def _price_factors(year: int) -> dict[str, Column]:
    w, close = by(), F.col("close")
    ago = lambda k: F.lag("close", k).over(w)
    seasons = [F.lag("_monthly", year * (i + 1)).over(w) for i in range(SEASON_YEARS)]
    return {
        "momentum_12_1": ago(MONTH) / ago(YEAR) - 1,
        "momentum_6_1": ago(MONTH) / ago(HALF) - 1,
        "momentum_1m": close / ago(MONTH) - 1,
        "momentum_12_7": ago(HALF) / ago(YEAR) - 1,
        "reversal_1d": -(close / ago(1) - 1),
        "reversal_5d": -(close / ago(5) - 1),
        "volatility_60": -rolling(F.stddev_samp, F.col("ret"), 60),
        "max_return": -rolling(F.max, F.col("ret"), MONTH),
        "high_52w_proximity": close / rolling(F.max, close, YEAR),
        "seasonality": sum(seasons[1:], seasons[0]) / SEASON_YEARS,
        "volume_shock": F.try_divide(F.col("volume"), rolling(F.avg, F.col("volume"), MONTH)),
        "illiquidity": -rolling(F.avg, F.col("_impact"), MONTH),
    }


def _residual_factors() -> dict[str, Column]:
    n, k = F.col("_down_n_w"), F.col("_down_k_w")
    # the market sums also hold down sessions on which the name has no return
    share = F.try_divide
    mean_down, mean_market = share(F.col("_down_r_w"), n), share(F.col("_down_m_w"), k)
    cov = share(F.col("_down_rm_w"), n) - mean_down * mean_market
    var = share(F.col("_down_mm_w"), k) - mean_market * mean_market
    return {
        "beta": -F.col("beta"),
        "residual_momentum": F.lag("_resid_231", MONTH).over(by()),
        "idiosyncratic_vol": -rolling(F.stddev_samp, F.col("residual"), 60),
        "downside_beta": -F.when((n >= DOWN_SAMPLES) & (var > 0), cov / var),
    }


PRICE_FACTORS = (
    "momentum_12_1", "momentum_6_1", "momentum_1m", "momentum_12_7", "reversal_1d",
    "reversal_5d", "volatility_60", "max_return", "high_52w_proximity", "seasonality",
    "volume_shock", "illiquidity",
)
RESIDUAL_FACTORS = ("beta", "residual_momentum", "idiosyncratic_vol", "downside_beta")
FACTORS = PRICE_FACTORS + RESIDUAL_FACTORS


def add_market_return(panel: DataFrame, sessions: int | None = None) -> DataFrame:
    """Attach each name's return and the equal-weight return of the session."""
    framed = panel if "ret" in panel.columns else panel.withColumn("ret", simple_return())
    market = framed.where(F.col("ret").isNotNull()).groupBy("event_time").agg(
        F.avg("ret").alias("market_ret")
    )
    return framed.join(small(market, sessions, 32), "event_time", "left")


def add_residuals(panel: DataFrame, window: int = BETA_WINDOW, sessions: int | None = None) -> DataFrame:
    """Attach trailing beta and the residual return.

    Missing returns count as zero inside the regression.  Prefix sums make the
    cost independent of the window; returns are small, so the differences keep
    their precision.
    """
    x, y = F.coalesce("market_ret", F.lit(0.0)), F.coalesce("ret", F.lit(0.0))
    df = running_sums(
        add_market_return(panel, sessions), {"_sx": x, "_sy": y, "_sxx": x * x, "_sxy": x * y}
    )
    sums = ("_sx", "_sy", "_sxx", "_sxy")
    # window columns first: used inline they would be computed at every mention
    df = df.withColumns({f"{s}_n": trailing(s, window) / window for s in sums} | {"_i": F.row_number().over(by())})
    cov = F.col("_sxy_n") - F.col("_sx_n") * F.col("_sy_n")
    var = F.col("_sxx_n") - F.col("_sx_n") * F.col("_sx_n")
    beta = F.when((F.col("_i") >= window) & (var > 0), cov / var)
    return (
        df.withColumn("beta", beta)
        .withColumn("residual", F.col("ret") - F.col("beta") * F.col("market_ret"))
        .drop("_i", *sums, *[f"{s}_n" for s in sums])
    )


def with_factors(
    panel: DataFrame,
    names: tuple[str, ...] = FACTORS,
    year: int = YEAR,
    sessions: int | None = None,
) -> DataFrame:
    """Panel with one column per requested factor, over one shared ordering."""
    unknown = [n for n in names if n not in FACTORS]
    if unknown:
        raise ValueError(f"unknown factors: {unknown}")
    df = panel.withColumn("ret", simple_return())
    if "seasonality" in names:
        df = df.withColumn("_monthly", simple_return(MONTH))
    if "illiquidity" in names:
        df = df.withColumn("_impact", F.try_divide(F.abs("ret"), F.col("close") * F.col("volume")))
    if any(n in RESIDUAL_FACTORS for n in names):
        df = add_residuals(df, sessions=sessions)
        if "residual_momentum" in names:
            df = df.withColumn("_resid_231", rolling(F.sum, F.col("residual"), 231))
        if "downside_beta" in names:
            down = F.col("market_ret") < 0
            both = down & F.col("ret").isNotNull()
            r, m = F.col("ret"), F.col("market_ret")
            df = running_sums(
                df,
                {
                    "_down_n": F.when(both, 1.0),
                    "_down_r": F.when(both, r),
                    "_down_rm": F.when(both, r * m),
                    "_down_k": F.when(down, 1.0),
                    "_down_m": F.when(down, m),
                    "_down_mm": F.when(down, m * m),
                },
            )
            sums = [c for c in df.columns if c.startswith("_down_")]
            df = df.withColumns({f"{s}_w": trailing(s, YEAR) for s in sums})
    defined = _price_factors(year)
    if any(n in RESIDUAL_FACTORS for n in names):
        defined |= {k: v for k, v in _residual_factors().items() if k in names}
    return df.withColumns({n: defined[n] for n in names})


def add_forward_returns(df: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Returns strictly after the bar: close h rows ahead over this close."""
    ahead = {f"fwd_{h}": F.try_divide(F.lead("close", h).over(by()), F.col("close")) - 1 for h in horizons}
    return df.withColumns(ahead)


def build_factor(
    prepared: DataFrame, name: str, horizons: tuple[int, ...] = HORIZONS, **options
) -> DataFrame:
    """Scored panel of one factor: rows with a finite signal."""
    df = add_forward_returns(with_factors(prepared, (name,), **options), horizons)
    return df.where(finite(F.col(name))).select(
        "event_time", "symbol", F.col(name).alias("signal"), *[f"fwd_{h}" for h in horizons]
    )


def factor_table(
    prepared: DataFrame, names: tuple[str, ...] = FACTORS, horizons: tuple[int, ...] = HORIZONS, **options
) -> DataFrame:
    """Wide table: every factor and forward return of each bar."""
    df = add_forward_returns(with_factors(prepared, names, **options), horizons)
    return df.select("event_time", "symbol", *names, *[f"fwd_{h}" for h in horizons])


def unpivot_factors(table: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Long table ``(factor, event_time, symbol, signal, fwd_*)`` of finite signals."""
    kept = [c for c in table.columns if c not in names]
    return table.unpivot(kept, list(names), "factor", "signal").where(finite(F.col("signal")))
