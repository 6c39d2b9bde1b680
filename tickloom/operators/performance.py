"""Performance statistics of any number of return series at once.

A series is the rows of one key (symbol, strategy, configuration, resample) in
``event_time`` order: at most one row per session, so the calendar bounds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.stats import finite, safe_corr
from tickloom.functions.windows import by, rolling, simple_return

YEAR = 252
VARIANCE_FLOOR = 1e-12
#: Trailing horizons of a profile in sessions (fixed values).
HORIZONS = {"1w": 5, "1m": 21, "3m": 63, "6m": 126, "1y": 252, "3y": 756}
LAGS = (1, 2, 5, 10)
DECAY = 0.94
SEED = 20
MIN_PROFILE = 60
MAX_SCALE = 3.0
MIN_GARCH = 250


def returns_of(levels: DataFrame, key: str = "symbol", price: str = "close") -> DataFrame:
    """Finite period returns of a level series."""
    framed = levels.withColumn("ret", simple_return(1, by(key), price))
    return framed.where(finite(F.col("ret")))


def with_curve(returns: DataFrame, keys: list[str], order: str = "event_time") -> DataFrame:
    """Attach compounded equity, its peak (seeded with 1) and the drawdown.

    Signs and zeros are tracked apart from the logarithm, so a return at or
    below -100 % compounds exactly.
    """
    run = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    factor = 1 + F.col("ret")
    df = returns.withColumns(
        {
            "_ln": F.sum(F.when(factor != 0, F.ln(F.abs(factor)))).over(run),
            "_neg": F.count(F.when(factor < 0, 1)).over(run),
            "_zero": F.count(F.when(factor == 0, 1)).over(run),
        }
    )
    sign = F.when(F.col("_neg") % 2 == 1, -1.0).otherwise(1.0)
    equity = F.when(F.col("_zero") > 0, 0.0).otherwise(sign * F.exp(F.coalesce("_ln", F.lit(0.0))))
    df = df.withColumn("equity", equity)
    df = df.withColumn("peak", F.greatest(F.max("equity").over(run), F.lit(1.0)))
    return df.withColumn("drawdown", F.col("equity") / F.col("peak") - 1).drop("_ln", "_neg", "_zero")


def product(factor: Column) -> Column:
    """Product of a column as an aggregate, for factors of any sign."""
    size = F.exp(F.coalesce(F.sum(F.when(factor != 0, F.ln(F.abs(factor)))), F.lit(0.0)))
    odd = F.count(F.when(factor < 0, 1)) % 2 == 1
    return F.when(F.count(F.when(factor == 0, 1)) > 0, 0.0).otherwise(F.when(odd, -size).otherwise(size))


def has_variance(dispersion: Column, largest: Column) -> Column:
    """Dispersion above floating-point residue, scaled to the series."""
    return F.coalesce(dispersion > VARIANCE_FLOOR * F.greatest(largest, F.lit(1.0)), F.lit(False))


def sharpe(ret: Column, risk_free: float = 0.0, periods: int = YEAR, annualise: bool = True) -> Column:
    """Sharpe ratio as an aggregate; 0 without variance or with one period."""
    excess = ret - risk_free / periods
    std = F.stddev_samp(excess)
    scale = periods**0.5 if annualise else 1.0
    ok = (F.count(excess) >= 2) & has_variance(std, F.max(F.abs(excess)))
    return F.when(ok, F.try_divide(F.avg(excess), std) * scale).otherwise(F.lit(0.0))


def sortino(ret: Column, risk_free: float = 0.0, periods: int = YEAR) -> Column:
    excess = ret - risk_free / periods
    down = F.when(excess < 0, excess)
    dev = F.sqrt(F.avg(down * down))
    ok = (F.count(excess) >= 2) & (F.count(down) > 0) & has_variance(dev, F.max(F.abs(down)))
    return F.when(ok, F.try_divide(F.avg(excess), dev) * periods**0.5).otherwise(F.lit(0.0))


def skew(ret: Column) -> Column:
    flat = (F.count(ret) < 3) | (F.var_pop(ret) == 0)
    return F.when(flat, 0.0).otherwise(F.coalesce(F.skewness(ret), F.lit(0.0)))


def kurt(ret: Column) -> Column:
    """Non-excess kurtosis: 3 for a normal distribution."""
    flat = (F.count(ret) < 4) | (F.var_pop(ret) == 0)
    return F.when(flat, 3.0).otherwise(F.coalesce(F.kurtosis(ret) + 3, F.lit(3.0)))


def _growth(total: Column, n: Column, periods: int) -> Column:
    return F.when(total <= 0, -1.0).otherwise(F.pow(F.when(total > 0, total), periods / n) - 1)


def summarise(
    returns: DataFrame,
    keys: list[str],
    order: str = "event_time",
    risk_free: float = 0.0,
    periods: int = YEAR,
) -> DataFrame:
    """Every headline statistic of every series: one window, one aggregation."""
    ret = F.col("ret")
    curve = with_curve(returns.where(finite(ret)), keys, order)
    grouped = curve.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_periods"),
        (product(1 + ret) - 1).alias("total_return"),
        (F.coalesce(F.stddev_samp(ret), F.lit(0.0)) * periods**0.5).alias("volatility"),
        sharpe(ret, risk_free, periods).alias("sharpe"),
        sortino(ret, risk_free, periods).alias("sortino"),
        F.least(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"),
        F.avg((ret > 0).cast("double")).alias("hit_rate"),
        skew(ret).alias("skewness"),
        kurt(ret).alias("kurtosis"),
    )
    out = grouped.withColumn("cagr", _growth(F.col("total_return") + 1, F.col("n_periods"), periods))
    calmar = F.when(F.col("max_drawdown") == 0, 0.0).otherwise(F.try_divide(F.col("cagr"), F.abs("max_drawdown")))
    return out.withColumn("calmar", calmar)


def tails(returns: DataFrame, keys: list[str], level: float = 0.05) -> DataFrame:
    """Value at risk, the mean beyond it, and the ratio of the tails."""
    series = W.partitionBy(*keys)
    ret = F.col("ret")
    cut = returns.where(finite(ret)).withColumn("_var", F.percentile(ret, F.lit(level)).over(series))
    high = F.percentile(ret, F.lit(0.95))
    low = F.abs(F.percentile(ret, F.lit(0.05)))
    return cut.groupBy(*keys).agg(
        F.first("_var").alias("var_5"),
        F.avg(F.when(ret <= F.col("_var"), ret)).alias("cvar_5"),
        F.when(low > 0, F.try_divide(F.abs(high), low)).otherwise(1.0).alias("tail_ratio"),
    )


def horizon_returns(bars: DataFrame, key: str = "symbol") -> DataFrame:
    """Return over each trailing horizon; null when the history is shorter."""
    back = W.partitionBy(key).orderBy(F.desc("event_time"))
    ranked = bars.withColumn("_back", F.row_number().over(back) - 1)
    last = F.max(F.when(F.col("_back") == 0, F.col("close")))
    out = []
    for name, k in HORIZONS.items():
        then = F.max(F.when(F.col("_back") == k, F.col("close")))
        out.append(F.when(then > 0, F.try_divide(last, then) - 1).alias(f"ret_{name}"))
    return ranked.groupBy(key).agg(*out)


def autocorrelations(returns: DataFrame, key: str = "symbol") -> DataFrame:
    """Correlation of a series with itself at the standard lags; 0 when flat."""
    w = by(key)
    lagged = returns.withColumns({f"_l{k}": F.lag("ret", k).over(w) for k in LAGS})
    cells = []
    for k in LAGS:
        enough = F.count(F.lit(1)) > k + 1
        rho = F.coalesce(safe_corr(F.col("ret"), F.col(f"_l{k}")), F.lit(0.0))
        cells.append(F.when(enough, rho).otherwise(0.0).alias(f"acf_{k}"))
    return lagged.groupBy(key).agg(*cells)


def levels(bars: DataFrame, key: str = "symbol") -> DataFrame:
    """Where the price stands: extremes of the last year, distance, drawdown."""
    back = W.partitionBy(key).orderBy(F.desc("event_time"))
    df = bars.withColumn("_back", F.row_number().over(back))
    year = F.when(F.col("_back") <= HORIZONS["1y"], F.col("close"))
    grouped = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("observations"),
        F.min_by("close", "event_time").alias("first_close"),
        F.max_by("close", "event_time").alias("last_close"),
        F.max(year).alias("high_52w"),
        F.min(year).alias("low_52w"),
        F.max("close").alias("_peak"),
        F.avg(F.col("close") * F.col("volume")).alias("adv_value"),
    )
    return grouped.withColumns(
        {
            "off_high": F.col("last_close") / F.col("high_52w") - 1,
            "current_drawdown": F.when(F.col("_peak") > 0, F.try_divide("last_close", "_peak") - 1).otherwise(0.0),
        }
    ).drop("_peak")


def volatilities(returns: DataFrame, key: str = "symbol", periods: int = YEAR, window: int | None = None) -> DataFrame:
    """Realised and exponentially weighted volatility.

    The recursion unrolls to weights that depend only on the position, seeded by
    the variance of the first twenty returns.
    """
    rows = W.partitionBy(key)
    df = returns.withColumns(
        {"_i": F.row_number().over(by(key)), "_n": F.count(F.lit(1)).over(rows)}
    )
    ret, i, n = F.col("ret"), F.col("_i"), F.col("_n")
    recent = ret if window is None else F.when(i > n - window, ret)
    weight = (1 - DECAY) * F.pow(F.lit(DECAY), n - i)
    seed = F.var_samp(F.when(i <= SEED, ret))
    carried = F.pow(F.lit(DECAY), F.max(n) - SEED) * seed
    ewma = carried + F.coalesce(F.sum(F.when(i > SEED, weight * ret * ret)), F.lit(0.0))
    enough = F.count(F.lit(1)) >= SEED
    return df.groupBy(key).agg(
        F.when(enough, F.stddev_samp(recent)).otherwise(0.0).alias("realised_daily"),
        F.when(enough, F.sqrt(F.greatest(F.when(enough, ewma), F.lit(0.0)))).otherwise(0.0).alias("ewma_daily"),
    ).withColumns(
        {
            "realised_vol": F.col("realised_daily") * periods**0.5,
            "ewma_vol": F.col("ewma_daily") * periods**0.5,
        }
    )


def vol_scale(annual: Column, target: float) -> Column:
    """Position multiplier that maps a forecast onto a target, capped."""
    return F.when(annual > 0, F.least(F.try_divide(F.lit(target), annual), F.lit(MAX_SCALE))).otherwise(0.0)


def flags(stats: DataFrame) -> DataFrame:
    """Smell tests of a profile."""
    ratio = F.try_divide("ewma_vol", "realised_vol")
    regime = (
        F.when(F.col("realised_vol") <= 0, "unknown")
        .when(ratio > 1.3, "elevated")
        .when(ratio < 0.7, "compressed")
        .otherwise("normal")
    )
    still = F.col("volatility") <= 1e-6
    return stats.withColumns(
        {
            "vol_regime": regime,
            "has_no_variance": still,
            "is_implausible": (F.col("sharpe") > 2.5) | still,
            "fat_left_tail": (F.col("skewness") < -0.5) & (F.col("kurtosis") > 5.0),
        }
    )


def profile(bars: DataFrame, key: str = "symbol", min_bars: int = MIN_PROFILE) -> DataFrame:
    """Complete statistical profile of every name with enough history."""
    sized = bars.withColumn("_bars", F.count(F.lit(1)).over(W.partitionBy(key)))
    kept = sized.where(F.col("_bars") >= min_bars).drop("_bars")
    rets = returns_of(kept, key)
    joined = levels(kept, key)
    for part in (
        horizon_returns(kept, key),
        summarise(rets, [key]),
        tails(rets, [key]),
        autocorrelations(rets, key),
        volatilities(rets, key),
    ):
        joined = joined.join(part, key)
    return flags(joined)


def rolling_stats(
    returns: DataFrame, window: int = 126, key: str = "symbol", market: str | None = "market_ret", periods: int = YEAR
) -> DataFrame:
    """Rolling Sharpe, volatility and beta; null until full or where flat."""
    if window < 20:
        raise ValueError("a rolling window needs at least 20 periods")
    w, ret = by(key), F.col("ret")
    frame = w.rowsBetween(-(window - 1), 0)
    df = returns.withColumns(
        {"_mean": rolling(F.avg, ret, window, w), "_std": rolling(F.stddev_samp, ret, window, w)}
    )
    out = {
        "rolling_sharpe": F.when(F.col("_std") > 0, F.try_divide("_mean", "_std") * periods**0.5),
        "rolling_volatility": F.col("_std") * periods**0.5,
    }
    if market:
        m = F.col(market)
        df = df.withColumns({"_cov": F.covar_pop(ret, m).over(frame), "_var": F.var_pop(m).over(frame)})
        full = F.col("_mean").isNotNull()
        out["rolling_beta"] = F.when(full & (F.col("_var") > 0), F.try_divide("_cov", "_var"))
    return df.withColumns(out).drop("_mean", "_std", "_cov", "_var")


def rolling_summary(series: DataFrame, value: str, key: str = "symbol") -> DataFrame:
    """Last, worst, best and share of positive values of a rolling series."""
    v = F.col(value)
    return series.where(finite(v)).groupBy(key).agg(
        F.max_by(v, "event_time").alias("last"),
        F.min(v).alias("worst"),
        F.max(v).alias("best"),
        F.avg((v > 0).cast("double")).alias("fraction_positive"),
    )
