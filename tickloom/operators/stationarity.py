"""Stationarity, volatility models and cointegration of many series.

The calendar bounds a series, so the tests take it whole: series are shuffled and
sorted once, and Arrow tasks hand them to NumPy one after another.  Half-lives and
hedge ratios are moments in the JVM; GARCH is a grouped NumPy helper.
"""

from __future__ import annotations

import math
import operator
import statistics
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.chunks import key_changes
from tickloom.functions.stats import safe_corr, slope
from tickloom.functions.windows import by, rolling
from tickloom.session import checkpointed

MIN_OBSERVATIONS = 60
MIN_SPREAD = 20
SIGNIFICANCE = 0.05
TRENDING = 0.55
MAX_LAGS = 40

#: Response surface of the Dickey-Fuller p-value with a constant, and the KPSS
#: level table (published values).
DF_MIN, DF_STAR, DF_MAX = -18.83, -1.61, 2.74
DF_SMALL = (2.1659, 1.4412, 0.038269)
DF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
KPSS_STATS = (0.347, 0.463, 0.574, 0.739)
KPSS_P = (0.10, 0.05, 0.025, 0.01)


def _each_series(levels: DataFrame, keys: list[str], value: str, order: str, of: Callable[[np.ndarray, np.ndarray], tuple | None], kinds: list[str]) -> DataFrame:
    """``of(values, which are null)`` for every series, in order (ties by value); no row where that is None."""
    placed = levels.select(*keys, order, F.col(value).cast("double").alias("_x")).repartition(*keys).sortWithinPartitions(*keys, order, "_x").select(*keys, "_x")
    own_kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in placed.select(*keys).schema]

    def made(own: pa.Table, results: list[tuple | None]) -> Iterator[pa.RecordBatch]:
        kept = [r for r in results if r is not None]
        columns = own.filter(pa.array([r is not None for r in results], pa.bool_())).columns
        made = zip(*kept, strict=True) if kept else [()] * len(kinds)
        table = pa.table([*columns, *[pa.array(c, pa.int64() if k.endswith("bigint") else pa.float64()) for c, k in zip(made, kinds, strict=True)]], names=[*keys, *[k.split()[0] for k in kinds]])
        yield from table.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, parts = None, []  # the series still open
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.Table.from_batches([batch]).select(keys)
            null = batch.column("_x").is_null().to_numpy(False)
            x = batch.column("_x").to_numpy(False)
            new = key_changes(own, row)
            starts = np.flatnonzero(new)
            ends = np.append(starts, len(own))
            if ends[0]:
                parts.append((x[: ends[0]], null[: ends[0]]))
            if not len(starts):
                continue
            done = [] if row is None else [of(*map(np.concatenate, zip(*parts, strict=True)))]
            done += [of(x[a:b], null[a:b]) for a, b in zip(ends[:-2], ends[1:-1], strict=True)]
            first = own.take(pa.array(starts))
            closed = first.slice(0, len(first) - 1)
            yield from made(closed if row is None else pa.concat_tables([row, closed]), done)
            row, parts = first.slice(len(first) - 1), [(x[ends[-2] :], null[ends[-2] :])]
        if row is not None:
            yield from made(row, [of(*map(np.concatenate, zip(*parts, strict=True)))])

    return placed.mapInArrow(run, ", ".join([*own_kinds, *kinds]))


def _keyed(keys: list[str]) -> Column:
    """Whether a series has all its keys."""
    return reduce(operator.and_, [F.col(k).isNotNull() for k in keys])


def _hurst(x: np.ndarray, null: np.ndarray) -> tuple[float]:
    n = len(x) - int(null.sum())
    lags, spreads = [], []
    with np.errstate(invalid="ignore", over="ignore"):
        for k in range(2, max(3, min(n // 10, MAX_LAGS))):
            d = (x[k:] - x[:-k])[~(null[k:] | null[:-k])]
            if len(d):
                d = d - d[0]  # equal steps have no spread at all
                d -= d.mean()
                v = float(d @ d) / len(d)
                if v > 0 or math.isnan(v):
                    lags.append(k)
                    spreads.append(v)
        if n < MIN_OBSERVATIONS or len(lags) < 2:
            return (0.5,)
        a, b = np.log(np.asarray(lags, dtype=float)), np.log(np.asarray(spreads))
        if not np.isfinite(b).all():
            return (1.0,)
        a -= a.mean()
        return (float(min(max(a @ (b - b.mean()) / (a @ a) / 2, 0.0), 1.0)),)


def hurst(levels: DataFrame, keys: list[str], value: str = "close", order: str = "event_time") -> DataFrame:
    """Half the slope of log variance of lagged differences on the log lag; one half where that is unusable or a key is null."""
    of = _each_series(levels, keys, value, order, _hurst, ["hurst double"])
    return of.withColumn("hurst", F.when(_keyed(keys), F.col("hurst")).otherwise(0.5))


def half_life(levels: DataFrame, keys: list[str], value: str = "close", order: str = "event_time") -> DataFrame:
    """Bars until a deviation halves; null (never) when it does not decay."""
    w = by(keys, order)
    df = levels.withColumn("_x", F.lag(value).over(w)).withColumn("_dx", F.col(value) - F.col("_x"))
    fit = df.groupBy(*keys).agg(F.count(value).alias("_n"), slope(F.col("_dx"), F.col("_x")).alias("_lam"))
    decays = (F.col("_n") >= MIN_SPREAD) & (F.col("_lam") < 0)
    return fit.select(*keys, F.when(decays, F.try_divide(F.lit(-math.log(2.0)), F.col("_lam"))).alias("half_life"))


def _df_pvalue(stat: float) -> float:
    if stat > DF_MAX:
        return 1.0
    if stat < DF_MIN:
        return 0.0
    coefficients = DF_SMALL if stat <= DF_STAR else DF_LARGE
    return statistics.NormalDist().cdf(sum(c * stat**i for i, c in enumerate(coefficients)))


def _lags(n: float) -> int:
    return max(min(math.ceil(12.0 * (n / 100.0) ** 0.25), int(n) // 2 - 2), 0)


def _design(d: np.ndarray, level: np.ndarray, lags: int) -> np.ndarray:
    """[1, level, difference lagged 1 to ``lags``, difference] of the rows that have all lags."""
    windows = np.lib.stride_tricks.sliding_window_view(d, lags + 1)
    z = np.empty((len(windows), lags + 3))
    z[:, 0], z[:, 1] = 1.0, level[lags:]
    z[:, 2:-1], z[:, -1] = windows[:, :-1][:, ::-1], windows[:, -1]
    return z


def _fitted(gram: np.ndarray) -> np.ndarray:
    """Residual sums of squares of the last column on ever more of the ones before it."""
    a, b = gram[:-1, :-1], gram[:-1, -1]
    scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    try:
        lower = np.linalg.cholesky(a / np.outer(scale, scale))
        return gram[-1, -1] - np.cumsum(np.linalg.solve(lower, b / scale) ** 2)
    except np.linalg.LinAlgError:  # lags that depend on each other
        return np.array([gram[-1, -1] - b[:p] @ np.linalg.pinv(a[:p, :p]) @ b[:p] for p in range(1, len(a) + 1)])


def adf_statistic(e: np.ndarray, top: int, choose: bool = True) -> float | None:
    """The Dickey-Fuller t value of centred levels, at the order of least AIC up to ``top`` or at ``top``; None if degenerate."""
    d, level = np.diff(e), e[:-1]
    z = _design(d, level, top)
    gram, m, order = z.T @ z, float(len(z)), top
    if choose:
        ssr = np.maximum(_fitted(gram)[1:], 1e-300)
        aic = m * (math.log(2 * math.pi) + np.log(ssr / m) + 1) + 2 * np.arange(2, top + 3)
        order = int(np.argmin(aic))
    kept = [*range(2 + order), top + 2]
    gram = gram[np.ix_(kept, kept)]
    if order < top:  # rows that lack later lags only
        rows = _design(d[:top], level[:top], order)
        gram = gram + rows.T @ rows
    a, b = gram[:-1, :-1], gram[:-1, -1]
    scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    inverse = np.linalg.pinv(a / np.outer(scale, scale)) / np.outer(scale, scale)
    beta = inverse @ b
    variance = float(gram[-1, -1] - beta @ b) / (gram[0, 0] - len(a)) * inverse[1, 1]
    return float(beta[1] / math.sqrt(variance)) if variance > 0 else None


def _centred(x: np.ndarray) -> np.ndarray:
    """Values that are finite, without their mean: others are no rows."""
    x = x[np.isfinite(x)]
    return x - x.mean() if len(x) else x


def adf_fixed(levels: DataFrame, keys: list[str], lags: int, value: str = "close", order: str = "event_time") -> DataFrame:
    """The Dickey-Fuller t value of every series at one order; null where degenerate."""

    def of(x: np.ndarray, null: np.ndarray) -> tuple | None:
        e = _centred(x)
        usable = len(e) >= 2 * lags + 6 and e @ e > 0
        return (len(e), adf_statistic(e, lags, choose=False) if usable else None) if len(e) else None

    return _each_series(levels, keys, value, order, of, ["n bigint", "statistic double"])


def _kpss(e: np.ndarray) -> float:
    """The KPSS p-value of centred levels, at the automatic bandwidth."""
    n = len(e)
    cross = np.array([2.0 * float(e[i:] @ e[:-i]) / n for i in range(1, int(n ** (2.0 / 9.0)) + 1)])
    s0, s1 = float(e @ e) / n + cross.sum(), float(cross @ np.arange(1, len(cross) + 1))
    ratio = s1 / s0 if s0 != 0 else math.inf
    width = int(min(1.1447 * (ratio * ratio) ** (1.0 / 3.0) * n ** (1.0 / 3.0), n - 1))
    sums = np.cumsum(e)
    # Bartlett's weights are those of squared sums over all windows of width + 1 rows; those beyond the end hold the rest of a sum that ends at zero
    moved = sums.copy()
    moved[width + 1 :] -= sums[: -width - 1]
    rest = sums[n - 1 - width : n - 1]
    long_run = float(moved @ moved + rest @ rest) / (width + 1)
    if long_run == 0:
        return KPSS_P[-1]
    return float(np.interp(float(sums @ sums) / n / long_run, KPSS_STATS, KPSS_P))


def _unit_root(x: np.ndarray, null: np.ndarray) -> tuple[float, float] | None:
    e = _centred(x)
    if len(e) < MIN_OBSERVATIONS or not e @ e > 0:
        return (1.0, 0.0) if len(e) else None
    stat = adf_statistic(e, _lags(len(e)))
    return 1.0 if stat is None else _df_pvalue(stat), _kpss(e)


def _tested(tests: DataFrame, keys: list[str]) -> DataFrame:
    # a series without a key has no long-run variance
    return tests.withColumn("kpss_pvalue", F.when(_keyed(keys) | (F.col("kpss_pvalue") == 0), F.col("kpss_pvalue")).otherwise(KPSS_P[-1]))


def unit_root_tests(levels: DataFrame, keys: list[str], value: str = "close", order: str = "event_time") -> DataFrame:
    """ADF (order by AIC; 1 when unusable) and KPSS (level, automatic bandwidth; 0 when unusable) p-values."""
    return _tested(_each_series(levels, keys, value, order, _unit_root, ["adf_pvalue double", "kpss_pvalue double"]), keys)


def verdict(adf: Column, kpss: Column, significance: float = SIGNIFICANCE) -> Column:
    """Both tests agree on stationary, agree on a unit root, or disagree."""
    rejects, accepts = adf < significance, kpss >= significance
    return (
        F.when(rejects & accepts, "STATIONARY")
        .when(~rejects & ~accepts, "UNIT_ROOT")
        .otherwise("INCONCLUSIVE")
    )


def assess(levels: DataFrame, keys: list[str] | None = None, value: str = "close", order: str = "event_time") -> DataFrame:
    """Both tests, Hurst and the reconciled verdict of every series."""
    keys = keys or ["symbol"]

    def of(x: np.ndarray, null: np.ndarray) -> tuple | None:
        tests = _unit_root(x, null)
        return tests and (*tests, *_hurst(x, null))

    # one pass for all, of the series that have a key
    joined = _each_series(levels.where(_keyed(keys)), keys, value, order, of, ["adf_pvalue double", "kpss_pvalue double", "hurst double"])
    named = joined.withColumn("verdict", verdict(F.col("adf_pvalue"), F.col("kpss_pvalue")))
    fade = (F.col("verdict") == "STATIONARY") & (F.col("hurst") < TRENDING)
    return named.withColumn("tradable_as_mean_reversion", fade)


def pair_series(panel: DataFrame, pairs: DataFrame) -> DataFrame:
    """Aligned closes of the listed pairs ``(left, right)``.

    Two equality joins per listed pair; nothing pairs the whole panel.
    """
    slim = panel.select("event_time", "symbol", "close")
    y = slim.select(F.col("symbol").alias("left"), "event_time", F.col("close").alias("y"))
    x = slim.select(F.col("symbol").alias("right"), "event_time", F.col("close").alias("x"))
    return y.join(F.broadcast(pairs), "left").join(x, ["right", "event_time"]).select("left", "right", "event_time", "y", "x")


def hedge_ratios(aligned: DataFrame) -> DataFrame:
    """Slope, intercept and correlation of every pair; zeros when degenerate."""
    y, x = F.col("y"), F.col("x")
    n = F.count(F.lit(1))
    beta = F.when(n >= MIN_OBSERVATIONS, F.coalesce(slope(y, x), F.lit(0.0))).otherwise(0.0)
    grouped = aligned.groupBy("left", "right").agg(
        n.alias("observations"),
        beta.alias("hedge_ratio"),
        F.avg("y").alias("_my"),
        F.avg("x").alias("_mx"),
        F.coalesce(safe_corr(y, x), F.lit(0.0)).alias("correlation"),
        (F.var_pop("x") > 0).alias("_moves"),
    )
    fitted = F.col("_moves") & (F.col("observations") >= MIN_OBSERVATIONS)
    alpha = F.when(fitted, F.col("_my") - F.col("hedge_ratio") * F.col("_mx")).otherwise(0.0)
    return grouped.withColumn("intercept", alpha).drop("_my", "_mx", "_moves")


def spreads(aligned: DataFrame, ratios: DataFrame) -> DataFrame:
    """Residual of every pair; the ratio table has one row per listed pair."""
    joined = aligned.join(F.broadcast(ratios), ["left", "right"])
    return joined.withColumn("spread", F.col("y") - (F.col("hedge_ratio") * F.col("x") + F.col("intercept")))


def engle_granger(panel: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cointegration report of every listed pair."""
    aligned = pair_series(panel, pairs)
    ratios = hedge_ratios(aligned)
    series = spreads(aligned, ratios).select("left", "right", "event_time", "spread")
    keys = ["left", "right"]
    report = (
        ratios.join(assess(series, keys, "spread"), keys)
        .join(half_life(series, keys, "spread"), keys)
        .withColumn("cointegrated", F.col("verdict") == "STATIONARY")
    )
    quick = (F.col("half_life") > 0) & (F.col("half_life") < F.col("observations") / 4)
    return report.withColumn("tradable", F.col("cointegrated") & F.coalesce(quick, F.lit(False)))


def regime_slices(
    returns: DataFrame, keys: list[str], market: str = "market_ret", window: int = 60, min_bars: int = 60
) -> DataFrame:
    """Rows of each series labelled bull, bear and high_vol (overlapping)."""
    w, m = by(keys), F.col(market)
    df = returns.withColumns(
        {"_sum": rolling(F.sum, m, window, w), "_vol": rolling(F.stddev_pop, m, window, w)}
    ).where(F.col("_sum").isNotNull())
    df = df.withColumn("_cut", F.percentile("_vol", F.lit(2 / 3)).over(W.partitionBy(*keys)))
    labels = F.array(
        F.when(F.col("_sum") > 0, F.lit("bull")),
        F.when(F.col("_sum") < 0, F.lit("bear")),
        F.when(F.col("_vol") >= F.col("_cut"), F.lit("high_vol")),
    )
    long = df.withColumn("regime", F.explode(F.filter(labels, lambda x: x.isNotNull())))
    size = F.count(F.lit(1)).over(W.partitionBy(*keys, "regime"))
    return long.withColumn("_size", size).where(F.col("_size") >= min_bars).drop("_size", "_sum", "_vol", "_cut")


def garch(returns: DataFrame, key: str = "symbol", periods: int = 252) -> DataFrame:
    """One-step GARCH(1,1) forecast, with the exponential one where it fails."""
    from tickloom.operators.performance import MIN_GARCH, volatilities

    types = {f.name: f.dataType for f in returns.schema}
    schema = T.StructType([T.StructField(key, types[key]), T.StructField("garch_daily", T.DoubleType())])

    def run(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        r = frame.sort_values("_t", kind="stable")["_r"].to_numpy(dtype=float)
        daily = garch_forecast(r[np.isfinite(r)]) if r.size >= MIN_GARCH else None
        return pd.DataFrame([[*group, daily]], columns=schema.names)

    fitted = returns.select(key, F.col("event_time").alias("_t"), F.col("ret").alias("_r")).groupBy(key).applyInPandas(run, schema)
    both = volatilities(returns, key).join(fitted, key)
    good = F.coalesce(F.col("garch_daily") > 0, F.lit(False))
    daily = F.when(good, F.col("garch_daily")).otherwise(F.col("ewma_daily"))
    return both.select(
        key,
        daily.alias("daily"),
        (daily * periods**0.5).alias("annualised"),
        F.when(good, "garch").when(F.col("ewma_daily") > 0, "ewma").otherwise("insufficient").alias("method"),
    )


def garch_forecast(r: np.ndarray) -> float | None:
    """Maximum likelihood over a grid of (alpha, beta, level), narrowed thrice.

    All candidates advance together, one step of the recursion per return.
    """
    x = r * 100.0
    sq = x * x
    level = float(sq.mean())
    if not level > 0:
        return None
    weights = 0.94 ** np.arange(min(75, sq.size))
    start = float(weights @ sq[: weights.size] / weights.sum())
    alphas, betas, scales = np.linspace(0.01, 0.4, 12), np.linspace(0.3, 0.98, 14), np.linspace(0.4, 1.8, 8)
    best = None
    for _ in range(4):
        a, b, s = (g.ravel() for g in np.meshgrid(alphas, betas, scales))
        keep = a + b < 0.9999
        a, b, s = a[keep], b[keep], s[keep]
        omega = level * s * (1.0 - a - b)
        var = omega + (a + b) * start
        nll = np.zeros_like(var)
        for q in sq:
            nll += np.log(var) + q / var
            var = omega + a * q + b * var
        i = int(np.argmin(nll))
        best = (float(var[i]), float(nll[i]))
        span = lambda grid, at: np.linspace(
            max(1e-6, at - (grid[1] - grid[0])), at + (grid[1] - grid[0]), len(grid)
        )
        alphas, betas, scales = span(alphas, a[i]), np.minimum(span(betas, b[i]), 0.9998), span(scales, s[i])
    daily = math.sqrt(best[0]) / 100.0
    return daily if math.isfinite(daily) and daily > 0 else None
