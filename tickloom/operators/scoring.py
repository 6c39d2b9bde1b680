"""Scoring a signal against forward returns.

``rows`` is a proven bound on the rows of one session (see ``sizing``); without
it the ranks take the route that splits sessions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tickloom.functions.ranks import fits_arrays, session_scores, session_shares, with_average_ranks, with_ordinal_rank
from tickloom.functions.stats import finite, rank_corr
from tickloom.functions.windows import by, rolling
from tickloom.sizing import fits_task

MIN_NAMES = 20
ROLLING_WINDOW = 252
BUCKETS = 5


def session_ic(
    scored: DataFrame,
    forward: str,
    keys: list[str] | None = None,
    min_names: int = MIN_NAMES,
    rows: int | None = None,
) -> DataFrame:
    """Spearman correlation of signal and forward return per session."""
    keys = keys or []
    session = [*keys, "event_time"]
    usable = scored.where(F.col("signal").isNotNull() & F.col(forward).isNotNull()).select(
        *session, F.col("signal").cast("double").alias("signal"), F.col(forward).cast("double").alias("_fwd")
    )
    if fits_arrays(rows, 2):
        scores = session_scores(usable, {"": ("signal", "_fwd")}, session).select(*session, "ic", "names")
        return scores.where((F.col("names") >= min_names) & finite(F.col("ic")))
    ranked = with_average_ranks(usable, {"_rs": "signal", "_rf": "_fwd"}, session, rows)
    return (
        ranked.groupBy(*session)
        .agg(rank_corr(F.col("_rs"), F.col("_rf")).alias("ic"), F.count(F.lit(1)).alias("names"))
        .where((F.col("names") >= min_names) & finite(F.col("ic")))
    )


def _moments() -> list[Column]:
    """Aggregates of ``ic``, where it is not null."""
    hit = F.avg((F.col("ic") > 0).cast("double"))
    return [F.avg("ic").alias("_mean"), F.stddev_samp("ic").alias("_std"), F.count("ic").alias("sessions"), hit.alias("_hit")]


def _summary() -> list[Column]:
    enough = F.col("sessions") >= 2
    spread = enough & (F.col("_std") > 0)
    zero = F.lit(0.0)
    return [
        F.when(enough, F.col("_mean")).otherwise(zero).alias("mean"),
        F.when(enough, F.col("_std")).otherwise(zero).alias("std"),
        F.when(spread, F.col("_mean") / F.col("_std")).otherwise(zero).alias("information_ratio"),
        F.when(spread, F.col("_mean") / F.col("_std") * F.sqrt("sessions")).otherwise(zero).alias("t_stat"),
        F.when(enough, F.col("_hit")).otherwise(zero).alias("hit_rate"),
        F.col("sessions"),
    ]


def summarise_ic(per_session: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean, deviation, information ratio, t statistic and hit rate."""
    return per_session.groupBy(*(keys or [])).agg(*_moments()).select(*(keys or []), *_summary())


def information_coefficient(scored: DataFrame, forward: str, **options) -> DataFrame:
    return summarise_ic(session_ic(scored, forward, **options), options.get("keys"))


def by_horizon(scored: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """One row per bar and horizon, so every horizon is scored in one job."""
    kept = [c for c in scored.columns if not c.startswith("fwd_")]
    long = scored.unpivot(kept, [f"fwd_{h}" for h in horizons], "_h", "fwd")
    return long.withColumn("horizon", F.substring("_h", 5, 9).cast("int")).drop("_h")


def ic_by_horizon(scored: DataFrame, horizons: tuple[int, ...], keys: list[str] | None = None, **options) -> DataFrame:
    rows, least = options.get("rows"), options.get("min_names", MIN_NAMES)
    if fits_arrays(rows, 1 + len(horizons)):
        pairs = {str(h): ("signal", f"fwd_{h}") for h in horizons}
        scores = session_scores(scored.where(F.col("signal").isNotNull()), pairs, [*(keys or []), "event_time"])
        kept = scores.where((F.col("names") >= least) & finite(F.col("ic"))).withColumn("horizon", F.col("_label").cast("int"))
        return summarise_ic(kept, [*(keys or []), "horizon"])
    keys = [*(keys or []), "horizon"]
    return summarise_ic(session_ic(by_horizon(scored, horizons), "fwd", keys=keys, **options), keys)


def rolling_ic(
    scored: DataFrame, forward: str, window: int = ROLLING_WINDOW, keys: list[str] | None = None, **options
) -> DataFrame:
    """Mean IC over trailing sessions; nothing until the window is full.

    The table it slides over has one row per session and key.
    """
    per_session = session_ic(scored, forward, keys=keys, **options)
    order = W.partitionBy(*(keys or [])).orderBy("event_time")
    smooth = per_session.withColumn("rolling_ic", rolling(F.avg, F.col("ic"), window, order))
    return smooth.where(F.col("rolling_ic").isNotNull()).select(
        *(keys or []), F.col("event_time").alias("end"), "rolling_ic", F.lit(window).alias("sessions")
    )


def _positions(scored: DataFrame, keys: list[str], rows: int | None) -> DataFrame:
    """Ordinal position by (signal, symbol) and size of the session."""
    session = [*keys, "event_time"]
    ranked = with_ordinal_rank(scored, "signal", "symbol", "_ord", session, rows)
    if fits_task(rows):
        return ranked.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*session)))
    counts = scored.groupBy(*session).agg(F.count(F.lit(1)).alias("_n"))
    return ranked.join(counts, session)


def quantile_returns(
    scored: DataFrame, forward: str, buckets: int = BUCKETS, keys: list[str] | None = None, rows: int | None = None
) -> DataFrame:
    """Pooled mean forward return of each within-session signal bucket."""
    keys = keys or []
    usable = scored.where(F.col("signal").isNotNull() & F.col(forward).isNotNull()).select(
        *keys, "event_time", "symbol", "signal", forward
    )
    bucket = F.floor((F.col("_ord") - 1) * buckets / F.col("_n"))
    return (
        _positions(usable, keys, rows)
        .groupBy(*keys, (bucket + 1).alias("quantile"))
        .agg(F.avg(forward).alias("mean_forward_return"), F.count(F.lit(1)).alias("names"))
    )


def spread_and_shape(quantiles: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Top minus bottom bucket and whether the staircase only rises."""
    keys = keys or []
    order = W.partitionBy(*keys).orderBy("quantile")
    rises = F.col("mean_forward_return") >= F.lag("mean_forward_return").over(order)
    stepped = quantiles.withColumn("_rises", F.coalesce(rises, F.lit(True)))
    top, bottom = F.max_by("mean_forward_return", "quantile"), F.min_by("mean_forward_return", "quantile")
    return stepped.groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) >= 2, top - bottom).otherwise(F.lit(0.0)).alias("spread"),
        F.bool_and("_rises").alias("is_monotonic"),
    )


def signal_turnover(scored: DataFrame, keys: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """Twice the mean change of a name's percentile rank from bar to bar."""
    keys = keys or []
    share = (F.col("_ord") - 1) / F.greatest(F.col("_n") - 1, F.lit(1))
    moved = _positions(scored.select(*keys, "event_time", "symbol", "signal"), keys, rows).withColumn("_pct", share)
    delta = F.abs(F.col("_pct") - F.lag("_pct").over(by([*keys, "symbol"])))
    return (
        moved.withColumn("_delta", delta)
        .groupBy(*keys)
        .agg((F.coalesce(F.avg("_delta"), F.lit(0.0)) * 2).alias("turnover"))
    )


def _usable(table: DataFrame, names: list[str], forward: str) -> DataFrame:
    """Signals that are not finite are none."""
    signals = [F.when(finite(F.col(n)), F.col(n)).alias(n) for n in names]
    return table.select("event_time", "symbol", *signals, forward)


def _stacked(table: DataFrame, names: list[str]) -> DataFrame:
    kept = [c for c in table.columns if c not in names]
    return table.unpivot(kept, list(names), "factor", "signal").where(F.col("signal").isNotNull())


def factor_ics(
    table: DataFrame, names: list[str], forward: str, min_names: int = MIN_NAMES, rows: int | None = None
) -> DataFrame:
    """``information_coefficient`` of every factor of a wide table: each bar is shuffled once, whatever their number."""
    wide = _usable(table, names, forward)
    if not fits_arrays(rows, len(names) + 1):
        return information_coefficient(_stacked(wide, names), forward, keys=["factor"], min_names=min_names, rows=rows)
    scores = session_scores(wide.drop("symbol"), {n: (n, forward) for n in names}, ["event_time"])
    return summarise_ic(_enough(scores, min_names), ["factor"])


def _enough(scores: DataFrame, min_names: int) -> DataFrame:
    return scores.where((F.col("names") >= min_names) & finite(F.col("ic"))).withColumnRenamed("_label", "factor")


def factor_reports(
    table: DataFrame, names: list[str], horizon: int, round_trip: float, buckets: int = BUCKETS,
    min_names: int = MIN_NAMES, rows: int | None = None,
) -> DataFrame:
    """``factor_report`` of every factor of a wide table.

    Sessions are dealt once: one reading gives the sums per session and factor,
    a second the places of all names, which go to their names for the turnover.
    """
    forward = f"fwd_{horizon}"
    wide = _usable(table, names, forward)
    if not fits_arrays(rows, len(names) + 2):
        # one pass of the factors feeds three reports; lost blocks are recomputed
        long = _stacked(wide, names).persist(StorageLevel.DISK_ONLY)
        return factor_report(long, horizon, round_trip, ["factor"], buckets, min_names, rows)
    # both read all columns of one exchange
    dealt = wide.repartition("event_time")
    scores = session_scores(dealt, {n: (n, forward) for n in names}, ["event_time"], buckets, "symbol")
    ic = F.when((F.col("names") >= min_names) & finite(F.col("ic")), F.col("ic"))
    sums = [F.try_divide(F.sum(F.col("sums")[q]), F.sum(F.col("counts")[q])) for q in range(buckets)]
    grouped = scores.withColumn("ic", ic).groupBy(F.col("_label").alias("factor")).agg(*_moments(), F.array(*sums).alias("_means"))
    means = F.filter("_means", lambda m: m.isNotNull())
    steps = F.greatest(F.size("_means") - 1, F.lit(0))
    rises = F.zip_with(F.slice("_means", F.lit(1), steps), F.slice("_means", F.lit(2), steps), lambda a, b: b >= a)
    top, bottom = F.element_at("_means", -1), F.element_at("_means", 1)
    shaped = grouped.where("sessions > 0").withColumn("_means", means).select(
        "factor", *_summary(), F.when(F.size("_means") >= 2, top - bottom).otherwise(F.lit(0.0)).alias("spread"),
        F.forall(rises, lambda x: x).alias("is_monotonic"),
    )
    before = by().rowsBetween(W.unboundedPreceding, -1)
    moves = session_shares(dealt, names, "symbol", "event_time").select(
        *[F.abs(F.col(n) - F.last(n, ignorenulls=True).over(before)).alias(n) for n in names]
    )
    churn = moves.agg(*[(F.coalesce(F.avg(n), F.lit(0.0)) * 2).alias(n) for n in names]).unpivot([], names, "factor", "turnover")
    report = shaped.join(churn, "factor")
    return report.withColumns(cost_verdict(F.col("spread"), F.col("turnover"), horizon, F.lit(round_trip)))


def cost_verdict(
    spread: Column, turnover: Column, horizon: int, round_trip: Column
) -> dict[str, Column]:
    """Does the bucket spread outlive trading at the signal's turnover?"""
    traded = F.least(F.lit(1.0), turnover * horizon)
    net = spread - traded * round_trip
    return {
        "per_rebalance": traded,
        "net_spread": net,
        "survives": F.when(turnover > 0, net > 0),
    }


def factor_report(
    scored: DataFrame,
    horizon: int,
    round_trip: float,
    keys: list[str] | None = None,
    buckets: int = BUCKETS,
    min_names: int = MIN_NAMES,
    rows: int | None = None,
) -> DataFrame:
    """IC, bucket spread, turnover and cost verdict of each key in one job."""
    keys = keys or []
    forward = f"fwd_{horizon}"
    tag = keys or ["_all"]
    if not keys:
        scored = scored.withColumn("_all", F.lit(1))
    ic = information_coefficient(scored, forward, keys=tag, min_names=min_names, rows=rows)
    shape = spread_and_shape(quantile_returns(scored, forward, buckets, tag, rows), tag)
    churn = signal_turnover(scored, tag, rows)
    joined = ic.join(shape, tag).join(churn, tag)
    report = joined.withColumns(
        cost_verdict(F.col("spread"), F.col("turnover"), horizon, F.lit(round_trip))
    )
    return report.drop("_all") if not keys else report
