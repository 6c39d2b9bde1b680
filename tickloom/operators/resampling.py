"""Bootstraps, permutations, overfitting statistics and the gauntlet.

Draws are functions of a row and a draw number, by a reproducible integer
generator, so nothing is drawn on the driver.  Where order does not count, each
row joins every draw where it lies and only sums per draw travel.  Where it
does, a series is one row with an array of its returns, as long as the calendar;
it crosses the network once for a block of draws.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.scalar import normal_cdf, normal_ppf
from tickloom.operators.performance import VARIANCE_FLOOR, kurt, sharpe, skew
from tickloom.operators.portfolio import mix
from tickloom.session import checkpointed

EULER = 0.5772156649015329


def series_arrays(returns: DataFrame, keys: list[str], order: str = "event_time") -> DataFrame:
    """One row per series: its returns in order."""
    ordered = F.sort_array(F.collect_list(F.struct(order, "ret")))
    return returns.groupBy(*keys).agg(F.transform(ordered, lambda x: x["ret"]).alias("r")).withColumn("n", F.size("r"))


#: Draws that share one copy of their series.
DRAW_BLOCK = 64
#: Rounds of a permutation.
ROUNDS = 16


def resamples(series: DataFrame, count: int, keys: list[str]) -> DataFrame:
    """One row per series and resample ``b``, spread over tasks by series and block of resamples."""
    last = (count - 1) // DRAW_BLOCK
    blocks = series.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(last)))).repartition(*keys, "_block")
    first = F.col("_block") * DRAW_BLOCK
    draws = F.sequence(first, F.least(first + (DRAW_BLOCK - 1), F.lit(count - 1)))
    return blocks.withColumn("b", F.explode(draws)).drop("_block")


MODULUS = 2147483647


def keyed(df: DataFrame, seed: Column, rounds: int = ROUNDS) -> DataFrame:
    """``df`` with ``_keys``: per round of a permutation a point, a factor and an addend, from a seed."""
    draw = lambda k: mix(F.lit(k), seed)
    keys = [F.struct(draw(3 * k).alias("p"), (draw(3 * k + 1) + 1).alias("f"), draw(3 * k + 2).alias("a")) for k in range(rounds)]
    return df.withColumn("_keys", F.array(*keys))


def permuted(df: DataFrame, position: str, size: str, out: str, rounds: int = ROUNDS) -> DataFrame:
    """``out``: where the keyed permutation of ``[0, size)`` takes ``position``, by the ``_keys`` of the row.

    Each round pairs every place with its mirror image around a keyed point and swaps or keeps the pair by
    a keyed bit.  Both places of a pair compute the same bit, so each round, and the whole, is a
    permutation of exactly ``size`` places for any size and key, from the row alone.
    """
    df = df.withColumn(out, F.col(position).cast("bigint"))
    for k in range(rounds):
        key = F.col("_keys")[k]
        df = df.withColumn("_y", F.pmod(key["p"] % F.col(size) - F.col(out), F.col(size)))
        bit = (F.greatest(out, "_y") * key["f"] + key["a"]) % MODULUS % 2
        df = df.withColumn(out, F.when(bit == 1, F.col("_y")).otherwise(F.col(out)))
    return df.drop("_y")


def array_sharpe(df: DataFrame, values: str, out: str, periods: int = 252) -> DataFrame:
    """Sharpe of an array column; 0 without variance."""
    n = F.size(values)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    peak = F.aggregate(values, F.lit(1.0), lambda a, x: F.greatest(a, F.abs(x)))
    df = df.withColumns({"_mean": F.try_divide(total, n), "_peak": peak})
    squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean")))
    df = df.withColumn("_std", F.sqrt(F.try_divide(squares, n - 1)))
    ok = F.coalesce(F.col("_std") > VARIANCE_FLOOR * F.col("_peak"), F.lit(False))
    value = F.when(ok, F.try_divide("_mean", "_std") * periods**0.5).otherwise(0.0)
    return df.withColumn(out, value).drop("_mean", "_peak", "_std")


def array_drawdown(values: Column) -> Column:
    """Deepest fall of the compounded curve seeded with 1."""
    start = F.struct(F.lit(1.0).alias("e"), F.lit(1.0).alias("p"), F.lit(0.0).alias("d"))

    def step(a: Column, x: Column) -> Column:
        e = a["e"] * (1 + x)
        p = F.greatest(a["p"], e)
        return F.struct(e.alias("e"), p.alias("p"), F.least(a["d"], e / p - 1).alias("d"))

    return F.aggregate(values, start, step, lambda a: a["d"])


def _positions(n: Column) -> Column:
    return F.sequence(F.lit(0), n - 1)


def _interval(sampled: DataFrame, keys: list[str], confidence: float) -> DataFrame:
    tail = (1 - confidence) / 2
    return sampled.groupBy(*keys).agg(
        F.first("point").alias("point_estimate"),
        F.percentile("s", F.lit(tail)).alias("lower"),
        F.percentile("s", F.lit(1 - tail)).alias("upper"),
        F.count(F.lit(1)).alias("resamples"),
    )


def bootstrap_sharpe(series: DataFrame, keys: list[str], count: int = 2000, seed: int = 7, confidence: float = 0.95, periods: int = 252) -> DataFrame:
    """Confidence interval of the Sharpe ratio from independent draws."""
    usable = array_sharpe(series.where("n >= 4"), "r", "point", periods)
    rows = resamples(usable, count, keys)
    draw = F.transform(
        _positions(F.col("n")),
        lambda i: F.element_at("r", (mix(i, F.col("b") * 1000003 + seed) % F.col("n") + 1).cast("int")),
    )
    return _interval(array_sharpe(rows.withColumn("d", draw), "d", "s", periods), keys, confidence)


def block_bootstrap(series: DataFrame, keys: list[str], block: int = 20, count: int = 2000, seed: int = 7, periods: int = 252) -> DataFrame:
    """The same from contiguous blocks, cut to the length of the series."""
    usable = array_sharpe(series.where(F.col("n") >= 2 * block), "r", "point", periods)
    rows = resamples(usable, count, keys)
    starts = F.col("n") - block + 1

    def pick(i: Column) -> Column:
        start = mix(F.floor(i / block), F.col("b") * 1000003 + seed) % starts
        return F.element_at("r", (start + i % block + 1).cast("int"))

    draw = F.transform(_positions(F.col("n")), pick)
    return _interval(array_sharpe(rows.withColumn("d", draw), "d", "s", periods), keys, 0.95)


def shuffled(values: str, seed: Column) -> Column:
    """An array in pseudo-random order."""
    tagged = F.transform(values, lambda x, i: F.struct(mix(i, seed).alias("h"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(tagged), lambda t: t["x"])


def permutation_test(returns: DataFrame, benchmark: DataFrame, keys: list[str], count: int = 2000, seed: int = 7, periods: int = 252, order: str = "event_time") -> DataFrame:
    """Share of random re-splits whose Sharpe difference reaches the observed one.

    ``returns`` has a row per series and time, ``benchmark`` a row per time.  The rows of a series and of
    the benchmark form one pool; a draw takes as many of it as the series has.  Which side a row falls
    on in a draw is a function of its number, so rows meet their draws where they lie.
    """
    numbered = lambda df, *by: df.withColumn("_i", F.row_number().over(W.partitionBy(*by).orderBy(order)) - 1)
    # both are read for sizes, the observed gap and the draws
    own = checkpointed(numbered(returns.where(F.col("ret").isNotNull()).select(*keys, order, "ret"), *keys))
    sizes = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    other = checkpointed(numbered(benchmark.where(F.col("ret").isNotNull()).select(order, "ret").withColumn("_one", F.lit(0)), "_one").drop("_one"))
    held = sizes.join(F.broadcast(other.agg(F.count(F.lit(1)).alias("_q"))), F.lit(True)).where("_n >= 4 and _q >= 4").withColumn("_size", F.col("_n") + F.col("_q"))
    mine = own.join(held, keys).select(*keys, "_n", "_size", "ret", "_i")
    # the benchmark's rows once per series
    theirs = held.join(other, F.lit(True)).select(*keys, "_n", "_size", "ret", (F.col("_i") + F.col("_n")).alias("_i"))
    pool = mine.unionByName(theirs)
    r = F.col("ret")
    both = lambda left: sharpe(F.when(left, r), periods=periods) - sharpe(F.when(~left, r), periods=periods)
    observed = pool.groupBy(*keys).agg(both(F.col("_i") < F.col("_n")).alias("observed"))
    draws = keyed(pool.sparkSession.range(count).withColumnRenamed("id", "b"), F.col("b") * 1000003 + seed)
    # a small pool times its draws is work for all tasks, so it is not left to what its bytes suggest
    spread = pool.repartition(int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_i")
    # a row per draw, whatever the panel: every row of the pool is in every draw
    drawn = permuted(spread.join(F.broadcast(draws), F.lit(True)), "_i", "_size", "_at")
    gaps = drawn.groupBy(*keys, "b").agg(both(F.col("_at") < F.col("_n")).alias("_x"))
    extreme = F.count_if(F.col("_x") >= F.col("observed"))
    return gaps.join(F.broadcast(observed), keys).groupBy(*keys).agg(
        F.first("observed").alias("observed"), ((extreme + 1) / (F.count(F.lit(1)) + 1)).alias("p_value")
    )


def monte_carlo_drawdown(series: DataFrame, keys: list[str], count: int = 2000, seed: int = 7) -> DataFrame:
    """Drawdowns of the same trades in random order, against the realised one."""
    usable = series.where("n >= 2").withColumn("_real", array_drawdown(F.col("r")))
    rows = resamples(usable, count, keys).withColumn("o", shuffled("r", F.col("b") * 1000003 + seed))
    done = rows.withColumn("d", array_drawdown(F.col("o"))).groupBy(*keys).agg(
        F.first("_real").alias("realised_drawdown"),
        F.median("d").alias("median_drawdown"),
        F.percentile("d", F.lit(0.05)).alias("percentile_5"),
        F.count(F.lit(1)).alias("shuffles"),
    )
    real = F.col("realised_drawdown")
    return done.withColumn("luck_ratio", F.when(real != 0, F.try_divide("percentile_5", real)).otherwise(0.0))


# ---- overfitting ---------------------------------------------------------------------


def sharpe_moments(returns: DataFrame, keys: list[str], periods: int = 252) -> DataFrame:
    """Per-period Sharpe, skew, kurtosis and length of every series."""
    r = F.col("ret")
    return returns.groupBy(*keys).agg(
        F.count(r).alias("n_observations"),
        sharpe(r, periods=periods, annualise=False).alias("observed_sharpe"),
        skew(r).alias("skew"),
        kurt(r).alias("kurt"),
    )


def deflated_sharpe(moments: DataFrame, trials: str = "n_trials", variance: str | None = None) -> DataFrame:
    """Probability that the true Sharpe is positive given the search effort."""
    c = F.col
    n = c(trials).cast("double")
    spread = c(variance) if variance else 1 / c("n_observations")
    several = c(trials) > 1
    df = moments.withColumns(
        {
            "_z1": normal_ppf(F.when(several, 1 - 1 / n).otherwise(F.lit(0.5))),
            "_z2": normal_ppf(F.when(several, 1 - 1 / (n * math.e)).otherwise(F.lit(0.5))),
        }
    )
    best = F.when(several & (spread > 0), F.sqrt(spread) * ((1 - EULER) * c("_z1") + EULER * c("_z2"))).otherwise(0.0)
    df = df.withColumn("expected_max_sharpe", best)
    sr = c("observed_sharpe")
    width = F.sqrt(F.greatest(F.lit(1e-12), 1 - c("skew") * sr + (c("kurt") - 1) / 4 * sr * sr))
    stat = (sr - c("expected_max_sharpe")) * F.sqrt(c("n_observations") - 1) / width
    df = df.withColumn("statistic", stat)
    known = c("n_observations") >= 4
    return df.withColumn("dsr", F.when(known, normal_cdf("statistic")).otherwise(0.0)).drop("_z1", "_z2")


def backtest_overfitting(sweep: DataFrame, keys: list[str], splits: int = 10) -> DataFrame:
    """Share of balanced splits whose in-sample winner is mediocre outside.

    ``sweep`` holds ``(config, event_time, ret)`` of configurations that share
    their periods.  Blocks reduce to sums first, so the splits work on a table
    of blocks times configurations.
    """
    if splits % 2:
        raise ValueError("the number of blocks must be even")
    spark = sweep.sparkSession
    order = W.partitionBy(*keys, "config").orderBy("event_time")
    sized = sweep.withColumns(
        {"_i": F.row_number().over(order) - 1, "_n": F.count(F.lit(1)).over(W.partitionBy(*keys, "config"))}
    )
    block = F.floor(F.col("_i") / F.floor(F.col("_n") / splits))
    blocks = (
        sized.withColumn("block", block)
        .where(F.col("block") < splits)
        .groupBy(*keys, "config", "block")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"))
    )
    masks = spark.range(1 << splits).where(F.bit_count("id") == splits // 2).select(F.col("id").alias("mask"))
    sides = masks.select("mask", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("block")).withColumn(
        "inside", F.expr("(shiftright(mask, block) & 1) = 1")
    )
    half = blocks.join(F.broadcast(sides), "block").groupBy(*keys, "mask", "config", "inside").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")
    )
    mean = F.col("s") / F.col("n")
    var = F.try_divide(F.col("q") - F.col("s") * mean, F.col("n") - 1)
    score = F.when(var > 1e-24, F.try_divide(mean, F.sqrt(F.when(var > 0, var)))).otherwise(0.0)
    scored = half.withColumn("score", score)
    wide = scored.groupBy(*keys, "mask", "config").agg(
        F.max(F.when(F.col("inside"), F.col("score"))).alias("a"), F.max(F.when(~F.col("inside"), F.col("score"))).alias("o")
    )
    # the first configuration wins a tie, as an argmax does
    best = wide.groupBy(*keys, "mask").agg(F.max_by("o", F.struct("a", (-F.col("config")).alias("c"))).alias("_best"))
    ranks = wide.join(best, [*keys, "mask"]).groupBy(*keys, "mask").agg(F.avg((F.col("o") <= F.col("_best")).cast("double")).alias("rank"))
    configs = wide.groupBy(*keys).agg(F.countDistinct("config").alias("n_configurations"))
    poor = F.avg((F.col("rank") <= 0.5).cast("double"))
    done = ranks.groupBy(*keys).agg(poor.alias("pbo"), F.count(F.lit(1)).alias("n_combinations"))
    return done.join(configs, keys) if keys else done.join(F.broadcast(configs), F.lit(True), "left")


def dropout_names(names: DataFrame, samples: int, drop: float = 0.2, number: str = "sym_no", rows: int | None = None) -> DataFrame:
    """Universe samples that keep a random share of the names (two at least)."""
    from tickloom.functions.ranks import with_ordinal_rank

    spread = names.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    drawn = spread.withColumn("_h", mix(F.col(number), F.col("sample")))
    ranked = with_ordinal_rank(drawn, "_h", number, "_r", ["sample"], rows)
    counts = names.agg(F.count(F.lit(1)).alias("_n"))
    keep = F.greatest(F.lit(2), F.floor(F.col("_n") * (1 - drop)))
    return ranked.join(F.broadcast(counts), F.lit(True), "left").where(F.col("_r") <= keep).drop("_h", "_r", "_n")


def sample_masks(kept: DataFrame, name: str = "symbol") -> DataFrame:
    """A row per name of ``(sample, name)``, with a bit of ``_mask`` for every sample that keeps it."""
    return kept.groupBy(name).agg(F.bit_or(F.expr("shiftleft(1L, cast(sample as int))")).alias("_mask"))


# ---- the gauntlet -----------------------------------------------------------------------

#: Order of the checks, cheapest first, and the threshold of each (fixed values).
CHECKS = {
    "1_data_integrity": 0.0,
    "2_look_ahead": 1e-9,
    "7_cost_sensitivity": 0.0,
    "5_walk_forward": 0.5,
    "6_parameter_plateau": 0.6,
    "9_regimes": 2.0,
    "3_deflated_sharpe": 0.95,
    "8_universe_dropout": 0.0,
    "10_placebo": 0.95,
    "11_mc_drawdown": -0.25,
    "4_pbo": 0.5,
    "12_locked_oos": 0.0,
}


def _rows(df: DataFrame, name: str, statistic: Column, passed: Column, skipped: Column | None = None) -> DataFrame:
    skip = F.lit(False) if skipped is None else F.coalesce(skipped, F.lit(True))
    return df.select(
        "strategy",
        F.lit(name).alias("test"),
        (F.coalesce(passed, F.lit(False)) & ~skip).alias("passed"),
        skip.alias("skipped"),
        F.when(~skip, statistic.cast("double")).alias("statistic"),
        F.lit(CHECKS[name]).alias("threshold"),
    )


def check_data_integrity(findings: DataFrame) -> DataFrame:
    """``(strategy, critical)``: no critical finding may remain."""
    return _rows(findings, "1_data_integrity", F.col("critical"), F.col("critical") == 0)


def check_look_ahead(pairs: DataFrame) -> DataFrame:
    """``(strategy, ret, corrupted_ret)``: decisions may not move with the future."""
    gap = F.max(F.abs(F.col("ret") - F.col("corrupted_ret")))
    grouped = pairs.groupBy("strategy").agg(gap.alias("gap"))
    return _rows(grouped, "2_look_ahead", F.col("gap"), F.col("gap") < CHECKS["2_look_ahead"])


def check_deflated_sharpe(deflated: DataFrame) -> DataFrame:
    return _rows(deflated, "3_deflated_sharpe", F.col("dsr"), F.col("dsr") > CHECKS["3_deflated_sharpe"])


def check_pbo(pbo: DataFrame) -> DataFrame:
    return _rows(pbo, "4_pbo", F.col("pbo"), F.col("pbo") < CHECKS["4_pbo"])


def check_walk_forward(returns: DataFrame, periods: int = 252) -> DataFrame:
    """``(strategy, ret, in_sample)``: out-of-sample keeps half the Sharpe."""
    r = F.col("ret")
    grouped = returns.groupBy("strategy").agg(
        sharpe(F.when(F.col("in_sample"), r), periods=periods).alias("a"),
        sharpe(F.when(~F.col("in_sample"), r), periods=periods).alias("b"),
        F.count_if(~F.col("in_sample")).alias("n"),
    )
    kept = F.when(F.col("a") > 0, F.try_divide("b", "a")).otherwise(0.0)
    return _rows(grouped, "5_walk_forward", kept, (F.col("a") > 0) & (kept > CHECKS["5_walk_forward"]), F.col("n") == 0)


def check_parameter_plateau(neighbours: DataFrame) -> DataFrame:
    """``(strategy, sharpe)`` of nearby parameters: a mesa, not a needle."""
    grouped = neighbours.groupBy("strategy").agg(
        F.max("sharpe").alias("best"), F.median("sharpe").alias("mid"), F.count(F.lit(1)).alias("n")
    )
    kept = F.when(F.col("best") > 0, F.try_divide("mid", "best")).otherwise(F.col("best"))
    good = (F.col("best") > 0) & (kept > CHECKS["6_parameter_plateau"])
    return _rows(grouped, "6_parameter_plateau", kept, good, F.col("n") < 3)


def check_cost_sensitivity(tripled: DataFrame, periods: int = 252) -> DataFrame:
    grouped = tripled.groupBy("strategy").agg(sharpe(F.col("ret"), periods=periods).alias("s"))
    return _rows(grouped, "7_cost_sensitivity", F.col("s"), F.col("s") > 0)


def check_universe_dropout(sharpes: DataFrame) -> DataFrame:
    grouped = sharpes.groupBy("strategy").agg(F.percentile("sharpe", F.lit(0.05)).alias("p"), F.count(F.lit(1)).alias("n"))
    return _rows(grouped, "8_universe_dropout", F.col("p"), F.col("p") > 0, F.col("n") < 10)


def check_regimes(returns: DataFrame, periods: int = 252) -> DataFrame:
    """``(strategy, regime, ret)``: two regimes at least must pay."""
    each = returns.groupBy("strategy", "regime").agg(sharpe(F.col("ret"), periods=periods).alias("s"))
    grouped = each.groupBy("strategy").agg(F.count_if(F.col("s") > 0).alias("n"))
    return _rows(grouped, "9_regimes", F.col("n"), F.col("n") >= CHECKS["9_regimes"])


def check_placebo(placebo: DataFrame, actual: DataFrame) -> DataFrame:
    """``(strategy, sharpe)`` of random books against the strategy's own."""
    joined = placebo.join(actual.select("strategy", F.col("sharpe").alias("_own")), "strategy")
    grouped = joined.groupBy("strategy").agg(
        F.avg((F.col("sharpe") < F.col("_own")).cast("double")).alias("p"), F.count(F.lit(1)).alias("n")
    )
    return _rows(grouped, "10_placebo", F.col("p"), F.col("p") >= CHECKS["10_placebo"], F.col("n") < 20)


def check_monte_carlo(drawdowns: DataFrame, limit: float = CHECKS["11_mc_drawdown"]) -> DataFrame:
    return _rows(drawdowns, "11_mc_drawdown", F.col("percentile_5"), F.col("percentile_5") > limit)


def check_locked(returns: DataFrame, minimum: float = 0.0, periods: int = 252) -> DataFrame:
    grouped = returns.groupBy("strategy").agg(sharpe(F.col("ret"), periods=periods).alias("s"))
    return _rows(grouped, "12_locked_oos", F.col("s"), F.col("s") > minimum)


def gauntlet(spark: SparkSession, strategies: DataFrame, results: list[DataFrame], short_circuit: bool = True) -> DataFrame:
    """All checks of all strategies; a missing input is a skipped check.

    Rows after the first failure are cut, and every row carries the verdict.
    """
    table = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(CHECKS.items())], "position int, test string, threshold double")
    grid = strategies.select("strategy").distinct().join(F.broadcast(table), F.lit(True), "left")
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    joined = grid.join(found.drop("threshold"), ["strategy", "test"], "left")
    joined = joined.withColumns(
        {"skipped": F.coalesce("skipped", F.lit(True)), "passed": F.coalesce("passed", F.lit(False))}
    )
    failed = F.when(~F.col("passed") & ~F.col("skipped"), F.col("position"))
    strategy = W.partitionBy("strategy")  # twelve rows
    joined = joined.withColumn("_stop", F.min(failed).over(strategy))
    first = F.max(F.when(F.col("position") == F.col("_stop"), F.col("test"))).over(strategy)
    out = joined.withColumns({"first_failure": first, "strategy_passed": F.col("_stop").isNull()})
    if short_circuit:
        out = out.where(F.col("_stop").isNull() | (F.col("position") <= F.col("_stop")))
    return out.drop("_stop")

