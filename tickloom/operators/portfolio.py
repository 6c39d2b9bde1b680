"""Books: target weights, vectorised evaluation, order planning and fills.

A strategy is a function from a DataFrame of what each decision sees to a
DataFrame of weights ``(book, decision_time, symbol, weight)``; any number of
books, configurations, samples and seeds are evaluated together as key columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.chunks import key_changes
from tickloom.functions.ranks import with_ordinal_rank
from tickloom.functions.scalar import money, to_tick, whole_lots
from tickloom.functions.windows import by, copied_to, rolling
from tickloom.operators.performance import with_curve
from tickloom.sizing import fits_task, within

Strategy = Callable[[DataFrame], DataFrame]


# ---- what a decision sees -----------------------------------------------------


def decision_view(features: DataFrame, dates: DataFrame, key: str = "symbol", stamps: int | None = None) -> DataFrame:
    """Latest row of every name at each decision, whatever its age.

    A row is valid until the name's next one.  ``entry`` is the open after the
    decision, or the last close of a name that stopped trading.  ``stamps``
    bounds the sessions and the decisions.
    """
    w = by(key)
    framed = features.withColumns(
        {
            "_until": F.lead("event_time").over(w),
            "entry": F.coalesce(F.lead("open").over(w), F.col("close")),
        }
    )
    return copied_to(framed, dates, "decision_time", "event_time", "_until", stamps).drop("_until")


def holding_returns(view: DataFrame, key: str = "symbol") -> DataFrame:
    """Return of each name from one decision's entry to the next decision's."""
    nxt = F.lead("entry").over(W.partitionBy(key).orderBy("decision_time"))
    framed = view.select(key, "decision_time", "entry").withColumn("_next", nxt)
    return framed.where(F.col("_next").isNotNull()).select(
        key, "decision_time", (F.try_divide("_next", "entry") - 1).alias("ret")
    )


# ---- constraints ----------------------------------------------------------------


def exposure(weights: DataFrame, keys: list[str]) -> DataFrame:
    """Gross and net of every book; a weight that is not finite is an error."""
    bad = F.isnan("weight") | F.col("weight").isNull() | (F.abs("weight") == float("inf"))
    return weights.groupBy(*keys).agg(
        F.sum(F.abs("weight")).alias("gross"),
        F.sum("weight").alias("net"),
        F.count(F.lit(1)).alias("names"),
        F.count_if(bad).alias("invalid"),
    )


def clipped(
    weights: DataFrame, keys: list[str], max_position: float, max_gross: float, rows: int | None = None
) -> DataFrame:
    """Clip each name, drop zeros, then scale a book that is still too large."""
    cut = weights.where("weight <> 0").withColumn(
        "weight", F.greatest(F.least(F.col("weight"), F.lit(max_position)), F.lit(-max_position))
    )
    scale = F.when(F.col("_gross") > max_gross, max_gross / F.col("_gross")).otherwise(1.0)
    sized = _per_decision(cut, keys, {"_gross": F.sum(F.abs("weight"))}, rows)
    return sized.withColumn("weight", F.col("weight") * scale).drop("_gross")


def run_strategy(view: DataFrame, strategy: Strategy, keys: list[str], max_position: float = 1.0, max_gross: float = 1.0) -> DataFrame:
    """Generate and clip: the wrapper every strategy goes through."""
    return view.transform(strategy).transform(lambda w: clipped(w, keys, max_position, max_gross))


def _per_decision(df: DataFrame, keys: list[str], aggs: dict[str, Column], rows: int | None) -> DataFrame:
    """Attach aggregates of a decision: windows when ``rows`` bounds it."""
    if fits_task(rows):
        decision = W.partitionBy(*keys)
        return df.withColumns({name: agg.over(decision) for name, agg in aggs.items()})
    return df.join(df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in aggs.items()]), keys)


def _equal(signals: DataFrame, keys: list[str], gross: float, rows: int | None = None) -> DataFrame:
    """Split ``gross`` over the signalled names of each decision."""
    counted = _per_decision(signals, keys, {"_n": F.count(F.lit(1))}, rows)
    return counted.withColumn("weight", F.col("side") * gross / F.col("_n")).drop("_n", "side")


# ---- strategies -------------------------------------------------------------------


def equal_weight(view: DataFrame, keys: list[str] | None = None, gross: float = 1.0, rows: int | None = None) -> DataFrame:
    """Every name with a price, equally."""
    keys = keys or ["decision_time"]
    names = view.where(F.col("close") > 0).select(*keys, "symbol", F.lit(1.0).alias("side"))
    return _equal(names, keys, gross, rows)


def buy_and_hold(view: DataFrame, keys: list[str] | None = None, gross: float = 1.0) -> DataFrame:
    """The names of the first decision, held at their first weights."""
    keys = keys or ["decision_time"]
    first = view.agg(F.min("decision_time").alias("decision_time"))
    opened = equal_weight(view.join(F.broadcast(first), "decision_time", "left_semi"), keys, gross)
    dates = view.select("decision_time").distinct()
    return dates.join(F.broadcast(opened.select("symbol", "weight")), F.lit(True), "left").select("decision_time", "symbol", "weight")


def sma_features(panel: DataFrame, fast: int, slow: int) -> DataFrame:
    w = by()
    return panel.withColumns(
        {"fast_ma": rolling(F.avg, F.col("close"), fast, w), "slow_ma": rolling(F.avg, F.col("close"), slow, w)}
    )


def sma_crossover(
    view: DataFrame, keys: list[str] | None = None, gross: float = 1.0, allow_short: bool = False, rows: int | None = None
) -> DataFrame:
    keys = keys or ["decision_time"]
    up = F.col("fast_ma") > F.col("slow_ma")
    side = F.when(up, 1.0).otherwise(F.lit(-1.0) if allow_short else F.lit(None))
    ready = view.where(F.col("slow_ma").isNotNull()).withColumn("side", side).where(F.col("side").isNotNull())
    return _equal(ready.select(*keys, "symbol", "side"), keys, gross, rows)


def momentum_features(panel: DataFrame, lookbacks: tuple[int, ...], skips: tuple[int, ...]) -> DataFrame:
    """Closes at the ends of every momentum window."""
    w = by()
    ends = {f"start_{k}": F.lag("close", k - 1).over(w) for k in lookbacks}
    ends |= {f"end_{s}": (F.lag("close", s).over(w) if s else F.col("close")) for s in skips}
    return panel.withColumns(ends)


def momentum_scores(view: DataFrame, configs: list[tuple[int, int]], kept: list[str]) -> DataFrame:
    """One row per name, decision and ``(lookback, skip)`` configuration."""
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("config"),
                F.lit(k).alias("lookback"),
                F.lit(s).alias("skip"),
                F.when(F.col(f"start_{k}") > 0, F.try_divide(f"end_{s}", f"start_{k}") - 1).alias("score"),
            )
            for i, (k, s) in enumerate(configs)
        ]
    )
    return view.select(*kept, F.explode(cells).alias("c")).select(*kept, "c.*").where(F.col("score").isNotNull())


def top_fraction(
    scored: DataFrame,
    keys: list[str],
    fraction: float,
    gross: float = 1.0,
    long_only: bool = True,
    rows: int | None = None,
    score: str = "score",
    tie: str = "symbol",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Best fraction of each decision long, optionally the worst short.

    Ties go to the smaller id.  ``rows`` bounds the names of a decision.
    """
    sized = _per_decision(scored.withColumn("_neg", -F.col(score)), keys, {"_n": F.count(F.lit(1))}, rows)
    ranked = with_ordinal_rank(sized, "_neg", tie, "_rank", keys, rows)
    k = F.greatest(F.lit(1), F.floor(F.col("_n") * fraction))
    leg = gross if long_only else gross / 2
    held = F.when(F.col("_rank") <= k, leg / k)
    if not long_only:
        short = F.when(F.col("_rank") > F.col("_n") - k, -(leg / k))
        held = F.coalesce(short, held)
    return ranked.withColumn("weight", held).where(F.col("weight").isNotNull()).select(
        *keys, "symbol", score, "weight", "_rank", *keep
    )


def mix(i: Column, s: Column, k: Column | None = None) -> Column:
    """Pseudo-random value of a key and a seed, in plain integer arithmetic."""
    p = 2147483647
    base = i.cast("bigint") * 1103515245 + s.cast("bigint") * 12345679
    x = ((base if k is None else base + k.cast("bigint") * 362437) + 88675123) % p
    y = (x * x + x * 48271) % p
    return (y * y + y * 69621 + i.cast("bigint")) % p


def random_entry(view: DataFrame, seeds: int, n_names: int, hold: int = 1, number: str = "sym_no", gross: float = 1.0) -> DataFrame:
    """The same number of random names per holding bucket, for every seed."""
    order = view.select("decision_time").distinct().withColumn(
        "_bucket", F.floor((F.row_number().over(W.orderBy("decision_time")) - 1) / hold)
    )
    seeded = view.where(F.col("close") > 0).join(F.broadcast(order), "decision_time").withColumn(
        "seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))
    )
    drawn = seeded.withColumn("_h", mix(F.col(number), F.col("seed"), F.col("_bucket")))
    best = W.partitionBy("seed", "decision_time").orderBy("_h", number)
    chosen = drawn.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= n_names)
    return _equal(chosen.select("seed", "decision_time", "symbol", F.lit(1.0).alias("side")), ["seed", "decision_time"], gross, n_names)


def zscore_features(panel: DataFrame, window: int) -> DataFrame:
    w = by()
    mean, std = rolling(F.avg, F.col("close"), window, w), rolling(F.stddev_samp, F.col("close"), window, w)
    df = panel.withColumns({"_m": mean, "_s": std})
    return df.withColumn("z", F.when(F.col("_s") > 0, F.try_divide(F.col("close") - F.col("_m"), F.col("_s")))).drop("_m", "_s")


def zscore_reversion(
    view: DataFrame, entry: float, max_z: float, keys: list[str] | None = None, gross: float = 1.0, fadeable: DataFrame | None = None, rows: int | None = None
) -> DataFrame:
    """Fade deviations between ``entry`` and ``max_z``; optionally gated names."""
    keys = keys or ["decision_time"]
    far = F.abs("z")
    picked = view.where((far >= entry) & (far <= max_z))
    if fadeable is not None:
        picked = picked.join(fadeable.where("tradable_as_mean_reversion").select("symbol"), "symbol", "left_semi")
    side = F.when(F.col("z") > 0, -1.0).otherwise(1.0)
    return _equal(picked.select(*keys, "symbol", side.alias("side")), keys, gross, rows)


def pair_features(aligned: DataFrame, window: int) -> DataFrame:
    """Rolling hedge ratio, spread z-score and half-life of every pair.

    The spread of a window uses the ratio of that window, so its moments follow
    from the moments of the two legs.
    """
    w = W.partitionBy("left", "right").orderBy("event_time")
    frame, inner = w.rowsBetween(-(window - 1), 0), w.rowsBetween(-(window - 2), 0)
    df = aligned.withColumns({"_y1": F.lag("y").over(w), "_x1": F.lag("x").over(w), "_i": F.row_number().over(w)})
    df = df.withColumns({"_dy": F.col("y") - F.col("_y1"), "_dx": F.col("x") - F.col("_x1")})
    cov = lambda a, b: F.covar_pop(a, b).over(inner)
    df = df.withColumns(
        {
            "_cxy": F.covar_samp("y", "x").over(frame),
            "_vx": F.var_samp("x").over(frame),
            "_vy": F.var_samp("y").over(frame),
            "_my": F.avg("y").over(frame),
            "_mx": F.avg("x").over(frame),
            "_ay": cov("_dy", "_y1"), "_ax": cov("_dy", "_x1"), "_by": cov("_dx", "_y1"), "_bx": cov("_dx", "_x1"),
            "_yy": cov("_y1", "_y1"), "_yx": cov("_y1", "_x1"), "_xx": cov("_x1", "_x1"),
        }
    ).where(F.col("_i") >= window)
    c = F.col
    df = df.withColumn("beta", F.when(c("_vx") > 0, F.try_divide("_cxy", "_vx")).otherwise(0.0))
    b = c("beta")
    spread_var = c("_vy") + b * b * c("_vx") - 2 * b * c("_cxy")
    now = (c("y") - b * c("x")) - (c("_my") - b * c("_mx"))
    decay = F.try_divide(
        c("_ay") - b * c("_ax") - b * c("_by") + b * b * c("_bx"),
        c("_yy") - 2 * b * c("_yx") + b * b * c("_xx"),
    )
    return df.withColumns(
        {
            "z": F.when(spread_var > 0, F.try_divide(now, F.sqrt(F.when(spread_var > 0, spread_var)))),
            "half_life": F.when(decay < 0, F.try_divide(F.lit(-0.6931471805599453), decay)),
        }
    ).select("left", "right", "event_time", "beta", "z", "half_life")


def pairs_trading(features: DataFrame, entry: float = 2.0, max_half_life: float = 30.0, gross: float = 1.0, cointegrated: DataFrame | None = None) -> DataFrame:
    """Both legs of every pair whose spread is far out and decays fast."""
    live = (F.col("beta") != 0) & (F.abs("z") >= entry) & (F.col("half_life") <= max_half_life)
    df = features.where(F.coalesce(live, F.lit(False)))
    if cointegrated is not None:
        df = df.join(F.broadcast(cointegrated.where("cointegrated").select("left", "right")), ["left", "right"], "left_semi")
    side = F.when(F.col("z") > 0, -1.0).otherwise(1.0)
    hedge = F.round(F.abs("beta"), 4)
    scale = F.when(hedge > 0, gross / 2 / (1 + hedge)).otherwise(gross / 2)
    return df.select(
        "left", "right", F.col("event_time").alias("decision_time"),
        (side * scale).alias("left_weight"), (-side * scale * hedge).alias("right_weight"),
    )


def signal_book(
    scored: DataFrame, keys: list[str], fraction: float, construction: str = "EQUAL", gross: float = 1.0, rows: int | None = None, tie: str = "symbol"
) -> DataFrame:
    """Top fraction by score, weighted equally, by rank or by inverse volatility.

    ``scored`` carries ``vol`` for the last; names without one take the median
    of the usable inverses.
    """
    carried = scored if "vol" in scored.columns else scored.withColumn("vol", F.lit(None).cast("double"))
    chosen = top_fraction(carried, keys, fraction, gross, True, rows, tie=tie, keep=("vol",)).drop("weight")
    if construction == "EQUAL":
        sizes = chosen.withColumn("_s", F.lit(1.0))
    elif construction == "SCORE":
        top = _per_decision(chosen, keys, {"_k": F.max("_rank")}, rows)
        sizes = top.withColumn("_s", (F.col("_k") - F.col("_rank") + 1).cast("double"))
    elif construction == "INVERSE_VOL":
        inverse = chosen.withColumn("_inv", F.when(F.col("vol") > 0, F.try_divide(F.lit(1.0), F.col("vol"))))
        middle = _per_decision(inverse, keys, {"_mid": F.median("_inv")}, rows)
        sizes = middle.withColumn("_s", F.coalesce("_inv", "_mid", F.lit(1.0)))
    else:
        raise ValueError(f"unknown construction {construction}")
    total = _per_decision(sizes, keys, {"_t": F.sum("_s")}, rows)
    return total.withColumn("weight", gross * F.col("_s") / F.col("_t")).select(*keys, "symbol", "weight")


# ---- overlay ------------------------------------------------------------------------


def vol_target_scales(
    market: DataFrame, keys: list[str], target: float = 0.15, window: int = 60, max_leverage: float = 2.0, band: float = 0.10, periods: int = 252
) -> DataFrame:
    """Scale toward a volatility target, held while it drifts inside the band.

    Holding is a fold along the calendar: one short array per book.
    """
    w = W.partitionBy(*keys).orderBy("event_time") if keys else W.partitionBy(F.lit(0)).orderBy("event_time")
    realised = rolling(F.stddev_samp, F.col("market_ret"), window, w) * periods**0.5
    raw = F.when(F.col("_v") > 0, F.round(F.least(F.try_divide(F.lit(target), F.col("_v")), F.lit(max_leverage)), 4)).otherwise(0.0)
    steps = market.withColumn("_v", realised).where(F.col("_v").isNotNull()).withColumn("_raw", raw)
    series = steps.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("event_time", "_raw"))).alias("_a"))
    start = F.struct(F.lit(0.0).alias("last"), F.array().cast("array<double>").alias("out"))

    def hold(acc: Column, x: Column) -> Column:
        last, new = acc["last"], x["_raw"]
        keep = (last != 0) & (F.try_divide(F.abs(new - last), last) < band)
        value = F.when(keep, last).otherwise(new)
        return F.struct(value.alias("last"), F.array_append(acc["out"], value).alias("out"))

    held = F.aggregate("_a", start, hold, lambda acc: acc["out"])
    zipped = F.arrays_zip(F.col("_a"), held.alias("scale"))
    return series.select(*keys, F.explode(zipped).alias("z")).select(
        *keys, F.col("z._a.event_time").alias("event_time"), F.col("z._a._raw").alias("raw_scale"), F.col("z.scale").alias("scale")
    )


# ---- evaluation ---------------------------------------------------------------------


def evaluate(
    weights: DataFrame,
    returns: DataFrame,
    dates: DataFrame,
    keys: list[str],
    cost_rate: float = 0.0,
    cost_multiple: float = 1.0,
) -> DataFrame:
    """Net return, turnover, equity and drawdown of every book.

    A decision earns from the entry after it to the entry after the next one,
    so the last of ``dates`` earns nothing.  Trading is the change of weight
    between consecutive decisions.
    """
    order = W.orderBy("decision_time")
    index = (
        dates.select("decision_time").distinct()
        .withColumns({"_i": F.row_number().over(order), "_next": F.lead("decision_time").over(order)})
        .where(F.col("_next").isNotNull())
        .drop("_next")
    )
    numbered = weights.select(*keys, "decision_time", "symbol", "weight").join(F.broadcast(index), "decision_time")
    # a weight is held now and given up at the next decision
    sides = F.array(
        F.struct(F.col("_i").alias("i"), F.col("weight").alias("now"), F.lit(0.0).alias("then")),
        F.struct((F.col("_i") + 1).alias("i"), F.lit(0.0).alias("now"), F.col("weight").alias("then")),
    )
    both = numbered.select(*keys, "symbol", F.explode(sides).alias("s"))
    moved = both.groupBy(*keys, F.col("s.i").alias("_i"), "symbol").agg(
        F.sum("s.now").alias("weight"), F.sum("s.then").alias("_then")
    )
    marked = moved.join(returns.join(F.broadcast(index), "decision_time"), ["_i", "symbol"], "left")
    book = marked.groupBy(*keys, "_i").agg(
        F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("gross_ret"),
        F.sum(F.abs(F.col("weight") - F.col("_then"))).alias("turnover"),
        F.count_if(F.col("weight") != 0).alias("names"),
    )
    net = F.col("gross_ret") - F.col("turnover") * cost_rate * cost_multiple
    dated = book.join(F.broadcast(index), "_i").drop("_i").withColumn("ret", net)
    return with_curve(dated.withColumnRenamed("decision_time", "event_time"), keys)


def evaluate_samples(
    scored: DataFrame, returns: DataFrame, dates: DataFrame, keys: list[str], samples: int, fraction: float, cost_rate: float = 0.0
) -> DataFrame:
    """``evaluate`` of ``top_fraction`` on samples of the names, with ``sample`` as a further key.

    Bit ``s`` of a row's ``_mask`` says whether sample ``s`` keeps the name.  A
    decision is ranked once for all samples, so no row is copied to them; a task
    holds the names of one decision times ``samples`` (62 at most).
    """
    within("samples", samples, 1, 62)
    places = np.arange(samples, dtype=np.int64)
    bits = lambda table, name: (table.column(name).to_numpy()[:, None] >> places & 1).astype(np.int32)

    def best(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("symbol", "ascending")]))
        table = table.take(pa.array(np.argsort(-table.column("score").to_numpy(), kind="stable")))
        kept = bits(table, "_mask")
        upto = kept.cumsum(axis=0, dtype=np.int32)
        kept[upto > np.maximum(1, np.floor(upto[-1] * fraction))] = 0
        held = (kept.astype(np.int64) << places).sum(axis=1)
        out = table.select([*keys, "decision_time", "symbol"]).append_column("_mask", pa.array(held))
        return out.filter(pa.array(held != 0))

    def sums(table: pa.Table) -> pa.Table:
        now, then = bits(table, "_now"), bits(table, "_then")
        n, was = now.sum(axis=0), then.sum(axis=0)
        weight, before = 1.0 / np.maximum(n, 1), 1.0 / np.maximum(was, 1)
        both = (now & then).sum(axis=0)
        turnover = both * np.abs(weight - before) + (n - both) * weight + (was - both) * before
        gross = table.column("ret").to_numpy() @ now * weight
        live = np.flatnonzero(n + was)
        first = table.select([*keys, "_i"]).slice(0, 1).take(pa.array([0] * len(live), pa.int64()))
        made = [pa.array(places[live]), pa.array(gross[live]), pa.array(turnover[live]), pa.array(n[live].astype(np.int64))]
        return pa.table([*first.columns, *made], names=[*keys, "_i", "sample", "gross_ret", "turnover", "names"])

    kinds = lambda df, *columns: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema)
    ranked = scored.select(*keys, "decision_time", "symbol", "score", "_mask").groupBy(*keys, "decision_time")
    held = ranked.applyInArrow(best, kinds(scored, *keys, "decision_time", "symbol", "_mask"))
    order = W.orderBy("decision_time")
    index = (
        dates.select("decision_time").distinct()
        .withColumns({"_i": F.row_number().over(order).cast("bigint"), "_next": F.lead("decision_time").over(order)})
        .where(F.col("_next").isNotNull())
        .drop("_next")
    )
    nothing = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("_i").alias("i"), F.col("_mask").alias("now"), nothing.alias("then")),
        F.struct((F.col("_i") + 1).alias("i"), nothing.alias("now"), F.col("_mask").alias("then")),
    )
    both = held.join(F.broadcast(index), "decision_time").select(*keys, "symbol", F.explode(sides).alias("s"))
    moved = both.groupBy(*keys, F.col("s.i").alias("_i"), "symbol").agg(F.max("s.now").alias("_now"), F.max("s.then").alias("_then"))
    marked = moved.join(returns.join(F.broadcast(index), "decision_time"), ["_i", "symbol"], "left")
    marked = marked.select(*keys, "_i", "_now", "_then", F.coalesce("ret", F.lit(0.0)).alias("ret"))
    book = marked.groupBy(*keys, "_i").applyInArrow(
        sums, f"{kinds(marked, *keys, '_i')}, sample bigint, gross_ret double, turnover double, names bigint"
    )
    dated = book.join(F.broadcast(index), "_i").drop("_i").withColumn("ret", F.col("gross_ret") - F.col("turnover") * cost_rate)
    return with_curve(dated.withColumnRenamed("decision_time", "event_time"), [*keys, "sample"])


def evaluate_configs(
    view: DataFrame, dates: DataFrame, configs: list[tuple[int, int]], fraction: float, cost_rate: float = 0.0, samples: int | None = None
) -> DataFrame:
    """``evaluate`` of ``top_fraction`` on the ``momentum_scores`` of all ``configs``, with ``config`` as the key.

    ``view`` has the closes at the ends of the windows.  With ``samples``, bit
    ``s`` of a row's ``_mask`` says whether sample ``s`` keeps the name, and
    ``sample`` is a further key.  A decision is ranked in one task for all
    configurations; a row says in bits which books hold it, and no row is copied
    to them.  Rows meet the name's next decision after one shuffle by name, and
    only sums per book and decision go on.
    """
    books = len(configs) if samples is None else samples
    within("books of a word", books, 1, 62)
    words, places = 1 if samples is None else len(configs), np.arange(books, dtype=np.int64)
    ends = sorted({f"start_{k}" for k, _ in configs} | {f"end_{s}" for _, s in configs})
    order = W.orderBy("decision_time")
    index = (
        dates.select("decision_time").distinct()
        .withColumns({"_i": F.row_number().over(order).cast("bigint"), "_next": F.lead("decision_time").over(order)})
        .where(F.col("_next").isNotNull())
        .drop("_next")
    )
    following = F.lead("entry").over(W.partitionBy("symbol").orderBy("decision_time"))
    earned = F.when(F.col("symbol").isNotNull(), F.try_divide(following, "entry") - 1)
    kept = [F.col(c).cast("double").alias(c) for c in ends] + ([] if samples is None else ["_mask"])
    rated = view.select("symbol", "decision_time", F.coalesce(earned, F.lit(0.0)).alias("_ret"), *kept)

    def best(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("symbol", "ascending")], null_placement="at_start"))
        held = np.zeros((len(table), words), np.int64)
        known = {c: table.column(c).is_valid().to_numpy() for c in ends}
        values = {c: table.column(c).to_numpy() for c in ends}
        for number, (k, s) in enumerate(configs):
            start, end = values[f"start_{k}"], values[f"end_{s}"]
            rows = np.flatnonzero(known[f"start_{k}"] & known[f"end_{s}"] & ~(start <= 0))
            rows = rows[np.argsort(-(end[rows] / start[rows] - 1), kind="stable")]
            if samples is None:
                held[rows[: max(1, math.floor(len(rows) * fraction))], 0] |= 1 << number
                continue
            bits = (table.column("_mask").to_numpy()[rows, None] >> places & 1).astype(np.int32)
            upto = bits.cumsum(axis=0, dtype=np.int32)
            if len(rows):
                bits[upto > np.maximum(1, np.floor(upto[-1] * fraction))] = 0
            held[rows, number] = (bits.astype(np.int64) << places).sum(axis=1)
        some = np.flatnonzero(held.any(axis=1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * words), pa.array(held[some].ravel()))
        return table.select(["symbol", "_i", "_ret"]).take(pa.array(some)).append_column("_held", lists)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, last = None, None  # the row before, and the books that held it
        found: dict[int, np.ndarray] = {}  # per decision: names, names held before too, returns
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.Table.from_batches([batch.select(["symbol", "_i"])])
            i, ret = batch.column("_i").to_numpy(), batch.column("_ret").to_numpy()
            held = batch.column("_held").flatten().to_numpy().reshape(-1, words)
            new = key_changes(own.select(["symbol"]), None if row is None else row.select(["symbol"]))
            before = np.concatenate([held[:1] if last is None else last, held[:-1]])
            follows = ~new & (np.diff(i, prepend=i[0] if row is None else row["_i"][0].as_py()) == 1)
            both = np.where(follows[:, None], held & before, 0)
            row, last = own.slice(len(own) - 1), held[-1:]
            at = np.argsort(i, kind="stable")
            numbers, starts = np.unique(i[at], return_index=True)
            parts = np.empty((3, len(numbers), words, books))
            for w in range(words):
                now, then = ((x[at, w][:, None] >> places & 1).astype(np.float64) for x in (held, both))
                for n, x in enumerate((now, then, now * ret[at][:, None])):
                    parts[n, :, w] = np.add.reduceat(x, starts, axis=0)
            for n, number in enumerate(numbers.tolist()):
                found[number] = found[number] + parts[:, n] if number in found else parts[:, n].copy()
        for number, (now, then, earned) in found.items():
            w, b = np.nonzero(now)
            made = [np.full(len(w), number), w, b, now[w, b].astype(np.int64), then[w, b].astype(np.int64), earned[w, b]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["_i", "_word", "_book", "_now", "_both", "_earned"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in view.select("symbol").schema)
    chosen = rated.join(F.broadcast(index), "decision_time").drop("decision_time").groupBy("_i").applyInArrow(best, f"{kinds}, _i bigint, _ret double, _held array<bigint>")
    placed = chosen.repartition("symbol").sortWithinPartitions("symbol", "_i")
    parts = placed.mapInArrow(sums, "_i bigint, _word bigint, _book bigint, _now bigint, _both bigint, _earned double")
    c = F.col
    nothing = F.lit(0).cast("bigint")
    sides = F.array(  # what is held now is given up at the next decision
        F.struct(c("_i").alias("i"), c("_now").alias("now"), c("_both").alias("both"), c("_earned").alias("earned"), nothing.alias("was")),
        F.struct((c("_i") + 1).alias("i"), nothing.alias("now"), nothing.alias("both"), F.lit(0.0).alias("earned"), c("_now").alias("was")),
    )
    total = parts.select("_word", "_book", F.explode(sides).alias("s")).groupBy("_word", "_book", c("s.i").alias("_i")).agg(
        *[F.sum(f"s.{n}").alias(f"_{n}") for n in ("now", "both", "earned", "was")]
    )
    weight, before = 1.0 / F.greatest(c("_now"), F.lit(1)), 1.0 / F.greatest(c("_was"), F.lit(1))
    turnover = c("_both") * F.abs(weight - before) + (c("_now") - c("_both")) * weight + (c("_was") - c("_both")) * before
    keys = [c("_book").alias("config")] if samples is None else [c("_word").alias("config"), c("_book").alias("sample")]
    book = total.join(F.broadcast(index), "_i").select(
        *[k.cast("int") for k in keys], c("decision_time").alias("event_time"),
        (c("_earned") * weight).alias("gross_ret"), turnover.alias("turnover"), c("_now").alias("names"),
    )
    return with_curve(book.withColumn("ret", c("gross_ret") - c("turnover") * cost_rate), ["config"] if samples is None else ["config", "sample"])


def run_summary(evaluated: DataFrame, keys: list[str], cost_rate: float) -> DataFrame:
    """Equity ends, total return, deepest drawdown and fees of each book."""
    return evaluated.groupBy(*keys).agg(
        F.min_by("equity", "event_time").alias("first_equity"),
        F.max_by("equity", "event_time").alias("last_equity"),
        (F.max_by("equity", "event_time") - 1).alias("total_return"),
        F.least(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"),
        (F.sum("turnover") * cost_rate).alias("fees"),
        F.count(F.lit(1)).alias("periods"),
    )


# ---- orders and fills -----------------------------------------------------------------


def plan_orders(
    targets: DataFrame, positions: DataFrame, marks: DataFrame, accounts: DataFrame, min_value: float = 500.0, threshold: float = 0.005
) -> DataFrame:
    """Signed quantity deltas per account; held names without a target close."""
    both = targets.join(positions, ["account", "instrument"], "full_outer").fillna(0.0, ["weight", "quantity"])
    priced = both.join(marks, "instrument").join(accounts, "account").where(F.col("mark") > 0)
    target = whole_lots((F.col("equity") * F.col("weight") / F.col("mark")).cast("decimal(28,8)"), F.col("lot"))
    sized = priced.withColumn("delta", (target.cast("double") - F.col("quantity")))
    value = F.abs("delta") * F.col("mark")
    big = (value >= min_value) & ((F.col("equity") <= 0) | (value / F.when(F.col("equity") > 0, F.col("equity")) >= threshold))
    return sized.withColumn("value", value).withColumn(
        "outcome", F.when(F.col("delta") == 0, "unchanged").when(big, "planned").otherwise("too_small")
    )


def fund_orders(planned: DataFrame, headroom: float = 0.005, min_value: float = 500.0) -> DataFrame:
    """Sells release cash, then buys are funded largest first, cut to lots.

    The order of buys matters, so each account folds its own short list.
    """
    live = planned.where("outcome = 'planned'")
    released = F.sum(F.when(F.col("delta") < 0, F.abs("delta") * F.col("mark")).otherwise(0.0))
    buy = F.when(
        F.col("delta") > 0,
        F.struct((-F.col("value")).alias("k"), F.col("instrument"), F.col("delta"), F.col("mark"), F.col("lot").cast("double").alias("lot")),
    )
    sell = F.when(F.col("delta") < 0, F.struct("instrument", F.col("delta").alias("quantity")))
    per = live.groupBy("account").agg(
        (F.first("cash") + released).alias("_cash"),
        F.sort_array(F.collect_list(buy)).alias("_buys"),
        F.collect_list(sell).alias("_sells"),
    )
    empty = F.array().cast("array<struct<instrument:bigint,quantity:double>>")
    start = F.struct(F.col("_cash").alias("cash"), empty.alias("out"))

    def fund(acc: Column, b: Column) -> Column:
        room = acc["cash"] * (1 - headroom) / b["mark"]
        quantity = F.greatest(F.floor(F.least(b["delta"], room) / b["lot"]) * b["lot"], F.lit(0.0))
        taken = quantity * b["mark"] >= min_value
        return F.struct(
            F.when(taken, acc["cash"] - quantity * b["mark"]).otherwise(acc["cash"]).alias("cash"),
            F.when(taken, F.array_append(acc["out"], F.struct(b["instrument"].alias("instrument"), quantity.alias("quantity"))))
            .otherwise(acc["out"])
            .alias("out"),
        )

    funded = F.aggregate("_buys", start, fund, lambda acc: acc["out"])
    done = per.select("account", F.explode(F.concat(funded, F.col("_sells").cast("array<struct<instrument:bigint,quantity:double>>"))).alias("o"))
    return done.select("account", "o.instrument", "o.quantity")


def estimate_fills(orders: DataFrame, bars: DataFrame, model: str = "next_open", participation: float = 0.10, tick: float = 0.01) -> DataFrame:
    """Fill each order in the bar after its decision.

    ``bars`` are keyed by instrument and session; an order sees the next one.
    Quantity is capped by volume, the price moves against the trader by half a
    spread plus square-root impact, and never leaves the bar.
    """
    w = W.partitionBy("instrument").orderBy("session")
    nxt = F.lead(F.struct("session", "open", "high", "low", "close", "volume")).over(w)
    joined = orders.join(bars.withColumn("n", nxt), ["instrument", "session"], "left")
    n = lambda c: F.col(f"n.{c}")
    typical = (n("high") + n("low") + n("close")) / 3
    reference = {"next_open": n("open"), "next_vwap": typical, "next_close": n("close")}[model]
    tradable = F.coalesce((n("volume") > 0) & (n("high") > n("low")), F.lit(False))
    quantity = F.least(F.col("quantity"), n("volume") * participation)
    df = joined.withColumns({"_ref": reference, "_q": quantity, "_adv": n("volume") * typical})
    size = F.col("_q") * F.col("_ref")
    impact = F.lit(0.7 * 0.02) * F.sqrt(F.try_divide(size, F.when(F.col("_adv") > 0, F.col("_adv")))) * size
    slip = money((size * 5 / 20000 + F.coalesce(impact, F.lit(0.0))).cast("decimal(28,8)")).cast("double")
    side = F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0)
    moved = F.col("_ref") + side * F.try_divide(slip, F.col("_q"))
    inside = F.greatest(n("low"), F.least(n("high"), moved))
    outcome = (
        F.when(F.col("n").isNull(), "no_market")
        .when(~tradable, "no_liquidity")
        .when(F.col("_q") < F.col("quantity"), "partial")
        .otherwise("filled")
    )
    done = F.col("outcome").isin("partial", "filled")
    return df.withColumn("outcome", outcome).withColumns(
        {
            "fill_quantity": F.when(done, F.col("_q")),
            "fill_price": F.when(done, to_tick(inside, F.lit(tick))),
        }
    ).drop("_ref", "_q", "_adv", "n")


def order_outcomes(fills: DataFrame) -> DataFrame:
    """Orders by outcome with their share."""
    counts = fills.groupBy("outcome").agg(F.count(F.lit(1)).alias("orders"))
    total = counts.agg(F.sum("orders").alias("_t"))
    return counts.join(F.broadcast(total), F.lit(True), "left").select("outcome", "orders", (F.col("orders") / F.col("_t")).alias("share"))
