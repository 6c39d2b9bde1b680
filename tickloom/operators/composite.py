"""Factor overlap, orthogonalisation and weighted composites."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.ranks import fits_arrays, rank_products, session_scores, with_average_ranks
from tickloom.functions.stats import clip, finite, rank_corr
from tickloom.operators.scoring import MIN_NAMES
from tickloom.sizing import fits_task, small

WINSOR = 3.0
REDUNDANT = 0.5


def complete_rows(table: DataFrame, names: list[str]) -> DataFrame:
    """Bars on which every factor has a finite signal."""
    keep = finite(F.col(names[0]))
    for name in names[1:]:
        keep = keep & finite(F.col(name))
    return table.where(keep)


def per_session(df: DataFrame, aggs: dict[str, Column], rows: int | None, width: int = 64) -> DataFrame:
    """Attach session aggregates to every row.

    With a bound on the session, windows keep the rows where they are; without
    one, partial sums are joined back and no task holds a session.
    """
    if fits_task(rows):
        session = W.partitionBy("event_time")
        return df.withColumns({name: agg.over(session) for name, agg in aggs.items()})
    grouped = df.groupBy("event_time").agg(*[agg.alias(name) for name, agg in aggs.items()])
    return df.join(grouped, "event_time")


def zscore_by_session(df: DataFrame, names: list[str], rows: int | None = None) -> DataFrame:
    """Cross-sectional z-scores, winsorised; zero where a session is flat."""
    aggs = {f"_m_{n}": F.avg(n) for n in names} | {f"_s_{n}": F.stddev_samp(n) for n in names}
    joined = per_session(df, aggs, rows)

    def score(n: str) -> Column:
        z = (F.col(n) - F.col(f"_m_{n}")) / F.col(f"_s_{n}")
        return clip(F.when(F.col(f"_s_{n}") > 0, z).otherwise(F.lit(0.0)), -WINSOR, WINSOR)

    return joined.select(*[c for c in df.columns if c not in names], *[score(n).alias(n) for n in names])


def orthogonalise(
    df: DataFrame, names: list[str], min_names: int = MIN_NAMES, sessions: int | None = None
) -> DataFrame:
    """Each factor keeps what the earlier ones of its session do not explain.

    Everything Gram-Schmidt needs is in the session's Gram matrix: partial sums
    give the matrix, a per-session helper turns it into a triangular map, and
    one join applies it.  No task ever holds a session.
    """
    if len(names) < 2:
        return df
    k = len(names)
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    maps = (
        df.groupBy("event_time")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.array(*[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in cells]).alias("_gram"),
            F.array(*[F.sum(n) for n in names]).alias("_sums"),
        )
        .where(F.col("_n") >= min_names)
        .select("event_time", _residual_map("_n", "_gram", "_sums").alias("_map"))
    )
    joined = df.join(small(maps, sessions, 8 * k * k + 32), "event_time", "left")

    def residual(i: int) -> Column:
        cells = [F.col("_map")[i * k + p] * F.col(names[p]) for p in range(i + 1)]
        return F.when(F.col("_map").isNotNull(), sum(cells[1:], cells[0])).otherwise(F.col(names[i]))

    return joined.select(
        *[c for c in df.columns if c not in names], *[residual(i).alias(n) for i, n in enumerate(names)]
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _residual_map(n: pd.Series, gram: pd.Series, sums: pd.Series) -> pd.Series:
    """Scaled Gram-Schmidt map of each session, a k-by-k matrix row by row."""

    def solve(count, flat, totals):
        k = len(totals)
        g = np.zeros((k, k))
        g[np.triu_indices(k)] = flat
        g = np.triu(g) + np.triu(g, 1).T
        t = np.asarray(totals, dtype=float)
        rows = np.eye(k)
        for i in range(k):
            for j in range(i):
                norm = rows[j] @ g @ rows[j]
                if norm > 0:
                    rows[i] = rows[i] - (rows[i] @ g @ rows[j]) / norm * rows[j]
        for i in range(k):
            variance = rows[i] @ g @ rows[i] / count - (rows[i] @ t / count) ** 2
            if variance > 1e-24:
                rows[i] = rows[i] / variance**0.5
        return rows.ravel()

    return pd.Series([solve(c, f, s) for c, f, s in zip(n, gram, sums)])


def factor_correlations(table: DataFrame, names: list[str], rows: int | None = None) -> DataFrame:
    """Pooled correlation of within-session ranks, one row per pair.

    All pairs of columns come from one aggregation; a pair of a factor with
    itself carries the overall statistics' diagonal.
    """
    k = len(names)
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    whole = complete_rows(table, names)
    if fits_arrays(rows, 2 * k):
        # all ranks of a session have the mean (n + 1) / 2: what lies between sessions is one number
        sums = rank_products(whole, names, "event_time")
        n, middle = F.col("n").cast("double"), (F.col("n") + 1) / 2.0
        pooled = sums.agg(
            F.sum("n").alias("observations"),
            (F.sum(n * middle * middle) - F.sum(n * middle) * F.try_divide(F.sum(n * middle), F.sum(n))).alias("_between"),
            *[F.sum(F.col("products")[p]).alias(f"_c{i}_{j}") for p, (i, j) in enumerate(cells)],
        )
        share = lambda i, j: F.try_divide(F.col(f"_c{i}_{j}") + F.col("_between"), F.col("observations"))
        moments = pooled.select(
            F.coalesce("observations", F.lit(0)).alias("observations"), *[share(i, j).alias(f"_v{i}_{j}") for i, j in cells]
        )
    else:
        ranks = {f"_r{i}": n for i, n in enumerate(names)}
        ranked = with_average_ranks(whole.select("event_time", "symbol", *names), ranks, ["event_time"], rows)
        moments = ranked.agg(
            F.count(F.lit(1)).alias("observations"),
            *[F.covar_pop(f"_r{i}", f"_r{j}").alias(f"_v{i}_{j}") for i, j in cells],
        )
    entries = F.array(
        *[
            F.struct(
                F.lit(names[i]).alias("left"),
                F.lit(names[j]).alias("right"),
                F.try_divide(
                    F.col(f"_v{i}_{j}"), F.sqrt(F.col(f"_v{i}_{i}")) * F.sqrt(F.col(f"_v{j}_{j}"))
                ).alias("rho"),
            )
            for i, j in cells
        ]
    )
    return moments.select("observations", F.explode(entries).alias("e")).select(
        "e.left", "e.right", "e.rho", "observations"
    )


def overlap_summary(correlations: DataFrame) -> DataFrame:
    """Effective number of factors and share of the first component.

    The eigenvalues of a correlation matrix sum to k and their squares to the
    squared entries, so the effective number needs no eigensolver.  The first
    eigenvalue is read from the k-by-k matrix, which is a few hundred numbers.
    """
    both = correlations.select("left", "right", "rho").unionByName(
        correlations.where("left <> right").select(
            F.col("right").alias("left"), F.col("left").alias("right"), "rho"
        )
    )
    square = F.sum(F.col("rho") * F.col("rho"))
    entries = F.sort_array(F.collect_list(F.struct("left", "right", "rho")))
    return both.agg(
        F.countDistinct("left").alias("factors"),
        (F.countDistinct("left") * F.countDistinct("left") / square).alias("effective_factors"),
        (_largest_share(F.transform(entries, lambda e: e["rho"]))).alias("first_component"),
    )


@F.pandas_udf(T.DoubleType())
def _largest_share(flat: pd.Series) -> pd.Series:
    """Largest eigenvalue over the trace of a matrix stored row by row."""

    def share(values) -> float:
        k = int(round(len(values) ** 0.5))
        return float(np.linalg.eigvalsh(np.asarray(values, dtype=float).reshape(k, k))[-1] / k)

    return flat.map(share)


def redundant_pairs(correlations: DataFrame, threshold: float = REDUNDANT) -> DataFrame:
    return correlations.where("left <> right").where(F.abs("rho") >= threshold).select("left", "right", "rho")


def signal_counts(table: DataFrame, names: list[str]) -> DataFrame:
    """``(factor, signals, rows)``: finite signals of every factor over all rows."""
    counts = table.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(finite(F.col(n))).alias(n) for n in names])
    return counts.unpivot(["rows"], names, "factor", "signals").select("factor", "signals", "rows")


def skipped_factors(table: DataFrame, names: list[str]) -> DataFrame:
    """Factors without one finite signal: their lookback exceeds the window."""
    return signal_counts(table, names).where("signals = 0").drop("rows")


def covered_factors(table: DataFrame, names: list[str], least: float = 0.0) -> list[str]:
    """Factors whose signals are at least ``least`` of all rows, and not none, in the order of ``names``.

    A composite keeps complete rows only, so one factor with few signals would leave few rows to
    all.  One row of counts comes to the driver.
    """
    kept = {r["factor"] for r in signal_counts(table, names).where((F.col("signals") > 0) & (F.col("signals") >= least * F.col("rows"))).collect()}
    return [n for n in names if n in kept]


def ic_weights(
    table: DataFrame, names: list[str], horizon: int, min_names: int = MIN_NAMES, rows: int | None = None
) -> DataFrame:
    """One row, one weight per factor: positive mean IC, normalised.

    ``table`` holds complete rows, so the factors share their sessions and are
    ranked side by side; equal weights when no mean IC is positive.
    """
    forward = f"fwd_{horizon}"
    usable = table.where(F.col(forward).isNotNull()).select("event_time", forward, *names)
    if fits_arrays(rows, len(names) + 1):
        scores = session_scores(usable, {n: (n, forward) for n in names}, ["event_time"])
        ics = [F.max(F.when(F.col("_label") == n, F.col("ic"))).alias(f"_ic{i}") for i, n in enumerate(names)]
        per = scores.where(F.col("names") >= min_names).groupBy("event_time").agg(*ics)
    else:
        ranks = {f"_r{i}": n for i, n in enumerate(names)} | {"_rf": forward}
        per = (
            with_average_ranks(usable, ranks, ["event_time"], rows)
            .groupBy("event_time")
            .agg(
                F.count(F.lit(1)).alias("_n"),
                *[rank_corr(F.col(f"_r{i}"), F.col("_rf")).alias(f"_ic{i}") for i in range(len(names))],
            )
            .where(F.col("_n") >= min_names)
        )
    scores = per.agg(
        *[
            F.when(F.count(f"_ic{i}") >= 2, F.greatest(F.avg(f"_ic{i}"), F.lit(0.0)))
            .otherwise(F.lit(0.0))
            .alias(f"_s{i}")
            for i in range(len(names))
        ]
    )
    total = sum((F.col(f"_s{i}") for i in range(1, len(names))), F.col("_s0"))
    return scores.select(
        *[
            F.when(total > 0, F.try_divide(F.col(f"_s{i}"), total)).otherwise(1.0 / len(names)).alias(n)
            for i, n in enumerate(names)
        ]
    )


def combine_factors(
    table: DataFrame,
    names: list[str],
    horizon: int,
    ic_weighted: bool = True,
    orthogonal: bool = True,
    min_names: int = MIN_NAMES,
    rows: int | None = None,
    sessions: int | None = None,
) -> DataFrame:
    """Composite signal of the bars on which every factor is defined.

    Weights come from the raw factors; the z-scores come after.
    """
    joined = complete_rows(table, names)
    standard = zscore_by_session(joined, names, rows)
    if orthogonal:
        standard = orthogonalise(standard, names, min_names, sessions)
    if ic_weighted:
        one_row = ic_weights(joined, names, horizon, min_names, rows).select(
            *[F.col(n).alias(f"_w_{n}") for n in names]
        )
        standard = standard.join(F.broadcast(one_row), F.lit(True), "left")
        signal = sum((F.col(n) * F.col(f"_w_{n}") for n in names), F.lit(0.0))
    else:
        signal = sum((F.col(n) for n in names), F.lit(0.0)) / len(names)
    forward = [c for c in table.columns if c.startswith("fwd_")]
    return standard.withColumn("signal", signal).where(finite(F.col("signal"))).select(
        "event_time", "symbol", "signal", *forward
    )
