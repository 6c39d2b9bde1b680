"""Guarded aggregates: ANSI mode raises where the study expects 0 or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """Not null, not NaN, not infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def centred(x: Column, y: Column) -> dict[str, Column]:
    """Population moments of the rows where both values exist."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return {
        "n": F.count(a),
        "cov": F.covar_pop(a, b),
        "vx": F.var_pop(a),
        "vy": F.var_pop(b),
    }


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; null when either side is flat."""
    m = centred(x, y)
    spread = F.sqrt(m["vx"]) * F.sqrt(m["vy"])
    return F.when(spread > 0, F.try_divide(m["cov"], spread))


def rank_corr(a: Column, b: Column) -> Column:
    """Correlation of two rank columns, both never null.

    Ranks are multiples of one half, so every sum is exact and the result does
    not depend on the order of addition.
    """
    n = F.count(F.lit(1))
    va = n * F.sum(a * a) - F.sum(a) * F.sum(a)
    vb = n * F.sum(b * b) - F.sum(b) * F.sum(b)
    return F.try_divide(n * F.sum(a * b) - F.sum(a) * F.sum(b), F.sqrt(va) * F.sqrt(vb))


def slope(y: Column, x: Column) -> Column:
    m = centred(x, y)
    return F.when(m["vx"] > 0, F.try_divide(m["cov"], m["vx"]))


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    lo = low if isinstance(low, Column) else F.lit(low)
    hi = high if isinstance(high, Column) else F.lit(high)
    return F.least(F.greatest(x, lo), hi)
