"""Scalar helpers: keys, money, ticks and lots."""

from __future__ import annotations

import statistics

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def safe_key(col: Column) -> Column:
    """Identifier usable as a file or table name."""
    return F.translate(col, ":/", "__")


def instrument_id(venue: str, isin: Column, symbol: Column) -> Column:
    """``VENUE:`` plus the ISIN, or the folded symbol where none is known."""
    return F.concat(F.lit(f"{venue}:"), F.coalesce(F.nullif(F.trim(isin), F.lit("")), F.upper(symbol)))


def money(col: Column) -> Column:
    """Half-up cents of a decimal."""
    return F.round(col, 2)


def money_up(col: Column) -> Column:
    """Cents rounded up, for fees a regulator never rounds down."""
    return F.ceil(col, F.lit(2))


def clip(col: Column, low: float, high: float) -> Column:
    """Value held within ``[low, high]``; null stays null, not a number goes to ``high`` as Spark's greatest value."""
    return F.when(col.isNotNull(), F.greatest(F.least(col, F.lit(high)), F.lit(low)))


def to_tick(price: Column, tick: Column) -> Column:
    """Nearest multiple of the tick, halves to even."""
    return F.bround(price / tick, 0) * tick


def whole_lots(quantity: Column, lot: Column) -> Column:
    """Quantity cut toward zero to whole lots."""
    return F.signum(quantity.cast("double")).cast("decimal(1,0)") * F.floor(F.abs(quantity) / lot) * lot


def notional(price: Column, quantity: Column, multiplier: Column | None = None) -> Column:
    value = price * quantity
    return value if multiplier is None else value * multiplier


@F.pandas_udf(T.DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    """Standard normal distribution function (Spark has no ``erf``)."""
    cdf = statistics.NormalDist().cdf
    return x.map(lambda v: None if pd.isna(v) else cdf(v)).astype("float64")


@F.pandas_udf(T.DoubleType())
def normal_ppf(p: pd.Series) -> pd.Series:
    """Inverse of the standard normal distribution function on (0, 1)."""
    ppf = statistics.NormalDist().inv_cdf
    return p.map(lambda v: ppf(v) if 0.0 < v < 1.0 else None).astype("float64")
