"""Fixed schemas; every writer projects and casts to one of these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR = T.StructType(
    [
        T.StructField("instrument_id", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("receive_time", T.TimestampType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
        T.StructField("trades", T.LongType()),
    ]
)

PANEL = T.StructType([BAR[0], T.StructField("symbol", T.StringType()), *BAR.fields[1:]])

MONEY = T.DecimalType(28, 10)

#: Seconds per bar of each supported timeframe (fixed values).
TIMEFRAMES = {
    "1m": 60,
    "5m": 300,
    "15m": 900,
    "30m": 1800,
    "1h": 3600,
    "4h": 14400,
    "1d": 86400,
}


class SchemaError(ValueError):
    """A frame that may not be written."""


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project and cast to ``schema``; missing or zone-less columns are errors."""
    have = {f.name: f.dataType for f in df.schema}
    missing = [f.name for f in schema if f.name not in have]
    if missing:
        raise SchemaError(f"missing columns: {missing}")
    naive = [
        f.name
        for f in schema
        if isinstance(f.dataType, T.TimestampType) and isinstance(have[f.name], T.TimestampNTZType)
    ]
    if naive:
        raise SchemaError(f"timestamps without a zone: {naive}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def bad_ohlc() -> Column:
    """Rows whose prices contradict each other."""
    c = F.col
    return (
        (c("low") <= 0)
        | (c("high") < c("low"))
        | (c("open") > c("high"))
        | (c("open") < c("low"))
        | (c("close") > c("high"))
        | (c("close") < c("low"))
    )


def acausal() -> Column:
    return F.col("receive_time") < F.col("event_time")
