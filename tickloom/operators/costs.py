"""Trading-cost schedules as decimal column structs.

A cost model is a function of columns that returns a struct, so any schedule can
be added by writing such a function.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalar import money, money_up

COMPONENTS = (
    "brokerage", "stt", "exchange_fee", "regulatory_fee", "stamp_duty", "gst",
    "depository_fee", "slippage", "funding",
)
NOTIONAL = "decimal(24,6)"
RATE = "decimal(9,7)"
CENTS = "decimal(28,2)"


@dataclass(frozen=True)
class Schedule:
    """Rates of one Indian segment (fixed values, fractions of turnover)."""

    stt_buy: str
    stt_sell: str
    stamp_buy: str
    exchange: str
    brokerage: str = "0"
    depository: str = "0"


TURNOVER_FEE = "0.000001"
TAX_ON_FEES = "0.18"
EXERCISE_STT = "0.00125"
DELIVERY = Schedule("0.001", "0.001", "0.00015", "0.0000297", depository="15.34")
INTRADAY = Schedule("0", "0.00025", "0.00003", "0.0000297")
FUTURES = Schedule("0", "0.0002", "0.00002", "0.0000173", brokerage="20")
OPTIONS = Schedule("0", "0.001", "0.00003", "0.0003503", brokerage="20")

SEC_FEE = "0.0000278"
TAF_PER_SHARE = "0.000166"
TAF_CAP = "8.30"

SPREAD_BPS = "5"
IMPACT = 0.7
VOLATILITY = 0.02


def _rate(text: str) -> Column:
    return F.lit(Decimal(text)).cast(RATE)


def _flat(text: str) -> Column:
    return F.lit(Decimal(text)).cast("decimal(12,2)")


def notional_of(quantity: Column, price: Column) -> Column:
    return (quantity * price).cast(NOTIONAL)


def slippage(
    notional: Column,
    adv: Column | None = None,
    spread: Column | None = None,
    quantity: Column | None = None,
    volatility: Column | None = None,
    scale: float = 1.0,
) -> Column:
    """Half the spread plus square-root impact; no impact without a volume."""
    if spread is None:
        half = (notional * F.lit(Decimal(SPREAD_BPS)).cast("decimal(6,2)") / F.lit(20000)).cast("decimal(28,8)")
    else:
        half = (spread / 2 * quantity).cast("decimal(28,8)")
    if adv is None:
        impact = F.lit(0).cast("decimal(28,8)")
    else:
        size = notional.cast("double")
        vol = F.lit(VOLATILITY) if volatility is None else F.coalesce(volatility, F.lit(VOLATILITY))
        # sqrt is a double in Spark: back to decimal before any rounding
        felt = F.lit(IMPACT) * vol * F.sqrt(F.try_divide(size, F.when(adv > 0, adv))) * size
        impact = F.coalesce(felt, F.lit(0.0)).cast("decimal(28,8)")
    total = half + impact
    return total if scale == 1.0 else total * F.lit(Decimal(str(scale))).cast("decimal(6,2)")


def _struct(**given: Column) -> Column:
    zero = F.lit(0).cast(CENTS)
    return F.struct(*[given.get(c, zero).cast(CENTS).alias(c) for c in COMPONENTS])


def indian(schedule: Schedule, side: Column, notional: Column, slip: Column) -> Column:
    """One Indian segment; each component is rounded half-up to the paisa."""
    sell = side == "SELL"
    exchange = notional * _rate(schedule.exchange)
    turnover = notional * _rate(TURNOVER_FEE)
    brokerage = _flat(schedule.brokerage)
    fees = (brokerage.cast("decimal(28,13)") + exchange + turnover).cast("decimal(28,13)")
    return _struct(
        brokerage=brokerage,
        stt=money(notional * F.when(sell, _rate(schedule.stt_sell)).otherwise(_rate(schedule.stt_buy))),
        exchange_fee=money(exchange),
        regulatory_fee=money(turnover),
        stamp_duty=money(notional * F.when(sell, _rate("0")).otherwise(_rate(schedule.stamp_buy))),
        gst=money(fees * F.lit(Decimal(TAX_ON_FEES)).cast("decimal(4,2)")),
        depository_fee=F.when(sell, _flat(schedule.depository)).otherwise(_flat("0")),
        slippage=money(slip),
    )


def exercise_stt(intrinsic: Column) -> Column:
    """Tax on an option that expires in the money."""
    return money(intrinsic.cast(NOTIONAL) * _rate(EXERCISE_STT))


def us_equity(side: Column, quantity: Column, notional: Column, slip: Column) -> Column:
    """Regulatory fees on sells only, rounded up to the cent."""
    sell = side == "SELL"
    fee = notional * _rate(SEC_FEE) + _taf(quantity)
    return _struct(
        regulatory_fee=F.when(sell, money_up(fee)).otherwise(F.lit(0)),
        slippage=money(slip),
    )


def _taf(quantity: Column) -> Column:
    per_share = quantity.cast("decimal(18,4)") * F.lit(Decimal(TAF_PER_SHARE)).cast("decimal(9,6)")
    return F.least(per_share.cast("decimal(28,10)"), F.lit(Decimal(TAF_CAP)).cast("decimal(28,10)"))


def us_round_trip_bps(notional: Column, shares: Column) -> Column:
    fee = (notional * _rate(SEC_FEE) + _taf(shares)).cast("double")
    return F.when(notional > 0, F.try_divide(fee, notional.cast("double")) * 10000).otherwise(0.0)


def total(costs: Column) -> Column:
    out = costs[COMPONENTS[0]]
    for name in COMPONENTS[1:]:
        out = out + costs[name]
    return out.cast(CENTS)


def explicit(costs: Column) -> Column:
    """What a broker itemises: no slippage, no funding."""
    return (total(costs) - costs["slippage"] - costs["funding"]).cast(CENTS)


def bps(costs: Column, notional: Column) -> Column:
    return F.coalesce(F.try_divide(total(costs).cast("double"), notional.cast("double")) * 10000, F.lit(0.0))


def add(a: Column, b: Column) -> Column:
    return _struct(**{c: a[c] + b[c] for c in COMPONENTS})


def scale(costs: Column, factor: str) -> Column:
    """Every component times a factor, for sensitivity runs."""
    by = F.lit(Decimal(factor)).cast("decimal(8,4)")
    return _struct(**{c: money(costs[c] * by) for c in COMPONENTS})


def priced(trades: DataFrame, model: Callable[[], Column]) -> DataFrame:
    """Trades with the itemised costs of a model and their totals."""
    df = trades.withColumn("costs", model())
    c = F.col("costs")
    return df.withColumns({"total_cost": total(c), "explicit_cost": explicit(c)})


def sums(priced_trades: DataFrame, keys: list[str]) -> DataFrame:
    """Component sums per group."""
    parts = [F.sum(F.col("costs")[c]).alias(c) for c in COMPONENTS]
    return priced_trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("trades"), *parts, F.sum("total_cost").alias("total"))
