"""Risk rules, reconciliation and audits over order and position tables."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Thresholds of the rules (fixed defaults)."""

    max_order_notional: float = 500_000.0
    max_position_pct: float = 0.10
    price_band_pct: float = 0.05
    max_orders_per_minute: int = 20
    max_open_orders: int = 50
    max_gross_exposure_pct: float = 1.50
    max_net_exposure_pct: float = 1.00
    max_cluster_pct: float = 0.30
    daily_loss_limit_pct: float = -0.03
    max_adv_participation: float = 0.05

    def __post_init__(self) -> None:
        if self.daily_loss_limit_pct >= 0:
            raise ValueError("a loss limit is negative")
        if min(self.max_order_notional, self.max_position_pct, self.max_gross_exposure_pct) <= 0:
            raise ValueError("size limits are positive")


#: Drawdown at or below which a rung engages, the size it leaves, and whether it
#: halts trading (fixed values, shallow to deep).
LADDER = ((-0.05, 0.50, False), (-0.08, 0.25, False), (-0.10, 0.0, True))

#: States an order may move to from each state (fixed values).
TRANSITIONS = {
    "CREATED": ("RISK_CHECKED", "REJECTED"),
    "RISK_CHECKED": ("SUBMITTED", "REJECTED"),
    "SUBMITTED": ("ACKNOWLEDGED", "REJECTED", "UNKNOWN", "PARTIALLY_FILLED", "FILLED"),
    "ACKNOWLEDGED": ("PARTIALLY_FILLED", "FILLED", "CANCEL_REQUESTED", "CANCELLED", "REJECTED", "UNKNOWN"),
    "PARTIALLY_FILLED": ("PARTIALLY_FILLED", "FILLED", "CANCEL_REQUESTED", "CANCELLED", "UNKNOWN"),
    "CANCEL_REQUESTED": ("CANCELLED", "FILLED", "PARTIALLY_FILLED", "UNKNOWN"),
    "UNKNOWN": ("ACKNOWLEDGED", "PARTIALLY_FILLED", "FILLED", "CANCELLED", "REJECTED"),
    "FILLED": (),
    "REJECTED": (),
    "CANCELLED": (),
}
LIVE = ("SUBMITTED", "ACKNOWLEDGED", "PARTIALLY_FILLED", "CANCEL_REQUESTED", "UNKNOWN")
CHECK = "struct<check:string,passed:boolean,observed:double,threshold:double>"


def state_measures(state: DataFrame) -> DataFrame:
    """Drawdown and day result as fractions; 0 where the base is not positive."""
    def change(now: str, base: str) -> Column:
        return F.coalesce(F.try_divide(F.col(now) - F.col(base), F.when(F.col(base) > 0, F.col(base))), F.lit(0.0))

    return state.withColumns(
        {"drawdown": change("equity", "peak_equity"), "day_pnl_pct": change("equity", "day_start_equity")}
    )


def exposures(positions: DataFrame, account: list[str]) -> DataFrame:
    return positions.groupBy(*account).agg(
        F.sum(F.abs("notional")).alias("gross_exposure"), F.sum("notional").alias("net_exposure")
    )


def with_rung(state: DataFrame) -> DataFrame:
    """Deepest engaged rung of the drawdown ladder: scale and halt."""
    scale, halt = F.lit(1.0), F.lit(False)
    for depth, size, stops in LADDER:
        engaged = F.col("drawdown") <= depth
        scale = F.when(engaged, size).otherwise(scale)
        halt = F.when(engaged, F.lit(stops)).otherwise(halt)
    return state.withColumns({"scale": scale, "halt": halt})


def _check(name: str, passed: Column, observed: Column | None = None, threshold: float | None = None) -> Column:
    seen = F.lit(None) if observed is None else observed
    return F.struct(
        F.lit(name).alias("check"),
        passed.alias("passed"),
        seen.cast("double").alias("observed"),
        F.lit(threshold).cast("double").alias("threshold"),
    ).cast(CHECK)


def check_orders(orders: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Every rule for every order, as an array of checks.

    ``orders`` carries the state it is judged against: ``price, notional,
    signed_notional, last_price, held, adv, cluster, cluster_held, equity,
    gross_exposure, net_exposure, open_orders, orders_this_minute, day_pnl_pct,
    drawdown, halt``.
    """
    c, lim = F.col, limits
    solvent = c("equity") > 0
    share = lambda x: F.try_divide(x, F.when(solvent, c("equity")))
    band = F.try_divide(F.abs(c("price") - c("last_price")), F.when(c("last_price") > 0, c("last_price")))
    size = share(F.abs(F.coalesce("held", F.lit(0.0)) + c("signed_notional")))
    take = F.try_divide(c("notional"), F.when(c("adv") > 0, c("adv")))
    gross = share(c("gross_exposure") + c("notional"))
    net = share(F.abs(c("net_exposure") + c("signed_notional")))
    group = share(F.abs(F.coalesce("cluster_held", F.lit(0.0)) + c("signed_notional")))
    no = F.lit(False)
    listed = [
        _check("order_notional", c("notional") <= lim.max_order_notional, c("notional"), lim.max_order_notional),
        _check("order_rate", c("orders_this_minute") < lim.max_orders_per_minute, c("orders_this_minute"), lim.max_orders_per_minute),
        _check("open_orders", c("open_orders") < lim.max_open_orders, c("open_orders"), lim.max_open_orders),
        # no last price: the order cannot be shown sane
        _check("price_band", F.coalesce(band <= lim.price_band_pct, no), band, lim.price_band_pct),
        _check("position_size", F.coalesce(size <= lim.max_position_pct, no), size, lim.max_position_pct),
        # no volume: not judged
        _check("liquidity", F.coalesce(take <= lim.max_adv_participation, F.lit(True)), take, lim.max_adv_participation),
        F.when(~solvent, _check("portfolio", no)),
        F.when(solvent, _check("gross_exposure", gross <= lim.max_gross_exposure_pct, gross, lim.max_gross_exposure_pct)),
        F.when(solvent, _check("net_exposure", net <= lim.max_net_exposure_pct, net, lim.max_net_exposure_pct)),
        F.when(solvent, _check("daily_loss", c("day_pnl_pct") > lim.daily_loss_limit_pct, c("day_pnl_pct"), lim.daily_loss_limit_pct)),
        F.when(
            solvent & c("cluster").isNotNull(),
            _check("cluster_concentration", group <= lim.max_cluster_pct, group, lim.max_cluster_pct),
        ),
        _check("drawdown_ladder", ~c("halt"), c("drawdown"), LADDER[-1][0]),
    ]
    return orders.withColumn("checks", F.filter(F.array(*listed), lambda x: x.isNotNull()))


def check_rows(checked: DataFrame, order_id: str = "order_id") -> DataFrame:
    """One row per order and rule."""
    return checked.select(order_id, F.explode("checks").alias("c")).select(order_id, "c.*")


def verdicts(checked: DataFrame, order_id: str = "order_id") -> DataFrame:
    """ALLOW or BLOCK, the breaches and the size scale of each order."""
    broken = F.transform(F.filter("checks", lambda x: ~x["passed"]), lambda x: x["check"])
    return checked.select(
        order_id,
        F.when(F.forall("checks", lambda x: x["passed"]), "ALLOW").otherwise("BLOCK").alias("decision"),
        F.array_sort(broken).alias("breaches"),
        "scale",
    )


def limit_utilisation(observations: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Observed against threshold per account; null where nothing is measured.

    A negative limit is breached below it, a positive one above it.
    """
    spark = observations.sparkSession
    rows = [(f.name, float(getattr(limits, f.name))) for f in fields(limits)]
    table = spark.createDataFrame(rows, "name string, threshold double")
    accounts = observations.select("account").distinct()
    seen = observations.select("account", "name", "observed")
    grid = accounts.withColumn("name", F.explode(F.array(*[F.lit(n) for n, _ in rows])))
    joined = grid.join(F.broadcast(table), "name").join(seen, ["account", "name"], "left")
    size, limit = F.col("observed"), F.col("threshold")
    return joined.withColumns(
        {
            "utilisation": F.try_divide(size, limit),
            "within": F.when(size.isNotNull(), F.when(limit < 0, size > limit).otherwise(F.abs(size) <= limit)),
        }
    )


def reconcile(
    internal: DataFrame, broker: DataFrame, keys: list[str], quantity_tolerance: float = 0.0, price_tolerance: float = 0.0
) -> DataFrame:
    """Breaks between own open positions and the broker's."""
    a = internal.where("position <> 0").select(*keys, F.col("position").alias("ours"), F.col("average_cost").alias("our_price"))
    b = broker.select(*keys, F.col("position").alias("theirs"), F.col("average_cost").alias("their_price"))
    both = a.join(b, keys, "full_outer")
    gap = F.abs(F.col("ours") - F.col("theirs")).cast("double")
    kind = (
        F.when(F.col("theirs").isNull(), "PHANTOM")
        .when(F.col("ours").isNull(), "UNRECORDED")
        .when(gap > quantity_tolerance, "QUANTITY")
        .when(F.abs(F.col("our_price") - F.col("their_price")) > price_tolerance, "PRICE")
    )
    price = F.col("kind") == "PRICE"
    zero = F.lit(0.0)
    return both.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(
        *keys,
        "kind",
        F.when(price, F.col("our_price")).otherwise(F.coalesce(F.col("ours").cast("double"), zero)).alias("internal"),
        F.when(price, F.col("their_price")).otherwise(F.coalesce(F.col("theirs").cast("double"), zero)).alias("broker"),
    )


def halt_required(breaks: DataFrame, keys: list[str]) -> DataFrame:
    """Per account: breaks, critical ones, and whether trading must stop."""
    critical = F.count_if(F.col("kind").isin("PHANTOM", "UNRECORDED", "QUANTITY"))
    return breaks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("breaks"), critical.alias("critical"), (critical > 0).alias("should_halt")
    )


def transition_audit(history: DataFrame, order_id: str = "order_id", order: str = "seq") -> DataFrame:
    """Steps of an order's life that the transition table does not allow."""
    spark = history.sparkSession
    table = legal_transitions(spark)
    w = W.partitionBy(order_id).orderBy(order)
    steps = history.withColumn("previous", F.lag("state").over(w)).where(F.col("previous").isNotNull())
    return steps.join(
        F.broadcast(table), (steps["previous"] == table["from_state"]) & (steps["state"] == table["to_state"]), "left_anti"
    )


def legal_transitions(spark: SparkSession) -> DataFrame:
    pairs = [(a, b) for a, targets in TRANSITIONS.items() for b in targets]
    return spark.createDataFrame(pairs, "from_state string, to_state string")


def state_flags(state: Column) -> dict[str, Column]:
    ended = [s for s, targets in TRANSITIONS.items() if not targets]
    return {"is_terminal": state.isin(*ended), "is_live": state.isin(*LIVE)}


def feed_health(last_seen: DataFrame, now: Column, degraded: int = 3600, down: int = 86400) -> DataFrame:
    """ok, degraded or down by the age of the last row."""
    age = F.unix_seconds(now) - F.unix_seconds("last_seen")
    return last_seen.withColumns(
        {
            "stale_seconds": age,
            "health": F.when(age <= degraded, "ok").when(age <= down, "degraded").otherwise("down"),
        }
    )


def alerts(health: DataFrame, breaks: DataFrame, states: DataFrame, checked: DataFrame) -> DataFrame:
    """Alert rows of every kind with a severity."""
    stale = health.where("health <> 'ok'").select(
        F.lit("data_stale").alias("kind"),
        F.col("feed").alias("subject"),
        F.when(F.col("health") == "down", "CRITICAL").otherwise("WARN").alias("severity"),
        F.col("stale_seconds").cast("double").alias("value"),
    )
    broken = breaks.groupBy("account").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("reconciliation_break").alias("kind"),
        F.col("account").cast("string").alias("subject"),
        F.lit("CRITICAL").alias("severity"),
        F.col("n").cast("double").alias("value"),
    )
    rung = states.where("scale < 1").select(
        F.lit("drawdown_rung").alias("kind"),
        F.col("account").cast("string").alias("subject"),
        F.when(F.col("halt"), "CRITICAL").otherwise("WARN").alias("severity"),
        F.col("drawdown").alias("value"),
    )
    blocked = F.count_if(~F.forall("checks", lambda x: x["passed"]))
    breach = checked.groupBy("account").agg(blocked.alias("n")).where("n > 0").select(
        F.lit("risk_breach").alias("kind"),
        F.col("account").cast("string").alias("subject"),
        F.lit("WARN").alias("severity"),
        F.col("n").cast("double").alias("value"),
    )
    return stale.unionByName(broken).unionByName(rung).unionByName(breach)


def daily_summary(curve: DataFrame) -> DataFrame:
    """Result and open positions of every account and day; the ``previous`` equity is looked up where the curve lacks it."""
    before = F.col("previous") if "previous" in curve.columns else F.lag("equity").over(W.partitionBy("account").orderBy("date"))
    change = F.col("equity") - before
    return curve.select("account", "date", change.alias("pnl"), "positions").where(F.col("pnl").isNotNull())
