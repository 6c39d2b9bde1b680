"""The research tables derived from the star-schema inputs.

Each builder has a twin in ``CTES``: the same definition as plain SQL, so an
oracle can state what a query should return.  Sums of doubles are rounded before
they are divided, and every ordering key is unique.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.windows import by
from tickloom.session import configure
from tickloom.sizing import counted, fits_task, footer_rows

SMOOTH = 60
SPLIT_ROW = 200
#: Rows above which a panel's names and sessions are counted: the footers' bound is far too high.
COUNTED_ROWS = 1_000_000
_schemas: dict = {}


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    configure(spark)
    path = f"{d}/{name}.parquet"
    if path not in _schemas:  # inferring one costs a job
        _schemas[path] = spark.read.parquet(path).schema
    df = spark.read.schema(_schemas[path]).parquet(path)
    zoneless = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def lines(spark: SparkSession, d: str, name: str = "lineitem") -> int:
    """Footer row count."""
    return footer_rows(spark, f"{d}/{name}.parquet")


def rows(spark: SparkSession, d: str) -> int:
    """Bounds any name, session, decision or calendar of a panel built from ``lineitem``.

    A panel has at most one row for a supplier and a ship date, so where the
    footers say too little the larger of their two numbers is the bound.
    """
    total = lines(spark, d)
    if fits_task(total) and total <= COUNTED_ROWS:
        return total

    def count() -> int:
        ends = load(spark, d, "lineitem").agg(F.countDistinct("l_suppkey"), F.countDistinct(F.to_date("l_shipdate")))
        return max(ends.first())

    return counted(spark, f"{d}/lineitem.parquet", "panel", count)


def fill_rows(spark: SparkSession, d: str, keys: list[str], bound: int | None = None) -> int:
    """Fills of the largest key, counted where the footers give more than ``bound``, else than a task may hold."""
    total = lines(spark, d)
    if fits_task(total) and total <= (bound or total):
        return total
    each = fills(spark, d).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counted(spark, f"{d}/lineitem.parquet", ",".join(keys), lambda: each.agg(F.max("n")).first()[0])


def symbol_of(key: str) -> Column:
    return F.concat(F.lit("S"), F.lpad(F.col(key).cast("string"), 10, "0"))


def instrument_of(key: str) -> Column:
    kind = F.when(F.col(key) % 10 == 0, F.lit("X:INF")).otherwise(F.lit("X:INE"))
    return F.concat(kind, F.lpad(F.col(key).cast("string"), 10, "0"))


def _stamped(df: DataFrame) -> DataFrame:
    close_time = F.col("session").cast("timestamp") + F.expr("INTERVAL 10 HOURS")
    return df.withColumns(
        {"event_time": close_time, "receive_time": close_time + F.expr("INTERVAL 150 MINUTES")}
    )


def panel_raw(spark: SparkSession, d: str) -> DataFrame:
    """One row per supplier and ship date: the daily volume-weighted price."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    daily = (
        load(spark, d, "lineitem")
        .groupBy(F.col("l_suppkey").alias("sym_no"), F.to_date("l_shipdate").alias("session"))
        .agg(
            F.round(F.sum("l_extendedprice"), 2).alias("amount"),
            F.sum("l_quantity").alias("volume"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.count(F.lit(1)).alias("trades"),
        )
    )
    return _stamped(daily).select(
        "sym_no",
        instrument_of("sym_no").alias("instrument_id"),
        symbol_of("sym_no").alias("symbol"),
        "session",
        "event_time",
        "receive_time",
        ((F.col("high") + F.col("low")) / 2).alias("open"),
        "high",
        "low",
        (F.col("amount") / F.col("volume")).alias("close"),
        "volume",
        "trades",
        "amount",
    )


def panel_smooth(spark: SparkSession, d: str) -> DataFrame:
    """Trailing 60-row volume-weighted price, with a narrow range around it."""
    frame = by().rowsBetween(-(SMOOTH - 1), 0)
    close = F.round(F.sum("amount").over(frame), 2) / F.sum("volume").over(frame)
    base = (
        panel_raw(spark, d)
        .withColumns({"close": close, "rn": F.row_number().over(by())})
        .where(F.col("rn") >= SMOOTH)
    )
    opened = F.col("close") * (1 + (F.col("volume") % 5 - 2) * 0.001)
    return base.withColumn("open", opened).select(
        "sym_no",
        "instrument_id",
        "symbol",
        "session",
        "event_time",
        "receive_time",
        "open",
        (F.greatest("open", "close") * 1.002).alias("high"),
        (F.least("open", "close") * 0.998).alias("low"),
        "close",
        "volume",
        "trades",
        (F.col("rn") - (SMOOTH - 1)).alias("rn"),
    )


def panel_split(spark: SparkSession, d: str) -> DataFrame:
    """``panel_smooth`` with a known split from the 200th row of some names."""
    ratio = (
        F.when((F.col("rn") >= SPLIT_ROW) & (F.col("sym_no") % 5 == 0), F.lit(0.5))
        .when((F.col("rn") >= SPLIT_ROW) & (F.col("sym_no") % 5 == 1), F.lit(0.2))
        .otherwise(F.lit(1.0))
    )
    return panel_smooth(spark, d).withColumns(
        {c: F.col(c) * ratio for c in ("open", "high", "low", "close")}
    )


def actions(spark: SparkSession, d: str) -> DataFrame:
    """Splits of ``panel_split`` and a dividend for every seventh name."""
    at = panel_smooth(spark, d).where(F.col("rn") == SPLIT_ROW)
    split = at.where(F.col("sym_no") % 5 <= 1).select(
        "instrument_id",
        "symbol",
        F.lit("SPLIT").alias("action_type"),
        F.col("session").alias("ex_date"),
        F.date_sub("session", 10).alias("announcement_date"),
        F.when(F.col("sym_no") % 5 == 0, 2.0).otherwise(5.0).alias("ratio"),
        F.lit(0.0).alias("cash_per_share"),
    )
    dividend = at.where(F.col("sym_no") % 7 == 0).select(
        "instrument_id",
        "symbol",
        F.lit("DIVIDEND").alias("action_type"),
        F.col("session").alias("ex_date"),
        F.lit(None).cast("date").alias("announcement_date"),
        F.lit(1.0).alias("ratio"),
        F.lit(1.5).alias("cash_per_share"),
    )
    return split.unionByName(dividend)


def ticks(spark: SparkSession, d: str) -> DataFrame:
    lag_seconds = F.make_dt_interval(secs=F.col("event_id") % 90)
    return load(spark, d, "events").select(
        F.concat(F.lit("U"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("instrument_id"),
        F.col("ts").alias("event_time"),
        (F.col("ts") + lag_seconds).alias("receive_time"),
        F.col("value").alias("price"),
        F.col("event_id").alias("sequence"),
        "event_type",
        "props",
    )


def fills(spark: SparkSession, d: str, by_keys: list[str] | None = None) -> DataFrame:
    """Line items as executions, shuffled by ``by_keys``; the order key is every column of the line."""
    line = load(spark, d, "lineitem").withColumns({"account": F.col("l_suppkey"), "instrument": F.col("l_partkey") % 20}).drop("l_suppkey")
    if by_keys:
        line = line.repartition(*by_keys)
    price = half_away(F.col("l_extendedprice") / F.col("l_quantity"), 2)
    return line.select(
        "account",
        "instrument",
        F.when(F.col("l_linenumber") % 2 == 1, "BUY").otherwise("SELL").alias("side"),
        F.col("l_quantity").cast("decimal(18,4)").alias("quantity"),
        price.cast("decimal(18,4)").alias("price"),
        half_away(F.col("l_extendedprice") * F.col("l_tax") / 100, 2).cast("decimal(18,4)").alias("fees"),
        F.to_date("l_shipdate").alias("session"),
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        "l_returnflag",
        "l_linestatus",
    )


FILL_ORDER = [
    "session", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity",
    "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
]


def rebalance_dates(spark: SparkSession, d: str) -> DataFrame:
    """First session of each month, decided at noon."""
    return (
        load(spark, d, "lineitem")
        .groupBy(F.date_trunc("month", "l_shipdate").alias("month"))
        .agg(F.to_date(F.min("l_shipdate")).alias("as_of"))
        .select("as_of", (F.col("as_of").cast("timestamp") + F.expr("INTERVAL 12 HOURS")).alias("decision_time"))
    )


def dirty_base(spark: SparkSession, d: str) -> DataFrame:
    """``panel_split`` with known defects of every kind the checks look for."""
    rn, c = F.col("rn"), F.col
    flat = (rn % 10 == 0) & (c("sym_no") % 4 == 0)
    return panel_split(spark, d).select(
        "instrument_id",
        "symbol",
        "event_time",
        F.when(rn % 113 == 0, c("event_time") - F.expr("INTERVAL 1 HOURS")).otherwise(c("receive_time")).alias("receive_time"),
        F.when(flat, c("close")).otherwise(c("open")).alias("open"),
        F.when(flat, c("close")).otherwise(c("high")).alias("high"),
        F.when(flat, c("close")).when(rn % 131 == 0, -c("low")).otherwise(c("low")).alias("low"),
        "close",
        F.when(rn % 71 == 0, F.lit(0.0)).otherwise(c("volume")).alias("volume"),
        (rn * 10 - F.when((c("sym_no") % 3 == 0) & (rn % 50 == 0), 13).otherwise(0)).alias("seq"),
        "rn",
    )


def dirty_bars(spark: SparkSession, d: str) -> DataFrame:
    """``dirty_base`` with bars that come again a day later."""
    bars = dirty_base(spark, d)
    again = bars.where("rn % 97 = 0").withColumns(
        {"seq": F.col("seq") + 5, "receive_time": F.col("receive_time") + F.expr("INTERVAL 1 DAYS")}
    )
    return bars.unionByName(again)


def instruments(spark: SparkSession, d: str) -> DataFrame:
    """Listing lifecycle of every instrument of the panel."""
    span = panel_raw(spark, d).groupBy("sym_no", "instrument_id").agg(
        F.min("event_time").alias("listed_at"), F.max("event_time").alias("last_at")
    )
    return span.select(
        "instrument_id",
        "listed_at",
        F.when(F.col("sym_no") % 9 == 0, F.col("last_at") - F.expr("INTERVAL 400 DAYS")).alias("delisted_at"),
        F.when(F.col("sym_no") % 11 == 0, F.col("listed_at") + F.expr("INTERVAL 1000 DAYS")).alias("expiry"),
    )


def aliases(spark: SparkSession, d: str) -> DataFrame:
    """Brands as symbols that move to another instrument every three years."""
    era = load(spark, d, "part").select("p_brand", (F.col("p_partkey") % 3).alias("era")).distinct()
    return era.select(
        F.col("p_brand").alias("symbol"),
        F.lit("NSE").alias("exchange"),
        F.concat(F.lit("X:INE"), F.col("p_brand"), F.lit("-"), F.col("era").cast("string")).alias("instrument_id"),
        F.make_timestamp(F.lit(1993) + F.col("era") * 3, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("valid_from"),
        F.when(
            F.col("era") < 2,
            F.make_timestamp(F.lit(1996) + F.col("era") * 3, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)),
        ).alias("valid_to"),
    )


CTES: dict[str, str] = {
    "dirty_base": """
        SELECT instrument_id, symbol, event_time,
               CASE WHEN rn % 113 = 0 THEN event_time - INTERVAL 1 HOUR ELSE receive_time END AS receive_time,
               CASE WHEN rn % 10 = 0 AND sym_no % 4 = 0 THEN close ELSE open END AS open,
               CASE WHEN rn % 10 = 0 AND sym_no % 4 = 0 THEN close ELSE high END AS high,
               CASE WHEN rn % 10 = 0 AND sym_no % 4 = 0 THEN close WHEN rn % 131 = 0 THEN -low ELSE low END AS low,
               close, CASE WHEN rn % 71 = 0 THEN 0.0::DOUBLE ELSE volume END AS volume,
               rn * 10 - CASE WHEN sym_no % 3 = 0 AND rn % 50 = 0 THEN 13 ELSE 0 END AS seq, rn
        FROM panel_split""",
    "dirty_bars": """
        SELECT * FROM dirty_base UNION ALL
        SELECT instrument_id, symbol, event_time, receive_time + INTERVAL 1 DAY, open, high, low, close, volume, seq + 5, rn
        FROM dirty_base WHERE rn % 97 = 0""",
    "instruments": """
        SELECT instrument_id, listed_at,
               CASE WHEN sym_no % 9 = 0 THEN last_at - INTERVAL 400 DAY END AS delisted_at,
               CASE WHEN sym_no % 11 = 0 THEN listed_at + INTERVAL 1000 DAY END AS expiry
        FROM (SELECT sym_no, instrument_id, min(event_time) AS listed_at, max(event_time) AS last_at
              FROM panel_raw GROUP BY 1, 2)""",
    "aliases": """
        SELECT DISTINCT p_brand AS symbol, 'NSE' AS exchange,
               'X:INE' || p_brand || '-' || CAST(p_partkey % 3 AS VARCHAR) AS instrument_id,
               make_timestamp(1993 + (p_partkey % 3) * 3, 1, 1, 0, 0, 0) AS valid_from,
               CASE WHEN p_partkey % 3 < 2 THEN make_timestamp(1996 + (p_partkey % 3) * 3, 1, 1, 0, 0, 0) END AS valid_to
        FROM part""",
    "panel_raw": """
        SELECT sym_no,
               CASE WHEN sym_no % 10 = 0 THEN 'X:INF' ELSE 'X:INE' END
                 || lpad(CAST(sym_no AS VARCHAR), 10, '0') AS instrument_id,
               'S' || lpad(CAST(sym_no AS VARCHAR), 10, '0') AS symbol,
               session,
               CAST(session AS TIMESTAMP) + INTERVAL 10 HOUR AS event_time,
               CAST(session AS TIMESTAMP) + INTERVAL 750 MINUTE AS receive_time,
               (high + low) / 2 AS open, high, low, amount / volume AS close,
               volume, trades, amount
        FROM (SELECT l_suppkey AS sym_no, CAST(l_shipdate AS DATE) AS session,
                     round(sum(l_extendedprice), 2) AS amount, sum(l_quantity) AS volume,
                     max(l_extendedprice / l_quantity) AS high,
                     min(l_extendedprice / l_quantity) AS low, count(*) AS trades
              FROM lineitem GROUP BY 1, 2)""",
    "panel_smooth": """
        SELECT sym_no, instrument_id, symbol, session, event_time, receive_time, open,
               greatest(open, close) * 1.002 AS high, least(open, close) * 0.998 AS low,
               close, volume, trades, rn - 59 AS rn
        FROM (SELECT sym_no, instrument_id, symbol, session, event_time, receive_time, close,
                     close * (1 + (volume % 5 - 2) * 0.001) AS open, volume, trades, rn
              FROM (SELECT sym_no, instrument_id, symbol, session, event_time, receive_time,
                           volume, trades,
                           round(sum(amount) OVER w, 2) / sum(volume) OVER w AS close,
                           row_number() OVER (PARTITION BY symbol ORDER BY event_time) AS rn
                    FROM panel_raw
                    WINDOW w AS (PARTITION BY symbol ORDER BY event_time
                                 ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
              WHERE rn >= 60)""",
    "panel_split": """
        SELECT sym_no, instrument_id, symbol, session, event_time, receive_time,
               open * ratio AS open, high * ratio AS high, low * ratio AS low,
               close * ratio AS close, volume, trades, rn
        FROM (SELECT *, CASE WHEN rn >= 200 AND sym_no % 5 = 0 THEN 0.5::DOUBLE
                             WHEN rn >= 200 AND sym_no % 5 = 1 THEN 0.2::DOUBLE
                             ELSE 1.0::DOUBLE END AS ratio FROM panel_smooth)""",
    "actions": """
        SELECT instrument_id, symbol, 'SPLIT' AS action_type, session AS ex_date,
               session - 10 AS announcement_date,
               CASE WHEN sym_no % 5 = 0 THEN 2.0 ELSE 5.0 END::DOUBLE AS ratio,
               0.0::DOUBLE AS cash_per_share
        FROM panel_smooth WHERE rn = 200 AND sym_no % 5 <= 1
        UNION ALL
        SELECT instrument_id, symbol, 'DIVIDEND', session, NULL, 1.0::DOUBLE, 1.5::DOUBLE
        FROM panel_smooth WHERE rn = 200 AND sym_no % 7 = 0""",
    "ticks": """
        SELECT 'U' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS instrument_id, ts AS event_time,
               ts + to_seconds(event_id % 90) AS receive_time, value AS price,
               event_id AS sequence, event_type, props
        FROM events""",
    "fills": """
        SELECT l_suppkey AS account, l_partkey % 20 AS instrument,
               CASE WHEN l_linenumber % 2 = 1 THEN 'BUY' ELSE 'SELL' END AS side,
               CAST(l_quantity AS DECIMAL(18,4)) AS quantity,
               CAST(round(l_extendedprice / l_quantity, 2) AS DECIMAL(18,4)) AS price,
               CAST(round(l_extendedprice * l_tax / 100, 2) AS DECIMAL(18,4)) AS fees,
               CAST(l_shipdate AS DATE) AS session, l_orderkey, l_partkey, l_linenumber,
               l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus
        FROM lineitem""",
    "rebalance_dates": """
        SELECT as_of, CAST(as_of AS TIMESTAMP) + INTERVAL 12 HOUR AS decision_time
        FROM (SELECT CAST(min(l_shipdate) AS DATE) AS as_of FROM lineitem
              GROUP BY date_trunc('month', l_shipdate))""",
}


def oracle(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the table definitions it mentions, in order."""
    known = {**CTES, **(extra or {})}
    needed: list[str] = []
    open_: set[str] = set()

    def visit(text: str) -> None:
        for name in known:
            if name in needed or name in open_ or not re.search(rf"\b{name}\b", text):
                continue
            open_.add(name)
            visit(known[name])
            open_.discard(name)
            needed.append(name)

    visit(body)
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in needed) + "\n" + body


def r(expr: str, digits: int = 8) -> str:
    """Rounded double as SQL, with no negative zero."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def half_away(col: Column, digits: int) -> Column:
    """Round the binary product half away from zero, as the SQL twin does."""
    scale = float(10**digits)
    return F.round(col * scale, 0) / scale


def present(df: DataFrame, digits: int = 8, **per_column: int) -> DataFrame:
    """Plain output types: strings, longs, booleans and rounded doubles."""
    out = []
    for field in df.schema:
        kind, col = field.dataType.typeName(), F.col(field.name)
        if kind == "date":
            col = F.date_format(col, "yyyy-MM-dd")
        elif kind.startswith("timestamp"):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        elif kind in ("double", "float", "decimal"):
            col = half_away(col.cast("double"), per_column.get(field.name, digits)) + F.lit(0.0)
        elif kind in ("integer", "short", "byte"):
            col = col.cast("bigint")
        out.append(col.alias(field.name))
    return df.select(*out)
