"""Queries over books, their evaluation, resampling and the gauntlet."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tickloom.functions.ranks import fits_arrays
from tickloom.functions.windows import by, simple_return
from tickloom.operators import factors, ledger, performance, pit, quality, stationarity
from tickloom.operators import portfolio as po
from tickloom.operators import resampling as rs
from tickloom.plans import tables as t
from tickloom.plans.registry import query
from tickloom.plans.statistics import PAIRS, top_pairs
from tickloom.plans.tables import oracle, present, r, rows
from tickloom.session import discard, written
from tickloom.sizing import small

W = "OVER (PARTITION BY symbol ORDER BY event_time)"
STAMP = "'%Y-%m-%d %H:%M:%S'"
LOOKBACKS, SKIPS = (60, 90, 126, 189, 252), (0, 5, 21)
CONFIGS = [(k, s) for k in LOOKBACKS for s in SKIPS if s < k]
COST = 0.001
MONTHS = 12
DRAWS = 2000
#: Months at the end that nothing but the last check looks at.
LOCKED_MONTHS = 12
SEEDS = 20


def full(agg: str, x: str, n: int) -> str:
    frame = f"OVER (PARTITION BY symbol ORDER BY event_time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} >= {n} THEN {agg}({x}) {frame} END"


def mix_sql(i: str, s: str, k: str | None = None) -> str:
    p = 2147483647
    base = f"({i}) * 1103515245 + ({s}) * 12345679" + (f" + ({k}) * 362437" if k else "")
    x = f"(CAST({base} AS BIGINT) + 88675123) % {p}"
    y = f"((({x}) * ({x}) + ({x}) * 48271) % {p})"
    return f"(({y} * {y} + {y} * 69621 + ({i})) % {p})"


SQL = {
    "featured": f"""SELECT *, lead(event_time) {W} AS until, coalesce(lead(open) {W}, close) AS entry,
        {', '.join(f'lag(close, {k - 1}) {W} AS start_{k}' for k in LOOKBACKS)}, {', '.join(f'lag(close, {s}) {W} AS end_{s}' for s in SKIPS)},
        {full('avg', 'close', 20)} AS fast_ma, {full('avg', 'close', 50)} AS slow_ma, {full('stddev_samp', 'close', 60)} AS sd60, {full('avg', 'close', 60)} AS m60
        FROM panel_smooth""",
    "seen": """SELECT f.*, d.decision_time, (close - m60) / nullif(sd60, 0) AS z FROM featured f JOIN rebalance_dates d
        ON d.decision_time >= f.event_time AND (f.until IS NULL OR d.decision_time < f.until)""",
    "held": """SELECT symbol, decision_time, nxt / entry - 1 AS ret FROM (
        SELECT symbol, decision_time, entry, lead(entry) OVER (PARTITION BY symbol ORDER BY decision_time) AS nxt FROM seen) WHERE nxt IS NOT NULL""",
    "indexed": "SELECT decision_time, row_number() OVER (ORDER BY decision_time) AS i FROM (SELECT DISTINCT decision_time FROM held)",
    "sweep_scores": " UNION ALL ".join(
        f"SELECT {i} AS config, symbol, decision_time, end_{s} / start_{k} - 1 AS score FROM seen WHERE start_{k} > 0" for i, (k, s) in enumerate(CONFIGS)
    ),
    "sweep_weights": """SELECT config, decision_time, symbol, 1.0 / k AS weight FROM (SELECT *, greatest(1, floor(n * 0.2)) AS k FROM (
        SELECT *, row_number() OVER (PARTITION BY config, decision_time ORDER BY -score, symbol) AS rk, count(*) OVER (PARTITION BY config, decision_time) AS n FROM sweep_scores))
        WHERE rk <= k""",
}


def evaluated_sql(weights: str, key: str, multiple: float = 1.0) -> str:
    return f"""
    SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY {key} ORDER BY event_time)) AS equity FROM (
      SELECT {key}, decision_time AS event_time, sum(weight * coalesce(ret, 0)) AS gross_ret, sum(abs(weight - was)) AS turnover,
             count(*) FILTER (weight <> 0) AS names, sum(weight * coalesce(ret, 0)) - sum(abs(weight - was)) * {COST * multiple} AS ret
      FROM (SELECT {key}, i, symbol, sum(now) AS weight, sum(was) AS was FROM (
              SELECT {key}, i, symbol, weight AS now, 0 AS was FROM {weights} JOIN indexed USING (decision_time)
              UNION ALL SELECT {key}, i + 1, symbol, 0, weight FROM {weights} JOIN indexed USING (decision_time)) GROUP BY 1, 2, 3)
      JOIN indexed USING (i) LEFT JOIN held USING (decision_time, symbol) GROUP BY 1, 2)"""


SQL["sweep"] = evaluated_sql("sweep_weights", "config")


def sql(body: str, **extra: str) -> str:
    return oracle(body, {**SQL, **extra})


# ---- shared frames ---------------------------------------------------------------


def dates(spark, d):
    return t.rebalance_dates(spark, d)


def view_of(panel, spark, d):
    """Momentum features of ``panel`` as they are known at each rebalance date."""
    return po.decision_view(po.momentum_features(panel, LOOKBACKS, SKIPS), dates(spark, d), stamps=rows(spark, d))


def view(spark, d):
    features = po.momentum_features(t.panel_smooth(spark, d), LOOKBACKS, SKIPS)
    features = po.zscore_features(po.sma_features(features, 20, 50), 60)
    return po.decision_view(features, dates(spark, d), stamps=rows(spark, d))


def sweep_weights(seen, n, kept=()):
    scored = po.momentum_scores(seen, CONFIGS, ["decision_time", "symbol", *kept])
    return po.top_fraction(scored, [*kept, "config", "decision_time"], 0.2, rows=n)


def sweep(spark, d, multiple=1.0):
    seen = view(spark, d)
    return po.evaluate(sweep_weights(seen, rows(spark, d)), po.holding_returns(seen), dates(spark, d), ["config"], COST, multiple)


# ---- weights ----------------------------------------------------------------------

_EQUAL = "SELECT decision_time, symbol, {side} / count(*) OVER (PARTITION BY decision_time) AS weight FROM seen WHERE {where}"
_OUT = f"SELECT strftime(decision_time, {STAMP}) AS decision_time, symbol, {r('weight')} AS weight FROM w"


def weights_query(name, ids, weights_sql):
    def wrap(run):
        query(name, ids, sql(_OUT, w=weights_sql))(lambda spark, d: present(run(spark, d).select("decision_time", "symbol", "weight")))
        return run

    return wrap


@weights_query("po3_equal_weight", "PO3", _EQUAL.format(side="1.0", where="close > 0"))
def equal(spark, d):
    return po.equal_weight(view(spark, d), rows=rows(spark, d))


@weights_query(
    "po3_buy_and_hold",
    "PO3",
    """SELECT d.decision_time, f.symbol, f.weight FROM (SELECT DISTINCT decision_time FROM seen) d, (
        SELECT symbol, 1.0 / count(*) OVER () AS weight FROM seen WHERE close > 0 AND decision_time = (SELECT min(decision_time) FROM seen)) f""",
)
def hold(spark, d):
    return po.buy_and_hold(view(spark, d))


@weights_query(
    "po4_sma_crossover",
    "PO4",
    _EQUAL.format(side="(CASE WHEN fast_ma > slow_ma THEN 1.0 ELSE -1.0 END)", where="slow_ma IS NOT NULL"),
)
def sma(spark, d):
    return po.sma_crossover(view(spark, d), allow_short=True, rows=rows(spark, d))


RANDOM = f"""SELECT seed, decision_time, symbol, 1.0 / count(*) OVER (PARTITION BY seed, decision_time) AS weight FROM (
    SELECT *, row_number() OVER (PARTITION BY seed, decision_time ORDER BY {mix_sql('sym_no', 'seed', 'bucket')}, sym_no) AS rk FROM seen
    JOIN (SELECT decision_time, floor((row_number() OVER (ORDER BY decision_time) - 1) / 2) AS bucket FROM (SELECT DISTINCT decision_time FROM seen)) USING (decision_time),
    (SELECT unnest(range({SEEDS})) AS seed)) WHERE rk <= 10"""


def drawn_names(seen):
    return po.random_entry(seen, SEEDS, 10, hold=2)


def random_weights(spark, d):
    return drawn_names(view(spark, d))


@query(
    "po5_random_entry",
    "PO5",
    sql(f"SELECT seed, strftime(decision_time, {STAMP}) AS decision_time, symbol, {r('weight')} AS weight FROM w", w=RANDOM),
)
def random_book(spark, d):
    return present(random_weights(spark, d).select("seed", "decision_time", "symbol", "weight"))


LONG_SHORT = """SELECT decision_time, symbol, CASE WHEN rk > n - k THEN -0.5 / k ELSE 0.5 / k END AS weight FROM (SELECT *, greatest(1, floor(n * 0.2)) AS k FROM (
    SELECT *, row_number() OVER (PARTITION BY decision_time ORDER BY -score, symbol) AS rk, count(*) OVER (PARTITION BY decision_time) AS n
    FROM sweep_scores WHERE config = 8)) WHERE rk <= k OR rk > n - k"""


def long_short(spark, d):
    scored = po.momentum_scores(view(spark, d), [CONFIGS[8]], ["decision_time", "symbol"])
    return po.top_fraction(scored, ["decision_time"], 0.2, long_only=False, rows=rows(spark, d))


weights_query("po6_momentum", "PO6", LONG_SHORT)(long_short)


@weights_query(
    "po7_zscore_reversion",
    "PO7",
    _EQUAL.format(side="(CASE WHEN z > 0 THEN -1.0 ELSE 1.0 END)", where="abs(z) >= 1 AND abs(z) <= 3"),
)
def reversion(spark, d):
    return po.zscore_reversion(view(spark, d), 1.0, 3.0, rows=rows(spark, d))


@query("po7_gated_reversion", "PO7 TS5")
def gated(spark, d):
    fadeable = stationarity.assess(t.panel_smooth(spark, d))
    return present(po.zscore_reversion(view(spark, d), 1.0, 3.0, fadeable=fadeable, rows=rows(spark, d)))


_PF = "OVER (PARTITION BY l, r ORDER BY event_time ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
_PI = "OVER (PARTITION BY l, r ORDER BY event_time ROWS BETWEEN 58 PRECEDING AND CURRENT ROW)"
PAIR_SQL = {
    **PAIRS,
    "lagged": "SELECT *, y - y1 AS dy, x - x1 AS dx FROM (SELECT *, lag(y) OVER p AS y1, lag(x) OVER p AS x1, row_number() OVER p AS i FROM pair_rows WINDOW p AS (PARTITION BY l, r ORDER BY event_time))",
    "hedged": f"SELECT *, covar_samp(y, x) {_PF} / var_samp(x) {_PF} AS beta, avg(y) {_PF} AS my, avg(x) {_PF} AS mx, var_samp(y) {_PF} AS vy, var_samp(x) {_PF} AS vx, covar_samp(y, x) {_PF} AS cxy, "
    + ", ".join(
        f"covar_pop({a}, {b}) {_PI} AS {n}"
        for n, a, b in (("ay", "dy", "y1"), ("ax", "dy", "x1"), ("by_", "dx", "y1"), ("bx", "dx", "x1"), ("yy", "y1", "y1"), ("yx", "y1", "x1"), ("xx", "x1", "x1"))
    )
    + " FROM lagged",
    "spreads": """SELECT *, ((y - beta * x) - (my - beta * mx)) / sqrt(vy + beta * beta * vx - 2 * beta * cxy) AS z,
        (ay - beta * ax - beta * by_ + beta * beta * bx) / (yy - 2 * beta * yx + beta * beta * xx) AS decay FROM hedged WHERE i >= 60""",
    "legs": """SELECT *, CASE WHEN z > 0 THEN -1 ELSE 1 END AS side, round(abs(beta), 4) AS h FROM spreads WHERE abs(z) >= 2 AND decay < 0 AND -ln(2) / decay <= 30""",
}


def pair_features(spark, d):
    return po.pair_features(stationarity.pair_series(t.panel_smooth(spark, d), top_pairs(spark, d)), 60)


@query(
    "po8_pairs",
    "PO8",
    oracle(
        f"""SELECT l AS "left", r AS "right", strftime(event_time, {STAMP}) AS decision_time, {r('side * 0.5 / (1 + h)', 6)} AS left_weight,
            {r('-side * 0.5 / (1 + h) * h', 6)} AS right_weight FROM legs""",
        PAIR_SQL,
    ),
)
def pairs(spark, d):
    return present(po.pairs_trading(pair_features(spark, d)), 6)


@query(
    "po1_exposure",
    "PO1",
    sql(
        f"""SELECT strftime(decision_time, {STAMP}) AS decision_time, {r('sum(abs(weight))')} AS gross, {r('sum(weight)')} AS net, count(*) AS names,
            CAST(0 AS BIGINT) AS invalid FROM w GROUP BY decision_time""",
        w=LONG_SHORT,
    ),
)
def exposure(spark, d):
    return present(po.exposure(long_short(spark, d), ["decision_time"]))


@query(
    "po2_clipped",
    "PO2 UD1",
    sql(
        f"""SELECT strftime(decision_time, {STAMP}) AS decision_time, symbol, {r('c * CASE WHEN g > 0.5 THEN 0.5 / g ELSE 1 END')} AS weight
        FROM (SELECT *, sum(abs(c)) OVER (PARTITION BY decision_time) AS g FROM (SELECT *, greatest(least(weight, 0.03), -0.03) AS c FROM w WHERE weight <> 0))""",
        w=LONG_SHORT,
    ),
)
def clipped(spark, d):
    seen = view(spark, d)

    def strategy(frame):
        scored = po.momentum_scores(frame, [CONFIGS[8]], ["decision_time", "symbol"])
        return po.top_fraction(scored, ["decision_time"], 0.2, long_only=False, rows=rows(spark, d))

    df = po.run_strategy(seen, strategy, ["decision_time"], 0.03, 0.5)
    return present(df.select("decision_time", "symbol", "weight"))


SIGNAL = {
    "vols": f"SELECT symbol, event_time, {full('stddev_samp', 'ret', 20)} AS vol FROM (SELECT symbol, event_time, close / lag(close) {W} - 1 AS ret FROM panel_smooth)",
    "signals": "SELECT s.symbol, s.decision_time, -(z) AS score, vol FROM seen s JOIN vols v USING (symbol, event_time) WHERE z IS NOT NULL",
    "picked": """SELECT *, max(rk) OVER (PARTITION BY decision_time) AS kk FROM (SELECT *, row_number() OVER (PARTITION BY decision_time ORDER BY -score, symbol) AS rk,
        count(*) OVER (PARTITION BY decision_time) AS n FROM signals) WHERE rk <= greatest(1, floor(n * 0.3))""",
}
_SIZE = {
    "EQUAL": "1.0",
    "SCORE": "kk - rk + 1",
    "INVERSE_VOL": "coalesce(1 / nullif(vol, 0), median(1 / nullif(vol, 0)) OVER (PARTITION BY decision_time), 1)",
}


def signals(spark, d):
    w = by()
    panel = t.panel_smooth(spark, d).withColumn("_ret", simple_return())
    from tickloom.functions.windows import rolling

    panel = panel.withColumn("vol", rolling(F.stddev_samp, F.col("_ret"), 20, w))
    seen = po.decision_view(po.zscore_features(panel, 60), dates(spark, d))
    return seen.where(F.col("z").isNotNull()).select("symbol", "decision_time", (-F.col("z")).alias("score"), "vol")


def _register_construction(kind: str) -> None:
    weights_query(
        f"po10_signal_{kind.lower()}",
        "PO10 J6",
        "SELECT decision_time, symbol, s / sum(s) OVER (PARTITION BY decision_time) AS weight FROM (SELECT *, "
        + _SIZE[kind]
        + " AS s FROM picked)",
    )(lambda spark, d: po.signal_book(pit.refuse_forward_columns(signals(spark, d)), ["decision_time"], 0.3, kind, rows=rows(spark, d)))


SQL |= SIGNAL
for _kind in _SIZE:
    _register_construction(_kind)


# ---- overlay ------------------------------------------------------------------------

_SCALES = f"""SELECT event_time, rn, CASE WHEN v > 0 THEN round(least(0.15 / v, 2.0), 4) ELSE 0 END AS raw FROM (
    SELECT event_time, row_number() OVER (ORDER BY event_time) - 59 AS rn, stddev_samp(m) OVER (ORDER BY event_time ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) * sqrt(252) AS v
    FROM (SELECT event_time, avg(ret) AS m FROM (SELECT event_time, close / lag(close) {W} - 1 AS ret FROM panel_smooth) WHERE ret IS NOT NULL GROUP BY 1)) WHERE rn >= 1"""


def _overlay_oracle() -> str:
    head = oracle("SELECT 1 FROM raw_scales", {"raw_scales": _SCALES}).rsplit("\nSELECT 1 FROM", 1)[0]
    return head.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
    kept AS (SELECT rn, event_time, raw, raw AS scale FROM raw_scales WHERE rn = 1
             UNION ALL SELECT s.rn, s.event_time, s.raw, CASE WHEN k.scale <> 0 AND abs(s.raw - k.scale) / k.scale < 0.10 THEN k.scale ELSE s.raw END
             FROM kept k JOIN raw_scales s ON s.rn = k.rn + 1)
    SELECT 'all' AS book, strftime(event_time, {STAMP}) AS event_time, {r('raw', 4)} AS raw_scale, {r('scale', 4)} AS scale FROM kept"""


@query("po11_volatility_target", "PO11", _overlay_oracle())
def overlay(spark, d):
    df = t.panel_smooth(spark, d).withColumn("ret", simple_return()).where(F.col("ret").isNotNull())
    market = df.groupBy("event_time").agg(F.avg("ret").alias("market_ret")).withColumn("book", F.lit("all"))
    return present(po.vol_target_scales(market, ["book"]), 4)


# ---- evaluation ---------------------------------------------------------------------


@query(
    "po9_evaluation",
    "PO9 G9",
    sql(
        f"""SELECT CAST(config AS BIGINT) AS config, strftime(event_time, {STAMP}) AS event_time, {r('ret')} AS ret, {r('turnover')} AS turnover,
            {r('equity')} AS equity, names FROM sweep"""
    ),
)
def evaluation(spark, d):
    return present(sweep(spark, d).select("config", "event_time", "ret", "turnover", "equity", "names"))


@query(
    "po9_tripled_costs",
    "PO9",
    sql(
        f"SELECT CAST(config AS BIGINT) AS config, {r('max_by(equity, event_time)')} AS equity, {r('sum(ret)')} AS total FROM costly GROUP BY config",
        costly=evaluated_sql("sweep_weights", "config", 3.0),
    ),
)
def tripled(spark, d):
    df = sweep(spark, d, 3.0)
    return present(df.groupBy("config").agg(F.max_by("equity", "event_time").alias("equity"), F.sum("ret").alias("total")))


@query(
    "po15_run_summary",
    "PO15 PO9",
    sql(
        f"""SELECT CAST(config AS BIGINT) AS config, {r('min_by(equity, event_time)')} AS first_equity, {r('max_by(equity, event_time)')} AS last_equity,
            {r('max_by(equity, event_time) - 1')} AS total_return, {r('least(min(equity / peak - 1), 0)')} AS max_drawdown, {r(f'sum(turnover) * {COST}')} AS fees, count(*) AS periods
        FROM (SELECT *, greatest(1, max(equity) OVER (PARTITION BY config ORDER BY event_time)) AS peak FROM sweep) GROUP BY config"""
    ),
)
def run_summary(spark, d):
    return present(po.run_summary(sweep(spark, d), ["config"], COST))


# ---- orders ---------------------------------------------------------------------------

ORDERS = {
    "positioned": "SELECT account, instrument, CAST(sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) AS DOUBLE) AS quantity FROM fills GROUP BY 1, 2",
    "targets": "SELECT account, instrument, 0.02 * (1 + instrument % 4) AS weight FROM positioned WHERE (account + instrument) % 3 <> 0",
    "marked": "SELECT instrument, round(sum(CAST(quantity * price AS DOUBLE)) / sum(CAST(quantity AS DOUBLE)), 2) AS mark, 1 + instrument % 3 * 5 AS lot FROM fills GROUP BY 1",
    "funds": "SELECT account, 1000000.0::DOUBLE + account * 1000 AS equity, 50000.0::DOUBLE + account % 9 * 20000 AS cash FROM (SELECT DISTINCT account FROM fills)",
    "planned": """SELECT *, CASE WHEN delta = 0 THEN 'unchanged' WHEN value >= 500 AND value / equity >= 0.005 THEN 'planned' ELSE 'too_small' END AS outcome FROM (
        SELECT *, abs(delta) * mark AS value FROM (
          SELECT account, instrument, mark, lot, equity, cash, quantity,
                 trunc(CAST(round(CAST(equity * weight / mark AS DECIMAL(28,8)), 8) AS DOUBLE) / lot) * lot - quantity AS delta
          FROM (SELECT coalesce(a.account, b.account) AS account, coalesce(a.instrument, b.instrument) AS instrument, coalesce(weight, 0) AS weight, coalesce(quantity, 0) AS quantity
                FROM targets a FULL JOIN positioned b ON a.account = b.account AND a.instrument = b.instrument) JOIN marked USING (instrument) JOIN funds USING (account)))""",
}


def planned(spark, d):
    fills = ledger.fill_columns(t.fills(spark, d))
    held = fills.groupBy("account", "instrument").agg(F.sum("signed_quantity").cast("double").alias("quantity"))
    c = F.col
    targets = held.where((c("account") + c("instrument")) % 3 != 0).select("account", "instrument", (0.02 * (1 + c("instrument") % 4)).alias("weight"))
    q, v = F.sum(c("quantity").cast("double")), F.sum((c("quantity") * c("price")).cast("double"))
    marks = fills.groupBy("instrument").agg(t.half_away(v / q, 2).alias("mark")).withColumn("lot", (1 + c("instrument") % 3 * 5).cast("decimal(6,0)"))
    funds = fills.select("account").distinct().select(
        "account", (1_000_000.0 + c("account") * 1000).alias("equity"), (50_000.0 + c("account") % 9 * 20_000).alias("cash")
    )
    return po.plan_orders(targets, held, marks, funds)


@query(
    "po12_order_plan",
    "PO12 F10",
    oracle(f"SELECT account, instrument, {r('delta', 4)} AS delta, {r('value', 2)} AS value, outcome FROM planned", ORDERS),
)
def order_plan(spark, d):
    return present(planned(spark, d).select("account", "instrument", "delta", "value", "outcome"), 4, value=2)


def _funding_oracle() -> str:
    head = oracle("SELECT 1 FROM planned", ORDERS).rsplit("\nSELECT 1 FROM", 1)[0]
    return head.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
    live AS (SELECT * FROM planned WHERE outcome = 'planned'),
    buys AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY -value, instrument) AS rn FROM live WHERE delta > 0),
    start AS (SELECT account, any_value(cash) + coalesce(sum(abs(delta) * mark) FILTER (delta < 0), 0) AS cash FROM live GROUP BY 1),
    fold AS (SELECT account, CAST(0 AS BIGINT) AS rn, cash, CAST(-1 AS BIGINT) AS instrument, 0.0::DOUBLE AS quantity FROM start
             UNION ALL SELECT account, rn, CASE WHEN q * mark >= 500 THEN cash - q * mark ELSE cash END, instrument, CASE WHEN q * mark >= 500 THEN q ELSE 0 END
             FROM (SELECT b.account, b.rn, f.cash, b.instrument, b.mark, greatest(floor(least(b.delta, f.cash * (1 - 0.005) / b.mark) / b.lot) * b.lot, 0) AS q
                   FROM fold f JOIN buys b ON b.account = f.account AND b.rn = f.rn + 1))
    SELECT account, instrument, {r('quantity', 4)} AS quantity FROM fold WHERE rn > 0 AND quantity > 0
    UNION ALL SELECT account, instrument, {r('delta', 4)} FROM live WHERE delta < 0"""


@query("po13_funded_orders", "PO13", _funding_oracle())
def funded(spark, d):
    return present(po.fund_orders(planned(spark, d)), 4)


_FILLS = f"""
    SELECT *, CASE WHEN nopen IS NULL THEN 'no_market' WHEN NOT (nvolume > 0 AND nhigh > nlow) THEN 'no_liquidity' WHEN q < quantity THEN 'partial' ELSE 'filled' END AS outcome
    FROM (SELECT *, least(quantity, nvolume * 0.10) AS q FROM (
      SELECT sym_no AS instrument, session, CASE WHEN trades % 2 = 1 THEN 'BUY' ELSE 'SELL' END AS side, 1 + volume * 0.05 * (sym_no % 3) AS quantity,
             lead(open) {W} AS nopen, lead(high) {W} AS nhigh, lead(low) {W} AS nlow, lead(volume) {W} AS nvolume, lead((high + low + close) / 3) {W} AS ntyp FROM panel_raw))"""
_PRICED = """SELECT *, CASE WHEN outcome IN ('filled', 'partial') THEN CAST(round_even(greatest(nlow, least(nhigh, nopen + CASE WHEN side = 'BUY' THEN 1 ELSE -1 END
    * CAST(round(CAST(q * nopen * 5 / 20000 + coalesce(0.7 * 0.02 * sqrt(q * nopen / nullif(nvolume * ntyp, 0)) * (q * nopen), 0) AS DECIMAL(28,8)), 2) AS DOUBLE) / q)) / 0.01, 0) AS DOUBLE) * 0.01 END AS fill_price FROM est"""


def estimated(spark, d):
    bars = t.panel_raw(spark, d).select(F.col("sym_no").alias("instrument"), "session", "open", "high", "low", "close", "volume", "trades")
    orders = bars.select(
        "instrument",
        "session",
        F.when(F.col("trades") % 2 == 1, "BUY").otherwise("SELL").alias("side"),
        (1 + F.col("volume") * 0.05 * (F.col("instrument") % 3)).alias("quantity"),
    )
    return po.estimate_fills(orders, bars.drop("trades"))


@query(
    "po14_fill_estimates",
    "PO14 UD3",
    oracle(
        f"""SELECT instrument, strftime(session, '%Y-%m-%d') AS session, outcome, {r("CASE WHEN outcome IN ('filled', 'partial') THEN q END", 6)} AS fill_quantity,
            {r('fill_price', 4)} AS fill_price FROM priced""",
        {"est": _FILLS, "priced": _PRICED},
    ),
)
def fill_estimates(spark, d):
    df = estimated(spark, d)
    return present(df.select("instrument", "session", "outcome", "fill_quantity", "fill_price"), 6, fill_price=4)


@query(
    "po15_order_outcomes",
    "PO15",
    oracle(f"SELECT outcome, count(*) AS orders, {r('count(*) / sum(count(*)) OVER ()')} AS share FROM est GROUP BY outcome", {"est": _FILLS}),
)
def outcomes(spark, d):
    return present(po.order_outcomes(estimated(spark, d)))


# ---- resampling -------------------------------------------------------------------------

ARR = "SELECT config, ret, row_number() OVER (PARTITION BY config ORDER BY event_time) - 1 AS i, count(*) OVER (PARTITION BY config) AS n FROM sweep"
_SR = "avg(ret) / stddev_samp(ret) * sqrt(12)"


def arrays(spark, d):
    return rs.series_arrays(sweep(spark, d), ["config"])


def _bootstrap(index: str) -> str:
    return sql(
        f"""SELECT CAST(config AS BIGINT) AS config, {r('any_value(point)')} AS point_estimate, {r('quantile_cont(s, 0.025)')} AS lower, {r('quantile_cont(s, 0.975)')} AS upper,
            count(*) AS resamples FROM (SELECT config, b, {_SR} AS s FROM drawn GROUP BY 1, 2) JOIN (SELECT config, {_SR} AS point FROM arr GROUP BY 1) USING (config) GROUP BY config""",
        arr=ARR,
        drawn=f"""SELECT p.config, b, v.ret FROM (SELECT config, b, {index} AS j FROM arr, (SELECT unnest(range({DRAWS})) AS b)) p
            JOIN arr v ON v.config = p.config AND v.i = p.j""",
    )


@query("g1_bootstrap_sharpe", "G1", _bootstrap(f"{mix_sql('i', 'b * 1000003 + 7')} % n"))
def bootstrap(spark, d):
    return present(rs.bootstrap_sharpe(arrays(spark, d), ["config"], DRAWS, periods=MONTHS))


@query("g2_block_bootstrap", "G2", _bootstrap(f"{mix_sql('i // 20', 'b * 1000003 + 7')} % (n - 19) + i % 20"))
def block_bootstrap(spark, d):
    return present(rs.block_bootstrap(arrays(spark, d), ["config"], 20, DRAWS, periods=MONTHS))


def _permuted_sql() -> str:
    """``pos``: the place that the rounds of the keyed permutation take row ``k`` of ``size`` to."""
    draw = lambda k: mix_sql(f"{k}::BIGINT", "(b * 1000003 + 7)")
    keys = ", ".join(f"{draw(3 * k)} AS p{k}, {draw(3 * k + 1)} + 1 AS f{k}, {draw(3 * k + 2)} AS a{k}" for k in range(rs.ROUNDS))
    out = f"SELECT *, CAST(k AS BIGINT) AS pos FROM pool, (SELECT b, {keys} FROM (SELECT unnest(range({DRAWS})) AS b))"
    for k in range(rs.ROUNDS):
        out = f"SELECT *, ((p{k} % size - pos) % size + size) % size AS y{k} FROM ({out})"
        swap = f"(greatest(pos, y{k}) * f{k} + a{k}) % {rs.MODULUS} % 2 = 1"
        out = f"SELECT * REPLACE (CASE WHEN {swap} THEN y{k} ELSE pos END AS pos) FROM ({out})"
    return out


@query(
    "g3_permutation_test",
    "G3",
    sql(
        f"""SELECT CAST(config AS BIGINT) AS config, {r('any_value(observed)')} AS observed, {r('(count(*) FILTER (x >= observed) + 1) / (count(*) + 1)')} AS p_value
        FROM (SELECT config, b, avg(ret) FILTER (pos < n) / stddev_samp(ret) FILTER (pos < n) * sqrt(12) - avg(ret) FILTER (pos >= n) / stddev_samp(ret) FILTER (pos >= n) * sqrt(12) AS x
              FROM ({_permuted_sql()}) GROUP BY 1, 2)
        JOIN (SELECT config, {_SR} - (SELECT {_SR} FROM arr WHERE config = 0) AS observed FROM arr GROUP BY 1) USING (config) WHERE config <> 0 GROUP BY config""",
        arr=ARR,
        pool="""SELECT *, count(*) OVER (PARTITION BY config) AS size FROM (SELECT config, i AS k, ret, n FROM arr
            UNION ALL SELECT c.config, c.n + a.i, a.ret, c.n FROM arr a, (SELECT DISTINCT config, n FROM arr) c WHERE a.config = 0)""",
    ),
)
def permutation(spark, d):
    months = sweep(spark, d).select("config", "event_time", "ret")
    return present(rs.permutation_test(months.where("config <> 0"), months.where("config = 0"), ["config"], DRAWS, periods=MONTHS))


@query(
    "g4_monte_carlo_drawdown",
    "G4 PF4",
    sql(
        f"""SELECT CAST(config AS BIGINT) AS config, {r('any_value(rd)')} AS realised_drawdown, {r('median(dd)')} AS median_drawdown, {r('quantile_cont(dd, 0.05)')} AS percentile_5,
            count(*) AS shuffles, {r('quantile_cont(dd, 0.05) / any_value(rd)')} AS luck_ratio
        FROM (SELECT config, b, least(min(e / greatest(1, p) - 1), 0) AS dd FROM (SELECT *, max(e) OVER (PARTITION BY config, b ORDER BY rk) AS p FROM (
                SELECT config, b, rk, exp(sum(ln(1 + ret)) OVER (PARTITION BY config, b ORDER BY rk)) AS e FROM (
                  SELECT config, ret, b, row_number() OVER (PARTITION BY config, b ORDER BY {mix_sql('i', 'b * 1000003 + 7')}, i) AS rk FROM arr, (SELECT unnest(range({DRAWS})) AS b)))) GROUP BY 1, 2)
        JOIN (SELECT config, least(min(equity / greatest(1, p) - 1), 0) AS rd FROM (SELECT *, max(equity) OVER (PARTITION BY config ORDER BY event_time) AS p FROM sweep) GROUP BY 1) USING (config)
        GROUP BY config""",
        arr=ARR,
    ),
)
def monte_carlo(spark, d):
    return present(rs.monte_carlo_drawdown(arrays(spark, d), ["config"], DRAWS))


_MOM = "avg((ret - m) ** {k}) / stddev_pop(ret) ** {k}"
MOMENTS = f"""SELECT config, count(*) AS n, avg(ret) / stddev_samp(ret) AS sr, {_MOM.format(k=3)} AS skew, {_MOM.format(k=4)} AS kurt
    FROM (SELECT *, avg(ret) OVER (PARTITION BY config) AS m FROM sweep) GROUP BY config"""


def _expected_max(trials: int) -> float:
    import math
    import statistics

    ppf = statistics.NormalDist().inv_cdf
    return (1 - rs.EULER) * ppf(1 - 1 / trials) + rs.EULER * ppf(1 - 1 / (trials * math.e))


def deflated(spark, d):
    moments = rs.sharpe_moments(sweep(spark, d), ["config"]).withColumn("n_trials", F.lit(len(CONFIGS)))
    return rs.deflated_sharpe(moments)


@query(
    "g5_sharpe_statistic",
    "G5",
    sql(
        f"""SELECT CAST(config AS BIGINT) AS config, n AS n_observations, {r('sr')} AS observed_sharpe, {r('skew')} AS skew, {r('kurt')} AS kurt,
            {r(f'{_expected_max(len(CONFIGS))!r} / sqrt(n)')} AS expected_max_sharpe,
            {r(f'(sr - {_expected_max(len(CONFIGS))!r} / sqrt(n)) * sqrt(n - 1) / sqrt(greatest(1e-12, 1 - skew * sr + (kurt - 1) / 4 * sr * sr))')} AS statistic
        FROM mom""",
        mom=MOMENTS,
    ),
)
def sharpe_statistic(spark, d):
    return present(deflated(spark, d).drop("dsr", "n_trials"))


@query("g5_deflated_sharpe", "G5 F14")
def deflated_sharpe(spark, d):
    return present(deflated(spark, d))


SWEEP_RETURNS = """SELECT CAST(l_linenumber AS BIGINT) AS config, date_trunc('month', l_shipdate) AS event_time,
    round(avg(l_discount - l_tax), 9) AS ret FROM lineitem GROUP BY 1, 2"""


def monthly_sweep(spark, d):
    return t.load(spark, d, "lineitem").groupBy(
        F.col("l_linenumber").cast("bigint").alias("config"), F.date_trunc("month", "l_shipdate").alias("event_time")
    ).agg(t.half_away(F.avg(F.col("l_discount") - F.col("l_tax")), 9).alias("ret"))


@query(
    "g6_overfitting_probability",
    "G6",
    oracle(
        f"""SELECT {r('avg(CASE WHEN rank <= 0.5 THEN 1.0 ELSE 0.0 END)')} AS pbo, count(*) AS n_combinations, (SELECT count(DISTINCT config) FROM ms) AS n_configurations FROM (
            SELECT w.mask, avg(CASE WHEN o <= best THEN 1.0 ELSE 0.0 END) AS rank FROM wide w JOIN (SELECT mask, max_by(o, (a, -config)) AS best FROM wide GROUP BY 1) USING (mask) GROUP BY 1)""",
        {
            "ms": SWEEP_RETURNS,
            "blocked": "SELECT * FROM (SELECT config, ret, (row_number() OVER (PARTITION BY config ORDER BY event_time) - 1) // (count(*) OVER (PARTITION BY config) // 10) AS block FROM ms) WHERE block < 10",
            "masks": "SELECT m AS mask, b AS block, ((m >> b) & 1) = 1 AS inside FROM (SELECT unnest(range(1024)) AS m), (SELECT unnest(range(10)) AS b) WHERE bit_count(m) = 5",
            "wide": """SELECT mask, config, avg(ret) FILTER (inside) / stddev_samp(ret) FILTER (inside) AS a, avg(ret) FILTER (NOT inside) / stddev_samp(ret) FILTER (NOT inside) AS o
                FROM blocked JOIN masks USING (block) GROUP BY 1, 2""",
        },
    ),
)
def overfitting(spark, d):
    return present(rs.backtest_overfitting(monthly_sweep(spark, d), []))


DROP_SAMPLES = 30
DROPPED = {
    "kept": f"""SELECT sample, symbol FROM (SELECT sample, symbol, row_number() OVER (PARTITION BY sample ORDER BY {mix_sql('sym_no', 'sample')}, sym_no) AS rk,
        count(*) OVER (PARTITION BY sample) AS n FROM (SELECT DISTINCT symbol, sym_no FROM panel_smooth), (SELECT unnest(range({DROP_SAMPLES})) AS sample))
        WHERE rk <= greatest(2, floor(n * 0.8))""",
    "drop_weights": """SELECT sample, decision_time, symbol, 1.0 / k AS weight FROM (SELECT *, greatest(1, floor(n * 0.2)) AS k FROM (
        SELECT *, row_number() OVER (PARTITION BY sample, decision_time ORDER BY -score, symbol) AS rk, count(*) OVER (PARTITION BY sample, decision_time) AS n
        FROM sweep_scores JOIN kept USING (symbol) WHERE config = 8)) WHERE rk <= k""",
    "dropped": evaluated_sql("drop_weights", "sample"),
}


def sampled(seen, names, spark, d, configs):
    """Books of ``configs`` on samples of the names; the view is read twice."""
    n = rows(spark, d)
    kept = rs.dropout_names(names, DROP_SAMPLES, rows=n).select("sample", "symbol")
    returns = po.holding_returns(seen)
    if fits_arrays(n, DROP_SAMPLES):
        masked = seen.join(rs.sample_masks(kept), "symbol")
        if len(configs) > 1:
            return po.evaluate_configs(masked, dates(spark, d), configs, 0.2, COST, DROP_SAMPLES)
        scored = po.momentum_scores(masked, configs, ["decision_time", "symbol", "_mask"])
        return po.evaluate_samples(scored, returns, dates(spark, d), ["config"], DROP_SAMPLES, 0.2, COST)
    scored = po.momentum_scores(seen.join(kept, "symbol"), configs, ["decision_time", "symbol", "sample"])
    return po.evaluate(po.top_fraction(scored, ["sample", "config", "decision_time"], 0.2, rows=n), returns, dates(spark, d), ["sample", "config"], COST)


def dropout(spark, d):
    panel = t.panel_smooth(spark, d)
    features = po.momentum_features(panel, (CONFIGS[8][0],), (CONFIGS[8][1],))
    names = panel.select("symbol", "sym_no").distinct()
    seen = po.decision_view(features, dates(spark, d)).select("symbol", "decision_time", "entry", f"start_{CONFIGS[8][0]}", f"end_{CONFIGS[8][1]}")
    return sampled(seen.persist(StorageLevel.DISK_ONLY), names, spark, d, [CONFIGS[8]])


@query(
    "g7_universe_dropout",
    "G7 UD4",
    sql(f"SELECT sample, {r(_SR)} AS sharpe FROM dropped GROUP BY sample", **DROPPED),
)
def universe_dropout(spark, d):
    return present(dropout(spark, d).groupBy("sample").agg(performance.sharpe(F.col("ret"), periods=MONTHS).alias("sharpe")))


def placebo(spark, d):
    return po.evaluate(random_weights(spark, d), po.holding_returns(view(spark, d)), dates(spark, d), ["seed"], COST)


@query(
    "g8_placebo",
    "G8 UD4",
    sql(f"SELECT seed, {r(_SR)} AS sharpe FROM placed GROUP BY seed", random_weights=RANDOM, placed=evaluated_sql("random_weights", "seed")),
)
def placebos(spark, d):
    return present(placebo(spark, d).groupBy("seed").agg(performance.sharpe(F.col("ret"), periods=MONTHS).alias("sharpe")))


@query(
    "g9_parameter_sweep",
    "G9",
    sql(
        f"SELECT CAST(config AS BIGINT) AS config, CAST(lookback AS BIGINT) AS lookback, CAST(skip AS BIGINT) AS skip, {r(_SR)} AS sharpe FROM sweep JOIN "
        f"(VALUES {', '.join(f'({i}, {k}, {s})' for i, (k, s) in enumerate(CONFIGS))}) AS c(cfg, lookback, skip) ON cfg = config GROUP BY 1, 2, 3"
    ),
)
def parameter_sweep(spark, d):
    stats = sweep(spark, d).groupBy("config").agg(performance.sharpe(F.col("ret"), periods=MONTHS).alias("sharpe"))
    pick = F.array(*[F.struct(F.lit(k).alias("lookback"), F.lit(s).alias("skip")) for k, s in CONFIGS])
    return present(stats.withColumn("c", pick[F.col("config")]).select("config", "c.lookback", "c.skip", "sharpe"))


# ---- gauntlet ------------------------------------------------------------------------------


def evaluated(seen, spark, d):
    """``evaluate`` of ``sweep_weights``, side by side where a decision's names fit a task."""
    n = rows(spark, d)
    if fits_arrays(n, len(CONFIGS)):
        return po.evaluate_configs(seen, dates(spark, d), CONFIGS, 0.2, COST)
    return po.evaluate(sweep_weights(seen, n), po.holding_returns(seen), dates(spark, d), ["config"], COST)


def gauntlet_results(spark, d):
    """The twelve checks for each swept configuration.

    Panel and views are written once; each check is a table of its own, made one
    after another, so that the shuffle files of one are gone before the next.
    """
    named = F.concat(F.lit("momentum-"), F.col("config").cast("string")).alias("strategy")
    n = rows(spark, d)
    panel = written(t.panel_smooth(spark, d), "panel")
    ends = [f"start_{k}" for k in LOOKBACKS] + [f"end_{s}" for s in SKIPS]
    looked = lambda frame: view_of(frame, spark, d).select("symbol", "sym_no", "decision_time", "close", "entry", *ends)
    seen, false = written(looked(panel), "seen"), written(looked(pit.corrupt_future(panel, 0.7)), "seen")
    # a row per configuration and month, read by every check
    swept = written(evaluated(seen, spark, d).select(named, "config", "event_time", "ret", "gross_ret", "turnover"), "swept")
    base = swept.select("strategy", "config", "event_time", "ret")
    own = base.groupBy("strategy", "config").agg(performance.sharpe(F.col("ret"), periods=MONTHS).alias("sharpe"))
    names = own.select("strategy")

    def costs():
        return rs.check_cost_sensitivity(swept.select("strategy", (F.col("gross_ret") - F.col("turnover") * COST * 3.0).alias("ret")), MONTHS)

    # the months in order, a row each: three fifths to develop on, then walk forward, the last year locked
    months = base.select("event_time").distinct().withColumn("_all", F.lit(0))
    own_month = Window.partitionBy("_all").orderBy("event_time")
    months = months.select("event_time", F.row_number().over(own_month).alias("month"), F.count(F.lit(1)).over(Window.partitionBy("_all")).alias("months"))
    dated = base.join(small(months, n), "event_time")
    opened, locked = dated.where(F.col("month") <= F.col("months") - LOCKED_MONTHS), dated.where(F.col("month") > F.col("months") - LOCKED_MONTHS)

    def walk_forward():
        return rs.check_walk_forward(opened.withColumn("in_sample", F.col("month") <= 0.6 * F.col("months")), MONTHS)

    def plateau():
        near = own.select(F.col("strategy"), F.col("config")).join(
            own.select((F.floor(F.col("config") / 3)).alias("_group"), F.col("sharpe")), F.floor(F.col("config") / 3) == F.col("_group")
        )
        return rs.check_parameter_plateau(near.select("strategy", "sharpe"))

    def deflated_():
        moments = rs.sharpe_moments(base, ["strategy"]).withColumn("n_trials", F.lit(len(CONFIGS)))
        return rs.check_deflated_sharpe(rs.deflated_sharpe(moments))

    def placebos_():
        drawn = po.evaluate(drawn_names(seen), po.holding_returns(seen), dates(spark, d), ["seed"], COST)
        sharpes = drawn.groupBy("seed").agg(performance.sharpe(F.col("ret"), periods=MONTHS).alias("sharpe"))
        spread = names.join(F.broadcast(sharpes), F.lit(True), "left").select("strategy", "sharpe")
        return rs.check_placebo(spread, own)

    def integrity():
        flagged = quality.flagged_bars(panel, "1d", rows=n)
        critical = quality.findings(flagged).agg(F.count_if(F.col("severity") == "CRITICAL").alias("critical"))
        return rs.check_data_integrity(names.join(F.broadcast(critical), F.lit(True), "left"))

    def ahead():
        # every configuration again, on the view of prices that are false behind the cutoff
        twin = evaluated(false, spark, d)
        cutoff = panel.agg(F.percentile(F.unix_seconds("event_time"), F.lit(0.3)).alias("_t"))
        pairs = base.join(twin.select("config", "event_time", F.col("ret").alias("corrupted_ret")), ["config", "event_time"])
        return rs.check_look_ahead(pairs.join(F.broadcast(cutoff), F.unix_seconds("event_time") < F.col("_t")))

    def dropout_():
        # every configuration on samples of the names: sample and configuration are keys of one evaluation
        books = sampled(seen, panel.select("symbol", "sym_no").distinct(), spark, d, CONFIGS)
        return rs.check_universe_dropout(books.groupBy(named, "sample").agg(performance.sharpe(F.col("ret"), periods=MONTHS).alias("sharpe")))

    def regimes():
        market = factors.add_market_return(panel, n).where(F.col("market_ret").isNotNull()).select("event_time", "market_ret").distinct()
        labels = stationarity.regime_slices(market.withColumns({"_one": F.lit(0), "ret": F.col("market_ret")}), ["_one"])
        labels = labels.select(F.to_date("event_time").alias("_day"), "regime").distinct()
        paid = base.withColumn("_day", F.to_date("event_time")).join(small(labels, n), "_day").select("strategy", "regime", "ret")
        return rs.check_regimes(paid, MONTHS)

    def shuffled():
        return rs.check_monte_carlo(rs.monte_carlo_drawdown(rs.series_arrays(base, ["strategy"]), ["strategy"], DRAWS))

    def overfit():
        pbo = rs.backtest_overfitting(base.select("config", "event_time", "ret"), []).select("pbo")
        return rs.check_pbo(names.join(F.broadcast(pbo), F.lit(True), "left"))

    checks = [integrity, ahead, dropout_, regimes, lambda: rs.check_locked(locked, periods=MONTHS), costs, walk_forward, plateau, deflated_, placebos_, shuffled, overfit]
    found = [written(check(), "check") for check in checks]
    names = written(names, "names")
    discard(panel, seen, false, swept)
    return names, found


@query("g10_gauntlet_checks", "G10")
def gauntlet_checks(spark, d):
    names, found = gauntlet_results(spark, d)
    return present(rs.gauntlet(spark, names, found, short_circuit=False))


@query("g11_gauntlet_verdict", "G11")
def gauntlet_verdict(spark, d):
    names, found = gauntlet_results(spark, d)
    return present(rs.gauntlet(spark, names, found))


@query(
    "g10_look_ahead",
    "G10 P11",
    sql(
        f"""SELECT 'momentum' AS strategy, '2_look_ahead' AS test, max(abs(a.ret - b.ret)) < 1e-9 AS passed, false AS skipped, {r('max(abs(a.ret - b.ret))')} AS statistic, 1e-9::DOUBLE AS threshold
        FROM sweep a JOIN sweep b USING (config, event_time) WHERE a.config = 8"""
    ),
)
def look_ahead(spark, d):
    n = rows(spark, d)
    panel = t.panel_smooth(spark, d)

    def run(frame):
        features = po.momentum_features(frame, LOOKBACKS, SKIPS)
        seen = po.decision_view(features, dates(spark, d))
        scored = po.momentum_scores(seen, [CONFIGS[8]], ["decision_time", "symbol"])
        return po.evaluate(po.top_fraction(scored, ["decision_time"], 0.2, rows=n).withColumn("book", F.lit(0)), po.holding_returns(seen), dates(spark, d), ["book"], COST)

    cutoff = panel.agg(F.percentile(F.unix_seconds("event_time"), F.lit(0.3)).alias("_t"))
    base, other = run(panel), run(pit.corrupt_future(panel, 0.7))
    both = base.select("event_time", "ret").join(other.select("event_time", F.col("ret").alias("corrupted_ret")), "event_time")
    before = both.join(F.broadcast(cutoff), F.unix_seconds("event_time") < F.col("_t"))
    return present(rs.check_look_ahead(before.withColumn("strategy", F.lit("momentum"))), threshold=12)


