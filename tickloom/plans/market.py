"""Queries over point-in-time panels, universes, screens, actions and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.stats import finite
from tickloom.operators import calendar, corpactions, joins, pit, quality, screener, sketches, universe
from tickloom.plans import tables as t
from tickloom.plans.registry import query
from tickloom.plans.research import EXTRA
from tickloom.plans.tables import oracle, present, r, rows
from tickloom.session import shared_folder

DAY = "'%Y-%m-%d'"
STAMP = "'%Y-%m-%d %H:%M:%S'"
AS_OF = "1998-06-15 12:00:00"

# ---- reads and predicates --------------------------------------------------


@query(
    "p1_observable_rows",
    "P1 S8 D1",
    oracle(
        f"""SELECT symbol, count(*) AS n_rows, strftime(max(event_time), {STAMP}) AS last_seen,
            {r('sum(volume)', 2)} AS volume FROM panel_raw WHERE receive_time <= TIMESTAMP '{AS_OF}' GROUP BY symbol"""
    ),
)
def observable(spark, d):
    seen = pit.observable(t.panel_raw(spark, d), AS_OF).groupBy("symbol")
    return present(
        seen.agg(F.count(F.lit(1)).alias("n_rows"), F.max("event_time").alias("last_seen"), F.sum("volume").alias("volume")), 2
    )


@query(
    "p1_causality_audit",
    "P1 F7",
    oracle(
        """SELECT count(*) AS rows, count(*) FILTER (l_shipdate > o_orderdate) AS violations,
           CAST(max(greatest(epoch(l_shipdate) - epoch(o_orderdate), 0)) AS BIGINT) AS max_ahead_seconds
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
    ),
)
def audit(spark, d):
    joined = t.load(spark, d, "lineitem").join(t.load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    seen = joined.select(F.col("l_shipdate").alias("receive_time"), F.col("o_orderdate").alias("decision_time"))
    return present(pit.observability_audit(seen))


@query(
    "p2_trailing_sessions",
    "P2 J7 S7",
    oracle(
        f"""SELECT strftime(session, {DAY}) AS session, count(*) AS names FROM panel_raw
        WHERE event_time IN (SELECT DISTINCT event_time FROM panel_raw ORDER BY 1 DESC LIMIT 250) GROUP BY session"""
    ),
)
def trailing(spark, d):
    recent = pit.trailing_sessions(t.panel_raw(spark, d), 250)
    return present(recent.groupBy("session").agg(F.count(F.lit(1)).alias("names")))


_RECENT = "(SELECT DISTINCT event_time FROM panel_raw ORDER BY 1 DESC LIMIT 60)"


@query(
    "p7_symbol_search",
    "P7 T1 F1",
    oracle(
        f"""SELECT symbol, {r('adv', 4)} AS traded_value, bars FROM (
            SELECT symbol, median(close * volume) AS adv, count(*) AS bars FROM panel_raw
            WHERE event_time IN {_RECENT} AND starts_with(symbol, 'S00') GROUP BY symbol)
            ORDER BY adv DESC, symbol LIMIT 60"""
    ),
)
def search(spark, d):
    return present(pit.search(t.panel_raw(spark, d), "s00"), 4)


@query(
    "p8_suggestions",
    "P8",
    oracle(
        """SELECT symbol, CAST(2 AS BIGINT) AS priority FROM (SELECT DISTINCT symbol FROM panel_raw)
           WHERE contains(symbol, '05') ORDER BY symbol LIMIT 8"""
    ),
)
def suggest(spark, d):
    return present(pit.suggestions(t.panel_raw(spark, d), "05"))


@query(
    "p9_latest_close",
    "P9 A7",
    oracle(
        f"""SELECT instrument_id, {r('max_by(close, event_time)')} AS close, max_by(symbol, event_time) AS symbol,
            strftime(max(event_time), {STAMP}) AS event_time FROM panel_raw GROUP BY instrument_id"""
    ),
)
def latest(spark, d):
    return present(pit.latest_close(t.panel_raw(spark, d)))


@query("p9_bar_count", "P9", oracle("SELECT count(DISTINCT event_time) AS bars FROM panel_raw"))
def bars(spark, d):
    return present(pit.bar_count(t.panel_raw(spark, d)))


@query(
    "p9_wide_closes",
    "P9",
    oracle(
        f"""SELECT strftime(event_time, {STAMP}) AS event_time, {r("max(close) FILTER (symbol = 'S0000000001')")} AS "S0000000001",
            {r("max(close) FILTER (symbol = 'S0000000002')")} AS "S0000000002"
            FROM panel_raw WHERE symbol IN ('S0000000001', 'S0000000002') GROUP BY 1"""
    ),
)
def wide(spark, d):
    return present(pit.wide_closes(t.panel_raw(spark, d), ["S0000000001", "S0000000002"]))


@query(
    "p10_tradable",
    "P10",
    oracle(
        """SELECT instrument_id, listed_at <= TIMESTAMP '1997-03-01' AND NOT coalesce(delisted_at <= TIMESTAMP '1997-03-01', false)
           AND NOT coalesce(expiry <= TIMESTAMP '1997-03-01', false) AS tradable FROM instruments"""
    ),
)
def tradable(spark, d):
    return present(pit.tradable_on(t.instruments(spark, d), "1997-03-01").select("instrument_id", "tradable"))


@query(
    "p11_corrupted_future",
    "P11",
    oracle(
        f"""SELECT symbol, {r('sum(c)', 4)} AS close_sum, {r('max(h)', 4)} AS high FROM (
            SELECT symbol, CASE WHEN event_time >= cut THEN close * 3 ELSE close END AS c,
                   CASE WHEN event_time >= cut THEN high * 3 ELSE high END AS h
            FROM panel_raw, (SELECT event_time AS cut FROM (
                SELECT event_time, row_number() OVER (ORDER BY event_time) - 1 AS i, count(*) OVER () AS n
                FROM (SELECT DISTINCT event_time FROM panel_raw)) WHERE i = floor(n * 0.7))) GROUP BY symbol"""
    ),
)
def corrupted(spark, d):
    df = pit.corrupt_future(t.panel_raw(spark, d), 0.7).groupBy("symbol")
    return present(df.agg(F.sum("close").alias("close_sum"), F.max("high").alias("high")), 4)


@query(
    "p13_bar_violations",
    "P13 S2 S10",
    oracle(
        """SELECT coalesce(v, 'sound') AS violation, count(*) AS n FROM (
            SELECT CASE WHEN receive_time < event_time THEN 'receive_before_event'
                        WHEN least(open, high, low, close) <= 0 THEN 'non_positive_price'
                        WHEN high < low OR open > high OR open < low OR close > high OR close < low THEN 'ohlc_order' END AS v
            FROM dirty_bars) GROUP BY 1"""
    ),
)
def violations(spark, d):
    df = pit.bar_violations(t.dirty_bars(spark, d))
    return present(df.groupBy(F.coalesce("violation", F.lit("sound")).alias("violation")).agg(F.count(F.lit(1)).alias("n")))


_QUOTES = {
    "quotes": """SELECT instrument_id, event_time, receive_time, sequence, price * 0.999 AS bid,
        CASE WHEN sequence % 211 = 0 THEN price * 0.998 ELSE price * 1.001 END AS ask FROM ticks"""
}


def quotes(spark, d):
    c = F.col
    return t.ticks(spark, d).select(
        "instrument_id", "event_time", "receive_time", "sequence",
        (c("price") * 0.999).alias("bid"),
        F.when(c("sequence") % 211 == 0, c("price") * 0.998).otherwise(c("price") * 1.001).alias("ask"),
    )


@query(
    "p13_quote_violations",
    "P13 P14",
    oracle(
        f"""SELECT instrument_id, count(*) FILTER (bid > ask) AS crossed, {r('avg(ask - bid)')} AS spread,
            {r('avg((ask + bid) / 2)')} AS mid FROM quotes GROUP BY instrument_id""",
        _QUOTES,
    ),
)
def quote_checks(spark, d):
    df = pit.quote_columns(pit.quote_violations(quotes(spark, d)))
    return present(
        df.groupBy("instrument_id").agg(
            F.count_if(F.col("violation") == "crossed_book").alias("crossed"), F.avg("spread").alias("spread"), F.avg("mid").alias("mid")
        )
    )


@query(
    "p14_bar_columns",
    "P14",
    oracle(
        f"""SELECT symbol, {r('avg((high + low + close) / 3)')} AS typical_price,
            count(*) FILTER (open = close) AS dojis FROM panel_smooth GROUP BY symbol"""
    ),
)
def bar_columns(spark, d):
    df = pit.bar_columns(t.panel_smooth(spark, d))
    return present(df.groupBy("symbol").agg(F.avg("typical_price").alias("typical_price"), F.count_if("is_doji").alias("dojis")))


@query(
    "t3_tail_sma",
    "T3 W2",
    oracle(
        f"""SELECT symbol, {r('avg(close)')} AS sma, count(*) AS bars FROM (
            SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY event_time DESC) AS k FROM panel_smooth)
            WHERE k <= 50 GROUP BY symbol"""
    ),
)
def tail_sma(spark, d):
    df = pit.tail(t.panel_smooth(spark, d), 50)
    return present(df.groupBy("symbol").agg(F.avg("close").alias("sma"), F.count(F.lit(1)).alias("bars")))


@query(
    "t4_every_kth",
    "T4",
    oracle(
        f"""SELECT symbol, strftime(session, {DAY}) AS session, {r('close')} AS close FROM (
            SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY event_time) - 1 AS i FROM panel_smooth) WHERE i % 20 = 0"""
    ),
)
def every_kth(spark, d):
    return present(pit.every_kth(t.panel_smooth(spark, d), 20).select("symbol", "session", "close"))


# ---- universes and liquidity ------------------------------------------------

RULES = universe.UniverseRules(top_n=30, lookback_days=60, min_price=1.0, min_sessions=8, min_median_value=20000.0)


def universe_sql(dates: str) -> str:
    return f"""
    SELECT as_of, instrument_id, median_value, last_close, sessions, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY median_value DESC, instrument_id) AS rank FROM (
        SELECT as_of, instrument_id, median(close * volume) AS median_value, max_by(close, event_time) AS last_close, count(*) AS sessions
        FROM panel_raw JOIN (
          SELECT * FROM (SELECT as_of, decision_time, event_time,
                                row_number() OVER (PARTITION BY as_of ORDER BY event_time DESC) AS back
                         FROM {dates} JOIN (SELECT event_time, min(receive_time) AS known FROM panel_raw GROUP BY 1)
                           ON known <= decision_time AND CAST(event_time AS DATE) >= CAST(decision_time AS DATE) - 120)
          WHERE back <= 60) USING (event_time)
        WHERE receive_time <= decision_time GROUP BY 1, 2)
      WHERE sessions >= 8 AND last_close >= 1 AND median_value >= 20000) WHERE rank <= 30"""


SCHEDULE = {"schedule": universe_sql("rebalance_dates")}


def schedule(spark, d):
    return universe.universe_schedule(t.panel_raw(spark, d), t.rebalance_dates(spark, d), RULES, t.lines(spark, d))


@query(
    "a1_universe",
    "A1 T1",
    oracle(
        f"SELECT instrument_id, rank, {r('median_value', 4)} AS median_value, {r('last_close', 4)} AS last_close, sessions FROM one",
        {
            "one_date": f"SELECT DATE '{AS_OF[:10]}' AS as_of, TIMESTAMP '{AS_OF}' AS decision_time",
            "one": universe_sql("one_date"),
        },
    ),
)
def one_universe(spark, d):
    df = universe.universe(t.panel_raw(spark, d), AS_OF, RULES)
    return present(df.select("instrument_id", "rank", "median_value", "last_close", "sessions"), 4)


@query(
    "a2_universe_schedule",
    "A2",
    oracle(
        f"""SELECT strftime(as_of, {DAY}) AS as_of, instrument_id, rank, {r('median_value', 4)} AS median_value FROM schedule""",
        SCHEDULE,
    ),
)
def universe_schedule(spark, d):
    return present(schedule(spark, d).select("as_of", "instrument_id", "rank", "median_value"), 4)


@query(
    "a3_universe_turnover",
    "A3 U3",
    oracle(
        f"""SELECT strftime(as_of, {DAY}) AS as_of, CAST(sum(a) AS BIGINT) AS members, CAST(sum(CASE WHEN b = 0 THEN 1 ELSE 0 END) AS BIGINT) AS added,
            CAST(sum(CASE WHEN a = 0 THEN 1 ELSE 0 END) AS BIGINT) AS dropped,
            {r('sum(CASE WHEN a <> b THEN 1 ELSE 0 END) / count(*)')} AS turnover
        FROM (SELECT i, instrument_id, max(a) AS a, max(b) AS b FROM (
            SELECT i, instrument_id, 1 AS a, 0 AS b FROM schedule JOIN numbered USING (as_of)
            UNION ALL SELECT i + 1, instrument_id, 0, 1 FROM schedule JOIN numbered USING (as_of)) GROUP BY 1, 2)
        JOIN numbered USING (i) GROUP BY as_of""",
        {**SCHEDULE, "numbered": "SELECT as_of, row_number() OVER (ORDER BY as_of) AS i FROM rebalance_dates"},
    ),
)
def universe_turnover(spark, d):
    return present(universe.turnover(schedule(spark, d), t.rebalance_dates(spark, d)))


@query(
    "a3_survivorship",
    "A3 U3",
    oracle(
        """SELECT instrument_id, CASE WHEN l IS NULL THEN 'dropped' WHEN e IS NULL THEN 'added' ELSE 'kept' END AS status
           FROM (SELECT instrument_id, 1 AS e FROM schedule WHERE as_of = (SELECT min(as_of) FROM schedule))
           FULL JOIN (SELECT instrument_id, 1 AS l FROM schedule WHERE as_of = (SELECT max(as_of) FROM schedule)) USING (instrument_id)""",
        SCHEDULE,
    ),
)
def survivors(spark, d):
    members = schedule(spark, d)
    ends = members.agg(F.min("as_of").alias("a"), F.max("as_of").alias("b")).first()
    return present(universe.survivorship(members, str(ends["a"]), str(ends["b"])))


@query(
    "a6_trailing_adv",
    "A6",
    oracle(
        f"""SELECT instrument_id, {r('round(CAST(avg(close * volume) AS DECIMAL(28,10)), 2)', 2)} AS adv FROM panel_raw
            WHERE event_time IN (SELECT DISTINCT event_time FROM panel_raw ORDER BY 1 DESC LIMIT 20) GROUP BY 1 HAVING avg(close * volume) > 0"""
    ),
)
def adv(spark, d):
    return present(universe.trailing_adv(t.panel_raw(spark, d)), 2)


@query(
    "a8_identity_changes",
    "A8",
    oracle(
        "SELECT symbol, count(DISTINCT instrument_id) AS instruments FROM renamed GROUP BY symbol HAVING count(DISTINCT instrument_id) > 1",
        {"renamed": "SELECT symbol, CASE WHEN rn > 250 AND sym_no % 4 = 0 THEN instrument_id || 'B' ELSE instrument_id END AS instrument_id FROM panel_smooth"},
    ),
)
def identities(spark, d):
    moved = (F.col("rn") > 250) & (F.col("sym_no") % 4 == 0)
    new_id = F.when(moved, F.concat("instrument_id", F.lit("B"))).otherwise(F.col("instrument_id"))
    return present(universe.identity_changes(t.panel_smooth(spark, d).withColumn("instrument_id", new_id)))


@query(
    "a9_market_return",
    "A9 J3",
    oracle(
        f"""SELECT strftime(event_time, {DAY}) AS session, {r('avg(ret)')} AS market_ret, count(*) AS names FROM (
            SELECT event_time, close / lag(close) OVER (PARTITION BY symbol ORDER BY event_time) - 1 AS ret FROM panel_smooth)
            WHERE ret IS NOT NULL GROUP BY event_time"""
    ),
)
def market(spark, d):
    from tickloom.functions.windows import simple_return

    df = t.panel_smooth(spark, d).withColumn("ret", simple_return()).where("ret IS NOT NULL")
    return present(df.groupBy("session").agg(F.avg("ret").alias("market_ret"), F.count(F.lit(1)).alias("names")))


@query(
    "a10_most_liquid",
    "A10 T1",
    oracle(
        f"""SELECT instrument_id, {r('m', 4)} AS median_value FROM (SELECT instrument_id, median(close * volume) AS m FROM panel_raw GROUP BY 1)
            ORDER BY m DESC, instrument_id LIMIT 25"""
    ),
)
def liquid(spark, d):
    return present(universe.most_liquid(t.panel_raw(spark, d), 25), 4)


SKETCHED = {"windowed_values": "SELECT symbol, close * volume AS value FROM panel_raw WHERE session >= DATE '1994-02-01' AND session < DATE '1997-05-01'"}
_kept: dict[tuple[str, str], str] = {}


def value_sketches(spark, d):
    """Sketches of the panel, written once per application and folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _kept:
        path = shared_folder(spark, "value-sketches")
        sketches.monthly_sketches(t.panel_raw(spark, d)).write.parquet(path)
        _kept[key] = path
    return spark.read.parquet(_kept[key])


@query(
    "p4_liquid_by_sketch",
    "P4 A10",
    oracle("SELECT symbol FROM windowed_values GROUP BY symbol HAVING median(value) >= 60000", SKETCHED),
)
def liquid_by_sketch(spark, d):
    names = sketches.liquid_names(value_sketches(spark, d), t.panel_raw(spark, d), 60000.0, "1994-02-10", "1997-04-20")
    return present(names.select("symbol"))


@query(
    "a10_most_liquid_by_sketch",
    "A10 T1",
    oracle(f"SELECT symbol, {r('m', 4)} AS median_value FROM (SELECT symbol, median(value) AS m FROM windowed_values GROUP BY 1) ORDER BY m DESC, symbol LIMIT 25", SKETCHED),
)
def most_liquid_by_sketch(spark, d):
    return present(sketches.most_liquid(value_sketches(spark, d), t.panel_raw(spark, d), 25, "1994-02-10", "1997-04-20"), 4)


# ---- screens ----------------------------------------------------------------

SCREEN = screener.Screen(window=700, min_adv=30000.0, min_bars=120, min_price=5.0, limit=20)
_CHEAP = """
    SELECT symbol, count(*) AS bars, max_by(close, event_time) AS last_close, min_by(close, event_time) AS first_close,
           median(close * volume) AS adv, stddev_samp(ret) * sqrt(252) AS volatility, max(abs(ret)) AS max_move,
           max_by(close, event_time) / min_by(close, event_time) - 1 AS window_return
    FROM (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY event_time) - 1 AS ret FROM panel_split
          WHERE event_time IN (SELECT DISTINCT event_time FROM panel_split ORDER BY 1 DESC LIMIT 1900))
    GROUP BY symbol HAVING count(*) >= 120 AND adv >= 30000 AND last_close >= 5"""
WIDE_SCREEN = screener.Screen(window=1900, min_adv=30000.0, min_bars=120, limit=20)
_SCREEN_COLS = ["symbol", "bars", "last_close", "adv", "volatility", "max_move", "window_return"]
_SCREEN_SQL = f"""symbol, bars, {r('last_close')} AS last_close, {r('adv', 4)} AS adv, {r('volatility')} AS volatility,
    {r('max_move')} AS max_move, {r('window_return')} AS window_return"""


@query(
    "a4_cheap_pass",
    "A4",
    oracle(f"SELECT {_SCREEN_SQL}, NOT coalesce(max_move < 0.35, false) AS suspected FROM cheap", {"cheap": _CHEAP}),
)
def cheap(spark, d):
    df = screener.cheap_pass(t.panel_split(spark, d), WIDE_SCREEN)
    return present(df.select(*_SCREEN_COLS, "suspected"), adv=4)


@query(
    "a5_screen_counts",
    "A5",
    oracle(
        """SELECT (SELECT count(DISTINCT symbol) FROM panel_split) AS considered, count(*) FILTER (max_move < 0.35) AS passed_filters,
           count(*) FILTER (NOT coalesce(max_move < 0.35, false)) AS suspected_actions FROM cheap""",
        {"cheap": _CHEAP},
    ),
)
def counts(spark, d):
    return present(screener.screen_counts(t.panel_split(spark, d), WIDE_SCREEN))


def _register_sort(name: str) -> None:
    column, descending = screener.SORTS[name]

    @query(
        f"a5_shortlist_{name}",
        "A5 T2",
        oracle(
            f"""SELECT {_SCREEN_SQL} FROM (SELECT * FROM cheap WHERE max_move < 0.35
                ORDER BY {column} {'DESC' if descending else 'ASC'} NULLS LAST, symbol LIMIT 20)""",
            {"cheap": _CHEAP},
        ),
    )
    def run(spark, d):
        screen = screener.Screen(window=1900, min_adv=30000.0, min_bars=120, sort_by=name, limit=20)
        return present(screener.shortlist(t.panel_split(spark, d), screen).select(*_SCREEN_COLS), adv=4)


for _name in screener.SORTS:
    _register_sort(_name)

# ---- joins ------------------------------------------------------------------

_REQUESTS = """SELECT 'brand#' || CAST(o_custkey % 30 AS VARCHAR) AS symbol, 'NSE' AS exchange, o_orderdate AS as_of, o_orderkey FROM orders"""


def requests(spark, d):
    return t.load(spark, d, "orders").select(
        F.concat(F.lit("brand#"), (F.col("o_custkey") % 30).cast("string")).alias("symbol"),
        F.lit("NSE").alias("exchange"),
        F.col("o_orderdate").alias("as_of"),
        "o_orderkey",
    )


@query(
    "j1_resolve_symbols",
    "J1",
    oracle(
        """SELECT q.o_orderkey, coalesce(a.instrument_id, 'unresolved') AS instrument_id FROM requests q LEFT JOIN aliases a
           ON upper(q.symbol) = upper(a.symbol) AND q.exchange = a.exchange AND a.valid_from <= q.as_of
           AND (a.valid_to IS NULL OR q.as_of < a.valid_to)""",
        {"requests": _REQUESTS},
    ),
)
def resolved(spark, d):
    df = joins.resolve_symbols(requests(spark, d), t.aliases(spark, d), t.lines(spark, d, "part"))
    return present(df.select("o_orderkey", F.coalesce("instrument_id", F.lit("unresolved")).alias("instrument_id")))


@query(
    "j2_symbols_of",
    "J2",
    oracle(
        """SELECT instrument_id, string_agg(symbol, ',' ORDER BY symbol) AS symbols FROM aliases
           WHERE valid_from <= TIMESTAMP '1997-06-01' AND (valid_to IS NULL OR TIMESTAMP '1997-06-01' < valid_to) GROUP BY 1"""
    ),
)
def symbols_of(spark, d):
    df = joins.symbols_of(t.aliases(spark, d), "1997-06-01")
    return present(df.select("instrument_id", F.array_join("symbols", ",").alias("symbols")))


_TOP3 = "(SELECT symbol FROM panel_raw GROUP BY 1 ORDER BY count(*) DESC, symbol LIMIT 3)"


@query(
    "j5_aligned_returns",
    "J5",
    oracle(
        f"""SELECT strftime(event_time, {STAMP}) AS event_time, symbol, {r('ret')} AS ret FROM (
            SELECT event_time, symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY event_time) - 1 AS ret
            FROM panel_raw WHERE symbol IN {_TOP3} AND event_time IN (
              SELECT event_time FROM panel_raw WHERE symbol IN {_TOP3} GROUP BY 1 HAVING count(*) = 3)) WHERE ret IS NOT NULL"""
    ),
)
def aligned(spark, d):
    panel = t.panel_raw(spark, d)
    busiest = panel.groupBy("symbol").count().orderBy(F.desc("count"), "symbol").limit(3)
    return present(joins.aligned_returns(panel, busiest, 3))


SCORES_SQL = {
    "scores": """SELECT symbol, event_time, CASE WHEN rn % 17 = 0 THEN CAST('NaN' AS DOUBLE) ELSE close - open END AS signal FROM panel_smooth""",
    "decisions": """SELECT DISTINCT symbol, decision_time FROM (SELECT DISTINCT symbol FROM panel_smooth), rebalance_dates""",
}


def scores(spark, d):
    signal = F.when(F.col("rn") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("close") - F.col("open"))
    return t.panel_smooth(spark, d).select("symbol", "event_time", signal.alias("signal"), "instrument_id")


def decisions(spark, d):
    """Every name at every rebalance: the grid the decisions are made on."""
    names = t.panel_smooth(spark, d).select("symbol").distinct()
    dates = t.rebalance_dates(spark, d).agg(F.collect_list("decision_time").alias("dates"))
    return names.withColumn("decision_time", F.explode(dates.scalar()))


@query(
    "j6_asof_scores",
    "J6",
    oracle(
        f"""SELECT symbol, strftime(decision_time, {STAMP}) AS decision_time, {r('signal')} AS signal, strftime(value_time, {STAMP}) AS value_time
        FROM (SELECT d.symbol, decision_time, max_by(signal, event_time) AS signal, max(event_time) AS value_time
              FROM decisions d JOIN scores s ON d.symbol = s.symbol AND s.event_time <= d.decision_time GROUP BY 1, 2)
        WHERE isfinite(signal)""",
        SCORES_SQL,
    ),
)
def asof_scores(spark, d):
    return present(joins.scores_at(decisions(spark, d), scores(spark, d)))


@query(
    "j8_quantity_factors",
    "J8 C1",
    oracle(
        f"""SELECT i.instrument_id, strftime(i.s, {DAY}) AS "start", strftime(i.e, {DAY}) AS "end", count(a.ex_date) AS actions,
            {r("exp(coalesce(sum(ln(CASE WHEN a.action_type IN ('SPLIT', 'BONUS') THEN a.ratio ELSE 1 END)), 0))")} AS factor
        FROM (SELECT instrument_id, date_trunc('year', session)::DATE AS s, max(session) AS e FROM panel_raw GROUP BY 1, 2) i
        LEFT JOIN actions a ON a.instrument_id = i.instrument_id AND i.s < a.ex_date AND a.ex_date <= i.e GROUP BY 1, 2, 3"""
    ),
)
def quantity_factors(spark, d):
    years = t.panel_raw(spark, d).groupBy("instrument_id", F.to_date(F.date_trunc("year", "session")).alias("start"))
    intervals = years.agg(F.max("session").alias("end"))
    return present(corpactions.quantity_factors(intervals, t.actions(spark, d)))


@query(
    "j9_known_actions",
    "J9",
    oracle(
        f"""SELECT instrument_id, action_type, strftime(ex_date, {DAY}) AS ex_date FROM actions
            WHERE coalesce(announcement_date, ex_date) <= DATE '1998-01-01'"""
    ),
)
def known(spark, d):
    return present(corpactions.known_at(t.actions(spark, d), "1998-01-01").select("instrument_id", "action_type", "ex_date"))


@query(
    "j10_unexplained_jumps",
    "J10",
    oracle(
        f"""SELECT instrument_id, strftime(ex_date, {DAY}) AS ex_date, {r('move')} AS move FROM (
            SELECT instrument_id, session AS ex_date, close / lag(close) OVER (PARTITION BY instrument_id ORDER BY event_time) - 1 AS move FROM panel_split) m
            WHERE abs(move) > 0.35 AND NOT EXISTS (SELECT 1 FROM actions a WHERE a.action_type = 'DIVIDEND'
              AND a.instrument_id = m.instrument_id AND a.ex_date = m.ex_date)"""
    ),
)
def jumps(spark, d):
    known = t.actions(spark, d).where("action_type = 'DIVIDEND'")
    return present(corpactions.unexplained_jumps(t.panel_split(spark, d), known))


# ---- corporate actions --------------------------------------------------------

_VENDOR = """SELECT 'X' || CAST(p_partkey AS VARCHAR) AS instrument_id, CASE WHEN p_size % 3 = 0 THEN p_size / 4.0 ELSE 1.0 END AS split_ratio,
    CASE WHEN p_size % 2 = 0 THEN p_retailprice / 1000 ELSE 0 END AS dividend FROM part"""


@query(
    "c1_action_checks",
    "C1",
    oracle(
        f"""SELECT coalesce(CASE WHEN announcement_date > ex_date THEN 'announced_after_ex_date'
              WHEN action_type IN ('SPLIT', 'BONUS') AND ratio = 1 THEN 'ratio_without_effect'
              WHEN action_type = 'DIVIDEND' AND cash_per_share <= 0 THEN 'dividend_without_cash' END, 'sound') AS violation,
            count(*) AS n, {r("sum(CASE WHEN action_type IN ('SPLIT', 'BONUS') THEN 1 / ratio ELSE 1 END)")} AS price_multipliers
        FROM spoiled GROUP BY 1""",
        {
            "spoiled": """SELECT action_type, ex_date, cash_per_share * (CASE WHEN contains(symbol, '7') THEN 0 ELSE 1 END) AS cash_per_share,
                CASE WHEN contains(symbol, '5') THEN 1.0 ELSE ratio END AS ratio,
                CASE WHEN contains(symbol, '3') THEN ex_date + 1 ELSE announcement_date END AS announcement_date FROM actions"""
        },
    ),
)
def action_checks(spark, d):
    has = F.col("symbol").contains
    spoiled = t.actions(spark, d).withColumns(
        {
            "cash_per_share": F.when(has("7"), 0.0).otherwise(F.col("cash_per_share")),
            "ratio": F.when(has("5"), 1.0).otherwise(F.col("ratio")),
            "announcement_date": F.when(has("3"), F.date_add("ex_date", 1)).otherwise(F.col("announcement_date")),
        }
    )
    df = corpactions.multipliers(corpactions.validate_actions(spoiled))
    return present(
        df.groupBy(F.coalesce("violation", F.lit("sound")).alias("violation")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("price_multiplier").alias("price_multipliers")
        )
    )


def vendor(spark, d):
    c = F.col
    return t.load(spark, d, "part").select(
        F.concat(F.lit("X"), c("p_partkey").cast("string")).alias("instrument_id"),
        F.lit("2000-01-03").cast("date").alias("ex_date"),
        F.when(c("p_size") % 3 == 0, c("p_size") / 4.0).otherwise(1.0).alias("split_ratio"),
        F.when(c("p_size") % 2 == 0, c("p_retailprice") / 1000).otherwise(0.0).alias("dividend"),
    )


@query(
    "c2_vendor_actions",
    "C2",
    oracle(
        f"""SELECT instrument_id, 'SPLIT' AS action_type, {r('split_ratio')} AS ratio, 0.0::DOUBLE AS cash_per_share FROM vendor
            WHERE split_ratio BETWEEN 0.01 AND 100 AND split_ratio <> 1
            UNION ALL SELECT instrument_id, 'DIVIDEND', 1.0::DOUBLE, {r('dividend')} FROM vendor WHERE dividend > 0""",
        {"vendor": _VENDOR},
    ),
)
def vendor_actions(spark, d):
    return present(corpactions.vendor_actions(vendor(spark, d)).drop("ex_date"))


@query(
    "c2_uncovered_names",
    "C2",
    oracle(
        "SELECT DISTINCT instrument_id FROM panel_raw WHERE instrument_id NOT IN (SELECT instrument_id FROM actions)"
    ),
)
def uncovered(spark, d):
    return present(corpactions.uncovered(t.panel_raw(spark, d), t.actions(spark, d)))


_FACTOR = "coalesce((SELECT product(1 / a.ratio) FROM actions a WHERE a.{k} = p.{k} AND a.action_type = 'SPLIT' AND p.event_time < CAST(a.ex_date AS TIMESTAMP)), 1)"


def _adjusted(key: str) -> str:
    return oracle(
        f"""SELECT symbol, strftime(session, {DAY}) AS session, {r('close * f', 6)} AS close, {r('volume / f', 6)} AS volume
            FROM (SELECT symbol, session, close, volume, {_FACTOR.format(k=key)} AS f FROM panel_split p)"""
    )


@query("c3_back_adjusted", "C3", _adjusted("instrument_id"))
def back_adjusted(spark, d):
    df = corpactions.back_adjust(t.panel_split(spark, d), t.actions(spark, d))
    return present(df.select("symbol", "session", "close", "volume"), 6)


@query("c5_display_series", "C5", _adjusted("symbol"))
def display(spark, d):
    df = corpactions.display_series(t.panel_split(spark, d), t.actions(spark, d))
    return present(df.select("symbol", "session", "close", "volume"), 6)


@query(
    "c4_inferred_splits",
    "C4 W4",
    oracle(
        f"SELECT symbol, strftime(event_time, {DAY}) AS session, {r('split_factor')} AS split_factor, {r('close * split_factor', 6)} AS close FROM split_factored",
        EXTRA,
    ),
)
def inferred(spark, d):
    df = corpactions.inferred_split_factors(t.panel_split(spark, d))
    return present(df.select("symbol", "session", "split_factor", (F.col("close") * F.col("split_factor")).alias("close")), close=6)


# ---- quality ------------------------------------------------------------------

_GAP = "OVER (PARTITION BY instrument_id ORDER BY event_time, seq)"
_FLAGGED = f"""
    SELECT *, coalesce(event_time = lag(event_time) {_GAP}, false) AS is_duplicate_timestamps,
      receive_time < event_time AS is_receive_before_event,
      low <= 0 OR high < low OR open > high OR open < low OR close > high OR close < low AS is_invalid_ohlc,
      coalesce(abs(close / lag(close) {_GAP} - 1) > 0.35, false) AS is_extreme_move, high = low AS is_flat_bars, volume = 0 AS is_zero_volume,
      coalesce(event_time - lag(event_time) {_GAP} > INTERVAL 10 DAY, false) AS is_missing_history,
      coalesce(event_time - lag(event_time) {_GAP} > INTERVAL 1 DAY, false) AS is_missing_bars,
      coalesce(event_time < lag(event_time) OVER (PARTITION BY instrument_id ORDER BY seq), false) AS is_out_of_order
    FROM dirty_bars"""


def _finding(check: str, severity: str, sampled: bool) -> str:
    sample = "array_to_string(list(strftime(event_time, '%Y-%m-%d') ORDER BY event_time)[1:3], ',')" if sampled else "NULL"
    count = "least(count(*), 1)" if check == "out_of_order" else "count(*)"
    return f"""SELECT instrument_id, '{check}' AS "check", {severity} AS severity, {count} AS count, {sample} AS sample
        FROM flagged WHERE is_{check} GROUP BY instrument_id"""


_FLAT = "CASE WHEN count(*) / (SELECT count(*) FROM dirty_bars b WHERE b.instrument_id = flagged.instrument_id) > 0.05 THEN 'WARN' ELSE 'INFO' END"


def findings_sql(gap: str) -> str:
    parts = [
        _finding(c, _FLAT if c == "flat_bars" else f"'{s}'", c in quality._SAMPLED)
        for c, s in quality.SEVERITY.items()
        if c not in ("missing_bars", "missing_history") or c == gap
    ]
    return " UNION ALL ".join(parts)


FOUND = {"flagged": _FLAGGED, "findings": findings_sql("missing_history")}
CONTINUOUS = {"flagged": _FLAGGED, "findings": findings_sql("missing_bars")}


def found(spark, d, continuous=False):
    flagged = quality.flagged_bars(t.dirty_bars(spark, d), "1d", continuous, "seq", 2 * rows(spark, d))
    return quality.findings(flagged)


def _sample():
    return F.array_join(F.transform("sample", lambda x: F.date_format(x, "yyyy-MM-dd")), ",").alias("sample")


@query("q1_quality_findings", "Q1 Q2 Q3 Q4 Q5 Q6 Q7 Q9 T5 W9", oracle("SELECT * FROM findings", FOUND))
def quality_findings(spark, d):
    return present(found(spark, d).select("instrument_id", "check", "severity", "count", _sample()))


@query("q8_continuous_findings", "Q8 W9", oracle("SELECT * FROM findings WHERE \"check\" = 'missing_bars'", CONTINUOUS))
def continuous_findings(spark, d):
    df = found(spark, d, continuous=True).where(F.col("check") == "missing_bars")
    return present(df.select("instrument_id", "check", "severity", "count", _sample()))


@query(
    "q10_quality_report",
    "Q10",
    oracle(
        """SELECT instrument_id, count(*) AS findings, count(*) FILTER (severity = 'CRITICAL') AS critical,
           count(*) FILTER (severity = 'CRITICAL') = 0 AS is_clean FROM findings GROUP BY instrument_id""",
        FOUND,
    ),
)
def quality_report(spark, d):
    return present(quality.report(found(spark, d)))


@query(
    "q10_quality_summary",
    "Q10",
    oracle('SELECT "check", severity, count(*) AS instruments, CAST(sum(count) AS BIGINT) AS rows FROM findings GROUP BY 1, 2', FOUND),
)
def quality_summary(spark, d):
    return present(quality.summary(found(spark, d)))


# ---- calendars ------------------------------------------------------------------


def holidays(spark, d):
    return t.panel_raw(spark, d).select("session").distinct().where(F.dayofyear("session") % 50 == 0)


_OPEN = f"""SELECT session FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '1993-01-01', TIMESTAMP '1999-12-31', INTERVAL 1 DAY)) AS DATE) AS session)
    WHERE isodow(session) <= 5 AND session NOT IN (SELECT session FROM panel_raw WHERE dayofyear(session) % 50 = 0)"""


@query(
    "f6_sessions",
    "F4 F6 UD5",
    oracle(
        f"""SELECT strftime(session, {DAY}) AS session, strftime(lead(session) OVER (ORDER BY session), {DAY}) AS next_session FROM open_days""",
        {"open_days": _OPEN},
    ),
)
def sessions(spark, d):
    days = calendar.sessions_between(spark, "1993-01-01", "1999-12-31", holidays(spark, d))
    return present(calendar.with_next_session(days))


@query(
    "f6_next_session",
    "F6",
    oracle(
        f"""SELECT strftime(day, {DAY}) AS day, strftime(min(session), {DAY}) AS next_session
        FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) LEFT JOIN (SELECT DISTINCT session FROM panel_raw) ON session > day AND session <= day + 30
        GROUP BY day"""
    ),
)
def next_session(spark, d):
    days = t.load(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return present(calendar.next_session(days, calendar.observed_sessions(t.panel_raw(spark, d))))


@query(
    "f5_local_sessions",
    "F3 F5",
    oracle(
        f"""SELECT sequence, strftime(l, {STAMP}) AS local_time,
            isodow(l) <= 5 AND CAST(l AS TIME) >= TIME '09:30:00' AND CAST(l AS TIME) < TIME '16:00:00' AS is_open
            FROM (SELECT sequence, (event_time AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS l FROM ticks)"""
    ),
)
def local_sessions(spark, d):
    ts = F.col("event_time")
    return present(
        t.ticks(spark, d).select(
            "sequence", calendar.local_time(ts, "US").alias("local_time"), calendar.is_open(ts, "US").alias("is_open")
        )
    )


@query(
    "f5_session_bounds",
    "F5",
    oracle(
        f"""SELECT strftime(session, {DAY}) AS session,
            strftime((CAST(session AS TIMESTAMP) + INTERVAL 570 MINUTE) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC', {STAMP}) AS opens,
            strftime((CAST(session AS TIMESTAMP) + INTERVAL 16 HOUR) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC', {STAMP}) AS closes
            FROM (SELECT DISTINCT session FROM panel_raw)"""
    ),
)
def session_bounds(spark, d):
    days = calendar.observed_sessions(t.panel_raw(spark, d))
    opens, closes = calendar.session_bounds(F.col("session"), "US")
    return present(days.select("session", opens.alias("opens"), closes.alias("closes")))


@query(
    "f7_staleness",
    "F7 RK9",
    oracle(
        """SELECT instrument_id, CAST(floor(epoch(TIMESTAMP '2024-02-01')) - floor(epoch(max(receive_time))) AS BIGINT) AS stale_seconds
           FROM ticks GROUP BY instrument_id"""
    ),
)
def staleness(spark, d):
    last = t.ticks(spark, d).groupBy("instrument_id").agg(F.max("receive_time").alias("_last"))
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return present(last.select("instrument_id", calendar.staleness_seconds(now, F.col("_last")).alias("stale_seconds")))


@query(
    "f1_scalar_functions",
    "F1 F2 F12 F13",
    oracle(
        """SELECT doc_id, upper(trim(lang)) AS lang, starts_with(source, 'w') AS web, contains(text, 'the') AS has_the,
           length(text) AS n, translate(lang || ':' || source || '/' || CAST(doc_id AS VARCHAR), ':/', '__') AS safe_key,
           sha256(text) AS digest FROM documents"""
    ),
)
def scalars(spark, d):
    from tickloom.functions.scalar import safe_key

    c = F.col
    return present(
        t.load(spark, d, "documents").select(
            "doc_id",
            F.upper(F.trim("lang")).alias("lang"),
            c("source").startswith("w").alias("web"),
            c("text").contains("the").alias("has_the"),
            F.length("text").alias("n"),
            safe_key(F.concat("lang", F.lit(":"), "source", F.lit("/"), c("doc_id").cast("string"))).alias("safe_key"),
            F.sha2("text", 256).alias("digest"),
        )
    )


@query(
    "f8_number_functions",
    "F8",
    oracle(
        f"""SELECT symbol, strftime(session, {DAY}) AS session, {r('ret')} AS ret, {r('ln(close)')} AS log_close, {r('sqrt(volume)')} AS root_volume,
            {r('CASE WHEN ret IS NOT NULL THEN greatest(least(ret, 0.01), -0.01) END')} AS clipped, {r('coalesce(ret, 0)')} AS filled, coalesce(isfinite(odd), false) AS is_finite
            FROM (SELECT *, CASE WHEN rn % 5 = 0 THEN 'NaN'::DOUBLE WHEN rn % 7 = 0 THEN '-Infinity'::DOUBLE ELSE ret END AS odd
                  FROM (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY event_time) - 1 AS ret FROM panel_smooth))"""
    ),
)
def numbers(spark, d):
    from tickloom.functions.scalar import clip
    from tickloom.functions.windows import simple_return

    df = t.panel_smooth(spark, d).withColumn("ret", simple_return())
    odd = F.when(F.col("rn") % 5 == 0, F.lit(float("nan"))).when(F.col("rn") % 7 == 0, F.lit(float("-inf"))).otherwise(F.col("ret"))
    return present(
        df.select(
            "symbol", "session", "ret", F.ln("close").alias("log_close"), F.sqrt("volume").alias("root_volume"),
            clip(F.col("ret"), -0.01, 0.01).alias("clipped"), F.coalesce("ret", F.lit(0.0)).alias("filled"), finite(odd).alias("is_finite"),
        )
    )


@query(
    "f12_json_details",
    "F12",
    oracle(
        """SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum,
           max('{"event_type":"' || event_type || '","k":' || json_extract_string(props, '$.k') || '}') AS sample FROM events GROUP BY 1"""
    ),
)
def details(spark, d):
    parsed = t.load(spark, d, "events").withColumn("p", F.from_json("props", "k INT"))
    text = F.to_json(F.struct("event_type", F.col("p.k").alias("k")))
    return present(parsed.groupBy("event_type").agg(F.sum("p.k").alias("k_sum"), F.max(text).alias("sample")))


__all__ = ["SCHEDULE", "finite", "schedule"]
