"""Queries over stores, feeds, logs, records and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.operators import records
from tickloom.plans import tables as t
from tickloom.plans.registry import query
from tickloom.plans.tables import oracle, present, r, rows
from tickloom.session import shared_folder
from tickloom.sources import bars as store
from tickloom.sources import exchange_files, feeds, merkle
from tickloom.streaming import jobs

STAMP = "'%Y-%m-%d %H:%M:%S'"
DAY = "'%Y-%m-%d'"
AS_OF = "1999-03-01 00:00:00"
_made: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, d: str, name: str, build) -> str:
    """Build a derived table once per application and folder."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _made:
        path = shared_folder(spark, name)
        build(path)
        _made[key] = path
    return _made[key]


# ---- bars and panels ----------------------------------------------------------------


def corrections(spark, d):
    """Revised closes for every tenth bar, as a later batch brings them."""
    panel = t.panel_smooth(spark, d)
    revised = panel.where(F.col("rn") % 10 == 0)
    return revised.withColumns({"close": F.col("close") * 1.0005, "receive_time": F.col("receive_time") + F.expr("INTERVAL 1 DAYS")})


def bar_store(spark, d) -> store.BarStore:
    def build(path):
        made = store.BarStore(spark, path)
        made.write(t.panel_smooth(spark, d), "1d")
        made.write(corrections(spark, d), "1d")

    return store.BarStore(spark, _once(spark, d, "bars", build))


STORED = {
    "stored": """SELECT instrument_id, event_time, receive_time + CASE WHEN rn % 10 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS receive_time,
        open, high, low, close * CASE WHEN rn % 10 = 0 THEN 1.0005 ELSE 1 END AS close, volume, trades, symbol, session FROM panel_smooth""",
}


@query(
    "s1_bar_upsert",
    "S1 S2 S3 U1 U2",
    oracle(
        f"""SELECT instrument_id, strftime(event_time, {STAMP}) AS event_time, {r('close')} AS close, {r('volume', 4)} AS volume FROM stored
            WHERE receive_time <= TIMESTAMP '{AS_OF}' AND event_time >= TIMESTAMP '1994-01-01'""",
        STORED,
    ),
)
def bar_view(spark, d):
    df = bar_store(spark, d).view("1d", as_of=AS_OF, start="1994-01-01 00:00:00")
    return present(df.select("instrument_id", "event_time", "close", "volume"), volume=4)


@query(
    "s4_coverage",
    "S4",
    oracle(
        f"""SELECT instrument_id, strftime(min(event_time), {STAMP}) AS first, strftime(max(event_time), {STAMP}) AS last, count(*) AS bars FROM stored GROUP BY 1""",
        STORED,
    ),
)
def coverage(spark, d):
    return present(bar_store(spark, d).coverage("1d"))


@query("s5_instruments", "S5", oracle("SELECT DISTINCT instrument_id FROM panel_smooth"))
def instruments(spark, d):
    return present(bar_store(spark, d).instruments("1d"))


def panel_store(spark, d) -> store.PanelStore:
    def build(path):
        made = store.PanelStore(spark, path)
        made.write(t.panel_raw(spark, d))
        # one month arrives again with doubled volume and replaces its sessions
        again = t.panel_raw(spark, d).where(F.date_trunc("month", "session") == F.lit("1996-05-01").cast("timestamp"))
        made.write(again.withColumn("volume", F.col("volume") * 2))

    return store.PanelStore(spark, _once(spark, d, "panel", build))


PANELED = {
    "paneled": "SELECT instrument_id, symbol, session, event_time, receive_time, close, volume * CASE WHEN date_trunc('month', session) = DATE '1996-05-01' THEN 2 ELSE 1 END AS volume FROM panel_raw"
}


@query(
    "s6_panel_view",
    "S6 S8 S10",
    oracle(
        f"""SELECT symbol, count(*) AS sessions, {r('sum(volume)', 2)} AS volume, strftime(max(event_time), {STAMP}) AS last FROM paneled
            WHERE receive_time <= TIMESTAMP '{AS_OF}' AND session >= DATE '1995-01-01' GROUP BY symbol""",
        PANELED,
    ),
)
def panel_view(spark, d):
    df = panel_store(spark, d).view(as_of=AS_OF, start="1995-01-01").groupBy("symbol")
    return present(df.agg(F.count(F.lit(1)).alias("sessions"), F.sum("volume").alias("volume"), F.max("event_time").alias("last")), 2)


@query("s7_sessions", "S7", oracle(f"SELECT DISTINCT strftime(session, {DAY}) AS session_date FROM panel_raw"))
def sessions(spark, d):
    return present(panel_store(spark, d).sessions())


@query(
    "s9_session_view",
    "S9",
    oracle(f"SELECT symbol, {r('close')} AS close, {r('volume', 2)} AS volume FROM paneled WHERE session = DATE '1996-05-15'", PANELED),
)
def session_view(spark, d):
    df = panel_store(spark, d).session_view("1996-05-15", as_of=AS_OF)
    return present(df.select("symbol", "close", "volume"), volume=2)


# ---- feeds ---------------------------------------------------------------------------


def bhavcopy_folder(spark, d) -> str:
    """The panel as monthly files, older years in the legacy layout."""

    def build(path):
        panel = t.panel_raw(spark, d)
        c = F.col
        text = {k: F.format_string("%.4f", c(k)) for k in ("open", "high", "low", "close")}
        series = F.when(c("trades") > 1, " BE ").otherwise(" EQ ")
        base = panel.withColumns(text | {"series": series, "isin": F.element_at(F.split("instrument_id", ":"), -1), "day": F.date_format("session", "yyyy-MM-dd")})
        month = F.date_format("session", "yyyyMM")
        for layout, years, date_column in ((feeds.LAYOUTS[0], c("session") < "1997-01-01", "TIMESTAMP"), (feeds.LAYOUTS[1], c("session") >= "1997-01-01", "TradDt")):
            cols = [c(k).alias(layout[k]) for k in ("symbol", "series", "open", "high", "low", "close")]
            cols += [c("volume").cast("bigint").alias(layout["volume"]), c("amount").alias(layout["value"])]
            cols += [c("trades").alias(layout["trades"]), c("isin").alias(layout["isin"]), c("day").alias(date_column)]
            out = base.where(years).select(*cols, month.alias("month"))
            out.repartition("month").write.mode("append").partitionBy("month").option("header", "true").csv(path)

    return _once(spark, d, "bhavcopy", build)


@query(
    "s11_bhavcopy",
    "S11 S13 F1",
    oracle(
        f"""SELECT 'NSE:' || split_part(instrument_id, ':', 2) AS instrument_id, symbol, strftime(event_time, {STAMP}) AS event_time, strftime(receive_time, {STAMP}) AS receive_time,
            {r('round(close, 4)', 3)} AS close, {r('volume', 2)} AS volume, trades FROM panel_raw WHERE trades = 1"""
    ),
)
def bhavcopy(spark, d):
    raw = feeds.read_bhavcopy(spark, bhavcopy_folder(spark, d), by_row_day=True)
    df = feeds.bhavcopy_bars(raw)
    return present(df.select("instrument_id", "symbol", "event_time", "receive_time", "close", "volume", "trades"), 3)


@query(
    "s12_file_dates",
    "S12 S14",
    oracle(
        f"""SELECT status, count(*) AS files FROM (SELECT CASE WHEN year(day) < 1996 THEN 'skipped' WHEN day_no % 11 = 0 THEN 'failed' ELSE 'ok' END AS status
            FROM (SELECT CAST(o_orderdate AS DATE) AS day, day(CAST(o_orderdate AS DATE)) AS day_no FROM orders GROUP BY 1, 2)) GROUP BY 1"""
    ),
)
def file_dates(spark, d):
    days = t.load(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    iso = F.concat(F.lit("bhav_"), F.date_format("day", "yyyyMMdd"), F.lit(".csv"))
    spelled = F.concat(F.lit("cm"), F.upper(F.date_format("day", "ddMMMyyyy")), F.lit("bhav.csv.zip"))
    files = days.select("day", F.when(F.month("day") % 2 == 0, iso).otherwise(spelled).alias("path"))
    named = files.select("path", feeds.date_from_name(F.col("path")).alias("session"))
    stored = days.where(F.year("day") < 1996).select(F.col("day").alias("session_date"))
    failed = named.where((F.dayofmonth("session") % 11 == 0) & (F.year("session") >= 1996))
    return present(feeds.ingest_status(named, stored, failed))


@query(
    "s14_pending_files",
    "S14",
    oracle(
        f"SELECT DISTINCT strftime(CAST(o_orderdate AS DATE), {DAY}) AS session FROM orders WHERE CAST(o_orderdate AS DATE) NOT IN (SELECT session FROM panel_raw)"
    ),
)
def pending(spark, d):
    files = t.load(spark, d, "orders").select(F.to_date("o_orderdate").alias("session")).distinct()
    return present(feeds.pending_files(files, t.panel_raw(spark, d).select(F.col("session").alias("session_date")).distinct()))


def daily_folder(spark, d) -> str:
    """The panel as one file a session: even months plain, odd months in the legacy layout and zipped, some days broken."""
    t_ = {"open": "%.4f", "high": "%.4f", "low": "%.4f", "close": "%.4f"}

    def build(path):
        session = F.col("session")
        odd = F.month("session") % 2 == 1
        plain = F.concat(F.lit("bhav_"), F.date_format("session", "yyyyMMdd"), F.lit(".csv"))
        zipped = F.concat(F.lit("cm"), F.upper(F.date_format("session", "ddMMMyyyy")), F.lit("bhav.csv.zip"))
        rows_ = t.panel_raw(spark, d).select(
            F.when(odd, zipped).otherwise(plain).alias("file"), (F.dayofmonth(session) % 11 == 0).alias("broken"), "symbol",
            F.when(F.col("trades") > 1, " BE ").otherwise(" EQ ").alias("series"), *[F.format_string(f, c).alias(c) for c, f in t_.items()],
            F.col("volume").cast("bigint").cast("string").alias("volume"), F.col("amount").cast("string").alias("value"),
            F.col("trades").cast("string").alias("trades"), F.element_at(F.split("instrument_id", ":"), -1).alias("isin"),
        )
        exchange_files.write_daily_files(rows_, path).count()

    return _once(spark, d, "daily-files", build)


@query(
    "s14_ingest_folder",
    "S11 S12 S14",
    oracle(
        f"""SELECT strftime(session, {DAY}) AS session, CASE WHEN y < 1993 THEN 'skipped' WHEN broken THEN 'failed' WHEN eq = 0 THEN 'empty' ELSE 'ok' END AS status,
            CASE WHEN y < 1993 OR broken THEN 0 ELSE eq END AS bars, {r('CASE WHEN y < 1993 THEN volume WHEN NOT broken THEN eq_volume END', 2)} AS stored
            FROM (SELECT session, year(session) AS y, day(session) % 11 = 0 AS broken, CAST(count(*) FILTER (trades = 1) AS BIGINT) AS eq, sum(volume) AS volume,
                  sum(volume) FILTER (trades = 1) AS eq_volume FROM panel_raw GROUP BY session)"""
    ),
)
def ingest_folder(spark, d):
    made = store.PanelStore(spark, shared_folder(spark, "ingested"))
    made.write(t.panel_raw(spark, d).where(F.year("session") < 1993))
    outcomes = exchange_files.ingest_folder(made, daily_folder(spark, d))
    stored = made.view(as_of="2100-01-01").groupBy(F.to_date("event_time").alias("session")).agg(F.sum("volume").alias("stored"))
    return present(outcomes.join(stored, "session", "left").select("session", "status", "bars", "stored"), 2)


VENDOR = {
    "vendor": """SELECT instrument_id, date_trunc('hour', event_time) AS bar_open, min_by(price, sequence) AS open, max(price) AS high, min(price) AS low,
        max_by(price, sequence) AS close, CAST(count(*) AS DOUBLE) AS volume, count(*) AS trades, min(sequence) AS seq FROM ticks GROUP BY 1, 2"""
}
HORIZON = "2024-01-28 12:00:00"


@query(
    "s15_vendor_bars",
    "S15",
    oracle(
        f"""SELECT instrument_id, strftime(event_time, {STAMP}) AS event_time, strftime(event_time + INTERVAL 1 MINUTE, {STAMP}) AS receive_time, {r('open')} AS open, {r('close')} AS close, trades
        FROM (SELECT *, coalesce(lead(bar_open) OVER (PARTITION BY instrument_id ORDER BY bar_open), bar_open + INTERVAL 1 MINUTE) AS event_time FROM vendor)
        WHERE event_time <= TIMESTAMP '{HORIZON}'""",
        VENDOR,
    ),
)
def vendor_bars(spark, d):
    ticks = t.ticks(spark, d)
    hourly = ticks.groupBy("instrument_id", F.date_trunc("hour", "event_time").alias("bar_open")).agg(
        F.min_by("price", "sequence").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "sequence").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"),
        F.count(F.lit(1)).alias("trades"), F.min("sequence").alias("seq"),
    )
    df = feeds.vendor_bars(hourly, HORIZON)
    return present(df.select("instrument_id", "event_time", "receive_time", "open", "close", "trades"))


@query(
    "s16_fill_log",
    "S16 T3",
    oracle(
        f"""SELECT account, count(*) AS fills, {r('sum(CAST(price AS DOUBLE) * CAST(quantity AS DOUBLE))', 2)} AS value, strftime(max(session), {DAY}) AS last FROM fills GROUP BY account"""
    ),
)
def fill_log(spark, d):
    def build(path):
        rows_ = t.fills(spark, d).select("account", "instrument", "side", F.col("quantity").cast("string"), F.col("price").cast("string"), F.date_format("session", "yyyy-MM-dd").alias("at"))
        feeds.append_log(rows_.where("side = 'BUY'"), path)
        feeds.append_log(rows_.where("side = 'SELL'"), path)
        # a torn line, as a crash leaves it
        t.load(spark, d, "region").limit(1).select(F.lit('{"account": 1, "instru').alias("value")).write.mode("append").text(path)

    schema = "account bigint, instrument bigint, side string, quantity string, price string, at string"
    df = feeds.read_log(spark, _once(spark, d, "fill-log", build), schema)
    value = F.col("price").cast("double") * F.col("quantity").cast("double")
    return present(df.groupBy("account").agg(F.count(F.lit(1)).alias("fills"), F.sum(value).alias("value"), F.max("at").alias("last")), 2)


@query("s17_dataset_version", "S17 F13")
def version(spark, d):
    return present(feeds.dataset_version(feeds.file_digests(spark, d)))


@query(
    "s17_changed_files",
    "S17 U4",
    oracle(
        """SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change
        FROM (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS digest FROM documents WHERE lang <> 'fr' OR lang IS NULL) a
        FULL JOIN (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(CASE WHEN n_chars % 7 = 0 THEN text || '.' ELSE text END) AS digest FROM documents WHERE source <> (SELECT min(source) FROM documents)) b
          ON a.path = b.path WHERE a.digest IS DISTINCT FROM b.digest"""
    ),
)
def changed(spark, d):
    docs = t.load(spark, d, "documents")
    path = F.col("doc_id").cast("string").alias("path")
    lowest = docs.agg(F.min("source"))
    before = docs.where((F.col("lang") != "fr") | F.col("lang").isNull()).select(path, F.sha2("text", 256).alias("digest"))
    text = F.when(F.col("n_chars") % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    after = docs.where(F.col("source") != lowest.scalar()).select(path, F.sha2(text, 256).alias("digest"))
    return present(feeds.changed_files(before, after))


_MAPS = {
    "map_before": "SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS digest FROM documents WHERE lang <> 'fr' OR lang IS NULL",
    "map_after": """SELECT CAST(doc_id AS VARCHAR) AS path, sha256(CASE WHEN n_chars % 7 = 0 THEN text || '.' ELSE text END) AS digest
        FROM documents WHERE source <> (SELECT min(source) FROM documents)""",
}


def _maps(spark, d):
    docs = t.load(spark, d, "documents")
    path = F.col("doc_id").cast("string").alias("path")
    before = docs.where((F.col("lang") != "fr") | F.col("lang").isNull()).select(path, F.sha2("text", 256).alias("digest"))
    text = F.when(F.col("n_chars") % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    after = docs.where(F.col("source") != docs.agg(F.min("source")).scalar()).select(path, F.sha2(text, 256).alias("digest"))
    return before, after


def _tree(spark, d, name):
    def build(path):
        merkle.write_tree(_maps(spark, d)[name == "after"], path, MERKLE_DEPTH)

    return merkle.read_tree(spark, _once(spark, d, f"merkle-{name}", build))


MERKLE_DEPTH = 3


def _merkle_ctes(source: str) -> dict[str, str]:
    entry = "path || chr(1) || coalesce(digest, '')"
    out = {
        "level3": f"SELECT substr(sha256(path), 1, 3) AS node, sha256(string_agg({entry}, chr(2) ORDER BY path COLLATE \"C\", digest)) AS digest, count(*) AS entries FROM {source} GROUP BY 1"
    }
    for level in (2, 1, 0):
        out[f"level{level}"] = (
            f"SELECT substr(node, 1, {level}) AS node, sha256(string_agg(node || chr(1) || digest, chr(2) ORDER BY node)) AS digest, "
            f"CAST(sum(entries) AS BIGINT) AS entries FROM level{level + 1} GROUP BY 1"
        )
    return out


@query(
    "s17_merkle_tree",
    "S17 F13",
    oracle(
        "SELECT * FROM (" + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS level, node, digest, entries FROM level{i}" for i in range(4)) + ")",
        {**_MAPS, **dict(reversed(_merkle_ctes("map_before").items()))},
    ),
)
def merkle_tree(spark, d):
    return present(_tree(spark, d, "before").select("level", "node", "digest", "entries"))


@query(
    "s17_merkle_changes",
    "S17 U4",
    oracle(
        """SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change
           FROM map_before a FULL JOIN map_after b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.digest IS DISTINCT FROM b.digest""",
        _MAPS,
    ),
)
def merkle_changes(spark, d):
    before, after = _maps(spark, d)
    return present(merkle.changes(before, after, _tree(spark, d, "before"), _tree(spark, d, "after"), MERKLE_DEPTH))


@query(
    "s17_sampled_fingerprint",
    "S17 T4",
    oracle(
        """SELECT any_value(n) AS rows, count(*) AS sampled,
            sha256(string_agg(strftime(event_time, '%Y-%m-%d %H:%M:%S') || '|' || instrument_id || '|' || CAST(CAST(round(close * 1e6) AS BIGINT) AS VARCHAR), chr(10) ORDER BY i)) AS content_hash
        FROM (SELECT *, row_number() OVER (ORDER BY event_time, instrument_id) - 1 AS i, count(*) OVER () AS n FROM panel_smooth) WHERE i % greatest(1, n // 2000) = 0"""
    ),
)
def fingerprint(spark, d):
    return present(feeds.sampled_fingerprint(t.panel_smooth(spark, d), 2000, rows(spark, d)))


# ---- records -------------------------------------------------------------------------

RECORDS = {
    "hypotheses": """SELECT c_custkey AS hypothesis_id, CASE WHEN c_custkey % 41 = 0 THEN ' ' ELSE c_name END AS statement, repeat(c_name || ' ', 3 + c_custkey % 5) AS economic_mechanism,
        DATE '1992-01-01' AS dev_start, DATE '1996-01-01' AS dev_end, CASE WHEN c_custkey % 17 = 0 THEN DATE '1995-06-01' ELSE DATE '1996-01-01' END AS val_start,
        DATE '1999-01-01' AS val_end, DATE '1999-01-01' AS test_start, DATE '2003-01-01' AS test_end FROM customer""",
    "experiments": """SELECT o_orderkey AS experiment_id, o_custkey AS hypothesis_id, 'S' || CAST(o_custkey % 40 AS VARCHAR) AS strategy_id, CAST(o_orderdate AS DATE) AS day, o_orderdate AS created_at,
        CASE o_orderstatus WHEN 'P' THEN 'DEVELOPMENT' WHEN 'F' THEN 'VALIDATION' ELSE 'LOCKED_TEST' END AS period FROM orders""",
    "access": "SELECT strategy_id, experiment_id FROM experiments WHERE period = 'LOCKED_TEST' AND experiment_id % 3 = 0",
    "judged": """SELECT *, CASE WHEN length(trim(economic_mechanism)) < 80 THEN 'mechanism_too_thin' WHEN trim(statement) = '' THEN 'empty_statement'
        WHEN NOT (dev_start < dev_end AND dev_end <= val_start AND val_start < val_end AND val_end <= test_start AND test_start < test_end) THEN 'periods_not_ordered' END AS violation FROM hypotheses""",
}


def hypotheses(spark, d) -> DataFrame:
    c = F.col
    k = c("c_custkey")
    day = lambda text: F.lit(text).cast("date")
    return t.load(spark, d, "customer").select(
        k.alias("hypothesis_id"),
        F.when(k % 41 == 0, " ").otherwise(c("c_name")).alias("statement"),
        F.repeat(F.concat("c_name", F.lit(" ")), (3 + k % 5).cast("int")).alias("economic_mechanism"),
        day("1992-01-01").alias("dev_start"), day("1996-01-01").alias("dev_end"),
        F.when(k % 17 == 0, day("1995-06-01")).otherwise(day("1996-01-01")).alias("val_start"),
        day("1999-01-01").alias("val_end"), day("1999-01-01").alias("test_start"), day("2003-01-01").alias("test_end"),
    )


def experiments(spark, d) -> DataFrame:
    status = F.col("o_orderstatus")
    return t.load(spark, d, "orders").select(
        F.col("o_orderkey").alias("experiment_id"),
        F.col("o_custkey").alias("hypothesis_id"),
        F.concat(F.lit("S"), (F.col("o_custkey") % 40).cast("string")).alias("strategy_id"),
        F.to_date("o_orderdate").alias("day"),
        F.col("o_orderdate").alias("created_at"),
        F.when(status == "P", "DEVELOPMENT").when(status == "F", "VALIDATION").otherwise("LOCKED_TEST").alias("period"),
    )


def access(spark, d) -> DataFrame:
    df = experiments(spark, d).where((F.col("period") == "LOCKED_TEST") & (F.col("experiment_id") % 3 == 0))
    return df.select("strategy_id", "experiment_id")


@query("e1_hypothesis_checks", "E1", oracle("SELECT hypothesis_id, coalesce(violation, 'sound') AS violation FROM judged", RECORDS))
def hypothesis_checks(spark, d):
    df = records.hypothesis_violations(hypotheses(spark, d))
    return present(df.select("hypothesis_id", F.coalesce("violation", F.lit("sound")).alias("violation")))


@query(
    "e2_period_mismatches",
    "E2",
    oracle(
        """SELECT experiment_id, period, coalesce(actual, 'none') AS actual FROM (SELECT *, CASE WHEN day >= test_start AND day < test_end THEN 'LOCKED_TEST'
            WHEN day >= val_start AND day < val_end THEN 'VALIDATION' WHEN day >= dev_start AND day < dev_end THEN 'DEVELOPMENT' END AS actual
            FROM experiments JOIN hypotheses USING (hypothesis_id)) WHERE actual IS DISTINCT FROM period""",
        RECORDS,
    ),
)
def mismatches(spark, d):
    df = records.period_mismatches(experiments(spark, d), hypotheses(spark, d), "day")
    return present(df.select("experiment_id", "period", F.coalesce("actual", F.lit("none")).alias("actual")))


@query("e3_trial_counts", "E3", oracle("SELECT hypothesis_id, count(*) AS n_trials FROM experiments GROUP BY 1", RECORDS))
def trials(spark, d):
    return present(records.trial_counts(experiments(spark, d)))


@query(
    "e4_repeated_locked_tests",
    "E4",
    oracle("SELECT strategy_id, count(*) AS accesses FROM access GROUP BY 1 HAVING count(*) > 1", RECORDS),
)
def repeated(spark, d):
    return present(records.repeated_locked_tests(access(spark, d)))


@query(
    "j12_locked_test_leaks",
    "J12 E4",
    oracle(
        f"SELECT experiment_id, strftime(created_at, {STAMP}) AS created_at FROM experiments WHERE period = 'LOCKED_TEST' AND experiment_id NOT IN (SELECT experiment_id FROM access)",
        RECORDS,
    ),
)
def leaks(spark, d):
    return present(records.locked_test_leaks(experiments(spark, d), access(spark, d)))


@query(
    "e5_idempotent_insert",
    "E5 U1",
    oracle(
        """SELECT strategy_id, min(experiment_id) AS experiment_id FROM experiments WHERE day < DATE '1996-01-01' GROUP BY 1
           UNION ALL SELECT period || strategy_id, min_by(experiment_id, (day, experiment_id)) FROM experiments WHERE day >= DATE '1996-01-01' GROUP BY 1""",
        RECORDS,
    ),
)
def idempotent(spark, d):
    e = experiments(spark, d)
    early = F.col("day") < "1996-01-01"
    existing = e.where(early).groupBy("strategy_id").agg(F.min("experiment_id").alias("experiment_id"))
    order = F.struct("day", "experiment_id").alias("o")
    late = e.where(~early).select(F.concat("period", "strategy_id").alias("strategy_id"), "experiment_id", order)
    repeated_ = existing.select("strategy_id", "experiment_id", F.struct(F.lit("1990-01-01").cast("date").alias("day"), "experiment_id").alias("o"))
    joined = records.insert_new(existing.withColumn("o", F.struct(F.lit(None).cast("date").alias("day"), "experiment_id")), late.unionByName(repeated_), ["strategy_id"], "o")
    return present(joined.select("strategy_id", "experiment_id"))


@query(
    "e5_latest_results",
    "E5",
    oracle(
        f"""SELECT experiment_id, test_name, strftime(max(run_at), {STAMP}) AS run_at FROM (SELECT l_orderkey AS experiment_id, 't' || CAST(l_linenumber AS VARCHAR) AS test_name, l_shipdate AS run_at FROM lineitem) GROUP BY 1, 2"""
    ),
)
def latest_results(spark, d):
    li = t.load(spark, d, "lineitem")
    results = li.select(F.col("l_orderkey").alias("experiment_id"), F.concat(F.lit("t"), F.col("l_linenumber").cast("string")).alias("test_name"), F.col("l_shipdate").alias("run_at"))
    return present(records.latest_results(results))


@query(
    "e6_metric_checks",
    "E6",
    oracle(
        """SELECT coalesce(CASE WHEN l_discount - 0.09 > 0 THEN 'drawdown_positive' WHEN l_tax - 0.005 < 0 THEN 'volatility_negative' WHEN l_quantity - 2 < 0 THEN 'turnover_negative'
            WHEN NOT (l_quantity / 49 BETWEEN 0 AND 1) THEN 'hit_rate_out_of_range' END, 'sound') AS violation, count(*) AS n FROM lineitem GROUP BY 1"""
    ),
)
def metric_checks(spark, d):
    c = F.col
    metrics = t.load(spark, d, "lineitem").select(
        (c("l_discount") - 0.09).alias("max_drawdown"), (c("l_tax") - 0.005).alias("volatility"), (c("l_quantity") - 2).alias("turnover"),
        (c("l_quantity") / 49).alias("hit_rate"), c("l_linenumber").alias("n_trades"),
    )
    df = records.metric_violations(metrics)
    return present(df.groupBy(F.coalesce("violation", F.lit("sound")).alias("violation")).agg(F.count(F.lit(1)).alias("n")))


@query(
    "e6_rejections",
    "E6",
    oracle("SELECT o_orderpriority AS killed_at_stage, count(*) AS rejections, count(DISTINCT o_custkey) AS hypotheses FROM orders GROUP BY 1"),
)
def rejections(spark, d):
    df = t.load(spark, d, "orders").select(F.col("o_orderpriority").alias("killed_at_stage"), F.col("o_custkey").alias("hypothesis_id"))
    return present(records.rejections_by_stage(df))


@query(
    "e6_resolved_hypotheses",
    "E6",
    oracle(
        f"""SELECT c_custkey AS hypothesis_id, coalesce(max_by(CASE WHEN o_orderstatus = 'F' THEN 'REJECTED' WHEN o_orderstatus = 'O' THEN 'CONFIRMED' END, (o_orderdate, o_orderkey)), 'OPEN') AS status,
            strftime(max(o_orderdate), {DAY}) AS resolved_at FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus <> 'P' GROUP BY 1"""
    ),
)
def resolved(spark, d):
    orders = t.load(spark, d, "orders").where("o_orderstatus <> 'P'")
    last = orders.groupBy(F.col("o_custkey").alias("hypothesis_id")).agg(F.max_by(F.struct("o_orderstatus", "o_orderdate"), F.struct("o_orderdate", "o_orderkey")).alias("l"))
    decisions = last.select("hypothesis_id", F.when(F.col("l.o_orderstatus") == "F", "REJECTED").otherwise("CONFIRMED").alias("status"), F.to_date("l.o_orderdate").alias("resolved_at"))
    base = hypotheses(spark, d).select("hypothesis_id", F.lit("OPEN").alias("status"), F.lit(None).cast("date").alias("resolved_at"))
    return present(records.resolve(base, decisions))


@query(
    "e7_fingerprints",
    "E7 F12",
    oracle(
        """SELECT experiment_id, sha256('{"hypothesis_id":' || hypothesis_id || ',"period":"' || period || '","strategy_id":"' || strategy_id || '"}') AS fingerprint FROM experiments""",
        RECORDS,
    ),
)
def fingerprints(spark, d):
    df = experiments(spark, d)
    return present(df.select("experiment_id", records.fingerprint(["strategy_id", "period", "hypothesis_id"]).alias("fingerprint")))


@query(
    "e8_observed_sessions",
    "E8",
    oracle(f"SELECT split_part(instrument_id, ':', 1) AS exchange, strftime(session, {DAY}) AS session, count(DISTINCT instrument_id) AS instruments FROM panel_raw GROUP BY 1, 2"),
)
def observed(spark, d):
    return present(records.observed_sessions(t.panel_raw(spark, d)))


@query(
    "e8_open_incidents",
    "E8",
    oracle(f"SELECT event_id, user_id, strftime(ts, {STAMP}) AS opened_at FROM events WHERE event_type = 'error' AND event_id % 4 <> 0"),
)
def incidents(spark, d):
    e = t.load(spark, d, "events").where("event_type = 'error'")
    log = e.select("event_id", "user_id", F.col("ts").alias("opened_at"), F.when(F.col("event_id") % 4 == 0, F.col("ts")).alias("resolved_at"))
    return present(records.open_incidents(log, "event_id").drop("resolved_at"))


@query(
    "e8_audit_trail",
    "E8",
    oracle(f"SELECT user_id, count(*) AS entries, strftime(max(ts), {STAMP}) AS latest FROM events GROUP BY user_id"),
)
def audit(spark, d):
    return present(records.audit_trail(t.load(spark, d, "events").withColumnRenamed("ts", "at"), "user_id"))


# ---- streams -------------------------------------------------------------------------


def tick_stream(spark: SparkSession, d: str, files: int = 1000) -> DataFrame:
    """``events`` as a stream of ticks, split into files by day."""

    def build(path):
        day = F.date_format("event_time", "yyyy-MM-dd")
        ticks = t.ticks(spark, d).withColumn("size", (F.col("sequence") % 50 + 1).cast("double"))
        ticks.repartitionByRange(12, "event_time").sortWithinPartitions("event_time").withColumn("day", day).drop("props", "event_type").write.parquet(path)

    path = _once(spark, d, "tick-files", build)
    return jobs.file_stream(spark, path, spark.read.parquet(path).schema, files=files)


def streamed(spark, d, name, build) -> DataFrame:
    out, state = shared_folder(spark, name), shared_folder(spark, f"{name}-state")
    return jobs.run_to_table(build, out, state)


@query(
    "st2_tick_bars",
    "ST2 S3",
    oracle(
        f"""SELECT instrument_id, strftime(e, {STAMP}) AS event_time, {r('open')} AS open, {r('high')} AS high, {r('low')} AS low, {r('close')} AS close, {r('volume', 2)} AS volume, trades
        FROM (SELECT instrument_id, time_bucket(INTERVAL 4 HOUR, event_time, TIMESTAMP '1970-01-01') + INTERVAL 4 HOUR AS e, min_by(price, sequence) AS open, max(price) AS high, min(price) AS low,
              max_by(price, sequence) AS close, sum(CAST(sequence % 50 + 1 AS DOUBLE)) AS volume, count(*) AS trades FROM ticks GROUP BY 1, 2)
        WHERE e <= (SELECT max(event_time) - INTERVAL 10 MINUTE FROM ticks)"""
    ),
)
def tick_bars(spark, d):
    df = streamed(spark, d, "tick-bars", jobs.tick_bars(tick_stream(spark, d), "4h"))
    return present(df.drop("receive_time"), volume=2)


@query(
    "st3_time_gaps",
    "ST3",
    oracle(
        f"""SELECT instrument_id, prev AS previous_sequence, sequence, sequence - prev - 1 AS missing, {r("gap", 1)} AS gap_seconds FROM (
            SELECT instrument_id, sequence, lag(sequence) OVER w AS prev, epoch(event_time) - epoch(lag(event_time) OVER w) AS gap FROM ticks
            WINDOW w AS (PARTITION BY instrument_id ORDER BY sequence)) WHERE gap > 86400"""
    ),
)
def time_gaps(spark, d):
    stream = jobs.sequence_gaps(tick_stream(spark, d), 86400.0, step=None)
    return present(streamed(spark, d, "gaps", stream), 1)


@query(
    "st3_sequence_gaps",
    "ST3",
    oracle(
        f"""SELECT instrument_id, prev AS previous_sequence, own AS sequence, own - prev - 1 AS missing, {r("gap", 1)} AS gap_seconds FROM (
            SELECT instrument_id, own, lag(own) OVER w AS prev, epoch(event_time) - epoch(lag(event_time) OVER w) AS gap
            FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY sequence) AS own FROM ticks) WHERE own % 7 <> 0
            WINDOW w AS (PARTITION BY instrument_id ORDER BY own)) WHERE own - prev <> 1"""
    ),
)
def own_gaps(spark, d):
    def build(path):
        # numbered per instrument, with every seventh tick lost
        own = F.row_number().over(W.partitionBy("instrument_id").orderBy("sequence"))
        ticks = t.ticks(spark, d).withColumn("sequence", own.cast("long")).where("sequence % 7 <> 0")
        ticks.repartitionByRange(12, "event_time").drop("props", "event_type").write.parquet(path)

    path = _once(spark, d, "own-tick-files", build)
    ticks = jobs.file_stream(spark, path, spark.read.parquet(path).schema)
    return present(streamed(spark, d, "own-gaps", jobs.sequence_gaps(ticks, 1e18)), 1)


@query(
    "st4_stream_alerts",
    "ST4 RK9 RK3",
    oracle(
        f"""SELECT * FROM (WITH p AS (SELECT *, max(price) OVER (PARTITION BY instrument_id ORDER BY sequence) AS peak,
                coalesce(max(price) OVER (PARTITION BY instrument_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ticks),
            e AS (SELECT *, sum(CASE WHEN price >= before THEN 1 ELSE 0 END) OVER (PARTITION BY instrument_id ORDER BY sequence) AS episode,
                CASE WHEN peak > 0 THEN CAST(price AS DOUBLE) / peak - 1 ELSE 0.0::DOUBLE END AS fall FROM p),
            g AS (SELECT *, CAST(fall <= -0.05 AS INT) + CAST(fall <= -0.08 AS INT) + CAST(fall <= -0.10 AS INT) AS reached FROM e),
            b AS (SELECT *, coalesce(max(reached) OVER (PARTITION BY instrument_id, episode ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rung FROM g),
            s AS (SELECT instrument_id, max(event_time) AS seen FROM ticks GROUP BY 1)
        SELECT instrument_id, 'drawdown_rung' AS kind, strftime(event_time, {STAMP}) AS at, {r("fall", 6)} AS value FROM b WHERE reached > rung
        UNION ALL SELECT instrument_id, 'data_stale', strftime(seen, {STAMP}), 86400.0::DOUBLE FROM s
        WHERE seen + INTERVAL 1 DAY < (SELECT max(event_time) - INTERVAL 10 MINUTE FROM ticks))"""
    ),
)
def stream_alerts(spark, d):
    stream = jobs.stream_alerts(tick_stream(spark, d), 86400)
    return present(streamed(spark, d, "alerts", stream), 6)


#: Days that a bar may lie behind the newest one of earlier files.
LATE_DAYS = 60
#: Files of one trigger: what has come is one batch.
ALL_FILES = 2**31 - 1


@query(
    "st1_bar_ingest",
    "ST1 S1 S2 P13",
    oracle(
        f"""SELECT * FROM (WITH b AS (SELECT *, CAST(least((year(event_time) - 1992) // 2, 3) AS INT) AS p FROM dirty_base),
            v AS (SELECT instrument_id, event_time, receive_time, open, high, low, close, CASE WHEN rn % 61 = 0 THEN 3 ELSE p END AS f FROM b
                UNION ALL SELECT instrument_id, event_time, receive_time, open, high, low, close, p + 1 FROM b
                    WHERE rn % 61 <> 0 AND p < 3 AND year(event_time) % 2 = 1 AND month(event_time) = 12 AND day(event_time) > 16
                UNION ALL SELECT instrument_id, event_time, receive_time + INTERVAL 1 DAY, open, high, low, high, p FROM b WHERE rn % 97 = 0
                UNION ALL SELECT instrument_id, event_time, receive_time + INTERVAL 2 DAY, open, high, abs(low), close, p FROM b WHERE rn % 131 = 0),
            ok AS (SELECT * FROM v WHERE NOT (receive_time < event_time OR least(open, high, low, close) <= 0 OR high < low OR open > high OR open < low OR close > high OR close < low)),
            n AS (SELECT instrument_id, max(event_time) AS newest FROM ok WHERE f < 3 GROUP BY 1),
            j AS (SELECT ok.*, f = 3 AND coalesce(event_time < newest - INTERVAL {LATE_DAYS} DAY, false) AS late FROM ok LEFT JOIN n USING (instrument_id)),
            k AS (SELECT * FROM j WHERE NOT late QUALIFY row_number() OVER (PARTITION BY instrument_id, event_time ORDER BY receive_time DESC, close DESC) = 1)
        SELECT instrument_id, count(*) AS bars, {r('sum(close)', 4)} AS close_sum, strftime(max(event_time), {STAMP}) AS last,
            coalesce(any_value(l.late), 0) AS late FROM k LEFT JOIN (SELECT instrument_id, count(*) AS late FROM j WHERE late GROUP BY 1) l USING (instrument_id) GROUP BY 1)"""
    ),
)
def bar_ingest(spark, d):
    def build(path):
        c = F.col
        period = F.least(F.floor((F.year("event_time") - 1992) / 2), F.lit(3))
        held = c("rn") % 61 == 0
        ended = (F.year("event_time") % 2 == 1) & (F.month("event_time") == 12) & (F.dayofmonth("event_time") > 16)
        # a bar's first coming, the same again a file later, a revision and a mended one: copies of one row, the panel is made once
        copies = [F.lit(0), F.when(~held & ended & (period < 3), 1), F.when(c("rn") % 97 == 0, 2), F.when(c("rn") % 131 == 0, 3)]
        bars = t.dirty_base(spark, d).withColumns({"trades": F.lit(1).cast("bigint"), "copy": F.explode(F.array_compact(F.array(*copies)))})
        late = F.when(c("copy") >= 2, c("copy") - 1).otherwise(0)
        every = bars.withColumns(
            {
                "file": F.when((c("copy") == 0) & held, 3).when(c("copy") == 1, period + 1).otherwise(period),
                "receive_time": c("receive_time") + F.make_dt_interval(days=late),
                "close": F.when(c("copy") == 2, c("high")).otherwise(c("close")),
                "low": F.when(c("copy") == 3, F.abs("low")).otherwise(c("low")),
            }
        )
        every.drop("copy").write.partitionBy("file").parquet(path)

    source = _once(spark, d, "bar-files", build)
    made = store.BarStore(spark, shared_folder(spark, "ingested"))
    aside, arrived, state = (shared_folder(spark, name) for name in ("quarantine", "arrived", "ingest-state"))
    # two years come at a time, in order: the last also brings bars that were held back, each the end of the one before
    for k in range(4):
        come = spark.read.parquet(source).where(F.col("file") == k).drop("file")
        come.write.mode("append").parquet(arrived)
        stream = jobs.file_stream(spark, arrived, come.schema, files=ALL_FILES)
        jobs.ingest_bars(stream, made, "1d", aside, state, LATE_DAYS * 86400.0).awaitTermination()
    late = spark.read.parquet(aside).where("violation = 'late'").groupBy("instrument_id").agg(F.count(F.lit(1)).alias("late"))
    bars = made.view("1d", as_of="2100-01-01 00:00:00").groupBy("instrument_id")
    df = bars.agg(F.count(F.lit(1)).alias("bars"), F.sum("close").alias("close_sum"), F.max("event_time").alias("last"))
    return present(df.join(late, "instrument_id", "left").withColumn("late", F.coalesce("late", F.lit(0).cast("bigint"))), 4)
