"""The routes that split large groups give exactly what the plain ones give."""

import random

from pyspark.sql import functions as F

from tickloom.functions.chunks import with_previous, with_running_sum
from tickloom.functions.ranks import with_average_ranks, with_ordinal_rank
from tickloom.operators import ledger, quality, scoring
from tickloom.session import checkpointed
from tickloom.operators.composite import complete_rows, factor_correlations, ic_weights, orthogonalise, zscore_by_session


def _skewed(spark, n=4000, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        session = 0 if rng.random() < 0.5 else rng.randrange(1, 6)
        value = 0.0 if rng.random() < 0.4 else rng.choice([rng.gauss(0, 1), float(rng.randrange(5))])
        rows.append((session, f"N{i:06d}", value))
    return spark.createDataFrame(rows, "event_time int, symbol string, signal double")


def test_average_rank_routes_agree(spark):
    df = _skewed(spark)
    plain = with_average_ranks(df, {"r": "signal"}, ["event_time"], 10_000)
    split = with_average_ranks(df, {"r": "signal"}, ["event_time"], None)
    assert plain.exceptAll(split.select(plain.columns)).count() == 0
    assert split.count() == df.count()


def test_many_columns_are_ranked_in_one_pass(spark):
    df = _skewed(spark, 1500).withColumns({f"c{i}": F.when(F.rand(i) > 0.1, F.round(F.randn(i), 1)) for i in range(6)})
    columns = {f"r{i}": f"c{i}" for i in range(6)}
    df = checkpointed(df)  # the draws are made once
    split = with_average_ranks(df, columns, ["event_time"], None)
    for out, col in columns.items():
        there = df.where(F.col(col).isNotNull())
        plain = with_average_ranks(there, {out: col}, ["event_time"], 10_000).select("event_time", "symbol", out)
        assert plain.exceptAll(split.where(F.col(col).isNotNull()).select(plain.columns)).count() == 0
    one = with_average_ranks(df, {"r0": "c0"}, ["event_time"], None)
    shuffles = [x._jdf.queryExecution().executedPlan().toString().count("Exchange") for x in (one, split)]
    assert shuffles[0] == shuffles[1] <= 16


def test_ordinal_rank_routes_agree_with_a_hot_tie(spark):
    df = _skewed(spark)
    plain = with_ordinal_rank(df, "signal", "symbol", "r", ["event_time"], 10_000)
    split = with_ordinal_rank(df, "signal", "symbol", "r", ["event_time"], None)
    assert plain.exceptAll(split.select(plain.columns)).count() == 0


def test_scores_do_not_depend_on_the_route(spark):
    df = _skewed(spark).withColumn("fwd_5", F.sin(F.col("signal") * 3) + F.length("symbol"))
    for run in (scoring.information_coefficient, scoring.quantile_returns):
        a = run(df, "fwd_5", rows=10_000).toPandas()
        b = run(df, "fwd_5", rows=None).toPandas()
        a, b = a.sort_values(list(a.columns)[0]), b.sort_values(list(b.columns)[0])
        assert abs(a.to_numpy(dtype=float) - b[a.columns].to_numpy(dtype=float)).max() < 1e-9
    a = scoring.signal_turnover(df, rows=10_000).first()[0]
    assert abs(a - scoring.signal_turnover(df, rows=None).first()[0]) < 1e-12


def test_zscores_do_not_depend_on_the_route(spark):
    df = _skewed(spark).withColumn("other", F.col("signal") * 2 + F.rand(3))
    a = zscore_by_session(df, ["signal", "other"], 10_000).agg(F.sum("signal"), F.sum("other"), F.max("other")).first()
    b = zscore_by_session(df, ["signal", "other"], None).agg(F.sum("signal"), F.sum("other"), F.max("other")).first()
    assert max(abs(x - y) for x, y in zip(a, b)) < 1e-7


def test_orthogonal_columns_are_uncorrelated_and_unit_scaled(spark):
    df = _skewed(spark).withColumns({"b": F.col("signal") + F.randn(1), "c": F.col("signal") - F.randn(2)})
    z = zscore_by_session(df, ["signal", "b", "c"], 10_000)
    z = z.join(z.groupBy("event_time").count().where("count >= 20"), "event_time", "left_semi")
    out = orthogonalise(z, ["signal", "b", "c"])
    dots = out.groupBy("event_time").agg(
        F.avg(F.col("signal") * F.col("b")), F.avg(F.col("b") * F.col("c")), F.stddev_pop("c")
    ).collect()
    for _, ab, bc, scale in dots:
        assert abs(ab) < 1e-9 and abs(bc) < 1e-9 and abs(scale - 1) < 1e-9


def _events(spark, n=3000):
    rng = random.Random(9)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", i, rng.gauss(0, 1)) for i in range(n)]
    return spark.createDataFrame(rows, "k string, t int, v double")


def test_previous_and_running_sum_routes_agree(spark):
    df = _events(spark)
    chunk = F.floor(F.col("t") / 100)
    a = with_previous(df, ["k"], ["t"], ["v"], 10_000)
    b = with_previous(df, ["k"], ["t"], ["v"], None, chunk)
    assert a.exceptAll(b.select(a.columns)).count() == 0
    a = with_running_sum(df, ["k"], ["t"], {"s": F.col("v")}, 10_000).toPandas().set_index("t")["s"]
    b = with_running_sum(df, ["k"], ["t"], {"s": F.col("v")}, None, chunk).toPandas().set_index("t")["s"]
    assert (a - b).abs().max() < 1e-9


def _fold(fills):
    """Average-cost book, one fill after the other."""
    q, avg, out = 0.0, 0.0, []
    for side, quantity, price in fills:
        d = quantity if side == "BUY" else -quantity
        realised = 0.0
        if q == 0 or (q > 0) == (d > 0):
            avg = (abs(q) * avg + abs(d) * price) / abs(q + d)
        else:
            realised = (price - avg) * min(abs(d), abs(q)) * (1 if q > 0 else -1)
            if q + d == 0:
                avg = 0.0
            elif (q + d > 0) != (q > 0):
                avg = price
        q += d
        out.append((q, avg, realised))
    return out


def test_ledger_matches_the_fold_over_a_long_episode(spark):
    rng = random.Random(4)
    held, fills = 0, []
    for i in range(3000):
        # big buys and bigger sells keep one position open and shrink it often
        if held > 900:
            side, quantity = "SELL", held - rng.randrange(1, 40)
        else:
            side, quantity = "BUY", rng.randrange(1, 400)
        held += quantity if side == "BUY" else -quantity
        fills.append((side, quantity, round(rng.uniform(50, 150), 2)))
    expected = _fold(fills)
    rows = [(1, i, s, q, p) for i, (s, q, p) in enumerate(fills)]
    df = spark.createDataFrame(rows, "account int, t int, side string, quantity int, price double").selectExpr(
        "account", "t", "side", "cast(quantity as decimal(18,4)) quantity", "cast(price as decimal(18,4)) price", "cast(0 as decimal(18,4)) fees"
    )
    signed = ledger.fill_columns(df)
    for rows_, chunk in ((10_000, None), (None, F.floor(F.col("t") / 250))):
        got = ledger.positions(signed, ["account"], ["t"], rows_, chunk).orderBy("t").collect()
        assert len(got) == len(expected)
        for row, (q, avg, realised) in zip(got, expected):
            assert float(row["position"]) == q
            assert abs(row["average_cost"] - avg) < 1e-6
            assert abs(float(row["realised"]) - realised) < 0.0051


def test_ledger_open_add_reduce_flip(spark):
    fills = [("BUY", 10, 10.0), ("BUY", 10, 14.0), ("SELL", 5, 15.0), ("SELL", 17, 9.0), ("BUY", 2, 8.0)]
    rows = [(1, i, s, q, p) for i, (s, q, p) in enumerate(fills)]
    df = spark.createDataFrame(rows, "account int, t int, side string, quantity int, price double").selectExpr(
        "account", "t", "side", "cast(quantity as decimal(18,4)) quantity", "cast(price as decimal(18,4)) price", "cast(1 as decimal(18,4)) fees"
    )
    got = ledger.positions(ledger.fill_columns(df), ["account"], ["t"], 100).orderBy("t").collect()
    assert [r["kind"] for r in got] == ["open", "add", "reduce", "flip", "close"]
    assert [float(r["position"]) for r in got] == [10, 20, 15, -2, 0]
    assert [round(r["average_cost"], 9) for r in got] == [10, 12, 12, 9, 0]
    assert [float(r["realised"]) for r in got] == [0, 0, 15, -45, 2]


def test_quality_routes_agree(spark, walk):
    rows, schema = walk(3, 120)
    df = spark.createDataFrame(rows, schema).withColumns({"open": F.col("close"), "high": F.col("close") * 1.01, "low": F.col("close") * 0.99})
    df = df.unionByName(df.limit(5))
    found = [quality.findings(quality.flagged_bars(df, "1d", True, None, r)).drop("sample") for r in (1000, None)]
    assert found[0].exceptAll(found[1]).count() == 0 and found[0].count() > 0


def test_bounds_count_groups_where_the_footers_are_too_large(spark, monkeypatch):
    import duckdb

    from tickloom import sizing
    from tickloom.plans import tables as t

    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(sizing, "TASK_ROWS", 4000)
    ask = lambda sql: duckdb.execute(sql.format(f"'{folder}/lineitem.parquet'")).fetchall()[0][0]
    assert t.lines(spark, folder) > sizing.TASK_ROWS
    assert t.rows(spark, folder) == ask("SELECT greatest(count(DISTINCT l_suppkey), count(DISTINCT CAST(l_shipdate AS DATE))) FROM {}")
    largest = "SELECT max(n) FROM (SELECT count(*) AS n FROM {} GROUP BY l_suppkey, l_partkey % 20)"
    assert t.fill_rows(spark, folder, ["account", "instrument"]) == ask(largest)
    from tickloom.plans import REGISTRY

    plan = REGISTRY["l2_positions"].run(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "_chunk" not in plan


def test_split_routes_cut_alike_in_every_branch(spark):
    df = _skewed(spark, 500)
    for split in (with_ordinal_rank(df, "signal", "symbol", "r", ["event_time"], None), with_average_ranks(df, {"r": "signal"}, ["event_time"], None)):
        assert "percentile_approx" not in split._jdf.queryExecution().optimizedPlan().toString()


def test_chunked_positions_read_their_fills_once_a_step(spark):
    fills = spark.range(200).selectExpr(
        "1 AS account", "id AS t", "if(id % 3 = 0, 'SELL', 'BUY') AS side", "cast(5 as decimal(18,4)) quantity",
        "cast(10 + id % 7 as decimal(18,4)) price", "cast(0 as decimal(18,4)) fees",
    )
    done = ledger.positions(ledger.fill_columns(fills), ["account"], ["t"], None, F.floor(F.col("t") / 50))
    assert "Range (0, 200" not in done._jdf.queryExecution().optimizedPlan().toString()


def test_curve_copies_days_of_accounts_not_of_instruments(spark):
    import datetime as dt

    from pyspark.sql import Window as W

    rng = random.Random(11)
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    rows = [(rng.randrange(4), rng.choice([-3, 0, 1, 2]), day(rng.randrange(30)), rng.choice(["BUY", "SELL"]), rng.randrange(1, 9), rng.randrange(5, 20)) for _ in range(300)]
    df = spark.createDataFrame(rows, "account int, instrument int, session date, side string, quantity int, price int")
    df = df.selectExpr("account", "instrument", "session", "side", "cast(quantity as decimal(18,4)) quantity", "cast(price as decimal(18,4)) price", "cast(1 as decimal(18,4)) fees")
    fills = checkpointed(ledger.fill_columns(df).withColumn("n", F.monotonically_increasing_id()))
    prices = fills.groupBy("instrument", "session").agg(F.avg(F.col("price").cast("double")).alias("mark"))
    order = ["session", "n"]
    dates = fills.select(F.col("session").alias("date")).distinct()
    held = ledger.positions_on(ledger.positions(fills, ["account", "instrument"], order, 10_000), dates, ["account", "instrument"], order)
    own = W.partitionBy("account").orderBy(*order)
    flows = fills.withColumn("cash", 1000 + F.sum("cash_delta").over(own)).groupBy("account", "session").agg(F.max_by("cash", "n").alias("mark"))
    money = ledger.marks_on(flows, dates, "account").withColumnRenamed("mark", "cash")
    long = ledger.equity_curve(held, ledger.marks_on(prices, dates, "instrument"), money, ["account"], "instrument")
    short = ledger.session_curve(fills, prices, ["account"], "instrument", [-3, 0, 1, 2], 1000.0, 30)
    read = lambda x: sorted((r.account, r.date, round(r.equity, 6), r.positions) for r in x.collect())
    assert read(short) == read(long)


def _odd_fills(spark):
    import datetime as dt

    rng = random.Random(12)
    maybe = lambda x, share=0.2: None if rng.random() < share else x
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    rows = [(maybe(rng.randrange(9), 0.1), maybe(rng.choice([-3, 0, 1, 2])), maybe(day(rng.randrange(30)), 0.05), rng.choice(["BUY", "SELL"]), maybe(rng.randrange(1, 9)), maybe(rng.randrange(5, 20))) for _ in range(400)]
    # accounts that begin with fills of one instrument, or of two, without a quantity
    rows += [(20, 1, day(2), "BUY", None, 5), (20, 1, day(4), "BUY", 3, 5), (21, 1, day(2), "BUY", None, 5), (21, 2, day(2), "SELL", None, 5), (22, 0, day(3), "BUY", None, 5)]
    rows += [(23, 1, day(1), "BUY", 10**9, 10**9), (23, 1, day(5), "SELL", 7, 3)]
    df = spark.createDataFrame(rows, "account int, instrument int, session date, side string, quantity bigint, price bigint")
    df = df.selectExpr("account", "instrument", "session", "side", "cast(quantity as decimal(18,4)) quantity", "cast(price as decimal(18,4)) / 3 price", "cast(1.25 as decimal(18,4)) fees")
    return checkpointed(ledger.fill_columns(df.withColumn("price", F.col("price").cast("decimal(18,4)"))))


def _windowed_curve(fills, prices, instruments, opening):
    """The curve in plain windows: a null sum is null until the first value."""
    from pyspark.sql import Window as W

    days = fills.select(F.col("session").alias("date")).where("date is not null").distinct()
    marks = ledger.marks_on(prices, days, "instrument").groupBy("date").agg(*[F.max(F.when(F.col("instrument") == i, F.col("mark"))).alias(f"m{n}") for n, i in enumerate(instruments)])
    units = [F.sum(F.when(F.col("instrument") == i, F.col("signed_quantity")).otherwise(0) * 10_000).cast("bigint").alias(f"q{n}") for n, i in enumerate(instruments)]
    daily = fills.groupBy("account", "session").agg(F.sum("cash_delta").alias("flow"), *units)
    firsts = daily.groupBy("account").agg(F.min("session").alias("first"))
    every = firsts.join(days, F.col("date") >= F.col("first")).join(marks, "date").withColumnRenamed("account", "a")
    own = W.partitionBy("a").orderBy("date")
    full = every.join(daily, F.col("a").eqNullSafe(F.col("account")) & (F.col("date") == F.col("session")), "left")
    held = [F.sum(f"q{n}").over(own) / 10_000 for n in range(len(instruments))]
    value = sum((h * F.coalesce(F.col(f"m{n}"), F.lit(0.0)) for n, h in enumerate(held)), F.lit(0.0))
    cash = (F.lit(opening).cast("decimal(28,8)") + F.sum("flow").over(own)).cast("decimal(28,8)")
    done = full.select(F.col("a").alias("account"), "date", cash.alias("cash"), sum(((h != 0).cast("bigint") for h in held), F.lit(0)).alias("positions"), (cash.cast("double") + value).alias("equity"))
    return done.withColumn("previous", F.lag("equity").over(W.partitionBy("account").orderBy("date")))


def test_curve_with_odd_rows_is_that_of_windows(spark):
    fills, names = _odd_fills(spark), [-3, 0, 1, 2]
    prices = checkpointed(fills.groupBy("instrument", "session").agg(F.avg(F.col("price").cast("double")).alias("mark")))
    read = lambda x: sorted(map(repr, x.select("account", "date", "cash", "positions", "equity", "previous").collect()))
    plain = read(_windowed_curve(fills, prices, names, 1000.5))
    columns = ("previous", "cash", "positions", "equity")
    assert read(ledger.session_curve(fills, prices, ["account"], "instrument", names, 1000.5, 10_000, columns)) == plain
    assert read(ledger.session_curve(fills, prices, ["account"], "instrument", names, 1000.5, None, columns)) == plain


def test_curve_does_not_depend_on_its_batches(spark, monkeypatch):
    import pyarrow as pa

    fills = _odd_fills(spark)
    days = fills.select(F.col("session").alias("date")).where("date is not null").distinct().orderBy("date")
    calendar = days.withColumn("_marks", F.when(F.day("date") != 9, F.array(*[F.day("date") + F.lit(float(i)) for i in range(4)]))).toArrow().combine_chunks()
    moves = fills.where("session is not null").selectExpr("account", "session _day", "instrument _name", "cast(signed_quantity * 10000 as bigint) _units", "cash_delta _flow").orderBy("account").toArrow()
    columns = ("cash", "positions", "equity", "previous")

    def run(size):
        out = ledger._curves(iter(moves.combine_chunks().to_batches(max_chunksize=size)), ["account"], calendar, [-3, 0, 1, 2], 10**11, columns)
        return pa.Table.from_batches(list(out)).to_pylist()

    whole = run(10_000)
    assert len({r["account"] for r in whole}) == 14 and all(r["date"].day != 9 for r in whole)
    assert [run(k) == whole for k in (1, 7, 50)] == [True] * 3
    monkeypatch.setattr(ledger, "CURVE_CELLS", 1)
    assert [run(k) == whole for k in (7, 10_000)] == [True] * 2


def test_curve_shuffles_its_fills_once(spark):
    from tickloom.plans import REGISTRY

    plan = REGISTRY["l6_equity_curve"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Generate" not in plan


def test_snapshot_of_a_curve_with_its_previous_equity(spark):
    from tickloom.plans import REGISTRY

    rows = [(1, "a", 5.0, None, 1), (1, "b", 9.0, 5.0, 2), (1, "c", 6.0, 9.0, 0), (2, "a", -4.0, None, 1), (3, "a", None, None, None), (3, "b", 2.0, None, 1), (None, "a", 3.0, None, 1), (None, "b", None, 3.0, 4)]
    curve = spark.createDataFrame(rows, "account int, date string, equity double, previous double, positions bigint")
    read = lambda x: sorted(map(repr, ledger.snapshot(x, ["account"]).collect()))
    assert read(curve) == read(curve.drop("previous"))
    assert "drawdown=-0.33333333333333337, last_change=-3.0" in read(curve)[0]
    plan = REGISTRY["l7_snapshot"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortAggregate" not in plan


def test_daily_summary_of_a_curve_with_its_previous_equity(spark):
    from tickloom.operators import risk
    from tickloom.plans import REGISTRY

    rows = [(1, "a", 5.0, None, 1), (1, "b", 9.0, 5.0, 2), (1, "c", None, 9.0, 0), (1, "d", 2.0, None, 0), (None, "a", 3.0, None, 1), (None, "b", 1.0, 3.0, 4)]
    curve = spark.createDataFrame(rows, "account int, date string, equity double, previous double, positions bigint")
    read = lambda x: sorted(map(repr, risk.daily_summary(x).collect()))
    assert read(curve) == read(curve.drop("previous")) and len(read(curve)) == 2
    plan = REGISTRY["rk9_daily_summary"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1


def _factors(spark, n=2500):
    df = _skewed(spark, n).dropDuplicates(["event_time", "symbol"]).where("event_time is not null")
    gone = lambda i: F.xxhash64("symbol", F.lit(i)) % 7 == 0
    wide = df.select(
        "event_time", F.concat(F.lit("N"), F.substring("symbol", -2, 2)).alias("symbol"),
        F.when(~gone(1), F.col("signal")).alias("a"), F.when(gone(2), F.lit(float("nan"))).otherwise(F.sin(F.xxhash64("symbol") % 11)).alias("b"),
        F.when(~gone(3), F.round(F.cos(F.xxhash64("symbol") % 97), 2)).alias("fwd_21"),
    )
    return checkpointed(wide.dropDuplicates(["event_time", "symbol"]))


def test_reports_of_a_wide_table_are_those_of_the_long_one(spark):
    df = _factors(spark)
    for run in (
        lambda rows: scoring.factor_reports(df, ["a", "b"], 21, 0.0033, rows=rows),
        lambda rows: scoring.factor_ics(df, ["a", "b"], "fwd_21", rows=rows),
    ):
        a, b = (run(rows).toPandas().sort_values("factor").reset_index(drop=True) for rows in (10_000, None))
        assert list(a["factor"]) == ["a", "b"] and (a["sessions"] >= 2).all()
        numbers = [c for c in a.columns if c != "factor"]
        assert abs(a[numbers].to_numpy(dtype=float) - b[numbers].to_numpy(dtype=float)).max() < 1e-9


def test_a_bar_is_dealt_to_its_session_once_for_all_factors(spark):
    df = _factors(spark)
    plan = scoring.factor_reports(df, ["a", "b"], 21, 0.0033, rows=10_000)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [event_time") == plan.count("FlatMapGroupsInArrow") == 2
    assert "rank(" not in plan and "row_number" not in plan


def test_overlap_and_weights_do_not_depend_on_the_route(spark):
    df = _factors(spark).withColumn("c", F.col("b") - F.col("a"))
    one, other = (factor_correlations(df, ["a", "b", "c"], rows).toPandas() for rows in (10_000, None))
    assert one["observations"].iloc[0] == other["observations"].iloc[0] > 0
    both = one.merge(other, on=["left", "right"])
    assert len(both) == 6 and abs(both["rho_x"] - both["rho_y"]).max() < 1e-9
    whole = complete_rows(df, ["a", "b", "c"])
    one, other = (ic_weights(whole, ["a", "b", "c"], 21, rows=rows).first() for rows in (10_000, None))
    assert max(abs(x - y) for x, y in zip(one, other)) < 1e-9


def test_a_panel_is_bounded_by_its_names_and_sessions_long_before_a_task_is_full(spark, tmp_path, monkeypatch):
    from tickloom.plans import tables

    monkeypatch.setattr(tables, "COUNTED_ROWS", 10)
    lines = spark.range(200).selectExpr("id % 7 as l_suppkey", "date_add(date'1994-01-01', cast(id % 9 as int)) as l_shipdate")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert tables.rows(spark, str(tmp_path)) == 9


def test_last_positions_fold_is_the_end_of_the_history(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(40) or None, i, rng.choice(["BUY", "SELL"]), rng.randrange(1, 6), round(rng.uniform(5, 9), 2)) for i in range(3000)]
    df = spark.createDataFrame(rows, "account int, t int, side string, quantity int, price double").selectExpr(
        "account", "t", "side", "cast(quantity as decimal(18,4)) quantity", "cast(price as decimal(18,4)) price", "cast(0.01 as decimal(18,4)) fees"
    )
    signed = checkpointed(ledger.fill_columns(df))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")  # keys go over batches
    try:
        folded = ledger.last_positions(signed, ["account"], ["t"], 3000, keep=("side",)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    history = ledger.positions(signed, ["account"], ["t"], 3000)
    plain = ledger.final_positions(history, ["account"], ["t"]).collect()
    sides = {r.account: r.side for r in history.groupBy("account").agg(F.max_by("side", "t").alias("side")).collect()}
    read = lambda rows: {r.account: (r.position, round(r.average_cost, 9), r.realised, r.fees, r.fills) for r in rows}
    assert read(folded) == read(plain) and len(folded) == 40
    assert {r.account: r.side for r in folded} == sides


def test_totals_of_the_ledger_make_no_history(spark):
    from tickloom.plans import REGISTRY

    plan = lambda q: REGISTRY[q].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan("l3_positions_with_splits") and "Window" not in plan("l3_dividends")


def test_samples_by_masks_are_the_books_of_each_sample(spark):
    from tickloom.operators import portfolio as po
    from tickloom.operators import resampling as rs

    rng = random.Random(3)
    day = lambda i: f"2024-01-{i + 1:02d} 12:00:00"
    rows = [(c, day(i), f"S{n:02d}", float(rng.randrange(6)), rng.uniform(-0.1, 0.1)) for c in range(2) for i in range(5) for n in range(23) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "config int, at string, symbol string, score double, ret double")
    df = checkpointed(df.select("config", F.to_timestamp("at").alias("decision_time"), "symbol", "score", "ret"))
    returns = df.where("config = 0 and decision_time < '2024-01-05'").select("symbol", "decision_time", "ret")
    names = df.select("symbol", F.substring("symbol", 2, 2).cast("int").alias("sym_no")).distinct()
    kept = checkpointed(rs.dropout_names(names, 4, rows=100).select("sample", "symbol"))
    dates = df.select("decision_time").distinct()
    plain = po.evaluate(po.top_fraction(df.join(kept, "symbol"), ["sample", "config", "decision_time"], 0.2, rows=100), returns, dates, ["sample", "config"], 0.001)
    masked = po.evaluate_samples(df.join(rs.sample_masks(kept), "symbol"), returns, dates, ["config"], 4, 0.2, 0.001)
    read = lambda x: sorted((r.sample, r.config, r.event_time, r.names, round(r.ret, 10), round(r.turnover, 10), round(r.equity, 10)) for r in x.collect())
    assert read(masked) == read(plain) and len(read(plain)) == 4 * 2 * 4


def test_configurations_side_by_side_are_the_books_of_each(spark):
    from tickloom.operators import portfolio as po
    from tickloom.operators import resampling as rs

    rng = random.Random(6)
    maybe = lambda x: None if rng.random() < 0.1 else x
    day = lambda i: f"2024-01-{i + 1:02d} 12:00:00"
    close = lambda: maybe(float(rng.choice([0, -1, 1, 2, 3, 4])))
    rows = [(day(i), f"S{n:02d}", rng.uniform(1, 9), close(), close(), close(), close()) for i in range(7) for n in range(31) if rng.random() < 0.85]
    rows += [(day(i), None, 1.0 + i, 1.0, 2.0, 9.0, 9.0) for i in range(7)]
    df = spark.createDataFrame(rows, "at string, symbol string, entry double, start_5 double, start_9 double, end_0 double, end_2 double")
    view = checkpointed(df.withColumn("decision_time", F.to_timestamp("at")).drop("at"))
    dates, configs = view.select("decision_time").distinct(), [(5, 0), (9, 2), (9, 0)]
    columns = ["event_time", "names", "gross_ret", "turnover", "ret", "equity", "peak", "drawdown"]
    read = lambda x, *keys: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in x.select(*keys, *columns).collect())
    scored = po.momentum_scores(view, configs, ["decision_time", "symbol"])
    plain = po.evaluate(po.top_fraction(scored, ["config", "decision_time"], 0.2, rows=100), po.holding_returns(view), dates, ["config"], 0.001)
    beside = po.evaluate_configs(view.repartition(5), dates, configs, 0.2, 0.001)
    assert read(beside, "config") == read(plain, "config") and plain.count() == 3 * 6
    names = view.where("symbol is not null").select("symbol", F.substring("symbol", 2, 2).cast("int").alias("sym_no")).distinct()
    kept = checkpointed(rs.dropout_names(names, 4, 0.4, rows=100).select("sample", "symbol"))
    sampled = po.momentum_scores(view.join(kept, "symbol"), configs, ["decision_time", "symbol", "sample"])
    each = po.evaluate(po.top_fraction(sampled, ["sample", "config", "decision_time"], 0.3, rows=100), po.holding_returns(view), dates, ["sample", "config"], 0.001)
    masked = view.join(rs.sample_masks(kept), "symbol")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        for records in (before, "3"):
            spark.conf.set(size, records)
            assert read(po.evaluate_configs(masked, dates, configs, 0.3, 0.001, 4), "sample", "config") == read(each, "sample", "config")
    finally:
        spark.conf.set(size, before)
    assert po.evaluate_configs(view.limit(0), dates, configs, 0.2).count() == 0


def test_checks_of_the_gauntlet_are_tables_of_their_own(spark):
    from tickloom.plans.books import gauntlet_results

    names, found = gauntlet_results(spark, "/root/testdata/sf0.001")
    for frame in (names, *found):
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
        assert len(frame.columns) in (1, 6) and frame.count() <= 15
