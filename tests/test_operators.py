"""Known answers."""

import datetime as dt
import math
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import corpactions, costs, crosssection, factors, performance, pit, portfolio, resampling, scoring, stationarity, universe


def _series(spark, **named):
    start = dt.datetime(2020, 1, 1)
    rows = [(n, start + dt.timedelta(days=i), float(v)) for n, x in named.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "symbol string, event_time timestamp, close double")


@pytest.mark.parametrize("side, total", [("BUY", "118.62"), ("SELL", "118.96")])
def test_delivery_contract_note(spark, side, total):
    df = spark.createDataFrame([(side,)], "side string").withColumn("n", F.lit(Decimal("100000")).cast(costs.NOTIONAL))
    zero = F.lit(0).cast("decimal(28,8)")
    got = df.select(costs.total(costs.indian(costs.DELIVERY, F.col("side"), F.col("n"), zero)).alias("t")).first()["t"]
    assert str(got) == total


def test_slippage_is_zero_impact_without_volume(spark):
    df = spark.range(1).select(F.lit(Decimal("100000")).cast(costs.NOTIONAL).alias("n"), F.lit(0.0).alias("adv"))
    got = df.select(costs.slippage(F.col("n"), F.col("adv")).alias("s")).first()["s"]
    assert float(got) == 25.0


@pytest.mark.parametrize("ratio", [0.5, 0.2, 0.25, 1 / 3, 0.1])
def test_inferred_split_is_removed(spark, ratio):
    df = _series(spark, A=[100.0] * 20 + [100.0 * ratio] * 20).withColumn("volume", F.lit(10.0))
    got = corpactions.adjust_inferred_splits(df).agg(F.min("close"), F.max("close")).first()
    assert abs(got[0] - 100 * ratio) < 1e-9 and abs(got[1] - 100 * ratio) < 1e-9


def test_a_crash_is_not_a_split(spark):
    df = _series(spark, A=[100.0] * 20 + [57.0] * 20).withColumn("volume", F.lit(10.0))
    assert corpactions.inferred_split_factors(df).where("split_factor <> 1").count() == 0


def test_perfect_signal_has_unit_ic(spark):
    rows = [(s, f"N{i:03d}", float(i * (s + 1)), float(i) ** 3) for s in range(4) for i in range(30)]
    df = spark.createDataFrame(rows, "event_time int, symbol string, signal double, fwd_5 double")
    got = scoring.information_coefficient(df, "fwd_5", rows=200).first()
    assert abs(got["mean"] - 1) < 1e-12 and got["sessions"] == 4 and got["hit_rate"] == 1.0
    assert scoring.signal_turnover(df, rows=200).first()[0] == 0.0


def test_factors_are_null_until_their_window_is_full(spark, walk):
    rows, schema = walk(2, 300)
    df = factors.with_factors(spark.createDataFrame(rows, schema), ("volatility_60", "momentum_12_1", "beta"))
    got = df.groupBy("symbol").agg(F.count("volatility_60"), F.count("momentum_12_1"), F.count("beta")).collect()
    assert {tuple(r)[1:] for r in got} == {(240, 48, 49)}


def test_permuting_rows_changes_nothing(spark, walk):
    rows, schema = walk(3, 300)
    df = spark.createDataFrame(rows, schema)
    a = factors.with_factors(df, ("idiosyncratic_vol",)).agg(F.sum("idiosyncratic_vol")).first()[0]
    b = factors.with_factors(df.orderBy(F.rand(4)), ("idiosyncratic_vol",)).agg(F.sum("idiosyncratic_vol")).first()[0]
    assert a is None and b is None or abs(a - b) < 1e-12


def test_summary_of_a_constant_series(spark):
    df = _series(spark, A=[0.001] * 50).withColumnRenamed("close", "ret")
    got = performance.summarise(df, ["symbol"]).first()
    assert got["sharpe"] == 0.0 and got["sortino"] == 0.0 and got["kurtosis"] == 3.0 and got["max_drawdown"] == 0.0


def test_total_loss_compounds(spark):
    df = _series(spark, A=[0.5, -1.0, 0.5], B=[0.1, -0.5, 0.2]).withColumnRenamed("close", "ret")
    got = {r["symbol"]: r for r in performance.summarise(df, ["symbol"]).collect()}
    assert got["A"]["total_return"] == -1.0 and got["A"]["cagr"] == -1.0 and got["A"]["max_drawdown"] == -1.0
    assert abs(got["B"]["total_return"] - (1.1 * 0.5 * 1.2 - 1)) < 1e-12


def test_first_loss_counts_in_the_drawdown(spark):
    df = _series(spark, A=[-0.2, 0.1]).withColumnRenamed("close", "ret")
    assert abs(performance.summarise(df, ["symbol"]).first()["max_drawdown"] + 0.2) < 1e-12


def test_known_processes(spark):
    rng = np.random.default_rng(7)
    walk_ = np.cumsum(rng.normal(0, 1, 800)) + 100
    ou = [0.0]
    for _ in range(799):
        ou.append(ou[-1] * 0.8 + rng.normal())
    got = {r["symbol"]: r for r in stationarity.assess(_series(spark, W=walk_, O=np.array(ou) + 50)).collect()}
    assert got["O"]["verdict"] == "STATIONARY" and got["O"]["adf_pvalue"] < 0.01 and got["O"]["tradable_as_mean_reversion"]
    assert got["W"]["adf_pvalue"] > 0.05 and got["W"]["verdict"] != "STATIONARY"
    assert abs(got["W"]["hurst"] - 0.5) < 0.15 and got["O"]["hurst"] < 0.3
    half = {r["symbol"]: r["half_life"] for r in stationarity.half_life(_series(spark, O=ou), ["symbol"]).collect()}
    assert 2 < half["O"] < 5


def test_cointegrated_pair(spark):
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.normal(0, 1, 600)) + 200
    noise = [0.0]
    for _ in range(599):
        noise.append(noise[-1] * 0.7 + rng.normal())
    df = _series(spark, A=2 * x + np.array(noise) + 5, B=x)
    pairs = spark.createDataFrame([("A", "B")], "left string, right string")
    got = stationarity.engle_granger(df, pairs).first()
    assert abs(got["hedge_ratio"] - 2) < 0.05 and got["cointegrated"] and got["tradable"]


def test_garch_follows_the_last_returns(spark):
    rng = np.random.default_rng(1)
    var, r = 1e-4, []
    for _ in range(1200):
        x = rng.normal() * var**0.5
        r.append(x)
        var = 2e-6 + 0.08 * x * x + 0.9 * var
    df = _series(spark, G=r, S=r[:100]).withColumnRenamed("close", "ret")
    got = {x["symbol"]: x for x in stationarity.garch(df).collect()}
    assert got["G"]["method"] == "garch" and abs(got["G"]["daily"] / var**0.5 - 1) < 0.15
    assert got["S"]["method"] == "ewma"


def test_allocations(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(0, 0.01, (300, 6))
    base[:, 1] = base[:, 0] + rng.normal(0, 0.002, 300)
    start = dt.datetime(2020, 1, 1)
    rows = [(f"S{j}", start + dt.timedelta(days=i), float(base[i, j])) for i in range(300) for j in range(6)]
    df = spark.createDataFrame(rows, "symbol string, event_time timestamp, ret double")
    names = crosssection.chosen(df, 6)
    cov = crosssection.ledoit_wolf(crosssection.moment_table(df, names)).cache()
    matrix = np.zeros((6, 6))
    for r in cov.collect():
        matrix[r["i"], r["j"]] = r["value"]
    weights = {r["i"]: r for r in crosssection.allocations(cov).collect()}
    w = np.array([weights[i]["weight_erc"] for i in range(6)])
    risk = w * (matrix @ w)
    assert abs(w.sum() - 1) < 1e-9 and risk.max() / risk.min() - 1 < 1e-4
    assert abs(sum(r["weight_hrp"] for r in weights.values()) - 1) < 1e-9
    corr = crosssection.correlation(cov)
    d = np.sqrt(np.diag(matrix))
    lam = np.linalg.eigvalsh(matrix / np.outer(d, d))
    assert abs(crosssection.effective_bets(corr).first()["effective_bets"] - lam.sum() ** 2 / (lam**2).sum()) < 1e-9
    groups = {r["i"]: r["label"] for r in crosssection.clusters(corr, 0.5).collect()}
    assert groups[0] == groups[1] == 0 and len(set(groups.values())) == 5


def _returns(spark, names, sessions, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 0.01, (sessions, names)) + rng.normal(0, 0.01, (sessions, 1 + names // 4))[:, np.arange(names) // 4]
    base[rng.random(base.shape) < 0.1] = np.nan
    start = dt.datetime(2020, 1, 1)
    rows = [(f"S{j:05d}", start + dt.timedelta(days=i), None if np.isnan(x) else float(x)) for i, day in enumerate(base) for j, x in enumerate(day)]
    return spark.createDataFrame(rows, "symbol string, event_time timestamp, ret double"), np.nan_to_num(base)


def test_moments_do_not_depend_on_tiles(spark):
    df, x = _returns(spark, 13, 90)
    names = crosssection.chosen(df, 13)
    want = {}
    q = x * x
    for i in range(13):
        for j in range(13):
            want[i, j] = (90, x[:, i].sum(), x[:, j].sum(), q[:, i].sum(), q[:, j].sum(), x[:, i] @ x[:, j], q[:, i] @ x[:, j], x[:, i] @ q[:, j], q[:, i] @ q[:, j])
    for sizes in ((256, 512, 8192), (4, 16, 32), (5, 7, 1000)):
        got = {(r["i"], r["j"]): tuple(r)[2:] for r in crosssection.moment_table(df, names, *sizes).collect()}
        assert got.keys() == want.keys()
        assert all(np.allclose(got[k], want[k], rtol=1e-9, atol=1e-15) for k in want)


def test_spanning_tree_order_and_weights(spark):
    df, _ = _returns(spark, 21, 120)
    cov = crosssection.ledoit_wolf(crosssection.moment_table(df, crosssection.chosen(df, 21))).cache()
    corr = crosssection.correlation(cov).cache()
    matrix, near = np.zeros((21, 21)), {}
    for r in cov.collect():
        matrix[r["i"], r["j"]] = r["value"]
    for r in crosssection.distances(corr).where("i < j").collect():
        near[r["i"], r["j"]] = r["distance"]
    # Kruskal, and the branches it joins
    branch, tree = {i: (i, [i]) for i in range(21)}, []
    for (i, j), d in sorted(near.items(), key=lambda e: (e[1], e[0])):
        if branch[i] is branch[j]:
            continue
        old, new = sorted((branch[i], branch[j]), key=lambda b: b[0])
        merged = (21 + len(tree), old[1] + new[1])
        branch.update(dict.fromkeys(merged[1], merged))
        tree.append((i, j))
    found = crosssection.spanning_tree(corr).cache()
    assert sorted((r["i"], r["j"]) for r in found.collect()) == sorted(tree)
    order = crosssection.leaf_order(found).cache()
    assert [r["i"] for r in order.orderBy("position").collect()] == branch[0][1]
    # clusters at a cut are what is left of the tree below it
    cut = float(np.median([near[e] for e in tree]))
    label = {i: i for i in range(21)}
    for i, j in tree:
        if near[i, j] <= cut:
            low, high = sorted((label[i], label[j]))
            label = {k: low if v == high else v for k, v in label.items()}
    assert {r["i"]: r["label"] for r in crosssection.clusters(corr, cut).collect()} == label

    def split(names):
        if len(names) < 2:
            return {names[0]: 1.0}
        halves = names[: len(names) // 2], names[len(names) // 2 :]
        risk = []
        for h in halves:
            w = 1 / np.diag(matrix)[h]
            risk.append(w / w.sum() @ matrix[np.ix_(h, h)] @ w / w.sum())
        return {i: w * risk[1 - k] / sum(risk) for k, h in enumerate(halves) for i, w in split(h).items()}

    want = split(branch[0][1])
    got = {r["i"]: r["weight_hrp"] for r in crosssection.hierarchical_weights(cov, order).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_universe_never_sees_the_future(spark, walk):
    rows, schema = walk(6, 120)
    panel = spark.createDataFrame(rows, schema)
    rules = universe.UniverseRules(top_n=3, min_sessions=40, min_price=1, min_median_value=1)
    as_of = "2022-04-01 09:00:00"
    a = universe.universe(panel, as_of, rules).toPandas()
    b = universe.universe(pit.observable(panel, as_of), as_of, rules).toPandas()
    assert a.equals(b) and len(a) == 3


def test_universe_rules_that_cannot_be_met():
    with pytest.raises(ValueError):
        universe.UniverseRules(min_sessions=61, lookback_days=60)


def test_scores_with_forward_returns_are_refused(spark):
    with pytest.raises(ValueError):
        pit.refuse_forward_columns(spark.range(1).withColumn("fwd_5", F.lit(1.0)))


def test_clipping_keeps_relative_views(spark):
    df = spark.createDataFrame([(0, "A", 0.9), (0, "B", 0.4), (0, "C", 0.0)], "d int, symbol string, weight double")
    got = {r["symbol"]: r["weight"] for r in portfolio.clipped(df, ["d"], 0.5, 0.6).collect()}
    assert "C" not in got and abs(got["A"] - 0.6 * 5 / 9) < 1e-12 and abs(got["B"] - 0.6 * 4 / 9) < 1e-12


def test_bootstrap_brackets_the_estimate(spark):
    rng = np.random.default_rng(2)
    df = _series(spark, A=rng.normal(0.001, 0.01, 250)).withColumnRenamed("close", "ret")
    arrays = resampling.series_arrays(df, ["symbol"])
    got = resampling.bootstrap_sharpe(arrays, ["symbol"], 300).first()
    assert got["lower"] < got["point_estimate"] < got["upper"] and got["resamples"] == 300
    block = resampling.block_bootstrap(arrays, ["symbol"], 20, 300).first()
    assert block["lower"] < block["upper"]
    luck = resampling.monte_carlo_drawdown(arrays, ["symbol"], 200).first()
    assert luck["percentile_5"] <= luck["median_drawdown"] <= 0


def test_deflated_sharpe_falls_with_trials(spark):
    rng = np.random.default_rng(2)
    df = _series(spark, A=rng.normal(0.001, 0.01, 500)).withColumnRenamed("close", "ret")
    moments = resampling.sharpe_moments(df, ["symbol"])
    got = [resampling.deflated_sharpe(moments.withColumn("n_trials", F.lit(n))).first()["dsr"] for n in (1, 10, 200)]
    assert 1 > got[0] > got[1] > got[2] > 0


def test_overfitting_of_noise_and_of_an_edge(spark):
    rng = np.random.default_rng(5)
    start = dt.datetime(2020, 1, 1)
    edge = rng.normal(0, 0.01, (400, 6))
    edge[:, 2] += 0.01
    rows = [(j, start + dt.timedelta(days=i), float(edge[i, j])) for i in range(400) for j in range(6)]
    df = spark.createDataFrame(rows, "config bigint, event_time timestamp, ret double")
    got = resampling.backtest_overfitting(df, []).first()
    assert got["pbo"] == 0.0 and got["n_combinations"] == 252 and got["n_configurations"] == 6


def test_gauntlet_stops_at_the_first_failure(spark):
    names = spark.createDataFrame([("a",), ("b",)], "strategy string")
    clean = resampling.check_data_integrity(spark.createDataFrame([("a", 0), ("b", 2)], "strategy string, critical int"))
    rows = resampling.gauntlet(spark, names, [clean]).toPandas()
    assert rows[rows.strategy == "b"].test.tolist() == ["1_data_integrity"]
    a = rows[rows.strategy == "a"]
    assert len(a) == 12 and a.strategy_passed.all() and a.skipped.sum() == 11


def test_rows_are_copied_to_the_dates_they_hold_on(spark):
    from tickloom.functions.windows import copied_to

    rows = [("a", 1, 4), ("a", 4, None), ("b", 3, 3), ("c", 9, None), ("d", -5, 2), ("e", 5, 8)]
    asked = [0, 1, 3, 5, 7, 7, 8]
    day = lambda n: None if n is None else dt.date(2024, 1, 10) + dt.timedelta(days=n)
    df = spark.createDataFrame([(k, day(a), day(b)) for k, a, b in rows], "k string, f date, u date")
    dates = spark.createDataFrame([(day(n),) for n in asked], "on date")
    got = sorted((r.k, r["on"]) for r in copied_to(df, dates, "on", "f", "u").collect())
    assert got == sorted((k, day(n)) for k, a, b in rows for n in set(asked) if a <= n and (b is None or n < b))
    assert copied_to(df, dates.limit(0), "on", "f", "u").count() == 0


def _regress(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ (x.T @ y)
    rest = y - x @ beta
    return beta, float(rest @ rest), inverse


def plain_adf(x: np.ndarray) -> float:
    """Augmented Dickey-Fuller p-value, lag chosen by AIC; 1 when unusable."""
    n = x.size
    if n < stationarity.MIN_OBSERVATIONS or np.std(x) == 0.0:
        return 1.0
    top = min(int(math.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 2)
    dx = np.diff(x)

    def design(lags: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(skip, dx.size)
        columns = [x[rows], np.ones(rows.size)] + [dx[rows - j] for j in range(1, lags + 1)]
        return dx[rows], np.column_stack(columns)

    best, chosen = math.inf, 0
    for lags in range(top + 1):
        y, z = design(lags, top)
        _, ssr, _ = _regress(y, z)
        m = y.size
        aic = m * (math.log(2 * math.pi) + math.log(max(ssr, 1e-300) / m) + 1) + 2 * z.shape[1]
        if aic < best:
            best, chosen = aic, lags
    y, z = design(chosen, chosen)
    beta, ssr, inverse = _regress(y, z)
    variance = ssr / (y.size - z.shape[1]) * inverse[0, 0]
    if not variance > 0:
        return 1.0
    return stationarity._df_pvalue(float(beta[0] / math.sqrt(variance)))


def plain_kpss(x: np.ndarray) -> float:
    """KPSS level p-value with automatic bandwidth; 0 when unusable."""
    n = x.size
    if n < stationarity.MIN_OBSERVATIONS or np.std(x) == 0.0:
        return 0.0
    e = x - x.mean()
    s0, s1 = float(e @ e) / n, 0.0
    for i in range(1, int(n ** (2.0 / 9.0)) + 1):
        cross = 2.0 * float(e[i:] @ e[:-i]) / n
        s0 += cross
        s1 += i * cross
    ratio = s1 / s0
    bandwidth = min(int(1.1447 * (ratio * ratio) ** (1 / 3) * n ** (1 / 3)), n - 1)
    long_run = float(e @ e)
    for i in range(1, bandwidth + 1):
        long_run += 2.0 * float(e[i:] @ e[:-i]) * (1.0 - i / (bandwidth + 1.0))
    stat = float(np.sum(np.cumsum(e) ** 2)) / n**2 / (long_run / n)
    return float(np.interp(stat, stationarity.KPSS_STATS, stationarity.KPSS_P))


def test_unit_roots_equal_the_plain_regressions(spark):
    rng = np.random.default_rng(4)
    series = {}
    for k in range(36):
        n = int(rng.integers(20, 700))
        noise = rng.normal(0, 1, n)
        phi = (0.0, 0.5, 0.9, 1.0, -0.95, 0.99)[k % 6]
        x = np.zeros(n)
        for i in range(1, n):
            x[i] = phi * x[i - 1] + noise[i]
        series[f"S{k}"] = 1e4 * (k % 3) + x
    series["flat"], series["turns"] = np.full(200, 3.0), np.tile([1.0, -1.0], 150)
    start = dt.datetime(2020, 1, 1)
    rows = [(k, start + dt.timedelta(days=i), float(v)) for k, x in series.items() for i, v in enumerate(x)]
    rows += [("S0", start - dt.timedelta(days=1), None), ("S1", start - dt.timedelta(days=1), float("nan")), ("none", start, None)]
    df = spark.createDataFrame(rows, "symbol string, event_time timestamp, close double").repartition(3)
    got = {r["symbol"]: (r["adf_pvalue"], r["kpss_pvalue"]) for r in stationarity.unit_root_tests(df, ["symbol"]).collect()}
    assert got.keys() == series.keys()
    for k, x in series.items():
        if k != "turns":  # differences and levels depend on each other
            assert abs(got[k][0] - plain_adf(x - x.mean())) < 1e-6, k  # products of levels far from zero are inexact
        assert abs(got[k][1] - plain_kpss(x)) < 1e-9, k


def _odd_series(spark):
    rng = np.random.default_rng(9)
    start = dt.datetime(2020, 1, 1)
    series = {f"S{k}": list(100 + np.cumsum(rng.normal(0, 1, int(rng.integers(1, 300))))) for k in range(20)}
    series |= {"flat": [3.0] * 200, "line": [float(i) for i in range(200)], "gaps": [None if i % 7 == 3 else float(np.sin(i)) for i in range(300)], "none": [None] * 90}
    series |= {"nan": [*series["S0"][:1], float("nan"), *map(float, range(100))], None: [float(i % 5) for i in range(100)]}
    rows = [(k, start + dt.timedelta(days=i), None if v is None else float(v)) for k, x in series.items() for i, v in enumerate(x)]
    return series, spark.createDataFrame(rows, "symbol string, event_time timestamp, close double").repartition(5)


def test_hurst_of_odd_series(spark):
    series, df = _odd_series(spark)
    got = {r["symbol"]: r["hurst"] for r in stationarity.hurst(df, ["symbol"]).collect()}
    assert got.keys() == series.keys()
    for name, values in series.items():
        n, points = sum(v is not None for v in values), []
        for k in range(2, max(3, min(n // 10, stationarity.MAX_LAGS))):
            steps = [a - b for a, b in zip(values[k:], values) if a is not None and b is not None]
            if steps and np.var(steps) > 0:
                points.append((math.log(k), math.log(np.var(steps))))
        want = 0.5
        if name is not None and n >= 60 and len(points) >= 2:
            want = min(max(np.polyfit(*zip(*points), 1)[0] / 2, 0.0), 1.0)
        assert abs(got[name] - (1.0 if name == "nan" else want)) < 1e-9, name


def test_assessment_reads_a_series_once(spark):
    _, df = _odd_series(spark)
    done = stationarity.assess(df)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1 and "Window" not in plan and "Join" not in plan
    whole = sorted(map(tuple, done.collect()))
    tests = stationarity.unit_root_tests(df, ["symbol"]).join(stationarity.hurst(df, ["symbol"]), "symbol")
    assert sorted(map(tuple, tests.collect())) == [r[:4] for r in whole] and len(whole) == 24
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        for rows in ("1", "13"):
            spark.conf.set(size, rows)
            assert sorted(map(tuple, stationarity.assess(df).collect())) == whole
    finally:
        spark.conf.set(size, before)


def test_gated_reversion_sees_its_view_once(spark):
    from tickloom.plans import REGISTRY

    plan = REGISTRY["po7_gated_reversion"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Generate explode(CASE") == 1


def test_keyed_permutation_is_one(spark):
    rows = [(n, i, b) for n in (1, 2, 3, 17, 83) for i in range(n) for b in range(200)]
    df = spark.createDataFrame(rows, "n bigint, i bigint, b bigint")
    got = resampling.permuted(resampling.keyed(df, F.col("b") * 1000003 + 7), "i", "n", "at").collect()
    places = {}
    for r in got:
        places.setdefault((r["n"], r["b"]), []).append(r["at"])
    assert all(sorted(p) == list(range(n)) for (n, _), p in places.items())
    # every row goes everywhere about equally often, and two rows move independently
    counts = np.zeros((17, 17))
    for r in got:
        if r["n"] == 17:
            counts[r["i"], r["at"]] += 1
    assert ((counts - 200 / 17) ** 2 / (200 / 17)).sum() < 16 * 16 + 4 * math.sqrt(2 * 16 * 16)


def test_permutation_test_tells_signal_from_noise(spark):
    rng = np.random.default_rng(8)
    start = dt.datetime(2020, 1, 1)
    bench = rng.normal(0, 0.01, 250)
    series = {"better": bench + 0.003 + rng.normal(0, 0.002, 250), "same": rng.permutation(bench)}
    rows = [(k, start + dt.timedelta(days=i), float(x)) for k, v in series.items() for i, x in enumerate(v)]
    returns = spark.createDataFrame(rows, "name string, event_time timestamp, ret double")
    base = spark.createDataFrame([(start + dt.timedelta(days=i), float(x)) for i, x in enumerate(bench)], "event_time timestamp, ret double")
    got = {r["name"]: r for r in resampling.permutation_test(returns, base, ["name"], 500).collect()}
    assert got["better"]["p_value"] < 0.02 and 0.3 < got["same"]["p_value"] < 0.7 and abs(got["same"]["observed"]) < 1e-9
