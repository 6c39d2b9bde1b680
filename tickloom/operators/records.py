"""Research records: append-only tables and the questions asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MIN_MECHANISM = 80
PERIODS = (("DEVELOPMENT", "dev_start", "dev_end"), ("VALIDATION", "val_start", "val_end"), ("LOCKED_TEST", "test_start", "test_end"))


def hypothesis_violations(hypotheses: DataFrame) -> DataFrame:
    """Name the rule a hypothesis breaks; null when it may be registered."""
    c = F.col
    ordered = (
        (c("dev_start") < c("dev_end")) & (c("dev_end") <= c("val_start")) & (c("val_start") < c("val_end"))
        & (c("val_end") <= c("test_start")) & (c("test_start") < c("test_end"))
    )
    return hypotheses.withColumn(
        "violation",
        F.when(F.length(F.trim("economic_mechanism")) < MIN_MECHANISM, "mechanism_too_thin")
        .when(F.trim("statement") == "", "empty_statement")
        .when(~ordered, "periods_not_ordered"),
    )


def period_of(day: Column) -> Column:
    """Period a date belongs to (half-open); null outside all of them."""
    out = F.lit(None).cast("string")
    for name, start, end in PERIODS:
        out = F.when((F.col(start) <= day) & (day < F.col(end)), name).otherwise(out)
    return out


def period_mismatches(experiments: DataFrame, hypotheses: DataFrame, day: str) -> DataFrame:
    """Experiments that ran outside the period they declare."""
    joined = experiments.join(hypotheses, "hypothesis_id").withColumn("actual", period_of(F.col(day)))
    return joined.where(F.coalesce(F.col("actual"), F.lit("NONE")) != F.col("period"))


def trial_counts(experiments: DataFrame) -> DataFrame:
    """Trials per hypothesis, counted rather than kept."""
    return experiments.groupBy("hypothesis_id").agg(F.count(F.lit(1)).alias("n_trials"))


def repeated_locked_tests(access: DataFrame) -> DataFrame:
    """Strategies that opened the locked test more than once."""
    return access.groupBy("strategy_id").agg(F.count(F.lit(1)).alias("accesses")).where("accesses > 1")


def locked_test_leaks(experiments: DataFrame, access: DataFrame) -> DataFrame:
    """Locked-test experiments without an access record."""
    locked = experiments.where(F.col("period") == "LOCKED_TEST")
    return locked.join(access.select("experiment_id"), "experiment_id", "left_anti").select("experiment_id", "created_at")


def insert_new(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Add rows whose key is not there yet; the first of a key wins."""
    first = W.partitionBy(*keys).orderBy(order)
    once = new.withColumn("_r", F.row_number().over(first)).where(F.col("_r") == 1).drop("_r")
    return existing.unionByName(once.join(existing.select(*keys), keys, "left_anti"))


def latest_results(results: DataFrame, order: str = "run_at") -> DataFrame:
    """One gauntlet result per experiment and test: the latest overwrites."""
    newest = W.partitionBy("experiment_id", "test_name").orderBy(F.desc(order))
    return results.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") == 1).drop("_r")


def metric_violations(metrics: DataFrame) -> DataFrame:
    """Domain rules of a metrics row."""
    c = F.col
    return metrics.withColumn(
        "violation",
        F.when(c("max_drawdown") > 0, "drawdown_positive")
        .when(c("volatility") < 0, "volatility_negative")
        .when(c("turnover") < 0, "turnover_negative")
        .when(~c("hit_rate").between(0, 1), "hit_rate_out_of_range")
        .when(c("n_trades") < 0, "trades_negative"),
    )


def rejections_by_stage(rejections: DataFrame) -> DataFrame:
    """What kills ideas: rejections and hypotheses per stage."""
    return rejections.groupBy("killed_at_stage").agg(
        F.count(F.lit(1)).alias("rejections"), F.countDistinct("hypothesis_id").alias("hypotheses")
    )


def resolve(hypotheses: DataFrame, decisions: DataFrame) -> DataFrame:
    """Close hypotheses: status and resolution time from the latest decision."""
    last = decisions.groupBy("hypothesis_id").agg(F.max_by(F.struct("status", "resolved_at"), "resolved_at").alias("_d"))
    joined = hypotheses.drop("status", "resolved_at").join(last, "hypothesis_id", "left")
    return joined.select(
        *[c for c in hypotheses.columns if c not in ("status", "resolved_at")],
        F.coalesce("_d.status", F.lit("OPEN")).alias("status"),
        F.col("_d.resolved_at").alias("resolved_at"),
    )


def fingerprint(columns: list[str]) -> Column:
    """Hash of the named inputs as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def observed_sessions(panel: DataFrame) -> DataFrame:
    """Instruments seen per exchange and session."""
    exchange = F.split("instrument_id", ":")[0]
    return panel.groupBy(exchange.alias("exchange"), "session").agg(F.countDistinct("instrument_id").alias("instruments"))


def open_incidents(log: DataFrame, entity: str) -> DataFrame:
    """Unresolved incidents, newest first."""
    return log.where(F.col("resolved_at").isNull()).orderBy(F.desc("opened_at"), entity)


def audit_trail(log: DataFrame, by: str) -> DataFrame:
    """Entries and the latest one per entity or actor."""
    return log.groupBy(by).agg(F.count(F.lit(1)).alias("entries"), F.max("at").alias("latest"))
