"""Health, service levels, anomalies and costs from logs of runs and changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.columns import bucket, ladder
from tidemark.operators.relational import moving


def z_scores(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], back: int = 30, limit: float = 3.0) -> DataFrame:
    """Mean and deviation of the back rows before each row, its z-score and an anomaly level."""
    mean, dev = moving(F.avg(value), keys, order, back, -1), moving(F.stddev(value), keys, order, back, -1)
    out = df.withColumn("trailing_avg", F.round(mean, 6)).withColumn("trailing_std", F.round(dev, 6))
    z = F.round(F.try_divide(F.col(value) - mean, dev), 4)
    level = F.when(F.abs("z_score") > limit, "critical").when(F.abs("z_score") > limit - 1, "warning").otherwise("normal")
    return out.withColumn("z_score", z).withColumn("anomaly", level)


def runtime_anomalies(runs: DataFrame, model: str, seconds: str, order: Sequence[str], back: int = 10, least: float = 60.0) -> DataFrame:
    """Runs of least seconds or more against the average of the back runs before: severity from twice on, critical from 4."""
    avg = moving(F.avg(seconds), [model], order, back, -1)
    out = runs.withColumn("trailing_avg", F.round(avg, 6)).withColumn("ratio", F.round(F.try_divide(F.col(seconds), avg), 4))
    hit = out.filter((F.col("ratio") >= 2.0) & (F.col(seconds) >= least))
    return hit.withColumn("severity", ladder("ratio", [(4.0, "critical"), (3.0, "high")], "medium"))


def sla(found: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Measured (lag_minutes, success_rate, run_seconds) against targets (max_lag, min_success, max_run)."""
    met = found.join(targets, key, "left")
    breach = [F.col("lag_minutes") > F.col("max_lag"), F.col("success_rate") < F.col("min_success"), F.col("run_seconds") > F.col("max_run")]
    n = sum((F.when(b, 1).otherwise(0) for b in breach[1:]), F.when(breach[0], 1).otherwise(0))
    out = met.withColumn("breaches", n).withColumn("lag_ratio", F.round(F.try_divide(F.col("lag_minutes"), F.col("max_lag")), 4))
    status = F.when(F.col("max_lag").isNull(), "unknown").when(F.col("breaches") == 0, "compliant").otherwise("breach")
    return out.withColumn("sla_status", status).withColumn("priority", F.when(F.col("breaches") >= 2, "P1").when(F.col("breaches") == 1, "P2").otherwise("P4"))


def throughput_class(rows_per_second: Column) -> Column:
    return F.when(rows_per_second < 100, "slow").when(rows_per_second > 1000, "high").otherwise("normal")


def partition_advice(rows: Column) -> Column:
    return F.when(rows > 100_000, "smaller_partitions").when(rows < 1_000, "larger_partitions").otherwise("keep")


def runtime_class(seconds: Column) -> Column:
    return F.when(seconds > 300, "very_slow").when(seconds > 120, "slow").when(seconds > 30, "moderate").otherwise("fast")


def with_daily_change(df: DataFrame, value: str, keys: Sequence[str], order: str) -> DataFrame:
    """The value before, the change and the change in percent; the first has change from 0."""
    w = W.partitionBy(*keys).orderBy(order)
    before = F.lag(value, 1, 0).over(w)
    return df.withColumn("previous", before).withColumn("change", F.col(value) - before).withColumn("change_pct", F.round(F.try_divide(F.col(value) - before, before) * 100, 4))


def trend(now: Column, before: Column, tolerance: float = 0.05) -> Column:
    ratio = F.try_divide(now - before, before)
    return F.when(ratio > tolerance, "increasing").when(ratio < -tolerance, "decreasing").otherwise("stable")


def sample_percent(df: DataFrame, key: str, percent: int) -> DataFrame:
    """The rows whose key falls into so many of 100 buckets; the same on every run."""
    return df if percent >= 100 else df.filter(bucket(key, 100) < percent)
