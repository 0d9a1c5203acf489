"""The plans are the ones meant: filters and columns reach the scan, no Python, no joins of everything with everything."""

import re

import pytest

from tidemark import queries

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "pushed"), [("E09_date_filter", r"GreaterThanOrEqual\(o_orderdate"), ("A18_partition_filter_guard", r"GreaterThanOrEqual\(ts"), ("B23_safety_buffer", r"LessThanOrEqual\(ts"), ("C01_timestamp", r"GreaterThan\(o_orderdate"), ("F09_semi_join", r"LessThan\(c_acctbal"), ("B22_high_water", r"GreaterThan\(o_orderdate")])
def test_filters_reach_the_scan(spark, name, pushed):
    assert re.search(rf"PushedFilters: \[[^\]]*{pushed}", plan(spark, name))


@pytest.mark.parametrize(("name", "columns"), [("G02_count_distinct", {"l_returnflag", "l_suppkey", "l_partkey"}), ("G17_weighted_average", {"l_linestatus", "l_extendedprice", "l_quantity"}), ("I03_top_k", {"o_orderkey", "o_totalprice"}), ("G13_having", {"o_custkey"})])
def test_only_needed_columns_are_read(spark, name, columns):
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, name))
    assert read and all({c.split(":")[0] for c in r.split(",")} == columns for r in read)


@pytest.mark.parametrize(("name", "node"), [("H01_row_number", "WindowGroupLimit"), ("I04_top_k_per_group", "WindowGroupLimit"), ("I03_top_k", "TakeOrderedAndProject"), ("F09_semi_join", "LeftSemi"), ("F07_anti_join", "LeftAnti"), ("C07_log_current_state", "WindowGroupLimit"), ("G01_basic_aggregates", "partial_")])
def test_operators_are_the_ones_meant(spark, name, node):
    assert node in plan(spark, name)


@pytest.mark.parametrize("name", ["S07_monthly_revenue_fact", "C16_snapshot_diff", "D01_scd2", "B03_merge_upsert", "P05_derived_offset", "P04_cumulative", "S01_rfm_segments", "Q04_z_scores", "C12_categorized_risk", "L25_validators", "O13_contract"])
def test_no_python_and_no_cartesian_products(spark, name):
    shown = plan(spark, name)
    assert not re.search(r"Python|Pandas|MapInArrow|CartesianProduct", shown)


def test_upsert_does_not_shuffle_the_target_for_a_small_batch(spark):
    from pyspark.sql import functions as F

    from tidemark.operators.incremental import upsert

    target = spark.read.parquet(f"{SF}/lineitem.parquet").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")).select("l_orderkey", "q")
    target.write.mode("overwrite").saveAsTable("physical_target")
    table = spark.table("physical_target")
    batch = F.broadcast(table.limit(5))
    shown = upsert(table, batch, ["l_orderkey"])._jdf.queryExecution().executedPlan().toString()
    first = shown.split("Union")[1].split("LeftAnti")[0]
    assert "BroadcastHashJoin" in first and "SortMergeJoin" not in first and "FullOuter" not in shown
    spark.sql("DROP TABLE physical_target")


def test_cumulative_metrics_read_their_windows_only(spark):
    """Thirty days before the first day asked for, and nothing after the last; no scan without a bound."""
    shown = plan(spark, "P04_cumulative")
    scans = shown.count("FileScan parquet")
    assert scans >= 2 and shown.count("GreaterThanOrEqual(o_orderdate,1997-01-31") == scans


def test_cumulative_metrics_with_both_dates_run_nothing_while_planned(spark):
    from tidemark.plans.semantic import MetricQuery
    from tidemark.queries.base import Tables
    from tidemark.queries.metrics import registry

    def jobs(end):
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
        registry(Tables(spark, SF)).query(MetricQuery(["customers_30d"], start_date="1997-03-01", end_date=end, granularity="day"))
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before

    assert jobs("1997-04-30") < jobs(None)


def test_cumulative_metrics_by_a_dimension_need_no_cross_join(spark):
    assert "NestedLoop" not in plan(spark, "P04c_by_dimension")


@pytest.mark.parametrize("name", ["P09_trend_stats", "A15_tiering"])
def test_no_window_over_all_rows(spark, name):
    assert "Window" not in plan(spark, name)


def test_tiers_come_from_one_scan(spark):
    assert plan(spark, "A15_tiering").count("FileScan parquet") == 1
