"""The metric layer."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import relational as R
from tidemark.plans import semantic as S
from tidemark.queries.base import query


def registry(t, row_filters=None) -> S.Registry:
    """Orders and customers as semantic models, and metrics of every kind over them."""
    orders = S.SemanticModel(
        "orders",
        lambda: t.orders,
        [S.Entity("order", "primary", "o_orderkey"), S.Entity("customer", "foreign", "o_custkey")],
        [S.Dimension("order_status", expr="o_orderstatus"), S.Dimension("priority", expr="o_orderpriority"), S.Dimension("size_class", expr="case when o_totalprice > 150000 then 'large' else 'small' end"), S.Dimension("ordered_at", "time", "o_orderdate")],
        [S.Measure("revenue", "sum", "o_totalprice"), S.Measure("order_count", "count", "o_orderkey"), S.Measure("customers", "count_distinct", "o_custkey"), S.Measure("average_price", "average", "o_totalprice")],
        time="o_orderdate",
    )
    customers = S.SemanticModel("customers", lambda: t.customer, [S.Entity("customer", "primary", "c_custkey")], [S.Dimension("segment", expr="c_mktsegment"), S.Dimension("in_debt", expr="c_acctbal < 0")], [S.Measure("customer_count", "count", "c_custkey")])
    metrics = [
        S.Metric("total_revenue", "simple", measure="revenue", tier=1, owner="finance"),
        S.Metric("orders", "simple", measure="order_count"),
        S.Metric("unique_customers", "simple", measure="customers"),
        S.Metric("final_revenue", "simple", measure="revenue", filter="{{ Dimension('order__order_status') }} = 'F'"),
        S.Metric("building_revenue", "simple", measure="revenue", filter="{{ Dimension('customer__segment') }} = 'BUILDING'"),
        S.Metric("average_order_value", "ratio", numerator="total_revenue", denominator="orders"),
        S.Metric("final_share", "ratio", numerator="final_revenue", denominator="total_revenue"),
        S.Metric("revenue_to_date", "cumulative", measure="revenue"),
        S.Metric("orders_30d", "cumulative", measure="order_count", window_days=30),
        S.Metric("customers_30d", "cumulative", measure="customers", window_days=30),
        S.Metric("revenue_growth", "derived", expr="try_divide(now - before, before)", inputs={"now": ("total_revenue", 0), "before": ("total_revenue", 364)}),
        S.Metric("revenue_per_customer", "derived", expr="try_divide(revenue, customers)", inputs={"revenue": ("total_revenue", 0), "customers": ("unique_customers", 0)}),
        S.Metric("unresolved", "simple", measure="net_revenue_retention"),
    ]
    return S.Registry([orders, customers], metrics, row_filters)


def _rounded(df, **places):
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


@query("F15_entity_join", "SELECT c_mktsegment AS segment, round(sum(o_totalprice), 2) AS total_revenue FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def _(t):
    return _rounded(registry(t).query(S.MetricQuery(["total_revenue"], ["segment"])), total_revenue=2)


@query("P01_semantic_measures", "SELECT o_orderpriority AS priority, round(sum(o_totalprice), 2) AS total_revenue, count(o_orderkey) AS orders, count(DISTINCT o_custkey) AS unique_customers FROM orders GROUP BY 1")
def _(t):
    return _rounded(registry(t).query(S.MetricQuery(["total_revenue", "orders", "unique_customers"], ["priority"])), total_revenue=2)


@query("P02_simple_filtered", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS metric_time, round(sum(o_totalprice), 2) AS building_revenue FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
def _(t):
    return _rounded(registry(t).query(S.MetricQuery(["building_revenue"], granularity="month")), building_revenue=2)


@query("P03_ratio", "SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS metric_time, round(sum(o_totalprice) / count(o_orderkey), 7) AS average_order_value, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') / sum(o_totalprice), 8) AS final_share FROM orders GROUP BY 1")
def _(t):
    return _rounded(registry(t).query(S.MetricQuery(["average_order_value", "final_share"], granularity="quarter")), average_order_value=7, final_share=8)


@query("P04_cumulative", """WITH days AS (SELECT CAST(d AS DATE) AS metric_time FROM generate_series(DATE '1997-03-01', DATE '1997-04-30', INTERVAL 1 DAY) s(d))
  SELECT metric_time, (SELECT count(*) FROM orders WHERE CAST(o_orderdate AS DATE) <= metric_time AND CAST(o_orderdate AS DATE) > metric_time - 30) AS orders_30d, (SELECT count(DISTINCT o_custkey) FROM orders WHERE CAST(o_orderdate AS DATE) <= metric_time AND CAST(o_orderdate AS DATE) > metric_time - 30) AS customers_30d FROM days""")
def _(t):
    return registry(t).query(S.MetricQuery(["orders_30d", "customers_30d"], start_date="1997-03-01", end_date="1997-04-30", granularity="day"))


@query("P04c_by_dimension", """WITH days AS (SELECT CAST(d AS DATE) AS metric_time FROM generate_series(DATE '1997-03-01', DATE '1997-04-30', INTERVAL 1 DAY) s(d))
  SELECT metric_time, o_orderstatus AS order_status, count(*) AS orders_30d, count(DISTINCT o_custkey) AS customers_30d FROM days JOIN orders ON CAST(o_orderdate AS DATE) <= metric_time AND CAST(o_orderdate AS DATE) > metric_time - 30 GROUP BY 1, 2""")
def _(t):
    return registry(t).query(S.MetricQuery(["orders_30d", "customers_30d"], ["order_status"], "1997-03-01", "1997-04-30", "day"))


@query("P04b_all_time", "SELECT CAST(o_orderdate AS DATE) AS metric_time, round(sum(sum(o_totalprice)) OVER (ORDER BY CAST(o_orderdate AS DATE)), 2) AS revenue_to_date FROM orders GROUP BY 1")
def _(t):
    made = registry(t).query(S.MetricQuery(["revenue_to_date"], granularity="day"))
    days = t.orders.select(F.to_date("o_orderdate").alias("metric_time")).distinct()
    return _rounded(made.join(days, "metric_time", "left_semi"), revenue_to_date=2)


@query("P05_derived_offset", """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS r, count(DISTINCT o_custkey) AS c FROM orders GROUP BY 1)
  SELECT coalesce(a.day, b.day) AS metric_time, round((a.r - b.r) / b.r, 8) AS revenue_growth, round(a.r / a.c, 4) AS revenue_per_customer FROM (SELECT * FROM d WHERE day BETWEEN DATE '1998-01-01' AND DATE '1998-03-31') a FULL JOIN (SELECT day + 364 AS day, r FROM d WHERE day + 364 BETWEEN DATE '1998-01-01' AND DATE '1998-03-31') b ON a.day = b.day""")
def _(t):
    made = registry(t).query(S.MetricQuery(["revenue_growth", "revenue_per_customer"], start_date="1998-01-01", end_date="1998-03-31", granularity="day"))
    return _rounded(made, revenue_growth=8, revenue_per_customer=4)


@query("P06_metric_query", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS metric_time, o_orderpriority AS priority, round(sum(o_totalprice), 2) AS total_revenue, count(o_orderkey) AS orders FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY' AND o_orderdate >= TIMESTAMP '1998-01-01' AND CAST(o_orderdate AS DATE) <= DATE '1998-12-31' GROUP BY 1, 2 ORDER BY 3 DESC LIMIT 20")
def _(t):
    q = S.MetricQuery(["total_revenue", "orders"], ["priority"], "1998-01-01", "1998-12-31", "month", ["{{ Dimension('customer__segment') }} = 'MACHINERY'"], ["-total_revenue"], 20)
    return _rounded(registry(t).query(q), total_revenue=2)


@query("P06b_long_form", "SELECT 'orders' AS metric_name, o_orderstatus AS order_status, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 2 UNION ALL SELECT 'unique_customers', o_orderstatus, CAST(count(DISTINCT o_custkey) AS DOUBLE) FROM orders GROUP BY 2")
def _(t):
    return registry(t).query_long(S.MetricQuery(["orders", "unique_customers"], ["order_status"]))


@query("P08_period_comparison", "SELECT count(*) AS orders, 'current' AS period FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-02-01' AND DATE '1998-02-28' UNION ALL SELECT count(*), 'previous_period' FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-01-04' AND DATE '1998-01-31' UNION ALL SELECT count(*), 'year_over_year' FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-02-01' AND DATE '1997-02-28'")
def _(t):
    r, q = registry(t), S.MetricQuery(["orders"], start_date="1998-02-01", end_date="1998-02-28")
    return r.compare(q).unionByName(r.compare(q, "year_over_year").filter("period <> 'current'"))


@query("P09_trend_stats", """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), e AS (SELECT n, row_number() OVER (ORDER BY day) AS up, row_number() OVER (ORDER BY day DESC) AS down FROM d), s AS (SELECT avg(n) AS mean, stddev_pop(n) AS std, avg(n) FILTER (WHERE up <= 7) AS first_avg, avg(n) FILTER (WHERE down <= 7) AS last_avg FROM e)
  SELECT round(mean, 6) AS mean, round(std, 6) AS std, round(std / mean, 6) AS cv, CASE WHEN last_avg > first_avg THEN 'up' WHEN last_avg < first_avg THEN 'down' ELSE 'flat' END AS direction, CASE WHEN std / mean > 0.3 THEN 'high' WHEN std / mean > 0.1 THEN 'medium' ELSE 'low' END AS volatility FROM s""")
def _(t):
    daily = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return _rounded(S.trend_stats(daily, "n", "day"), mean=6, std=6, cv=6).select("mean", "std", "cv", "direction", "volatility")


@query("P10_time_spine", """WITH s AS (SELECT CAST(x AS DATE) AS d FROM generate_series(DATE '2020-01-01', DATE '2030-12-31', INTERVAL 1 DAY) g(x))
  SELECT d AS date_day, year(d) AS year, quarter(d) AS quarter, dayofweek(d) AS day_of_week, dayofyear(d) AS day_of_year, strftime(d, '%Y-%m-%d') AS iso_date, dayname(d) AS day_name, dayofweek(d) IN (0, 6) AS is_weekend, strftime(d, '%m-%d') IN ('01-01', '07-04', '12-25') AS is_holiday, CAST(date_trunc('month', d) AS DATE) AS month_start, last_day(d) AS month_end,
    CAST(date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarter_end, CASE WHEN month(d) IN (12, 1, 2) THEN 'winter' WHEN month(d) <= 5 THEN 'spring' WHEN month(d) <= 8 THEN 'summer' ELSE 'autumn' END AS season, year(d) + CASE WHEN month(d) >= 4 THEN 1 ELSE 0 END AS fiscal_year, ((month(d) + 8) % 12) // 3 + 1 AS fiscal_quarter, d - 7 AS prior_week,
    CASE WHEN dayofweek(d) NOT IN (0, 6) THEN day(d) END AS day_ordinal, CASE WHEN dayofweek(d) NOT IN (0, 6) THEN count(*) FILTER (WHERE dayofweek(d) NOT IN (0, 6)) OVER (PARTITION BY date_trunc('month', d) ORDER BY d) END AS business_day FROM s""")
def _(t):
    spine = S.time_spine(t.spark, "2020-01-01", "2030-12-31")
    return spine.select("date_day", "year", "quarter", "day_of_week", "day_of_year", "iso_date", "day_name", "is_weekend", "is_holiday", "month_start", "month_end", "quarter_end", "season", "fiscal_year", "fiscal_quarter", "prior_week", "day_ordinal", "business_day")


_ROLLUP = """daily AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderstatus AS status, o_orderpriority AS priority, c_mktsegment AS segment, count(*) AS orders, sum(o_totalprice) AS revenue, count(DISTINCT o_custkey) AS customers, count(*) FILTER (WHERE o_totalprice > 150000) AS large_orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4)"""


def _daily(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("revenue"), F.countDistinct("o_custkey").alias("customers"), F.count_if(F.col("o_totalprice") > 150000).alias("large_orders"))


@query("P11_daily_rollup", f"WITH {_ROLLUP} SELECT day, status, priority, segment, orders, round(revenue, 2) AS revenue, customers, large_orders, round(revenue / orders, 4) AS average_value, lag(orders) OVER (PARTITION BY status, priority, segment ORDER BY day) AS orders_before FROM daily")
def _(t):
    w = W.partitionBy("status", "priority", "segment").orderBy("day")
    made = _daily(t).withColumn("average_value", F.round(F.try_divide("revenue", "orders"), 4)).withColumn("orders_before", F.lag("orders").over(w))
    return made.withColumn("revenue", F.round("revenue", 2))


@query("P12_monthly_rollup", f"WITH {_ROLLUP}, m AS (SELECT CAST(date_trunc('month', day) AS DATE) AS month, segment, CAST(sum(orders) AS BIGINT) AS orders, sum(revenue) AS revenue, CAST(sum(customers) AS BIGINT) AS sum_daily_unique FROM daily GROUP BY 1, 2) SELECT month, segment, orders, round(revenue, 2) AS revenue, sum_daily_unique, round((revenue - lag(revenue) OVER w) / lag(revenue) OVER w * 100, 4) AS growth_pct FROM m WINDOW w AS (PARTITION BY segment ORDER BY month)")
def _(t):
    monthly = _daily(t).groupBy(F.trunc("day", "month").alias("month"), "segment").agg(F.sum("orders").alias("orders"), F.sum("revenue").alias("revenue"), F.sum("customers").alias("sum_daily_unique"))
    before = F.lag("revenue").over(W.partitionBy("segment").orderBy("month"))
    return monthly.withColumn("growth_pct", F.round(F.try_divide(F.col("revenue") - before, before) * 100, 4)).withColumn("revenue", F.round("revenue", 2))


@query("P13_cohort_retention", """WITH f AS (SELECT o_custkey, min(date_trunc('month', o_orderdate)) AS cohort FROM orders GROUP BY 1), s AS (SELECT cohort, count(*) AS size FROM f GROUP BY 1), a AS (SELECT cohort, date_diff('month', cohort, date_trunc('month', o_orderdate)) AS period, count(DISTINCT o.o_custkey) AS active FROM orders o JOIN f ON o.o_custkey = f.o_custkey GROUP BY 1, 2)
  SELECT CAST(cohort AS DATE) AS cohort, period, active, size, round(active / size, 6) AS retention FROM a JOIN s USING (cohort)""")
def _(t):
    from tidemark.functions.columns import months_between_starts

    first = t.orders.groupBy("o_custkey").agg(F.trunc(F.min("o_orderdate"), "month").alias("cohort"))
    sizes = first.groupBy("cohort").agg(F.count("*").alias("size"))
    active = t.orders.join(first, "o_custkey").groupBy("cohort", months_between_starts("o_orderdate", "cohort").alias("period")).agg(F.countDistinct("o_custkey").alias("active"))
    return active.join(sizes, "cohort").withColumn("retention", F.round(F.try_divide("active", "size"), 6))


@query("P14_query_performance", """SELECT run_id, CASE WHEN seconds < 1 THEN 'instant' WHEN seconds < 10 THEN 'fast' WHEN seconds < 60 THEN 'medium' ELSE 'slow' END AS tier, avg(n_rows) OVER w AS rolling_rows, seconds > 1.5 * avg(seconds) OVER w AS regression FROM runs WINDOW w AS (PARTITION BY model_name ORDER BY run_at, run_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""", "runs")
def _(t):
    avg = R.moving(F.avg("seconds"), ["model_name"], ["run_at", "run_id"], 99)
    tier = F.when(F.col("seconds") < 1, "instant").when(F.col("seconds") < 10, "fast").when(F.col("seconds") < 60, "medium").otherwise("slow")
    return t.runs.select("run_id", tier.alias("tier"), R.moving(F.avg("n_rows"), ["model_name"], ["run_at", "run_id"], 99).alias("rolling_rows"), (F.col("seconds") > F.lit(1.5) * avg).alias("regression"))


@query("P15_cache_ranking", "SELECT model_name, status, count(*) AS n, round(count(*) * avg(seconds), 2) AS score FROM runs GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY 4 DESC, 1 LIMIT 50", "runs")
def _(t):
    made = t.runs.groupBy("model_name", "status").agg(F.count("*").alias("n"), F.round(F.count("*") * F.avg("seconds"), 2).alias("score")).filter("n > 1")
    return R.top_k(made, [F.col("score").desc(), F.col("model_name")], 50)


@query("P16_quality_dashboard", """SELECT 'freshness_days' AS check_name, CAST(date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2001-08-01') AS DOUBLE) AS value FROM orders UNION ALL SELECT 'null_rate', round(count(*) FILTER (WHERE o_orderkey % 17 = 0) / count(*), 8) FROM orders UNION ALL SELECT 'rollup_variance', 0.0""")
def _(t):
    one = t.orders.agg(F.datediff(F.lit("2001-08-01").cast("date"), F.to_date(F.max("o_orderdate"))).cast("double").alias("f"), F.round(F.count_if(F.col("o_orderkey") % 17 == 0) / F.count("*"), 8).alias("n"), F.count("*").alias("base"))
    rolled = _daily(t).agg(F.sum("orders").alias("rolled"))
    rows = F.array(F.struct(F.lit("freshness_days").alias("check_name"), F.col("f").alias("value")), F.struct(F.lit("null_rate").alias("check_name"), F.col("n").alias("value")), F.struct(F.lit("rollup_variance").alias("check_name"), (F.col("rolled") - F.col("base")).cast("double").alias("value")))
    return one.crossJoin(rolled).select(F.inline(rows))


@query("P17_metric_anomalies", """WITH h AS (SELECT date_trunc('hour', ts) AS hr, event_type, sum(value) AS total FROM events GROUP BY 1, 2) SELECT hr, event_type, round(avg(total) OVER (PARTITION BY event_type ORDER BY hr ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 6) AS avg24, total > 2 * avg(total) OVER (PARTITION BY event_type ORDER BY hr ROWS BETWEEN 167 PRECEDING AND 1 PRECEDING) AS spike FROM h""")
def _(t):
    hourly = t.events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hr"), "event_type").agg(F.sum("value").alias("total"))
    return hourly.select("hr", "event_type", F.round(R.moving(F.avg("total"), ["event_type"], ["hr"], 23), 6).alias("avg24"), (F.col("total") > 2 * R.moving(F.avg("total"), ["event_type"], ["hr"], 167, -1)).alias("spike"))


@query("P18_error_patterns", """WITH e AS (SELECT user_id, count(*) AS errors, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS late FROM events WHERE event_type = 'error' GROUP BY 1) SELECT user_id, errors, CASE WHEN late * 2 > errors THEN 'rising' WHEN late * 2 < errors THEN 'falling' ELSE 'steady' END AS trend, CASE WHEN errors > 16 THEN 'investigate' ELSE 'watch' END AS advice FROM e""")
def _(t):
    e = t.events.filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("errors"), F.count_if(F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")).alias("late"))
    trend = F.when(F.col("late") * 2 > F.col("errors"), "rising").when(F.col("late") * 2 < F.col("errors"), "falling").otherwise("steady")
    return e.select("user_id", "errors", trend.alias("trend"), F.when(F.col("errors") > 16, "investigate").otherwise("watch").alias("advice"))


@query("P19_user_engagement", "SELECT user_id, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days, CASE WHEN count(DISTINCT CAST(ts AS DATE)) >= 27 THEN 'power' WHEN count(DISTINCT CAST(ts AS DATE)) >= 20 THEN 'regular' ELSE 'casual' END AS segment FROM events GROUP BY 1")
def _(t):
    made = t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct(F.to_date("ts")).alias("days"))
    return made.withColumn("segment", F.when(F.col("days") >= 27, "power").when(F.col("days") >= 20, "regular").otherwise("casual"))


@query("P20_model_health", "SELECT model_name, concat_ws(',', CASE WHEN count(*) FILTER (WHERE status = 'error') > 0 THEN 'errors' END, CASE WHEN max(seconds) > 300 THEN 'slow_runs' END) AS issues, round(100.0 * count(*) FILTER (WHERE status = 'success') / count(*), 6) AS health FROM runs GROUP BY 1", "runs")
def _(t):
    from tidemark.functions.columns import named_list

    bad = F.count_if(F.col("status") == "error")
    made = t.runs.groupBy("model_name").agg(bad.alias("bad"), F.max("seconds").alias("slowest"), F.round(F.try_divide(F.count_if(F.col("status") == "success") * 100.0, F.count("*")), 6).alias("health"))
    return made.select("model_name", named_list(("errors", F.col("bad") > 0), ("slow_runs", F.col("slowest") > 300)).alias("issues"), "health")


@query("P21_critical_alerts", "SELECT 'too_many_errors' AS alert, 'critical' AS severity FROM runs HAVING count(*) FILTER (WHERE status = 'error') > 10 UNION ALL SELECT 'never' AS alert, 'info' FROM runs HAVING count(*) < 0", "runs")
def _(t):
    a = t.runs.agg(F.count_if(F.col("status") == "error").alias("n")).filter("n > 10").select(F.lit("too_many_errors").alias("alert"), F.lit("critical").alias("severity"))
    b = t.runs.agg(F.count("*").alias("n")).filter("n < 0").select(F.lit("never").alias("alert"), F.lit("info").alias("severity"))
    return R.union_all(a, b)


@query("P22_metric_lint", "SELECT 'unresolved: unknown measure net_revenue_retention' AS problem")
def _(t):
    from tidemark.sources.registry import values

    return values(t.spark, [(p,) for p in registry(t).lint()], "problem string")


@query("P07_discovery", "SELECT * FROM (VALUES ('average_order_value', 'ratio'), ('building_revenue', 'simple'), ('customers_30d', 'cumulative'), ('final_revenue', 'simple'), ('final_share', 'ratio'), ('orders', 'simple'), ('orders_30d', 'cumulative'), ('revenue_growth', 'derived'), ('revenue_per_customer', 'derived'), ('revenue_to_date', 'cumulative'), ('total_revenue', 'simple'), ('unique_customers', 'simple'), ('unresolved', 'simple')) v(metric, kind)")
def _(t):
    from tidemark.sources.registry import values

    return values(t.spark, [(m["name"], m["type"]) for m in registry(t).list_metrics()], "metric string, kind string")


