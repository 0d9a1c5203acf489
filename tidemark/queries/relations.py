"""Joins, aggregations, windows, sorting, set operations and subqueries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import relational as R
from tidemark.queries.base import query


def _n(t, *columns):
    return t.nation.select(*columns)


# joins


@query("F01_inner_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("F02_left_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")
def _(t):
    return t.customer.join(t.orders.filter("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("F03_full_outer", "SELECT coalesce(b.c_custkey, n.c_custkey) AS c_custkey, b.c_custkey IS NULL AS is_new, n.c_custkey IS NULL AS is_gone FROM before b FULL JOIN now n ON b.c_custkey = n.c_custkey", "before now")
def _(t):
    b, n = t.before.select(F.col("c_custkey").alias("b")), t.now.select(F.col("c_custkey").alias("n"))
    return b.join(n, F.col("b") == F.col("n"), "full_outer").select(F.coalesce("b", "n").alias("c_custkey"), F.col("b").isNull().alias("is_new"), F.col("n").isNull().alias("is_gone"))


@query("F04_cross_one_row", "SELECT o_orderkey, round(o_totalprice / s.total, 12) AS share FROM orders CROSS JOIN (SELECT sum(o_totalprice) AS total FROM orders) s")
def _(t):
    total = t.orders.agg(F.sum("o_totalprice").alias("total"))
    return t.orders.crossJoin(F.broadcast(total)).select("o_orderkey", F.round(F.col("o_totalprice") / F.col("total"), 12).alias("share"))


@query("F05_theta_scenarios", "SELECT scenario, target, n AS actual FROM (VALUES ('small', 100), ('medium', 1000), ('large', 100000)) v(scenario, target) CROSS JOIN (SELECT count(*) AS n FROM orders) WHERE target <= n * 1.2")
def _(t):
    from tidemark.sources.registry import values

    scenarios = values(t.spark, [("small", 100), ("medium", 1000), ("large", 100000)], "scenario string, target long")
    actual = t.orders.agg(F.count("*").alias("actual"))
    return scenarios.join(F.broadcast(actual), F.col("target") <= F.col("actual") * 1.2)


@query("F06_using", "SELECT c_custkey, b.c_acctbal AS old_balance, n.c_acctbal AS new_balance FROM before b JOIN now n USING (c_custkey)", "before now")
def _(t):
    return t.before.select("c_custkey", F.col("c_acctbal").alias("old_balance")).join(t.now.select("c_custkey", F.col("c_acctbal").alias("new_balance")), ["c_custkey"])


@query("F07_anti_join", "SELECT b.c_custkey FROM before b LEFT JOIN now n ON b.c_custkey = n.c_custkey WHERE n.c_custkey IS NULL", "before now")
def _(t):
    return t.before.join(t.now, "c_custkey", "left_anti").select("c_custkey")


@query("F08_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT NULLIF(o_custkey, 3) FROM orders WHERE o_custkey IS NOT NULL AND o_custkey <> 3)")
def _(t):
    ordered = t.orders.select(F.nullif("o_custkey", F.lit(3)).alias("k")).filter("k is not null")
    return t.customer.join(ordered, F.col("c_custkey") == F.col("k"), "left_anti").select("c_custkey")


@query("F09_semi_join", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(t):
    return t.orders.join(t.customer.filter("c_acctbal < 0"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("F10_semi_inequality", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate < o.o_orderdate)")
def _(t):
    p = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("d"))
    return t.orders.join(p, (F.col("o_custkey") == F.col("k")) & (F.col("d") < F.col("o_orderdate")), "left_semi").select("o_orderkey")


@query("F11_mark_join", "SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN 'building' ELSE 'other' END AS segment FROM orders")
def _(t):
    marked = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k")).distinct()
    return t.orders.join(marked, F.col("o_custkey") == F.col("k"), "left").select("o_orderkey", F.when(F.col("k").isNotNull(), "building").otherwise("other").alias("segment"))


@query("F12_self_join", "SELECT a.n_name AS first, b.n_name AS second FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def _(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("first"), F.col("b.n_name").alias("second"))


@query("F13_star_join", "SELECT r_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def _(t):
    star = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return star.groupBy("r_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))


@query("F14_expression_join", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON lower(replace('NATION_' || s_nationkey, '_', '-')) = replace(lower(n_name), '_', '-')")
def _(t):
    left = F.lower(F.replace(F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")), F.lit("_"), F.lit("-")))
    return t.supplier.join(t.nation, left == F.replace(F.lower("n_name"), F.lit("_"), F.lit("-"))).select("s_suppkey", "n_name")


@query("F16_lookup_join", "SELECT run_id, model_name, tier FROM runs LEFT JOIN (VALUES ('1-URGENT', 1), ('2-HIGH', 2)) v(m, tier) ON model_name = m", "runs")
def _(t):
    from tidemark.sources.registry import values

    tiers = values(t.spark, [("1-URGENT", 1), ("2-HIGH", 2)], "m string, tier long")
    return t.runs.join(F.broadcast(tiers), F.col("model_name") == F.col("m"), "left").select("run_id", "model_name", "tier")


# aggregation


@query("G01_basic_aggregates", "SELECT o_orderstatus, count(*) AS n, count(NULLIF(o_orderkey % 7, 0)) AS n_set, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count(F.nullif(F.col("o_orderkey") % 7, F.lit(0))).alias("n_set"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.min("o_orderdate").alias("first_day"), F.max("o_orderdate").alias("last_day"))


@query("G02_count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts"))


@query("G03_conditional_aggregate", "SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, round(coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0), 2) AS spent, max(CASE WHEN event_type = 'error' THEN ts END) AS last_error FROM events GROUP BY 1")
def _(t):
    bought = F.col("event_type") == "purchase"
    return t.events.groupBy("user_id").agg(F.count_if(bought).alias("purchases"), F.round(F.coalesce(F.sum(F.when(bought, F.col("value"))), F.lit(0.0)), 2).alias("spent"), F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("last_error"))


@query("G04_conditional_distinct", "SELECT CAST(ts AS DATE) AS day, count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS buyers FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy(F.to_date("ts").alias("day")).agg(F.countDistinct(F.when(F.col("event_type") == "purchase", F.col("user_id"))).alias("buyers"))


@query("G05_ratio_aggregate", "SELECT user_id, round(100.0 * count(*) FILTER (WHERE event_type = 'purchase') / NULLIF(count(*) FILTER (WHERE event_type = 'view'), 0), 6) AS conversion FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.round(F.try_divide(F.count_if(F.col("event_type") == "purchase") * 100.0, F.count_if(F.col("event_type") == "view")), 6).alias("conversion"))


@query("G06_statistics", "SELECT l_returnflag, round(stddev(l_quantity), 8) AS std, round(corr(l_quantity, l_extendedprice), 8) AS correlation, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.stddev("l_quantity"), 8).alias("std"), F.round(F.corr("l_quantity", "l_extendedprice"), 8).alias("correlation"), F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"))


@query("G07_percentiles", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 6) AS p50, round(quantile_cont(o_totalprice, 0.95), 6) AS p95 FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_orderpriority").agg(F.round(F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice)"), 6).alias("p50"), F.round(F.expr("percentile_cont(0.95) WITHIN GROUP (ORDER BY o_totalprice)"), 6).alias("p95"))


@query("G08_mode", "SELECT user_id, event_type AS common FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY 1, 2) WHERE rn = 1")
def _(t):
    counts = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return R.latest(counts, "user_id", [F.col("n").desc(), F.col("event_type")]).select("user_id", F.col("event_type").alias("common"))


@query("G09_string_aggregate", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"))


@query("G10_approx_distinct", "SELECT count(DISTINCT user_id) AS users, TRUE AS sketches_near, TRUE AS approximation_near FROM events")
def _(t):
    daily = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.hll_sketch_agg("user_id").alias("sketch"))
    sketches = daily.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("of_sketches"))
    # the exact count stands beside for comparison: within 5 % for sketches of 12 bits, 15 % for a relative deviation of 5 %
    both = t.events.agg(F.approx_count_distinct("user_id").alias("approximate"), F.countDistinct("user_id").alias("users")).crossJoin(F.broadcast(sketches))
    near = lambda c, part: F.abs(F.col(c) - F.col("users")) <= part * F.col("users")
    return both.select("users", near("of_sketches", 0.05).alias("sketches_near"), near("approximate", 0.15).alias("approximation_near"))


@query("G11_approx_percentile", "SELECT o_orderstatus, part, count(*) AS n, TRUE AS near FROM orders, (VALUES (0.25::DOUBLE), (0.5), (0.75)) q(part) GROUP BY 1, 2")
def _(t):
    parts = [0.25, 0.5, 0.75]
    quartiles = t.orders.groupBy("o_orderstatus").agg(F.percentile_approx("o_totalprice", parts, 10000).alias("q"))
    asked = quartiles.select("o_orderstatus", F.explode(F.arrays_zip(F.lit(parts).alias("part"), F.col("q").alias("value"))).alias("x")).select("o_orderstatus", "x.part", "x.value")
    # the exact rank of each value stands beside for comparison: within a hundredth
    met = t.orders.join(F.broadcast(asked), "o_orderstatus").groupBy("o_orderstatus", "part").agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") <= F.col("value")).alias("below"), F.count_if(F.col("o_totalprice") < F.col("value")).alias("under"))
    return met.select("o_orderstatus", "part", "n", ((F.col("below") >= (F.col("part") - 0.01) * F.col("n")) & (F.col("under") <= (F.col("part") + 0.01) * F.col("n"))).alias("near"))


@query("G12_approx_top", "SELECT * FROM (SELECT event_type AS item, count(*) AS amount, 'count' AS kind FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3) UNION ALL SELECT * FROM (SELECT event_type, CAST(trunc(sum(value)) AS BIGINT), 'sum' FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)")
def _(t):
    counts = t.events.agg(F.expr("approx_top_k(event_type, 3)").alias("top")).select(F.inline("top")).toDF("item", "amount")
    sums = t.events.groupBy(F.col("event_type").alias("item")).agg(F.sum("value").cast("long").alias("amount"))
    return counts.withColumn("kind", F.lit("count")).unionByName(R.top_k(sums, [F.col("amount").desc(), F.col("item")], 3).withColumn("kind", F.lit("sum")))


@query("G13_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 12")


@query("G13b_global_having", "SELECT count(*) AS n FROM orders HAVING count(*) > 10")
def _(t):
    return t.orders.agg(F.count("*").alias("n")).filter("n > 10")


@query("G14_group_by_expression", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_totalprice > 150000 AS large, count(*) AS n FROM orders GROUP BY 1, 2")
def _(t):
    return t.orders.groupBy(F.trunc("o_orderdate", "month").alias("month"), (F.col("o_totalprice") > 150000).alias("large")).agg(F.count("*").alias("n"))


@query("G15_window_over_aggregate", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(avg(count(*)) OVER (), 6) AS mean FROM events GROUP BY 1")
def _(t):
    daily = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return daily.select("day", "n", F.round(F.avg("n").over(W.partitionBy()), 6).alias("mean"))


@query("G16_two_level", "SELECT n AS orders_per_customer, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders_per_customer")).groupBy("orders_per_customer").agg(F.count("*").alias("customers"))


@query("G17_weighted_average", "SELECT l_linestatus, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS weighted FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_linestatus").agg(F.round(R.weighted_average("l_extendedprice", "l_quantity"), 4).alias("weighted"))


@query("G18_static_pivot", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_F, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_O, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_P FROM orders GROUP BY 1")
def _(t):
    return R.pivoted(t.orders, ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], "count", prefix="n_")


@query("G18b_data_driven_pivot", """SELECT user_id, round(coalesce(sum(value) FILTER (WHERE event_type = 'click'), 0), 2) AS click, round(coalesce(sum(value) FILTER (WHERE event_type = 'error'), 0), 2) AS error, round(coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0), 2) AS purchase,
  round(coalesce(sum(value) FILTER (WHERE event_type = 'signup'), 0), 2) AS signup, round(coalesce(sum(value) FILTER (WHERE event_type = 'view'), 0), 2) AS view FROM events GROUP BY 1""")
def _(t):
    kinds = R.distinct_values(t.events, "event_type")
    made = R.pivoted(t.events, ["user_id"], "event_type", kinds, "sum", "value")
    return made.select("user_id", *[F.round(k, 2).alias(k) for k in kinds])


@query("G19_config_aggregation", "SELECT l_shipdate, round(sum(l_extendedprice), 2) AS revenue, count(DISTINCT l_suppkey) AS suppliers, max(l_discount) AS top_discount FROM lineitem GROUP BY 1")
def _(t):
    metrics = {"revenue": ("sum", "l_extendedprice"), "suppliers": ("count_distinct", "l_suppkey"), "top_discount": ("max", "l_discount")}
    return R.aggregated(t.lineitem, ["l_shipdate"], metrics).withColumn("revenue", F.round("revenue", 2))


@query("G20_scaled_sample", "SELECT round(sum(o_totalprice) * 10, 1) AS estimate FROM orders WHERE o_orderkey % 10 = 3")
def _(t):
    return t.orders.filter("o_orderkey % 10 = 3").agg(F.round(F.sum("o_totalprice") * 10, 1).alias("estimate"))


# windows

_ORDER = ["o_orderdate", "o_orderkey"]


@query("H01_row_number", "SELECT o_custkey, o_orderkey AS latest_order FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def _(t):
    return R.latest(t.orders, "o_custkey", [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", F.col("o_orderkey").alias("latest_order"))


@query("H02_rank", "SELECT n_name, rank() OVER (PARTITION BY n_regionkey ORDER BY n DESC) AS place FROM (SELECT n_name, n_regionkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)")
def _(t):
    counts = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "n_regionkey").agg(F.count("*").alias("n"))
    return counts.select("n_name", F.rank().over(W.partitionBy("n_regionkey").orderBy(F.col("n").desc())).alias("place"))


@query("H03_ntile", "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS quarter FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.ntile(4).over(W.partitionBy("c_mktsegment").orderBy("c_acctbal", "c_custkey")).alias("quarter"))


@query("H04_lag", "SELECT o_orderkey, lag(o_totalprice, 1, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, lag(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS two_before FROM orders")
def _(t):
    w = W.partitionBy("o_custkey").orderBy(*_ORDER)
    return t.orders.select("o_orderkey", F.lag("o_totalprice", 1, 0.0).over(w).alias("before"), F.lag("o_orderkey", 2).over(w).alias("two_before"))


@query("H05_last_value", "SELECT o_orderkey, last_value(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final_status FROM orders")
def _(t):
    w = W.partitionBy("o_custkey").orderBy(*_ORDER).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return t.orders.select("o_orderkey", F.last("o_orderstatus").over(w).alias("final_status"))


@query("H06_running_sum", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.round(R.running(F.sum("o_totalprice"), ["o_custkey"], _ORDER), 2).alias("running"))


@query("H07_moving_average", "SELECT day, round(avg(n) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS ma7 FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)")
def _(t):
    daily = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return daily.select("day", F.round(R.moving(F.avg("n"), [], ["day"], 6), 6).alias("ma7"))


@query("H08_trailing_average", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS before5 FROM events")
def _(t):
    return t.events.select("event_id", F.round(R.moving(F.avg("value"), ["user_id"], ["ts"], 5, -1), 6).alias("before5"))


@query("H09_range_interval", "SELECT event_id, count(*) OVER w AS n_day, round(sum(value) OVER w, 2) AS sum_day FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)")
def _(t):
    return t.events.select("event_id", R.within_time(F.count("*"), ["user_id"], "ts", 86400).alias("n_day"), F.round(R.within_time(F.sum("value"), ["user_id"], "ts", 86400), 2).alias("sum_day"))


@query("H10_range_symmetric", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND INTERVAL 1 HOUR FOLLOWING) AS near FROM events")
def _(t):
    return t.events.select("event_id", R.within_time(F.count("*"), ["user_id"], "ts", 3600, 3600).alias("near"))


@query("H11_default_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY CAST(date_trunc('month', o_orderdate) AS DATE)) AS peers FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.count("*").over(W.partitionBy("o_custkey").orderBy(F.trunc("o_orderdate", "month"))).alias("peers"))


@query("H12_partition_aggregate", "SELECT c_custkey, count(*) OVER (PARTITION BY c_mktsegment) AS n, min(c_acctbal) OVER (PARTITION BY c_mktsegment) AS low, max(c_acctbal) OVER (PARTITION BY c_mktsegment) AS high, round(avg(c_acctbal) OVER (PARTITION BY c_mktsegment), 4) AS mean FROM customer")
def _(t):
    # one pre-aggregated row a segment joins back: the rows themselves don't move
    stats = t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"), F.round(F.avg("c_acctbal"), 4).alias("mean"))
    return t.customer.select("c_custkey", "c_mktsegment").join(stats, "c_mktsegment").drop("c_mktsegment")


@query("H13_partition_percentile", "SELECT c_custkey, round(quantile_cont(c_acctbal, 0.75) OVER (PARTITION BY c_nationkey), 6) AS p75 FROM customer")
def _(t):
    return t.customer.selectExpr("c_custkey", "round(percentile_cont(0.75) WITHIN GROUP (ORDER BY c_acctbal) OVER (PARTITION BY c_nationkey), 6) AS p75")


@query("H14_ordered_moving_average", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS ma3 FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.round(R.moving(F.avg("o_totalprice"), ["o_custkey"], _ORDER, 2), 4).alias("ma3"))


@query("H15_global_window", "SELECT month, row_number() OVER (ORDER BY month) AS place, n - lag(n, 1, 0) OVER (ORDER BY month) AS change FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY 1)")
def _(t):
    monthly = t.orders.groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.count("*").alias("n"))
    w = W.orderBy("month")
    return monthly.select("month", F.row_number().over(w).alias("place"), (F.col("n") - F.lag("n", 1, 0).over(w)).alias("change"))


# sorting and limits


@query("I01_order_by", "SELECT n_name, n_regionkey FROM nation ORDER BY n_regionkey DESC, n_name")
def _(t):
    return t.nation.select("n_name", "n_regionkey").orderBy(F.col("n_regionkey").desc(), "n_name")


@query("I02_order_by_case", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END, 1")
def _(t):
    order = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(3)
    return t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n")).orderBy(order, "o_orderpriority")


@query("I03_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(t):
    return R.top_k(t.orders.select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 25)


@query("I04_top_k_per_group", "SELECT o_orderpriority, o_orderkey, place FROM (SELECT o_orderpriority, o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 10")
def _(t):
    return R.top_per_group(t.orders.select("o_orderpriority", "o_orderkey", "o_totalprice"), "o_orderpriority", [F.col("o_totalprice").desc(), F.col("o_orderkey")], 10, "place").select("o_orderpriority", "o_orderkey", "place")


@query("I05_limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100")
def _(t):
    return t.orders.select("o_orderkey").orderBy("o_orderkey").limit(100)


# set operations


@query("J01_union_all", "SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def _(t):
    return R.union_all(t.customer.select(F.col("c_nationkey").alias("nation")), t.supplier.select(F.col("s_nationkey").alias("nation")))


@query("J02_union_distinct", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t):
    return R.union_all(t.customer.select(F.col("c_nationkey").alias("nation")), t.supplier.select(F.col("s_nationkey").alias("nation"))).distinct()


@query("J03_union_priority", "SELECT c_custkey, c_acctbal, origin FROM (SELECT c_custkey, c_acctbal, 'now' AS origin FROM now UNION ALL SELECT c_custkey, c_acctbal, 'before' FROM before WHERE c_custkey NOT IN (SELECT c_custkey FROM now))", "before now")
def _(t):
    return R.union_by_priority(["c_custkey"], [F.col("c_acctbal")], t.now.select("c_custkey", "c_acctbal", F.lit("now").alias("origin")), t.before.select("c_custkey", "c_acctbal", F.lit("before").alias("origin")))


@query("J04_intersect_except", "SELECT 'both' AS side, c_custkey FROM (SELECT c_custkey FROM before INTERSECT SELECT c_custkey FROM now) UNION ALL SELECT 'gone', c_custkey FROM (SELECT c_custkey FROM before EXCEPT SELECT c_custkey FROM now)", "before now")
def _(t):
    b, n = t.before.select("c_custkey"), t.now.select("c_custkey")
    return R.union_all(b.intersect(n).select(F.lit("both").alias("side"), "c_custkey"), b.subtract(n).select(F.lit("gone").alias("side"), "c_custkey"))


@query("J05_generated_union", "SELECT 'orders' AS table_name, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'part', count(*) FROM part")
def _(t):
    return R.union_all(*[getattr(t, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n in ("orders", "customer", "part")])


@query("J06_union_null_padding", "SELECT c_custkey AS id, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS price FROM customer UNION ALL SELECT p_partkey, NULL, p_retailprice FROM part")
def _(t):
    return R.union_all(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")), t.part.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price")))


# subqueries


@query("K01_scalar_in_where", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def _(t):
    t.orders.createOrReplaceTempView("k01_orders")
    return t.spark.sql("SELECT o_orderkey FROM k01_orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM k01_orders)")


@query("K02_scalar_in_select", "SELECT c_custkey, CASE WHEN c_acctbal > (SELECT avg(c_acctbal) FROM customer) THEN 'above' ELSE 'below' END AS side FROM customer")
def _(t):
    mean = t.customer.agg(F.avg("c_acctbal").alias("mean"))
    return t.customer.crossJoin(F.broadcast(mean)).select("c_custkey", F.when(F.col("c_acctbal") > F.col("mean"), "above").otherwise("below").alias("side"))


@query("K03_correlated_lookup", "SELECT c_custkey, (SELECT n_name FROM nation WHERE n_nationkey = c_nationkey) AS nation FROM customer")
def _(t):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.col("n_name").alias("nation"))


@query("K04_correlated_aggregate", "SELECT o_orderkey, (SELECT min(p.o_orderdate) FROM orders p WHERE p.o_custkey = o.o_custkey) AS first_order FROM orders o")
def _(t):
    return t.orders.select("o_orderkey", F.min("o_orderdate").over(W.partitionBy("o_custkey")).alias("first_order"))


@query("K05_nested_ctes", "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1), b AS (SELECT c_mktsegment, total FROM a JOIN customer ON o_custkey = c_custkey), c AS (SELECT c_mktsegment, count(*) AS n, round(max(total), 2) AS top FROM b GROUP BY 1) SELECT * FROM c WHERE n > 1")
def _(t):
    a = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    b = a.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment", "total")
    return b.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.max("total"), 2).alias("top")).filter("n > 1")


@query("K06_plan_time_values", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) IN (SELECT DISTINCT CAST(o_orderdate AS DATE) FROM orders ORDER BY 1 DESC LIMIT 3)")
def _(t):
    days = t.orders.select(F.to_date("o_orderdate").alias("d")).distinct().orderBy(F.col("d").desc()).limit(3).collect()
    return t.orders.filter(F.to_date("o_orderdate").isin([r.d for r in days])).select("o_orderkey")
