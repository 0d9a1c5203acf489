"""Domain analytics put together from the operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import relational as R
from tidemark.queries.base import query
from tidemark.queries.streams import _SESSIONS

_AS_OF = "2001-08-01"
_RFM = """r AS (SELECT o_custkey, date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2001-08-01') AS recency, count(*) AS frequency, sum(o_totalprice) AS monetary FROM orders GROUP BY 1),
  s AS (SELECT *, CASE WHEN recency <= 90 THEN 4 WHEN recency <= 180 THEN 3 WHEN recency <= 365 THEN 2 ELSE 1 END AS rs, CASE WHEN frequency >= 15 THEN 4 WHEN frequency >= 10 THEN 3 WHEN frequency >= 5 THEN 2 ELSE 1 END AS fs, CASE WHEN monetary >= 2000000 THEN 4 WHEN monetary >= 1000000 THEN 3 WHEN monetary >= 500000 THEN 2 ELSE 1 END AS ms FROM r)"""


def _rfm(t):
    r = t.orders.groupBy("o_custkey").agg(F.datediff(F.lit(_AS_OF).cast("date"), F.to_date(F.max("o_orderdate"))).alias("recency"), F.count("*").alias("frequency"), F.sum("o_totalprice").alias("monetary"))
    return r.withColumns({
        "rs": C.ladder("recency", [(90, 4), (180, 3), (365, 2)], 1, at_least=False),
        "fs": C.ladder("frequency", [(15, 4), (10, 3), (5, 2)], 1),
        "ms": C.ladder("monetary", [(2000000, 4), (1000000, 3), (500000, 2)], 1),
    })


#: Segment rules in order: the first that holds names the segment.
SEGMENTS = [("champions", "rs >= 4 and fs >= 4 and ms >= 4"), ("loyal", "rs >= 3 and fs >= 3"), ("promising", "rs >= 3 and fs <= 2"), ("at_risk", "rs <= 2 and fs >= 3"), ("lost", "rs = 1 and fs <= 2")]


@query("S01_rfm_segments", f"WITH {_RFM} SELECT o_custkey, rs, fs, ms, CASE WHEN rs >= 4 AND fs >= 4 AND ms >= 4 THEN 'champions' WHEN rs >= 3 AND fs >= 3 THEN 'loyal' WHEN rs >= 3 AND fs <= 2 THEN 'promising' WHEN rs <= 2 AND fs >= 3 THEN 'at_risk' WHEN rs = 1 AND fs <= 2 THEN 'lost' ELSE 'others' END AS segment FROM s")
def _(t):
    segment = F.lit("others")
    for name, rule in reversed(SEGMENTS):
        segment = F.when(F.expr(rule), name).otherwise(segment)
    return _rfm(t).select("o_custkey", "rs", "fs", "ms", segment.alias("segment"))


@query("S02_rfm_score", f"WITH {_RFM} SELECT o_custkey, round((rs + fs + ms) / 3.0, 6) AS score, CASE WHEN (rs + fs + ms) / 3.0 >= 3.5 THEN 'gold' WHEN (rs + fs + ms) / 3.0 >= 2.5 THEN 'silver' ELSE 'bronze' END AS tier FROM s")
def _(t):
    score = (F.col("rs") + F.col("fs") + F.col("ms")) / F.lit(3.0)
    return _rfm(t).select("o_custkey", F.round(score, 6).alias("score"), C.ladder(score, [(3.5, "gold"), (2.5, "silver")], "bronze").alias("tier"))


@query("S03_ab_test", """WITH v AS (SELECT user_id % 2 AS variant, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, sum(value) AS total FROM events GROUP BY 1), m AS (SELECT variant, users, purchases / users AS rate, total / users AS spend FROM v)
  SELECT b.users AS users_b, round(abs(b.rate - a.rate) / a.rate, 8) AS rate_lift, round(abs(b.spend - a.spend) / a.spend, 8) AS spend_lift, CASE WHEN abs(b.rate - a.rate) / a.rate > 0.05 THEN 'significant' ELSE 'not_significant' END AS label FROM m a JOIN m b ON a.variant = 0 AND b.variant = 1""")
def _(t):
    v = t.events.groupBy((F.col("user_id") % 2).alias("variant")).agg(F.countDistinct("user_id").alias("users"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.sum("value").alias("total"))
    m = v.select("variant", "users", F.try_divide("purchases", "users").alias("rate"), F.try_divide("total", "users").alias("spend"))
    a, b = m.filter("variant = 0").alias("a"), m.filter("variant = 1").alias("b")
    lift = lambda c: F.try_divide(F.abs(F.col(f"b.{c}") - F.col(f"a.{c}")), F.col(f"a.{c}"))
    return a.crossJoin(F.broadcast(b)).select(F.col("b.users").alias("users_b"), F.round(lift("rate"), 8).alias("rate_lift"), F.round(lift("spend"), 8).alias("spend_lift"), F.when(lift("rate") > 0.05, "significant").otherwise("not_significant").alias("label"))


@query("S04_metric_framework", "SELECT c_mktsegment, c_nationkey, count(*) AS customers, round(avg(c_acctbal), 4) AS balance FROM customer WHERE c_acctbal > 0 GROUP BY 1, 2 ORDER BY customers DESC, c_mktsegment, c_nationkey LIMIT 30")
def _(t):
    config = {"group": ["c_mktsegment", "c_nationkey"], "metrics": {"customers": ("count", "c_custkey"), "balance": ("avg", "c_acctbal")}, "filter": "c_acctbal > 0", "limit": 30}
    made = R.aggregated(t.customer.filter(config["filter"]), config["group"], config["metrics"]).withColumn("balance", F.round("balance", 4))
    return R.top_k(made, [F.col("customers").desc(), *map(F.col, config["group"])], config["limit"])


@query("S05_customer_segmentation", "WITH r AS (SELECT o_custkey, sum(o_totalprice) AS revenue, max(o_orderdate) AS newest FROM orders GROUP BY 1) SELECT c_custkey, CASE WHEN revenue >= 2000000 THEN 'high' WHEN revenue >= 1000000 THEN 'medium' WHEN revenue IS NULL THEN 'none' ELSE 'low' END AS value_class, coalesce(newest >= TIMESTAMP '2001-02-01', false) AS active FROM customer LEFT JOIN r ON c_custkey = o_custkey")
def _(t):
    r = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("revenue"), F.max("o_orderdate").alias("newest"))
    value = F.when(F.col("revenue") >= 2000000, "high").when(F.col("revenue") >= 1000000, "medium").when(F.col("revenue").isNull(), "none").otherwise("low")
    return t.customer.join(r, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", value.alias("value_class"), F.coalesce(F.col("newest") >= F.lit("2001-02-01").cast("timestamp_ntz"), F.lit(False)).alias("active"))


def enriched_orders(t):
    """Orders with their customer's segment and region, and their place in the customer's sequence."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    numbered = t.orders.withColumn("order_seq", F.row_number().over(w))
    return numbered.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")


_ENRICHED = "e AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, c_mktsegment, r_name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS order_seq FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"


@query("S06_orders_enriched", f"WITH {_ENRICHED} SELECT o_orderkey, c_mktsegment AS segment, r_name AS region, order_seq, order_seq = 1 AS is_first FROM e")
def _(t):
    return enriched_orders(t).select("o_orderkey", F.col("c_mktsegment").alias("segment"), F.col("r_name").alias("region"), "order_seq", (F.col("order_seq") == 1).alias("is_first"))


@query("S07_monthly_revenue_fact", f"WITH {_ENRICHED} SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, r_name AS region, c_mktsegment AS segment, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue, round(coalesce(sum(o_totalprice) FILTER (WHERE order_seq = 1), 0), 2) AS new_revenue, round(coalesce(sum(o_totalprice) FILTER (WHERE order_seq > 1), 0), 2) AS repeat_revenue, count(DISTINCT o_custkey) AS customers FROM e GROUP BY 1, 2, 3")
def _(t):
    price = F.col("o_totalprice")
    return enriched_orders(t).groupBy(F.trunc("o_orderdate", "month").alias("month"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment")).agg(
        F.count("*").alias("orders"), F.round(F.sum(price), 2).alias("revenue"), F.round(F.coalesce(F.sum(F.when(F.col("order_seq") == 1, price)), F.lit(0.0)), 2).alias("new_revenue"), F.round(F.coalesce(F.sum(F.when(F.col("order_seq") > 1, price)), F.lit(0.0)), 2).alias("repeat_revenue"), F.countDistinct("o_custkey").alias("customers"),
    )


@query("S08_staging_models", "SELECT c_custkey AS account_id, lower(trim(c_name)) AS name, CAST(CAST(c_acctbal AS DECIMAL(16,2)) AS DOUBLE) AS balance, md5(c_name || CAST(c_custkey AS VARCHAR)) AS row_hash, string_split(c_name, '#')[1] AS kind FROM customer")
def _(t):
    return t.customer.select(F.col("c_custkey").alias("account_id"), C.tidy("c_name").alias("name"), F.col("c_acctbal").cast("decimal(16,2)").alias("balance"), F.md5(F.concat("c_name", F.col("c_custkey").cast("string")).cast("binary")).alias("row_hash"), F.split("c_name", "#")[0].alias("kind"))


@query("S09_pushdown_pair", "WITH f AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderstatus = 'F') SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 30 PRECEDING AND CURRENT ROW), 4) AS avg31, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM f")
def _(t):
    f = t.orders.filter("o_orderdate >= timestamp_ntz'2000-01-01' and o_orderstatus = 'F'")
    order = ["o_orderdate", "o_orderkey"]
    return f.select("o_orderkey", F.round(R.moving(F.avg("o_totalprice"), ["o_custkey"], order, 30), 4).alias("avg31"), F.round(R.running(F.sum("o_totalprice"), ["o_custkey"], order), 2).alias("running"))


@query("S10_join_order_pair", "WITH l AS (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT c_mktsegment, count(*) AS n, round(sum(q), 2) AS quantity FROM orders JOIN l ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND c_acctbal > 0 GROUP BY 1")
def _(t):
    recent = t.orders.filter("o_orderdate >= timestamp_ntz'2000-01-01'").select("o_orderkey", "o_custkey")
    lines = t.lineitem.join(recent, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    solvent = t.customer.filter("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    return recent.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(solvent, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("q"), 2).alias("quantity"))


@query("S11_staged_aggregation", "WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY month ORDER BY total DESC, o_custkey) AS place FROM m) SELECT month, o_custkey, place, round(total, 2) AS total, round(sum(total) OVER (PARTITION BY month ORDER BY place), 2) AS running FROM r WHERE place <= 10")
def _(t):
    m = t.orders.groupBy(F.trunc("o_orderdate", "month").alias("month"), "o_custkey").agg(F.sum("o_totalprice").alias("total"))
    top = R.top_per_group(m, "month", [F.col("total").desc(), F.col("o_custkey")], 10, "place")
    return top.select("month", "o_custkey", "place", F.round("total", 2).alias("total"), F.round(F.sum("total").over(W.partitionBy("month").orderBy("place")), 2).alias("running"))


@query("S12_sessionization", f"WITH {_SESSIONS.format(gap=30)} SELECT user_id, session_no, count(*) AS n, round(sum(value), 2) AS total, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0, 4) AS minutes FROM numbered GROUP BY 1, 2")
def _(t):
    s = R.with_time_gap_sessions(t.events, "user_id", "ts", 30)
    return s.groupBy("user_id", "session_no").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.round(C.epoch_diff(F.max("ts"), F.min("ts"), "minute"), 4).alias("minutes"))


@query("S13_margin_model", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net, round(l_extendedprice * (1 - l_discount) * 0.3, 6) AS margin, CASE WHEN l_extendedprice * (1 - l_discount) * 0.3 > 20000 THEN 'high' ELSE 'normal' END AS margin_class FROM lineitem")
def _(t):
    s = t.lineitem.withColumn("n", F.col("l_extendedprice") * (1 - F.col("l_discount"))).withColumn("m", F.col("n") * 0.3)
    return s.select("l_orderkey", "l_linenumber", F.round("n", 6).alias("net"), F.round("m", 6).alias("margin"), F.when(F.col("m") > 20000, "high").otherwise("normal").alias("margin_class"))


@query("S14_statistics", "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(stddev(l_extendedprice), 4) AS std, round(corr(l_quantity, l_extendedprice), 8) AS correlation FROM lineitem GROUP BY 1 HAVING count(*) > 2")
def _(t):
    made = t.lineitem.groupBy(F.trunc("l_shipdate", "month").alias("month")).agg(F.round(F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY l_extendedprice)"), 6).alias("median"), F.round(F.stddev("l_extendedprice"), 4).alias("std"), F.round(F.corr("l_quantity", "l_extendedprice"), 8).alias("correlation"), F.count("*").alias("_n"))
    return made.filter("_n > 2").drop("_n")


@query("S15_approximate_segments", "SELECT c_mktsegment, count(*) AS customers, round(sum(c_acctbal), 2) AS balance, count(DISTINCT c_nationkey) AS nations, TRUE AS nations_near, TRUE AS median_near FROM customer GROUP BY 1")
def _(t):
    made = t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.approx_count_distinct("c_nationkey").alias("about"), F.percentile_approx("c_acctbal", 0.5, 10000).alias("median"))
    # exact figures stand beside for comparison: counts within 15 %, the rank of the median within a hundredth
    exact = t.customer.join(F.broadcast(made.select("c_mktsegment", "median")), "c_mktsegment").groupBy("c_mktsegment").agg(F.countDistinct("c_nationkey").alias("nations"), F.count_if(F.col("c_acctbal") <= F.col("median")).alias("below"), F.count_if(F.col("c_acctbal") < F.col("median")).alias("under"))
    n = F.col("customers")
    near = (F.col("below") >= 0.49 * n) & (F.col("under") <= 0.51 * n)
    return made.join(exact, "c_mktsegment").select("c_mktsegment", "customers", "balance", "nations", (F.abs(F.col("about") - F.col("nations")) <= 0.15 * F.col("nations")).alias("nations_near"), near.alias("median_near"))


@query("S16_marketing_efficiency", "SELECT event_type, round(sum(value) / (count(DISTINCT user_id) * 10), 6) AS roas, date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS lifespan, regexp_extract(event_type, '^([a-z]{3})', 1) AS channel FROM events GROUP BY event_type")
def _(t):
    return t.events.groupBy("event_type").agg(F.round(F.try_divide(F.sum("value"), F.countDistinct("user_id") * 10), 6).alias("roas"), F.datediff(F.to_date(F.max("ts")), F.to_date(F.min("ts"))).alias("lifespan")).withColumn("channel", F.regexp_extract("event_type", "^([a-z]{3})", 1))


@query("S17_layout_query", "SELECT event_id, row_number() OVER w AS seq, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 2) AS cumulative, lag(event_type) OVER w AS before, count(*) OVER (PARTITION BY event_type) AS type_count FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def _(t):
    w = W.partitionBy("user_id").orderBy("ts")
    sizes = t.events.groupBy("event_type").agg(F.count("*").alias("type_count"))
    made = t.events.select("event_id", "event_type", F.row_number().over(w).alias("seq"), F.round(R.running(F.sum("value"), ["user_id"], ["ts"]), 2).alias("cumulative"), F.lag("event_type").over(w).alias("before"))
    return made.join(sizes, "event_type").drop("event_type")
