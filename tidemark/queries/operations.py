"""Monitoring, anomalies and costs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import cdc
from tidemark.operators import monitoring as M
from tidemark.operators import relational as R
from tidemark.queries.base import query
from tidemark.sources.registry import values

_BY = "PARTITION BY model_name ORDER BY run_at, run_id"
_ORDER = ["run_at", "run_id"]


@query("Q01_health_score", "WITH h AS (SELECT op, count(*) AS n, count(DISTINCT key) AS keys, max(commit_ts) AS newest FROM changes GROUP BY 1), lag AS (SELECT lag_op, CAST(m AS DOUBLE) AS lag_minutes FROM (VALUES ('INSERT', 10.0), ('UPDATE', 20.0)) v(lag_op, m)) SELECT op, n, keys, lag_minutes, CASE WHEN lag_minutes IS NULL THEN 50 WHEN lag_minutes > 15 THEN 70 ELSE 100 END AS score FROM h LEFT JOIN lag ON op = lag_op", "changes")
def _(t):
    h = t.changes.groupBy("op").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"))
    lag = values(t.spark, [("INSERT", 10.0), ("UPDATE", 20.0)], "lag_op string, lag_minutes double")
    score = F.when(F.col("lag_minutes").isNull(), 50).when(F.col("lag_minutes") > 15, 70).otherwise(100)
    return h.join(F.broadcast(lag), F.col("op") == F.col("lag_op"), "left").select("op", "n", "keys", "lag_minutes", score.alias("score"))


@query("Q02_quality_summary", """WITH kept AS (SELECT lsn FROM changes WHERE lsn % 97 <> 0), g AS (SELECT lsn - lag(lsn) OVER (ORDER BY lsn) AS step FROM kept), c AS (SELECT 'gaps' AS issue, count(*) AS n FROM g WHERE step > 1 UNION ALL SELECT 'late', count(*) FROM changes WHERE commit_ts > TIMESTAMP '2024-01-30' UNION ALL SELECT 'repeated_tx', count(*) FROM (SELECT txn_id FROM changes GROUP BY 1 HAVING count(*) > 2))
  SELECT issue, n, CASE WHEN n > 100 THEN 'high' WHEN n > 0 THEN 'low' ELSE 'none' END AS severity FROM c""", "changes")
def _(t):
    parts = {"gaps": cdc.sequence_gaps(t.changes.filter("lsn % 97 <> 0"), "lsn"), "late": t.changes.filter("commit_ts > timestamp_ntz'2024-01-30'"), "repeated_tx": t.changes.groupBy("txn_id").agg(F.count("*").alias("n")).filter("n > 2")}
    made = R.union_all(*[d.agg(F.count("*").alias("n")).select(F.lit(i).alias("issue"), "n") for i, d in parts.items()])
    return made.withColumn("severity", F.when(F.col("n") > 100, "high").when(F.col("n") > 0, "low").otherwise("none"))


_SLA = [("timestamp", 15.0, 99.0, 120.0), ("log", 5.0, 99.5, 60.0), ("trigger", 30.0, 98.0, 300.0), ("snapshot", 60.0, 95.0, 600.0), ("real_time", 2.0, 99.9, 30.0)]


@query("Q03_sla", """WITH found AS (SELECT * FROM (VALUES ('timestamp', 10.0, 99.5, 60.0), ('log', 8.0, 99.0, 70.0), ('snapshot', 70.0, 96.0, 100.0), ('other', 1.0, 100.0, 1.0)) v(cdc_type, lag_minutes, success_rate, run_seconds)), s AS (SELECT * FROM (VALUES ('timestamp', 15.0, 99.0, 120.0), ('log', 5.0, 99.5, 60.0), ('trigger', 30.0, 98.0, 300.0), ('snapshot', 60.0, 95.0, 600.0), ('real_time', 2.0, 99.9, 30.0)) v(cdc_type, max_lag, min_success, max_run)),
  b AS (SELECT cdc_type, lag_minutes, max_lag, CASE WHEN lag_minutes > max_lag THEN 1 ELSE 0 END + CASE WHEN success_rate < min_success THEN 1 ELSE 0 END + CASE WHEN run_seconds > max_run THEN 1 ELSE 0 END AS breaches FROM found LEFT JOIN s USING (cdc_type)) SELECT cdc_type, CAST(breaches AS BIGINT) AS breaches, round(CAST(lag_minutes AS DOUBLE) / max_lag, 4) AS lag_ratio, CASE WHEN max_lag IS NULL THEN 'unknown' WHEN breaches = 0 THEN 'compliant' ELSE 'breach' END AS sla_status, CASE WHEN breaches >= 2 THEN 'P1' WHEN breaches = 1 THEN 'P2' ELSE 'P4' END AS priority FROM b""")
def _(t):
    found = values(t.spark, [("timestamp", 10.0, 99.5, 60.0), ("log", 8.0, 99.0, 70.0), ("snapshot", 70.0, 96.0, 100.0), ("other", 1.0, 100.0, 1.0)], "cdc_type string, lag_minutes double, success_rate double, run_seconds double")
    targets = values(t.spark, _SLA, "cdc_type string, max_lag double, min_success double, max_run double")
    return M.sla(found, F.broadcast(targets), "cdc_type").select("cdc_type", "breaches", "lag_ratio", "sla_status", "priority")


@query("Q04_z_scores", """WITH d AS (SELECT CAST(run_at AS DATE) AS day, model_name, sum(seconds) AS total FROM runs GROUP BY 1, 2), z AS (SELECT day, model_name, round(avg(total) OVER w, 6) AS trailing_avg, round((total - avg(total) OVER w) / NULLIF(stddev(total) OVER w, 0), 4) AS z_score FROM d WINDOW w AS (PARTITION BY model_name ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
  SELECT day, model_name, trailing_avg, z_score, CASE WHEN abs(z_score) > 3 THEN 'critical' WHEN abs(z_score) > 2 THEN 'warning' ELSE 'normal' END AS anomaly FROM z""", "runs")
def _(t):
    daily = t.runs.groupBy(F.to_date("run_at").alias("day"), "model_name").agg(F.sum("seconds").alias("total"))
    return M.z_scores(daily, "total", ["model_name"], ["day"]).select("day", "model_name", "trailing_avg", "z_score", "anomaly")


@query("Q05_alert_rules", """WITH n AS (SELECT count(*) FILTER (WHERE status = 'error') AS errors, max(seconds) AS slowest FROM runs), r AS (SELECT * FROM (VALUES ('error_count', 5.0, 15), ('slow_run', 1000.0, 60)) v(rule, threshold, every_minutes)) SELECT rule, CASE WHEN rule = 'error_count' THEN errors > threshold ELSE slowest > threshold END AS fires, TIMESTAMP '2001-08-01' + to_minutes(CAST(every_minutes AS BIGINT)) AS next_check FROM r CROSS JOIN n""", "runs")
def _(t):
    rules = values(t.spark, [("error_count", 5.0, 15), ("slow_run", 1000.0, 60)], "rule string, threshold double, every_minutes int")
    n = t.runs.agg(F.count_if(F.col("status") == "error").alias("errors"), F.max("seconds").alias("slowest"))
    fires = F.when(F.col("rule") == "error_count", F.col("errors") > F.col("threshold")).otherwise(F.col("slowest") > F.col("threshold"))
    return rules.crossJoin(F.broadcast(n)).select("rule", fires.alias("fires"), F.expr("timestamp_ntz'2001-08-01' + make_dt_interval(0, 0, every_minutes, 0)").alias("next_check"))


@query("Q06_executive_summary", "SELECT 'runs' AS metric, CAST(count(*) AS DOUBLE) AS value FROM runs UNION ALL SELECT 'success_rate', round(100.0 * count(*) FILTER (WHERE status = 'success') / count(*), 6) FROM runs UNION ALL SELECT 'changes', CAST(count(*) AS DOUBLE) FROM changes", "runs changes")
def _(t):
    one = t.runs.agg(F.count("*").cast("double").alias("runs"), F.round(F.count_if(F.col("status") == "success") * 100.0 / F.count("*"), 6).alias("success_rate"))
    two = t.changes.agg(F.count("*").cast("double").alias("changes"))
    return one.crossJoin(two).select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("runs", "success_rate", "changes")])))


@query("Q07_throughput", """WITH r AS (SELECT model_name, CAST(sum(n_rows) AS BIGINT) AS n, sum(n_rows) / sum(seconds) AS rps FROM runs GROUP BY 1) SELECT model_name, n, round(rps, 4) AS rps, CASE WHEN rps < 100 THEN 'slow' WHEN rps > 1000 THEN 'high' ELSE 'normal' END AS throughput, CASE WHEN n > 100000 THEN 'smaller_partitions' WHEN n < 1000 THEN 'larger_partitions' ELSE 'keep' END AS advice FROM r""", "runs")
def _(t):
    r = t.runs.groupBy("model_name").agg(F.sum("n_rows").alias("n"), F.try_divide(F.sum("n_rows"), F.sum("seconds")).alias("rps"))
    return r.select("model_name", "n", F.round("rps", 4).alias("rps"), M.throughput_class(F.col("rps")).alias("throughput"), M.partition_advice(F.col("n")).alias("advice"))


@query("Q08_performance_harness", "SELECT scenario, CASE WHEN n >= 0.8 * target_rows AND 10.0 <= max_seconds AND n / 10.0 >= min_rate THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (VALUES ('small', 1000, 5.0, 100), ('medium', 10000, 30.0, 300), ('large', 100000, 120.0, 800)) v(scenario, target_rows, max_seconds, min_rate) CROSS JOIN (SELECT count(*) AS n FROM lineitem) WHERE target_rows <= 1.2 * n")
def _(t):
    scenarios = values(t.spark, [("small", 1000, 5.0, 100), ("medium", 10000, 30.0, 300), ("large", 100000, 120.0, 800)], "scenario string, target_rows long, max_seconds double, min_rate long")
    n = t.lineitem.agg(F.count("*").alias("n"))
    good = (F.col("n") >= 0.8 * F.col("target_rows")) & (F.lit(10.0) <= F.col("max_seconds")) & (F.col("n") / 10.0 >= F.col("min_rate"))
    return scenarios.join(F.broadcast(n), F.col("target_rows") <= 1.2 * F.col("n")).select("scenario", F.when(good, "PASS").otherwise("FAIL").alias("verdict"))


@query("Q09_shard_load", "SELECT shard, n, CASE WHEN n > 1.1 * avg(n) OVER () THEN 'hot' WHEN n < 0.9 * avg(n) OVER () THEN 'cold' ELSE 'even' END AS load FROM (SELECT c_nationkey % 5 AS shard, count(*) AS n FROM customer GROUP BY 1)")
def _(t):
    loads = t.customer.groupBy((F.col("c_nationkey") % 5).alias("shard")).agg(F.count("*").alias("n"))
    mean = F.avg("n").over(W.partitionBy())
    return loads.select("shard", "n", F.when(F.col("n") > F.lit(1.1) * mean, "hot").when(F.col("n") < F.lit(0.9) * mean, "cold").otherwise("even").alias("load"))


@query("Q10_performance_ranking", "SELECT model_name, round(avg_seconds, 6) AS avg_seconds, row_number() OVER (ORDER BY avg_seconds DESC) AS place, CASE WHEN avg_seconds > 300 THEN 'very_slow' WHEN avg_seconds > 120 THEN 'slow' WHEN avg_seconds > 30 THEN 'moderate' ELSE 'fast' END AS class FROM (SELECT model_name, avg(seconds) AS avg_seconds FROM runs GROUP BY 1)", "runs")
def _(t):
    r = t.runs.groupBy("model_name").agg(F.avg("seconds").alias("a"))
    return r.select("model_name", F.round("a", 6).alias("avg_seconds"), F.row_number().over(W.orderBy(F.col("a").desc())).alias("place"), M.runtime_class(F.col("a")).alias("class"))


@query("Q11_runtime_anomalies", f"SELECT run_id, round(ratio, 4) AS ratio, CASE WHEN round(ratio, 4) >= 4 THEN 'critical' WHEN round(ratio, 4) >= 3 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT run_id, seconds, seconds / avg(seconds) OVER ({_BY} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS ratio FROM runs) WHERE round(ratio, 4) >= 2 AND seconds >= 60", "runs")
def _(t):
    return M.runtime_anomalies(t.runs, "model_name", "seconds", _ORDER).select("run_id", "ratio", "severity")


@query("Q12_daily_cost", """WITH d AS (SELECT CAST(run_at AS DATE) AS day, sum(seconds) / 3600 * 2.5 AS cost FROM runs GROUP BY 1) SELECT day, round(cost, 6) AS cost, round(avg(cost) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS avg7, coalesce(cost > 1.5 * avg(cost) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), false) AS alert FROM d""", "runs")
def _(t):
    d = t.runs.groupBy(F.to_date("run_at").alias("day")).agg((F.sum("seconds") / 3600 * 2.5).alias("c"))
    alert = F.col("c") > F.lit(1.5) * R.moving(F.avg("c"), [], ["day"], 7, -1)
    return d.select("day", F.round("c", 6).alias("cost"), F.round(R.moving(F.avg("c"), [], ["day"], 6), 6).alias("avg7"), F.coalesce(alert, F.lit(False)).alias("alert"))


@query("Q13_incremental_efficiency", "SELECT count(*) FILTER (WHERE run_at > TIMESTAMP '2000-01-01') AS new_rows, count(*) AS total_rows, round(100.0 * count(*) FILTER (WHERE run_at > TIMESTAMP '2000-01-01') / count(*), 6) AS pct, CASE WHEN 100.0 * count(*) FILTER (WHERE run_at > TIMESTAMP '2000-01-01') / count(*) > 50 THEN 'inefficient' WHEN 100.0 * count(*) FILTER (WHERE run_at > TIMESTAMP '2000-01-01') / count(*) > 20 THEN 'moderate' ELSE 'efficient' END AS class FROM runs", "runs")
def _(t):
    new = F.count_if(F.col("run_at") > F.lit("2000-01-01").cast("timestamp_ntz"))
    made = t.runs.agg(new.alias("new_rows"), F.count("*").alias("total_rows")).withColumn("pct", F.try_divide(F.col("new_rows") * 100.0, F.col("total_rows")))
    return made.select("new_rows", "total_rows", F.round("pct", 6).alias("pct"), F.when(F.col("pct") > 50, "inefficient").when(F.col("pct") > 20, "moderate").otherwise("efficient").alias("class"))


@query("Q14_query_profile", "SELECT run_id, CASE WHEN seconds > 300 AND n_rows < 50000 THEN 'inefficient' WHEN seconds > 300 THEN 'heavy' ELSE 'ok' END AS profile FROM runs ORDER BY seconds DESC, run_id LIMIT 20", "runs")
def _(t):
    profile = F.when((F.col("seconds") > 300) & (F.col("n_rows") < 50000), "inefficient").when(F.col("seconds") > 300, "heavy").otherwise("ok")
    return R.top_k(t.runs, [F.col("seconds").desc(), F.col("run_id")], 20).select("run_id", profile.alias("profile"))


@query("Q15_dashboard", """WITH d AS (SELECT CAST(run_at AS DATE) AS day, count(*) AS n, avg(seconds) AS s FROM runs GROUP BY 1), w AS (SELECT day, n, avg(s) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS now7, avg(s) OVER (ORDER BY day ROWS BETWEEN 13 PRECEDING AND 7 PRECEDING) AS before7 FROM d) SELECT day, n, round(now7, 6) AS ma7, CASE WHEN (now7 - before7) / before7 > 0.05 THEN 'increasing' WHEN (now7 - before7) / before7 < -0.05 THEN 'decreasing' ELSE 'stable' END AS trend FROM w""", "runs")
def _(t):
    d = t.runs.groupBy(F.to_date("run_at").alias("day")).agg(F.count("*").alias("n"), F.avg("seconds").alias("s"))
    w = d.withColumn("now7", R.moving(F.avg("s"), [], ["day"], 6)).withColumn("before7", R.moving(F.avg("s"), [], ["day"], 13, -7))
    return w.select("day", "n", F.round("now7", 6).alias("ma7"), M.trend(F.col("now7"), F.col("before7")).alias("trend"))


@query("Q16_cost_report", """WITH w AS (SELECT CAST(date_trunc('week', run_at) AS DATE) AS week, model_name, sum(seconds) / 3600 * 2.5 AS cost FROM runs GROUP BY 1, 2), t AS (SELECT week, sum(cost) AS total FROM w GROUP BY 1) SELECT week, model_name, round(cost, 6) AS cost, round(cost / total, 6) AS share, round(cost - lag(cost) OVER (PARTITION BY model_name ORDER BY week), 6) AS change FROM w JOIN t USING (week)""", "runs")
def _(t):
    w = t.runs.groupBy(F.trunc("run_at", "week").alias("week"), "model_name").agg((F.sum("seconds") / 3600 * 2.5).alias("c"))
    total = w.groupBy("week").agg(F.sum("c").alias("total"))
    before = F.lag("c").over(W.partitionBy("model_name").orderBy("week"))
    return w.withColumn("before", before).join(total, "week").select("week", "model_name", F.round("c", 6).alias("cost"), F.round(F.try_divide("c", "total"), 6).alias("share"), F.round(F.col("c") - F.col("before"), 6).alias("change"))


@query("Q17_dev_limits", "SELECT 'orders' AS model, count(*) AS n, count(*) > 100000 AS over_limit FROM orders")
def _(t):
    from tidemark.plans.project import ENVIRONMENTS

    return t.orders.agg(F.count("*").alias("n")).select(F.lit("orders").alias("model"), "n", (F.col("n") > ENVIRONMENTS["dev"].max_rows).alias("over_limit"))


@query("Q19_sampled_top_k", "WITH s AS (SELECT o_custkey, count(*) AS hits FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 20) SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN s USING (o_custkey) GROUP BY 1")
def _(t):
    hits = t.orders.filter("o_orderkey % 4 = 0").groupBy("o_custkey").agg(F.count("*").alias("hits")).filter("hits >= 2")
    top = R.top_k(hits, [F.col("hits").desc(), F.col("o_custkey")], 20)
    return t.orders.join(F.broadcast(top), "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("Q20_layered_cache", "SELECT c_custkey, c_acctbal, 'hot' AS layer FROM now WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, c_acctbal, 'warm' FROM before WHERE c_custkey NOT IN (SELECT c_custkey FROM now WHERE c_custkey % 3 = 0)", "before now")
def _(t):
    hot = t.now.filter("c_custkey % 3 = 0").select("c_custkey", "c_acctbal", F.lit("hot").alias("layer"))
    warm = t.before.join(hot.select("c_custkey"), "c_custkey", "left_anti").select("c_custkey", "c_acctbal", F.lit("warm").alias("layer"))
    return R.union_all(hot, warm)
