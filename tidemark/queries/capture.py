"""Change data capture and slowly changing dimensions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import cdc, scd
from tidemark.operators import relational as R
from tidemark.queries.base import query


def _at(ts: str):
    return F.lit(ts).cast("timestamp_ntz")


@query("C01_timestamp", "SELECT o_orderkey, 'UPSERT' AS cdc_operation FROM orders WHERE o_orderdate > TIMESTAMP '2000-01-01' AND o_orderdate <= TIMESTAMP '2001-07-31 23:59:00'")
def _(t):
    return cdc.timestamp_changes(t.orders, "o_orderdate", "2000-01-01", "2001-07-31 23:59:00").select("o_orderkey", "cdc_operation")


@query("C02_soft_deletes", "SELECT o_orderkey, 'UPSERT' AS cdc_operation FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate > TIMESTAMP '2000-01-01' UNION ALL SELECT o_orderkey, 'DELETE' FROM orders WHERE o_orderstatus = 'P' AND o_orderdate > TIMESTAMP '1999-01-01'")
def _(t):
    return cdc.with_soft_deletes(t.orders, "o_orderdate", F.col("o_orderstatus") == "P", "2000-01-01", "1999-01-01").select("o_orderkey", "cdc_operation")


@query("C03_watermark_state", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderdate > TIMESTAMP '1999-06-01') WHERE rn = 1")
def _(t):
    from datetime import datetime

    from tidemark.operators.incremental import high_water
    from tidemark.sources.registry import values

    marks = values(t.spark, [("orders", datetime(1999, 6, 1))], "table_name string, high_water timestamp_ntz")
    mark = high_water(marks, "high_water", datetime(1900, 1, 1), "table_name = 'orders'")
    return R.latest(cdc.timestamp_changes(t.orders, "o_orderdate", str(mark)), "o_custkey", [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey")


@query("C04_timezone_late", "SELECT event_id, utc_ts, delay_minutes, delay_minutes > 60 AS is_late_arrival FROM (SELECT event_id, ts + INTERVAL 5 HOUR AS utc_ts, CAST(event_id % 120 AS DOUBLE) AS delay_minutes FROM events)")
def _(t):
    seen = t.events.withColumn("utc_ts", C.to_utc("ts", "America/New_York")).withColumn("seen", F.expr("utc_ts + make_dt_interval(0, 0, cast(event_id % 120 as int), 0)"))
    return cdc.with_lateness(seen, "utc_ts", "seen").select("event_id", "utc_ts", "delay_minutes", "is_late_arrival")


@query("C05_partition_pruned", "SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR) || '||' || o_orderstatus) AS content_hash, strftime(o_orderdate, '%Y%m%d') AS day_key, dayofweek(o_orderdate) NOT IN (0, 6) AS is_business_day FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-25'")
def _(t):
    recent = t.orders.filter(F.col("o_orderdate") >= _at("2001-07-25"))
    return recent.select("o_orderkey", C.content_hash("o_orderkey", "o_orderstatus").alias("content_hash"), F.date_format("o_orderdate", "yyyyMMdd").alias("day_key"), (~C.is_weekend("o_orderdate")).alias("is_business_day"))


@query("C06_log_parse", "SELECT lsn, op, status, amount, last_value(op) OVER (PARTITION BY txn_id, key ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final_op, lsn = max(lsn) OVER (PARTITION BY txn_id, key) AS is_final_in_transaction FROM changes", "changes")
def _(t):
    parsed = cdc.parse_log(t.log, "payload", {"status": "string", "amount": "double"})
    return cdc.with_final_in_transaction(parsed, "txn_id", "key", "lsn").select("lsn", "op", "status", "amount", "final_op", "is_final_in_transaction")


@query("C07_log_current_state", "SELECT key, lsn, status, amount FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY lsn DESC) AS rn FROM changes) WHERE rn = 1 AND op <> 'DELETE'", "changes")
def _(t):
    return cdc.current_state(t.changes, "key", [F.col("lsn").desc()]).select("key", "lsn", "status", "amount")


@query("C08_conflicts", """SELECT lsn, concurrent, winner_rank, seconds_since, CASE WHEN concurrent > 1 AND winner_rank = 1 THEN 'conflict_winner' WHEN concurrent > 1 THEN 'conflict_loser' WHEN seconds_since < 60 THEN 'rapid_change' ELSE 'normal' END AS conflict_status FROM (
  SELECT lsn, count(*) OVER (PARTITION BY key ORDER BY commit_ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND INTERVAL 1 HOUR FOLLOWING) AS concurrent, row_number() OVER (PARTITION BY key, date_trunc('second', commit_ts) ORDER BY lsn DESC) AS winner_rank,
  round((epoch_us(commit_ts) - epoch_us(lag(commit_ts) OVER (PARTITION BY key ORDER BY commit_ts, lsn))) / 1000000.0, 3) AS seconds_since FROM changes)""", "changes")
def _(t):
    return cdc.conflicts(t.changes, "key", "commit_ts", "lsn", 3600).select("lsn", "concurrent", "winner_rank", "seconds_since", "conflict_status")


@query("C09_log_batch_dedup", "SELECT txn_id, key, lsn, op FROM (SELECT *, row_number() OVER (PARTITION BY txn_id, key ORDER BY CASE op WHEN 'DELETE' THEN 1 WHEN 'UPDATE' THEN 2 ELSE 3 END, lsn DESC) AS rn FROM changes WHERE lsn <= 50000) WHERE rn = 1", "changes")
def _(t):
    batch = t.changes.filter("lsn <= 50000")
    return R.latest(batch, ["txn_id", "key"], [cdc.operation_rank(), F.col("lsn").desc()]).select("txn_id", "key", "lsn", "op")


@query("C10_audit_trail", """SELECT lsn, CASE WHEN op = 'INSERT' THEN 'created' WHEN op = 'DELETE' THEN 'removed' WHEN status = lag(status) OVER w THEN 'value_change' ELSE 'status_change' END AS change_kind, round((epoch_us(commit_ts) - epoch_us(lag(commit_ts) OVER w)) / 3600000000.0, 4) AS hours_since,
  count(*) OVER (PARTITION BY key ORDER BY commit_ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS changes_24h FROM changes WINDOW w AS (PARTITION BY key ORDER BY commit_ts, lsn)""", "changes")
def _(t):
    w = W.partitionBy("key").orderBy("commit_ts", "lsn")
    kind = F.when(F.col("op") == "INSERT", "created").when(F.col("op") == "DELETE", "removed").when(F.col("status") == F.lag("status").over(w), "value_change").otherwise("status_change")
    return t.changes.select("lsn", kind.alias("change_kind"), F.round(C.epoch_diff("commit_ts", F.lag("commit_ts").over(w), "hour"), 4).alias("hours_since"), R.within_time(F.count("*"), ["key"], "commit_ts", 86400).alias("changes_24h"))


_PIVOT = "pivoted AS (SELECT customer_id, operation, changed_at, max(CASE WHEN column_name = 'segment' THEN old_value END) AS old_segment, max(CASE WHEN column_name = 'segment' THEN new_value END) AS new_segment, max(CASE WHEN column_name = 'nation' THEN old_value END) AS old_nation, max(CASE WHEN column_name = 'nation' THEN new_value END) AS new_nation, string_agg(DISTINCT column_name, ',' ORDER BY column_name) AS changed_columns FROM audit GROUP BY 1, 2, 3)"


def _pivoted(t):
    return cdc.pivot_audit(t.audit, ["customer_id", "operation", "changed_at"], ["segment", "nation"])


@query("C11_audit_pivot", f"WITH {_PIVOT} SELECT customer_id, CASE operation WHEN 'I' THEN 'INSERT' WHEN 'U' THEN 'UPDATE' ELSE 'DELETE' END AS operation, changed_at, old_segment, new_segment, old_nation, new_nation, changed_columns FROM pivoted", "audit")
def _(t):
    return _pivoted(t).withColumn("operation", F.when(F.col("operation") == "I", "INSERT").when(F.col("operation") == "U", "UPDATE").otherwise("DELETE"))


@query("C12_categorized_risk", f"""WITH {_PIVOT}, cat AS (SELECT customer_id, changed_at, operation, CASE WHEN old_segment IS DISTINCT FROM new_segment THEN 'segment_change' WHEN old_nation IS DISTINCT FROM new_nation THEN 'relocation' ELSE 'other' END AS category FROM pivoted)
  SELECT customer_id, category, CASE WHEN operation = 'D' THEN 'high' WHEN category = 'relocation' THEN 'medium' ELSE 'low' END AS risk, count(*) OVER (PARTITION BY category ORDER BY changed_at RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS recent FROM cat""", "audit")
def _(t):
    category = F.when(C.changed("old_segment", "new_segment"), "segment_change").when(C.changed("old_nation", "new_nation"), "relocation").otherwise("other")
    cat = _pivoted(t).withColumn("category", category)
    risk = F.when(F.col("operation") == "D", "high").when(F.col("category") == "relocation", "medium").otherwise("low")
    return cat.select("customer_id", "category", risk.alias("risk"), R.within_time(F.count("*"), ["category"], "changed_at", 3600).alias("recent"))


@query("C13_trigger_state", "SELECT key, lsn, op = 'DELETE' AS is_inactive FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY commit_ts DESC, lsn DESC) AS rn FROM changes) WHERE rn = 1", "changes")
def _(t):
    return R.latest(t.changes, "key", [F.col("commit_ts").desc(), F.col("lsn").desc()]).select("key", "lsn", (F.col("op") == "DELETE").alias("is_inactive"))


@query("C14_audit_alerts", """WITH daily AS (SELECT CAST(commit_ts AS DATE) AS day, count(*) AS n, count(DISTINCT key) AS users, count(*) FILTER (WHERE op = 'DELETE') AS deletes FROM changes GROUP BY 1)
  SELECT day, n, users, CASE WHEN n > 3 * (SELECT avg(n) FROM daily) THEN 'volume' WHEN deletes > 0.15 * n THEN 'deletes' ELSE 'ok' END AS alert FROM daily""", "changes")
def _(t):
    daily = t.changes.groupBy(F.to_date("commit_ts").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("key").alias("users"), F.count_if(F.col("op") == "DELETE").alias("deletes"))
    mean = daily.agg(F.avg("n").alias("mean"))
    alert = F.when(F.col("n") > 3 * F.col("mean"), "volume").when(F.col("deletes") > F.lit(0.15) * F.col("n"), "deletes").otherwise("ok")
    return daily.crossJoin(F.broadcast(mean)).select("day", "n", "users", alert.alias("alert"))


@query("C15_change_patterns", """WITH gaps AS (SELECT key, status, (epoch_us(commit_ts) - epoch_us(lag(commit_ts) OVER (PARTITION BY key ORDER BY commit_ts, lsn))) / 86400000000.0 AS days FROM changes)
  SELECT key, count(*) AS n, round(avg(days), 6) AS avg_days, CASE WHEN count(*) > 70 THEN 'high' WHEN count(*) > 60 THEN 'medium' ELSE 'low' END AS activity, count(DISTINCT status) AS mobility FROM gaps GROUP BY 1""", "changes")
def _(t):
    w = W.partitionBy("key").orderBy("commit_ts", "lsn")
    gaps = t.changes.withColumn("days", C.epoch_diff("commit_ts", F.lag("commit_ts").over(w), "day"))
    return gaps.groupBy("key").agg(F.count("*").alias("n"), F.round(F.avg("days"), 6).alias("avg_days"), F.when(F.count("*") > 70, "high").when(F.count("*") > 60, "medium").otherwise("low").alias("activity"), F.countDistinct("status").alias("mobility"))


_DIFF = """SELECT coalesce(n.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'INSERT' WHEN n.c_custkey IS NULL THEN 'DELETE' WHEN b.c_acctbal IS DISTINCT FROM n.c_acctbal OR b.c_mktsegment IS DISTINCT FROM n.c_mktsegment THEN 'UPDATE' ELSE 'NO_CHANGE' END AS change_type,
  coalesce(n.c_acctbal, b.c_acctbal) AS c_acctbal, coalesce(n.c_mktsegment, b.c_mktsegment) AS c_mktsegment, b.c_acctbal IS DISTINCT FROM n.c_acctbal AND b.c_custkey IS NOT NULL AND n.c_custkey IS NOT NULL AS c_acctbal_changed, b.c_mktsegment IS DISTINCT FROM n.c_mktsegment AND b.c_custkey IS NOT NULL AND n.c_custkey IS NOT NULL AS c_mktsegment_changed,
  concat_ws(',', CASE WHEN b.c_custkey IS NOT NULL AND n.c_custkey IS NOT NULL AND b.c_acctbal IS DISTINCT FROM n.c_acctbal THEN 'c_acctbal' END, CASE WHEN b.c_custkey IS NOT NULL AND n.c_custkey IS NOT NULL AND b.c_mktsegment IS DISTINCT FROM n.c_mktsegment THEN 'c_mktsegment' END) AS changed_fields FROM before b FULL JOIN now n ON b.c_custkey = n.c_custkey"""
_FIELDS = ["c_acctbal", "c_mktsegment"]


@query("C16_snapshot_diff", _DIFF, "before now")
def _(t):
    return cdc.snapshot_diff(t.before, t.now, "c_custkey", _FIELDS)


@query("C16b_initial_load", "SELECT c_custkey, 'INITIAL_LOAD' AS change_type, c_acctbal, c_mktsegment, false AS c_acctbal_changed, false AS c_mktsegment_changed, '' AS changed_fields FROM now", "now")
def _(t):
    return cdc.initial_load(t.now, "c_custkey", _FIELDS)


@query("C17_snapshot_diff_anti", f"SELECT c_custkey, c_acctbal, c_mktsegment, change_type, changed_fields FROM ({_DIFF}) WHERE change_type <> 'NO_CHANGE'", "before now")
def _(t):
    return cdc.snapshot_diff_anti(t.before, t.now, "c_custkey", _FIELDS)


@query("C18_snapshot_rules", """SELECT c_custkey, band_before || '_TO_' || band_now AS transition, CASE WHEN abs(diff) >= 100 THEN 'large' WHEN diff <> 0 THEN 'small' ELSE 'none' END AS magnitude FROM (SELECT n.c_custkey, n.c_acctbal - b.c_acctbal AS diff,
  CASE WHEN b.c_acctbal < 0 THEN 'OUT' WHEN b.c_acctbal < 1000 THEN 'LOW' ELSE 'OK' END AS band_before, CASE WHEN n.c_acctbal < 0 THEN 'OUT' WHEN n.c_acctbal < 1000 THEN 'LOW' ELSE 'OK' END AS band_now FROM now n JOIN before b ON n.c_custkey = b.c_custkey)""", "before now")
def _(t):
    band = lambda c: F.when(F.col(c) < 0, "OUT").when(F.col(c) < 1000, "LOW").otherwise("OK")
    met = t.now.select("c_custkey", "c_acctbal").join(t.before.select("c_custkey", F.col("c_acctbal").alias("old")), "c_custkey")
    diff = F.col("c_acctbal") - F.col("old")
    return met.select("c_custkey", F.concat(band("old"), F.lit("_TO_"), band("c_acctbal")).alias("transition"), F.when(F.abs(diff) >= 100, "large").when(diff != 0, "small").otherwise("none").alias("magnitude"))


_DAILY = "daily AS (SELECT CAST(commit_ts AS DATE) AS day, count(*) AS n FROM changes GROUP BY 1)"


@query("C19_change_trend", f"WITH {_DAILY} SELECT day, n, round(avg(n) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS avg7, n > 1.2 * avg(n) OVER (ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS anomaly, n - lag(n, 1, 0) OVER (ORDER BY day) AS change FROM daily", "changes")
def _(t):
    daily = t.changes.groupBy(F.to_date("commit_ts").alias("day")).agg(F.count("*").alias("n"))
    trailing = R.moving(F.avg("n"), [], ["day"], 30, -1)
    return daily.select("day", "n", F.round(R.moving(F.avg("n"), [], ["day"], 6), 6).alias("avg7"), (F.col("n") > F.lit(1.2) * trailing).alias("anomaly"), (F.col("n") - F.lag("n", 1, 0).over(W.orderBy("day"))).alias("change"))


@query("C20_snapshot_monitor", f"SELECT count(*) AS n, count(*) FILTER (WHERE change_type <> 'NO_CHANGE') AS changed, round(100.0 * count(*) FILTER (WHERE change_type <> 'NO_CHANGE') / count(*), 6) AS change_rate FROM ({_DIFF})", "before now")
def _(t):
    diff = cdc.snapshot_diff(t.before, t.now, "c_custkey", _FIELDS)
    changed = F.count_if(F.col("change_type") != "NO_CHANGE")
    return diff.agg(F.count("*").alias("n"), changed.alias("changed"), F.round(F.try_divide(changed * 100.0, F.count("*")), 6).alias("change_rate"))


@query("C21_stream_enrichment", """SELECT event_id, CASE WHEN value >= 150 THEN 'high' WHEN value >= 50 THEN 'medium' ELSE 'low' END AS segment, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS last_hour,
  coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 300000000 AND value > 100, false) AS suspicious FROM events""")
def _(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    quick = C.epoch_diff("ts", F.lag("ts").over(w), "minute") < 5
    return t.events.select("event_id", C.ladder("value", [(150, "high"), (50, "medium")], "low").alias("segment"), R.within_time(F.count("*"), ["user_id"], "ts", 3600).alias("last_hour"), F.coalesce(quick & (F.col("value") > 100), F.lit(False)).alias("suspicious"))


@query("C22_high_volume_dedup", "SELECT key, shard, lsn, CASE WHEN length(status) > 6 THEN 'large' ELSE 'small' END AS size_class FROM (SELECT key, lsn % 4 AS shard, lsn, status, row_number() OVER (PARTITION BY key, lsn % 4 ORDER BY lsn DESC) AS rn FROM changes) WHERE rn = 1", "changes")
def _(t):
    dealt = t.changes.withColumn("shard", F.col("lsn") % 4)
    return R.latest(dealt, ["key", "shard"], [F.col("lsn").desc()]).select("key", "shard", "lsn", F.when(F.length("status") > 6, "large").otherwise("small").alias("size_class"))


@query("C23_state_reconstruction", "SELECT key, lsn, CASE WHEN op = 'DELETE' THEN NULL ELSE status END AS status, CASE WHEN op = 'DELETE' THEN NULL ELSE amount END AS amount FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY lsn DESC) AS rn FROM changes) WHERE rn = 1", "changes")
def _(t):
    from tidemark.operators.incremental import affected_keys, upsert

    c = t.changes
    half = c.agg((F.max("lsn") / 2).cast("long")).first()[0]
    state = lambda d: R.latest(d, "key", [F.col("lsn").desc()]).select("key", "lsn", *[F.when(F.col("op") != "DELETE", F.col(x)).alias(x) for x in ("status", "amount")])
    return upsert(state(c.filter(F.col("lsn") <= half)), state(affected_keys(c, ["key"], "lsn", half)), ["key"])


@query("C24_index_friendly", "SELECT c_custkey, lower(split_part(email, '@', 2)) AS domain, CASE WHEN c_acctbal > 0 THEN 'active' ELSE 'blocked' END AS status_class FROM emails WHERE email IS NOT NULL AND email LIKE '%@%' AND email NOT LIKE '%@%@%'", "emails")
def _(t):
    e = t.emails.filter("email is not null and email like '%@%' and email not like '%@%@%'")
    return e.select("c_custkey", C.email_domain("email").alias("domain"), F.when(F.col("c_acctbal") > 0, "active").otherwise("blocked").alias("status_class"))


@query("C25_storage_optimized", "SELECT event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS type_code, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN user_id IN (SELECT user_id FROM events WHERE value > 200) THEN 'vip' ELSE 'std' END AS segment FROM events")
def _(t):
    code = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "purchase", 3).otherwise(0)
    vip = t.events.filter("value > 200").select(F.col("user_id").alias("v")).distinct()
    return t.events.join(vip, F.col("user_id") == F.col("v"), "left").select("event_id", code.alias("type_code"), C.json_get("props", "$.k", "long").alias("k"), F.when(F.col("v").isNotNull(), "vip").otherwise("std").alias("segment"))


@query("C26_cost_minimized", "SELECT lsn, CASE WHEN op = 'DELETE' THEN NULL ELSE amount END AS amount, 'PROCESS' AS decision FROM changes WHERE op <> 'INSERT' OR amount > 100", "changes")
def _(t):
    decided = t.changes.withColumn("decision", F.when((F.col("op") != "INSERT") | (F.col("amount") > 100), "PROCESS").otherwise("SKIP"))
    return decided.filter("decision = 'PROCESS'").select("lsn", F.when(F.col("op") != "DELETE", F.col("amount")).alias("amount"), "decision")


@query("C27_lazy_json", "SELECT lsn, CASE WHEN op <> 'DELETE' THEN status END AS status FROM changes", "changes")
def _(t):
    return t.log.select("lsn", F.when(F.col("op") != "DELETE", F.get_json_object("payload", "$.after.status")).alias("status"))


@query("C28_operation_filter", "SELECT lsn, op FROM changes WHERE op IN ('INSERT', 'UPDATE') AND commit_ts > TIMESTAMP '2024-01-15'", "changes")
def _(t):
    since = t.changes.filter(F.col("op").isin("INSERT", "UPDATE", "DELETE") & (F.col("commit_ts") > _at("2024-01-15")))
    return since.filter("op <> 'DELETE'").select("lsn", "op")


# slowly changing dimensions over the change log

_SCD2 = """versions AS (SELECT key, status, amount, commit_ts AS valid_from, coalesce(lead(commit_ts) OVER (PARTITION BY key ORDER BY commit_ts, lsn), TIMESTAMP '9999-12-31 00:00:00') AS valid_to, op, lsn FROM changes),
  history AS (SELECT key, status, amount, valid_from, valid_to, valid_to = TIMESTAMP '9999-12-31 00:00:00' AS is_current, row_number() OVER (PARTITION BY key ORDER BY valid_from, lsn) AS version_number FROM versions WHERE op <> 'DELETE')"""


def _history(t, upto=None):
    c = t.changes if upto is None else t.changes.filter(upto)
    return scd.versions(c, "key", "commit_ts", ["lsn"], F.col("op") == "DELETE").select("key", "status", "amount", "valid_from", "valid_to", "is_current", "version_number")


@query("D01_scd2", f"WITH {_SCD2} SELECT key, status, amount, valid_from, valid_to, is_current, version_number FROM history", "changes")
def _(t):
    # a history up to the middle, then the rest of the changes put on it
    middle = "commit_ts <= timestamp_ntz'2024-01-15'"
    return scd.apply_versions(_history(t, middle), t.changes.filter(f"not ({middle})"), "key", "commit_ts", ["lsn"], F.col("op") == "DELETE")


@query("D02_scd1", "SELECT key, status, amount FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY lsn DESC) AS rn FROM changes) WHERE rn = 1", "changes")
def _(t):
    c = t.changes.select("key", "status", "amount", "lsn")
    first = scd.type1(None, c.filter("lsn % 2 = 0"), "key", [F.col("lsn").desc()])
    newest = R.latest(c, "key", [F.col("lsn").desc()])
    return scd.type1(first, newest, "key", [F.col("lsn").desc()]).drop("lsn")


@query("D03_scd3", "SELECT n.c_custkey, n.c_mktsegment, CASE WHEN b.c_custkey IS NOT NULL AND b.c_mktsegment IS DISTINCT FROM n.c_mktsegment THEN b.c_mktsegment WHEN b.c_custkey IS NOT NULL THEN 'NONE' END AS previous_c_mktsegment FROM now n LEFT JOIN before b ON n.c_custkey = b.c_custkey", "before now")
def _(t):
    target = t.before.select("c_custkey", "c_mktsegment", F.lit("NONE").alias("previous_c_mktsegment"))
    return scd.type3(target, t.now.select("c_custkey", "c_mktsegment"), "c_custkey", ["c_mktsegment"])


@query("D04_mixed_scd", """SELECT b.c_custkey, b.c_mktsegment, CASE WHEN n.c_custkey IS NOT NULL AND b.c_mktsegment IS NOT DISTINCT FROM n.c_mktsegment THEN n.c_acctbal ELSE b.c_acctbal END AS c_acctbal, TIMESTAMP '2001-01-01' AS valid_from, CASE WHEN n.c_custkey IS NOT NULL AND b.c_mktsegment IS DISTINCT FROM n.c_mktsegment THEN TIMESTAMP '2001-02-01' ELSE TIMESTAMP '9999-12-31' END AS valid_to,
    NOT (n.c_custkey IS NOT NULL AND b.c_mktsegment IS DISTINCT FROM n.c_mktsegment) AS is_current, 1 AS version_number FROM before b LEFT JOIN now n ON b.c_custkey = n.c_custkey
  UNION ALL SELECT n.c_custkey, n.c_mktsegment, n.c_acctbal, TIMESTAMP '2001-02-01', TIMESTAMP '9999-12-31', true, CASE WHEN b.c_custkey IS NULL THEN 1 ELSE 2 END FROM now n LEFT JOIN before b ON b.c_custkey = n.c_custkey WHERE b.c_custkey IS NULL OR b.c_mktsegment IS DISTINCT FROM n.c_mktsegment""", "before now")
def _(t):
    shape = lambda d, ts: d.select("c_custkey", "c_mktsegment", "c_acctbal", _at(ts).alias("ts"))
    target = scd.versions(shape(t.before, "2001-01-01"), "c_custkey", "ts").drop("ts")
    return scd.mixed(target, shape(t.now, "2001-02-01"), "c_custkey", "ts", ["c_mktsegment"], ["c_acctbal"])


@query("D05_batched_scd", "SELECT key, lsn, ntile(4) OVER (ORDER BY key) AS batch, md5(status || '||' || CAST(amount AS VARCHAR)) AS content_hash FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY lsn DESC) AS rn FROM changes) WHERE rn = 1", "changes")
def _(t):
    newest = R.latest(t.changes, "key", [F.col("lsn").desc()])
    return R.global_ntile(newest.select("key", "lsn", C.content_hash("status", "amount").alias("content_hash")), 4, ["key"], "batch")


@query("D06_scd2_quality", f"""WITH {_SCD2} SELECT key, count(*) AS versions, count(*) FILTER (WHERE is_current) AS current_versions, count(*) FILTER (WHERE valid_from >= valid_to) AS invalid_ranges, 0 AS unclosed, 0 AS current_with_end, CASE WHEN count(*) FILTER (WHERE valid_from >= valid_to) > 0 OR count(*) FILTER (WHERE is_current) > 1 THEN 'FAIL' ELSE 'PASS' END AS status FROM history GROUP BY 1""", "changes")
def _(t):
    return scd.quality(_history(t), "key")


@query("D07_overlaps", f"WITH {_SCD2}, broken AS (SELECT key, version_number, valid_from, CASE WHEN version_number % 5 = 0 THEN valid_to + INTERVAL 3 DAY ELSE valid_to END AS valid_to FROM history WHERE NOT is_current) SELECT key, version_number FROM broken a WHERE EXISTS (SELECT 1 FROM broken b WHERE b.key = a.key AND b.version_number < a.version_number AND b.valid_to > a.valid_from)", "changes")
def _(t):
    broken = _history(t).filter("not is_current").withColumn("valid_to", F.when(F.col("version_number") % 5 == 0, F.col("valid_to") + F.expr("interval 3 days")).otherwise(F.col("valid_to")))
    return scd.overlaps(broken, "key").select("key", "version_number")


@query("D08_snapshot_no_invalidation", "SELECT c_custkey, c_acctbal, TIMESTAMP '2001-01-01' AS valid_from, CASE WHEN c_custkey % 11 <> 0 AND c_custkey % 7 = 0 THEN TIMESTAMP '2001-02-01' END AS valid_to FROM before UNION ALL SELECT c_custkey, c_acctbal, TIMESTAMP '2001-02-01', NULL FROM now WHERE c_custkey % 7 = 0 OR c_custkey % 10 = 0", "before now")
def _(t):
    k = F.col("c_custkey")
    old = t.before.select(k, "c_acctbal", _at("2001-01-01").alias("updated_at"))
    new = t.now.select(k, "c_acctbal", F.when((k % 7 == 0) | (k % 10 == 0), _at("2001-02-01")).otherwise(_at("2001-01-01")).alias("updated_at"))
    first = scd.snapshot(None, old, "c_custkey", "updated_at")
    return scd.snapshot(first, new, "c_custkey", "updated_at", invalidate_deleted=False).drop("updated_at")


@query("D09_point_in_time", f"WITH {_SCD2} SELECT 'then' AS view, key, status FROM history WHERE valid_from <= TIMESTAMP '2024-01-15 12:00:00' AND TIMESTAMP '2024-01-15 12:00:00' < valid_to UNION ALL SELECT 'current', key, status FROM history WHERE is_current", "changes")
def _(t):
    h = _history(t)
    return R.union_all(scd.as_of(h, "2024-01-15 12:00:00").select(F.lit("then").alias("view"), "key", "status"), h.filter("is_current").select(F.lit("current").alias("view"), "key", "status"))
