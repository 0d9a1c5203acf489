"""Streaming operators: batch forms, and runs of streams over the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import cdc
from tidemark.operators import relational as R
from tidemark.queries.base import Tables, query
from tidemark.streaming import streams as S


def _stream(t: Tables, files: int = 1) -> DataFrame:
    """The events as a stream of one file or several in order of time."""
    return S.read(t.spark, _folder(t, files), 1)


def _folder(t: Tables, files: int) -> str:
    path = f"{t.store.root}/incoming"
    (t.events.repartitionByRange(files, "ts") if files > 1 else t.events.coalesce(1)).write.mode("overwrite").parquet(path)
    return path


@query("M01_tumbling", "SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2, 3")
def _(t):
    made = t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return made.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "total")


@query("M01b_tumbling_stream", "WITH m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events) SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, count(*) AS n FROM events, m WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark GROUP BY 1, 2")
def _(t):
    made = S.tumbling(S.with_event_time(_stream(t), "ts", "10 minutes"), "ts", "1 hour", [], F.count("*").alias("n"))
    return S.collected(made, t.store, "tumbling")


@query("M02_sliding", "SELECT CAST(s AS TIMESTAMP) AS window_start, count(*) AS n FROM events, LATERAL (SELECT unnest([time_bucket(INTERVAL 15 MINUTE, ts), time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE]) AS s) GROUP BY 1")
def _(t):
    return t.events.groupBy(F.window("ts", "1 hour", "15 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


_SESSIONS = "gaps AS (SELECT event_id, user_id, ts, value, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > CAST({gap} AS BIGINT) * 60000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), numbered AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM gaps)"


@query("M03_sessions", f"WITH {_SESSIONS.format(gap=720)} SELECT user_id, session_no, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM numbered GROUP BY 1, 2")
def _(t):
    return R.with_time_gap_sessions(t.events, "user_id", "ts", 720).groupBy("user_id", "session_no").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"))


@query("M03b_session_window", f"WITH {_SESSIONS.format(gap=720)} SELECT user_id, min(ts) AS window_start, count(*) AS n FROM numbered GROUP BY user_id, session_no")
def _(t):
    return t.events.groupBy(F.session_window("ts", "720 minutes").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("window_start"), "n")


@query("M04_watermark", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20'")
def _(t):
    from datetime import datetime

    from tidemark.operators.incremental import high_water, since

    mark = high_water(t.events.filter(F.col("ts") <= F.lit("2024-01-20").cast("timestamp_ntz")), "ts", datetime(1900, 1, 1))
    return since(t.events, "ts", mark).select("event_id")


@query("M05_late_data", "SELECT event_id, CAST(event_id % 90 AS DOUBLE) AS delay_minutes, event_id % 90 > 60 AS is_late_arrival FROM events")
def _(t):
    seen = t.events.withColumn("seen", F.expr("ts + make_dt_interval(0, 0, cast(event_id % 90 as int), 0)"))
    return cdc.with_lateness(seen, "ts", "seen").select("event_id", "delay_minutes", "is_late_arrival")


@query("M06_stream_dedup", "SELECT event_id FROM events")
def _(t):
    twice = t.events.unionByName(t.events)
    path = f"{t.store.root}/twice"
    twice.coalesce(1).write.parquet(path)
    made = S.deduplicated(S.with_event_time(S.read(t.spark, path), "ts", "1 hour"), ["event_id"])
    return S.collected(made, t.store, "deduplicated").select("event_id")


@query("M06b_offset_dedup", "SELECT key, lsn FROM (SELECT key, lsn, row_number() OVER (PARTITION BY key, txn_id ORDER BY lsn DESC) AS rn FROM changes) WHERE rn = 1", "changes")
def _(t):
    return R.latest(t.changes, ["key", "txn_id"], [F.col("lsn").desc()]).select("key", "lsn")


@query("M07_latest_state", "SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def _(t):
    return S.latest_state(_stream(t, 3), t.store, "state", ["user_id"], "ts", ["event_id"]).select("user_id", "event_id", "event_type")


@query("M08_bounded_microbatch", "SELECT count(*) AS n FROM events")
def _(t):
    return S.collected(_stream(t, 4), t.store, "bounded").agg(F.count("*").alias("n"))


@query("M09_realtime_user_aggregates", "SELECT user_id, date_trunc('hour', ts) AS hr, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, CASE WHEN count(*) >= 3 THEN 'active' WHEN count(*) = 2 THEN 'normal' ELSE 'light' END AS segment FROM events GROUP BY 1, 2")
def _(t):
    n = F.count("*")
    made = t.events.groupBy("user_id", F.date_trunc("hour", "ts").alias("hr")).agg(n.alias("n"), F.count_if(F.col("event_type") == "purchase").alias("purchases"))
    return made.withColumn("segment", F.when(F.col("n") >= 3, "active").when(F.col("n") == 2, "normal").otherwise("light"))


@query("M10_stream_health", """WITH m AS (SELECT date_trunc('hour', ts) AS hr, count(*) AS n, quantile_cont(CAST(event_id % 90 AS DOUBLE), 0.95) AS p95 FROM events GROUP BY 1) SELECT hr, n, round(p95, 6) AS p95, coalesce(epoch_us(hr) - epoch_us(lag(hr) OVER (ORDER BY hr)) > 3600000000, false) AS gap, n - lag(n) OVER (ORDER BY hr) AS change FROM m""")
def _(t):
    m = t.events.groupBy(F.date_trunc("hour", "ts").alias("hr")).agg(F.count("*").alias("n"), F.expr("percentile_cont(0.95) WITHIN GROUP (ORDER BY cast(event_id % 90 as double))").alias("p95"))
    w = W.orderBy("hr")
    return m.select("hr", "n", F.round("p95", 6).alias("p95"), F.coalesce(C.epoch_diff("hr", F.lag("hr").over(w), "hour") > 1, F.lit(False)).alias("gap"), (F.col("n") - F.lag("n").over(w)).alias("change"))


@query("M11_dead_letters", "SELECT CASE WHEN value > 100 THEN 'timeout' WHEN value > 50 THEN 'schema' ELSE 'other' END AS error_class, event_id % 4 AS retries, count(*) AS n, CASE WHEN event_id % 4 >= 3 THEN 'dead' ELSE 'retry' END AS severity FROM events WHERE event_type = 'error' GROUP BY 1, 2, 4")
def _(t):
    cls = C.ladder(F.col("value") - 0.0000001, [(100, "timeout"), (50, "schema")], "other")
    e = t.events.filter("event_type = 'error'").select(cls.alias("error_class"), (F.col("event_id") % 4).alias("retries"))
    return e.groupBy("error_class", "retries").agg(F.count("*").alias("n")).withColumn("severity", F.when(F.col("retries") >= 3, "dead").otherwise("retry"))


@query("M12_sequence_gaps", "WITH k AS (SELECT lsn, lag(lsn) OVER (ORDER BY lsn) AS before FROM changes WHERE lsn % 50 NOT IN (7, 8)) SELECT before AS gap_start, lsn AS gap_end, lsn - before - 1 AS missing FROM k WHERE lsn - before > 1", "changes")
def _(t):
    return cdc.sequence_gaps(t.changes.filter("lsn % 50 not in (7, 8)"), "lsn")
