"""Sources, materializations and incremental strategies."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import incremental as I
from tidemark.operators import relational as R
from tidemark.plans.project import Context, Model, Project, choose_materialization, log_run, materialize
from tidemark.plans.tools import dispatch, dispatch_in, label_table, labelled, labels_of, maintain, statistics
from tidemark.queries.base import query
from tidemark.sources.registry import date_spine, values

CUT = "2000-01-01"


def _ctx(t, **more) -> Context:
    return Context(t.spark, t.catalog, t.store, "2001-08-01", **more)


def _at(ts: str):
    return F.lit(ts).cast("timestamp_ntz")


@query("A01_source_scan", "SELECT * FROM supplier")
def _(t):
    return t.catalog.read("raw", "supplier")


@query("A02_model_graph", "SELECT c_mktsegment AS segment, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def _(t):
    p = Project()
    p.model("stg_orders", layer="staging")(lambda c: c.source("orders").select("o_orderkey", "o_custkey", "o_totalprice"))
    p.model("stg_customers", layer="staging")(lambda c: c.source("customer").select("c_custkey", "c_mktsegment"))
    p.model("int_joined", layer="intermediate", depends_on=["stg_orders", "stg_customers"])(lambda c: c.ref("stg_orders").join(c.ref("stg_customers"), F.col("o_custkey") == F.col("c_custkey")))
    p.model("fct_revenue", depends_on=["int_joined"])(lambda c: c.ref("int_joined").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.round(F.sum("o_totalprice"), 2).alias("revenue")))
    ctx = _ctx(t)
    p.run(ctx)
    return ctx.built["fct_revenue"]


@query("A03_self_reference", "SELECT o_orderkey, o_orderdate FROM orders")
def _(t):
    def make(c):
        src = c.source("orders").select("o_orderkey", "o_orderdate")
        if c.is_incremental:
            return I.since(src, "o_orderdate", I.high_water(c.this, "o_orderdate", None))
        return src.filter(F.col("o_orderdate") <= _at(CUT))

    ctx = _ctx(t, model=Model("fct_orders", make, materialized="incremental"))
    materialize(ctx)
    return materialize(ctx)


@query("A04_seed", "SELECT code, name, r_regionkey FROM (VALUES ('AF', 'AFRICA'), ('AM', 'AMERICA')) v(code, name) JOIN region ON r_name = name")
def _(t):
    from tidemark.sources.registry import seed

    path = f"{t.store.root}/seed"
    values(t.spark, [("AF", "AFRICA"), ("AM", "AMERICA")], "code string, name string").coalesce(1).write.csv(path, header=True)
    return F.broadcast(seed(t.spark, path, "code string, name string")).join(t.region, F.col("name") == F.col("r_name")).select("code", "name", "r_regionkey")


@query("A05_inline_values", f"SELECT c_custkey FROM emails WHERE split_part(email, '@', 2) IN (VALUES {', '.join(f"('{d}')" for d in C.BLOCKED_DOMAINS)})", "emails")
def _(t):
    domains = values(t.spark, [(d,) for d in C.BLOCKED_DOMAINS], "domain string")
    return t.emails.join(F.broadcast(domains), C.email_domain("email") == F.col("domain"), "left_semi").select("c_custkey")


@query("A06_literal_union", "SELECT 'timestamp' AS cdc_type, CAST(15.0 AS DOUBLE) AS max_lag UNION ALL SELECT 'log', 5.0 UNION ALL SELECT 'trigger', 30.0")
def _(t):
    return values(t.spark, [("timestamp", 15.0), ("log", 5.0), ("trigger", 30.0)], "cdc_type string, max_lag double")


@query("A07_date_spine", "SELECT 'day' AS part, CAST(d AS DATE) AS date_day FROM generate_series(DATE '2020-01-01', DATE '2020-12-31', INTERVAL 1 DAY) s(d) UNION ALL SELECT 'month', CAST(d AS DATE) FROM generate_series(DATE '2020-01-01', DATE '2020-12-31', INTERVAL 1 MONTH) s(d) UNION ALL SELECT 'week', CAST(d AS DATE) FROM generate_series(DATE '2020-01-01', DATE '2020-12-31', INTERVAL 7 DAY) s(d)")
def _(t):
    return R.union_all(*[date_spine(t.spark, "2020-01-01", "2021-01-01", p).select(F.lit(p).alias("part"), "date_day") for p in ("day", "month", "week")])


def _built(t, kind, make, **config):
    name = {"view": "stg_x", "ephemeral": "int_x"}.get(kind, "fct_x")
    return materialize(_ctx(t, model=Model(name, make, materialized=kind, **config)))


@query("A08_view", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 0")
def _(t):
    return _built(t, "view", lambda c: c.source("supplier").filter("s_acctbal > 0").select("s_suppkey", "s_acctbal"))


@query("A09_table", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def _(t):
    return _built(t, "table", lambda c: c.source("part").groupBy("p_brand").agg(F.count("*").alias("n")))


@query("A10_ephemeral", "SELECT p_partkey, p_size FROM part WHERE p_size > 25")
def _(t):
    return _built(t, "ephemeral", lambda c: c.source("part").filter("p_size > 25").select("p_partkey", "p_size"))


@query("A11_incremental", "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders")
def _(t):
    def make(c):
        src = c.source("orders").select("o_orderkey", "o_totalprice", "o_orderdate")
        return src.filter(F.col("o_orderdate") > _at("1999-12-01")) if c.is_incremental else src.filter(F.col("o_orderdate") <= _at(CUT))

    ctx = _ctx(t, model=Model("fct_o", make, materialized="incremental", strategy="merge", unique_key=["o_orderkey"]))
    materialize(ctx)
    return materialize(ctx)


@query("A12_materialized_view", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-30' GROUP BY 1")
def _(t):
    def make(c):
        return c.source("events").filter(F.to_date("ts") == F.lit("2024-01-30").cast("date")).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))

    ctx = _ctx(t, model=Model("mart_today", make, materialized="materialized_view"))
    materialize(ctx)
    return materialize(ctx)  # a refresh is another build


_SNAP = """SELECT c_custkey, c_acctbal, c_mktsegment, TIMESTAMP '2001-01-01' AS valid_from, CASE WHEN c_custkey % 11 = 0 THEN TIMESTAMP '2001-08-01' WHEN c_custkey % 7 = 0 OR c_custkey % 13 = 0 THEN TIMESTAMP '2001-02-01' END AS valid_to FROM before
  UNION ALL SELECT n.c_custkey, n.c_acctbal, n.c_mktsegment, CASE WHEN n.c_custkey % 7 = 0 OR n.c_custkey % 13 = 0 OR n.c_custkey % 10 = 0 THEN TIMESTAMP '2001-02-01' ELSE TIMESTAMP '2001-01-01' END, NULL FROM now n LEFT JOIN before b ON n.c_custkey = b.c_custkey WHERE b.c_custkey IS NULL OR n.c_custkey % 7 = 0 OR n.c_custkey % 13 = 0"""


def _snapshots(t):
    k = F.col("c_custkey")
    old = t.before.select("c_custkey", "c_acctbal", "c_mktsegment", _at("2001-01-01").alias("updated_at"))
    new = t.now.select("c_custkey", "c_acctbal", "c_mktsegment", F.when((k % 7 == 0) | (k % 13 == 0) | (k % 10 == 0), _at("2001-02-01")).otherwise(_at("2001-01-01")).alias("updated_at"))
    return old, new


@query("A13_snapshot", _SNAP, "before now")
def _(t):
    old, new = _snapshots(t)
    for df in (old, new):
        out = materialize(_ctx(t, model=Model("snap", lambda c, d=df: d, materialized="snapshot", unique_key=["c_custkey"], updated_at="updated_at")))
    return out.drop("updated_at")


@query("A14_merge_materialization", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM now", "now")
def _(t):
    frames = [t.before, t.now]
    ctx = None
    for df in frames:
        ctx = _ctx(t, model=Model("dim_c", lambda c, d=df: d, materialized="incremental", strategy="merge_sync", unique_key=["c_custkey"]))
        out = materialize(ctx)
    return out


@query("A15_tiering", "SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) >= DATE '2001-05-03' THEN 'hot' WHEN CAST(o_orderdate AS DATE) >= DATE '2001-04-30' THEN 'warm' ELSE 'cold' END AS tier FROM orders")
def _(t):
    d = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", F.when(d >= F.lit("2001-05-03").cast("date"), "hot").when(d >= F.lit("2001-04-30").cast("date"), "warm").otherwise("cold").alias("tier"))


_BY_VOLUME = "CASE WHEN count(*) > 10000000 THEN 'incremental' WHEN count(*) > 1000000 THEN 'table' ELSE 'view' END AS materialization"


@query("A16_volume_based", f"SELECT 'orders' AS model, count(*) AS n_rows, {_BY_VOLUME} FROM orders UNION ALL SELECT 'lineitem', count(*), {_BY_VOLUME} FROM lineitem")
def _(t):
    rows = [(n, c, choose_materialization(c)) for n in ("orders", "lineitem") for c in [getattr(t, n).count()]]
    return values(t.spark, rows, "model string, n_rows long, materialization string")


@query("A17_partitioned_write", "SELECT event_id, event_type, CAST(ts AS DATE) AS day FROM events")
def _(t):
    return t.store.write("events_by_day", t.events.select("event_id", "event_type", F.to_date("ts").alias("day")), partition_by=["day"], sort_by=["event_type"]).select("event_id", "event_type", "day")


@query("A18_partition_filter_guard", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
def _(t):
    return t.catalog.read("raw", "events", "ts >= timestamp_ntz'2024-01-15'", require_filter_on="ts").select("event_id")


@query("A19_partition_expiry", "SELECT event_id, CAST(ts AS DATE) AS day FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-10'")
def _(t):
    t.store.write("expiring", t.events.select("event_id", F.to_date("ts").alias("day")), partition_by=["day"])
    return t.store.expire("expiring", "day", "2024-01-10").select("event_id", "day")


@query("A20_schema_evolution", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN p_brand END AS p_brand, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS p_size FROM part")
def _(t):
    target, batch = t.part.filter("p_partkey % 2 = 0").select("p_partkey", "p_size"), t.part.filter("p_partkey % 2 = 1").select("p_partkey", "p_brand")
    return I.append(*I.evolve(target, batch, "append"))


@query("A22_log_append", "SELECT * FROM (VALUES ('stg_a', 'success', 'view'), ('fct_b', 'success', 'table'), ('stg_a', 'success', 'view'), ('fct_b', 'success', 'table')) v(model_name, status, materialized)")
def _(t):
    p = Project()
    p.model("stg_a", layer="staging")(lambda c: c.source("region"))
    p.model("fct_b", depends_on=["stg_a"])(lambda c: c.ref("stg_a"))
    p.on_end.append(log_run(t.store))
    for _ in range(2):
        p.run(_ctx(t))
    return t.store.read("run_log").select("model_name", "status", "materialized")


_STATISTICS = ", ".join(f"('{c}', (SELECT count(*) FROM part), (SELECT count(*) - count({c}) FROM part), (SELECT CAST(min({c}) AS VARCHAR) FROM part), (SELECT CAST(max({c}) AS VARCHAR) FROM part))" for c in ("p_partkey", "p_size"))


@query("A23_statistics", f"SELECT * FROM (VALUES {_STATISTICS}) v(column_name, n_rows, n_null, low, high)")
def _(t):
    name = f"part_{uuid.uuid4().hex}"
    t.part.select("p_partkey", "p_size").write.saveAsTable(name)
    try:
        maintain(t.spark, name)
        return statistics(t.spark, name)
    finally:
        t.spark.sql(f"DROP TABLE {name}")


@query("A26_dialect_dispatch", """SELECT p_partkey, CASE WHEN p_size <> 0 THEN p_retailprice / p_size END AS own, 'default' AS other, 'core.spark' AS found FROM part""")
def _(t):
    divide = {"spark": lambda a, b: F.try_divide(a, b), "default": lambda a, b: F.when(b != 0, a / b)}
    name = {"default": lambda: F.lit("default"), "snowflake": lambda: F.lit("snowflake")}
    packages = {"core": {"default": lambda: F.lit("core.default"), "spark": lambda: F.lit("core.spark")}, "utils": {"default": lambda: F.lit("utils.default")}}
    return t.part.select("p_partkey", dispatch(divide)(F.col("p_retailprice"), F.col("p_size")).alias("own"), dispatch(name)().alias("other"), dispatch_in(packages, ["project", "core", "utils"])().alias("found"))


@query("A27_labels", "SELECT * FROM (VALUES ('job', 'cost_center', 'marketing'), ('job', 'team', 'analytics'), ('table', 'cost_center', 'marketing'), ('table', 'team', 'analytics'), ('comment', 'comment', 'cost_center=marketing, team=analytics')) v(kind, label, value)")
def _(t):
    labels, name = {"team": "analytics", "cost_center": "marketing"}, f"region_{uuid.uuid4().hex}"
    with labelled(t.spark, **labels):
        t.region.write.saveAsTable(name)
        try:
            label_table(t.spark, name, **labels)
            return labels_of(t.spark, name)
        finally:
            t.spark.sql(f"DROP TABLE {name}")


@query("A24_run_log_source", "SELECT model_name, count(*) AS n, round(sum(seconds) / 3600 * 2.5, 4) AS cost FROM runs GROUP BY 1", "runs")
def _(t):
    return t.runs.groupBy("model_name").agg(F.count("*").alias("n"), F.round(F.sum("seconds") / 3600 * 2.5, 4).alias("cost"))


# incremental strategies: the target is what was loaded by CUT, the batch what came later or changed


def _split(t):
    """Target: orders up to CUT. Batch: later orders, and every fifth older one with another price."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    old = o.filter(F.col("o_orderdate") <= _at(CUT))
    new = o.filter(F.col("o_orderdate") > _at(CUT))
    changed = old.filter("o_orderkey % 5 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1000)
    return old, new.unionByName(changed)


_SPLIT = "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderdate <= TIMESTAMP '2000-01-01' AND o_orderkey % 5 = 0 THEN o_totalprice + 1000 ELSE o_totalprice END AS o_totalprice, o_orderdate FROM orders"


@query("B01_delete_insert", _SPLIT)
def _(t):
    return I.delete_insert(*_split(t), ["o_orderkey"])


@query("B02_delete_insert_predicate", """SELECT o_orderkey, o_orderstatus, o_totalprice FROM (SELECT o_orderkey, o_orderstatus, o_totalprice, 1 AS keep FROM orders WHERE o_orderdate <= TIMESTAMP '2000-01-01' AND NOT (o_orderkey % 5 = 0 AND o_orderdate >= TIMESTAMP '1999-01-01')
  UNION ALL SELECT o_orderkey, CASE WHEN o_orderdate <= TIMESTAMP '2000-01-01' THEN o_orderstatus ELSE 'N' END, CASE WHEN o_orderdate <= TIMESTAMP '2000-01-01' THEN o_totalprice + 1000 ELSE o_totalprice END, 1 FROM orders WHERE o_orderdate > TIMESTAMP '2000-01-01' OR o_orderkey % 5 = 0)""")
def _(t):
    target, batch = _split(t)
    batch = batch.withColumn("o_orderstatus", F.lit("N"))
    return I.delete_insert(target, batch, ["o_orderkey"], "t.o_orderdate >= timestamp_ntz'1999-01-01'", keep=["o_orderstatus"]).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("B03_merge_upsert", _SPLIT)
def _(t):
    return I.upsert(*_split(t), ["o_orderkey"])


@query("B04_merge_delete_flag", "SELECT o_orderkey, CASE WHEN o_orderdate <= TIMESTAMP '2000-01-01' AND o_orderkey % 5 = 0 THEN o_totalprice + 1000 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders WHERE NOT (o_orderdate <= TIMESTAMP '2000-01-01' AND o_orderkey % 10 = 0)")
def _(t):
    target, batch = _split(t)
    batch = batch.withColumn("gone", (F.col("o_orderdate") <= _at(CUT)) & (F.col("o_orderkey") % 10 == 0)).withColumn("o_orderstatus", F.when(F.col("o_orderdate") <= _at(CUT), "X").otherwise(F.col("o_orderstatus")))
    clauses = [I.Clause("delete", "s.gone"), I.Clause("update", None, ["o_totalprice"])]
    return I.merge(target, batch, ["o_orderkey"], clauses, [I.Clause("insert", "not s.gone")]).select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("B05_guarded_merge", "SELECT event_id, user_id, value, ts FROM (SELECT user_id, event_id, value, ts, event_id % 10 = 9 AS gone, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND NOT gone")
def _(t):
    e = t.events.select("event_id", "user_id", "value", "ts", (F.col("event_id") % 10 == 9).alias("gone"))
    newest = lambda d: R.latest(d, "user_id", [F.col("ts").desc(), F.col("event_id").desc()])
    mid = _at("2024-01-15")
    target = newest(e.filter(F.col("ts") <= mid)).filter("not gone")
    return I.guarded_upsert(target, newest(e.filter(F.col("ts") > mid)), ["user_id"], "ts", "gone").select("event_id", "user_id", "value", "ts")


@query("B06_not_matched_by_source", "SELECT * FROM now", "now")
def _(t):
    return I.not_in_source_deleted(t.before, t.now, ["c_custkey"])


@query("B07_append", "SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '2000-01-01' AND o_orderkey % 5 = 0")
def _(t):
    return I.append(*_split(t)).select("o_orderkey")


@query("B08_append_new", "SELECT o_orderkey, o_totalprice FROM orders")
def _(t):
    return I.append_new(*_split(t), ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("B09_dedup_append", "SELECT user_id, day, event_id FROM (SELECT user_id, CAST(ts AS DATE) AS day, event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def _(t):
    e = t.events.withColumn("day", F.to_date("ts"))
    last = F.lit("2024-01-30").cast("date")
    make = lambda d: R.latest(d, ["user_id", "day"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "day", "event_id")
    target = make(e)
    return I.append(target.filter(F.col("day") != last), make(e.filter(F.col("day") == last)))


@query("B10_overwrite_window", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def _(t):
    daily = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    t.store.write("daily", daily.withColumn("n", F.when(F.col("day") >= F.lit("2024-01-24").cast("date"), F.lit(0)).otherwise(F.col("n")).cast("long")), partition_by=["day"])
    recent = t.store.write("recent", daily.filter(F.col("day") >= F.lit("2024-01-24").cast("date")))
    return t.store.overwrite_partitions("daily", recent, ["day"]).select("day", "n")


@query("B11_overwrite_dynamic", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def _(t):
    daily = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    stale = daily.withColumn("n", F.when(F.dayofmonth("day") % 3 == 0, F.lit(-1)).otherwise(F.col("n")).cast("long"))
    late = t.events.filter(F.dayofmonth("ts") % 3 == 0).select(F.to_date("ts").alias("day")).distinct()
    batch = t.events.withColumn("day", F.to_date("ts")).join(late, "day", "left_semi").groupBy("day").agg(F.count("*").alias("n"))
    return I.overwrite_partitions(stale, batch, ["day"])


@query("B12_overwrite_hourly", "SELECT date_trunc('hour', ts) AS hr, count(*) AS n FROM events GROUP BY 1")
def _(t):
    hourly = t.events.groupBy(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hr")).agg(F.count("*").alias("n"))
    since = _at("2024-01-30 18:00:00")
    return I.overwrite_partitions(hourly.filter(F.col("hr") < since).unionByName(hourly.filter(F.col("hr") >= since).withColumn("n", F.lit(0).cast("long"))), hourly.filter(F.col("hr") >= since), ["hr"])


def _numbered(df):
    from pyspark.sql import Window as W

    return df.select("event_id", "ts", F.row_number().over(W.partitionBy("user_id").orderBy("ts")).alias("nth"))


@query("B13_microbatch_day", "SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts) AS nth FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-04'")
def _(t):
    spans = list(I.batches(datetime(2024, 1, 1), datetime(2024, 1, 4), timedelta(days=1)))
    return I.microbatch(None, t.events, "ts", spans, _numbered).select("event_id", "nth")


@query("B14_microbatch_lookback", "SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts) AS nth FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-01 06:00:00'")
def _(t):
    first = list(I.batches(datetime(2024, 1, 1), datetime(2024, 1, 1, 4), timedelta(hours=1)))
    out = I.microbatch(None, t.events, "ts", first, _numbered)
    again = list(I.batches(datetime(2024, 1, 1), datetime(2024, 1, 1, 6), timedelta(hours=1), lookback=2, mark=datetime(2024, 1, 1, 4)))
    return I.microbatch(out, t.events, "ts", again, _numbered).select("event_id", "nth")


@query("B15_microbatch_bounds", "SELECT CAST(ts AS DATE) AS day, round(sum(value), 2) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13' GROUP BY 1")
def _(t):
    begin, end = (lambda: datetime(2024, 1, 10)), (lambda: datetime(2024, 1, 13))
    daily = lambda d: d.groupBy(F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 2).alias("total"))
    return I.microbatch(None, t.events, "ts", list(I.batches(begin(), end(), timedelta(days=1))), daily, "day")


@query("B16_soft_delete", "SELECT c_custkey, n.c_acctbal, CAST(NULL AS TIMESTAMP) AS deleted_at FROM now n UNION ALL SELECT c_custkey, c_acctbal, TIMESTAMP '2001-08-01' FROM before WHERE c_custkey % 11 = 0", "before now")
def _(t):
    target = t.before.select("c_custkey", "c_acctbal").withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
    return I.soft_delete(target, t.now.select("c_custkey", "c_acctbal"), ["c_custkey"], "2001-08-01")


@query("B17_hard_delete_sweep", "SELECT c_custkey FROM before WHERE c_custkey IN (SELECT c_custkey FROM now)", "before now")
def _(t):
    return I.sweep(t.before, t.now, ["c_custkey"]).select("c_custkey")


@query("B18_production_merge", """WITH e AS (SELECT user_id, event_type, value AS amount, ts, event_id, event_id % 10 <> 9 AS is_active FROM events),
  r AS (SELECT 1 AS run, * FROM e WHERE ts < TIMESTAMP '2024-01-24' UNION ALL SELECT 2, * FROM e WHERE ts >= (SELECT date_trunc('day', max(ts)) FROM e WHERE ts < TIMESTAMP '2024-01-24' AND amount > 1) - INTERVAL 3 DAY),
  c AS (SELECT *, CASE WHEN NOT is_active AND lag(is_active) OVER w THEN ts END AS deleted_at, CASE WHEN lag(event_type) OVER w <> event_type THEN 'type_changed' WHEN lag(amount) OVER w <> amount THEN 'amount_changed' ELSE 'no_change' END AS change_type FROM r WINDOW w AS (PARTITION BY run, user_id ORDER BY ts, event_id)),
  l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY run DESC, ts DESC, event_id DESC) AS rn FROM c WHERE amount > 1)
  SELECT user_id, event_type, amount, change_type, ts AS last_updated FROM l WHERE rn = 1 AND is_active AND deleted_at IS NULL""")
def _(t):
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    events = t.events.withColumnRenamed("value", "amount").withColumn("is_active", F.col("event_id") % 10 != 9)

    def model(rows):
        """Rows with what their change was, those of good quality, the newest of each key."""
        before = lambda c: F.lag(c).over(w)
        change = F.when(before("event_type") != F.col("event_type"), "type_changed").when(before("amount") != F.col("amount"), "amount_changed").otherwise("no_change")
        typed = rows.withColumn("deleted_at", F.when(~F.col("is_active") & before("is_active"), F.col("ts"))).withColumn("change_type", change)
        newest = R.latest(typed.filter("amount > 1"), "user_id", [F.col("ts").desc(), F.col("event_id").desc()])
        return newest.select("user_id", "event_type", "amount", "is_active", "deleted_at", "change_type", F.col("ts").alias("last_updated"))

    target = model(events.filter(F.col("ts") < _at("2024-01-24")))
    mark = I.high_water(target, "last_updated", datetime(1900, 1, 1))
    lookback = datetime(mark.year, mark.month, mark.day) - timedelta(days=3)
    merged = I.upsert(target, model(events.filter(F.col("ts") >= F.lit(lookback).cast("timestamp_ntz"))), ["user_id"])
    return merged.filter("is_active AND deleted_at IS NULL").drop("is_active", "deleted_at")


@query("B19_smart_merge", "SELECT c_custkey, c_acctbal, c_mktsegment FROM now UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM before WHERE c_custkey % 11 = 0", "before now")
def _(t):
    hashed = lambda d: d.select("c_custkey", "c_acctbal", "c_mktsegment", C.content_hash("c_acctbal", "c_mktsegment").alias("data_hash"))
    target, batch = hashed(t.before), hashed(t.now)
    return I.upsert(target, I.changed_only(target, batch, ["c_custkey"], "data_hash"), ["c_custkey"]).drop("data_hash")


@query("B20_watermark_table", "SELECT 'orders' AS table_name, max(o_orderdate) AS high_water FROM orders UNION ALL SELECT 'events', max(ts) FROM events")
def _(t):
    marks = values(t.spark, [("orders", datetime(1990, 1, 1))], "table_name string, high_water timestamp_ntz")
    found = R.union_all(t.orders.agg(F.max("o_orderdate").alias("high_water")).select(F.lit("orders").alias("table_name"), "high_water"), t.events.agg(F.max("ts").alias("high_water")).select(F.lit("events").alias("table_name"), "high_water"))
    return I.upsert(marks, found, ["table_name"])


@query("B21_update_case", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'CONSTRUCTION' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "CONSTRUCTION").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))


@query("B22_high_water", "SELECT o_orderkey FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders WHERE o_orderdate <= TIMESTAMP '2000-01-01')")
def _(t):
    this = t.orders.filter(F.col("o_orderdate") <= _at(CUT))
    return I.since(t.orders, "o_orderdate", I.high_water(this, "o_orderdate", datetime(1900, 1, 1))).select("o_orderkey")


@query("B23_safety_buffer", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20' AND ts <= TIMESTAMP '2024-01-30' - INTERVAL 1 MINUTE")
def _(t):
    return I.since(t.events, "ts", datetime(2024, 1, 20), until=datetime(2024, 1, 30) - timedelta(minutes=1)).select("event_id")


@query("B24_scoped_high_water", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_orderdate > (SELECT max(o_orderdate) FROM orders WHERE o_orderstatus = 'F' AND o_orderdate <= TIMESTAMP '2000-01-01')) OR (o_orderstatus <> 'F' AND o_orderdate > (SELECT max(o_orderdate) FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate <= TIMESTAMP '2000-01-01'))")
def _(t):
    this = t.orders.filter(F.col("o_orderdate") <= _at(CUT))
    parts = [I.since(t.orders.filter(w), "o_orderdate", I.high_water(this, "o_orderdate", datetime(1900, 1, 1), w)) for w in ("o_orderstatus = 'F'", "o_orderstatus <> 'F'")]
    return R.union_all(*parts).select("o_orderkey")


@query("B25_sequence_cap", "SELECT lsn FROM changes WHERE lsn > 100 AND lsn <= 100 + 500", "changes")
def _(t):
    return I.since(t.changes, "lsn", 100, most=500).select("lsn")


@query("B26_affected_keys", "SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE ts > TIMESTAMP '2024-01-30 12:00:00')")
def _(t):
    return I.affected_keys(t.events, ["user_id"], "ts", datetime(2024, 1, 30, 12)).select("event_id")


@query("B27_full_refresh_switch", "SELECT event_id, 'lookback' AS mode FROM events WHERE ts >= TIMESTAMP '2024-01-28' UNION ALL SELECT event_id, 'full' FROM events")
def _(t):
    def make(full: bool, days: int):
        return t.events if full else t.events.filter(F.col("ts") >= _at("2024-01-31") - F.expr(f"interval {days} days"))

    return R.union_all(*[make(f, 3).select("event_id", F.lit(m).alias("mode")) for f, m in ((False, "lookback"), (True, "full"))])


@query("B28_recent_window", "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    make = lambda d: d.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    late = F.col("ts") >= _at("2024-01-28")
    target = make(t.events.filter(~late | (F.col("event_id") % 2 == 0)))
    return I.delete_insert(target, make(t.events.filter(late)), ["user_id", "day"])


@query("B29_bounded_batch", "SELECT lsn FROM changes WHERE lsn > 50 ORDER BY lsn LIMIT 200", "changes")
def _(t):
    return t.changes.filter("lsn > 50").select("lsn").orderBy("lsn").limit(200)


@query("B30_shards", "SELECT o_orderkey % 4 AS shard, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    parts = [t.orders.filter(F.col("o_orderkey") % 4 == s).agg(F.count("*").alias("n")).select(F.lit(s).alias("shard"), "n") for s in range(4)]
    return R.union_all(*parts)
