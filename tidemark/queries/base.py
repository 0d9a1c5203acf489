"""Registration of queries, and feeds that stand in for tables the test data lack."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.registry import Catalog, tables
from tidemark.sources.storage import Store

#: The present, for orders and for events.
ORDERS_NOW, EVENTS_NOW = "2001-08-01", "2024-01-31"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder by name, and feeds derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def catalog(self) -> Catalog:
        return tables(self.spark, self.sf_dir)

    @cached_property
    def store(self) -> Store:
        return Store.scratch(self.spark)

    def __getattr__(self, name: str) -> DataFrame:
        if ("raw", name) not in self.catalog.sources:
            raise AttributeError(name)
        return self.catalog.read("raw", name)

    @property
    def log(self) -> DataFrame:
        """A change log: lsn, key, op, txn_id, commit_ts, payload {before, after} of {status, amount}."""
        e = self.events
        op = F.when(F.col("event_id") % 10 == 0, "INSERT").when(F.col("event_id") % 10 == 9, "DELETE").otherwise("UPDATE")
        image = F.struct(F.col("event_type").alias("status"), F.col("value").alias("amount"))
        payload = F.when(op == "DELETE", F.to_json(F.struct(image.alias("before")))).otherwise(F.to_json(F.struct(image.alias("after"))))
        return e.select(F.col("event_id").alias("lsn"), F.col("user_id").alias("key"), op.alias("op"), F.expr("event_id div 3").alias("txn_id"), F.col("ts").alias("commit_ts"), payload.alias("payload"))

    @property
    def changes(self) -> DataFrame:
        """The log with its payload parsed: status and amount."""
        from tidemark.operators.cdc import parse_log

        return parse_log(self.log, "payload", {"status": "string", "amount": "double"}).drop("payload")

    @property
    def audit(self) -> DataFrame:
        """Changes of customers as rows (audit_id, customer_id, column_name, old_value, new_value, operation, changed_at)."""
        c, k = self.customer, F.col("c_custkey")
        rows = F.array(
            F.when(k % 2 == 0, F.struct(F.lit("segment").alias("column_name"), F.col("c_mktsegment").alias("old_value"), F.when(k % 6 == 0, F.lit("VIP")).otherwise(F.col("c_mktsegment")).alias("new_value"))),
            F.when(k % 3 == 0, F.struct(F.lit("nation").alias("column_name"), F.col("c_nationkey").cast("string").alias("old_value"), ((F.col("c_nationkey") + 1) % 25).cast("string").alias("new_value"))),
            F.when(k % 5 == 0, F.struct(F.lit("name").alias("column_name"), F.col("c_name").alias("old_value"), F.upper("c_name").alias("new_value"))),
        )
        op = F.when(k % 7 == 0, "I").when(k % 11 == 0, "D").otherwise("U")
        at = F.expr("timestamp_ntz'2001-01-01 00:00:00' + make_dt_interval(0, 0, cast(c_custkey % 5000 as int), 0)")
        return c.select(k.alias("customer_id"), op.alias("operation"), at.alias("changed_at"), F.inline(F.array_compact(rows)))

    @property
    def before(self) -> DataFrame:
        """Yesterday's customers: some missing, some with other balances or segments."""
        k = F.col("c_custkey")
        balance = F.when(k % 7 == 0, F.col("c_acctbal") + 100).otherwise(F.col("c_acctbal"))
        segment = F.when(k % 13 == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment"))
        return self.customer.filter(k % 10 != 0).select("c_custkey", F.col("c_nationkey").cast("long").alias("c_nationkey"), balance.alias("c_acctbal"), segment.alias("c_mktsegment"))

    @property
    def now(self) -> DataFrame:
        """Today's customers: some of yesterday's are gone, some are new."""
        return self.customer.filter(F.col("c_custkey") % 11 != 0).select("c_custkey", F.col("c_nationkey").cast("long").alias("c_nationkey"), "c_acctbal", "c_mktsegment")

    @property
    def runs(self) -> DataFrame:
        """A log of model runs: run_id, model_name, seconds, n_rows, run_at, status."""
        k = F.col("o_orderkey")
        return self.orders.select(k.alias("run_id"), F.col("o_orderpriority").alias("model_name"), (F.col("o_totalprice") / 1000).alias("seconds"), (k % 1000 * 100 + 50).alias("n_rows"), F.col("o_orderdate").alias("run_at"), F.when(k % 20 == 0, "error").otherwise("success").alias("status"))

    @property
    def emails(self) -> DataFrame:
        """Customers with addresses of every kind."""
        k = F.col("c_custkey")
        plain = F.concat(F.regexp_replace(F.lower("c_name"), "#", "."), F.lit("@example.com"))
        email = F.when(k % 17 == 0, F.lit(None).cast("string")).when(k % 19 == 0, F.lit("no-at-sign")).when(k % 23 == 0, F.lit("a@b@c.com")).when(k % 29 == 0, F.concat(F.lit(" "), F.upper(plain))).when(k % 31 == 0, F.lit("someone@tempmail.com")).otherwise(plain)
        return self.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", email.alias("email"))


#: The feeds in SQL, to be put in front of a query by name.
FEEDS = {
    "changes": "changes AS (SELECT event_id AS lsn, user_id AS key, CASE WHEN event_id % 10 = 0 THEN 'INSERT' WHEN event_id % 10 = 9 THEN 'DELETE' ELSE 'UPDATE' END AS op, event_id // 3 AS txn_id, ts AS commit_ts, event_type AS status, value AS amount FROM events)",
    "audit": """audit AS (SELECT customer_id, operation, changed_at, column_name, old_value, new_value FROM (
      SELECT c_custkey AS customer_id, CASE WHEN c_custkey % 7 = 0 THEN 'I' WHEN c_custkey % 11 = 0 THEN 'D' ELSE 'U' END AS operation, TIMESTAMP '2001-01-01 00:00:00' + to_minutes(CAST(c_custkey % 5000 AS BIGINT)) AS changed_at,
        'segment' AS column_name, c_mktsegment AS old_value, CASE WHEN c_custkey % 6 = 0 THEN 'VIP' ELSE c_mktsegment END AS new_value, c_custkey % 2 = 0 AS there FROM customer
      UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'I' WHEN c_custkey % 11 = 0 THEN 'D' ELSE 'U' END, TIMESTAMP '2001-01-01 00:00:00' + to_minutes(CAST(c_custkey % 5000 AS BIGINT)), 'nation', CAST(c_nationkey AS VARCHAR), CAST((c_nationkey + 1) % 25 AS VARCHAR), c_custkey % 3 = 0 FROM customer
      UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'I' WHEN c_custkey % 11 = 0 THEN 'D' ELSE 'U' END, TIMESTAMP '2001-01-01 00:00:00' + to_minutes(CAST(c_custkey % 5000 AS BIGINT)), 'name', c_name, upper(c_name), c_custkey % 5 = 0 FROM customer) WHERE there)""",
    "before": "before AS (SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 10 <> 0)",
    "now": "now AS (SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 11 <> 0)",
    "runs": "runs AS (SELECT o_orderkey AS run_id, o_orderpriority AS model_name, o_totalprice / 1000 AS seconds, o_orderkey % 1000 * 100 + 50 AS n_rows, o_orderdate AS run_at, CASE WHEN o_orderkey % 20 = 0 THEN 'error' ELSE 'success' END AS status FROM orders)",
    "emails": """emails AS (SELECT c_custkey, c_name, c_acctbal, c_mktsegment, CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN 'no-at-sign' WHEN c_custkey % 23 = 0 THEN 'a@b@c.com' WHEN c_custkey % 29 = 0 THEN ' ' || upper(replace(lower(c_name), '#', '.') || '@example.com')
      WHEN c_custkey % 31 = 0 THEN 'someone@tempmail.com' ELSE replace(lower(c_name), '#', '.') || '@example.com' END AS email FROM customer)""",
}


#: Whole numbers that the other engine would give as 32-bit integers.
WIDE = {
    "A01_source_scan": "s_nationkey", "A04_seed": "r_regionkey", "A10_ephemeral": "p_size", "A20_schema_evolution": "p_size", "A21_hooks": "place", "A29_parquet_and_csv": "r_regionkey", "C25_storage_optimized": "type_code",
    "D04_mixed_scd": "version_number", "D06_scd2_quality": "unclosed current_with_end", "E02_star_computed": "l_linenumber", "E08_lateral_alias": "l_linenumber", "F05_theta_scenarios": "target", "F16_lookup_join": "tier",
    "I01_order_by": "n_regionkey", "J01_union_all": "nation", "J02_union_distinct": "nation", "L02_extremes": "l_linenumber", "L21_casts": "dirty", "L22_json": "list_size", "L26_score_ladder": "score", "L28_audit_columns": "r_regionkey",
    "N04_reduce_columns": "l_linenumber", "N08_memoized": "computed", "N15_stage_waves": "wave", "O05_expression_is_true": "l_linenumber", "O06_unique_combination": "l_linenumber", "Q01_health_score": "score", "Q09_shard_load": "shard",
    "Q21_deployment_audit": "models failures", "R04_governance_tiers": "tier sla_hours", "R08_environment_names": "prod_threads", "R09_environment_profiles": "threads sample_percent", "S01_rfm_segments": "rs fs ms", "S04_metric_framework": "c_nationkey",
    "S13_margin_model": "l_linenumber",
}


def query(name: str, sql: str | None = None, feeds: str = "") -> Callable:
    """Register a function of Tables as query name; feeds names the FEEDS that its SQL uses.

    Results have long for every whole number and timestamps without zone, as the other engine has them.
    """

    def add(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(f(Tables(spark, sf_dir)))

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            body = sql.strip()
            if feeds:
                front = ", ".join(FEEDS[x] for x in feeds.split())
                body = f"WITH {front}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {front} {body}"
            if name in WIDE:
                body = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in WIDE[name].split())}) FROM ({body})"
            ORACLES[name] = body
        return f

    return add


def plain(df: DataFrame) -> DataFrame:
    casts = {}
    for f in df.schema:
        if isinstance(f.dataType, T.IntegerType | T.ShortType | T.ByteType):
            casts[f.name] = F.col(f.name).cast("long")
        elif isinstance(f.dataType, T.FloatType | T.DecimalType):
            casts[f.name] = F.col(f.name).cast("double")
        elif isinstance(f.dataType, T.TimestampType):
            casts[f.name] = F.col(f.name).cast("timestamp_ntz")
    return df.withColumns(casts) if casts else df
