"""Row and column restrictions, consent, environments and deployment slots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import checks as K
from tidemark.operators import monitoring as M
from tidemark.plans import semantic as S
from tidemark.plans.project import ENVIRONMENTS, Slots, pr_environment, schema_name
from tidemark.queries.base import query
from tidemark.queries.metrics import registry
from tidemark.sources.registry import values


@query("R01_row_restrictions", "SELECT o_orderstatus AS order_status, count(*) AS orders FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def _(t):
    return registry(t, {"orders": "o_orderstatus <> 'P'"}).query(S.MetricQuery(["orders"], ["order_status"]))


@query("R02_column_masking", "SELECT c_custkey, 'user_' || substr(md5(c_name), 1, 8) AS c_name, regexp_replace(email, '^(.).*@(.*)$', '\\1***@\\2') AS email FROM emails", "emails")
def _(t):
    policy = S.Policy("analyst", masks={".*email.*": C.mask_email, ".*_name": C.anonymize_name})
    return policy.apply("customers", t.emails.select("c_custkey", "c_name", "email"))


@query("R03_measure_constraints", "SELECT 'price_positive' AS check_name, count(*) FILTER (WHERE NOT o_totalprice > 0) AS failures, CASE WHEN count(*) FILTER (WHERE NOT o_totalprice > 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM orders UNION ALL SELECT 'price_range', count(*) FILTER (WHERE o_totalprice > 300000), CASE WHEN count(*) FILTER (WHERE o_totalprice > 300000) = 0 THEN 'PASS' ELSE 'FAIL' END FROM orders")
def _(t):
    return K.summary(("price_positive", K.expression_is_true(t.orders, "o_totalprice > 0")), ("price_range", K.expression_is_true(t.orders, "o_totalprice <= 300000")))


@query("R05_consent", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE sha256('r' || c_name) END AS name FROM customer WHERE c_custkey % 4 <> 0")
def _(t):
    given = F.col("c_custkey") % 3 == 0
    return t.customer.filter("c_custkey % 4 <> 0").select("c_custkey", F.when(given, F.col("c_name")).otherwise(C.hash_pii("c_name", "r")).alias("name"))


@query("R06_pattern_monitors", "SELECT * FROM (VALUES ('c_custkey', 'unique'), ('c_name', 'not_null'), ('c_acctbal', 'range')) v(column_name, monitor)")
def _(t):
    return values(t.spark, K.monitors(t.customer.columns, {"*custkey": "unique", "*name": "not_null", "*bal": "range"}), "column_name string, monitor string")


@query("R07_blue_green", "SELECT 'green' AS slot, true AS is_active UNION ALL SELECT 'blue', false")
def _(t):
    slots = Slots(t.store)
    t.store.write(f"{slots.idle()}/dim_region", t.region)
    slots.switch(["dim_region"])
    return t.store.read(slots.table)


@query("R08_environment_names", "SELECT 'pr_12_feature_new_metric' AS name, 'analytics_marts' AS dev_schema, 'marts' AS prod_schema, 12 AS prod_threads")
def _(t):
    return values(t.spark, [(pr_environment("feature/new-metric", 12), schema_name("analytics", "marts", "dev"), schema_name("analytics", "marts", "prod"), ENVIRONMENTS["prod"].threads)], "name string, dev_schema string, prod_schema string, prod_threads long")


@query("Q18_environment_sample", f"SELECT o_orderkey FROM orders WHERE CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15) AS BIGINT) % 100 < {ENVIRONMENTS['ci'].sample_percent}")
def _(t):
    return M.sample_percent(t.orders, "o_orderkey", ENVIRONMENTS["ci"].sample_percent).select("o_orderkey")


@query("A21_hooks", "SELECT * FROM (VALUES (1, 'start'), (2, 'pre'), (3, 'post'), (4, 'end')) v(place, hook)")
def _(t):
    from tidemark.plans.project import Context, Project

    seen = []
    p = Project()
    p.model("dim_r", pre_hooks=[lambda c: seen.append("pre")], post_hooks=[lambda c: seen.append("post")])(lambda c: c.source("region"))
    p.on_start.append(lambda c: seen.append("start"))
    p.on_end.append(lambda c, r: seen.append("end"))
    p.run(Context(t.spark, t.catalog, t.store, "2001-08-01"))
    return values(t.spark, list(enumerate(seen, 1)), "place long, hook string")


@query("A25_schema_naming", "SELECT * FROM (VALUES ('dev', 'analytics_marts'), ('ci', 'analytics_marts'), ('prod', 'marts')) v(env, schema_name)")
def _(t):
    return values(t.spark, [(e, schema_name("analytics", "marts", e)) for e in ("dev", "ci", "prod")], "env string, schema_name string")


@query("A28_project_lint", "SELECT 'orders: staging models start with stg_' AS problem UNION ALL SELECT 'stg_late: staging refers to later marts fct_x'")
def _(t):
    from tidemark.plans.project import Project

    p = Project()
    p.model("orders", layer="staging")(lambda c: None)
    p.model("fct_x", depends_on=["orders"])(lambda c: None)
    p.model("stg_late", layer="staging", depends_on=["fct_x"])(lambda c: None)
    return values(t.spark, [(x,) for x in p.lint()], "problem string")


@query("A29_parquet_and_csv", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
def _(t):
    from tidemark.plans.tools import extract
    from tidemark.sources.registry import seed

    extract(t.region, f"{t.store.root}/region_csv")
    extract(t.region, f"{t.store.root}/region_parquet", "parquet")
    csv = seed(t.spark, f"{t.store.root}/region_csv", "r_regionkey int, r_name string")
    return csv.unionByName(t.spark.read.parquet(f"{t.store.root}/region_parquet"))


@query("N08_memoized", "SELECT count(*) AS n, 1 AS computed FROM orders")
def _(t):
    from tidemark.plans.tools import Memo

    made, memo = [], Memo()
    for _ in range(3):
        df = memo.get("n", lambda: made.append(1) or t.orders.agg(F.count("*").alias("n")))
    return df.withColumn("computed", F.lit(len(made)))


@query("N10_nested_config", "SELECT * FROM (VALUES ('marts.materialized', 'table'), ('marts.finance.tier', '1'), ('staging.materialized', 'view')) v(path, setting)")
def _(t):
    from tidemark.plans.tools import flattened, merged

    base = {"marts": {"materialized": "view", "finance": {"tier": 3}}, "staging": {"materialized": "view"}}
    found = flattened(merged(base, {"marts": {"materialized": "table", "finance": {"tier": 1}}}))
    return values(t.spark, [(k, str(v)) for k, v in found.items()], "path string, setting string")


@query("N15_stage_waves", "SELECT * FROM (VALUES (1, 'extract_a'), (1, 'extract_b'), (2, 'load'), (3, 'report')) v(wave, stage)")
def _(t):
    from tidemark.plans.tools import Stage, waves

    nothing = lambda: None
    stages = [Stage("report", nothing, ["load"]), Stage("load", nothing, ["extract_a", "extract_b"], parallel_safe=False), Stage("extract_a", nothing), Stage("extract_b", nothing)]
    return values(t.spark, [(i, n) for i, w in enumerate(waves(stages), 1) for n in w], "wave long, stage string")


@query("O18_constraint_inventory", "SELECT * FROM (VALUES ('orders', 'o_orderkey', 'primary_key'), ('orders', 'o_totalprice', 'not_null'), ('orders', 'o_totalprice', 'check')) v(table_name, column_name, kind)")
def _(t):
    contract = [K.Rule("o_orderkey", "bigint", primary_key=True), K.Rule("o_totalprice", "double", not_null=True, check="o_totalprice > 0")]
    return values(t.spark, K.constraints(contract, "orders"), "table_name string, column_name string, kind string")


@query("Q21_deployment_audit", "SELECT 'prod' AS env, 2 AS models, 1 AS failures, 'failed' AS status, 'prod: fct_bad failed' AS alert")
def _(t):
    from tidemark.plans.project import Context, Project
    from tidemark.plans.tools import audit

    alerts = []
    p = Project()
    p.model("dim_r")(lambda c: c.source("region"))
    p.model("fct_bad")(lambda c: c.source("no_such_table"))
    p.on_end.append(audit(t.store, alerts.append))
    p.run(Context(t.spark, t.catalog, t.store, "2001-08-01"))
    return t.store.read("deployment_audit").select("env", "models", "failures", "status", F.lit(alerts[0]).alias("alert"))


@query("R04_governance_tiers", "SELECT * FROM (VALUES ('revenue', 1, 4, true, false), ('churn', 2, 24, false, true), ('visits', 3, 72, true, true)) v(metric, tier, sla_hours, approved, review_due)")
def _(t):
    from datetime import date

    from tidemark.plans.tools import Record, governance

    records = [Record("revenue", 1, "finance", ["a", "b"], date(2001, 7, 1)), Record("churn", 2, "growth", [], date(2000, 7, 1)), Record("visits", 3, "web")]
    return values(t.spark, governance(records, date(2001, 8, 1)), "metric string, tier long, sla_hours long, approved boolean, review_due boolean")


@query("R09_environment_profiles", "SELECT * FROM (VALUES ('dev', 4, 1), ('ci', 4, 5), ('staging', 8, 50), ('prod', 12, 100)) v(env, threads, sample_percent)")
def _(t):
    return values(t.spark, [(e.name, e.threads, e.sample_percent) for e in ENVIRONMENTS.values()], "env string, threads long, sample_percent long")


@query("R10_ci_matrix", "SELECT e AS env, s AS step FROM (VALUES ('ci'), ('staging')) a(e) CROSS JOIN (VALUES ('dependencies'), ('lint'), ('build'), ('test'), ('docs')) b(s)")
def _(t):
    from tidemark.plans.tools import ci_matrix

    return values(t.spark, ci_matrix(["ci", "staging"]), "env string, step string")
