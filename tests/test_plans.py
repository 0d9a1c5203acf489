import pytest
from pyspark.sql import functions as F

from tidemark.plans import semantic as S
from tidemark.plans.project import Context, Project, Slots, choose_materialization, log_run, pr_environment, schema_name
from tidemark.queries.base import Tables
from tidemark.queries.metrics import registry
from tidemark.sources.registry import Catalog, Source, date_spine
from tidemark.sources.storage import Store

SF = "/root/testdata/sf0.001"


@pytest.fixture
def tables(spark):
    return Tables(spark, SF)


@pytest.fixture
def ctx(spark, tables):
    return Context(spark, tables.catalog, Store.scratch(spark), "2001-08-01")


def test_order_lint_and_skip(ctx):
    p = Project()
    p.model("stg_a", layer="staging")(lambda c: c.source("region"))
    p.model("int_b", layer="intermediate", depends_on=["stg_a"])(lambda c: c.ref("nowhere"))
    p.model("fct_c", depends_on=["int_b"])(lambda c: c.ref("int_b"))
    p.model("odd", layer="staging", depends_on=["fct_c"])(lambda c: c.ref("fct_c"))
    assert p.order(["int_b"]) == ["stg_a", "int_b"]
    assert len(p.lint()) == 2
    assert [(r.model, r.status) for r in p.run(ctx)] == [("stg_a", "success"), ("int_b", "error"), ("fct_c", "skipped"), ("odd", "skipped")]
    p.model("fct_d", depends_on=["missing"])(lambda c: None)
    with pytest.raises(ValueError, match="missing"):
        p.order()


def test_hooks_tests_and_log(ctx):
    seen = []
    p = Project()
    p.model("dim_r", pre_hooks=[lambda c: seen.append("pre")], post_hooks=[lambda c: seen.append("post")])(lambda c: c.source("region"))
    p.test("dim_r", lambda d: d.filter("r_regionkey > 3"), "few", store=True)
    p.on_start.append(lambda c: seen.append("start"))
    p.on_end.append(log_run(ctx.store))
    p.run(ctx)
    assert seen == ["start", "pre", "post"] and ctx.store.read("run_log").count() == 1
    verdict = p.check(ctx)[0]
    assert (verdict.failures, verdict.status) == (1, "error") and ctx.store.read("test_failures_dim_r_few").count() == 1


@pytest.mark.parametrize("strategy", ["append_new", "delete_insert", "merge"])
def test_incremental_equals_full_refresh(ctx, strategy):
    p = Project()

    def make(c):
        src = c.source("orders").select("o_orderkey", "o_orderdate")
        return src.filter("o_orderkey >= 700") if c.is_incremental else src.filter("o_orderkey < 800") if c.var("first") else src

    p.model("fct_o", materialized="incremental", strategy=strategy, unique_key=["o_orderkey"])(make)
    ctx.vars = {"first": True}
    p.run(ctx)
    p.run(ctx)
    two = sorted(r.o_orderkey for r in ctx.built["fct_o"].collect())
    p.run(ctx)
    assert sorted(r.o_orderkey for r in ctx.built["fct_o"].collect()) == two
    ctx.vars, ctx.full_refresh = {}, True
    p.run(ctx)
    assert sorted(r.o_orderkey for r in ctx.built["fct_o"].collect()) == two


def test_store_versions(spark):
    store = Store.scratch(spark)
    store.write("t", spark.range(3))
    old = store.read("t")
    store.replace("t", lambda d: d.filter("id > 0"))
    assert old.count() == 3 and store.read("t").count() == 2 and store.versions("t") == [1, 2]
    store.write("t", spark.range(9))
    assert store.versions("t") == [2, 3]
    store.append("t", spark.range(1))
    assert store.read("t").count() == 10
    store.drop("t")
    assert not store.exists("t")


def test_slots(spark):
    store = Store.scratch(spark)
    slots = Slots(store)
    assert (slots.active(), slots.idle()) == ("blue", "green")
    store.write("green/dim_x", spark.range(5))
    assert slots.switch(["dim_x"]) == "green" and slots.active() == "green" and spark.table("dim_x").count() == 5
    slots.clean(["dim_x"])
    assert store.exists("green/dim_x")


def test_guards_and_freshness(tables):
    with pytest.raises(ValueError, match="filter on ts"):
        tables.catalog.read("raw", "events", "event_id > 5", require_filter_on="ts")
    c = Catalog(tables.spark)
    c.add(Source("raw", "events", f"{SF}/events.parquet", loaded_at="ts", warn_after_hours=1, error_after_hours=48))
    assert c.freshness("raw", "events", "2024-01-31 12:00:00").first().status == "warn"
    assert c.freshness("raw", "events", "2024-03-01").first().status == "error"


def test_names_and_switches():
    assert schema_name("base", "marts", "dev") == "base_marts" and schema_name("base", "marts", "prod") == "marts" and schema_name("base", None, "dev") == "base"
    assert pr_environment("Feature/ABC-1", 7) == "pr_7_feature_abc_1"
    assert [choose_materialization(n) for n in (10, 2_000_000, 20_000_000)] == ["view", "table", "incremental"]


def test_metric_errors_and_discovery(tables):
    r = registry(tables)
    with pytest.raises(ValueError, match="can't reach"):
        r.query(S.MetricQuery(["total_revenue"], ["nonsense"]))
    with pytest.raises(ValueError, match="granularity"):
        r.query(S.MetricQuery(["total_revenue"], granularity="minute"))
    assert "segment" in r.dimensions_of("average_order_value") and r.dimensions_of("unresolved") == []
    assert S.governance_lint(r) == [] and "measure: revenue" in S.lookml(r.models["orders"])
    assert {m["name"] for m in r.list_models()} == {"orders", "customers"}


def test_policy(tables):
    p = S.Policy("analyst", {"customers": "c_custkey < 3"}, {"c_name": lambda c: F.lit("hidden")})
    assert [tuple(x) for x in p.apply("customers", tables.customer.select("c_custkey", "c_name")).orderBy("c_custkey").collect()] == [(0, "hidden"), (1, "hidden"), (2, "hidden")]


def test_spines(spark):
    assert date_spine(spark, "2024-02-27", "2024-03-02").count() == 4
    assert date_spine(spark, "2024-02-27", "2024-03-02", include_end=True).count() == 5
    assert date_spine(spark, "2024-01-01", "2024-01-02", "hour").count() == 24
    row = S.time_spine(spark, "2024-04-01", "2024-04-01").first()
    assert row.fiscal_year == 2025 and row.fiscal_quarter == 1 and row.season == "spring"
