import json
import time
import warnings

import pytest

from tidemark.plans import tools
from tidemark.queries.base import Tables
from tidemark.queries.metrics import registry

SF = "/root/testdata/sf0.001"


def test_stages_run_in_order_and_skip_after_failures():
    ran = []

    def bad():
        raise RuntimeError

    stages = [tools.Stage("c", lambda: ran.append("c"), ["a"]), tools.Stage("a", lambda: ran.append("a")), tools.Stage("b", bad), tools.Stage("d", lambda: ran.append("d"), ["b"], False), tools.Stage("slow", lambda: time.sleep(0.4), timeout=0.05)]
    assert tools.run_stages(stages) == {"a": "success", "b": "error", "c": "success", "d": "skipped", "slow": "timeout"}
    assert ran == ["a", "c"]


def test_settings_and_dispatch():
    assert tools.flattened(tools.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}, "d": 4})) == {"a.b": 3, "a.c": 2, "d": 4}
    assert tools.dispatch({"default": str, "spark": int}) is int and tools.dispatch({"default": str}, "other") is str
    with pytest.raises(KeyError):
        tools.dispatch({})


def test_maintenance(spark):
    spark.range(3).write.mode("overwrite").saveAsTable("kept_up")
    with warnings.catch_warnings(record=True) as found:
        warnings.simplefilter("always")
        assert tools.maintain(spark, "kept_up", ["statistics", "indexes"]) == ["statistics"]
    assert any("indexes" in str(w.message) for w in found)
    spark.sql("DROP TABLE kept_up")


def test_exports(spark):
    r = registry(Tables(spark, SF))
    made = json.loads(tools.dataset_json(r.models["orders"]))
    assert {m["name"] for m in made["tables"][0]["measures"]} == {"revenue", "order_count", "customers", "average_price"}
    assert "role='measure'" in tools.datasource_xml(r, "orders")


def test_labels(spark):
    with tools.labelled(spark, model="x"):
        assert spark.sparkContext.getLocalProperty("tidemark.label.model") == "x"
        assert sorted(map(tuple, tools.labels_of(spark).collect())) == [("comment", "comment", "model=x"), ("job", "model", "x")]
    assert spark.sparkContext.getLocalProperty("tidemark.label.model") is None and tools.labels_of(spark).count() == 0


def test_search_order():
    packages = {"a": {"other": 1}, "b": {"default": 2}, "c": {"spark": 3}}
    assert tools.dispatch_in(packages, ["a", "b", "c"]) == 2 and tools.dispatch_in(packages, ["c", "b"]) == 3 and tools.dispatch_in(packages, ["a"], "other") == 1
    with pytest.raises(KeyError):
        tools.dispatch_in(packages, ["a"])
