from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cdc, checks, scd
from tidemark.operators import incremental as inc
from tidemark.operators import monitoring as mon


def data(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_upsert_is_idempotent(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    s = spark.createDataFrame([(2, "B"), (3, "c"), (None, "N")], "k int, v string")
    once = inc.upsert(t, s, ["k"])
    assert data(once) == sorted([(1, "a"), (2, "B"), (3, "c"), (None, "N")], key=repr)
    assert data(inc.upsert(once, s, ["k"])) == data(once)


def test_deletes_come_before_updates(spark):
    schema = "k int, v string, ts timestamp_ntz, gone boolean"
    now, before = datetime(2024, 1, 2), datetime(2024, 1, 1)
    t = spark.createDataFrame([(1, "a", before, False), (2, "b", before, False), (4, "d", now, False), (5, "e", None, False)], schema)
    s = spark.createDataFrame([(1, "A", now, True), (2, "B", now, False), (3, "c", now, True), (4, "D", before, False), (5, "E", before, False), (6, "f", None, False)], schema)
    assert data(inc.guarded_upsert(t, s, ["k"], "ts", "gone").select("k", "v")) == [(2, "B"), (4, "d"), (5, "E")]


def test_merge_clauses(spark):
    t = spark.createDataFrame([(1, 1, 1), (2, 2, 2), (9, 9, 9)], "k int, a int, b int")
    s = spark.createDataFrame([(1, 10, 10), (2, 20, 20), (3, 30, 30)], "k int, a int, b int")
    out = inc.merge(t, s, ["k"], [inc.Clause("update", "s.a < 15", ["a"]), inc.Clause("delete")], [inc.Clause("insert", "s.a > 100")], [inc.Clause("delete", "t.a = 9")])
    assert data(out) == [(1, 10, 1)]


def test_schema_evolution(spark):
    t, s = spark.createDataFrame([(1, "x")], "k int, old string"), spark.createDataFrame([(2, 5)], "k int, new int")
    assert inc.append(*inc.evolve(t, s, "append")).columns == ["k", "old", "new"]
    assert inc.append(*inc.evolve(t, s, "sync")).columns == ["k", "new"]
    assert inc.append(*inc.evolve(t, s, "ignore")).columns == ["k", "old"]
    with pytest.raises(ValueError, match="new"):
        inc.evolve(t, s, "fail")


def test_batches_look_back():
    spans = list(inc.batches(datetime(2024, 1, 1), datetime(2024, 1, 5), timedelta(days=1), lookback=1, mark=datetime(2024, 1, 3, 5)))
    assert [s[0].day for s in spans] == [2, 3, 4]


def test_history_in_parts_equals_history_at_once(spark):
    rows = [(k, v, datetime(2024, 1, d), d * 10 + k) for k in (1, 2, 3) for d, v in ((1, "a"), (3, "b"), (5, "x" if k == 2 else "c"), (7, "d"))]
    changes = spark.createDataFrame(rows, "k int, v string, ts timestamp_ntz, n int")
    gone = F.col("v") == "x"
    whole = scd.versions(changes, "k", "ts", ["n"], gone)
    first = scd.versions(changes.filter("ts < timestamp_ntz'2024-01-04'"), "k", "ts", ["n"], gone)
    parts = scd.apply_versions(first, changes.filter("ts >= timestamp_ntz'2024-01-04'"), "k", "ts", ["n"], gone)
    assert data(whole) == data(parts.select(*whole.columns))
    assert {r.status for r in scd.quality(parts, "k").collect()} == {"PASS"} and scd.overlaps(parts, "k").count() == 0


def test_snapshot_runs(spark):
    schema = "k int, v string, ts timestamp_ntz"
    a = spark.createDataFrame([(1, "a", datetime(2024, 1, 1)), (2, "b", datetime(2024, 1, 1))], schema)
    b = spark.createDataFrame([(1, "A", datetime(2024, 1, 2)), (3, "c", datetime(2024, 1, 2))], schema)
    one = scd.snapshot(None, a, "k", "ts")
    two = scd.snapshot(one, b, "k", "ts", as_of="2024-01-03")
    got = {(r.k, r.v): r.valid_to for r in two.collect()}
    assert got == {(1, "a"): datetime(2024, 1, 2), (1, "A"): None, (2, "b"): datetime(2024, 1, 3), (3, "c"): None}
    assert data(scd.snapshot(two, b, "k", "ts", as_of="2024-01-04")) == data(two)


def test_snapshot_diff_null_safety(spark):
    p = spark.createDataFrame([(1, None), (2, "x")], "k int, v string")
    c = spark.createDataFrame([(1, "new"), (2, "x")], "k int, v string")
    kinds = lambda **how: {r.k: r.change_type for r in cdc.snapshot_diff(p, c, "k", ["v"], **how).collect()}
    assert kinds() == {1: "UPDATE", 2: "NO_CHANGE"} and kinds(null_safe=False) == {1: "NO_CHANGE", 2: "NO_CHANGE"}


def test_gaps_over_ranges(spark):
    edge = 1 << 20
    log = spark.createDataFrame([(x,) for x in (1, 2, 5, edge - 1, edge, edge + 3)], "n long")
    assert data(cdc.sequence_gaps(log, "n")) == sorted([(2, 5, 2), (5, edge - 1, edge - 7), (edge, edge + 3, 2)], key=repr)


def test_contracts(spark):
    contract = [checks.Rule("k", "int", primary_key=True), checks.Rule("v", "string", max_length=2, check="v <> 'zz'")]
    good = spark.createDataFrame([("a", 1), ("zz", 1), ("long", 2)], "v string, k int")
    df = checks.enforce_schema(good, contract)
    assert df.columns == ["k", "v"]
    assert {n: f(df).count() for n, f in checks.contract_tests(contract)} == {"primary_key_unique": 1, "k_not_null": 0, "v_check": 1, "v_length": 1}
    with pytest.raises(checks.ContractError, match="k is bigint"):
        checks.enforce_schema(good.withColumn("k", F.col("k").cast("long")), contract)
    with pytest.raises(checks.ContractError, match="missing k"):
        checks.enforce_schema(good.drop("k"), contract)
    assert ("t", "k", "primary_key") in checks.constraints(contract, "t")


def test_severity(spark):
    df = spark.createDataFrame([(None,), (None,), (1,)], "k int")
    judge = lambda **how: checks.judge(checks.DataTest("t", "m", lambda d: checks.not_null(d, "k"), **how), df).status
    assert judge() == "error" and judge(severity="warn") == "warn" and judge(error_if=5, warn_if=1) == "warn" and judge(error_if=5, warn_if=2) == "pass"


def test_samples_are_stable(spark):
    df = spark.range(10000)
    one, two = mon.sample_percent(df, "id", 5), mon.sample_percent(df.repartition(7), "id", 5)
    assert data(one) == data(two) and 300 < one.count() < 700 and mon.sample_percent(df, "id", 100).count() == 10000


def test_numbers_and_parts_over_all_rows(spark):
    from pyspark.sql import Window as W

    from tidemark.operators import relational as rel

    for n in (0, 1, 3, 7, 50):
        df = spark.range(n).withColumn("k", (F.col("id") * 37) % 101).repartition(5)
        want = df.select("id", F.row_number().over(W.orderBy("k")).cast("long").alias("row_number"), F.ntile(4).over(W.orderBy("k")).cast("long").alias("ntile"))
        got = rel.global_ntile(rel.numbered(df, ["k"]), 4, ["k"])
        assert data(got.select("id", "row_number", "ntile")) == data(want)
