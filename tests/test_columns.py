import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("a", "b", "default", "want"), [(10.0, 2.0, None, 5.0), (10.0, 0.0, None, None), (None, 2.0, None, None), (1.0, None, 0.0, 0.0), (1.0, 0.0, -1.0, -1.0)])
def test_safe_divide(spark, a, b, default, want):
    made = C.safe_divide(F.lit(a).cast("double"), F.lit(b).cast("double"), default)
    assert one(spark, made) == want


def test_names():
    assert C.snake_case("Order ID (USD)") == "order_id_usd" and C.snake_case("orderDate") == "order_date"
    assert C.pascal_case("order_line item") == "OrderLineItem"
    assert C.clean_column_name("1st col") == "_1st_col" and len(C.clean_column_name("x" * 90)) == 63


def test_booleans_and_ladders(spark):
    assert [one(spark, C.to_boolean(F.lit(v).cast("string"))) for v in ("Yes", "0", None, "maybe")] == [True, False, None, None]
    assert [one(spark, C.ladder(F.lit(v), [(10, "a"), (5, "b")], "c")) for v in (10, 7, 1)] == ["a", "b", "c"]
    assert [one(spark, C.ladder(F.lit(v), [(5, "a"), (10, "b")], "c", at_least=False)) for v in (5, 7, 11)] == ["a", "b", "c"]


def test_change_flags_and_nulls(spark):
    a, b = F.lit(None).cast("string"), F.lit("x")
    assert one(spark, C.changed(a, b)) is True and one(spark, C.changed(a, b, null_safe=False)) is None


def test_emails(spark):
    want = {"a@b.co": "valid", "ab.co": "invalid_format", "a@b@c.co": "multiple_at", "a@b": "invalid_format", None: "missing"}
    assert {v: one(spark, C.email_status(F.lit(v).cast("string"))) for v in want} == want
    assert one(spark, C.mask_email(F.lit("someone@x.org"))) == "s***@x.org"


def test_folds(spark):
    assert one(spark, C.compose(F.trim, F.upper)(F.lit(" a "))) == "A"
    steps = [lambda v: F.try_divide(v, F.lit(0)), lambda v: v + 1]
    assert one(spark, C.bind(F.lit(1.0), *steps)) is None
    df = spark.createDataFrame([(1, None, 3)], "a int, b int, c int")
    assert df.select(C.reduce_columns(["a", "b", "c"], "sum").alias("s"), C.reduce_columns(["b", "c"], "coalesce").alias("k")).first() == (4, 3)


def test_json_and_lists(spark):
    moved = C.json_set(F.lit('{"k": 1, "m": "x"}'), "k long, m string", "k", F.lit(5).cast("long"))
    assert one(spark, C.json_get(moved, "$.k", "long")) == 5 and one(spark, C.json_get(F.lit("no json"), "$.k")) is None
    assert one(spark, C.named_list(("a", F.lit(True)), ("b", F.lit(None).cast("boolean")), ("c", F.lit(True)))) == "a,c"


def test_periods(spark):
    d = F.lit("2024-05-31").cast("date")
    assert str(one(spark, C.quarter_end(d))) == "2024-06-30" and one(spark, C.quarter_label(d)) == "2024-Q2" and one(spark, C.iso_week_label(d)) == "2024-W22"
    assert one(spark, C.months_between_starts(F.lit("2024-03-01").cast("date"), F.lit("2024-01-31").cast("date"))) == 2
    assert one(spark, C.day_of_week(F.lit("2024-06-02").cast("date"))) == 0
