"""Data tests, contracts and quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import checks as K
from tidemark.operators import relational as R
from tidemark.queries.base import query


@query("O01_unique", "SELECT l_orderkey, count(*) AS n_records FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return K.unique(t.lineitem, "l_orderkey")


@query("O02_not_null", "SELECT c_custkey FROM emails WHERE email IS NULL", "emails")
def _(t):
    return K.not_null(t.emails, "email").select("c_custkey")


@query("O03_accepted_values", "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def _(t):
    return K.accepted_values(t.orders, "o_orderstatus", ["F", "O"]).select("o_orderkey")


@query("O04_relationships", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM now)", "now")
def _(t):
    return K.relationships(t.orders, "o_custkey", t.now, "c_custkey").select("o_orderkey")


@query("O05_expression_is_true", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_extendedprice > 1500 AND l_quantity >= 2)")
def _(t):
    return K.expression_is_true(t.lineitem, "l_extendedprice > 1500 and l_quantity >= 2").select("l_orderkey", "l_linenumber")


@query("O06_unique_combination", "SELECT l_orderkey, l_linenumber, count(*) AS n_records FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return K.unique(t.lineitem, "l_orderkey", "l_linenumber")


@query("O07_match_regex", "SELECT c_custkey FROM customer WHERE NOT regexp_matches(c_name, '^Customer#0+[0-9]*[02468]$')")
def _(t):
    return K.match_regex(t.customer, "c_name", "^Customer#0+[0-9]*[02468]$").select("c_custkey")


@query("O08_not_null_proportion", "SELECT avg(CASE WHEN email IS NOT NULL THEN 1.0 ELSE 0.0 END) AS not_null_proportion FROM emails HAVING avg(CASE WHEN email IS NOT NULL THEN 1.0 ELSE 0.0 END) < 0.99", "emails")
def _(t):
    return K.not_null_proportion(t.emails, "email", 0.99)


@query("O09_email_format", f"SELECT c_custkey FROM emails WHERE email IS NOT NULL AND NOT regexp_matches(email, '{C.EMAIL}')", "emails")
def _(t):
    return K.email_format(t.emails, "email").select("c_custkey")


# the singular tests: each a business rule over the test tables


@query("O10a_price_consistency", "SELECT p_partkey FROM part WHERE p_retailprice * 0.9 > 820 AND p_size < 10")
def _(t):
    return t.part.filter("p_retailprice * 0.9D > 820 and p_size < 10").select("p_partkey")


@query("O10b_future_dates", "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '2001-07-01'")
def _(t):
    return t.orders.filter("o_orderdate > timestamp_ntz'2001-07-01'").select("o_orderkey")


@query("O10c_blocked_domains", f"SELECT c_custkey, email FROM emails WHERE lower(split_part(email, '@', 2)) IN {C.BLOCKED_DOMAINS}", "emails")
def _(t):
    return t.emails.filter(C.email_domain("email").isin(*C.BLOCKED_DOMAINS)).select("c_custkey", "email")


@query("O10d_inactive_orders", "SELECT o_orderkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0 OR c_custkey IS NULL")
def _(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").filter("c_acctbal < 0 or c_custkey is null").select("o_orderkey")


@query("O10e_stock_level", "WITH sold AS (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01' GROUP BY 1) SELECT p_partkey, q FROM part JOIN sold ON p_partkey = l_partkey WHERE q > 0.8 * p_size * 20")
def _(t):
    sold = t.lineitem.filter("l_shipdate >= timestamp_ntz'2000-01-01'").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    return t.part.join(sold, F.col("p_partkey") == F.col("l_partkey")).filter("q > 0.8D * p_size * 20").select("p_partkey", "q")


@query("O10f_profile_completeness", "SELECT count(*) AS n, count(*) FILTER (WHERE email IS NULL) AS incomplete FROM emails HAVING count(*) FILTER (WHERE email IS NULL) > 0.01 * count(*)", "emails")
def _(t):
    return t.emails.agg(F.count("*").alias("n"), F.count_if(F.col("email").isNull()).alias("incomplete")).filter("incomplete > 0.01 * n")


@query("O10g_total_matches_items", "WITH items AS (SELECT l_orderkey, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1) SELECT o_orderkey FROM orders JOIN items ON o_orderkey = l_orderkey WHERE abs(o_totalprice - total) > 0.01")
def _(t):
    items = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("total"))
    return t.orders.join(items, F.col("o_orderkey") == F.col("l_orderkey")).filter("abs(o_totalprice - total) > 0.01").select("o_orderkey")


@query("O10h_burst_orders", "SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 2")
def _(t):
    return t.orders.groupBy("o_custkey", F.trunc("o_orderdate", "month").alias("month")).agg(F.count("*").alias("n")).filter("n > 2")


@query("O11_migration_tests", "SELECT 'positive_amount' AS test, count(*) AS failures FROM customer WHERE c_acctbal <= 0 UNION ALL SELECT 'orphans', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM now) UNION ALL SELECT 'duplicates', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)", "now")
def _(t):
    parts = {"positive_amount": t.customer.filter("c_acctbal <= 0"), "orphans": K.relationships(t.orders, "o_custkey", t.now, "c_custkey"), "duplicates": K.unique(t.lineitem, "l_orderkey", "l_linenumber")}
    return R.union_all(*[d.agg(F.count("*").alias("failures")).select(F.lit(n).alias("test"), "failures") for n, d in parts.items()])


@query("O12_severity", "SELECT test, failures, CASE WHEN failures > error_if THEN 'error' WHEN failures > warn_if THEN 'warn' ELSE 'pass' END AS status FROM (SELECT 'null_email' AS test, count(*) AS failures, 0 AS warn_if, 1000000 AS error_if FROM emails WHERE email IS NULL UNION ALL SELECT 'known_status', count(*), 0, 0 FROM orders WHERE o_orderstatus NOT IN ('F', 'O', 'P'))", "emails")
def _(t):
    from tidemark.sources.registry import values

    tests = [(K.DataTest("null_email", "emails", lambda d: K.not_null(d, "email"), warn_if=0, error_if=1_000_000, store=True), t.emails), (K.DataTest("known_status", "orders", lambda d: K.accepted_values(d, "o_orderstatus", ["F", "O", "P"])), t.orders)]
    found = [K.judge(x, d, t.store) for x, d in tests]
    return values(t.spark, [(v.test, v.failures, v.status) for v in found], "test string, failures long, status string")


@query("O13_contract", "SELECT 'o_orderkey_not_null' AS check_name, 0 AS failures, 'PASS' AS status UNION ALL SELECT 'primary_key_unique', 0, 'PASS' UNION ALL SELECT 'o_totalprice_check', count(*), CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END FROM orders WHERE NOT o_totalprice > 5000 UNION ALL SELECT 'o_orderstatus_length', 0, 'PASS'")
def _(t):
    contract = [K.Rule("o_orderkey", "bigint", primary_key=True), K.Rule("o_totalprice", "double", check="o_totalprice > 5000"), K.Rule("o_orderstatus", "string", max_length=20)]
    df = K.enforce_schema(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), contract)
    return K.summary(*[(n, f(df)) for n, f in K.contract_tests(contract)])


@query("O14_completeness", "SELECT 'email' AS column_name, count(*) FILTER (WHERE email IS NULL) AS null_count, round(1 - count(*) FILTER (WHERE email IS NULL) / count(*), 6) AS completeness FROM emails UNION ALL SELECT 'c_name', count(*) FILTER (WHERE c_name IS NULL), round(1 - count(*) FILTER (WHERE c_name IS NULL) / count(*), 6) FROM emails", "emails")
def _(t):
    return K.completeness(t.emails, ["email", "c_name"])


@query("O15_check_union", "SELECT 'negative_balance' AS check_name, 'warn' AS severity, count(*) FILTER (WHERE c_acctbal < 0) AS failures FROM customer UNION ALL SELECT 'no_segment', 'error', count(*) FILTER (WHERE c_mktsegment IS NULL) FROM customer UNION ALL SELECT 'far_nation', 'warn', count(*) FILTER (WHERE c_nationkey > 20) FROM customer")
def _(t):
    return K.expression_in_one_pass(t.customer, {"negative_balance": (F.col("c_acctbal") < 0, "warn"), "no_segment": (F.col("c_mktsegment").isNull(), "error"), "far_nation": (F.col("c_nationkey") > 20, "warn")})


@query("O16_staging_cleanup", "SELECT c_custkey, coalesce(NULLIF(lower(trim(email)), ''), 'unknown') AS email, lower(c_mktsegment) AS segment FROM emails", "emails")
def _(t):
    return t.emails.select("c_custkey", C.tidy("email", "unknown").alias("email"), C.tidy("c_mktsegment").alias("segment"))


@query("O17_quality_summary", "SELECT 'orders' AS table_name, count(*) AS n, CASE WHEN count(*) = count(DISTINCT o_orderkey) THEN 'PASS' ELSE 'FAIL' END AS status FROM orders UNION ALL SELECT 'lineitem', count(*), CASE WHEN count(*) = count(DISTINCT l_orderkey) THEN 'PASS' ELSE 'FAIL' END FROM lineitem")
def _(t):
    one = lambda d, n, k: d.agg(F.count("*").alias("n"), F.countDistinct(k).alias("d")).select(F.lit(n).alias("table_name"), "n", F.when(F.col("n") == F.col("d"), "PASS").otherwise("FAIL").alias("status"))
    return R.union_all(one(t.orders, "orders", "o_orderkey"), one(t.lineitem, "lineitem", "l_orderkey"))
