"""Projections, predicates, scalar functions and column builders."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.queries.base import query


@query("E01_projection", "SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS amount FROM orders")
def _(t):
    return t.orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").alias("amount"))


@query("E02_star_computed", "SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def _(t):
    return t.lineitem.select("*", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


@query("E03_case", """SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'small' END AS size_class,
  CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'pending' END AS status_name, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_totalprice > 200000 THEN 'big_final' ELSE 'final' END END AS nested FROM orders""")
def _(t):
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    return t.orders.select(
        "o_orderkey",
        C.ladder(price - 0.0000001, [(200000, "large"), (100000, "medium")], "small").alias("size_class"),
        F.when(status == "F", "final").when(status == "O", "open").otherwise("pending").alias("status_name"),
        F.when(status == "F", F.when(price > 200000, "big_final").otherwise("final")).alias("nested"),
    )


@query("E04_comparison_between_in", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 50000 AND 150000 AND o_orderstatus IN ('F', 'O') AND o_orderpriority NOT IN ('1-URGENT', '5-LOW')")
def _(t):
    return t.orders.filter(F.col("o_totalprice").between(50000, 150000) & F.col("o_orderstatus").isin("F", "O") & ~F.col("o_orderpriority").isin("1-URGENT", "5-LOW")).select("o_orderkey")


@query("E05_like", "SELECT p_partkey, p_name ILIKE '%WIDGET%' AS is_widget, p_type LIKE '%ECONOMY%' AS economy, p_brand NOT LIKE 'Brand#1%' AS other_brand FROM part")
def _(t):
    return t.part.select("p_partkey", F.col("p_name").ilike("%WIDGET%").alias("is_widget"), F.col("p_type").like("%ECONOMY%").alias("economy"), (~F.col("p_brand").like("Brand#1%")).alias("other_brand"))


@query("E06_regex", "SELECT c_custkey, regexp_matches(c_name, '#0+[1-4]') AS hit, NOT regexp_matches(c_name, '[13579]$') AS even FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.regexp_like("c_name", F.lit("#0+[1-4]")).alias("hit"), (~F.col("c_name").rlike("[13579]$")).alias("even"))


@query("E07_null_boolean", """SELECT o_orderkey, NULLIF(o_orderkey % 17, 0) IS NULL AS missing, NOT (o_totalprice > 100000) AS cheap,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1 AS is_first FROM orders""")
def _(t):
    from pyspark.sql import Window as W

    first = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) == 1
    return t.orders.select("o_orderkey", F.nullif(F.col("o_orderkey") % 17, F.lit(0)).isNull().alias("missing"), (~(F.col("o_totalprice") > 100000)).alias("cheap"), first.alias("is_first"))


@query("E08_lateral_alias", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM lineitem")
def _(t):
    return t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_extendedprice * (1 - l_discount) AS net", "net * (1 + l_tax) AS gross")


@query("E09_date_filter", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
def _(t):
    return t.orders.filter(C.between_dates("o_orderdate", "1997-01-01", "1998-01-01")).select("o_orderkey")


@query("E10_where_builder", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 150000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') UNION ALL SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 OR o_orderstatus = 'P'")
def _(t):
    a = t.orders.filter(C.conditions([("o_orderstatus", "=", "F"), ("o_totalprice", ">", 150000), ("o_orderpriority", "in", ["1-URGENT", "2-HIGH"])]))
    b = t.orders.filter(C.conditions([("o_totalprice", ">", 300000), ("o_orderstatus", "=", "P")], "or"))
    return a.select("o_orderkey").unionByName(b.select("o_orderkey"))


@query("E11_conditional_select", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _(t):
    flags = {"c_custkey": True, "c_name": True, "c_acctbal": False, "c_mktsegment": True}
    return t.customer.select(*[c for c, on in flags.items() if on])


@query("E12_change_flags", """SELECT n.c_custkey, b.c_mktsegment != n.c_mktsegment AS changed_unsafe, b.c_mktsegment IS DISTINCT FROM n.c_mktsegment AS changed_safe FROM before b JOIN now n ON b.c_custkey = n.c_custkey""", "before now")
def _(t):
    b = t.before.select("c_custkey", F.col("c_mktsegment").alias("old"))
    return b.join(t.now, "c_custkey").select("c_custkey", C.changed("old", "c_mktsegment", null_safe=False).alias("changed_unsafe"), C.changed("old", "c_mktsegment").alias("changed_safe"))


@query("L01_null_handling", "SELECT o_orderkey, coalesce(NULLIF(o_orderkey % 5, 0), -1) AS filled, NULLIF(o_orderstatus, 'F') AS not_final FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.coalesce(F.nullif(F.col("o_orderkey") % 5, F.lit(0)), F.lit(-1)).alias("filled"), F.nullif("o_orderstatus", F.lit("F")).alias("not_final"))


@query("L02_extremes", "SELECT l_orderkey, l_linenumber, greatest(l_discount, l_tax) AS high, least(l_discount, l_tax) AS low, greatest(NULLIF(l_quantity, 1), 5.0) AS skips_null FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.greatest("l_discount", "l_tax").alias("high"), F.least("l_discount", "l_tax").alias("low"), F.greatest(F.nullif("l_quantity", F.lit(1.0)), F.lit(5.0)).alias("skips_null"))


@query("L03_arithmetic", "SELECT c_custkey, abs(c_acctbal) AS magnitude, CAST(floor(c_acctbal) AS BIGINT) AS whole, c_custkey % 7 AS modulo, round(c_acctbal, 1) AS rounded, round(ln(abs(c_acctbal) + 1), 9) AS logged, round(log(2, abs(c_acctbal) + 1), 9) AS log2 FROM customer")
def _(t):
    b = F.col("c_acctbal")
    return t.customer.select("c_custkey", F.abs(b).alias("magnitude"), F.floor(b).alias("whole"), (F.col("c_custkey") % 7).alias("modulo"), F.round(b, 1).alias("rounded"), F.round(F.ln(F.abs(b) + 1), 9).alias("logged"), F.round(F.log(2.0, F.abs(b) + 1), 9).alias("log2"))


@query("L04_safe_divide", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice / (o_orderkey % 3) END AS ratio, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE o_totalprice / (o_orderkey % 3) END AS ratio_or_zero FROM orders")
def _(t):
    return t.orders.select("o_orderkey", C.safe_divide("o_totalprice", F.col("o_orderkey") % 3).alias("ratio"), C.safe_divide("o_totalprice", F.col("o_orderkey") % 3, 0.0).alias("ratio_or_zero"))


@query("L05_cents_to_dollars", "SELECT o_orderkey, CAST(CAST(o_orderkey / 100.0 AS DECIMAL(16,2)) AS DOUBLE) AS dollars FROM orders")
def _(t):
    return t.orders.select("o_orderkey", C.cents_to_dollars("o_orderkey").alias("dollars"))


@query("L06_numeric_transforms", """SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 9) AS normalized, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev(c_acctbal) OVER (), 6) AS standardized,
  CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 9) END AS logged, c_acctbal * 2.5 AS scaled, least(greatest(c_acctbal, 0.0), 5000.0) AS capped FROM customer""")
def _(t):
    s = t.customer.agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"), F.avg("c_acctbal").alias("mean"), F.stddev("c_acctbal").alias("std"))
    b = F.col("c_acctbal")
    return t.customer.crossJoin(F.broadcast(s)).select("c_custkey", F.round(C.normalize(b, F.col("lo"), F.col("hi")), 9).alias("normalized"), F.round(C.standardize(b, F.col("mean"), F.col("std")), 6).alias("standardized"), F.round(C.log_transform(b), 9).alias("logged"), C.scale(b, 2.5).alias("scaled"), C.cap(b, 0.0, 5000.0).alias("capped"))


@query("L07_formatting", "SELECT o_orderkey, '$' || CAST(CAST(round(o_totalprice, 2) AS DECIMAL(18,2)) AS VARCHAR) AS currency, strftime(o_orderdate, '%Y/%m/%d') AS day_text FROM orders")
def _(t):
    return t.orders.select("o_orderkey", C.format_currency("o_totalprice").alias("currency"), F.date_format("o_orderdate", "yyyy/MM/dd").alias("day_text"))


@query("L08_strings", """SELECT c_custkey, lower(c_name) AS low, upper(c_mktsegment) AS up, trim('  ' || c_name || ' ') AS trimmed, c_name || '-' || c_mktsegment AS joined, concat_ws('|', c_name, NULL, c_mktsegment) AS ws, replace(c_name, '#', '-') AS replaced,
  substr(c_name, 1, position('#' IN c_name) - 1) AS prefix, length(c_name) AS len, NULLIF(lower(trim(c_name)), '') AS tidy FROM customer""")
def _(t):
    n = F.col("c_name")
    return t.customer.select(
        "c_custkey", F.lower(n).alias("low"), F.upper("c_mktsegment").alias("up"), F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("trimmed"), F.concat(n, F.lit("-"), F.col("c_mktsegment")).alias("joined"), F.concat_ws("|", n, F.lit(None).cast("string"), "c_mktsegment").alias("ws"),
        F.replace(n, F.lit("#"), F.lit("-")).alias("replaced"), F.substring(n, F.lit(1), F.locate("#", n) - 1).alias("prefix"), F.length(n).alias("len"), C.tidy(n).alias("tidy"),
    )


@query("L09_regex", "SELECT c_custkey, regexp_extract(c_name, '#0*(\\d+)', 1) AS number, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.regexp_extract("c_name", r"#0*(\d+)", 1).alias("number"), C.digits_only("c_name").alias("digits"))


@query("L10_identifiers", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(t):
    shown = t.customer.select(F.col("c_custkey").alias("C Custkey"), F.col("c_name").alias("cName"), F.col("c_acctbal").alias("C-Acctbal!"))
    return shown.toDF(*[C.clean_column_name(c) for c in shown.columns])


@query("L11_keys", """SELECT o_orderkey, md5(coalesce(CAST(o_orderkey AS VARCHAR), '') || '|' || coalesce(o_orderstatus, '')) AS surrogate_key, md5(CAST(o_custkey AS VARCHAR) || '||' || o_orderpriority || '||' || '') AS content_hash FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", C.surrogate_key("o_orderkey", "o_orderstatus").alias("surrogate_key"), C.content_hash("o_custkey", "o_orderpriority", F.lit(None).cast("string")).alias("content_hash"))


@query("L12_fingerprint", "SELECT o_orderkey, CAST('0x' || substr(md5(o_orderkey || '|' || o_custkey), 1, 15) AS BIGINT) AS fingerprint, CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15) AS BIGINT) % 10 AS bucket FROM orders")
def _(t):
    return t.orders.select("o_orderkey", C.fingerprint("o_orderkey", "o_custkey").alias("fingerprint"), C.bucket("o_orderkey", 10).alias("bucket"))


@query("L13_date_parts", """SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, quarter(ts) AS q, weekofyear(ts) AS w, dayofweek(ts) AS dow, dayofyear(ts) AS doy, hour(ts) AS h, dayofweek(ts) IN (0, 6) AS weekend FROM events""")
def _(t):
    ts = F.col("ts")
    return t.events.select("event_id", F.year(ts).alias("y"), F.month(ts).alias("m"), F.day(ts).alias("d"), F.quarter(ts).alias("q"), F.weekofyear(ts).alias("w"), C.day_of_week(ts).alias("dow"), F.dayofyear(ts).alias("doy"), F.hour(ts).alias("h"), C.is_weekend(ts).alias("weekend"))


@query("L14_truncation", "SELECT event_id, date_trunc('hour', ts) AS hr, CAST(date_trunc('day', ts) AS DATE) AS dy, CAST(date_trunc('week', ts) AS DATE) AS wk, CAST(date_trunc('month', ts) AS DATE) AS mo, CAST(date_trunc('quarter', ts) AS DATE) AS qu, time_bucket(INTERVAL '15 minutes', ts) AS quarter_hour FROM events")
def _(t):
    ts = F.col("ts")
    return t.events.select("event_id", F.date_trunc("hour", ts).alias("hr"), F.to_date(ts).alias("dy"), F.trunc(ts, "week").alias("wk"), C.month_start(ts).alias("mo"), C.quarter_start(ts).alias("qu"), F.window(ts, "15 minutes")["start"].alias("quarter_hour"))


@query("L15_date_arithmetic", "SELECT o_orderkey, o_orderdate + INTERVAL 1 DAY AS next_day, o_orderdate - INTERVAL 2 HOUR AS earlier, CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH AS DATE) AS plus3, CAST(o_orderdate AS DATE) - 7 AS week_before FROM orders")
def _(t):
    d = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", (F.col("o_orderdate") + F.expr("interval 1 day")).alias("next_day"), (F.col("o_orderdate") - F.expr("interval 2 hour")).alias("earlier"), F.add_months(d, 3).alias("plus3"), F.date_sub(d, 7).alias("week_before"))


@query("L16_date_difference", "SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') AS days, date_diff('month', o_orderdate, TIMESTAMP '2001-08-01') AS months, round(epoch(TIMESTAMP '2001-08-01' - o_orderdate) / 3600, 4) AS hours FROM orders")
def _(t):
    now = F.lit("2001-08-01").cast("timestamp_ntz")
    return t.orders.select("o_orderkey", F.datediff(F.lit("2001-08-01").cast("date"), F.to_date("o_orderdate")).alias("days"), C.months_between_starts(now, "o_orderdate").alias("months"), F.round(C.epoch_diff(now, "o_orderdate", "hour"), 4).alias("hours"))


@query("L17_period_ends", "SELECT o_orderkey, last_day(CAST(o_orderdate AS DATE)) AS month_end, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarter_end FROM orders")
def _(t):
    return t.orders.select("o_orderkey", C.month_end(F.to_date("o_orderdate")).alias("month_end"), C.quarter_end("o_orderdate").alias("quarter_end"))


@query("L18_date_labels", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, CAST(year(o_orderdate) AS VARCHAR) || '-Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS quarter_label, strftime(o_orderdate, '%G-W%V') AS week_label, dayname(o_orderdate) AS day_name, monthname(o_orderdate) AS month_name FROM orders")
def _(t):
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.date_format(d, "yyyy-MM-dd").alias("iso"), C.quarter_label(d).alias("quarter_label"), C.iso_week_label(d).alias("week_label"), F.date_format(d, "EEEE").alias("day_name"), F.date_format(d, "MMMM").alias("month_name"))


@query("L19_time_zone", "SELECT event_id, ts + INTERVAL 5 HOUR AS utc_ts, ts - INTERVAL 9 HOUR AS from_tokyo FROM events")
def _(t):
    # the events lie in January, when New York is 5 hours behind UTC
    return t.events.select("event_id", C.to_utc("ts", "America/New_York").alias("utc_ts"), C.to_utc("ts", "Asia/Tokyo").alias("from_tokyo"))


@query("L20_present", "SELECT o_orderkey, TIMESTAMP '2001-08-01' AS as_of, o_orderdate < TIMESTAMP '2001-08-01' AS past FROM orders")
def _(t):
    now = F.lit("2001-08-01").cast("timestamp_ntz")
    return t.orders.select("o_orderkey", now.alias("as_of"), (F.col("o_orderdate") < now).alias("past"))


@query("L21_casts", "SELECT o_orderkey, CAST(o_totalprice AS BIGINT) AS whole, CAST(o_orderkey AS VARCHAR) AS text, CAST(o_orderdate AS DATE) AS day, TRY_CAST(o_orderpriority AS INTEGER) AS dirty FROM orders WHERE o_totalprice % 1 <> 0.5")
def _(t):
    return t.orders.filter("o_totalprice % 1 <> 0.5").select("o_orderkey", F.round("o_totalprice").cast("long").alias("whole"), F.col("o_orderkey").cast("string").alias("text"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").try_cast("int").alias("dirty"))


@query("L22_json", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS k_set, '{"id":' || event_id || ',"type":"' || event_type || '"}' AS built, 3 AS list_size FROM events""")
def _(t):
    moved = C.json_set("props", "k long", "k", C.json_get("props", "$.k", "long") + 1)
    built = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type")))
    return t.events.select("event_id", C.json_get("props", "$.k", "long").alias("k"), C.json_get("props", "$.missing").alias("missing"), C.json_get(moved, "$.k", "long").alias("k_set"), built.alias("built"), F.json_array_length(F.lit("[1,2,3]")).alias("list_size"))


@query("L23_arrays", """SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal > 0 THEN 'positive' END, CASE WHEN c_nationkey < 10 THEN 'low_nation' END) AS tags, CAST(c_acctbal > 0 AS BIGINT) + CAST(c_nationkey < 10 AS BIGINT) AS n_tags, string_split(c_name, '#')[2] AS tail FROM customer""")
def _(t):
    tags = F.array_compact(F.array(F.when(F.col("c_acctbal") > 0, "positive"), F.when(F.col("c_nationkey") < 10, "low_nation")))
    return t.customer.select("c_custkey", C.named_list(("positive", F.col("c_acctbal") > 0), ("low_nation", F.col("c_nationkey") < 10)).alias("tags"), F.size(tags).alias("n_tags"), F.split("c_name", "#")[1].alias("tail"))


@query("L24_boolean_parse", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS parsed FROM orders")
def _(t):
    k = F.col("o_orderkey") % 4
    return t.orders.select("o_orderkey", C.to_boolean(F.when(k == 0, " Yes").when(k == 1, "0").when(k == 2, "TRUE").otherwise("maybe")).alias("parsed"))


@query("L25_validators", """SELECT c_custkey, CASE WHEN email IS NULL THEN 'missing' WHEN email NOT LIKE '%@%' THEN 'invalid_format' WHEN email LIKE '%@%@%' THEN 'multiple_at' WHEN NOT regexp_matches(email, '""" + C.EMAIL + """') THEN 'invalid_format' ELSE 'valid' END AS email_status,
  CASE WHEN email IS NULL THEN 'has_email' WHEN NOT c_acctbal > 0 THEN 'positive_balance' ELSE 'valid' END AS record_status FROM emails""", "emails")
def _(t):
    return t.emails.select("c_custkey", C.email_status("email").alias("email_status"), C.validated([("has_email", F.col("email").isNotNull()), ("positive_balance", C.is_positive("c_acctbal"))]).alias("record_status"))


@query("L26_score_ladder", "SELECT c_custkey, CASE WHEN c_acctbal >= 7500 THEN 4 WHEN c_acctbal >= 5000 THEN 3 WHEN c_acctbal >= 2500 THEN 2 ELSE 1 END AS score FROM customer")
def _(t):
    return t.customer.select("c_custkey", C.ladder("c_acctbal", [(7500, 4), (5000, 3), (2500, 2)], 1).alias("score"))


@query("L27_masking", "SELECT c_custkey, regexp_replace(email, '^(.).*@(.*)$', '\\1***@\\2') AS masked, sha256('s' || c_name) AS hashed, 'user_' || substr(md5(c_name), 1, 8) AS anonymous FROM emails", "emails")
def _(t):
    return t.emails.select("c_custkey", C.mask_email("email").alias("masked"), C.hash_pii("c_name", "s").alias("hashed"), C.anonymize_name("c_name").alias("anonymous"))


@query("L28_audit_columns", "SELECT r_regionkey, r_name, TIMESTAMP '2001-08-01' AS loaded_at, 'prod' AS loaded_by, CAST(NULL AS VARCHAR) AS model_name FROM region")
def _(t):
    from tidemark.plans.project import Context, audit_columns

    return audit_columns(t.region, Context(t.spark, t.catalog, t.store, "2001-08-01"))


@query("N01_scalar_macro", "SELECT o_orderkey, CAST(CAST(o_totalprice * 100 / 100 AS DECIMAL(16,2)) AS DOUBLE) AS dollars FROM orders")
def _(t):
    return t.orders.select("o_orderkey", C.cents_to_dollars(F.col("o_totalprice") * 100).alias("dollars"))


@query("N02_apply_columns", "SELECT c_custkey, c_name, c_mktsegment, lower(c_name) AS c_name_low, lower(c_mktsegment) AS c_mktsegment_low FROM customer")
def _(t):
    return C.apply_to(t.customer.select("c_custkey", "c_name", "c_mktsegment"), ["c_name", "c_mktsegment"], F.lower, "_low")


@query("N03_filter_columns", "SELECT p_name, p_brand, p_type FROM part")
def _(t):
    return t.part.select(*C.names_where(t.part, lambda _, kind: kind == "string"))


@query("N04_reduce_columns", "SELECT l_orderkey, l_linenumber, round(l_quantity + l_discount + l_tax, 6) AS total, round((l_quantity + l_discount + l_tax) / 3, 6) AS mean, greatest(l_quantity, l_discount, l_tax) AS high, least(l_quantity, l_discount, l_tax) AS low, l_returnflag || l_linestatus AS glued, coalesce(l_returnflag, l_linestatus) AS first_set FROM lineitem")
def _(t):
    n = ["l_quantity", "l_discount", "l_tax"]
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(C.reduce_columns(n, "sum"), 6).alias("total"), F.round(C.reduce_columns(n, "avg"), 6).alias("mean"), C.reduce_columns(n, "max").alias("high"), C.reduce_columns(n, "min").alias("low"), C.reduce_columns(["l_returnflag", "l_linestatus"], "concat").alias("glued"), C.reduce_columns(["l_returnflag", "l_linestatus"], "coalesce").alias("first_set"))


@query("N05_compose", "SELECT c_custkey, upper(trim(replace(c_name, '#', ' '))) AS shown FROM customer")
def _(t):
    shown = C.compose(lambda c: F.replace(c, F.lit("#"), F.lit(" ")), F.trim, F.upper)
    return t.customer.select("c_custkey", shown(F.col("c_name")).alias("shown"))


@query("N06_partial", "SELECT c_custkey, least(greatest(c_acctbal, 0.0), 100.0) AS capped, c_acctbal * 3 AS tripled FROM customer")
def _(t):
    to_hundred, times = partial(C.cap, low=0.0, high=100.0), lambda n: lambda c: C.scale(c, n)
    return t.customer.select("c_custkey", to_hundred("c_acctbal").alias("capped"), times(3.0)("c_acctbal").alias("tripled"))


@query("N07_bind", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice / (o_orderkey % 4) / (o_orderkey % 3) END AS chained FROM orders")
def _(t):
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", C.bind(F.col("o_totalprice"), lambda v: C.safe_divide(v, k % 4), lambda v: C.safe_divide(v, k % 3)).alias("chained"))


@query("N09_conditional_pipeline", "SELECT o_orderkey, o_totalprice * 2 AS amount FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    steps = [(True, lambda d: d.filter("o_orderstatus = 'F'")), (False, lambda d: d.limit(1)), (True, lambda d: d.select("o_orderkey", (F.col("o_totalprice") * 2).alias("amount")))]
    out = t.orders
    for on, step in steps:
        out = out.transform(step) if on else out
    return out


@query("N11_table_macro", "SELECT CAST(d AS DATE) AS date_day, count(o_orderkey) AS n FROM generate_series(DATE '1997-01-01', DATE '1997-01-31', INTERVAL 1 DAY) s(d) LEFT JOIN orders ON CAST(o_orderdate AS DATE) = CAST(d AS DATE) GROUP BY 1")
def _(t):
    from tidemark.sources.registry import date_spine

    days = date_spine(t.spark, "1997-01-01", "1997-01-31", include_end=True)
    return days.join(t.orders, F.to_date("o_orderdate") == F.col("date_day"), "left").groupBy("date_day").agg(F.count("o_orderkey").alias("n"))


@query("N12_aggregate_macro", "SELECT l_returnflag, round(sum(l_discount * l_extendedprice) / sum(l_extendedprice), 9) AS weighted, quantile_cont(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY 1")
def _(t):
    from tidemark.operators.relational import weighted_average

    return t.lineitem.groupBy("l_returnflag").agg(F.round(weighted_average("l_discount", "l_extendedprice"), 9).alias("weighted"), F.expr("percentile_cont(0.9) WITHIN GROUP (ORDER BY l_quantity)").alias("p90"))


@query("N13_feature_flags", "SELECT o_orderkey, o_totalprice * 0.1 AS bonus FROM orders")
def _(t):
    features = {"bonus": (True, F.col("o_totalprice") * 0.1), "penalty": (False, F.col("o_totalprice") * -1)}
    return t.orders.select("o_orderkey", *[c.alias(n) for n, (on, c) in features.items() if on])


@query("N14_macro_test", "SELECT * FROM (VALUES ('by_two', CAST(5.0 AS DOUBLE)), ('by_zero', NULL), ('quantity', CAST(0.0 AS DOUBLE))) v(test_case, result)")
def _(t):
    one = t.spark.range(1).select(F.lit(100.0).alias("revenue"), F.lit(0.0).alias("quantity"))
    cases = [("by_two", C.safe_divide(F.lit(10.0), F.lit(2.0))), ("by_zero", C.safe_divide(F.lit(10.0), F.lit(0.0))), ("quantity", C.safe_divide("revenue", "quantity", 0.0))]
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("test_case"), c.alias("result")) for n, c in cases])))


@query("N16_metadata_helpers", "SELECT count(*) AS n, max(o_orderdate) AS newest FROM orders")
def _(t):
    return t.orders.agg(F.count("*").alias("n"), F.max("o_orderdate").alias("newest"))
