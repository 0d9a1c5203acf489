"""Change data capture: logs, audits and snapshots to changes and current states."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.columns import epoch_diff, json_get, named_list
from tidemark.operators.relational import latest, union_all


def timestamp_changes(df: DataFrame, ts: str, mark: str, until: str | None = None, operation: str = "UPSERT") -> DataFrame:
    """Rows after the mark, up to until, tagged with an operation."""
    out = df.filter(F.col(ts) > F.lit(mark).cast("timestamp_ntz"))
    if until:
        out = out.filter(F.col(ts) <= F.lit(until).cast("timestamp_ntz"))
    return out.withColumn("cdc_operation", F.lit(operation))


def with_soft_deletes(df: DataFrame, ts: str, deleted: Column, active_mark: str, deleted_mark: str) -> DataFrame:
    """Changes of active and of deleted rows, each after a mark of its own."""
    return union_all(timestamp_changes(df.filter(~deleted), ts, active_mark), timestamp_changes(df.filter(deleted), ts, deleted_mark, operation="DELETE"))


def with_lateness(df: DataFrame, event_ts: str, seen_ts: str, late_minutes: float = 60) -> DataFrame:
    delay = epoch_diff(seen_ts, event_ts, "minute")
    return df.withColumn("delay_minutes", F.round(delay, 4)).withColumn("is_late_arrival", delay > late_minutes)


def parse_log(log: DataFrame, payload: str, fields: Mapping[str, str], op: str = "op") -> DataFrame:
    """A column for each field, from the after image of the payload, or the before image of deletes."""
    path = lambda f, kind: F.when(F.col(op) == "DELETE", json_get(payload, f"$.before.{f}", kind)).otherwise(json_get(payload, f"$.after.{f}", kind))
    return log.withColumns({f: path(f, kind) for f, kind in fields.items()})


def with_final_in_transaction(log: DataFrame, tx: str, key: str, order: str, op: str = "op") -> DataFrame:
    """The last operation on a key in its transaction, and whether a row is that."""
    w = W.partitionBy(tx, key).orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return log.withColumn("final_op", F.last(op).over(w)).withColumn("is_final_in_transaction", F.col(order) == F.max(order).over(W.partitionBy(tx, key)))


def current_state(log: DataFrame, key: str | Sequence[str], order: Sequence[Column], op: str = "op") -> DataFrame:
    """The latest change of each key that wasn't deleted."""
    return latest(log, key, order).filter(F.col(op) != "DELETE")


def operation_rank(op: str = "op") -> Column:
    """Deletes before updates before inserts."""
    return F.when(F.col(op) == "DELETE", 1).when(F.col(op) == "UPDATE", 2).otherwise(3)


def conflicts(log: DataFrame, key: str, ts: str, order: str, seconds: float = 1.0) -> DataFrame:
    """How many changes of the key lie within seconds, the winner of each second, and what that makes of the row."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    near = F.count("*").over(W.partitionBy(key).orderBy(micros).rangeBetween(-int(seconds * 1e6), int(seconds * 1e6)))
    rank = F.row_number().over(W.partitionBy(key, F.date_trunc("second", ts)).orderBy(F.col(order).desc()))
    before = F.lag(ts).over(W.partitionBy(key).orderBy(ts, order))
    out = log.withColumn("concurrent", near).withColumn("winner_rank", rank).withColumn("seconds_since", F.round(epoch_diff(F.col(ts), before), 3))
    status = F.when((F.col("concurrent") > 1) & (F.col("winner_rank") == 1), "conflict_winner").when(F.col("concurrent") > 1, "conflict_loser").when(F.col("seconds_since") < 60, "rapid_change").otherwise("normal")
    return out.withColumn("conflict_status", status)


def pivot_audit(audit: DataFrame, keys: Sequence[str], fields: Sequence[str], name: str = "column_name", old: str = "old_value", new: str = "new_value") -> DataFrame:
    """One row for each change from rows (column, old, new): old_<f> and new_<f>, and the changed columns in order."""
    made = [F.max(F.when(F.col(name) == f, F.col(v))).alias(f"{p}_{f}") for f in fields for p, v in (("old", old), ("new", new))]
    return audit.groupBy(*keys).agg(*made, F.array_join(F.array_sort(F.collect_set(name)), ",").alias("changed_columns"))


def snapshot_diff(previous: DataFrame, current: DataFrame, key: str, fields: Sequence[str], null_safe: bool = True) -> DataFrame:
    """(key, change_type, <f>, <f>_changed, changed_fields): INSERT, DELETE, UPDATE or NO_CHANGE for every key of either."""
    p, c = previous.select(key, *fields, F.lit(1).alias("_in")).alias("p"), current.select(key, *fields, F.lit(1).alias("_in")).alias("c")
    both = p.join(c, F.col(f"p.{key}") == F.col(f"c.{key}"), "full_outer")
    old, new = F.col("p._in").isNotNull(), F.col("c._in").isNotNull()
    differs = {f: (~F.col(f"p.{f}").eqNullSafe(F.col(f"c.{f}")) if null_safe else F.coalesce(F.col(f"p.{f}") != F.col(f"c.{f}"), F.lit(False))) & old & new for f in fields}
    some = F.lit(False)
    for d in differs.values():
        some = some | d
    kind = F.when(~old, "INSERT").when(~new, "DELETE").when(some, "UPDATE").otherwise("NO_CHANGE")
    return both.select(F.coalesce(f"c.{key}", f"p.{key}").alias(key), kind.alias("change_type"), *[F.coalesce(f"c.{f}", f"p.{f}").alias(f) for f in fields], *[d.alias(f"{f}_changed") for f, d in differs.items()], named_list(*differs.items()).alias("changed_fields"))


def initial_load(current: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """What the first run gives in place of a diff."""
    return current.select(key, F.lit("INITIAL_LOAD").alias("change_type"), *fields, *[F.lit(False).alias(f"{f}_changed") for f in fields], F.lit("").alias("changed_fields"))


def snapshot_diff_anti(previous: DataFrame, current: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """As snapshot_diff() without NO_CHANGE rows, by a left join for new and changed rows and an anti join for deleted ones."""
    old = previous.select(key, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_there"))
    met = current.select(key, *fields).join(old, key, "left")
    differs = [(f, ~F.col(f).eqNullSafe(F.col(f"_{f}")) & F.col("_there").isNotNull()) for f in fields]
    kept = met.withColumn("changed_fields", named_list(*differs)).withColumn("change_type", F.when(F.col("_there").isNull(), "INSERT").when(F.col("changed_fields") != "", "UPDATE"))
    gone = previous.join(current, key, "left_anti").select(key, *fields).withColumn("change_type", F.lit("DELETE")).withColumn("changed_fields", F.lit(""))
    return union_all(kept.filter(F.col("change_type").isNotNull()).select(key, *fields, "change_type", "changed_fields"), gone)


def sequence_gaps(log: DataFrame, order: str) -> DataFrame:
    """(gap_start, gap_end, missing) where a sequence of whole numbers jumps.

    Each number is compared with the next one present in its range of 2**20, ranges by their ends: no task sees all.
    """
    span = F.expr(f"{order} div 1048576")
    within = log.select(F.col(order).alias("x"), span.alias("span")).withColumn("before", F.lag("x").over(W.partitionBy("span").orderBy("x")))
    ends = log.select(F.col(order).alias("x"), span.alias("span")).groupBy("span").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    across = ends.select(F.lag("high").over(W.orderBy("span")).alias("before"), F.col("low").alias("x"))
    jumps = union_all(within.select("before", "x"), across).filter(F.col("x") - F.col("before") > 1)
    return jumps.select(F.col("before").alias("gap_start"), F.col("x").alias("gap_end"), (F.col("x") - F.col("before") - 1).alias("missing"))
