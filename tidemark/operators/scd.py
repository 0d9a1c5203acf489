"""Slowly changing dimensions and snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.incremental import merge
from tidemark.operators.relational import latest, union_all

#: The end of a version that is still open.
FOREVER = "9999-12-31 00:00:00"


def _forever() -> Column:
    return F.lit(FOREVER).cast("timestamp_ntz")


def versions(changes: DataFrame, key: str, ts: str, order: Sequence[str] = (), deleted: Column | None = None) -> DataFrame:
    """Type 2 history from all changes: valid_from, valid_to, is_current and version_number; a delete closes and opens
    nothing."""
    w = W.partitionBy(key).orderBy(ts, *order)
    gone = F.lit(False) if deleted is None else deleted
    out = changes.withColumn("valid_from", F.col(ts)).withColumn("valid_to", F.coalesce(F.lead(ts).over(w), _forever())).withColumn("_gone", gone)
    kept = out.filter(~F.col("_gone")).drop("_gone")
    return kept.withColumn("is_current", F.col("valid_to") == _forever()).withColumn("version_number", F.row_number().over(W.partitionBy(key).orderBy("valid_from", *order)))


def apply_versions(target: DataFrame, changes: DataFrame, key: str, ts: str, order: Sequence[str] = (), deleted: Column | None = None) -> DataFrame:
    """versions() of changes put on a history: a key's open version ends at its first change, numbers go on."""
    marked = changes.withColumn("_gone", F.lit(False) if deleted is None else deleted)
    first = changes.groupBy(key).agg(F.min(ts).alias("_first"))
    new = versions(marked, key, ts, order, F.col("_gone")).drop("_gone")
    counts = target.groupBy(key).agg(F.max("version_number").alias("_n"))
    numbered = new.join(counts, key, "left").withColumn("version_number", (F.col("version_number") + F.coalesce("_n", F.lit(0))).cast("int")).drop("_n")
    closes = F.col("is_current") & F.col("_first").isNotNull()
    old = target.join(first, key, "left").withColumn("valid_to", F.when(closes, F.col("_first")).otherwise(F.col("valid_to"))).withColumn("is_current", F.col("is_current") & F.col("_first").isNull()).drop("_first")
    return union_all(old, numbered.select(*target.columns))


def type1(target: DataFrame | None, changes: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The latest values of each key, over the old ones."""
    newest = latest(changes, key, order)
    return newest if target is None else merge(target, newest, [key])


def type3(target: DataFrame, current: DataFrame, key: str, tracked: Sequence[str]) -> DataFrame:
    """current with previous_<c> for tracked columns: the target's value if it differs, else what the target kept as previous."""
    old = target.select(key, *[F.col(c).alias(f"_{c}") for c in tracked], *[F.col(f"previous_{c}").alias(f"_previous_{c}") for c in tracked], F.lit(True).alias("_there"))
    met = current.join(old, key, "left")
    made = {f"previous_{c}": F.when(F.col("_there").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_{c}")), F.col(f"_{c}")).otherwise(F.col(f"_previous_{c}")) for c in tracked}
    return met.withColumns(made).select(*current.columns, *made)


def snapshot(target: DataFrame | None, current: DataFrame, key: str, updated_at: str, invalidate_deleted: bool = True, as_of: str | None = None) -> DataFrame:
    """Timestamp-strategy history with valid_from and valid_to (null while open).

    A key with a newer updated_at closes its open row there and opens another; keys that vanished close at as_of if
    invalidate_deleted.
    """
    opened = current.withColumn("valid_from", F.col(updated_at)).withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))
    if target is None:
        return opened
    live, closed = target.filter(F.col("valid_to").isNull()), target.filter(F.col("valid_to").isNotNull())
    now = current.select(key, F.col(updated_at).alias("_now"), F.lit(True).alias("_there"))
    met = live.join(now, key, "left")
    gone = F.lit(as_of).cast("timestamp_ntz") if invalidate_deleted else F.lit(None).cast("timestamp_ntz")
    end = F.when(F.col("_there").isNull(), gone).when(F.col("_now") > F.col(updated_at), F.col("_now"))
    kept = met.withColumn("valid_to", end).drop("_now", "_there")
    old = live.select(key, F.col(updated_at).alias("_old"), F.lit(True).alias("_there"))
    fresh = opened.join(old, key, "left").filter(F.col("_there").isNull() | (F.col(updated_at) > F.col("_old"))).drop("_old", "_there")
    return union_all(closed, kept, fresh).select(*target.columns)


def mixed(target: DataFrame, changes: DataFrame, key: str, ts: str, versioned: Sequence[str], overwritten: Sequence[str]) -> DataFrame:
    """A new version where versioned columns differ from the open one, else the overwritten columns replace its own."""
    open_ = target.filter("is_current").select(key, *[F.col(c).alias(f"_{c}") for c in [*versioned, *overwritten]], F.lit(True).alias("_there"))
    met = changes.join(open_, key, "left")
    differs = F.col("_there").isNull()
    for c in versioned:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    sorted_ = met.withColumn("_new", differs).select(*changes.columns, "_new")
    history = apply_versions(target, sorted_.filter("_new").drop("_new"), key, ts)
    fixes = sorted_.filter(~F.col("_new")).select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in overwritten], F.lit(True).alias("_there"))
    joined = history.join(fixes, (F.col(key) == F.col("_k")) & F.col("is_current"), "left")
    return joined.select(*[F.when(F.col("_there").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in overwritten else F.col(c) for c in target.columns])


def quality(history: DataFrame, key: str) -> DataFrame:
    """For each key: versions, current ones, invalid ranges, unclosed and wrongly closed ones, and a status."""
    one = history.groupBy(key).agg(
        F.count("*").alias("versions"),
        F.count_if("is_current").alias("current_versions"),
        F.count_if(F.col("valid_from") >= F.col("valid_to")).alias("invalid_ranges"),
        F.count_if(~F.col("is_current") & (F.col("valid_to") == _forever())).alias("unclosed"),
        F.count_if(F.col("is_current") & (F.col("valid_to") != _forever())).alias("current_with_end"),
    )
    bad = (F.col("invalid_ranges") > 0) | (F.col("unclosed") > 0) | (F.col("current_with_end") > 0) | (F.col("current_versions") > 1)
    return one.withColumn("status", F.when(bad, "FAIL").otherwise("PASS"))


def overlaps(history: DataFrame, key: str) -> DataFrame:
    """Versions that begin before an earlier one of their key ended; a running maximum in place of a self-join."""
    w = W.partitionBy(key).orderBy("valid_from", "version_number").rowsBetween(W.unboundedPreceding, -1)
    return history.withColumn("_end", F.max("valid_to").over(w)).filter(F.col("_end") > F.col("valid_from")).drop("_end")


def as_of(history: DataFrame, ts: str) -> DataFrame:
    """The versions that were valid at a time."""
    at = F.lit(ts).cast("timestamp_ntz")
    return history.filter((F.col("valid_from") <= at) & (at < F.col("valid_to")))


def strategy_by_category(changes: DataFrame, categories: Mapping[str, Sequence[str]], fields: Sequence[str]) -> DataFrame:
    """change_category: the first category one of whose fields changed (<f>_changed), else none."""
    out = F.lit("none")
    for name, own in reversed(list(categories.items())):
        hit = F.lit(False)
        for f in own:
            if f in fields:
                hit = hit | F.col(f"{f}_changed")
        out = F.when(hit, name).otherwise(out)
    return changes.withColumn("change_category", out)
