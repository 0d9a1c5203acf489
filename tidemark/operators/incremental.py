"""Incremental strategies as functions from the target and a batch to the next target.

Keys match null-safely. A merge refuses nothing: a batch with several rows of a key must be reduced first, see
relational.latest().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.relational import union_all


def _on(keys: Sequence[str], a: str = "t", b: str = "s") -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def high_water(df: DataFrame, column: str, default, where: str | None = None):
    """The largest value, collected so that it prunes the next scan as a literal; default for an empty table."""
    found = (df.filter(where) if where else df).agg(F.max(column)).first()[0]
    return default if found is None else found


def since(df: DataFrame, column: str, mark, until=None, most: int | None = None) -> DataFrame:
    """Rows after a mark, up to a time, and at most so many steps of a sequence after the mark."""
    out = df.filter(F.col(column) > F.lit(mark))
    if until is not None:
        out = out.filter(F.col(column) <= F.lit(until))
    return out.filter(F.col(column) <= F.lit(mark) + F.lit(most)) if most is not None else out


def append(target: DataFrame, batch: DataFrame) -> DataFrame:
    return union_all(target, batch)


def append_new(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only rows whose key the target lacks."""
    return union_all(target, batch.alias("s").join(target.select(*keys).alias("t"), _on(keys), "left_anti"))


def delete_insert(target: DataFrame, batch: DataFrame, keys: Sequence[str], predicate: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Target rows with a key of the batch go, the batch comes.

    predicate limits what may go; columns in keep are taken over from the target's row of the same key.
    """
    hit = _on(keys) & (F.expr(predicate) if predicate else F.lit(True))
    rest = target.alias("t").join(batch.select(*keys).distinct().alias("s"), hit, "left_anti")
    if keep:
        old = target.select(*keys, *[F.col(c).alias(f"_{c}") for c in keep])
        batch = batch.alias("s").join(old.alias("t"), _on(keys), "left").select(*[F.coalesce(F.col(f"t._{c}"), F.col(f"s.{c}")).alias(c) if c in keep else F.col(f"s.{c}") for c in batch.columns])
    return union_all(rest, batch)


@dataclass
class Clause:
    """when: a condition on s.* and t.* (None: always); what: update, delete or insert; columns: what an update sets."""

    what: str
    when: str | None = None
    columns: Sequence[str] | None = None


def merge(target: DataFrame, source: DataFrame, keys: Sequence[str], matched: Sequence[Clause] = (Clause("update"),), not_matched: Sequence[Clause] = (Clause("insert"),), not_matched_by_source: Sequence[Clause] = ()) -> DataFrame:
    """The rows of a MERGE: the first clause that holds decides; a target row that none covers stays, a source row doesn't.

    Target rows meet the source in a left join, so a batch that is small enough is sent to them and they don't move; new
    rows are those of the source without a key in the target, of which only the keys are read.
    """
    there = source.withColumn("_s", F.lit(True)).alias("s")
    met = target.alias("t").join(there, _on(keys), "left")
    in_s = F.col("s._s").isNotNull()

    def first(clauses: Sequence[Clause]) -> Column:
        out = F.lit(-1)
        for i, c in reversed(list(enumerate(clauses))):
            out = F.when(F.expr(c.when), i).otherwise(out) if c.when else F.lit(i)
        return out

    def picks(clauses: Sequence[Clause], want: Callable[[Clause], bool]) -> Column:
        return F.col("_c").isin([i for i, c in enumerate(clauses) if want(c)])

    chosen = met.select("*", F.when(in_s, first(matched)).otherwise(first(not_matched_by_source)).alias("_c"))
    gone = (in_s & picks(matched, lambda c: c.what == "delete")) | (~in_s & picks(not_matched_by_source, lambda c: c.what == "delete"))

    def value(c: str) -> Column:
        if c not in source.columns:
            return F.col(f"t.{c}")
        sets = picks(matched, lambda x: x.what == "update" and (x.columns is None or c in x.columns))
        return F.when(in_s & sets, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c)

    old = chosen.filter(~gone).select(*[value(c) for c in target.columns])
    fresh = source.alias("s").join(target.select(*keys).alias("t"), _on(keys), "left_anti").withColumn("_c", first(not_matched)).filter(picks(not_matched, lambda c: c.what == "insert"))
    types = dict(target.dtypes)
    new = fresh.select(*[F.col(c) if c in source.columns else F.lit(None).cast(types[c]).alias(c) for c in target.columns])
    return old.unionByName(new)


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    return merge(target, source, keys)


def guarded_upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], ts: str, deleted: str = "false") -> DataFrame:
    """Deletes first, then updates if the source is newer or the target has no time, else insert; source rows without a
    time are left out, deleted ones are not inserted."""
    usable = source.filter(F.col(ts).isNotNull())
    newer = f"s.{ts} > t.{ts} or t.{ts} is null"
    return merge(target, usable, keys, [Clause("delete", f"({newer}) and (s.{deleted})" if deleted != "false" else "false"), Clause("update", newer)], [Clause("insert", f"not (s.{deleted})" if deleted != "false" else None)])


def not_in_source_deleted(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    return merge(target, source, keys, not_matched_by_source=[Clause("delete")])


def sweep(target: DataFrame, source: DataFrame, keys: Sequence[str], active: bool = True) -> DataFrame:
    """Target rows whose key the source still has; all if not active."""
    return target.alias("t").join(source.select(*keys).alias("s"), _on(keys), "left_semi") if active else target


def changed_only(target: DataFrame, batch: DataFrame, keys: Sequence[str], hash_column: str) -> DataFrame:
    """Batch rows that are new or whose hash differs from the target's."""
    old = target.select(*keys, F.col(hash_column).alias("_old"), F.lit(True).alias("_there"))
    met = batch.alias("s").join(old.alias("t"), _on(keys), "left")
    return met.filter(F.col("_there").isNull() | ~F.col(f"s.{hash_column}").eqNullSafe(F.col("_old"))).select("s.*")


def overwrite_partitions(target: DataFrame, batch: DataFrame, by: Sequence[str]) -> DataFrame:
    """The target without the partitions that the batch has, and the batch."""
    return union_all(target.alias("t").join(batch.select(*by).distinct().alias("s"), _on(by), "left_anti"), batch)


def affected_keys(df: DataFrame, keys: Sequence[str], column: str, mark) -> DataFrame:
    """All rows of the keys that have a row after the mark."""
    hit = df.filter(F.col(column) > F.lit(mark)).select(*keys).distinct()
    return df.alias("t").join(hit.alias("s"), _on(keys), "left_semi")


def batches(begin: datetime, end: datetime, size: timedelta, lookback: int = 0, mark: datetime | None = None) -> Iterator[tuple[datetime, datetime]]:
    """Event-time batches [start, stop) up to end; with a mark, from lookback batches before the one that holds it."""
    start = begin
    if mark is not None:
        steps = (mark - begin) // size - lookback
        start = begin + max(0, steps) * size
    while start < end:
        yield start, start + size
        start += size


def microbatch(target: DataFrame | None, source: DataFrame, ts: str, spans: Sequence[tuple[datetime, datetime]], transform: Callable[[DataFrame], DataFrame], batch_ts: str | None = None) -> DataFrame:
    """Each span of the source is transformed by itself and replaces the target's rows of that span."""
    out = target
    batch_ts = batch_ts or ts
    for start, stop in spans:
        made = transform(source.filter((F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(stop).cast("timestamp_ntz"))))
        outside = None if out is None else out.filter((F.col(batch_ts) < F.lit(start).cast("timestamp_ntz")) | (F.col(batch_ts) >= F.lit(stop).cast("timestamp_ntz")))
        out = made if outside is None else union_all(outside, made)
    return out


def soft_delete(target: DataFrame, source: DataFrame, keys: Sequence[str], as_of: str, deleted_at: str = "deleted_at") -> DataFrame:
    """Upsert that stamps target rows the source lacks instead of dropping them; a row that returns is active again."""
    stamped = source.withColumn(deleted_at, F.lit(None).cast("timestamp_ntz"))
    merged = merge(target, stamped, keys)
    alive = source.select(*keys).withColumn("_alive", F.lit(True))
    out = merged.alias("t").join(alive.alias("s"), _on(keys), "left")
    gone = F.col("_alive").isNull() & F.col(f"t.{deleted_at}").isNull()
    return out.select(*[F.when(gone, F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col(f"t.{c}")).alias(c) if c == deleted_at else F.col(f"t.{c}") for c in target.columns])


def evolve(target: DataFrame, batch: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """(target, batch) with matching columns. append: new columns are added; sync: also lost ones dropped; ignore: new ones
    are dropped; fail: any difference is an error."""
    new, lost = [c for c in batch.columns if c not in target.columns], [c for c in target.columns if c not in batch.columns]
    if mode == "fail" and (new or lost):
        raise ValueError(f"columns changed: new {new}, lost {lost}")
    types = dict(batch.dtypes)
    if mode in ("append", "sync"):
        target = target.withColumns({c: F.lit(None).cast(types[c]) for c in new})
    else:
        batch = batch.drop(*new)
    if mode == "sync":
        target = target.drop(*lost)
    else:
        old = dict(target.dtypes)
        batch = batch.withColumns({c: F.lit(None).cast(old[c]) for c in lost})
    return target, batch.select(*target.columns)
