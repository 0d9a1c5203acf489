"""Relational building blocks: latest rows, frames, pivots, unions, top-k."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.storage import checkpointed


def _list(x: str | Sequence) -> list:
    return [x] if isinstance(x, str | Column) else list(x)


def latest(df: DataFrame, keys: str | Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key under order; the planner keeps one row a key before the shuffle."""
    w = W.partitionBy(*_list(keys)).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_per_group(df: DataFrame, keys: str | Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """Rows whose rank in their group is at most k, with the rank; ties share one."""
    w = W.partitionBy(*_list(keys)).orderBy(*order)
    return df.withColumn(rank, F.rank().over(w)).filter(F.col(rank) <= k)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def union_all(*dfs: DataFrame) -> DataFrame:
    """By name; a column that a frame lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def union_by_priority(keys: Sequence[str], order: Sequence[Column], *dfs: DataFrame) -> DataFrame:
    """All rows, but of each key only those of the first frame that has it (one, the first under order)."""
    tagged = union_all(*[d.withColumn("_priority", F.lit(i)) for i, d in enumerate(dfs)])
    return latest(tagged, keys, [F.col("_priority"), *order]).drop("_priority")


def moving(c: Column, keys: Sequence[str], order: Sequence[Column | str], back: int, ahead: int = 0) -> Column:
    """An aggregate over the rows from back before to ahead after (negative: before) in each key."""
    return c.over(W.partitionBy(*keys).orderBy(*order).rowsBetween(-back, ahead))


def running(c: Column, keys: Sequence[str], order: Sequence[Column | str]) -> Column:
    return c.over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))


def within_time(c: Column, keys: Sequence[str], ts: str, back_seconds: float, ahead_seconds: float = 0) -> Column:
    """An aggregate over the rows of a key whose time lies from back before to ahead after the row's own."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return c.over(W.partitionBy(*keys).orderBy(micros).rangeBetween(-int(back_seconds * 1_000_000), int(ahead_seconds * 1_000_000)))


def pivoted(df: DataFrame, group: Sequence[str], column: str, values: Sequence, aggregate: str, value: str | None = None, prefix: str = "") -> DataFrame:
    """A column for each of values; count counts the rows that have it, sum and avg give 0 and null where there are none."""
    hit = F.col(column)

    def one(v) -> Column:
        if aggregate == "count":
            return F.count(F.when(hit == v, 1))
        made = getattr(F, aggregate)(F.when(hit == v, F.col(value)))
        return F.coalesce(made, F.lit(0)) if aggregate == "sum" else made

    return df.groupBy(*group).agg(*[one(v).alias(f"{prefix}{v}") for v in values])


def distinct_values(df: DataFrame, column: str, most: int = 1000) -> list:
    """The values of a column for a data-driven pivot, in order; refused above most."""
    found = [r[0] for r in df.select(column).distinct().orderBy(column).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values")
    return found


def aggregated(df: DataFrame, group: Sequence[str], metrics: Mapping[str, tuple[str, str]]) -> DataFrame:
    """name: (function, expression) metrics by group."""
    made = {"count_distinct": F.countDistinct, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}
    return df.groupBy(*group).agg(*[made[f](F.expr(e)).alias(n) for n, (f, e) in metrics.items()])


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "row_number") -> DataFrame:
    """df with row numbers from 1 over the whole table, without bringing it into one task.

    Rows are dealt by ranges of order and sorted there; a range's rows start after those of the ranges before. Rows that
    tie may come in either order. The dealt rows are written to the shared folder, so that numbers hold when a task runs
    again.
    """
    dealt = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_start"))
    # a row for each partition
    met = dealt.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return met.withColumn(name, F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_id", "_part", "_start")


def global_ntile(df: DataFrame, n: int, order: Sequence[Column | str], name: str = "ntile") -> DataFrame:
    """df with the number of one of n nearly equal parts in order, the first parts larger by one, as ntile() over all rows."""
    total = df.agg(F.count("*").alias("_total"))
    met = numbered(df, order, "_rn").crossJoin(F.broadcast(total))
    small, larger = F.expr(f"_total div {n}"), F.expr(f"_total % {n}")
    inside = F.col("_rn") - 1
    in_larger = F.expr("floor((_rn - 1) / (_total div %d + 1))" % n) + 1
    after = larger + F.floor(F.try_divide(inside - larger * (small + 1), small)) + 1
    return met.withColumn(name, F.when(inside < larger * (small + 1), in_larger).otherwise(after).cast("long")).drop("_rn", "_total")


def weighted_average(value: str, weight: str) -> Column:
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))


def with_time_gap_sessions(df: DataFrame, key: str, ts: str, gap_minutes: float, order: Sequence[str] = ()) -> DataFrame:
    """df with session_no, from 1 for each key; a new session after more than the gap."""
    w = W.partitionBy(key).orderBy(ts, *order)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    new = F.when(gap.isNull() | (gap > F.lit(int(gap_minutes * 60_000_000))), 1).otherwise(0)
    marked = df.withColumn("_new", new)
    return marked.withColumn("session_no", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_new")
