"""Named sources: Parquet tables, seeds with a declared schema, literal relations and spines."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a table that may be broadcast without looking at its size: literal tables and seeds stay below.
SMALL_ROWS = 100_000


@dataclass
class Source:
    """A table of a system; warn_after_hours and error_after_hours are for freshness checks."""

    system: str
    table: str
    path: str
    severity: str = "error"
    loaded_at: str | None = None
    warn_after_hours: float | None = None
    error_after_hours: float | None = None


@dataclass
class Catalog:
    """Sources by (system, table)."""

    spark: SparkSession
    sources: dict[tuple[str, str], Source] = field(default_factory=dict)

    def add(self, source: Source) -> Source:
        self.sources[source.system, source.table] = source
        return source

    def read(self, system: str, table: str, partition_filter: str | None = None, require_filter_on: str | None = None) -> DataFrame:
        """A source as a DataFrame. require_filter_on refuses reads whose filter doesn't name that partition column."""
        if require_filter_on and (not partition_filter or require_filter_on not in partition_filter):
            raise ValueError(f"{system}.{table} needs a filter on {require_filter_on}")
        df = self.spark.read.parquet(self.sources[system, table].path)
        return df.filter(partition_filter) if partition_filter else df

    def freshness(self, system: str, table: str, as_of: str) -> DataFrame:
        """One row: newest, age_hours and status (pass, warn, error) of a source with loaded_at."""
        s = self.sources[system, table]
        age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("newest").cast("timestamp"))) / 3.6e9
        status = F.lit("pass")
        if s.warn_after_hours is not None:
            status = F.when(F.col("age_hours") > s.warn_after_hours, "warn").otherwise(status)
        if s.error_after_hours is not None:
            status = F.when(F.col("age_hours") > s.error_after_hours, s.severity).otherwise(status)
        return self.read(system, table).agg(F.max(s.loaded_at).alias("newest")).withColumn("age_hours", age).withColumn("status", status)


def tables(spark: SparkSession, sf_dir: str) -> Catalog:
    """The test tables under the system "raw"."""
    catalog = Catalog(spark)
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        catalog.add(Source("raw", name, f"{sf_dir}/{name}.parquet"))
    return catalog


def seed(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """A small CSV of reference data under a declared schema; malformed rows fail."""
    return spark.read.csv(path, schema=schema, header=header, mode="FAILFAST")


def values(spark: SparkSession, rows: Sequence[Sequence], schema: str | T.StructType) -> DataFrame:
    """A literal relation, planned as local data."""
    if len(rows) > SMALL_ROWS:
        raise ValueError("a literal relation is for small constants")
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def date_spine(spark: SparkSession, start: str, end: str, part: str = "day", column: str = "date_day", include_end: bool = False) -> DataFrame:
    """A row for each day, week, month or hour from start, up to end."""
    kind = "timestamp_ntz" if part == "hour" else "date"
    step = F.expr(f"interval 1 {part}")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast(kind), F.lit(end).cast(kind), step)).alias(column))
    return days if include_end else days.filter(F.col(column) < F.lit(end).cast(kind))
