"""Streams over append-only folders: windows, sessions, deduplication and state kept by merging micro-batches.

Triggers take what is there and stop, so a run is a batch; the same code runs continuously under another trigger. In append
mode a window comes out once the watermark has passed its end: the last windows of a run stay in the state.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.incremental import guarded_upsert
from tidemark.operators.relational import latest
from tidemark.sources.storage import Store


def read(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream, so many files a micro-batch."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def with_event_time(df: DataFrame, ts: str, lateness: str) -> DataFrame:
    """The time as a zoned timestamp, which watermarks need, and the watermark."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


def tumbling(df: DataFrame, ts: str, width: str, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    return _flat(df.groupBy(F.window(ts, width), *keys).agg(*aggregates))


def sliding(df: DataFrame, ts: str, width: str, step: str, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Overlapping windows in steps. A range frame's value for every row has no counterpart on a stream."""
    return _flat(df.groupBy(F.window(ts, width, step), *keys).agg(*aggregates))


def sessions(df: DataFrame, ts: str, gap: str, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    return _flat(df.groupBy(F.session_window(ts, gap).alias("window"), *keys).agg(*aggregates))


def _flat(df: DataFrame) -> DataFrame:
    return df.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), F.col("window.end").cast("timestamp_ntz").alias("window_end"), *[c for c in df.columns if c != "window"])


def deduplicated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first row of each key within the watermark's lateness."""
    return df.dropDuplicatesWithinWatermark(list(keys))


def run(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Everything there is, in micro-batches, then stop."""
    df.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def collected(df: DataFrame, store: Store, table: str, mode: str = "append") -> DataFrame:
    """What a stream gives in one run, as a table of a store. A micro-batch that is repeated replaces its own rows."""

    def each(batch: DataFrame, number: int) -> None:
        marked = batch.withColumn("_batch", F.lit(number))
        if store.exists(table):
            marked = store.read(table).filter(F.col("_batch") != number).unionByName(marked)
        store.write(table, marked)

    run(df, each, f"{store.root}/_checkpoints/{table}", mode)
    return store.read(table).drop("_batch")


def latest_state(df: DataFrame, store: Store, table: str, keys: Sequence[str], ts: str, order: Sequence[str], deleted: str = "false") -> DataFrame:
    """The newest row of each key, kept by a guarded merge of each micro-batch; merging one twice changes nothing."""

    def each(batch: DataFrame, number: int) -> None:
        newest = latest(batch, keys, [F.col(ts).desc(), *[F.col(o).desc() for o in order]])
        if not store.exists(table):
            store.write(table, newest.filter(f"not ({deleted})"))
        else:
            store.write(table, guarded_upsert(store.read(table).alias("t"), newest, keys, ts, deleted))

    run(df, each, f"{store.root}/_checkpoints/{table}")
    return store.read(table)
