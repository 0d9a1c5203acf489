"""What the operators share: the shared folder, saved tables, shipping code to executors, words."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of anything but space and the controls 09 to 0D. bytes.split() splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset one in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/.tidemark"
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Compute df now and read it from the shared folder from here on."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def by_range(df: DataFrame, *order: Column | str) -> DataFrame:
    """df dealt by ranges of order, with range, the number of a row's; ranges are in order. Computed now, so they stay."""
    return cut(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))


def few_rows(df: DataFrame, few: int) -> DataFrame:
    """df, computed now; broadcast in joins if it has at most few rows."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= few else df


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses, remembered for drop_saved()."""
    path, sc = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}", spark.sparkContext
    sc._tidemark_paths = [*getattr(sc, "_tidemark_paths", []), path]
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again; later reads prune columns. See drop_saved()."""
    return saved_at(df, name)[0]


def saved_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """saved() and the path, for drop_path()."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete one path of fresh_path(); nothing may read it any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    spark.sparkContext._tidemark_paths = [x for x in spark.sparkContext._tidemark_paths if x != path]


def saved_paths(spark: SparkSession) -> list[str]:
    """The paths under the shared folder that this application has put and not deleted."""
    return list(getattr(spark.sparkContext, "_tidemark_paths", []))


def drop_saved(spark: SparkSession, but: Iterable[str] = ()) -> None:
    """Delete what this application has put under the shared folder, but the paths given; results that still read it must be
    written first."""
    for path in set(saved_paths(spark)) - set(but):
        drop_path(spark, path)


def ship(spark: SparkSession) -> None:
    """Make this subpackage importable on every executor."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    here = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.write(here.parent / "__init__.py", "tidemark/__init__.py")
        for p in sorted(here.glob("*.py")):
            z.write(p, f"tidemark/llm/{p.name}")
    path = os.path.join(tempfile.mkdtemp(), f"tidemark_llm_{uuid.uuid4().hex[:8]}.zip")
    Path(path).write_bytes(data.getvalue())
    sc.addPyFile(path)
    sc._tidemark_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows that a Python worker takes up at once.
SLICE = 1 << 22


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run over the same rows in batches of about SLICE bytes, or one row; what a worker has freed goes back at the end."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = max(1, b.num_rows * SLICE // max(b.nbytes, SLICE))
            for at in range(0, b.num_rows, step):
                yield b.slice(at, step)

    def kept_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(cut_up(batches))
        finally:
            give_back()

    return kept_small


def give_back() -> None:
    """Return memory that allocators hold for later use."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores put before it until no column of df has it (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
