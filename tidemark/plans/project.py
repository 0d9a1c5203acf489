"""Models, their graph and materializations.

A model is a function from a context to a DataFrame, so its plan stays lazy until its strategy writes it.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import timedelta
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import incremental as inc
from tidemark.operators import scd
from tidemark.operators.checks import DataTest, Rule, Verdict, enforce_schema, judge
from tidemark.sources.registry import Catalog
from tidemark.sources.storage import Store

LAYERS = ("staging", "intermediate", "marts")
PREFIXES = {"staging": ("stg_",), "intermediate": ("int_",), "marts": ("dim_", "fct_", "mart_")}
DEFAULT_MATERIALIZATION = {"staging": "view", "intermediate": "ephemeral", "marts": "table"}


@dataclass(frozen=True)
class Environment:
    """A target: dev reads samples and keeps little, prod all. threads is how many models may run at once."""

    name: str
    threads: int = 4
    schema: str = "analytics"
    sample_percent: int = 100
    max_rows: int | None = None


ENVIRONMENTS = {e.name: e for e in (Environment("dev", 4, "dev", 1, 100_000), Environment("ci", 4, "ci", 5), Environment("staging", 8, "staging", 50), Environment("prod", 12))}


def schema_name(default: str, custom: str | None, env: str) -> str:
    """<default>_<custom>; in prod the custom name alone."""
    if not custom:
        return default
    return custom.strip() if env == "prod" else f"{default}_{custom.strip()}"


def pr_environment(branch: str, number: int, most: int = 60) -> str:
    """A schema name for a branch under review."""
    return f"pr_{number}_{re.sub(r'[^a-z0-9]+', '_', branch.lower()).strip('_')}"[:most].rstrip("_")


@dataclass
class Model:
    name: str
    make: Callable[[Context], DataFrame]
    layer: str = "marts"
    depends_on: Sequence[str] = ()
    materialized: str | None = None
    strategy: str = "append"
    unique_key: Sequence[str] = ()
    partition_by: Sequence[str] = ()
    sort_by: Sequence[str] = ()
    updated_at: str | None = None
    on_schema_change: str = "ignore"
    predicate: str | None = None
    keep_columns: Sequence[str] = ()
    batch_size: timedelta = timedelta(days=1)
    lookback: int = 0
    contract: Sequence[Rule] = ()
    pre_hooks: Sequence[Callable[[Context], None]] = ()
    post_hooks: Sequence[Callable[[Context], None]] = ()
    tags: Sequence[str] = ()

    @property
    def kind(self) -> str:
        return self.materialized or DEFAULT_MATERIALIZATION[self.layer]


@dataclass
class Context:
    """What a model sees: sources, other models, its own last state, variables and a fixed present."""

    spark: SparkSession
    catalog: Catalog
    store: Store
    as_of: str
    env: Environment = ENVIRONMENTS["prod"]
    vars: Mapping[str, object] = field(default_factory=dict)
    full_refresh: bool = False
    model: Model | None = None
    built: dict[str, DataFrame] = field(default_factory=dict)

    def source(self, table: str, system: str = "raw") -> DataFrame:
        return self.catalog.read(system, table)

    def ref(self, name: str) -> DataFrame:
        if self.model and name not in self.model.depends_on:
            raise ValueError(f"{self.model.name} doesn't declare {name}")
        return self.built[name]

    def var(self, name: str, default=None):
        return self.vars.get(name, default)

    @property
    def this(self) -> DataFrame:
        return self.store.read(self.model.name)

    @property
    def is_incremental(self) -> bool:
        return self.model.kind == "incremental" and not self.full_refresh and self.store.exists(self.model.name)


@dataclass
class RunResult:
    model: str
    status: str
    seconds: float
    materialized: str
    message: str = ""


class Project:
    """A registry of models and tests that runs them in order of their references."""

    def __init__(self):
        self.models: dict[str, Model] = {}
        self.tests: list[DataTest] = []
        self.on_start: list[Callable[[Context], None]] = []
        self.on_end: list[Callable[[Context, list[RunResult]], None]] = []

    def model(self, name: str | None = None, **config) -> Callable:
        def add(f: Callable[[Context], DataFrame]):
            n = name or f.__name__
            self.models[n] = Model(n, f, **config)
            return f

        return add

    def test(self, model: str, failures: Callable[[DataFrame], DataFrame], name: str, **config) -> None:
        self.tests.append(DataTest(name, model, failures, **config))

    def order(self, select: Sequence[str] | None = None) -> list[str]:
        """Models after those they refer to; with select, these and all they need."""
        for m in self.models.values():
            if missing := [d for d in m.depends_on if d not in self.models]:
                raise ValueError(f"{m.name} refers to unknown {missing}")
        all_ = list(TopologicalSorter({n: set(m.depends_on) for n, m in self.models.items()}).static_order())
        if select is None:
            return all_
        wanted, todo = set(), list(select)
        while todo:
            n = todo.pop()
            if n not in wanted:
                wanted.add(n)
                todo += self.models[n].depends_on
        return [n for n in all_ if n in wanted]

    def lint(self) -> list[str]:
        """Names that don't fit their layer, and references to a later layer."""
        out = []
        for m in self.models.values():
            if not m.name.startswith(PREFIXES[m.layer]):
                out.append(f"{m.name}: {m.layer} models start with {' or '.join(PREFIXES[m.layer])}")
            out += [f"{m.name}: {m.layer} refers to later {self.models[d].layer} {d}" for d in m.depends_on if d in self.models and LAYERS.index(self.models[d].layer) > LAYERS.index(m.layer)]
        return out

    def run(self, ctx: Context, select: Sequence[str] | None = None) -> list[RunResult]:
        for hook in self.on_start:
            hook(ctx)
        results, failed = [], set()
        for name in self.order(select):
            m = self.models[name]
            if failed & set(m.depends_on):
                failed.add(name)
                results.append(RunResult(name, "skipped", 0.0, m.kind))
                continue
            own, began = replace(ctx, model=m, built=ctx.built), time.monotonic()
            ctx.spark.sparkContext.setJobDescription(f"model {name}")
            try:
                for hook in m.pre_hooks:
                    hook(own)
                ctx.built[name] = materialize(own)
                for hook in m.post_hooks:
                    hook(own)
                results.append(RunResult(name, "success", time.monotonic() - began, m.kind))
            except Exception as e:
                failed.add(name)
                results.append(RunResult(name, "error", time.monotonic() - began, m.kind, str(e)[:500]))
            finally:
                ctx.spark.sparkContext.setJobDescription(None)
        for hook in self.on_end:
            hook(ctx, results)
        return results

    def check(self, ctx: Context) -> list[Verdict]:
        return [judge(t, ctx.built[t.model], ctx.store) for t in self.tests]


def materialize(ctx: Context) -> DataFrame:
    """A model's result under its materialization; what later models read."""
    m = ctx.model
    if m.kind == "incremental":
        return _incremental(ctx)
    df = m.make(ctx)
    if m.contract:
        df = enforce_schema(df, m.contract)
    if m.kind == "ephemeral":
        return df
    if m.kind == "view":
        df.createOrReplaceTempView(m.name)
        return df
    if m.kind == "snapshot":
        old = ctx.store.read(m.name) if ctx.store.exists(m.name) else None
        return ctx.store.write(m.name, scd.snapshot(old, df, m.unique_key[0], m.updated_at, as_of=ctx.as_of))
    if m.kind in ("table", "materialized_view"):
        return ctx.store.write(m.name, df, partition_by=list(m.partition_by) or None, sort_by=list(m.sort_by) or None)
    raise ValueError(f"{m.name}: unknown materialization {m.kind}")


def _incremental(ctx: Context) -> DataFrame:
    m, batch = ctx.model, ctx.model.make(ctx)
    if m.contract:
        batch = enforce_schema(batch, m.contract)
    how = {"partition_by": list(m.partition_by) or None, "sort_by": list(m.sort_by) or None}
    if not ctx.is_incremental:
        return ctx.store.write(m.name, batch, **how)
    target, batch = inc.evolve(ctx.this, batch, m.on_schema_change)
    keys = list(m.unique_key)
    strategies: dict[str, Callable[[], DataFrame]] = {
        "append": lambda: inc.append(target, batch),
        "append_new": lambda: inc.append_new(target, batch, keys),
        "delete_insert": lambda: inc.delete_insert(target, batch, keys, m.predicate, m.keep_columns),
        "merge": lambda: inc.merge(target, batch, keys),
        "merge_sync": lambda: inc.not_in_source_deleted(target, batch, keys),
        "insert_overwrite": lambda: inc.overwrite_partitions(target, batch, list(m.partition_by)),
    }
    return ctx.store.write(m.name, strategies[m.strategy](), **how)


def choose_materialization(rows: int) -> str:
    """What a model of so many rows should be."""
    return "incremental" if rows > 10_000_000 else "table" if rows > 1_000_000 else "view"


def warehouse_size(rows: int) -> str:
    return "X-LARGE" if rows > 50_000_000 else "LARGE" if rows > 10_000_000 else "MEDIUM" if rows > 1_000_000 else "SMALL"


def log_run(store: Store, table: str = "run_log") -> Callable[[Context, list[RunResult]], None]:
    """An on_end hook that appends a row for each model run."""

    def hook(ctx: Context, results: list[RunResult]) -> None:
        rows = [(r.model, r.status, float(r.seconds), r.materialized, ctx.env.name, ctx.as_of) for r in results]
        store.append(table, ctx.spark.createDataFrame(rows, "model_name string, status string, seconds double, materialized string, env string, run_at string"))

    return hook


class Slots:
    """Blue-green deployment: models are built in the idle slot, then views point at it."""

    def __init__(self, store: Store, table: str = "deployment_slots"):
        self.store, self.table = store, table

    def active(self) -> str:
        if not self.store.exists(self.table):
            return "blue"
        return self.store.read(self.table).filter("is_active").first()["slot"]

    def idle(self) -> str:
        return "green" if self.active() == "blue" else "blue"

    def switch(self, models: Sequence[str]) -> str:
        """Point each model's view at the idle slot's table and make that slot active."""
        new = self.idle()
        for name in models:
            self.store.read(f"{new}/{name}").createOrReplaceTempView(name)
        rows = [(s, s == new) for s in ("blue", "green")]
        self.store.write(self.table, self.store.spark.createDataFrame(rows, "slot string, is_active boolean"))
        return new

    def clean(self, models: Sequence[str]) -> None:
        for name in models:
            self.store.drop(f"{self.idle()}/{name}")


def analyze(spark: SparkSession, table: str) -> None:
    """Statistics for a catalog table; indexes and vacuuming have no counterpart on Parquet."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")


def audit_columns(df: DataFrame, ctx: Context) -> DataFrame:
    return df.withColumns({"loaded_at": F.lit(ctx.as_of).cast("timestamp_ntz"), "loaded_by": F.lit(ctx.env.name), "model_name": F.lit(ctx.model.name if ctx.model else None).cast("string")})
