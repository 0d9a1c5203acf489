"""What surrounds a run: memoized results, nested settings, staged jobs, dialects, exports, audits and governance records."""

from __future__ import annotations

import json
import re
import time
import warnings
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import Future, ThreadPoolExecutor, wait
from concurrent.futures import TimeoutError as FutureTimeout
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import date, timedelta
from graphlib import TopologicalSorter
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.project import Context, RunResult
from tidemark.plans.semantic import Registry, SemanticModel
from tidemark.sources.registry import values
from tidemark.sources.storage import Store


class Memo:
    """DataFrames by key, computed once and kept in Spark's cache until dropped."""

    def __init__(self):
        self._made: dict[str, DataFrame] = {}

    def get(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        if key not in self._made:
            self._made[key] = make().cache()
        return self._made[key]

    def drop(self, key: str | None = None) -> None:
        for k in [key] if key else list(self._made):
            self._made.pop(k).unpersist()


def merged(base: Mapping, over: Mapping) -> dict:
    """Nested settings: mappings merge key by key, anything else of over replaces base's."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def flattened(config: Mapping, prefix: str = "") -> dict[str, object]:
    """Nested settings by dotted path."""
    out: dict[str, object] = {}
    for k, v in config.items():
        out |= flattened(v, f"{prefix}{k}.") if isinstance(v, Mapping) else {f"{prefix}{k}": v}
    return out


def dispatch(implementations: Mapping[str, Callable], dialect: str = "spark") -> Callable:
    """The implementation for a dialect, or the default one."""
    found = implementations.get(dialect) or implementations.get("default")
    if found is None:
        raise KeyError(f"no implementation for {dialect}")
    return found


def dispatch_in(packages: Mapping[str, Mapping[str, Callable]], order: Sequence[str], dialect: str = "spark") -> Callable:
    """The implementation of the first package in the search order that has one for a dialect or a default one."""
    for name in order:
        found = packages.get(name, {})
        if dialect in found or "default" in found:
            return dispatch(found, dialect)
    raise KeyError(f"no implementation for {dialect} in {', '.join(order)}")


def maintain(spark: SparkSession, table: str, wanted: Sequence[str] = ("statistics",)) -> list[str]:
    """Statistics for a catalog table; what Parquet has no counterpart for, such as indexes or vacuuming, only warns."""
    done = []
    for what in wanted:
        if what == "statistics":
            spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")
            done.append(what)
        else:
            warnings.warn(f"{what} has no counterpart on Parquet; {table} is left as it is", stacklevel=2)
    return done


def statistics(spark: SparkSession, table: str) -> DataFrame:
    """(column_name, n_rows, n_null, low, high) for each analyzed column of a catalog table, as its statistics have them."""
    shown = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
    n_rows = int(re.search(r"(\d+) rows", shown["Statistics"])[1])
    rows = []
    for c in spark.table(table).columns:
        found = {r.info_name: r.info_value for r in spark.sql(f"DESCRIBE EXTENDED {table} `{c}`").collect()}
        rows.append((c, n_rows, int(found["num_nulls"]), found["min"], found["max"]))
    return values(spark, rows, "column_name string, n_rows long, n_null long, low string, high string")


_LABEL = "tidemark.label."


@contextmanager
def labelled(spark: SparkSession, **labels: str) -> Iterator[None]:
    """Labels of the jobs that this thread starts within, as the job description and local properties."""
    sc = spark.sparkContext
    sc.setJobDescription(", ".join(f"{k}={v}" for k, v in sorted(labels.items())) or None)
    sc.setLocalProperty(f"{_LABEL}names", ",".join(sorted(labels)))
    for k, v in labels.items():
        sc.setLocalProperty(f"{_LABEL}{k}", v)
    try:
        yield
    finally:
        sc.setJobDescription(None)
        for k in (*labels, "names"):
            sc.setLocalProperty(f"{_LABEL}{k}", None)


def label_table(spark: SparkSession, table: str, **labels: str) -> None:
    """Labels of a catalog table, as properties."""
    pairs = ", ".join(f"'{_LABEL}{k}' = '{v}'" for k, v in sorted(labels.items()))
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({pairs})")


def labels_of(spark: SparkSession, table: str | None = None) -> DataFrame:
    """(kind, label, value): labels that this thread's jobs carry now, their comment, and those of a catalog table."""
    sc = spark.sparkContext
    names = (sc.getLocalProperty(f"{_LABEL}names") or "").split(",")
    rows = [("job", k, sc.getLocalProperty(f"{_LABEL}{k}")) for k in names if k]
    if comment := sc.getLocalProperty("spark.job.description"):
        rows.append(("comment", "comment", comment))
    if table:
        rows += [("table", r.key.removeprefix(_LABEL), r.value) for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect() if r.key.startswith(_LABEL)]
    return values(spark, rows, "kind string, label string, value string")


@dataclass
class Stage:
    """A step of a job; steps that are parallel_safe may run beside others once their dependencies are done."""

    name: str
    run: Callable[[], object]
    depends_on: Sequence[str] = ()
    parallel_safe: bool = True
    timeout: float | None = None


def waves(stages: Sequence[Stage]) -> list[list[str]]:
    """Stages in the order they run: those of a wave may run at once, unsafe ones stand alone."""
    by = {s.name: s for s in stages}
    sorter = TopologicalSorter({s.name: set(s.depends_on) for s in stages})
    sorter.prepare()
    out = []
    while sorter.is_active():
        ready = sorted(sorter.get_ready())
        together = [n for n in ready if by[n].parallel_safe]
        out += [together] * bool(together) + [[n] for n in ready if not by[n].parallel_safe]
        sorter.done(*ready)
    return out


def run_stages(stages: Sequence[Stage], threads: int = 4) -> dict[str, str]:
    """A status for each stage: success, error, timeout, or skipped after a failure it depends on."""
    by, status = {s.name: s for s in stages}, {}
    with ThreadPoolExecutor(threads) as pool:
        for wave in waves(stages):
            futures: dict[str, Future] = {}
            for n in wave:
                if any(status.get(d) != "success" for d in by[n].depends_on):
                    status[n] = "skipped"
                else:
                    futures[n] = pool.submit(by[n].run)
            began = time.monotonic()
            for n, f in futures.items():
                left = None if by[n].timeout is None else max(0.0, by[n].timeout - (time.monotonic() - began))
                try:
                    f.result(left)
                    status[n] = "success"
                except FutureTimeout:
                    status[n] = "timeout"
                except Exception:
                    status[n] = "error"
            wait(futures.values())
    return status


def audit(store: Store, alert: Callable[[str], None] = print, table: str = "deployment_audit") -> Callable[[Context, list[RunResult]], None]:
    """An on_end hook: a row for each run, and a call of alert where models failed."""

    def hook(ctx: Context, results: list[RunResult]) -> None:
        failed = [r.model for r in results if r.status == "error"]
        row = (ctx.env.name, ctx.as_of, len(results), len(failed), "failed" if failed else "success")
        store.append(table, ctx.spark.createDataFrame([row], "env string, run_at string, models long, failures long, status string"))
        if failed:
            alert(f"{ctx.env.name}: {', '.join(failed)} failed")

    return hook


@dataclass
class Record:
    """The governance of a metric: tier, who approved it, when it is due for review, and its changes."""

    metric: str
    tier: int
    owner: str
    approved_by: Sequence[str] = ()
    reviewed: date | None = None
    changes: list[tuple[date, str]] = field(default_factory=list)


#: Hours until a metric must be fresh, approvals and days between reviews, by tier.
TIERS = {1: (4, 2, 90), 2: (24, 1, 180), 3: (72, 0, 365)}


def governance(records: Sequence[Record], today: date) -> list[tuple[str, int, int, bool, bool]]:
    """(metric, tier, SLA hours, approved, review due) for each record."""
    out = []
    for r in records:
        hours, approvals, days = TIERS[r.tier]
        out.append((r.metric, r.tier, hours, len(r.approved_by) >= approvals, r.reviewed is None or r.reviewed + timedelta(days=days) <= today))
    return out


def dataset_json(model: SemanticModel, name: str | None = None) -> str:
    """A BI dataset: a table with typed columns and measures."""
    kinds = {"count": "Int64", "count_distinct": "Int64"}
    columns = [{"name": d.name, "dataType": "DateTime" if d.kind == "time" else "string"} for d in model.dimensions]
    measures = [{"name": m.name, "expression": f"{m.agg.upper()}({m.expr})", "formatType": kinds.get(m.agg, "Double")} for m in model.measures]
    return json.dumps({"name": name or model.name, "tables": [{"name": model.name, "columns": columns, "measures": measures}]}, indent=2)


def datasource_xml(registry: Registry, model: str) -> str:
    """A data source of a BI tool: a column for each dimension and measure."""
    m = registry.models[model]
    rows = [f"  <column name={quoteattr(d.name)} role='dimension' type={quoteattr('date' if d.kind == 'time' else 'string')}/>" for d in m.dimensions]
    rows += [f"  <column name={quoteattr(x.name)} role='measure' aggregation={quoteattr(x.agg)}/>" for x in m.measures]
    return "\n".join([f"<datasource name={quoteattr(model)}>", *rows, "</datasource>"])


def extract(df: DataFrame, path: str, format: str = "csv") -> None:
    """A query's result as files for a BI tool."""
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if format == "csv" else writer).format(format).save(path)


#: The steps of a check of changes, in order; a pipeline outside runs them.
CI_STEPS = ("dependencies", "lint", "build", "test", "docs")


def ci_matrix(environments: Sequence[str], steps: Sequence[str] = CI_STEPS) -> list[tuple[str, str]]:
    return [(e, s) for e in environments for s in steps]
