"""The metric layer: semantic models, metrics, and queries that compile to plans.

A query is resolved measure by measure: a measure's model is joined with the models that its dimensions belong to (facts to
their primary entities, so no fan-out), filtered, grouped at the grain asked for, and the metrics are put together on the
groups. Cumulative metrics of additive measures use a range frame over days; distinct counts add up by how much each day
changes them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.relational import union_all
from tidemark.sources.registry import date_spine

ADDITIVE = {"sum", "count"}
GRAINS = ("day", "week", "month", "quarter", "year")


@dataclass(frozen=True)
class Entity:
    name: str
    kind: str  # primary or foreign
    expr: str


@dataclass(frozen=True)
class Dimension:
    name: str
    kind: str = "categorical"  # or time
    expr: str | None = None


@dataclass(frozen=True)
class Measure:
    name: str
    agg: str  # sum, count, count_distinct, average, min, max
    expr: str = "1"
    time: str | None = None


@dataclass
class SemanticModel:
    name: str
    table: Callable[[], DataFrame]
    entities: Sequence[Entity] = ()
    dimensions: Sequence[Dimension] = ()
    measures: Sequence[Measure] = ()
    time: str | None = None
    owner: str | None = None


@dataclass
class Metric:
    """simple: measure; ratio: numerator / denominator metrics; cumulative: measure over window_days (None: from the
    start); derived: an expression over metrics, some shifted back by offset days."""

    name: str
    kind: str
    measure: str | None = None
    filter: str | None = None
    numerator: str | None = None
    denominator: str | None = None
    window_days: int | None = None
    expr: str | None = None
    inputs: Mapping[str, tuple[str, int]] = field(default_factory=dict)
    tier: int = 3
    owner: str | None = None
    label: str | None = None


@dataclass
class MetricQuery:
    metrics: Sequence[str]
    dimensions: Sequence[str] = ()
    start_date: str | None = None
    end_date: str | None = None
    granularity: str | None = None
    filters: Sequence[str] = ()
    order_by: Sequence[str] = ()
    limit: int | None = None


def _aggregate(m: Measure) -> Column:
    e = F.expr(m.expr)
    return {"sum": F.sum, "count": F.count, "count_distinct": F.countDistinct, "average": F.avg, "min": F.min, "max": F.max}[m.agg](e)


class Registry:
    """Semantic models and metrics, and their queries."""

    def __init__(self, models: Sequence[SemanticModel], metrics: Sequence[Metric], row_filters: Mapping[str, str] | None = None):
        self.models = {m.name: m for m in models}
        self.metrics = {m.name: m for m in metrics}
        self.measures = {x.name: (m, x) for m in models for x in m.measures}
        self.row_filters = dict(row_filters or {})

    def lint(self) -> list[str]:
        """What metrics refer to but nothing defines."""
        out = []
        for m in self.metrics.values():
            refs = [("measure", m.measure)] if m.kind in ("simple", "cumulative") else [("metric", x) for x in ((m.numerator, m.denominator) if m.kind == "ratio" else [i[0] for i in m.inputs.values()])]
            for what, name in refs:
                if name not in (self.measures if what == "measure" else self.metrics):
                    out.append(f"{m.name}: unknown {what} {name}")
        return out

    def list_metrics(self) -> list[dict]:
        return [{"name": m.name, "type": m.kind, "tier": m.tier, "label": m.label or m.name, "dimensions": self.dimensions_of(m.name)} for m in self.metrics.values()]

    def list_models(self) -> list[dict]:
        return [{"name": m.name, "entities": [e.name for e in m.entities], "dimensions": [d.name for d in m.dimensions], "measures": [x.name for x in m.measures]} for m in self.models.values()]

    def dimensions_of(self, metric: str) -> list[str]:
        """What a metric can be grouped by: dimensions of its model and of those one join away, that all inputs share."""
        m = self.metrics[metric]
        if m.kind in ("simple", "cumulative"):
            if m.measure not in self.measures:
                return []
            own = self.measures[m.measure][0]
            foreign = {e.name for e in own.entities}
            near = [x for x in self.models.values() if x is own or any(e.kind == "primary" and e.name in foreign for e in x.entities)]
            return sorted({d.name for x in near for d in x.dimensions})
        refs = [m.numerator, m.denominator] if m.kind == "ratio" else [i[0] for i in m.inputs.values()]
        found = [set(self.dimensions_of(r)) for r in refs if r in self.metrics]
        return sorted(set.intersection(*found)) if found else []

    def _base(self, model: SemanticModel, dimensions: Sequence[str], time: str | None) -> DataFrame:
        """The model's rows with metric_time and the dimensions, joined in from models whose primary entity it names."""
        df = model.table()
        if model.name in self.row_filters:
            df = df.filter(self.row_filters[model.name])
        own = {d.name: d for d in model.dimensions}
        made, joins = {}, {}
        for d in dimensions:
            if d in own:
                made[d] = F.expr(own[d].expr or d)
                continue
            for e in model.entities:
                other = next((m for m in self.models.values() if m is not model and any(x.kind == "primary" and x.name == e.name for x in m.entities) and any(x.name == d for x in m.dimensions)), None)
                if other:
                    joins.setdefault((e, other.name), []).append(d)
                    break
            else:
                raise ValueError(f"{model.name} can't reach dimension {d}")
        if time:
            df = df.withColumn("metric_time", F.expr(time).cast("date"))
        df = df.withColumns({f"_d_{n}": c for n, c in made.items()})
        for (e, other), names in joins.items():
            m = self.models[other]
            key = next(x.expr for x in m.entities if x.kind == "primary" and x.name == e.name)
            right = m.table()
            if other in self.row_filters:
                right = right.filter(self.row_filters[other])
            exprs = {x.name: x.expr or x.name for x in m.dimensions}
            right = right.select(F.expr(key).alias("_key"), *[F.expr(exprs[n]).alias(f"_d_{n}") for n in names])
            df = df.withColumn("_fk", F.expr(e.expr)).join(right, F.col("_fk") == F.col("_key"), "left").drop("_fk", "_key")
        return df

    def _dims_in(self, text: str) -> list[str]:
        return re.findall(r"\{\{\s*Dimension\('(?:\w+__)?(\w+)'\)\s*\}\}", text)

    def _measured(self, measure: str, dimensions: Sequence[str], grain: str | None, filters: Sequence[str], start: str | None, end: str | None) -> DataFrame:
        model, m = self.measures[measure]
        extra = [d for f in filters for d in self._dims_in(f)]
        df = self._base(model, list(dict.fromkeys([*dimensions, *extra])), m.time or model.time)
        for f in filters:
            df = df.filter(re.sub(r"\{\{\s*Dimension\('(?:\w+__)?(\w+)'\)\s*\}\}", r"_d_\1", f))
        df = _between(df, start, end)
        keys = [F.trunc("metric_time", grain).alias("metric_time") if grain != "day" else F.col("metric_time")] if grain else []
        return df.groupBy(*keys, *[F.col(f"_d_{d}").alias(d) for d in dimensions]).agg(_aggregate(m).alias("value"))

    def _metric(self, name: str, q: MetricQuery) -> DataFrame:
        """(metric_time, dimensions, value) of one metric."""
        m, keys = self.metrics[name], self._keys(q)
        filters = [*q.filters, *([m.filter] if m.filter else [])]
        if m.kind == "simple":
            return self._measured(m.measure, q.dimensions, q.granularity, filters, q.start_date, q.end_date)
        if m.kind == "cumulative":
            return self._cumulative(m, q, filters)
        if m.kind == "ratio":
            top, bottom = self._metric(m.numerator, q), self._metric(m.denominator, q)
            both = _outer(top.withColumnRenamed("value", "_n"), bottom.withColumnRenamed("value", "_d"), keys)
            return both.select(*keys, F.try_divide(F.col("_n").cast("double"), F.col("_d").cast("double")).alias("value"))
        return self._derived(m, q, keys)

    def _cumulative(self, m: Metric, q: MetricQuery, filters: Sequence[str]) -> DataFrame:
        """A value for each day of the query, whatever the grain: the measure over the window that ends with the day.

        Only rows that a window of the query holds are read. The days are those from start_date to end_date; where one isn't
        given, from the first or to the last day of the data. With dimensions, each combination gets those whose window holds
        rows of it.
        """
        model, x = self.measures[m.measure]
        first = None
        if q.start_date and m.window_days is not None:
            first = str(date.fromisoformat(q.start_date) - timedelta(days=m.window_days - 1))
        if x.agg in ADDITIVE:
            daily = self._measured(m.measure, q.dimensions, "day", filters, first, q.end_date)
            met = _left(self._days(daily, q, first, m.window_days), daily, ["metric_time", *q.dimensions])
            w = W.partitionBy(*q.dimensions).orderBy(F.datediff("metric_time", F.lit("1970-01-01").cast("date")))
            w = w.rangeBetween(W.unboundedPreceding if m.window_days is None else 1 - m.window_days, 0)
            out = met.withColumn("value", F.sum("value").over(w))
            if q.dimensions:
                out = out.filter("value is not null")
        else:
            extra = [d for f in filters for d in self._dims_in(f)]
            df = self._base(model, list(dict.fromkeys([*q.dimensions, *extra])), x.time or model.time)
            for f in filters:
                df = df.filter(re.sub(r"\{\{\s*Dimension\('(?:\w+__)?(\w+)'\)\s*\}\}", r"_d_\1", f))
            df = _between(df, first, q.end_date)
            # a value counts from a day it is seen until its window ends or it is seen again: changes of the count by day,
            # added up, so rows don't multiply with the width of the window
            seen = df.select("metric_time", *[F.col(f"_d_{d}").alias(d) for d in q.dimensions], F.expr(x.expr).alias("_v")).filter("_v is not null").distinct()
            again = F.lead("metric_time").over(W.partitionBy(*q.dimensions, "_v").orderBy("metric_time"))
            leaves = again if m.window_days is None else F.least(again, F.date_add("metric_time", m.window_days))
            moves = seen.withColumn("_until", leaves).select(*q.dimensions, F.explode(F.array(F.struct(F.col("metric_time").alias("d"), F.lit(1).alias("n")), F.struct(F.col("_until").alias("d"), F.lit(-1).alias("n")))).alias("_m"))
            daily = moves.groupBy(F.col("_m.d").alias("metric_time"), *q.dimensions).agg(F.sum("_m.n").alias("value")).filter("metric_time is not null")
            met = _left(self._days(seen, q, first, m.window_days), daily, ["metric_time", *q.dimensions])
            w = W.partitionBy(*q.dimensions).orderBy("metric_time").rowsBetween(W.unboundedPreceding, 0)
            out = met.withColumn("value", F.coalesce(F.sum("value").over(w), F.lit(0)))
            if q.dimensions:
                out = out.filter("value > 0")
        if q.start_date:
            out = out.filter(F.col("metric_time") >= F.lit(q.start_date).cast("date"))
        return out

    def _days(self, df: DataFrame, q: MetricQuery, first: str | None, window: int | None) -> DataFrame:
        """The days that windows need: from first, or where that is open from the first of the data; of each combination of
        dimensions only those from its first day until its last window ends."""
        low, high = first, q.end_date
        if not high or not (low or q.dimensions):
            least, most = df.agg(F.min("metric_time"), F.max("metric_time")).first()
            low, high = low or str(least or "1970-01-01"), high or str(most or "1970-01-01")
        if not q.dimensions:
            return date_spine(df.sparkSession, low, high, "day", "metric_time", include_end=True)
        last = F.lit(high).cast("date")
        if window is not None:
            last = F.least(last, F.date_add(F.max("metric_time"), window - 1))
        spans = df.groupBy(*q.dimensions).agg(F.min("metric_time").alias("_from"), last.alias("_to"))
        return spans.filter("_from <= _to").select(*q.dimensions, F.explode(F.sequence("_from", "_to")).alias("metric_time"))

    def _derived(self, m: Metric, q: MetricQuery, keys: Sequence[str]) -> DataFrame:
        out = None
        for alias, (name, offset) in m.inputs.items():
            own = q
            if offset:
                back = lambda d: str(date.fromisoformat(d) - timedelta(days=offset)) if d else None  # noqa: E731, B023
                own = MetricQuery(q.metrics, q.dimensions, back(q.start_date), back(q.end_date), q.granularity, q.filters)
            found = self._metric(name, own).withColumnRenamed("value", alias)
            if offset and q.granularity:
                shifted = F.date_add("metric_time", offset)
                found = found.withColumn("metric_time", shifted if q.granularity == "day" else F.trunc(shifted, q.granularity))
            out = found if out is None else _outer(out, found, keys)
        return out.select(*keys, F.expr(m.expr).alias("value"))

    def _keys(self, q: MetricQuery) -> list[str]:
        return (["metric_time"] if q.granularity else []) + list(q.dimensions)

    def query(self, q: MetricQuery) -> DataFrame:
        """A row for each group, a column for each metric."""
        if q.granularity and q.granularity not in GRAINS:
            raise ValueError(f"granularity {q.granularity}")
        keys, out = self._keys(q), None
        for name in q.metrics:
            found = self._metric(name, q).withColumnRenamed("value", name)
            out = found if out is None else _outer(out, found, keys)
        if q.order_by:
            out = out.orderBy(*[F.col(o[1:]).desc() if o.startswith("-") else F.col(o) for o in q.order_by])
        return out.limit(q.limit) if q.limit is not None else out

    def query_long(self, q: MetricQuery) -> DataFrame:
        """A row for each group and metric: metric_name, value."""
        parts = [self._metric(n, q).select(*self._keys(q), F.lit(n).alias("metric_name"), F.col("value").cast("double").alias("value")) for n in q.metrics]
        return union_all(*parts)

    def compare(self, q: MetricQuery, how: str = "previous_period") -> DataFrame:
        """The query's period and the one before it or a year earlier, told apart by period."""
        start, end = date.fromisoformat(q.start_date), date.fromisoformat(q.end_date)
        back = timedelta(days=365) if how == "year_over_year" else end - start + timedelta(days=1)
        before = MetricQuery(q.metrics, q.dimensions, str(start - back), str(end - back), q.granularity, q.filters)
        return union_all(self.query(q).withColumn("period", F.lit("current")), self.query(before).withColumn("period", F.lit(how)))


def _outer(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A full outer join on keys that may be null; without keys each has one row."""
    if not keys:
        return a.crossJoin(b)
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    rest = [c for c in a.columns if c not in keys], [c for c in b.columns if c not in keys]
    return a.alias("a").join(b.alias("b"), on, "full_outer").select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], *[f"a.{c}" for c in rest[0]], *[f"b.{c}" for c in rest[1]])


def _between(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Rows whose metric_time is within the dates given; a bound on the cast of a column still reaches the scan."""
    if start:
        df = df.filter(F.col("metric_time") >= F.lit(start).cast("date"))
    return df.filter(F.col("metric_time") <= F.lit(end).cast("date")) if end else df


def _left(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.alias("a").join(b.alias("b"), on, "left").select("a.*", *[f"b.{c}" for c in b.columns if c not in keys])


def trend_stats(df: DataFrame, value: str, order: str) -> DataFrame:
    """One row: mean, population deviation, variation, direction of the last seven against the first seven, volatility.

    The seven at either end are a top-k, so no task sees all rows.
    """
    n = df.select(value, order)
    end = lambda key, name: F.broadcast(n.orderBy(key).limit(7).agg(F.avg(value).alias(name)))
    made = n.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")).crossJoin(end(F.col(order), "first_avg")).crossJoin(end(F.col(order).desc(), "last_avg"))
    cv = F.try_divide("std", "mean")
    direction = F.when(F.col("last_avg") > F.col("first_avg"), "up").when(F.col("last_avg") < F.col("first_avg"), "down").otherwise("flat")
    return made.withColumn("cv", cv).withColumn("direction", direction).withColumn("volatility", F.when(cv > 0.3, "high").when(cv > 0.1, "medium").otherwise("low"))


def time_spine(spark, start: str, end: str, holidays: Mapping[str, str] | None = None) -> DataFrame:
    """A calendar: labels, bounds, weekend and holiday flags, season, fiscal year from April, the same day before, ordinals."""
    d = F.col("date_day")
    fixed = holidays or {"01-01": "New Year", "07-04": "Independence Day", "12-25": "Christmas"}
    md = F.date_format(d, "MM-dd")
    holiday = F.lit(None).cast("string")
    for k, v in fixed.items():
        holiday = F.when(md == k, v).otherwise(holiday)
    fiscal = F.year(d) + F.when(F.month(d) >= 4, 1).otherwise(0)
    month_days = W.partitionBy("month_start").orderBy("date_day")
    base = date_spine(spark, start, end, "day", include_end=True).select(
        "date_day", F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"), F.day(d).alias("day"), (F.dayofweek(d) - 1).alias("day_of_week"), F.dayofyear(d).alias("day_of_year"),
        F.date_format(d, "yyyy-MM-dd").alias("iso_date"), F.date_format(d, "yyyy-'Q'q").alias("quarter_label"), F.date_format(d, "EEEE").alias("day_name"), F.date_format(d, "MMMM").alias("month_name"),
        F.dayofweek(d).isin(1, 7).alias("is_weekend"), holiday.isNotNull().alias("is_holiday"), holiday.alias("holiday_name"),
        F.trunc(d, "month").alias("month_start"), F.last_day(d).alias("month_end"), F.trunc(d, "quarter").alias("quarter_start"), F.last_day(F.add_months(F.trunc(d, "quarter"), 2)).alias("quarter_end"), F.trunc(d, "year").alias("year_start"),
        F.when(F.month(d).isin(12, 1, 2), "winter").when(F.month(d).isin(3, 4, 5), "spring").when(F.month(d).isin(6, 7, 8), "summer").otherwise("autumn").alias("season"), F.month(d).isin(11, 12).alias("is_retail_season"),
        fiscal.alias("fiscal_year"), (F.expr("(month(date_day) + 8) % 12 div 3") + 1).cast("int").alias("fiscal_quarter"), F.date_sub(d, 7).alias("prior_week"), F.add_months(d, -1).alias("prior_month"), F.add_months(d, -12).alias("prior_year"),
    )
    ordinal = F.row_number().over(month_days)
    business = F.sum(F.when(~F.col("is_weekend"), 1).otherwise(0)).over(month_days.rowsBetween(W.unboundedPreceding, W.currentRow))
    # day_ordinal counts all days and only hides weekends; business_day counts working days
    return base.withColumn("day_ordinal", F.when(~F.col("is_weekend"), ordinal)).withColumn("business_day", F.when(~F.col("is_weekend"), business))


@dataclass(frozen=True)
class Policy:
    """What a role may see: a filter by model and columns, by pattern, that are masked for it."""

    role: str
    row_filters: Mapping[str, str] = field(default_factory=dict)
    masks: Mapping[str, Callable[[Column], Column]] = field(default_factory=dict)

    def apply(self, model: str, df: DataFrame) -> DataFrame:
        if model in self.row_filters:
            df = df.filter(self.row_filters[model])
        hits = {c: f for c in df.columns for p, f in self.masks.items() if re.fullmatch(p, c)}
        return df.withColumns({c: f(F.col(c)) for c, f in hits.items()}) if hits else df


def governance_lint(registry: Registry, max_tier_hours: Mapping[int, int] | None = None) -> list[str]:
    """Metrics of tier 1 without an owner or a label, and tiers without a service level."""
    hours = max_tier_hours or {1: 4, 2: 24, 3: 72}
    out = [f"{m.name}: tier 1 needs an owner" for m in registry.metrics.values() if m.tier == 1 and not m.owner]
    return out + [f"{m.name}: unknown tier {m.tier}" for m in registry.metrics.values() if m.tier not in hours]


def lookml(model: SemanticModel) -> str:
    """A view of a BI tool: dimensions and measures as text."""
    kinds = {"sum": "sum", "count": "count", "count_distinct": "count_distinct", "average": "average", "min": "min", "max": "max"}
    lines = [f"view: {model.name} {{"]
    lines += [f"  dimension: {d.name} {{ type: {'date' if d.kind == 'time' else 'string'} sql: {d.expr or d.name} ;; }}" for d in model.dimensions]
    lines += [f"  measure: {m.name} {{ type: {kinds[m.agg]} sql: {m.expr} ;; }}" for m in model.measures]
    return "\n".join([*lines, "}"])
