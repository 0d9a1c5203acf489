"""Data tests: each gives the failing rows; a runner counts and judges them."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import EMAIL
from tidemark.operators.relational import union_all


def unique(df: DataFrame, *columns: str) -> DataFrame:
    """Values, all set, that more than one row has, with their number of rows."""
    there = F.lit(True)
    for c in columns:
        there = there & F.col(c).isNotNull()
    return df.filter(there).groupBy(*columns).agg(F.count("*").alias("n_records")).filter("n_records > 1")


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*values))


def relationships(df: DataFrame, column: str, to: DataFrame, field: str) -> DataFrame:
    """Rows whose key, if set, the other table lacks."""
    return df.filter(F.col(column).isNotNull()).join(to.select(F.col(field).alias("_field")), F.col(column) == F.col("_field"), "left_anti")


def expression_is_true(df: DataFrame, expression: str) -> DataFrame:
    """Rows for which an expression is false; where it is null it doesn't fail."""
    return df.filter(~F.expr(expression))


def match_regex(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).rlike(pattern))


def email_format(df: DataFrame, column: str) -> DataFrame:
    return match_regex(df, column, EMAIL)


def not_null_proportion(df: DataFrame, column: str, at_least: float) -> DataFrame:
    """One row with the proportion if it is below at_least, else none."""
    found = df.agg(F.avg(F.when(F.col(column).isNotNull(), 1.0).otherwise(0.0)).alias("not_null_proportion"))
    return found.filter(F.col("not_null_proportion") < at_least)


def expression_in_one_pass(df: DataFrame, checks: Mapping[str, tuple[Column, str]]) -> DataFrame:
    """(check_name, severity, failures): how many rows hold each condition, all in one aggregation."""
    counted = df.agg(*[F.count_if(c).alias(f"c{i}") for i, (c, _) in enumerate(checks.values())])
    rows = F.array(*[F.struct(F.lit(n).alias("check_name"), F.lit(s).alias("severity"), F.col(f"c{i}").alias("failures")) for i, (n, (_, s)) in enumerate(checks.items())])
    return counted.select(F.inline(rows))


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, null_count, completeness) for each column, in one pass."""
    n = F.count("*").alias("n")
    counted = df.agg(n, *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n_{c}").alias("null_count"), F.round(1 - F.try_divide(F.col(f"n_{c}"), F.col("n")), 6).alias("completeness")) for c in columns])
    return counted.select(F.inline(rows))


@dataclass
class DataTest:
    """A named test of a model; failures above warn_if warn, above error_if fail, with severity warn never more than warn."""

    name: str
    model: str
    failures: Callable[[DataFrame], DataFrame]
    severity: str = "error"
    warn_if: int = 0
    error_if: int = 0
    store: bool = False
    limit: int | None = None


@dataclass
class Verdict:
    test: str
    model: str
    failures: int
    status: str


def judge(test: DataTest, df: DataFrame, store=None) -> Verdict:
    """Count a test's failing rows and judge; store, a storage.Store, keeps them under test_failures_<model>_<test>."""
    found = test.failures(df)
    if test.limit is not None:
        found = found.limit(test.limit)
    if test.store and store is not None:
        found = store.write(f"test_failures_{test.model}_{test.name}", found)
    n = found.count()
    status = "error" if n > test.error_if and test.severity == "error" else "warn" if n > test.warn_if else "pass"
    return Verdict(test.name, test.model, n, status)


@dataclass
class Rule:
    """A contracted column; check is an expression that must hold."""

    name: str
    type: str
    not_null: bool = False
    unique: bool = False
    primary_key: bool = False
    check: str | None = None
    max_length: int | None = None


class ContractError(ValueError):
    pass


def enforce_schema(df: DataFrame, contract: Sequence[Rule]) -> DataFrame:
    """df with its columns in contract order; missing, extra or differently typed columns are refused before any write."""
    have = {f.name: f.dataType for f in df.schema}
    want = {r.name: T._parse_datatype_string(r.type) for r in contract}
    problems = [f"missing {n}" for n in want if n not in have] + [f"extra {n}" for n in have if n not in want]
    problems += [f"{n} is {have[n].simpleString()}, not {t.simpleString()}" for n, t in want.items() if n in have and have[n] != t]
    if problems:
        raise ContractError("; ".join(problems))
    return df.select(*want)


def contract_tests(contract: Sequence[Rule]) -> list[tuple[str, Callable[[DataFrame], DataFrame]]]:
    """The constraints of a contract as data tests."""
    out: list[tuple[str, Callable[[DataFrame], DataFrame]]] = []
    keys = [r.name for r in contract if r.primary_key]
    if keys:
        out.append(("primary_key_unique", lambda d, k=tuple(keys): unique(d, *k)))
    for r in contract:
        if r.not_null or r.primary_key:
            out.append((f"{r.name}_not_null", lambda d, c=r.name: not_null(d, c)))
        if r.unique:
            out.append((f"{r.name}_unique", lambda d, c=r.name: unique(d, c)))
        if r.check:
            out.append((f"{r.name}_check", lambda d, e=r.check: expression_is_true(d, e)))
        if r.max_length is not None:
            out.append((f"{r.name}_length", lambda d, c=r.name, n=r.max_length: d.filter(F.length(c) > n)))
    return out


def constraints(contract: Sequence[Rule], table: str) -> list[tuple[str, str, str]]:
    """(table, column, constraint) of a contract, the inventory that an information schema would give."""
    out = []
    for r in contract:
        out += [(table, r.name, k) for k, on in (("primary_key", r.primary_key), ("not_null", r.not_null), ("unique", r.unique), ("check", bool(r.check))) if on]
    return out


def monitors(columns: Sequence[str], rules: Mapping[str, str]) -> list[tuple[str, str]]:
    """(column, check) by the first name pattern that fits."""
    return [(c, next(k for p, k in rules.items() if fnmatch.fnmatch(c, p))) for c in columns if any(fnmatch.fnmatch(c, p) for p in rules)]


def summary(*parts: tuple[str, DataFrame]) -> DataFrame:
    """(check_name, failures, status) of failing-row frames."""
    counted = [d.agg(F.count("*").alias("failures")).select(F.lit(n).alias("check_name"), "failures") for n, d in parts]
    return union_all(*counted).withColumn("status", F.when(F.col("failures") == 0, "PASS").otherwise("FAIL"))
