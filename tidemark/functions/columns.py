"""Scalar functions over columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# numbers


def safe_divide(a: Column | str, b: Column | str, default: float | None = None) -> Column:
    """a / b, or default where b is zero or either is null."""
    ratio = F.try_divide(col(a), col(b))
    return ratio if default is None else F.coalesce(ratio, F.lit(default))


def cents_to_dollars(c: Column | str, scale: int = 2) -> Column:
    return (col(c) / 100).cast(f"decimal(16,{scale})")


def normalize(c: Column | str, low: Column | float, high: Column | float) -> Column:
    """Where c lies between low and high, 0 to 1; null if they are equal."""
    return F.try_divide(col(c) - low, (F.lit(high) if not isinstance(high, Column) else high) - low)


def standardize(c: Column | str, mean: Column | float, std: Column | float) -> Column:
    return F.try_divide(col(c) - mean, F.lit(std) if not isinstance(std, Column) else std)


def log_transform(c: Column | str, base: float | None = None) -> Column:
    return F.when(col(c) > 0, F.ln(col(c)) if base is None else F.log(float(base), col(c)))


def scale(c: Column | str, factor: float) -> Column:
    return col(c) * factor


def cap(c: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(low)), F.lit(high))


def to_precision(c: Column | str, places: int) -> Column:
    return col(c).cast(f"decimal(18,{places})")


# text


def format_currency(c: Column | str, sign: str = "$") -> Column:
    return F.concat(F.lit(sign), F.round(col(c), 2).cast("decimal(18,2)").cast("string"))


def format_percentage(c: Column | str, places: int = 1) -> Column:
    return F.concat(F.round(col(c) * 100, places).cast(f"decimal(18,{places})").cast("string"), F.lit("%"))


def tidy(c: Column | str, default: str | None = None) -> Column:
    """Trimmed and in lower case; empty gives default."""
    done = F.nullif(F.lower(F.trim(col(c))), F.lit(""))
    return done if default is None else F.coalesce(done, F.lit(default))


def snake_case(name: str) -> str:
    return re.sub(r"[^0-9a-z]+", "_", re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()).strip("_")


def pascal_case(name: str) -> str:
    return "".join(w.capitalize() for w in re.split(r"[^0-9A-Za-z]+", name) if w)


def clean_column_name(name: str, most: int = 63) -> str:
    done = snake_case(name)
    return (f"_{done}" if done[:1].isdigit() else done)[:most]


def email_domain(c: Column | str) -> Column:
    return F.lower(F.element_at(F.split(col(c), "@"), -1))


def digits_only(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "[^0-9]", "")


# keys and hashes


def surrogate_key(*columns: Column | str) -> Column:
    """MD5 of the columns as text, null as empty, a bar between them."""
    return F.md5(F.concat_ws("|", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in columns]).cast("binary"))


def content_hash(*columns: Column | str) -> Column:
    return F.md5(F.concat_ws("||", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in columns]).cast("binary"))


def fingerprint(*cols: Column | str) -> Column:
    """60 bits of a row's MD5 as a long that other engines compute alike; nulls count as empty, '|' stands between columns."""
    text = F.concat_ws("|", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def bucket(c: Column | str, n: int) -> Column:
    """A stable shard number from 0 to n - 1."""
    return fingerprint(c) % F.lit(n)


# dates


def epoch_diff(later: Column | str, earlier: Column | str, unit: str = "second") -> Column:
    """later - earlier as a fraction of unit."""
    size = {"second": 1e6, "minute": 6e7, "hour": 3.6e9, "day": 8.64e10}[unit]
    return (F.unix_micros(col(later).cast("timestamp")) - F.unix_micros(col(earlier).cast("timestamp"))) / F.lit(size)


def day_of_week(c: Column | str) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(col(c)) - 1


def is_weekend(c: Column | str) -> Column:
    return F.dayofweek(col(c)).isin(1, 7)


def month_start(c: Column | str) -> Column:
    return F.trunc(col(c), "month")


def month_end(c: Column | str) -> Column:
    return F.last_day(col(c))


def quarter_start(c: Column | str) -> Column:
    return F.trunc(col(c), "quarter")


def quarter_end(c: Column | str) -> Column:
    return F.last_day(F.add_months(F.trunc(col(c), "quarter"), 2))


def quarter_label(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-'Q'q")


def iso_week_label(c: Column | str) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), col(c)).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(col(c)).cast("string"), 2, "0"))


def months_between_starts(later: Column | str, earlier: Column | str) -> Column:
    """How many month boundaries lie between two dates."""
    return (F.year(col(later)) * 12 + F.month(col(later)) - F.year(col(earlier)) * 12 - F.month(col(earlier))).cast("long")


def to_utc(ts: Column | str, zone: Column | str) -> Column:
    """A wall-clock time in a zone as wall-clock time in UTC."""
    z = zone if isinstance(zone, Column) else F.lit(zone)
    return F.convert_timezone(z, F.lit("UTC"), col(ts))


def between_dates(c: Column | str, start: str | None = None, end: str | None = None) -> Column:
    """start <= c < end, either left out if None."""
    tests = ([col(c) >= F.lit(start).cast("timestamp_ntz")] if start else []) + ([col(c) < F.lit(end).cast("timestamp_ntz")] if end else [])
    return reduce(lambda a, b: a & b, tests, F.lit(True))


# flags and checks


def to_boolean(c: Column | str) -> Column:
    """True for true, t, yes, y, 1; false for the opposites; else null."""
    v = F.lower(F.trim(col(c).cast("string")))
    return F.when(v.isin("true", "t", "yes", "y", "1"), True).when(v.isin("false", "f", "no", "n", "0"), False)


#: Fixed by the inventory: what counts as an address, and the domains that are refused.
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
BLOCKED_DOMAINS = ("tempmail.com", "10minutemail.com", "guerrillamail.com")
PHONE = r"^\+?[0-9][0-9 ()-]{6,}$"
URL = r"^https?://[^\s/$.?#].[^\s]*$"


def is_email(c: Column | str) -> Column:
    return col(c).rlike(EMAIL)


def is_phone(c: Column | str) -> Column:
    return col(c).rlike(PHONE)


def is_url(c: Column | str) -> Column:
    return col(c).rlike(URL)


def is_positive(c: Column | str) -> Column:
    return col(c) > 0


def email_status(c: Column | str) -> Column:
    v = col(c)
    return F.when(v.isNull(), "missing").when(~v.like("%@%"), "invalid_format").when(v.like("%@%@%"), "multiple_at").when(~v.rlike(EMAIL), "invalid_format").otherwise("valid")


def validated(checks: Sequence[tuple[str, Column]], passed: str = "valid") -> Column:
    """The name of the first check that fails (false or null), or passed."""
    return reduce(lambda rest, check: F.when(~F.coalesce(check[1], F.lit(False)), check[0]).otherwise(rest), reversed(checks), F.lit(passed))


def ladder(c: Column | str, steps: Sequence[tuple[float, object]], default: object, at_least: bool = True) -> Column:
    """The value of the first step whose bound c reaches (or, at_least=False, doesn't exceed)."""
    v = col(c)
    out = F.lit(default)
    for bound, value in reversed(steps):
        out = F.when(v >= bound if at_least else v <= bound, value).otherwise(out)
    return out


def changed(a: Column | str, b: Column | str, null_safe: bool = True) -> Column:
    """Whether two values differ; without null_safe a null on either side gives null, as != does."""
    return ~col(a).eqNullSafe(col(b)) if null_safe else col(a) != col(b)


# masking


def mask_email(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"^(.).*@(.*)$", r"$1***@$2")


def hash_pii(c: Column | str, salt: str = "") -> Column:
    return F.sha2(F.concat(F.lit(salt), col(c).cast("string")).cast("binary"), 256)


def anonymize_name(c: Column | str) -> Column:
    return F.when(col(c).isNotNull(), F.concat(F.lit("user_"), F.substring(F.md5(col(c).cast("binary")), 1, 8)))


def masked(c: Column | str, allowed: bool, mask: Callable[[Column | str], Column]) -> Column:
    return col(c) if allowed else mask(c)


# json and arrays


def json_get(c: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_cast(F.get_json_object(col(c), path), kind) if hasattr(F, "try_cast") else F.get_json_object(col(c), path).try_cast(kind)


def json_set(c: Column | str, schema: str, field: str, value: Column) -> Column:
    """A JSON object with one field replaced, by way of a struct."""
    return F.to_json(F.from_json(col(c), schema).withField(field, value))


def named_list(*pairs: tuple[str, Column]) -> Column:
    """The names whose condition holds, in order, joined by a comma."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, n) for n, c in pairs])), ",")


# columns in numbers


def apply_to(df: DataFrame, names: Iterable[str], f: Callable[[Column], Column], suffix: str = "") -> DataFrame:
    return df.withColumns({f"{n}{suffix}": f(F.col(n)) for n in names})


def names_where(df: DataFrame, test: Callable[[str, str], bool]) -> list[str]:
    """The columns whose (name, type) passes."""
    return [n for n, t in df.dtypes if test(n, t)]


def reduce_columns(names: Sequence[str], how: str) -> Column:
    cs = [F.col(n) for n in names]
    if how == "sum":
        return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in cs])
    if how == "avg":
        return reduce_columns(names, "sum") / len(cs)
    if how == "concat":
        return F.concat_ws("", *[c.cast("string") for c in cs])
    return {"max": F.greatest, "min": F.least, "coalesce": F.coalesce}[how](*cs)


def compose(*fs: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """The first function is applied first."""
    return lambda c: reduce(lambda v, f: f(v), fs, c)


def bind(c: Column, *steps: Callable[[Column], Column]) -> Column:
    """Steps in turn; once null, always null."""
    return reduce(lambda v, f: F.when(v.isNotNull(), f(v)), steps, c)


def conditions(tests: Sequence[tuple[str, str, object]], logic: str = "and") -> Column:
    """(column, operator, value) tests joined by and / or."""
    ops: dict[str, Callable[[Column, object], Column]] = {
        "=": lambda c, v: c == v, "!=": lambda c, v: c != v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v,
        "in": lambda c, v: c.isin(*v), "not in": lambda c, v: ~c.isin(*v), "like": lambda c, v: c.like(v), "is null": lambda c, _: c.isNull(), "is not null": lambda c, _: c.isNotNull(),
    }
    made = [ops[o](F.col(c), v) for c, o, v in tests]
    return reduce((lambda a, b: a & b) if logic == "and" else (lambda a, b: a | b), made)
