"""Strict scalar functions as Column expressions.

They differ from Spark's where the dialect does: nulls propagate through
GREATEST and LEAST, positions below one are errors, trimming is by Unicode
white space, decimal division truncates, calendar arithmetic has two rules.
Everything stays inside code generation; nothing here is a Python UDF.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

UNITS = ("year", "month", "day", "hour", "minute", "second")


def asc(c: Column | str) -> Column:
    """Ascending order with nulls last, the dialect's default."""
    return (F.col(c) if isinstance(c, str) else c).asc_nulls_last()


def desc(c: Column | str) -> Column:
    """Descending order with nulls first, the dialect's default."""
    return (F.col(c) if isinstance(c, str) else c).desc_nulls_first()


def _fail(condition: Column, message: str, value: Column) -> Column:
    return F.when(condition, F.raise_error(F.lit(message))).otherwise(value)


# strings


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def ltrim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+", "")


def rtrim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def substring(c: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """One-based; a start below one or a negative length is an error."""
    start = F.lit(start) if isinstance(start, int) else start
    if length is None:
        out, bad = F.substr(c, start), start < 1
    else:
        length = F.lit(length) if isinstance(length, int) else length
        out, bad = F.substr(c, start, length), (start < 1) | (length < 0)
    return _fail(bad, "SUBSTRING: start must be at least 1 and length not negative", out)


def replace(c: Column, old: Column, new: Column) -> Column:
    """All occurrences; an empty ``old`` matches before each character and at the end."""
    between = F.concat(new, F.array_join(F.transform(F.split(c, ""), lambda x: F.concat(x, new)), ""))
    spread = F.when(F.char_length(c) == 0, new).otherwise(between)
    return F.when(old == "", spread).otherwise(F.replace(c, old, new))


def like(c: Column, pattern: str, escape: str | None = None) -> Column:
    """LIKE without a default escape character; an escape may only precede %, _ or itself."""
    if escape is not None:
        at = 0
        while at < len(pattern):
            if pattern[at] == escape:
                if at + 1 == len(pattern) or pattern[at + 1] not in ("%", "_", escape):
                    raise ValueError("LIKE: the escape must precede %, _ or itself")
                at += 1
            at += 1
        return F.like(c, F.lit(pattern), F.lit(escape))
    unused = next(ch for ch in map(chr, range(1, 32)) if ch not in pattern)
    return F.like(c, F.lit(pattern), F.lit(unused))


# conditionals


def _any_null(cols: tuple[Column, ...]) -> Column:
    return reduce(lambda a, b: a | b, (c.isNull() for c in cols))


def greatest(*cols: Column) -> Column:
    return F.when(~_any_null(cols), F.greatest(*cols))


def least(*cols: Column) -> Column:
    return F.when(~_any_null(cols), F.least(*cols))


def nullif(a: Column, b: Column) -> Column:
    return F.when((a.isNull() | b.isNull()) | (a != b), a)


def between(v: Column, low: Column, high: Column) -> Column:
    """Null if any operand is null."""
    return F.when(~_any_null((v, low, high)), (v >= low) & (v <= high))


# exact and floating numbers


def exact(c: Column, scale: int = 2, precision: int = 38) -> Column:
    return c.cast(f"decimal({precision},{scale})")


def cents(c: Column) -> Column:
    """A float that holds hundredths as a whole number of them."""
    return F.rint(c * 100).cast("long")


def whole_sum(c: Column) -> Column:
    """Exact sum of whole numbers as decimal(38,0), by two sums of longs.

    High and low bits are summed apart, so neither overflows before some
    10**12 rows, and no row makes a wide decimal.
    """
    high, low = F.sum(F.shiftright(c, 20)), F.sum(c.bitwiseAND(F.lit((1 << 20) - 1)))
    return (high.cast("decimal(19,0)") * F.lit(1 << 20).cast("decimal(7,0)") + low.cast("decimal(19,0)")).cast("decimal(38,0)")


def divide(a: Column, b: Column, scale_a: int, scale_b: int) -> Column:
    """Decimal quotient truncated to ``scale_a + 6 - scale_b`` digits."""
    whole = lambda c, s: (c.cast(f"decimal(38,{s})") * F.lit(10**s).cast("decimal(20,0)")).cast("decimal(38,0)")
    return _truncated(whole(a, scale_a), whole(b, scale_b), max(scale_a + 6 - scale_b, 0))


def _truncated(a: Column, y: Column, scale: int) -> Column:
    """A million times ``a`` over ``y``, both whole, cut to a whole number and shifted by ``scale`` digits."""
    x = (a * F.lit(10**6).cast("decimal(7,0)")).cast("decimal(38,0)")
    quotient = ((x - x % y) / y).cast(f"decimal({36 - scale},0)")
    unit = F.lit(f"1e-{scale}").cast(f"decimal({scale + 1},{scale})")  # widths that Spark multiplies exactly
    return _fail(y == 0, "division by zero", (quotient * unit).cast(f"decimal(38,{scale})"))


def float_divide(a: Column, b: Column) -> Column:
    """IEEE quotient: no error at zero."""
    a, b = a.cast("double"), b.cast("double")
    zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, F.when(a.isNotNull(), zero)).otherwise(a / b)


def average(c: Column, scale: int = 2) -> Column:
    """Exact sum over count of floats that hold ``scale`` digits, truncated to ``scale + 6`` digits (an aggregate)."""
    total = whole_sum(F.rint(c * 10**scale).cast("long"))
    return _truncated(total.cast("decimal(31,0)"), F.count(c).cast("decimal(20,0)"), scale + 6)


def sqrt(c: Column) -> Column:
    return _fail(c < 0, "SQRT of a negative number", F.sqrt(c.cast("double")).cast("decimal(38,8)"))


def power(a: Column, b: Column) -> Column:
    value = F.pow(a.cast("double"), b.cast("double"))
    return _fail(F.isnan(value) | (F.abs(value) == float("inf")), "POWER is not finite", value.cast("decimal(38,8)"))


def mod(a: Column, b: Column) -> Column:
    return _fail(b == 0, "MOD by zero", a % b)


# dates and times


def _unit(unit: str) -> str:
    unit = unit.lower()
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit}")
    return unit


def extract(unit: str, ts: Column) -> Column:
    unit = _unit(unit)
    return {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}[unit](ts).cast("long")


def date_trunc(unit: str, ts: Column) -> Column:
    return F.date_trunc(_unit(unit), ts)


def date_add(ts: Column, n: Column | int, unit: str) -> Column:
    """Calendar units overflow: 31 January and one month is 2 or 3 March."""
    unit = _unit(unit)
    n = F.lit(n) if isinstance(n, int) else n
    if unit in ("year", "month"):
        months = n * 12 if unit == "year" else n
        first = F.add_months(F.trunc(ts, "month"), months.cast("int"))
        day = F.date_add(first, F.dayofmonth(ts) - 1)
        return day.cast("timestamp") + (ts - F.date_trunc("day", ts))
    return ts + n * F.expr(f"INTERVAL '1' {unit}")


def add_interval(ts: Column, months: int = 0, days: int = 0, micros: int = 0) -> Column:
    """Months are clamped to the end of the month, then days, then time."""
    return ts + F.make_interval(months=F.lit(months), days=F.lit(days), secs=F.lit(micros).cast("decimal(18,6)") / 1000000)


def date_diff(a: Column, b: Column, unit: str) -> Column:
    """``a - b``: boundaries crossed for years and months, whole elapsed units below."""
    unit = _unit(unit)
    if unit == "year":
        return (F.year(a) - F.year(b)).cast("long")
    if unit == "month":
        return ((F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)).cast("long")
    micros = F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))
    size = {"day": 86_400_000_000, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000}[unit]
    return ((micros - micros % size) / size).cast("long")


# collections


def element_at(c: Column, i: Column | int) -> Column:
    """One-based; null outside, at zero and below."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.when(i >= 1, F.get(c, i - 1))


def array_contains(c: Column, v: Column) -> Column:
    """Never null for an array; null is found by null."""
    return F.when(c.isNotNull(), F.exists(c, lambda x: x.eqNullSafe(v)))


def map_keys(c: Column) -> Column:
    return F.array_sort(F.map_keys(c))


def map_values(c: Column) -> Column:
    return F.transform(F.array_sort(F.map_entries(c)), lambda e: e["value"])


def map_equal(a: Column, b: Column) -> Column:
    return F.array_sort(F.map_entries(a)) == F.array_sort(F.map_entries(b))


def array_agg(value: Column, *order: Column) -> Column:
    """Keeps nulls; ordered by the columns ``order``; null for no rows (an aggregate)."""
    rows = F.array_sort(F.collect_list(F.struct(*(o.alias(f"k{i}") for i, o in enumerate(order)), value.alias("v"))))
    return F.when(F.count(F.lit(1)) > 0, F.transform(rows, lambda r: r["v"]))


def map_agg(key: Column, value: Column) -> Column:
    """Null and repeated keys are errors; keys in order; null for no rows (an aggregate)."""
    entries = F.array_sort(F.collect_list(F.struct(_fail(key.isNull(), "MAP_AGG: null key", key).alias("key"), value.alias("value"))))
    return F.when(F.count(F.lit(1)) > 0, F.map_from_entries(entries))


# JSON, read side (text columns; parse once with ``json``)


def json(c: Column) -> Column:
    return F.parse_json(c)


def _path(path: str) -> str:
    parts = path.removeprefix("$").strip(".").split(".")
    return "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in parts if p)


def json_get(v: Column, path: str, kind: str = "string") -> Column:
    """Value at ``a.b.0`` or ``$.a.b.0``; null if it is missing."""
    return F.try_variant_get(v, _path(path), kind)


def json_type(v: Column, path: str = "$") -> Column:
    at = F.try_variant_get(v, _path(path), "variant")
    kind = F.schema_of_variant(at)
    name = (
        F.when(F.is_variant_null(at), "null").when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean")
    )
    return F.when(at.isNotNull(), name.otherwise("number"))


def json_array_length(v: Column, path: str = "$") -> Column:
    """Missing and JSON null give null; anything but an array is an error."""
    at = F.try_variant_get(v, _path(path), "variant")
    kind = json_type(v, path)
    size = F.size(F.try_variant_get(v, _path(path), "array<variant>")).cast("long")
    return F.when(at.isNull() | (kind == "null"), None).when(kind != "array", F.raise_error(F.lit("JSON_ARRAY_LENGTH: not an array"))).otherwise(size)
