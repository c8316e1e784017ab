"""INTERVAL values: months, days and microseconds, kept apart.

A value is a struct, so it can be stored and returned. Comparison justifies:
a month counts as 30 days and a day as 24 hours. Everything here is Spark SQL
text for the dialect's compiler.
"""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import types as T

_MONTHS = {"year": 12, "month": 1}
_MICROS = {"hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "millisecond": 1000, "microsecond": 1}
#: Short names of units.
_ALIASES = {"yr": "year", "mon": "month", "hr": "hour", "min": "minute", "sec": "second"}
_TIMES = T.TimestampType | T.TimestampNTZType | T.DateType


def is_interval(kind: T.DataType | None) -> bool:
    return isinstance(kind, T.StructType) and kind.names == ["months", "days", "micros"]


def parts(text: str) -> tuple[int, int, int]:
    """months, days and microseconds of ``"<quantity> <unit> ..."``."""
    fields = text.split()
    if not fields or len(fields) % 2:
        raise ValueError("invalid interval")
    months = days = 0
    micros = Decimal(0)
    for quantity, unit in zip(fields[::2], fields[1::2], strict=True):
        unit = unit.lower().removesuffix("s")
        unit = _ALIASES.get(unit, unit)
        if unit in _MICROS:
            micros += Decimal(quantity) * _MICROS[unit]
        elif unit in _MONTHS or unit == "day":
            if not re.fullmatch(r"[+-]?\d+", quantity):
                raise ValueError("years, months and days are whole numbers")
            months += _MONTHS.get(unit, 0) * int(quantity)
            days += int(quantity) if unit == "day" else 0
        else:
            raise ValueError(f"unknown interval unit {unit}")
    if micros != int(micros):
        raise ValueError("an interval is a whole number of microseconds")
    return months, days, int(micros)


def build(months: str, days: str, micros: str) -> str:
    return f"named_struct('months', CAST({months} AS INT), 'days', CAST({days} AS INT), 'micros', CAST({micros} AS BIGINT))"


def literal(text: str) -> str:
    return build(*(f"{x}L" for x in parts(text)))


def negated(a: str) -> str:
    return f"(CASE WHEN {a} IS NOT NULL THEN {build(f'-({a}).months', f'-({a}).days', f'-({a}).micros')} END)"


def justified(a: str) -> str:
    """Microseconds under the 30-day month, as a decimal that holds any."""
    return f"((CAST(({a}).months AS DECIMAL(20,0)) * 30 + ({a}).days) * 86400000000 + ({a}).micros)"


def text(a: str) -> str:
    """Years, months, days, hours, minutes and seconds that are not zero; ``0`` if none is."""
    unit = lambda n, name: f"CASE WHEN {n} <> 0 THEN concat({n}, ' {name}', CASE WHEN abs({n}) = 1 THEN '' ELSE 's' END) END"
    whole = lambda x, y: f"CAST({x} div {y} AS BIGINT)"
    seconds = f"CAST((({a}).micros % 60000000) / CAST(1000000 AS DECIMAL(7,0)) AS DECIMAL(20,6))"
    shown = f"regexp_replace(CAST({seconds} AS STRING), '\\\\.?0+$', '')"
    last = f"CASE WHEN ({a}).micros % 60000000 <> 0 THEN concat({shown}, CASE WHEN abs({seconds}) = 1 THEN ' second' ELSE ' seconds' END) END"
    names = [
        unit(whole(f"({a}).months", 12), "year"), unit(f"(({a}).months % 12)", "month"), unit(f"({a}).days", "day"),
        unit(whole(f"({a}).micros", 3600000000), "hour"), unit(whole(f"(({a}).micros % 3600000000)", 60000000), "minute"), last,
    ]
    return f"(CASE WHEN {a} IS NOT NULL THEN coalesce(nullif(concat_ws(' ', {', '.join(names)}), ''), '0') END)"


def _native(a: str) -> str:
    return f"make_interval(0, ({a}).months, 0, ({a}).days, 0, 0, CAST(({a}).micros AS DECIMAL(20,0)) / 1000000)"


def operation(op: str, a: str, b: str, ka: T.DataType | None, kb: T.DataType | None) -> str | None:
    """SQL of an operation with an interval in or out; None if there is none."""
    if is_interval(ka) and is_interval(kb):
        if op in ("+", "-"):
            return f"(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {build(*(f'({a}).{f} {op} ({b}).{f}' for f in ('months', 'days', 'micros')))} END)"
        return f"({justified(a)} {op} {justified(b)})"
    if is_interval(kb) and isinstance(ka, _TIMES) and op in ("+", "-"):
        moved = f"CAST({a} AS TIMESTAMP_NTZ)" if isinstance(ka, T.DateType) else a
        return f"({moved} {op} {_native(b)})"
    if is_interval(ka) and isinstance(kb, _TIMES) and op == "+":
        return operation(op, b, a, kb, ka)
    if isinstance(ka, _TIMES) and type(ka) is type(kb) and op == "-":
        micros = f"unix_micros(CAST({{}} AS TIMESTAMP))"
        return f"(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {build('0', '0', f'{micros.format(a)} - {micros.format(b)}')} END)"
    return None
