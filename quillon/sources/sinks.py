"""Results as text: table, expanded, JSON lines or CSV, row by row."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame

FORMATS = ("table", "expanded", "json", "csv")


def _text(value) -> str:
    return "NULL" if value is None else value.hex() if isinstance(value, bytes | bytearray) else str(value)


def _line(cells: list[str]) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(cells)
    return out.getvalue()


def lines(rows: DataFrame, form: str = "table") -> Iterator[str]:
    """Lines of a result; one partition at a time is on the driver.

    ``table`` has columns as wide as in its first hundred rows.
    """
    if form not in FORMATS:
        raise ValueError(f"unknown format {form}")
    names, stream = rows.columns, rows.toLocalIterator(prefetchPartitions=True)
    if form == "csv":
        yield _line(names)
        yield from (_line(["" if v is None else _text(v) for v in r]) for r in stream)
    elif form == "json":
        yield from (json.dumps(r.asDict(recursive=True), default=_text, ensure_ascii=False) for r in stream)
    elif form == "expanded":
        wide = max(map(len, names), default=0)
        for n, r in enumerate(stream, 1):
            yield f"-- {n}"
            yield from (f"{name:<{wide}} | {_text(v)}" for name, v in zip(names, r, strict=True))
    else:
        first = [[_text(v) for v in r] for _, r in zip(range(100), stream, strict=False)]
        width = [max([len(name), *(len(r[i]) for r in first)]) for i, name in enumerate(names)]
        show = lambda cells: " | ".join(f"{c:<{w}}" for c, w in zip(cells, width, strict=True)).rstrip()
        yield show(names)
        yield "-+-".join("-" * w for w in width)
        yield from map(show, first)
        yield from (show([_text(v) for v in r]) for r in stream)
