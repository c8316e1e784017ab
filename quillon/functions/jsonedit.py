"""JSON functions that build new documents, in Arrow batches.

Documents are JSON text with sorted keys; numbers keep their digits.
"""

from __future__ import annotations

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, functions as F


def _parse(text: str):
    return json.loads(text, parse_float=Decimal)


def _write(value) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_write(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_write, value)) + "]"
    return str(value) if isinstance(value, Decimal) else json.dumps(value, ensure_ascii=False)


def _steps(path: str) -> list[str]:
    return [p for p in path.removeprefix("$").split(".") if p]


def _put(doc, steps: list[str], value):
    if not steps:
        return value
    key, rest = steps[0], steps[1:]
    if isinstance(doc, list):
        i = int(key) if key.isdigit() else -1
        if not 0 <= i < len(doc):
            raise ValueError("JSON_SET: the index must exist")
        return [*doc[:i], _put(doc[i], rest, value), *doc[i + 1 :]]
    if doc is None or isinstance(doc, dict):
        doc = dict(doc or {})
        doc[key] = _put(doc.get(key), rest, value)
        return doc
    raise ValueError("JSON_SET: the path leads through a scalar")


def _drop(doc, steps: list[str]):
    key, rest = steps[0], steps[1:]
    if isinstance(doc, list) and key.isdigit() and int(key) < len(doc):
        i = int(key)
        return [*doc[:i], *([_drop(doc[i], rest)] if rest else []), *doc[i + 1 :]]
    if isinstance(doc, dict) and key in doc:
        out = dict(doc)
        if rest:
            out[key] = _drop(doc[key], rest)
        else:
            del out[key]
        return out
    return doc


def _holds(doc, target) -> bool:
    if isinstance(target, dict):
        return isinstance(doc, dict) and all(k in doc and _holds(doc[k], v) for k, v in target.items())
    if isinstance(target, list):
        return isinstance(doc, list) and all(any(_holds(d, x) for d in doc) for x in target)
    if isinstance(doc, bool) or isinstance(target, bool):
        return doc is target
    if isinstance(doc, int | Decimal) and isinstance(target, int | Decimal):
        return doc == target
    return type(doc) is type(target) and doc == target


def json_set(doc: Column, path: str, value: Column) -> Column:
    """The document with a JSON value at a path; missing object keys are made."""
    steps = _steps(path)

    @F.pandas_udf("string")
    def run(d: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else _write(_put(_parse(a), steps, _parse(b))) for a, b in zip(d, v, strict=True)], dtype=object)

    return run(doc, value)


def json_remove(doc: Column, path: str) -> Column:
    """The document without what is at a path; nothing there changes nothing."""
    steps = _steps(path)
    if not steps:
        raise ValueError("JSON_REMOVE: the path is empty")

    @F.pandas_udf("string")
    def run(d: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else _write(_drop(_parse(a), steps)) for a in d], dtype=object)

    return run(doc)


def json_contains(doc: Column, target: Column) -> Column:
    """Whether the target is a part: objects by key, arrays by any element."""

    @F.pandas_udf("boolean")
    def run(d: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else _holds(_parse(a), _parse(b)) for a, b in zip(d, t, strict=True)], dtype=object)

    return run(doc, target)


def sql_function(name: str):
    """JSON_SET, JSON_REMOVE or JSON_CONTAINS over columns of text; JSON_SET's value stands under ``v``."""

    def apply(doc: str, *args: str):
        if name == "JSON_SET":
            return _write(_put(_parse(doc), _steps(args[0]), _parse(args[1]).get("v")))
        if name == "JSON_REMOVE":
            if not _steps(args[0]):
                raise ValueError("JSON_REMOVE: the path is empty")
            return _write(_drop(_parse(doc), _steps(args[0])))
        return _holds(_parse(doc), _parse(args[0]))

    @F.pandas_udf("boolean" if name == "JSON_CONTAINS" else "string")
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(x is None for x in row) else apply(*row) for row in zip(*columns, strict=True)], dtype=object)

    return run
