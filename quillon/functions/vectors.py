"""Vector functions on ``array<float>`` and sparse vectors, in float64."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

METRICS = ("cosine", "l2", "l1", "inner_product", "hamming")


def literal(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Similarity; zero if a norm is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))))


def l1(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)))


def hamming(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.when(x != y, 1.0).otherwise(0.0)))


def distance(metric: str, a: Column, b: Column) -> Column:
    """What NEAREST orders by: less is nearer."""
    if metric == "cosine":
        return 1 - cosine(a, b)
    if metric == "inner_product":
        return -dot(a, b)
    return {"l2": l2, "l1": l1, "hamming": hamming}[metric](a, b)


def dimensions(a: Column) -> Column:
    return F.size(a).cast("long")


def normalize(a: Column) -> Column:
    size = norm(a)
    return F.when(size == 0, F.raise_error(F.lit("NORMALIZE of a zero vector"))).otherwise(F.transform(a, lambda x: (x.cast("double") / size).cast("float")))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, s: Column | float) -> Column:
    factor = F.lit(float(s)) if isinstance(s, int | float) else s
    return F.transform(a, lambda x: (x.cast("double") * factor).cast("float"))


def quantised(a: Column, kind: str) -> Column:
    """What a VECTOR<F16> or VECTOR<I8> column keeps of a vector, widened again."""
    if kind == "F16":
        return _half(a)
    scale = F.greatest(F.array_max(F.transform(a, lambda x: F.abs(x.cast("double")))), F.lit(1e-38)) / 127
    step = F.get(F.transform(F.array(scale), lambda s: F.transform(a, lambda x: (F.rint(x.cast("double") / s) * s).cast("float"))), F.lit(0))
    return F.when(a.isNotNull(), step)


def _half(a: Column) -> Column:
    @F.pandas_udf("array<float>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda v: None if v is None else np.asarray(v, np.float32).astype(np.float16).astype(np.float32))

    return run(a)


def bits(a: Column) -> Column:
    """A BITVECTOR packed to bytes, the first element in the lowest bit."""
    set_ = lambda i, k: F.when(F.coalesce(F.get(a, i * 8 + k), F.lit(0.0)) != 0, F.pow(F.lit(2), k).cast("int")).otherwise(0)
    byte = lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda s, k: s + set_(i, k))
    count = F.ceil(F.size(a) / 8).cast("int")
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.lpad(F.hex(byte(i)), 2, "0")), ""))
