"""Relational operators that need more than one DataFrame call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

MAX_ROUNDS = 100


def recursive_union(base: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool, materialise: Callable[[DataFrame], DataFrame], rounds: int = MAX_ROUNDS) -> DataFrame:
    """WITH RECURSIVE: rows of ``base`` and of ``step`` on each round's new rows.

    ``distinct`` (UNION) keeps a row once over all rounds, so cycles end;
    without it (UNION ALL) a recursion of over ``rounds`` rounds is an error.
    ``materialise`` cuts the lineage of a round (it writes the round's rows).
    """
    new = materialise(base.distinct() if distinct else base)
    found = [new]
    for _ in range(rounds):
        nxt = step(new)
        if distinct:
            seen = found[0]
            for f in found[1:]:
                seen = seen.union(f)
            nxt = nxt.subtract(seen)
        new = materialise(nxt)
        if new.isEmpty():
            out = found[0]
            for f in found[1:]:
                out = out.union(f)
            return out
        found.append(new)
    raise RuntimeError("the recursion did not end")


def update(table: DataFrame, changes: dict[str, Column], where: Column | None = None) -> DataFrame:
    """UPDATE as a projection; all new values see the old row."""
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return table.select(*(F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in table.columns))


def delete(table: DataFrame, where: Column | None = None) -> DataFrame:
    """DELETE keeps the rows on which the predicate is false or null."""
    return table.limit(0) if where is None else table.filter(~F.coalesce(where, F.lit(False)))


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """INSERT: by column name; columns not given are null."""
    return table.unionByName(rows, allowMissingColumns=True).select(*table.columns)


def upsert(table: DataFrame, rows: DataFrame, key: list[str], changes: Callable[[Callable[[str], Column], Callable[[str], Column]], dict[str, Column]] | None = None) -> DataFrame:
    """UPSERT on a key: proposed rows replace or, with ``changes(old, excluded)``, change existing ones."""
    old = table.select(*(F.col(c).alias(f"o_{c}") for c in table.columns), F.lit(True).alias("o__"))
    new = rows.select(*(F.col(c).alias(f"n_{c}") for c in table.columns), F.lit(True).alias("n__"))
    on = [F.col(f"o_{k}") == F.col(f"n_{k}") for k in key]
    joined = old.join(new, on, "full")
    changed = changes(lambda c: F.col(f"o_{c}"), lambda c: F.col(f"n_{c}")) if changes else {c: F.col(f"n_{c}") for c in table.columns if c not in key}
    both = F.col("o__").isNotNull() & F.col("n__").isNotNull()
    return joined.select(
        *(
            F.when(both, changed.get(c, F.col(f"o_{c}"))).when(F.col("o__").isNotNull(), F.col(f"o_{c}")).otherwise(F.col(f"n_{c}")).alias(c)
            for c in table.columns
        )
    )


def rank_join(ranked: DataFrame, other: DataFrame, on: Column, how: str, order: list[Column], tie: list[Column]) -> DataFrame:
    """Join that keeps a ranked left side's order, unmatched right rows last."""
    return ranked.join(other, on, how).orderBy(*(o.asc_nulls_last() for o in order), *(t.asc_nulls_last() for t in tie))
