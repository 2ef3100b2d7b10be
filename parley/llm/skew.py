"""Joins of rows with a table of one row for each key, where a few keys may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this part of all rows is handed out; so fewer keys than this number are.
PARTS = 1000


def join_by_weight(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``rows`` with the columns of ``table`` (one row for each key, nulls are a key), for the keys it holds.

    ``weight`` counts the rows of each key.  Keys with over a PARTS-th of all weights, fewer than PARTS of them,
    are broadcast, and their rows are not shuffled; so no task gets more than that part of the rows by one key.
    Both inputs are read several times: give tables, not plans.
    """
    total = table.agg(F.sum(weight).alias("n")).first()["n"] or 0
    heavy = F.col(weight) * PARTS > F.lit(total)
    few = F.broadcast(table.where(heavy).select(*[F.col(k).alias(f"{k}__of") for k in keys], *[c for c in table.columns if c not in (*keys, weight)]))
    many = table.where(~heavy).select(*[F.col(k).alias(f"{k}__of") for k in keys], *[c for c in table.columns if c not in (*keys, weight)])

    def same(a: DataFrame, b: DataFrame):
        out = F.lit(True)
        for k in keys:
            out = out & a[k].eqNullSafe(b[f"{k}__of"])
        return out

    own = [f"{k}__of" for k in keys]
    near = rows.join(few, same(rows, few), "inner").drop(*own)
    rest = rows.join(few, same(rows, few), "left_anti")
    return near.unionByName(rest.join(many, same(rest, many), "inner").drop(*own))
