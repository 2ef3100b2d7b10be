"""Distributed connected components by alternating large-star and small-star steps.

Each step is one grouped minimum and one equi-join.  The minima are written before the join, so both
join sides are plain exchanges and adaptive execution can split a key with many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.store import discard, materialise


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges: columns u, v. Moves every edge towards the smallest neighbour."""
    if small:
        directed = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        directed = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialise(directed.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star")
    joined = directed.join(least, "u")
    moved = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if small:
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    else:
        moved = joined.where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(
            F.col("v").alias("u"), F.col("m").alias("v")
        )
    out = materialise(moved.where("u <> v").distinct(), "edges")
    discard(least)
    return out


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
    return tuple(row)


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (node, component) for each node with a link; component is its smallest reachable node.

    Null ends and self links are ignored; repeated links count once; an empty input gives no rows.
    """
    links = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = materialise(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    before = _mark(edges)
    while before[0]:
        large = _star(edges, small=False)
        after_small = _star(large, small=True)
        discard(large)
        discard(edges)
        edges, now = after_small, _mark(after_small)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
