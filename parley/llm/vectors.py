"""Near-duplicate embeddings: random-hyperplane tables, exact cosines, connected components.

Equal vectors collapse first.  Each table gives a vector a bucket of ``bits`` signs; bits grow with the
logarithm of the number of vectors, so buckets keep their size, and the number of tables follows from the
chance that a pair at the threshold meets in none (``miss``).  Within a bucket, blocks of vectors are
compared by matrix products in the task that holds them; a pair counts in the first table where it meets,
so counts add up, and a task returns sums and a spanning forest of links, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import textkit as tk
from parley.llm.components import connected_components
from parley.llm.store import discard, materialise, small_batches

BLOCK = 2048
LEAST_BITS = 8


def plan_tables(n: int, cosine: float, miss: float = 1e-5) -> tuple[int, int]:
    """(bits of a table, number of tables) for n vectors."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(n, 1) / 256)) if n > 256 else LEAST_BITS)
    met = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - met))


def _planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng(9_001).standard_normal((dim, bits * tables)).astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of unit length in double precision, however small or large they are."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _keys(unit: np.ndarray, planes: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(vectors, tables) bucket numbers."""
    out = np.zeros((len(unit), tables), dtype=np.int32)
    for at in range(0, len(unit), 1024):
        signs = (unit[at : at + 1024].astype(np.float32) @ planes > 0).reshape(-1, tables, bits)
        out[at : at + 1024] = signs @ (1 << np.arange(bits, dtype=np.int32))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _bucketed(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                # Vectors of other lengths meet only their like.
                lengths = np.asarray([len(v) for v in part.column(1)])
                for dim in np.unique(lengths):
                    own = part.filter(pa.array(lengths == dim))
                    keys = _keys(_unit(_matrix(own.column(1))), _planes(int(dim), bits, tables), bits, tables)
                    n = own.num_rows
                    row = pa.array(np.repeat(np.arange(n), tables))
                    table = np.tile(np.arange(tables), n)
                    bucket = ((int(dim) * tables + table).astype(np.int64) << 32) | keys.reshape(-1).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket), *(own.column(c).take(row) for c in (0, 1, 2))],
                        names=["bucket", "vec_id", "embedding", "copies"],
                    )

    return run


class _Sums:
    """What a task has found: links of each vector, and links that span what it has joined."""

    def __init__(self, cosine: float, bits: int, tables: int):
        self._cosine, self._bits, self._tables = cosine, bits, tables
        self._planes: dict[int, np.ndarray] = {}

    def compare(self, bucket: int, a: tuple, b: tuple | None) -> tuple[list, list]:
        """a, b: (ids, vectors, copies) of two blocks, or one with itself."""
        dim = a[1].shape[1]
        if dim not in self._planes:
            self._planes[dim] = _planes(dim, self._bits, self._tables)
        table = (bucket >> 32) - dim * self._tables
        left, right = a, a if b is None else b
        x = _unit(left[1])
        y = x if b is None else _unit(right[1])
        i, j = np.nonzero(x @ y.T >= self._cosine)
        keep = i < j if b is None else np.ones(len(i), dtype=bool)
        i, j = i[keep], j[keep]
        if not len(i):
            return [], []
        near = (left[0], right[0])
        kx = _keys(x, self._planes[dim], self._bits, self._tables)
        ky = kx if b is None else _keys(y, self._planes[dim], self._bits, self._tables)
        fresh = np.ones(len(i), dtype=bool)
        for at in range(0, len(i), 1 << 16):
            s = slice(at, at + (1 << 16))
            fresh[s] = ~(kx[i[s], :table] == ky[j[s], :table]).any(axis=1)
        i, j = i[fresh], j[fresh]
        counts = []
        for own, other, ids, copies in ((i, j, near[0], right[2]), (j, i, near[1], left[2])):
            sums = np.bincount(own, weights=copies[other], minlength=len(ids)).astype(np.int64)
            counts += [(int(ids[n]), int(sums[n])) for n in np.flatnonzero(sums)]
        return counts, self._forest(near[0][i], near[1][j])

    @staticmethod
    def _forest(a: np.ndarray, b: np.ndarray) -> list:
        up: dict[int, int] = {}

        def top(v: int) -> int:
            while up.get(v, v) != v:
                up[v] = up.get(up[v], up[v])
                v = up[v]
            return v

        links = []
        for p, q in zip(a.tolist(), b.tolist(), strict=True):
            s, t = top(p), top(q)
            if s != t:
                up[max(s, t)] = min(s, t)
                links.append((p, q))
        return links


def _compare(cosine: float, bits: int, tables: int):
    """Rows sorted by bucket, side and block: (vec_id, n, other) sums (other null) and links (n 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(cosine, bits, tables)

        def done(rows: pa.RecordBatch) -> pa.RecordBatch:
            ids, copies = rows.column(3).to_numpy(), rows.column(5).to_numpy()
            group, counts, links = np.stack([rows.column(i).to_numpy() for i in range(2)]), [], []
            side = rows.column(2).to_numpy()
            cut = np.flatnonzero(np.r_[True, (group[:, 1:] != group[:, :-1]).any(axis=0)])
            for at, to in zip(cut, np.r_[cut[1:], rows.num_rows], strict=True):
                vectors = _matrix(rows.column(4).slice(at, to - at)).astype(np.float64)
                own = (ids[at:to], vectors, copies[at:to])
                if group[1, at] % (1 << 20) == group[1, at] >> 20:
                    found = sums.compare(int(group[0, at]), own, None)
                else:
                    first = side[at:to] == 0
                    one, two = (tuple(x[m] for x in own) for m in (first, ~first))
                    found = sums.compare(int(group[0, at]), one, two) if first.any() and not first.all() else ([], [])
                counts += found[0]
                links += found[1]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([c[0] for c in counts] + [v[0] for v in links], pa.int64()),
                    pa.array([c[1] for c in counts] + [0] * len(links), pa.int64()),
                    pa.array([None] * len(counts) + [v[1] for v in links], pa.int64()),
                ],
                names=["vec_id", "n", "other"],
            )

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            group = np.stack([batch.column(i).to_numpy() for i in range(2)])
            change = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0))
            split = int(change[-1]) + 1 if len(change) else 0
            before = held[0]
            fresh = len(held) > 1 and any(before.column(i)[0] != batch.column(i)[0] for i in range(2))
            if split or fresh:
                ready = held[:-1] + [batch.slice(0, split)]
                held = [batch.slice(split)]
                yield done(pa.Table.from_batches(ready).combine_chunks().to_batches()[0])
        if held:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()
            if whole:
                yield done(whole[0])

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.9, miss: float = 1e-5) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding).

    Two vectors of the same length link when their cosine in double precision is at least ``cosine``.  A
    vector that is null, empty, zero or holds a null or non-finite component links with nothing, nor does
    one with a null vec_id (its component_id is null, kept is true).  n_links counts rows, so equal vectors
    count each; rows that repeat a vec_id are one node of the components.  Other columns are not read, and an
    empty table gives no rows.
    """
    small_batches(vectors.sparkSession)
    # Floats travel as they are; any other numbers as doubles.
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & ~bad & F.exists("embedding", lambda v: v != 0), F.lit(False))
    base = base.withColumn("usable", usable)
    good = base.where("usable").select("vec_id", "embedding")
    digest = F.sha2(F.array_join(F.transform("embedding", lambda v: (v + F.lit(0.0)).cast("string")), ","), 256)
    keyed = materialise(good.select("vec_id", "embedding", digest.alias("digest")), "vectors")
    classes = materialise(
        keyed.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vector_classes"
    )
    reps = keyed.join(classes.withColumnRenamed("rep", "vec_id"), ["vec_id", "digest"])
    reps = materialise(reps.dropDuplicates(["vec_id", "digest"]).select("vec_id", "embedding", "copies"), "vector_reps")
    bits, tables = plan_tables(reps.count(), cosine, miss)
    rows = reps.mapInArrow(_bucketed(bits, tables), f"bucket long, vec_id long, embedding {kind}, copies long")

    # Large buckets are compared block against block: a vector goes to each pair of blocks that has its own.
    counts = reps.select("vec_id", "embedding", "copies").mapInArrow(
        _bucketed(bits, tables), f"bucket long, vec_id long, embedding {kind}, copies long"
    )
    sizes = materialise(
        counts.groupBy("bucket").agg(F.count("*").alias("size"), F.max("vec_id").alias("last")).where("size > 1"), "bucket_sizes"
    )
    blocks = F.ceil(F.col("size") / BLOCK)
    own = F.pmod(F.xxhash64("vec_id"), blocks)
    dealt = (
        rows.join(sizes.select("bucket", "size"), "bucket")
        .withColumn("own", own)
        .withColumn("partner", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .withColumn("pair", F.least("own", "partner") * (1 << 20) + F.greatest("own", "partner"))
        .withColumn("side", (F.col("own") > F.col("partner")).cast("int"))
        .select("bucket", "pair", "side", "vec_id", "embedding", "copies")
    )
    dealt = dealt.repartition("bucket", "pair").sortWithinPartitions("bucket", "pair")
    found = materialise(dealt.mapInArrow(_compare(cosine, bits, tables), "vec_id long, n long, other long"), "vector_links")
    links = found.where("other is not null").select(F.col("vec_id").alias("a"), F.col("other").alias("b"))
    parts = materialise(connected_components(links), "components")
    sums = found.where("other is null").groupBy("vec_id").agg(F.sum("n").alias("n"))
    per_class = materialise(
        classes.join(sums, classes.rep == sums.vec_id, "left")
        .join(parts, classes.rep == parts.node, "left")
        .select("digest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")),
        "vector_components",
    )
    linked = keyed.select("vec_id", "digest").join(per_class, "digest")
    for table in (sizes, reps, found):
        discard(table)
    out = linked.select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = base.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
