"""Similarity of embeddings: centroids, top-k matches, tiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.vectors import cosine_sim, dot, effective_high, l2_normalize

#: Profiles that are handed out whole; more meet the queries block by block, blocks of so many bytes and queries.
SMALL = 4096
BLOCK_BYTES = 32 << 20
QUERY_BLOCK = 1 << 20
#: Samples from which a profile is scored by its sub-centroids too.
RICH = 15


def _partial_sums(keys: list[str]):
    """Sums of the vectors of each key and length within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(len(keys))))
            column = batch.column(len(keys))
            size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
            named = batch.select(keys).to_pandas()
            for n in np.unique(size[size > 0]):
                at = np.flatnonzero(size == n)
                group = named.iloc[at].groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
                first = np.unique(group, return_index=True)[1]
                sums = np.zeros((len(first), n))
                np.add.at(sums, group, np.nan_to_num(flat(column.take(pa.array(at))).reshape(-1, n), nan=0.0, posinf=np.inf, neginf=-np.inf))
                offsets = pa.array(np.arange(len(first) + 1, dtype=np.int32) * np.int32(n))
                own = batch.select(keys).take(pa.array(at[first]))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.ListArray.from_arrays(offsets, pa.array(sums.reshape(-1))), pa.array(np.bincount(group))], names=[*keys, "total", "n"])

    return run


def sum_vectors(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Element-wise sum of a vector column per group, as ``total``, and the row count ``n``.

    Batches are summed before the shuffle, so a hot group costs one vector for each batch.  Null vectors are left out;
    a null element counts as 0.
    """
    kind = dict(df.dtypes)
    rows = df.select(*keys, F.col(vector).cast("array<double>").alias("v__"))
    part = rows.mapInArrow(_partial_sums(keys), "".join(f"`{k}` {kind[k]}, " for k in keys) + "total array<double>, n long")
    each = part.select(*keys, "n", F.posexplode("total").alias("at", "x"))
    sums = each.groupBy(*keys, "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    return sums.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("total"), F.max("n").alias("n")
    )


def quality_score(units: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """D3: mean pairwise cosine, clamped to 0..1, by (|sum of unit vectors|^2 - n) / (n (n - 1)); no self join."""
    unit = units.withColumn("__u", l2_normalize(F.col(vector).cast("array<double>")))
    sums = sum_vectors(unit, keys, "__u")
    mean = (dot(F.col("total"), F.col("total")) - F.col("n")) / (F.col("n") * (F.col("n") - 1))
    return sums.select(*keys, "n", F.when(F.col("n") < 2, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean))).alias("quality"))


def centroid_drift(exemplars: DataFrame, profiles: DataFrame, order: str, golden: int = 5) -> DataFrame:
    """How far the centroid of a profile has moved from its first exemplars; 0 with fewer than ``golden`` of them.

    exemplars: id, ``order``, embedding; profiles: id, centroid.
    """
    w = Window.partitionBy("id").orderBy(order)
    first = exemplars.withColumn("rn__", F.row_number().over(w)).where(F.col("rn__") <= golden)
    sums = sum_vectors(first, ["id"], "embedding").where(F.col("n") == golden)
    far = F.greatest(F.lit(0.0), 1 - cosine_sim(F.col("total"), F.col("centroid")))
    return profiles.join(sums.drop("n"), "id", "left").select("id", F.coalesce(far, F.lit(0.0)).alias("drift"))


class _Block:
    """Some profiles, in the order of their ids, ready to be scored against queries."""

    def __init__(self, rows: pa.Table, k: int, subs: bool):
        rows = rows.filter(pc.is_valid(rows["vector"])).sort_by("id").combine_chunks()
        self.rows, self.k = rows, k
        size = pc.list_value_length(rows["vector"]).to_numpy() if rows.num_rows else np.zeros(0, int)
        self.dim = int(size[0]) if len(size) else -1
        self.rows = rows.filter(pa.array(size == self.dim)) if len(size) else rows
        self.matrix = flat(self.rows["vector"]).reshape(self.rows.num_rows, max(self.dim, 0))
        self.norms = np.linalg.norm(self.matrix, axis=1)
        self.subs = self._subs() if subs else None

    def _subs(self) -> np.ndarray:
        """(profiles, most sub-centroids, dim) of unit length, not a number where a profile has fewer."""
        own = [[v for v in row or [] if v is not None and len(v) == self.dim] for row in self.rows["subs"].to_pylist()]
        out = np.full((len(own), max([1, *map(len, own)]), max(self.dim, 0)), np.nan)
        for at, vectors in enumerate(own):
            if vectors:
                out[at, : len(vectors)] = vectors
        return out / (np.linalg.norm(out, axis=2, keepdims=True) + 1e-10)

    def best(self, scores: np.ndarray) -> np.ndarray:
        """Places of the k highest scores of each row, of equal ones the first."""
        n, most = scores.shape[1], min(self.k, scores.shape[1])
        if n <= 256:
            return np.argsort(-scores, axis=1, kind="stable")[:, :most]
        part = np.sort(np.argpartition(-scores, most - 1, axis=1)[:, :most], axis=1)
        own = np.take_along_axis(scores, part, axis=1)
        tied = np.flatnonzero((scores >= own.min(axis=1, keepdims=True)).sum(axis=1) > most)
        part = np.take_along_axis(part, np.argsort(-own, axis=1, kind="stable"), axis=1)
        part[tied] = np.argsort(-scores[tied], axis=1, kind="stable")[:, :most]
        return part

    def match(self, batch: pa.RecordBatch, names: list[str], carry: list[str]) -> Iterator[pa.RecordBatch]:
        """Rows (query_id, id, score, sub_score, carried ones) for a batch with query_id and vector; a query that cannot be scored has nulls."""
        column = batch.column(batch.schema.get_field_index("vector"))
        size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
        whole = (size == self.dim) & (self.rows.num_rows > 0)
        ids = batch.column(batch.schema.get_field_index("query_id"))
        for good in (True, False):
            at = np.flatnonzero(whole == good)
            if not len(at):
                continue
            if not good:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *(pa.nulls(len(at), t) for t in (self.rows["id"].type, pa.float64(), pa.float64())), *(pa.nulls(len(at), self.rows[c].type) for c in carry)], names=names)
                continue
            x = flat(column.take(pa.array(at))).reshape(len(at), self.dim)
            size_x = np.linalg.norm(x, axis=1)
            scores = x @ self.matrix.T / (size_x[:, None] * self.norms[None, :] + 1e-10)
            top = self.best(scores)
            pick, near = pa.array(top.reshape(-1)), np.take_along_axis(scores, top, axis=1)
            sub = np.full(top.shape, np.nan)
            if self.subs is not None:
                every = np.einsum("qd,qksd->qks", x, self.subs[top]) / (size_x[:, None, None] + 1e-10)
                sub = np.where(np.isnan(every), -np.inf, every).max(axis=2)
                sub[np.isinf(sub)] = np.nan
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(np.repeat(at, top.shape[1]))), self._of("id", pick), pa.array(near.reshape(-1)), pa.array(sub.reshape(-1), from_pandas=True), *(self._of(c, pick) for c in carry)],
                names=names,
            )

    def _of(self, name: str, at: pa.Array) -> pa.Array:
        column = self.rows[name].take(at)
        return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def flat(column) -> np.ndarray:
    """The numbers of a list column; a null counts as not a number."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = (pa.concat_arrays([c.flatten() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten()).cast(pa.float64())
    return values.to_numpy(zero_copy_only=False)


def _scored(queries: DataFrame, profiles: DataFrame, k: int, carry: list[str], subs: bool) -> DataFrame:
    """The k best profiles of each query with rank, score and sub_score; one row of nulls for a query without any.

    Up to SMALL profiles are handed out.  More meet the queries in pairs of blocks: a profile goes to the pairs of its
    block with all blocks of queries, and the other way round; a task holds one block of profiles, of BLOCK_BYTES, and
    queries stream past it.  Nothing of either side passes the driver; the best of the blocks are merged by query.
    """
    spark, kind = queries.sparkSession, {**dict(queries.dtypes), **dict(profiles.dtypes)}
    own = profiles.select(
        "id", F.col("centroid").cast("array<double>").alias("vector"), *([F.col("sub_centroids").cast("array<array<double>>").alias("subs")] if subs else []), *carry
    )
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("vector"))
    names = ["query_id", "id", "score", "sub_score", *carry]
    schema = f"query_id {kind['query_id']}, id {kind['id']}, score double, sub_score double" + "".join(f", `{c}` {kind[c]}" for c in carry)
    few = own.limit(SMALL + 1).toArrow()
    if few.num_rows <= SMALL:
        sent = spark.sparkContext.broadcast(few)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = _Block(sent.value, k, subs)
            for batch in batches:
                yield from block.match(batch, names, carry)

        found = asked.mapInArrow(score, schema)
    else:
        size = own.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim"), F.max(F.size("subs")).alias("subs") if subs else F.lit(0).alias("subs")).first()
        blocks = -(-size["n"] * 8 * max(size["dim"], 1) * (1 + max(size["subs"], 0)) // BLOCK_BYTES)
        parts = max(-(-asked.count() // QUERY_BLOCK), -(-spark.sparkContext.defaultParallelism // blocks), 1)
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = own.select(every(parts).alias("part"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("side"), "*")
        right = asked.select(F.pmod(F.xxhash64("query_id", "vector"), F.lit(parts)).cast("int").alias("part"), every(blocks).alias("block"), F.lit(1).alias("side"), "*")
        both = left.unionByName(right, allowMissingColumns=True)
        columns = ["id", "vector", *(["subs"] if subs else []), *carry]

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held, block = None, [], None
            for batch in batches:
                marks = np.stack([batch.column(c).to_numpy() for c in ("part", "block", "side")])
                cuts = np.flatnonzero(np.r_[True, (marks[:, 1:] != marks[:, :-1]).any(axis=0)]) if batch.num_rows else []
                for first, to in zip(cuts, [*cuts[1:], batch.num_rows]):
                    pair, rows = tuple(marks[:2, first]), batch.slice(first, to - first)
                    if pair != at:
                        at, held, block = pair, [], None
                    if marks[2, first] == 0:
                        held.append(rows.select(columns))
                        continue
                    if block is None:
                        empty = pa.Table.from_batches([rows.slice(0, 0).select(columns)])
                        block, held = _Block(pa.Table.from_batches(held) if held else empty, k, subs), []
                    yield from block.match(rows, names, carry)

        found = both.repartition("part", "block").sortWithinPartitions("part", "block", "side").mapInArrow(pairs, schema)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= k) & (F.col("id").isNotNull() | (F.col("rank") == 1)))


def match_profiles(queries: DataFrame, profiles: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` most similar profiles of each query, ties by id.

    queries: query_id, embedding. profiles: id, centroid. Returns query_id, id, score, rank.  Queries without an
    embedding, or of another length than the profiles, have no rows.
    """
    return _scored(queries, profiles, k, [], False).where("id is not null").select("query_id", "id", "score", "rank")


def classify_match(queries: DataFrame, profiles: DataFrame, high=None, medium: float = 0.35, margin: float = 0.05, multi_centroid: bool = True) -> DataFrame:
    """Tier of the best match of each query.  profiles: id, name, centroid, n (samples), perhaps sub_centroids.

    The score of a best profile with RICH samples and more is raised to that of its nearest sub-centroid (D21), unless
    ``multi_centroid`` is off.  Queries that match nothing, for want of profiles or of an embedding, are low with score 0.
    """
    subs = multi_centroid and "sub_centroids" in profiles.columns
    first = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c))).alias(c)
    rich = _scored(queries, profiles, 2, ["name", "n"], subs).groupBy("query_id").agg(
        *map(first, ("id", "name", "n", "score", "sub_score")), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second")
    )
    score = F.greatest("score", F.when(F.col("n") >= RICH, F.col("sub_score")))
    rich = rich.withColumn("score", F.coalesce(score, F.lit(0.0)))
    limit = effective_high(F.col("n")) if high is None else high + 0.15 * F.exp(-F.col("n") / 10.0)
    close = F.coalesce(F.col("score") - F.col("second") < margin, F.lit(False))
    tier = F.when((F.col("score") >= limit) & ~close, "high").when(F.col("id").isNotNull() & (F.col("score") >= medium), "medium").otherwise("low")
    low = tier == "low"
    return rich.select(
        "query_id",
        tier.alias("tier"),
        F.when(low, F.lit(None)).otherwise(F.col("id")).alias("profile_id"),
        F.when(low, F.lit("")).otherwise(F.col("name")).alias("name"),
        "score",
        (close & ~low).alias("ambiguous"),
    )


def change_points(windows: DataFrame, keys: list[str], order: str, vector: str, limit: float = 0.6) -> DataFrame:
    """Rows whose vector is further than ``limit`` from the row before."""
    w = Window.partitionBy(*keys).orderBy(order)
    v = F.col(vector).cast("array<double>")
    far = 1 - cosine_sim(F.lag(v).over(w), v)
    return windows.withColumn("distance", far).where(F.col("distance") > limit)
