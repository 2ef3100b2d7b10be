"""Vector code compression: product codes, learnt by rounds of exact assignment under norm-of-sum bounds.

Each part of a vector keeps its entry, an upper bound of the distance to it and a lower bound of the distance
to every other entry, each with the round in which it was measured.  The driver retains every codebook; a
bound is moved by the true net displacement of the entries between its round and now, which is never more
than the sum of the single steps.  Only parts whose bounds do not decide are measured again: first against
their own entry, then against all of them, in integers.  A pass over the vectors writes them with their
bounds to the shared folder, and with them one row for each task and entry: what entries gained and lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.skew import join_by_weight
from parley.llm.store import discard, materialise, small_batches

#: Integers below this can be squared and summed in 64 bits.
LARGEST = 1 << 27
_STATE = "vec_id long, label {label}, v array<int>, own binary, up array<float>, low array<float>, up_at binary, low_at binary"
_GAINS = "entry int, gained long, sums array<long>"


class Codebooks:
    """All codebooks so far: (parts, entries, width) integers for each round, and how far entries have moved."""

    def __init__(self, history: list[np.ndarray]):
        self.now, self.round = history[-1], len(history) - 1
        self.parts, self.entries, self.width = self.now.shape
        moved = np.stack([np.sqrt(((self.now - old).astype(np.float64) ** 2).sum(axis=2)) for old in history])
        #: (round, part, entry): net displacement of the entry, and the largest one among the other entries.
        self.moved, self.others = moved, np.zeros_like(moved)
        for e in range(self.entries):
            self.others[:, :, e] = np.delete(moved, e, axis=2).max(axis=2, initial=0.0)

    def distances(self, x: np.ndarray, part: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Squared distances of rows (n, width) to one entry each."""
        gap = x - self.now[part, entry]
        return (gap * gap).sum(axis=1)

    def nearest(self, x: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry, squared distance, squared distance of the next best); of equal ones the first entry."""
        near = np.empty((len(x), self.entries), dtype=np.int64)
        for e in range(self.entries):
            gap = x - self.now[part, e]
            near[:, e] = (gap * gap).sum(axis=1)
        own, at = near.argmin(axis=1), np.arange(len(x))
        best = near[at, own]
        near[at, own] = np.iinfo(np.int64).max
        return own, best, near.min(axis=1)


def _above(squared: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(squared.astype(np.float64)).astype(np.float32), np.float32(np.inf))


def _below(squared: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(squared.astype(np.float64)).astype(np.float32), np.float32(-np.inf))


class Bounds:
    """Entries and bounds of the parts of a batch, one row of (parts) for each vector."""

    def __init__(self, own, up, low, up_at, low_at):
        self.own, self.up, self.low, self.up_at, self.low_at = own, up, low, up_at, low_at

    @classmethod
    def unknown(cls, n: int, parts: int) -> Bounds:
        byte, real = lambda: np.zeros((n, parts), np.uint8), lambda x: np.full((n, parts), x, np.float32)
        return cls(byte(), real(np.inf), real(0.0), byte(), byte())

    def settle(self, x: np.ndarray, books: Codebooks) -> np.ndarray:
        """Bring all parts of x (n, parts, width) to the codebooks of now; gives the number of parts left alone,
        measured against their own entry, and measured against all."""
        part = np.broadcast_to(np.arange(books.parts), self.own.shape)

        def undecided(rows: np.ndarray, parts: np.ndarray) -> np.ndarray:
            own = self.own[rows, parts]
            up = self.up[rows, parts] + books.moved[self.up_at[rows, parts], parts, own]
            low = self.low[rows, parts] - books.others[self.low_at[rows, parts], parts, own]
            return ~(up * (1 + 1e-9) + 1e-9 < low)

        rows, parts = (a.reshape(-1) for a in np.broadcast_arrays(np.arange(len(x))[:, None], part))
        first = undecided(rows, parts)
        rows, parts = rows[first], parts[first]
        self.up[rows, parts] = _above(books.distances(x[rows, parts], parts, self.own[rows, parts]))
        self.up_at[rows, parts] = books.round
        second = undecided(rows, parts)
        tried, rows, parts = len(rows), rows[second], parts[second]
        own, best, other = books.nearest(x[rows, parts], parts)
        self.own[rows, parts], self.up[rows, parts], self.low[rows, parts] = own, _above(best), _below(other)
        self.up_at[rows, parts] = self.low_at[rows, parts] = books.round
        return np.array([first.size - tried, tried - len(rows), len(rows)])


def _cut(batch: pa.RecordBatch, books: Codebooks) -> np.ndarray:
    """Vectors of a batch as (n, parts, width); components that are missing in the last part are 0."""
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    n = batch.num_rows
    whole = np.zeros((n, books.parts * books.width), np.int64)
    dim = len(flat) // max(n, 1)
    whole[:, :dim] = flat.reshape(n, dim)
    return whole.reshape(n, books.parts, books.width)


def _bytes(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _reals(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(rows.reshape(-1)))


def _held(batch: pa.RecordBatch, parts: int) -> Bounds:
    byte = lambda c: np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, parts).copy()
    real = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, parts).copy()
    return Bounds(byte("own"), real("up"), real("low"), byte("up_at"), byte("low_at"))


def _pass(history: list[np.ndarray], fresh: bool):
    """A pass of assignment: vectors with new bounds, and at the end of the task what each entry gained."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, schema = Codebooks(history), None
        parts, entries, width = books.now.shape
        gained, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for batch in batches:
            x = _cut(batch, books)
            bounds = Bounds.unknown(len(x), parts) if fresh else _held(batch, parts)
            before = bounds.own.copy()
            bounds.settle(x, books)
            moved = np.ones(before.shape, bool) if fresh else bounds.own != before
            at, part = np.nonzero(moved)
            for own, sign in ((bounds.own, 1), (before, -1)):
                if sign > 0 or not fresh:
                    to = part * entries + own[at, part]
                    np.add.at(gained, to, sign)
                    np.add.at(sums, to, sign * x[at, part])
            kept = [batch.column(c) for c in ("vec_id", "label", "v")]
            kept += [_bytes(bounds.own), _reals(bounds.up), _reals(bounds.low), _bytes(bounds.up_at), _bytes(bounds.low_at)]
            schema = [a.type for a in kept]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.nulls(len(x), t) for t in (pa.int32(), pa.int64(), pa.list_(pa.int64())))], names=_NAMES)
        told = np.flatnonzero(gained.astype(bool) | sums.any(axis=1))
        if schema and len(told):
            rows = [pa.array(told.astype(np.int32)), pa.array(gained[told]), pa.ListArray.from_arrays(pa.array(np.arange(len(told) + 1, dtype=np.int32) * width), pa.array(sums[told].reshape(-1)))]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(told), t) for t in schema), *rows], names=_NAMES)

    return run


_NAMES = ["vec_id", "label", "v", "own", "up", "low", "up_at", "low_at", "entry", "gained", "sums"]


def _last(history: list[np.ndarray]):
    """The last pass: codes and errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = Codebooks(history)
        part = np.arange(books.parts)
        for batch in batches:
            x, bounds = _cut(batch, books), _held(batch, books.parts)
            bounds.settle(x, books)
            gap = x - books.now[part, bounds.own]
            error = (gap * gap).sum(axis=(1, 2))
            code = [row.tobytes().hex() for row in bounds.own]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of each kept row of ``vectors``, and the codebook of every round.

    Rows whose vector is null or holds null or non-finite components are dropped.  Components become
    floor(scale * x); a vector is cut into ``parts`` equal parts, and if its length is no multiple of them, the
    missing components of the last part are 0.  Codebooks start as the parts of the first ``entries`` kept rows by
    vec_id (rows without one last, equal ids by their components) and take ``rounds`` rounds of assignment and
    means (floor); entries that no part takes stay.  Fewer rows make smaller codebooks.  Each row counts, also
    those that repeat another.  Rows whose vector has another length than the first kept row's, or a
    component that is too large to be squared in 64 bits (32,768 and more at the default scale), have no code and
    no error and take no part in learning.  An empty table gives an empty table and no codebooks.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    kind = dict(vectors.dtypes)["label"]
    value = F.col("embedding").cast("array<double>")
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", value.alias("x")).where(F.col("x").isNotNull()).where(~bad)
    base = base.withColumn("fits", ~F.exists("x", lambda v: F.floor(F.least(F.lit(1e15), F.abs(v)) * scale) >= LARGEST - 1))
    whole = base.where("fits").select("vec_id", "label", F.transform("x", lambda v: F.floor(v * scale).cast("int")).alias("v"))
    seeds = whole.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()
    empty = spark.createDataFrame([], f"vec_id long, label {kind}, code string, error long")
    none = lambda rows: rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not seeds:
        return empty.unionByName(none(base)), []
    dim = len(seeds[0]["v"])
    rows = whole.where(F.size("v") == dim)
    seeds = [r["v"] for r in seeds if len(r["v"]) == dim] if all(len(r["v"]) == dim for r in seeds) else [
        r["v"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()
    ]
    width = -(-dim // parts)
    first = np.zeros((len(seeds), parts * width), np.int64)
    first[:, :dim] = np.array(seeds, dtype=np.int64).reshape(len(seeds), dim)
    history = [np.ascontiguousarray(first.reshape(len(seeds), parts, width).transpose(1, 0, 2))]

    count, total = np.zeros((parts, len(seeds)), object), np.zeros((parts, len(seeds), width), object)
    schema = f"{_STATE.format(label=kind)}, {_GAINS}"
    held = rows
    for at in range(rounds):
        made = materialise(held.mapInArrow(_pass(history, at == 0), schema), "codes", "zstd")
        discard(held)
        held = made.where("entry is null").drop("entry", "gained", "sums")
        held._parley_path = made._parley_path
        gains = made.where("entry is not null")
        for r in gains.groupBy("entry").agg(F.sum(F.col("gained").cast("decimal(38,0)")).alias("n")).collect():
            count[divmod(r["entry"], len(seeds))] += int(r["n"])
        sums = gains.select("entry", F.posexplode("sums").alias("at", "x")).groupBy("entry", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        for r in sums.collect():
            total[(*divmod(r["entry"], len(seeds)), r["at"])] += int(r["x"])
        book = history[-1].copy()
        for p, e in zip(*np.nonzero(count > 0), strict=True):
            book[p, e] = [int(s) // int(count[p, e]) for s in total[p, e]]
        history.append(book)
    if not rounds:
        held = materialise(held.mapInArrow(_pass(history, True), schema), "codes", "zstd").where("entry is null")
    done = held.mapInArrow(_last(history), f"vec_id long, label {kind}, code string, error long")
    odd = base.where(~F.col("fits") | (F.size("x") != dim))
    return done.unionByName(none(odd)), history


def books_digest(book: np.ndarray | None) -> str:
    """SHA-256 of all components by part, entry and place, in decimal with commas between."""
    return hashlib.sha256(",".join(map(str, [] if book is None else book.reshape(-1).tolist())).encode()).hexdigest()


def code_digest(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (errors of the rows of a label, those without one together) and the digest
    of the last codebooks, by ``compress``."""
    made, history = compress(vectors)
    coded = materialise(made, "coded", "zstd")
    by_label = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label_errors")
    out = join_by_weight(coded, by_label, ["label"], "n")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_digest(history[-1] if history else None)).alias("codebooks_sha256"))


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The same by plain rounds over all entries."""
    gap = "list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))"
    steps = [
        f"""k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor(4096 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)""",
        f"""x AS MATERIALIZED (SELECT vec_id, p, k.v[p * (len(k.v) // {parts}) + 1 : (p + 1) * (len(k.v) // {parts})] AS v FROM k, range({parts}) AS t(p))""",
        f"""s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k QUALIFY e < {entries})""",
        "c0 AS MATERIALIZED (SELECT x.p, s.e, x.v FROM s JOIN x ON s.vec_id = x.vec_id)",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT x.vec_id, x.p, min({{'d': {gap}, 'e': c.e}}) AS m FROM x JOIN c{r} AS c ON x.p = c.p GROUP BY x.vec_id, x.p)")
        if r < rounds:
            steps.append(
                f"""n{r} AS (SELECT p, e, list(v ORDER BY i) AS v FROM (
 SELECT x.p, a.m.e AS e, i, (sum(x.v[i]) - ((sum(x.v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS v
 FROM a{r} AS a JOIN x ON a.vec_id = x.vec_id AND a.p = x.p, unnest(range(1, len(x.v) + 1)) AS t(i) GROUP BY ALL) GROUP BY p, e)"""
            )
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(n.v, c.v) AS v FROM c{r} AS c LEFT JOIN n{r} AS n ON c.p = n.p AND c.e = n.e)")
    steps += [
        f"o AS (SELECT vec_id, string_agg(format('{{:02x}}', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)",
        f"h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})",
    ]
    return f"""WITH {", ".join(steps)}
SELECT o.vec_id, o.code, o.error, CAST(sum(o.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h.codebooks_sha256
FROM o JOIN k ON o.vec_id = k.vec_id, h"""


SQL = _sql()
