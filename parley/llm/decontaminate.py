"""Benchmark decontamination by size-partitioned MinHash containment search.

After "LSH Ensemble" (Zhu, Nargesian, Pu and Miller, 2016), both sides are partitioned by size: items by
the number of their shingles, in classes that grow by a factor of 4, and documents, for each class, into
pieces of as many shingles as the class's largest item.  A piece that holds m shingles of an item agrees
with it in about m / (piece + item) of the coordinates, so over a document that contains 80 % of an item
at least 10 of the 64 are expected to agree, wherever in the document they stand; one agreement makes a
candidate (no agreement: under 1 in 20,000).  Candidates are confirmed by exact shingle containment.
Items of fewer words than a shingle has are one shingle of their own length, which is looked for as it is.

The items are the query set.  They are sent to the tasks in blocks of bounded size; documents are read
once for each block and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import textkit as tk
from parley.llm.store import materialise, small_batches

COORDINATES = 64
#: Items of fewer words stand in too many texts by chance; they match only texts of the same words.
SHORTEST = 3
#: Bytes of item text in a block; a block's broadcast takes a small multiple of this.
BLOCK_BYTES = 8 << 20
_A = np.random.default_rng(77).integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_HIGH = np.uint64(32)


def _class_of(n: int) -> int:
    size = 4
    while size < n:
        size *= 4
    return size


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first, n, data, offsets in tk.text_chunks(column):
        start, end, row = tk.words(data, offsets)
        yield first, n, tk.word_hashes(data, start, end), row


class _Index:
    """Sets of a block of items and, for each size class, the items by coordinate value."""

    def __init__(self, ids: list, texts: list, k: int):
        self.ids, self.sets, short = [], [], {}
        for first, n, words, rows in _words(pa.array(texts, pa.string())):
            h, r = tk.shingle_hashes(words, rows, k)
            count = np.bincount(rows, minlength=n)
            for i in range(n):
                if SHORTEST <= count[i] < k:
                    own = tk.shingle_hashes(words[rows == i], np.zeros(count[i], np.int64), int(count[i]))[0]
                    short.setdefault(int(count[i]), []).append((own[0], ids[first + i]))
                    continue
                found = np.unique(h[r == i])
                if len(found):
                    self.ids.append(ids[first + i])
                    self.sets.append(found)
        #: Words of a short item: (hashes in order, items).
        self.short = {n: (np.array([h for h, _ in own], np.uint64), [i for _, i in own]) for n, own in ((n, sorted(own, key=lambda x: int(x[0]))) for n, own in short.items())}
        self.classes: dict[int, tuple] = {}
        for size in sorted({_class_of(len(s)) for s in self.sets}):
            members = [i for i, s in enumerate(self.sets) if _class_of(len(s)) == size]
            low = np.array([[((self.sets[i] * a) >> _HIGH).min() for a in _A] for i in members])
            keys = (np.arange(COORDINATES, dtype=np.uint64)[None, :] << _HIGH) | low
            order = np.argsort(keys, axis=None, kind="stable")
            seen = np.zeros((COORDINATES, 1 << 16), dtype=bool)
            seen[np.broadcast_to(np.arange(COORDINATES), low.shape), (low & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.classes[size] = (keys.reshape(-1)[order], np.repeat(members, COORDINATES)[order], seen)

    def held(self, words: np.ndarray, rows: np.ndarray) -> set[tuple[int, int, int | None]]:
        """(row, words, item) of the short items that stand in the texts."""
        found: set[tuple] = set()
        for n, (hashes, items) in self.short.items():
            h, r = tk.shingle_hashes(words, rows, n)
            a, b = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
            for i in np.flatnonzero(b > a):
                found.update((int(r[i]), n, at) for at in range(a[i], b[i]))
        return {(row, n, self.short[n][1][at]) for row, n, at in found}

    def candidates(self, h: np.ndarray, r: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) pairs of which some piece agrees in a coordinate."""
        found: set[tuple[int, int]] = set()
        if not len(h) or not self.classes:
            return found
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        within = np.arange(len(h)) - np.repeat(first, np.diff(np.r_[first, len(h)]))
        finest = min(self.classes)
        cut = np.flatnonzero(within % finest == 0)
        low = np.stack([np.minimum.reduceat((h * a) >> _HIGH, cut) for a in _A])
        for size, (keys, owners, seen) in self.classes.items():
            at = np.flatnonzero(within[cut] % size == 0)
            pieces, rows = np.minimum.reduceat(low, at, axis=1), r[cut][at]
            j, piece = np.nonzero(seen[np.arange(COORDINATES)[:, None], (pieces & np.uint64(0xFFFF)).astype(np.int64)])
            key = (j.astype(np.uint64) << _HIGH) | pieces[j, piece]
            a, b = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
            for i in np.flatnonzero(b > a):
                found.update((int(rows[piece[i]]), int(owner)) for owner in owners[a[i] : b[i]])
        return found


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, share: float = 0.8) -> DataFrame:
    """(doc_id, item_id, containment, n_shingles) of documents that hold at least ``share`` of an item.

    An item's set is its distinct k-word shingles; with fewer words, down to SHORTEST, it is one shingle of its own
    length, and with still fewer only a document of the same words holds it.  Items or documents without words
    never match.  Rows with a null item_id or doc_id take part and show the null.  Items of equal text are reported
    each, and so are rows that repeat.  Empty tables give no rows; texts are taken whole; other columns are not read.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // BLOCK_BYTES + 1
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, containment double, n_shingles long"
    out = None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        index = spark.sparkContext.broadcast(_Index([x.item_id for x in rows], [x.text for x in rows], k))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = index.value
            for batch in batches:
                hits: list[tuple] = []
                for first, _, words, rows in _words(batch.column(1)):
                    h, r = tk.shingle_hashes(words, rows, k)
                    hits += [(first + row, item, 1.0, 1) for row, _, item in own.held(words, rows)]
                    begin = np.searchsorted(r, np.arange(int(r[-1]) + 2)) if len(r) else None
                    for row, item in own.candidates(h, r):
                        wanted = own.sets[item]
                        inside = np.isin(wanted, h[begin[row] : begin[row + 1]]).sum()
                        if inside >= share * len(wanted):
                            hits.append((first + row, own.ids[item], inside / len(wanted), len(wanted)))
                row, item, part, size = zip(*hits, strict=True) if hits else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row, pa.int64())),
                        pa.array(item, pa.int64()),
                        pa.array(part, pa.float64()),
                        pa.array(size, pa.int64()),
                    ],
                    names=["doc_id", "item_id", "containment", "n_shingles"],
                )

        part = docs.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, share: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, with all their columns; rows with a null doc_id stay.

    Of rows that repeat a doc_id all go if one holds an item.  Empty tables are no special case.
    """
    hit = materialise(contaminated(docs, benchmark, k, share).select("doc_id").distinct(), "leaks")
    return docs.join(hit, "doc_id", "left_anti").select(*docs.columns)
