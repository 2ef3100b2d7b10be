"""Best-fit packing of tokenised documents into sequences of a fixed length.

Bounded-space online best fit: a task keeps at most ``open_bins`` open sequences, found by free space
through a bitset; a piece goes to the open sequence with the least free space that holds it, and when
there are too many, the fullest is closed.  Pieces come in runs chosen by a hash, each run longest first (best
fit decreasing within a run), so that short pieces fill what long ones leave open.  Only lengths are dealt
to the tasks that pack; token ids join their places afterwards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import textkit as tk
from parley.llm.store import materialise, small_batches
from parley.llm.tokens import WordEncoder, default_path


class BestFit:
    """Open bins by free space; ``add`` returns (bin number, place in it)."""

    def __init__(self, capacity: int, open_bins: int):
        self._capacity, self._most = capacity, open_bins
        self._by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self._bits = 0
        self._open = self._made = 0

    def add(self, length: int) -> tuple[int, int]:
        fits = self._bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self._capacity, self._made
            self._made += 1
            self._open += 1
        rest = free - length
        if rest:
            self._by_free[rest].append(number)
            self._bits |= 1 << rest
            if self._open > self._most:
                self._take((self._bits & -self._bits).bit_length() - 1)
                self._open -= 1
        else:
            self._open -= 1
        return number, self._capacity - free

    def _take(self, free: int) -> int:
        bins = self._by_free[free]
        number = bins.pop()
        if not bins:
            self._bits &= ~(1 << free)
        return number


def pieces(docs: DataFrame, length: int = 2048, tokenizer: str | None = None, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """Token pieces of whole texts: row (a number of its own), doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its ids and then ``end_id`` (null text: ``end_id`` alone); only a longer one is cut, and
    only its last piece is shorter than ``length``.  Repeated rows and null ids are pieces of their own; other
    columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    path = tokenizer or default_path()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, number = WordEncoder.of(path), TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, n, _, _ in tk.text_chunks(batch.column(1)):
                ids = batch.column(0).slice(first, n)
                cols: list[list] = [[], [], [], [], [], []]
                for row, data in enumerate(encoder.encode(batch.column(1).slice(first, n).to_pylist())):
                    data += end
                    for piece, at in enumerate(range(0, len(data), 4 * length)):
                        part = data[at : at + 4 * length]
                        for col, x in zip(cols, (row, piece, at // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                            col.append(x)
                row, piece, start, size, crc, part = cols
                out = [pa.array(np.arange(number, number + len(row))), ids.take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (piece, start, size, crc))]
                if keep_ids:
                    flat = np.frombuffer(b"".join(part), dtype="<u4").view(np.int32)
                    out.append(tk.list_array(flat, np.array(size), pa.int32()))
                out[2] = out[2].cast(pa.int32())
                number += len(row)
                yield pa.RecordBatch.from_arrays(out, names=["row", "doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "row long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return source.mapInArrow(run, schema)


def pack(parts: DataFrame, capacity: int = 2048, open_bins: int = 8192, pieces_per_task: int = 65_536, run: int = 16_384) -> DataFrame:
    """Adds sequence_id and offset to what ``pieces`` gives, without its row.

    Offsets of a sequence are gapless from 0.  Sequence ids are unique and otherwise arbitrary.  Equal rows
    are packed each, and dealt by their own numbers, so that equal or null ids spread.  A length over
    ``capacity`` is an error; an empty table gives no rows.
    """
    parts = materialise(parts, "pieces")
    total = parts.count()
    tasks, runs = total // pieces_per_task + 1, total // run + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.add(x) for x in batch.column(1).to_pylist()]
            numbers = [pa.array([base + number for number, _ in placed], pa.int64()), pa.array([offset for _, offset in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers], names=["row", "sequence_id", "offset"])

    order = F.pmod(F.xxhash64("row"), F.lit(runs))
    dealt = parts.select("row", "length").repartition(tasks, order).sortWithinPartitions(order, F.desc("length"), "row")
    places = dealt.mapInArrow(place, "row long, sequence_id long, offset long")
    return parts.join(places, "row").drop("row")
