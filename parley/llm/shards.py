"""Token sequences in training order, as shards of fixed-stride records.

Sequences are numbered as they are written; a keyed Feistel permutation with cycle-walking maps numbers to
slots of the training order, one to one and without any global state, so the order is a function of the
key.  Slots are dealt to range partitions, and each shard is a run of slots in files sorted by slot: a
reader that stopped at a slot skips what lies before it by Parquet statistics and reads on sequentially.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import textkit as tk
from parley.llm.store import discard, materialise, small_batches
from parley.llm.tokens import WordEncoder, default_path

ROUNDS = 6
#: Shards that a task writes at most.
SHARDS = 16


def permute(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slot of each number in [0, n): a Feistel network on the next even number of bits, walked into range."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = tk.mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % 2**64))
    out = numbers.astype(np.uint64)
    walking = np.ones(len(out), dtype=bool)
    while walking.any():
        x = out[walking]
        left, right = x >> np.uint64(half), x & low
        for k in keys:
            left, right = right, left ^ (tk.mix(right ^ k) & low)
        out[walking] = (left << np.uint64(half)) | right
        walking[walking] = out[walking] >= n
    return out.astype(np.int64)


def _records(path: str, stride: int, end_id: int, kind: str):
    """Records of each text, not yet padded: (task, row, doc_id, piece, n_tokens, record)."""
    end, size = np.array([end_id], dtype="<u4").tobytes(), np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, task, row = WordEncoder.of(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, n, _, _ in tk.text_chunks(batch.column(1)):
                docs, pieces, sizes, records = [], [], [], []
                for i, data in enumerate(encoder.encode(batch.column(1).slice(first, n).to_pylist())):
                    ids = np.frombuffer(data + end, "<u4").astype(kind).tobytes()
                    for piece, at in enumerate(range(0, len(ids), stride * size)):
                        part = ids[at : at + stride * size]
                        docs.append(i)
                        pieces.append(piece)
                        sizes.append(len(part) // size)
                        records.append(part)
                m = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([task] * m, pa.int64()),
                        pa.array(np.arange(row, row + m)),
                        batch.column(0).slice(first, n).take(pa.array(docs, pa.int64())),
                        pa.array(pieces, pa.int32()),
                        pa.array(sizes, pa.int32()),
                        pa.array(records, pa.binary()),
                    ],
                    names=["task", "row", "doc_id", "piece", "n_tokens", "record"],
                )
                row += m

    return run


def write_shards(
    docs: DataFrame, path: str, key: int = 1, stride: int = 1024, per_shard: int = 8192, end_id: int = 0, tokenizer: str | None = None
) -> int:
    """Write every text of ``docs`` (doc_id, text) as records of ``stride`` little-endian ids; returns their number.

    Ids take 16 bits if the tokenizer's vocabulary fits, else 32.  A text is its ids and ``end_id``; longer ones
    are cut, the last piece is padded with zeros and n_tokens tells its length.  Null texts give the end alone;
    repeated rows and null ids are records of their own; an empty table writes none; other columns are
    ignored.  Columns: slot, shard, doc_id, piece, n_tokens, record.  A file holds one shard at most.  The
    order depends on the key and on how the input is laid out in files.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokenizer = tokenizer or default_path()
    kind = "<u2" if max(WordEncoder.of(tokenizer).size, end_id + 1) <= 1 << 16 else "<u4"
    schema = "task long, row long, doc_id long, piece int, n_tokens int, record binary"
    made = materialise(docs.mapInArrow(_records(tokenizer, stride, end_id, kind), schema), "records", "zstd")
    # One row for each task of the scan.
    sizes = made.groupBy("task").agg(F.count("*").alias("n")).orderBy("task").toPandas()
    total = int(sizes["n"].sum())
    before = dict(zip(sizes["task"].tolist(), (sizes["n"].cumsum() - sizes["n"]).tolist(), strict=True))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = np.array([before[t] for t in batch.column(0).to_pylist()], dtype=np.int64)
            slot = permute(start + batch.column(1).to_numpy(), total, key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array(slot // per_shard), *batch.columns[2:]],
                names=["slot", "shard", "doc_id", "piece", "n_tokens", "record"],
            )

    placed = made.mapInArrow(slots, "slot long, shard long, doc_id long, piece int, n_tokens int, record binary")
    # Slots are dense, so ranges of shards are known without sampling; a task writes up to SHARDS of them in order.
    shards = max(1, -(-total // per_shard))
    tasks = max(-(-shards // SHARDS), min(shards, docs.sparkSession.sparkContext.defaultParallelism))
    dealt = placed.repartitionById(tasks, F.expr(f"cast(shard * {tasks} div {shards} as int)")).sortWithinPartitions("slot")
    size = stride * np.dtype(kind).itemsize
    padded = dealt.withColumn("record", F.expr(f"rpad(record, {size}, X'00')"))
    padded.write.option("maxRecordsPerFile", per_shard).option("compression", "zstd").parquet(path)
    discard(made)
    return total


def read_shards(spark: SparkSession, path: str, from_slot: int = 0) -> DataFrame:
    """Records from a slot on; what lies before is skipped by file statistics."""
    return spark.read.parquet(path).where(F.col("slot") >= from_slot)


def digest(records: DataFrame, stride: int = 1024) -> DataFrame:
    """slot, shard, doc_id, piece, n_tokens and the CRC of the ids (as written) of each record."""
    body = F.expr(f"substring(record, 1, cast(n_tokens * (octet_length(record) div {stride}) as int))")
    return records.select("slot", "shard", "doc_id", "piece", "n_tokens", F.crc32(body).alias("ids_crc32"))
