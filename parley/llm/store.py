"""Intermediate tables in the folder that all executors share.

Long jobs cut their lineage by writing a table and reading it again.  The folder is the one that
the cluster names in ``spark.checkpoint.dir``; only a local session (tests) gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import textkit as tk

#: Ids that an id filter takes (it then has 8 to 16 bits for each, 16 MB at most); more meet in a join.
FILTER_IDS = 1 << 23
#: Spark's setting that removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, so that a Python worker holds little at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables; on a cluster it has to be configured."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="parley-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to a new table in the shared folder and return it as read from there.

    Its shuffle files go with the write, as nothing reads them again; else they stay until the driver collects garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._parley_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialise`` made and that nothing will read any more."""
    path = getattr(df, "_parley_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def unused_name(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


class IdFilter:
    """A bitmap of hashed ids: holds every id that was put in, and few others."""

    def __init__(self, bits: int):
        self._words = np.zeros(bits // 64, dtype=np.uint64)

    def _bits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bit = tk.mix(ids.astype(np.int64).view(np.uint64)) & np.uint64(64 * len(self._words) - 1)
        return (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63))

    def holds(self, ids: np.ndarray) -> np.ndarray:
        word, bit = self._bits(ids)
        return self._words[word] & bit > 0

    def words_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, bits) of the words of the bitmap that ``ids`` set."""
        word, bit = self._bits(ids)
        own, at = np.unique(word, return_inverse=True)
        out = np.zeros(len(own), dtype=np.uint64)
        np.bitwise_or.at(out, at, bit)
        return own, out

    def put(self, word: np.ndarray, bits: np.ndarray) -> IdFilter:
        self._words[word] |= bits
        return self


def id_filter(ids: DataFrame, always: bool = False):
    """A broadcast filter of a table of ids (its first column), or None if they are more than FILTER_IDS.

    With ``always`` more ids share the bits of so many: the filter lets more of the others pass, but holds each id.
    """
    spark, n = ids.sparkSession, ids.count()
    if n > FILTER_IDS and not always:
        return None
    size = 1 << max(16, (8 * max(min(n, FILTER_IDS), 1)).bit_length())

    def run(batches):
        own = IdFilter(size)
        for batch in batches:
            word, bits = own.words_of(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], names=["word", "bits"])

    parts = ids.select(F.col(ids.columns[0]).cast("long").alias("id")).dropna().mapInArrow(run, "word long, bits long")
    rows = parts.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    return spark.sparkContext.broadcast(IdFilter(size).put(rows["word"].to_numpy(), rows["bits"].to_numpy().view(np.uint64)))


def may_hold(wanted, ids: Column) -> Column:
    """Whether a broadcast id filter lets an id pass; a null does not."""

    @F.pandas_udf("boolean")
    def holds(x: pd.Series) -> pd.Series:
        return pd.Series(wanted.value.holds(x.to_numpy()))

    return ids.isNotNull() & holds(F.coalesce(ids, F.lit(0).cast("long")))


def map_only_ids(rows: DataFrame, ids: DataFrame, name: str, run, schema: str) -> DataFrame:
    """``rows.mapInArrow(run, schema)`` for the rows whose column ``name`` is in ``ids`` (its first column), and perhaps some others.

    Up to FILTER_IDS ids go to the same pass over the rows as a filter of bounded size, without a shuffle of
    the rows; more meet them in a join.
    """
    ids = materialise(ids, "ids")
    wanted = id_filter(ids)
    if wanted is None:
        return rows.join(ids.select(F.col(ids.columns[0]).alias(name)), name, "left_semi").select(*rows.columns).mapInArrow(run, schema)
    at = rows.columns.index(name)

    def filtered(batches):
        for batch in batches:
            own = batch.filter(pa.array(wanted.value.holds(batch.column(at).fill_null(0).to_numpy(zero_copy_only=False))))
            if own.num_rows:
                yield own

    return rows.mapInArrow(lambda batches: run(filtered(batches)), schema)
