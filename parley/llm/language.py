"""Language identification by rank-order profiles of character n-grams (Cavnar and Trenkle, 1994).

A profile is the list of the most frequent 1- to 3-grams of letters.  A document takes the language
whose profile has the least out-of-place distance from its own.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm import textkit as tk
from parley.llm.store import small_batches

PROFILE = 300
#: Counts that a task holds at most.
HELD = 500_000
_BITS = np.uint64(21)


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def _ngrams(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, keys, counts) of every document; words are framed by a blank, keys hold up to 3 code points."""
    for first, n, data, offsets in tk.text_chunks(pc.utf8_lower(column.cast(pa.large_string()))):
        # A code point starts at each byte that is no continuation byte.
        starts = np.cumsum(np.r_[0, (data & 0xC0) != 0x80])[offsets]
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
        points = np.where(_letters()[points], points, 32).astype(np.uint64)
        for i in range(n):
            c = points[starts[i] : starts[i + 1]]
            c = np.r_[np.uint64(32), c, np.uint64(32)]
            c = c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]]
            two = (c[:-1] << _BITS) | c[1:]
            three = (two[:-1] << _BITS) | c[2:]
            three = three[c[1:-1] != 32]
            keys, counts = np.unique(np.r_[c[c != 32], two, three], return_counts=True)
            yield first + i, keys[keys != 32], counts[keys != 32]


def _ranked(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Keys of the document's profile, most frequent first, ties by key."""
    if len(keys) > PROFILE:
        least = np.partition(counts, -PROFILE)[-PROFILE]
        keep = counts >= least
        keys, counts = keys[keep], counts[keep]
    return keys[np.lexsort((keys, -counts))][:PROFILE]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial n-gram counts of each language; a task hands out what it holds when there is much."""
    total: dict[str, pd.Series] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for name, sums in total.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * len(sums), pa.string()),
                    pa.array(sums.index.to_numpy(dtype=np.uint64).view(np.int64)),
                    pa.array(sums.to_numpy().astype(np.int64)),
                ],
                names=["lang", "gram", "n"],
            )
        total.clear()

    for batch in batches:
        lang = batch.column(1).to_pylist()
        parts: dict[str, list] = {}
        for row, keys, counts in _ngrams(batch.column(0)):
            parts.setdefault(lang[row], []).append((keys, counts))
        for name, found in parts.items():
            sums = pd.Series(np.concatenate([c for _, c in found])).groupby(np.concatenate([k for k, _ in found])).sum()
            total[name] = sums if name not in total else total[name].add(sums, fill_value=0)
        if sum(map(len, total.values())) > HELD:
            yield from rows()
    yield from rows()


def learn_profiles(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank) of the ``size`` most frequent n-grams of each non-null ``lang`` in ``docs``."""
    small_batches(docs.sparkSession)
    counts = (
        docs.where("lang is not null")
        .select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
        .mapInArrow(_count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select("lang", "gram", "rank")


def predict_language(docs: DataFrame, profiles: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of every row of ``docs`` with lang_pred and score (0 to 1: 1 - distance / largest distance).

    A null text, one without a letter, or an empty set of profiles gives ``und`` and 0.  Of languages at
    the same distance the first by name is taken.  The profiles, a bounded number of n-grams for each
    language, are the only table that is sent to all tasks.
    """
    small_batches(docs.sparkSession)
    learned = profiles.toPandas()
    names = sorted(learned["lang"].unique())
    grams = np.unique(learned["gram"].to_numpy(dtype=np.int64).view(np.uint64))
    ranks = np.full((len(names), len(grams)), -1, dtype=np.int32)
    at = np.searchsorted(grams, learned["gram"].to_numpy(dtype=np.int64).view(np.uint64))
    ranks[[names.index(x) for x in learned["lang"]], at] = learned["rank"].to_numpy() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            best, score = np.full(n, -1), np.zeros(n)
            for row, keys, counts in _ngrams(batch.column(0)) if names else ():
                if not len(keys):
                    continue
                mine = _ranked(keys, counts)
                where = np.minimum(np.searchsorted(grams, mine), len(grams) - 1)
                known = grams[where] == mine
                theirs = ranks[:, where]
                off = np.where(known & (theirs >= 0), np.abs(theirs - np.arange(len(mine))), PROFILE).sum(axis=1)
                best[row] = int(np.argmin(off))
                score[row] = 1 - off[best[row]] / (PROFILE * len(mine))
            labels = pa.array([*names, "und"], pa.string()).take(pa.array(np.where(best < 0, len(names), best)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], labels, pa.array(score)], names=[*columns, "lang_pred", "score"]
            )

    source = docs.select(F.col("text").cast("string").alias("__text"), *columns)
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", lang_pred string, score double"
    return source.mapInArrow(run, schema)


def with_known_language(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """The rows of ``docs`` of which the language can be told, those with a letter; all columns are returned.

    Rows with a null or empty text go; repeated rows and null ids are judged each.
    """
    rows = docs.select(F.col("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return predict_language(rows, profiles, ["row"]).where("lang_pred <> 'und'").select("row.*")


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))
