"""Merges of profiles, many at once: who goes where in the end, one fold for each that stays, and mappings."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.exemplars import MOST, Exemplars, quality, sub_centroids
from parley.operators.folds import Machine, fold
from parley.operators.lineage import cut


def final_targets(merges: DataFrame) -> DataFrame:
    """(source, target) with the target at the end of each chain: of a to b and b to c, a and b go to c.

    A source with several targets goes to the smallest; of a ring the smallest stays and the others go to it.
    Steps double each round, so a chain of n merges takes log n rounds.
    """
    step = cut(merges.where("source is not null and target is not null and source <> target").groupBy("source").agg(F.min("target").alias("target")))
    n, walk = step.count(), step.withColumn("least", F.col("target"))
    for _ in range(n.bit_length()):
        on = walk.select(F.col("source").alias("target"), F.col("target").alias("next"), F.col("least").alias("then"))
        both = walk.join(on, "target", "left")
        walk = cut(both.select("source", F.coalesce("next", "target").alias("target"), F.least("least", F.coalesce("then", "least")).alias("least")))
        if not walk.join(step.select(F.col("source").alias("target")), "target", "left_semi").limit(1).count():
            break
    # Who still stands on a source after n steps is in a ring, or walks into one: its smallest member stays.
    ring = walk.select(F.col("source").alias("target"), F.col("least").alias("stays"))
    return walk.join(ring, "target", "left").select("source", F.coalesce("stays", "target").alias("target")).where("source <> target")


class _Joined(Machine):
    """Exemplars of the target, then those of each source; the centroid is made anew after each."""

    def __init__(self, most: int):
        self.state, self.at = Exemplars(most), None

    def row(self, part, source, pos, x) -> Iterable[tuple]:
        if (part, source) != self.at:
            self.state.recentre()
            self.at = (part, source)
        self.state.put(np.asarray(x, dtype=float))
        return ()

    def end(self) -> Iterable[tuple]:
        self.state.recentre()
        held = np.stack(self.state.rows)
        yield held.tolist(), self.state.centroid.tolist(), sub_centroids(held).tolist(), quality(held)


def merge_profiles(profiles: DataFrame, merges: DataFrame, mapping: DataFrame | None = None, now=None, most: int = MOST) -> tuple[DataFrame, DataFrame | None]:
    """(profiles, mapping) after all ``merges`` (source, target).

    profiles: id, exemplars, confirmed_count, auto_assigned_count, total_duration_sec, perhaps centroid,
    sub_centroids, quality, updated_at, and other columns, which stay as the target has them.  Sources are added in the
    order of their ids: exemplars by the rule of I3 against the centroid before, counts and seconds summed; centroid,
    sub-centroids and quality are made anew and updated_at is set.  Sources are deleted.  A merge with a profile that
    does not exist does nothing.  mapping: session_id, speaker_id and more; see ``merge_mappings``.
    """
    known = profiles.select("id")
    real = merges.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    to = cut(final_targets(real))
    moved = profiles.join(to.withColumnsRenamed({"source": "id", "target": "into"}), "id")
    stays = profiles.join(to.select(F.col("target").alias("id")).distinct(), "id", "left_semi").withColumn("into", F.col("id"))
    both = stays.withColumn("part", F.lit(0)).unionByName(moved.withColumn("part", F.lit(1)))
    rows = both.select(F.col("into").alias("id"), "part", F.col("id").alias("source"), F.posexplode(F.col("exemplars").cast("array<array<double>>")).alias("pos", "x"))
    shape = "exemplars array<array<double>>, centroid array<double>, sub_centroids array<array<double>>, quality double"
    made = fold(rows.where("x is not null"), "id", ["part", "source", "pos"], lambda: _Joined(most), shape)
    sums = both.groupBy(F.col("into").alias("id")).agg(*[F.sum(c).alias(c) for c in ("confirmed_count", "auto_assigned_count", "total_duration_sec")])
    fresh = sums.join(made, "id", "left").withColumn("updated_at", F.current_timestamp() if now is None else now).withColumnsRenamed({c: f"{c}__new" for c in _MADE})
    kept = profiles.join(to.select(F.col("source").alias("id")), "id", "left_anti").join(fresh, "id", "left")
    kind = dict(profiles.dtypes)
    out = kept.select(*[F.coalesce(F.col(f"{c}__new").cast(kind[c]), F.col(c)).alias(c) if c in _MADE else F.col(c) for c in profiles.columns])
    return out, None if mapping is None else merge_mappings(mapping, to)


_MADE = ["confirmed_count", "auto_assigned_count", "total_duration_sec", "exemplars", "centroid", "sub_centroids", "quality", "updated_at"]


def merge_mappings(mapping: DataFrame, to: DataFrame) -> DataFrame:
    """Rows of (session_id, speaker_id, ...) under the targets of ``to`` (source, target, as of ``final_targets``).

    Where a session has several rows for one target, the row of the greatest source stays, and the target's own goes.
    """
    moved = mapping.join(to.withColumnRenamed("source", "speaker_id"), "speaker_id", "left").withColumn("into", F.coalesce("target", "speaker_id"))
    w = Window.partitionBy("session_id", "into")
    rank = F.row_number().over(w.orderBy(F.col("target").isNull(), F.desc("speaker_id")))
    some = F.max(F.col("target").isNotNull()).over(w)
    kept = moved.withColumn("rank__", rank).withColumn("some__", some).where("rank__ = 1 or not some__")
    return kept.select(*[F.col("into").alias(c) if c == "speaker_id" else F.col(c) for c in mapping.columns])
