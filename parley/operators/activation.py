"""Local speakers of an utterance from the frames of a segmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A speaker is active from this peak on, long from this mean on; frames of one speaker alone.
ACTIVE, LONG, SOLO, OTHERS = 0.55, 0.3, 0.5, 0.3
#: Classes of speaker sets (nobody, one, two of three) that hold each speaker.
HOLDS = [(1, 4, 5), (2, 4, 6), (3, 5, 6)]


def powerset_to_activation(logits: Column) -> Column:
    """Activations of the three speakers from the logits of seven speaker sets."""
    p = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    return F.array(*[sum(F.get(p, F.lit(i)) for i in own) / total for own in HOLDS])


def active_speakers(frames: DataFrame, keys: list[str], active: float = ACTIVE, long: float = LONG) -> DataFrame:
    """(keys, spk, peak, mean, is_long) of the speakers whose activation reaches ``active`` in some frame.

    frames: keys, spk, act, a row for each frame and local speaker; a null activation does not count.
    """
    g = frames.groupBy(*keys, "spk").agg(F.max("act").alias("peak"), F.avg("act").alias("mean"))
    return g.where(F.col("peak") >= active).withColumn("is_long", F.col("mean") >= long)


def solo_frames(frames: DataFrame, keys: list[str], own: float = SOLO, others: float = OTHERS) -> DataFrame:
    """Rows of (keys, frame_ix, spk, act) in which the speaker is on and no other one is."""
    w = Window.partitionBy(*keys, "frame_ix")
    loud = F.count(F.when(F.col("act") > others, 1)).over(w) - F.when(F.col("act") > others, 1).otherwise(0)
    return frames.withColumn("loud__", loud).where((F.col("act") >= own) & (F.col("loud__") == 0)).drop("loud__")


def dominant_local(active: DataFrame, keys: list[str]) -> DataFrame:
    """The active speaker (as of ``active_speakers``) with the highest mean, of equal ones the first."""
    return active.groupBy(*keys).agg(F.min_by("spk", F.struct((-F.col("mean")).alias("mean"), F.col("spk").alias("of"))).alias("spk"))
