"""Thresholds and small formats on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def new_speaker_threshold(n: Column) -> Column:
    """H4: similarity below which a session with ``n`` speakers opens another one."""
    return F.when(n >= 2, F.greatest(F.lit(0.10), 0.30 - 0.05 * (n - 2))).otherwise(0.30)


def new_speaker_frozen(calls: Column, next_id: Column, best: Column) -> Column:
    """H4: after 20 calls with over four ids, a fairly good match forbids another speaker."""
    return (calls > 20) & (next_id > 4) & (best > F.greatest(F.lit(0.05), 0.20 - 0.03 * (next_id - 5)))


def is_ambiguous(top1: Column, top2: Column) -> Column:
    """H5: the two best scores are close, or both are high."""
    return (top1 - top2 < 0.05) | ((top1 > 0.30) & (top2 > 0.25))


def format_date(iso: Column) -> Column:
    """H7: the date of an ISO time, a dash if there is none."""
    return F.when(F.coalesce(iso, F.lit("")) == "", "-").otherwise(F.substring(iso, 1, 10))


def session_name(ts: Column) -> Column:
    """H8."""
    return F.date_format(ts, "yyyy-MM-dd_HHmmss")


def age_text(seconds: Column) -> Column:
    """H9: how long ago, in seconds, minutes or hours."""
    s = seconds.cast("long")
    return (
        F.when(s < 60, F.format_string("saved %ds ago", s))
        .when(s < 3600, F.format_string("saved %dm ago", (s / 60).cast("long")))
        .otherwise(F.format_string("saved %dh ago", (s / 3600).cast("long")))
    )


def palette_index(speaker: Column, colours: int = 8) -> Column:
    """Place of the speaker's colour, from 0."""
    return F.pmod(speaker - 1, F.lit(colours))


#: The colours of speakers, in the order they are given out.
COLOURS = ["#00ffcc", "#ff44aa", "#44ff44", "#ffaa00", "#aa88ff", "#ff6644", "#44ddff", "#ffff44"]


def palette(speaker: Column) -> Column:
    """The speaker's colour; the first one for no speaker."""
    return F.element_at(F.array(*map(F.lit, COLOURS)), F.coalesce(palette_index(speaker), F.lit(0)).cast("int") + 1)


def pcm16_to_float(sample: Column) -> Column:
    """H13."""
    return sample / 32768.0


def clip(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """H14."""
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def envelope(rms: Column) -> Column:
    """Height of a bar for the level of its bin; quiet bins have none."""
    return F.when(rms < 0.003, 0.0).otherwise(clip(F.pow(45 * rms, F.lit(0.45)), 0.0, 1.0))


def is_speech(prob: Column, rms: Column) -> Column:
    """B1: a speech probability of a half and more; where there is none, a level of 0.012 and more."""
    return F.when(prob.isNotNull(), prob >= 0.5).otherwise(rms >= 0.012)


def failure_bursts(failures: DataFrame, key: str, ts: str, seconds: int = 60, least: int = 3) -> DataFrame:
    """Failures with the count of those in the ``seconds`` before, themselves included, if it is ``least`` or more."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(at).rangeBetween(1 - seconds * 1_000_000, 0)
    return failures.withColumn("failures", F.count("*").over(w)).where(F.col("failures") >= least)
