"""Windows over a stream; each comes out once the watermark has passed its end, later rows are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _windowed(rows: DataFrame, keys: list[str], window: Column, aggregates: list[Column]) -> DataFrame:
    found = rows.groupBy(*keys, window.alias("w")).agg(*aggregates)
    return found.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in found.columns if c not in (*keys, "w")])


def tumbling(rows: DataFrame, keys: list[str], time: str, width: str, aggregates: list[Column]) -> DataFrame:
    """(keys, start, end, aggregates) of windows of ``width`` side by side; ``rows`` has a watermark on ``time`` or is no stream."""
    return _windowed(rows, keys, F.window(time, width), aggregates)


def sliding(rows: DataFrame, keys: list[str], time: str, width: str, step: str, aggregates: list[Column]) -> DataFrame:
    """The same of windows that begin each ``step``."""
    return _windowed(rows, keys, F.window(time, width, step), aggregates)


def sessions(rows: DataFrame, keys: list[str], time: str, gap: str, aggregates: list[Column]) -> DataFrame:
    """The same of runs of rows less than ``gap`` apart."""
    return _windowed(rows, keys, F.session_window(time, gap), aggregates)
