"""Streaming forms of the ordered folds, with the state of one key at a time.

Each takes a stream.  With ``time``, a column that has a watermark, rows are put in order first and late ones are
dropped (see ``events``); ``idle`` seconds of event time close a key.  Without it rows are taken as they
arrive, and ``idle_ms`` of processing time drop a key's state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parley.functions.text import normalize_text
from parley.operators.ordered import Endpoint, Failures, Prompts, Recent
from parley.streaming.events import fold_arrivals, fold_events


def _fold(rows: DataFrame, key: str, order: str, make, schema: str, time: str | None, idle: float | None, idle_ms: int | None) -> DataFrame:
    return fold_events(rows, key, [order], time, make, schema, idle) if time else fold_arrivals(rows, key, [order], make, schema, idle_ms)


def endpoint_stream(chunks: DataFrame, idle_ms: int | None = None, time: str | None = None, idle: float | None = None) -> DataFrame:
    """(stream_id, first, last, n_chunks) of a stream of (stream_id, seq, is_speech), by the rule of ``ordered.endpoint``."""
    rows = chunks.select("stream_id", "seq", F.coalesce("is_speech", F.lit(False)).alias("is_speech"), *([time] if time else []))
    return _fold(rows, "stream_id", "seq", Endpoint, "first long, last long, n_chunks int", time, idle, idle_ms)


def dedupe_stream(lines: DataFrame, n: int = 5, idle_ms: int | None = None, time: str | None = None, idle: float | None = None) -> DataFrame:
    """Rows of (session_id, seq, text) whose normal form is not among the last ``n`` accepted ones."""
    rows = lines.where(F.col("text").isNotNull() & (F.col("text") != ""))
    rows = rows.select("session_id", "seq", normalize_text(F.col("text")).alias("form"), "text", *([time] if time else []))
    return _fold(rows, "session_id", "seq", lambda: Recent(n), f"seq {dict(lines.dtypes)['seq']}, text string", time, idle, idle_ms)


def prompt_stream(offers: DataFrame, key: str = "session_id", idle_ms: int | None = None, time: str | None = None, idle: float | None = None) -> DataFrame:
    """The offers (key, t in whole seconds) that are shown, by the rule of ``ordered.prompt_budget``."""
    rows = offers.select(key, F.col("t").cast("long").alias("t"), *([time] if time else []))
    return _fold(rows, key, "t", Prompts, "t long", time, idle, idle_ms)


def failure_stream(failures: DataFrame, key: str, seconds: int = 60, least: int = 3, idle_ms: int | None = None, time: str | None = None, idle: float | None = None) -> DataFrame:
    """(key, t, failures) whenever the failures of the last ``seconds`` are ``least`` or more."""
    rows = failures.select(key, F.col("t").cast("long").alias("t"), *([time] if time else []))
    return _fold(rows, key, "t", lambda: Failures(seconds, least), "t long, failures int", time, idle, idle_ms)


def append_live(lines: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Appends transcript lines as they come, one folder for each session."""
    writer = lines.writeStream.format("parquet").partitionBy("session_id").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
