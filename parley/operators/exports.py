"""Transcripts as ordered lines, so that a session of any length is written by sorted tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.signal import markdown_line, plain_line


def plain_lines(lines: DataFrame) -> DataFrame:
    """(session_id, line_ix, line). lines: session_id, seq, ts, speaker, content."""
    return lines.select("session_id", F.col("seq").cast("long").alias("line_ix"), plain_line(F.col("ts"), F.col("speaker"), F.col("content")).alias("line"))


def markdown_lines(lines: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, line_ix, line); the header has negative places and ends in a rule.

    sessions: session_id, day, time, model, language (null or empty: no such line).
    """
    item = lambda name, c: F.concat(F.lit(f"- **{name}:** "), F.col(c))
    spoken = F.when(F.coalesce("language", F.lit("")) != "", item("Language", "language"))
    head = F.array(F.lit("# Transcript"), F.lit(""), item("Date", "day"), item("Time", "time"), item("Model", "model"), spoken, F.lit(""), F.lit("---"))
    top = sessions.select("session_id", F.posexplode(head).alias("line_ix", "line")).where("line is not null")
    body = lines.select("session_id", F.col("seq").cast("long").alias("line_ix"), markdown_line(F.col("ts"), F.col("speaker"), F.col("content")).alias("line"))
    return top.select("session_id", (F.col("line_ix") - 8).cast("long").alias("line_ix"), "line").unionByName(body)


def write_lines(lines: DataFrame, path: str) -> None:
    """One folder of text for each session, its lines in order."""
    lines.repartition("session_id").sortWithinPartitions("session_id", "line_ix").select("session_id", "line").write.partitionBy("session_id").text(path)
