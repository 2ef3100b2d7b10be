"""Speaker time marks from text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_rttm(spark: SparkSession, path: str, file_id: str | None = None) -> DataFrame:
    """A1: file_id, speaker, start, end of the SPEAKER lines with nine fields or more; other lines drop."""
    f = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    lines = spark.read.text(path).select(f.alias("f")).where((F.size("f") >= 9) & (F.col("f")[0] == "SPEAKER"))
    start, length = F.col("f")[3].try_cast("double"), F.col("f")[4].try_cast("double")
    out = lines.select(F.col("f")[1].alias("file_id"), F.col("f")[7].alias("speaker"), start.alias("start"), (start + length).alias("end"))
    return out if file_id is None else out.where(F.col("file_id") == file_id)


def write_rttm(segments: DataFrame, path: str) -> None:
    """The inverse: one SPEAKER line for each row of file_id, speaker, start, end."""
    length = F.col("end") - F.col("start")
    segments.select(F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", "file_id", "start", length, "speaker").alias("value")).write.text(path)
