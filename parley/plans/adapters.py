"""The library's tables as derived from the driver's, in DataFrame and in SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.vectors import l2_normalize
from parley.operators.matching import sum_vectors
from parley.plans.registry import table


def segments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        (F.col("vec_id") % 20).alias("session_id"),
        F.col("vec_id").alias("seg_ix"),
        F.col("label").alias("speaker"),
        "embedding",
        (1 + (F.col("vec_id") % 50) / 10.0).alias("duration_sec"),
        ((F.col("vec_id") % 100) / 100.0 / 10.0).alias("rms"),
    )


SEGMENTS = """segments AS (SELECT vec_id % 20 AS session_id, vec_id AS seg_ix, label AS speaker, CAST(embedding AS DOUBLE[]) AS embedding,
 1 + (vec_id % 50) / 10.0 AS duration_sec, (vec_id % 100) / 100.0 / 10.0 AS rms FROM embeddings)"""


def exemplars(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("label").alias("id"), "vec_id", "embedding", (1 + (F.col("vec_id") % 50) / 10.0).alias("duration_sec"))


def profiles(spark: SparkSession, d: str) -> DataFrame:
    sums = sum_vectors(exemplars(spark, d), ["id"], "embedding")
    return sums.select("id", F.concat(F.lit("Person "), F.col("id").cast("string")).alias("name"), l2_normalize(F.col("total")).alias("centroid"), "n")


PROFILES = """ex AS (SELECT label AS id, vec_id, CAST(embedding AS DOUBLE[]) AS embedding, 1 + (vec_id % 50) / 10.0 AS duration_sec FROM embeddings),
el AS (SELECT id, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM ex),
sm AS (SELECT id, pos, sum(x) AS x, count(*) AS n FROM el GROUP BY id, pos),
tot AS (SELECT id, list(x ORDER BY pos) AS total, max(n) AS n FROM sm GROUP BY id),
profiles AS (SELECT id, 'Person ' || id AS name, list_transform(total, lambda v: v / sqrt(list_dot_product(total, total))) AS centroid, n FROM tot)"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(
        F.col("user_id").alias("stream_id"), F.row_number().over(w).cast("long").alias("seq"), "ts",
        (F.col("value") >= 20).alias("is_speech"), (F.col("value") / 500).alias("level"),
    )


CHUNKS = """chunks AS (SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ts,
 value >= 20 AS is_speech, value / 500 AS level FROM events)"""


def intervals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    hour = (F.unix_seconds(F.col("ts").cast("timestamp")) - 1704067200) / 3600.0
    e = table(spark, d, "events").select(
        F.col("user_id").alias("file_id"), F.col("event_type").alias("speaker"), hour.alias("start"), (hour + F.col("value") / 10).alias("end")
    )
    ref = e.where(F.col("speaker").isin("view", "click", "purchase"))
    return ref, e.withColumnRenamed("speaker", "speaker_id")


INTERVALS = """iv AS (SELECT user_id AS file_id, event_type AS speaker, CAST(floor(epoch(ts)) - 1704067200 AS BIGINT) / 3600.0 AS start,
 CAST(floor(epoch(ts)) - 1704067200 AS BIGINT) / 3600.0 + value / 10 AS "end" FROM events),
ref AS (SELECT * FROM iv WHERE speaker IN ('view', 'click', 'purchase')), hyp AS (SELECT file_id, speaker AS speaker_id, start, "end" FROM iv)"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    probes = spark.createDataFrame([(-1 - i, lang, 0, t) for i, (lang, t) in enumerate(PROBES)], "doc_id long, lang string, pos int, line string")
    return docs.unionByName(probes)


#: One line for each rule, in either engine.
PROBES = [("en", "x"), ("en", "你好 there"), ("en", "㐀㐁 there"), ("zh", "你好 there"), ("en", "\u2003Thank you.\u00a0"), ("en", "Thanks for watching!"), ("en", "music"), ("en", "Thank you."), ("en", "no no no no no no no no")]
LINES = (
    "lines AS (SELECT doc_id, lang, CAST(pos - 1 AS INTEGER) AS pos, line FROM (SELECT doc_id, lang, generate_subscripts(s, 1) AS pos, unnest(s) AS line FROM "
    "(SELECT doc_id, lang, string_split(text, chr(10)) AS s FROM documents)) UNION ALL SELECT * FROM (VALUES "
    + ", ".join(f"(CAST({-1 - i} AS BIGINT), '{lang}', 0, '{t}')" for i, (lang, t) in enumerate(PROBES))
    + ") v(doc_id, lang, pos, line))"
)


def transcript(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.col("role").alias("speaker"), F.col("text").alias("content"),
        F.format_string("%02d:%02d:00", (F.col("turn") / 60).cast("int") % 24, (F.col("turn") % 60).cast("int")).alias("ts"),
    )


TRANSCRIPT = """transcript AS (SELECT conv_id AS session_id, turn AS seq, role AS speaker, text AS content,
 lpad(CAST((turn // 60) % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(turn % 60 AS VARCHAR), 2, '0') || ':00' AS ts FROM conversations)"""
