"""Queries on profile tables and session mappings."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import maintenance as mt
from parley.operators.merging import merge_mappings
from parley.operators.tags import create_profiles
from parley.plans import adapters as a
from parley.plans.registry import query, table

MAPPING = "mp AS (SELECT vec_id % 20 AS session_id, label AS speaker_id, count(*) AS segment_count FROM embeddings GROUP BY ALL)"


def _mapping(spark, d):
    keys = (F.col("vec_id") % 20).alias("session_id"), F.col("label").alias("speaker_id")
    return table(spark, d, "embeddings").groupBy(*keys).agg(F.count("*").alias("segment_count"))


def _customers(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


C = "c AS (SELECT c_custkey AS id, c_name AS name FROM customer)"


@query("a11_import_profiles", f"WITH {C} SELECT id, CASE WHEN id % 3 = 0 THEN name ELSE 'new ' || name END AS name FROM c WHERE id % 3 = 0 OR id % 2 = 0")
def a11(spark, d):
    c = _customers(spark, d)
    incoming = c.where("id % 2 = 0").select("id", F.concat(F.lit("new "), "name").alias("name"))
    return mt.import_profiles(c.where("id % 3 = 0"), incoming)


@query(
    "i4_rename_profiles",
    f"WITH {C} SELECT id, CASE WHEN id % 7 = 0 THEN 'R' || id ELSE name END AS name, CASE WHEN id % 7 = 0 THEN DATE '2024-01-02' ELSE DATE '2024-01-01' END AS updated_at FROM c",
)
def i4(spark, d):
    c = _customers(spark, d).withColumn("updated_at", F.lit("2024-01-01").cast("date"))
    names = c.where("id % 7 = 0").select("id", F.concat(F.lit("R"), F.col("id").cast("string")).alias("new_name"))
    return mt.rename_profiles(c, names, now=F.lit("2024-01-02").cast("date"))


@query("i6_delete_profiles", f"WITH {MAPPING} SELECT session_id, speaker_id, segment_count FROM mp WHERE speaker_id NOT IN (1, 4)")
def i6(spark, d):
    gone = spark.createDataFrame([(1,), (4,)], "id int")
    return mt.delete_profiles(a.profiles(spark, d), _mapping(spark, d), gone)[1].select("session_id", "speaker_id", "segment_count")


@query(
    "i7_merge_mappings",
    f"WITH {MAPPING} SELECT session_id, CASE WHEN speaker_id = 2 THEN 3 ELSE speaker_id END AS speaker_id, segment_count FROM mp "
    "WHERE NOT (speaker_id = 3 AND session_id IN (SELECT session_id FROM mp WHERE speaker_id = 2))",
)
def i7(spark, d):
    return merge_mappings(_mapping(spark, d), spark.createDataFrame([(2, 3)], "source int, target int")).select("session_id", "speaker_id", "segment_count")


@query("i8_record_session_speakers", f"WITH {MAPPING} SELECT session_id, speaker_id, CASE WHEN session_id = 5 THEN 99 ELSE segment_count END AS segment_count FROM mp")
def i8(spark, d):
    m = _mapping(spark, d)
    return mt.upsert(m, m.where("session_id = 5").withColumn("segment_count", F.lit(99).cast("long")), ["session_id", "speaker_id"])


@query("c3_link_by_name", f"WITH {C} SELECT id AS tag_id, id AS profile_id FROM c WHERE id % 5 = 0")
def c3(spark, d):
    c = _customers(spark, d)
    tags = c.where("id % 5 = 0").select(F.col("id").alias("tag_id"), F.upper("name").alias("tag"))
    return mt.link_by_name(tags, c).select("tag_id", "profile_id")


@query("c5_session_to_profile", f"WITH {MAPPING}, {a.PROFILES} SELECT session_id, speaker_id, name FROM mp LEFT JOIN profiles ON speaker_id = id AND id < 5")
def c5(spark, d):
    p = a.profiles(spark, d).where("id < 5").select(F.col("id").alias("speaker_id"), "name")
    return _mapping(spark, d).join(p, "speaker_id", "left").select("session_id", "speaker_id", "name")


@query("c7_conflict_sessions", f"WITH {MAPPING} SELECT session_id FROM mp WHERE speaker_id = 3 AND session_id IN (SELECT session_id FROM mp WHERE speaker_id = 2)")
def c7(spark, d):
    m = _mapping(spark, d)
    return m.where("speaker_id = 3").join(m.where("speaker_id = 2"), "session_id", "left_semi").select("session_id")


@query("g5_set_difference", f"WITH {C} SELECT id FROM c WHERE id % 2 = 0 EXCEPT SELECT id FROM c WHERE id % 3 = 0")
def g5(spark, d):
    c = _customers(spark, d).select("id")
    return c.where("id % 2 = 0").join(c.where("id % 3 = 0"), "id", "left_anti")


@query(
    "i1_create_profiles",
    f"WITH {a.PROFILES}, g AS (SELECT id, count(*) AS confirmed_count, least(20, count(*)) AS exemplar_count, round(sum(duration_sec), 6) AS total_sec FROM ex GROUP BY id) "
    "SELECT g.*, round(list_sum(list_transform(centroid, lambda x: x * x)), 6) AS size, round(centroid[64], 6) AS c63, CAST(0.0 AS DOUBLE) AS quality FROM g JOIN profiles USING (id)",
)
def i1(spark, d):
    p, c = create_profiles(a.exemplars(spark, d).withColumnRenamed("vec_id", "seq")), F.col("centroid")
    size = F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x), 6)
    return p.select(
        "id", "confirmed_count", F.size("exemplars").cast("long").alias("exemplar_count"), F.round("total_duration_sec", 6).alias("total_sec"), size.alias("size"), F.round(c[63], 6).alias("c63"), "quality"
    )


@query("f2_speakers_by_id", f"WITH {MAPPING} SELECT session_id, list(speaker_id ORDER BY speaker_id) AS speakers FROM mp GROUP BY session_id")
def f2(spark, d):
    return _mapping(spark, d).groupBy("session_id").agg(F.sort_array(F.collect_list("speaker_id")).alias("speakers"))
