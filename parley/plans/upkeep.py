"""Queries on profile upkeep, settings, incidents, frame weights and offers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parley.functions import signal as s
from parley.operators import maintenance as mt
from parley.operators.exemplars import update_profiles
from parley.operators.merging import merge_profiles
from parley.operators.ordered import prompt_budget
from parley.operators.protect import protect, unprotect
from parley.operators.tags import create_profiles
from parley.plans import adapters as a
from parley.plans.registry import query, table


@query("h16_overlap_weights", """WITH a AS (SELECT vec_id, list_transform(embedding[1:3], lambda v: abs(CAST(v AS DOUBLE))) AS act FROM embeddings),
t AS (SELECT vec_id, act, list_sum(list_transform(act, lambda v: exp(10 * v))) AS t FROM a)
SELECT vec_id, CAST(generate_subscripts(act, 1) - 1 AS INTEGER) AS spk, round(unnest(list_transform(act, lambda v: greatest(1e-8, pow(v, 3) * pow(exp(10 * v) / t, 3)))), 9) AS w FROM t""")
def h16(spark, d):
    act = F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 3), F.abs)
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(s.overlap_weights(act)).alias("spk", "w"))
    return e.select("vec_id", "spk", F.round("w", 9).alias("w"))


@query("h17_sample_weights", """SELECT vec_id, CAST(500 + vec_id % 500 AS INTEGER) AS n, round(CAST(embedding[1] AS DOUBLE) * 270 + CAST(embedding[2] AS DOUBLE) * least(270, 230 + vec_id % 500)
 + CAST(embedding[3] AS DOUBLE) * greatest(0, least(270, vec_id % 500 - 40)), 4) AS total FROM embeddings""")
def h17(spark, d):
    w = s.sample_weights(F.slice(F.col("embedding").cast("array<double>"), 1, 3), 500 + F.col("vec_id") % 500)
    e = table(spark, d, "embeddings").select("vec_id", w.alias("w"))
    return e.select("vec_id", F.size("w").alias("n"), F.round(F.aggregate("w", F.lit(0.0), lambda x, y: x + y), 4).alias("total"))


@query("h18_trim_silence", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), b AS (SELECT vec_id,
 coalesce(list_filter(range(0, 60, 4), lambda i: sqrt(list_sum(list_transform(x[i + 1:i + 4], lambda v: v * v)) / 4) > 0.15)[1], 0) AS lo,
 coalesce(list_filter(range(60, 4, -4), lambda i: sqrt(list_sum(list_transform(x[i + 1:i + 4], lambda v: v * v)) / 4) > 0.15)[1] + 4, 64) AS hi FROM e)
SELECT vec_id, CAST(CASE WHEN hi > lo THEN hi - lo ELSE 64 END AS INTEGER) AS n FROM b""")
def h18(spark, d):
    x = s.trim_silence(F.col("embedding").cast("array<double>"), 0.15, 4)
    return table(spark, d, "embeddings").select("vec_id", F.size(x).alias("n"))


@query("h21_transcript_line", f"""WITH {a.TRANSCRIPT} SELECT session_id, seq, '[' || ts || '] [' || speaker || '] ' || content AS plain, '**[' || ts || ']** **' || speaker || ':** ' || content AS markdown FROM transcript""")
def h21(spark, d):
    t, (ts, who, what) = a.transcript(spark, d), (F.col(c) for c in ("ts", "speaker", "content"))
    return t.select("session_id", "seq", s.plain_line(ts, who, what).alias("plain"), s.markdown_line(ts, who, what).alias("markdown"))


@query("h23_percent", "SELECT event_id, CAST(trunc(value / 500 * 100) AS BIGINT) AS pct FROM events")
def h23(spark, d):
    return table(spark, d, "events").select("event_id", s.percent(F.col("value") / 500).alias("pct"))


@query(
    "a16_incident_table",
    """SELECT event_id, key, json_extract_string(props, '$.' || key) AS val FROM (SELECT event_id, event_type, props, unnest(json_keys(props)) AS key FROM events)
UNION ALL SELECT event_id, unnest(['timestamp', 'context', 'error_type', 'error_message']), unnest([strftime(ts, '%Y-%m-%dT%H:%M:%S'), event_type,
 CASE WHEN event_type = 'error' THEN 'RuntimeError' END, CASE WHEN event_type = 'error' THEN 'event ' || event_id END]) FROM events""",
)
def a16(spark, d):
    bad = F.col("event_type") == "error"
    e = table(spark, d, "events").select(
        "event_id", "ts", F.col("event_type").alias("context"), F.when(bad, "RuntimeError").alias("error_type"),
        F.when(bad, F.concat(F.lit("event "), F.col("event_id").cast("string"))).alias("error_message"), F.col("props").alias("state"),
    )
    return mt.incident_table(e)


@query("a15_update_settings", """WITH k AS (SELECT event_id, props, value, unnest(json_keys(props)) AS key FROM events)
SELECT event_id, key, json_extract_string(props, '$.' || key) AS val FROM k WHERE key <> 'model' UNION ALL SELECT event_id, 'model', 'm' || (event_id % 7) FROM events""")
def a15(spark, d):
    patch = F.to_json(F.struct(F.concat(F.lit("m"), (F.col("event_id") % 7).cast("string")).alias("model")))
    doc = s.update_settings(F.from_json("props", "map<string,string>"), s.checked_patch(patch, {"model": "string", "k": "int"}))
    return table(spark, d, "events").select("event_id", F.explode(doc).alias("key", "val"))


@query("f1_top_matches", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 3")
def f1(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return table(spark, d, "events").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("user_id", "event_id")


@query("f7_pair_order", "SELECT user_id, string_agg(event_type, ',' ORDER BY n DESC, event_type) AS pairs FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def f7(spark, d):
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "event_type")))
    return n.groupBy("user_id").agg(F.array_join(order.getField("event_type"), ",").alias("pairs"))


@query("g1_union_tails", f"""WITH {a.CHUNKS}, p AS (SELECT (stream_id + 1) // 2 AS pair, stream_id % 2 AS side, seq FROM chunks), m AS (SELECT pair, seq FROM p WHERE side = 1), s AS (SELECT pair, seq FROM p WHERE side = 0)
SELECT coalesce(m.pair, s.pair) AS pair, coalesce(m.seq, s.seq) AS seq, CASE WHEN s.seq IS NULL THEN 'first' WHEN m.seq IS NULL THEN 'second' ELSE 'both' END AS part FROM m FULL JOIN s ON m.pair = s.pair AND m.seq = s.seq""")
def g1(spark, d):
    c = a.chunks(spark, d).select(F.floor((F.col("stream_id") + 1) / 2).alias("pair"), "seq", (F.col("stream_id") % 2).alias("side"))
    sides = c.groupBy("pair", "seq").agg(F.max("side").alias("most"), F.min("side").alias("least"))
    return sides.select("pair", "seq", F.when(F.col("most") > F.col("least"), "both").when(F.col("most") == 1, "first").otherwise("second").alias("part"))


@query("e13_prompt_budget", """WITH t AS (SELECT user_id, CAST(floor(epoch(ts)) - 1704067200 AS BIGINT) // 240 AS t FROM events), l AS (SELECT user_id, min(t) AS b, list(t ORDER BY t) AS ts FROM t GROUP BY user_id),
r AS (SELECT user_id, list_reduce(list_concat([CAST([] AS BIGINT[])], list_transform(ts, lambda x: [x - b])), lambda s, x:
 CASE WHEN len(list_filter(s, lambda y: y > x[1] - 600)) < 5 AND NOT (x[1] > 300 AND len(s) > 0 AND x[1] - s[-1] < 120) THEN list_append(s, x[1]) ELSE s END) AS shown FROM l)
SELECT user_id, unnest(shown) AS t FROM r""")
def e13(spark, d):
    t = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - 1704067200) / 240)
    first = F.min("t").over(Window.partitionBy("user_id"))
    offers = table(spark, d, "events").select("user_id", t.alias("t")).withColumn("t", F.col("t") - first)
    return prompt_budget(offers, "user_id", "t")


@query("i14_protect_profiles", "SELECT vec_id, CAST(unnest(embedding[1:2]) AS DOUBLE) AS x FROM embeddings")
def i14(spark, d):
    key = F.lit("0123456789abcdef")
    sealed = protect(protect(table(spark, d, "embeddings"), "embedding", key), "embedding", key)
    return unprotect(sealed, "embedding", key).select("vec_id", F.explode(F.slice("embedding", 1, 2)).alias("x"))


@query(
    "i2_update_profiles",
    """SELECT label AS id, CAST(least(20, count(*)) AS INTEGER) AS n, CASE WHEN count(*) >= 15 THEN 3 ELSE 0 END AS subs, count(*) FILTER (vec_id % 3 = 0) AS confirmed_count,
 count(*) FILTER (vec_id % 3 <> 0) AS auto_assigned_count, round(sum(1 + (vec_id % 50) / 10.0), 4) AS seconds, CAST('2024-01-02' AS DATE) AS last_seen_at FROM embeddings GROUP BY label""",
)
def i2(spark, d):
    e = a.exemplars(spark, d).withColumn("confirmed", F.col("vec_id") % 3 == 0).withColumnRenamed("vec_id", "seq")
    made = update_profiles(e, now=F.lit("2024-01-02").cast("date"))
    return made.select("id", F.size("exemplars").alias("n"), F.size("sub_centroids").alias("subs"), "confirmed_count", "auto_assigned_count", F.round("total_duration_sec", 4).alias("seconds"), "last_seen_at")


@query(
    "i7_merge_profiles",
    """WITH p AS (SELECT vec_id % 200 AS id, count(*) AS n, sum(1 + (vec_id % 50) / 10.0) AS s FROM embeddings GROUP BY ALL),
t AS (SELECT id, CASE WHEN id % 4 < 2 AND id - id % 4 + 3 IN (SELECT id FROM p) THEN id - id % 4 + 3 ELSE id END AS into FROM p)
SELECT t.into AS id, sum(n) AS samples, round(sum(s), 4) AS seconds, CAST(least(20, sum(least(20, n))) AS INTEGER) AS exemplars, bool_or(t.id <> t.into) AS merged FROM p JOIN t ON p.id = t.id GROUP BY t.into""",
)
def i7(spark, d):
    e = table(spark, d, "embeddings").select((F.col("vec_id") % 200).alias("id"), F.col("vec_id").alias("seq"), "embedding", (1 + (F.col("vec_id") % 50) / 10.0).alias("duration_sec"))
    old, new = F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-02").cast("timestamp")
    known, place = create_profiles(e, old), F.col("id") % 4
    merges = known.where(place < 2).select(F.col("id").alias("source"), F.when(place == 0, F.col("id") + 1).otherwise(F.col("id") + 2).alias("target"))
    made, _ = merge_profiles(known, merges, now=new)
    return made.select("id", F.col("confirmed_count").alias("samples"), F.round("total_duration_sec", 4).alias("seconds"), F.size("exemplars").alias("exemplars"), (F.col("updated_at") > old).alias("merged"))
