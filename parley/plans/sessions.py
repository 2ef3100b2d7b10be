"""Queries on several speakers at once, speaker changes, tags, matches of settled speakers, whitening."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parley.functions import rules as r
from parley.functions.signal import spectral_centroid
from parley.operators import identify as idf
from parley.operators import matching as m
from parley.operators import tags as tg
from parley.operators.ordered import scd_segments
from parley.operators.scatter import whiten
from parley.plans import adapters as a
from parley.plans.registry import query, table
from parley.plans.speakers import COS
from parley.plans.streams import E12

R = lambda c: F.round(c, 6)


@query("s4_identify_multi")
def s4(spark, d):
    v = F.col("vec_id")
    seg, local = F.floor(v / 60).alias("seg_ix"), F.floor(v / 20) % 3
    turns = table(spark, d, "embeddings").select(
        (v % 20).alias("session_id"), seg, local.alias("local_ix"), "embedding", (v % 50).alias("first_frame"), (v % 50 + 40).alias("last_frame"),
        (1 + (v % 50) / 10.0).alias("duration_sec"), ((v % 100) / 1000.0).alias("rms"),
    )
    return idf.identify_multi(turns)


@query(
    "e3_scd_segments",
    f"""WITH {a.SEGMENTS}, w AS (SELECT session_id, (row_number() OVER o - 1) * 8000 AS place, count(*) OVER (PARTITION BY session_id) * 8000 + 16000 AS total, embedding AS e, lag(embedding) OVER o AS f
 FROM segments WINDOW o AS (PARTITION BY session_id ORDER BY seg_ix)),
l AS (SELECT session_id, max(total) AS total, coalesce(list(place ORDER BY place) FILTER (WHERE f IS NOT NULL AND 1 - {COS.format("f", "e")} > 0.6), []) AS pts FROM w GROUP BY session_id),
b AS (SELECT session_id, total, CASE WHEN total < 48000 THEN [CAST(0 AS BIGINT)] ELSE list_reduce(list_concat([[CAST(0 AS BIGINT)]], list_transform(pts, lambda x: [x])),
 lambda s, x: CASE WHEN x[1] - s[-1] >= 24000 THEN list_append(s, x[1]) ELSE s END) END AS b FROM l),
u AS (SELECT session_id, total, len(b) AS n, unnest(b) AS start FROM b), v AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY session_id ORDER BY start), total) AS stop FROM u)
SELECT session_id, start, CAST(stop AS BIGINT) AS stop FROM v WHERE stop - start >= 24000 OR n = 1""",
)
def e3(spark, d):
    w = Window.partitionBy("session_id").orderBy("seg_ix")
    v = F.col("embedding").cast("array<double>")
    windows = a.segments(spark, d).select(
        "session_id", ((F.row_number().over(w) - 1) * 8000).alias("at"), (1 - m.cosine_sim(F.lag(v).over(w), v) > 0.6).alias("far"),
        (F.count("*").over(Window.partitionBy("session_id")) * 8000 + 16000).alias("total"),
    )
    return scd_segments(windows, "session_id", "at", "far", "total")


#: Embeddings that lean towards their label, so that speakers settle; every fourth speaker has no profile.
VOICED = "voiced AS (SELECT vec_id, label, list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) + CASE WHEN i = label + 1 THEN 1.5 ELSE 0 END) AS embedding FROM embeddings)"
_OF = [t.replace("FROM embeddings", "FROM voiced") for t in (a.PROFILES, a.SEGMENTS)]
MATCHED = f"""WITH {VOICED}, {_OF[0].replace("profiles AS (", "profiles AS (SELECT * FROM (")} WHERE id % 4 > 0), {_OF[1]}, el2 AS (SELECT session_id, speaker, seg_ix, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM segments),
s2 AS (SELECT *, sum(x) OVER w AS s, row_number() OVER w AS k FROM el2 WINDOW w AS (PARTITION BY session_id, speaker, pos ORDER BY seg_ix)),
c2 AS (SELECT session_id, speaker, seg_ix, max(k) AS k, list(s ORDER BY pos) AS e, sum(s * (s - x)) / (sqrt(sum(s * s)) * sqrt(sum((s - x) * (s - x))) + 1e-10) AS cos FROM s2 GROUP BY session_id, speaker, seg_ix),
sc AS (SELECT session_id, speaker, seg_ix, id, name, n, {COS.format("e", "centroid")} AS score FROM c2, profiles WHERE k >= 3 AND 1 - cos < 0.05),
rk AS (SELECT *, row_number() OVER (PARTITION BY session_id, speaker, seg_ix ORDER BY score DESC, id) AS rank FROM sc),
p2 AS (SELECT session_id, speaker, seg_ix, max(id) FILTER (rank = 1) AS id, max(score) FILTER (rank = 1) AS score, max(score) FILTER (rank = 2) AS second, max(name) FILTER (rank = 1) AS name, max(n) FILTER (rank = 1) AS n
 FROM rk WHERE rank <= 2 GROUP BY ALL),
t2 AS (SELECT *, CASE WHEN score >= 0.25 + 0.15 * exp(-n / 10.0) AND NOT coalesce(score - second < 0.05, false) THEN 'high' WHEN score >= 0.15 THEN 'medium' ELSE 'low' END AS tier FROM p2),
mt AS (SELECT * REPLACE (CASE WHEN tier = 'low' THEN 'new' ELSE tier END AS tier) FROM t2 QUALIFY row_number() OVER (PARTITION BY session_id, speaker ORDER BY tier = 'low', seg_ix) = 1)"""


def _voiced(df, label):
    return df.withColumn("embedding", F.transform("embedding", lambda x, i: x.cast("double") + F.when(i == F.col(label), 1.5).otherwise(0.0)))


def _known(spark, d):
    sums = m.sum_vectors(_voiced(a.exemplars(spark, d), "id"), ["id"], "embedding").where("id % 4 > 0")
    return sums.select("id", F.concat(F.lit("Person "), F.col("id").cast("string")).alias("name"), m.l2_normalize(F.col("total")).alias("centroid"), "n")


def _matched(spark, d):
    return tg.match_once(_voiced(a.segments(spark, d), "speaker"), _known(spark, d), high=0.25, medium=0.15)


@query(
    "c16_match_once",
    f"{MATCHED} SELECT session_id, speaker, seg_ix, tier, CASE WHEN tier = 'high' THEN id END AS profile_id, CASE tier WHEN 'high' THEN name WHEN 'medium' THEN name || '?' ELSE '' END AS name, round(score, 6) AS score FROM mt",
)
def c16(spark, d):
    return _matched(spark, d).withColumn("score", R("score"))


@query(
    "b17_long_auto_update",
    f"{MATCHED} SELECT mt.id, g.seg_ix AS seq, g.duration_sec FROM segments g JOIN mt ON g.session_id = mt.session_id AND g.speaker = mt.speaker AND g.seg_ix <= mt.seg_ix WHERE tier = 'high' AND n >= 10 AND duration_sec >= 3",
)
def b17(spark, d):
    return tg.long_auto_update(_voiced(a.segments(spark, d), "speaker"), _matched(spark, d), _known(spark, d)).select("id", "seq", "duration_sec")


@query(
    "i12_apply_tag",
    f"""WITH {a.SEGMENTS}, g AS (SELECT *, max(duration_sec) OVER (PARTITION BY session_id, speaker) AS longest FROM segments),
k AS (SELECT *, CASE WHEN speaker % 3 = 0 THEN CAST(speaker AS VARCHAR) ELSE substr(sha256('guest ' || (speaker % 2)), 1, 16) END AS id FROM g WHERE speaker % 3 <> 2 AND (duration_sec >= 3 OR longest < 3))
SELECT id, bool_and(speaker % 3 <> 0) AS created, count(*) AS confirmed_count, round(sum(duration_sec), 6) AS seconds, count(DISTINCT (session_id, speaker)) AS mapped FROM k GROUP BY id""",
)
def i12(spark, d):
    s, who = a.segments(spark, d), F.col("speaker")
    name = F.when(who % 3 == 0, F.concat(F.lit("PERSON "), who.cast("string"))).otherwise(F.concat(F.lit("Guest "), (who % 2).cast("string")))
    named = s.select("session_id", "speaker").distinct().where("speaker % 3 <> 2").withColumn("name", name)
    known = tg.create_profiles(a.exemplars(spark, d).withColumnRenamed("vec_id", "seq")).select(F.col("id").cast("string").alias("id"), "exemplars")
    known = known.withColumn("name", F.concat(F.lit("Person "), "id"))
    old, new, mapping = tg.apply_tags(named, s, known)
    kept = ["id", "confirmed_count", F.round("total_duration_sec", 6).alias("seconds")]
    both = old.where("confirmed_count > 0").select(*kept, F.lit(False).alias("created")).unionByName(new.select(*kept, F.lit(True).alias("created")))
    return both.join(mapping.groupBy(F.col("profile_id").alias("id")).agg(F.count("*").alias("mapped")), "id")


@query(
    "d16_spectral_centroid",
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), m AS (SELECT vec_id, list_dot_product(x, x) / 64 AS power, list_transform(range(33), lambda k:
 sqrt(pow(list_sum(list_transform(range(64), lambda i: x[i + 1] * cos(pi() * k * i / 32))), 2) + pow(list_sum(list_transform(range(64), lambda i: x[i + 1] * sin(pi() * k * i / 32))), 2))) AS mag FROM e)
SELECT vec_id, round(CASE WHEN sqrt(power) <= 0.003 THEN 0.5 ELSE least(1.0, list_dot_product(mag, CAST(range(33) AS DOUBLE[])) / (list_sum(mag) + 1e-10) / (0.4 * 33)) END, 6) AS pitch FROM m""",
)
def d16(spark, d):
    return table(spark, d, "embeddings").select("vec_id", R(spectral_centroid(F.col("embedding").cast("array<double>"))).alias("pitch"))


@query("d5_whitened")
def d5w(spark, d):
    return whiten(table(spark, d, "embeddings").select("vec_id", "label", "embedding"), "label", "embedding")


@query(
    "h4_new_speaker_frozen",
    "SELECT event_id, event_id % 40 > 20 AND event_id % 12 + 1 > 4 AND value / 500 > greatest(0.05, 0.20 - 0.03 * (event_id % 12 - 4)) AS frozen FROM events",
)
def h4f(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", r.new_speaker_frozen(e % 40, e % 12 + 1, F.col("value") / 500).alias("frozen"))


@query("s9_failure_burst", f"SELECT event_id, failures FROM ({E12}) WHERE failures >= 3")
def s9(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'")
    return r.failure_bursts(e, "user_id", "ts", 3 * 86400).select("event_id", "failures")
