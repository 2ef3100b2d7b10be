"""Queries on segments and profiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parley.functions.text import confidence_mark, format_duration
from parley.functions.vectors import cosine_sim, dot, effective_high, l2_normalize
from parley.operators import activation as act
from parley.operators import maintenance as mt
from parley.operators import matching as m
from parley.operators.identify import segment_lists
from parley.operators.tags import create_profiles
from parley.plans import adapters as a
from parley.plans.registry import query, table

COS = "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})) + 1e-10)"
R = lambda c: F.round(c, 6)


def _queries(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


SCORED = f"""WITH {a.PROFILES}, q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT query_id, id, {COS.format("e", "centroid")} AS score, name, n FROM q, profiles),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)"""


@query("c1_match_profiles", f"{SCORED} SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3")
def c1(spark, d):
    return m.match_profiles(_queries(spark, d), a.profiles(spark, d)).select("query_id", "id", R("score").alias("score"), "rank")


@query(
    "c2_classify_match",
    SCORED
    + """, p AS (SELECT query_id, max(id) FILTER (rank = 1) AS id, max(score) FILTER (rank = 1) AS score, max(score) FILTER (rank = 2) AS second,
 max(name) FILTER (rank = 1) AS name, max(n) FILTER (rank = 1) AS n FROM r WHERE rank <= 2 GROUP BY query_id),
t AS (SELECT *, coalesce(score - second < 0.05, false) AS close, CASE WHEN score >= 0.25 + 0.15 * exp(-n / 10.0) AND NOT coalesce(score - second < 0.05, false) THEN 'high'
 WHEN score >= 0.15 THEN 'medium' ELSE 'low' END AS tier FROM p)
SELECT query_id, tier, CASE WHEN tier <> 'low' THEN id END AS profile_id, CASE WHEN tier <> 'low' THEN name ELSE '' END AS name, round(score, 6) AS score,
 close AND tier <> 'low' AS ambiguous FROM t""",
)
def c2(spark, d):
    found = m.classify_match(_queries(spark, d), a.profiles(spark, d), high=0.25, medium=0.15)
    return found.withColumn("score", R("score"))


@query(
    "c2_multi_centroid",
    f"""WITH {a.PROFILES}, q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sx AS (SELECT id, vec_id % 3 AS part, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM ex),
sc AS (SELECT id, part, list(x ORDER BY pos) AS c FROM (SELECT id, part, pos, sum(x) AS x FROM sx GROUP BY id, part, pos) GROUP BY id, part),
s AS (SELECT query_id, id, {COS.format("e", "centroid")} AS score, name, n FROM q, profiles),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s),
p AS (SELECT query_id, max(id) FILTER (rank = 1) AS id, max(score) FILTER (rank = 1) AS score, max(score) FILTER (rank = 2) AS second, max(name) FILTER (rank = 1) AS name, max(n) FILTER (rank = 1) AS n
 FROM r WHERE rank <= 2 GROUP BY query_id),
b AS (SELECT p.query_id, max({COS.format("e", "c")}) AS sub FROM p JOIN q ON p.query_id = q.query_id JOIN sc ON p.id = sc.id GROUP BY p.query_id),
m AS (SELECT p.* REPLACE (CASE WHEN n >= 15 THEN greatest(score, sub) ELSE score END AS score) FROM p JOIN b ON p.query_id = b.query_id),
t AS (SELECT *, coalesce(score - second < 0.05, false) AS close, CASE WHEN score >= 0.25 + 0.15 * exp(-n / 10.0) AND NOT coalesce(score - second < 0.05, false) THEN 'high'
 WHEN score >= 0.15 THEN 'medium' ELSE 'low' END AS tier FROM m)
SELECT query_id, tier, CASE WHEN tier <> 'low' THEN id END AS profile_id, round(score, 6) AS score, close AND tier <> 'low' AS ambiguous FROM t""",
)
def c2_multi(spark, d):
    part = a.exemplars(spark, d).withColumn("part", F.col("vec_id") % 3)
    subs = m.sum_vectors(part, ["id", "part"], "embedding").groupBy("id").agg(F.collect_list("total").alias("sub_centroids"))
    found = m.classify_match(_queries(spark, d), a.profiles(spark, d).join(subs, "id"), high=0.25, medium=0.15)
    return found.select("query_id", "tier", "profile_id", R("score").alias("score"), "ambiguous")


@query("a5_load_profiles", f"WITH {a.PROFILES} SELECT id, name, n, round(centroid[1], 6) AS c0, round(centroid[64], 6) AS c63 FROM profiles")
def a5(spark, d):
    c = F.col("centroid")
    return a.profiles(spark, d).select("id", "name", "n", R(c[0]).alias("c0"), R(c[63]).alias("c63"))


@query(
    "a6_get_profile",
    "WITH e AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS rn, count(*) OVER () AS n, sum(1 + (vec_id % 50) / 10.0) OVER () AS s FROM embeddings WHERE label = 3) "
    "SELECT label AS id, n AS samples, round(s, 4) AS seconds, CAST(rn - 1 AS INTEGER) AS at, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM e WHERE rn <= 20",
)
def a6(spark, d):
    known = create_profiles(a.exemplars(spark, d).withColumnRenamed("vec_id", "seq")).where("id = 3")
    each = known.select("id", F.col("confirmed_count").alias("samples"), F.round("total_duration_sec", 4).alias("seconds"), F.posexplode("exemplars").alias("at", "e"))
    return each.select("id", "samples", "seconds", "at", F.posexplode(F.col("e").cast("array<double>")).alias("pos", "x"))


@query(
    "d1_running_sum_centroid",
    f"WITH {a.SEGMENTS}, el AS (SELECT session_id, speaker, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS x FROM segments) "
    "SELECT session_id, speaker, CAST(pos AS INTEGER) AS pos, round(sum(x), 6) AS x FROM el GROUP BY ALL",
)
def d1(spark, d):
    sums = m.sum_vectors(a.segments(spark, d), ["session_id", "speaker"], "embedding")
    return sums.select("session_id", "speaker", F.posexplode("total").alias("pos", "x")).withColumn("x", R("x"))


@query(
    "d3_quality_score",
    f"""WITH ex AS (SELECT label AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (
SELECT a.id, avg({COS.format("a.e", "b.e")}) AS m FROM (SELECT *, row_number() OVER () AS i FROM ex) a JOIN (SELECT *, row_number() OVER () AS i FROM ex) b ON a.id = b.id AND a.i <> b.i GROUP BY a.id)
SELECT id, round(greatest(0.0, least(1.0, m)), 6) AS quality FROM p""",
)
def d3(spark, d):
    return m.quality_score(a.exemplars(spark, d), ["id"], "embedding").select("id", R("quality").alias("quality"))


@query(
    "d4_centroid_drift",
    f"""WITH {a.PROFILES}, g AS (SELECT id, embedding FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY vec_id) AS rn FROM ex) WHERE rn <= 5),
ge AS (SELECT id, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM g), gm AS (SELECT id, list(x ORDER BY pos) AS golden, max(k) AS k FROM (SELECT id, pos, avg(x) AS x, count(*) AS k FROM ge GROUP BY id, pos) GROUP BY id)
SELECT id, CASE WHEN k >= 5 THEN round(greatest(0.0, 1 - {COS.format("golden", "centroid")}), 6) ELSE 0 END AS drift FROM gm JOIN profiles USING (id)""",
)
def d4(spark, d):
    drift = m.centroid_drift(a.exemplars(spark, d), a.profiles(spark, d), "vec_id")
    return drift.select("id", R("drift").alias("drift"))


@query("h3_effective_high", f"WITH {a.PROFILES} SELECT id, round(0.55 + 0.15 * exp(-n / 10.0), 6) AS high FROM profiles")
def h3(spark, d):
    return a.profiles(spark, d).select("id", R(effective_high(F.col("n"))).alias("high"))


@query(
    "h2_l2_normalize",
    "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id, CAST(generate_subscripts(e, 1) - 1 AS INTEGER) AS pos, round(unnest(e) / sqrt(list_dot_product(e, e)), 6) AS x FROM e",
)
def h2(spark, d):
    unit = table(spark, d, "embeddings").select("vec_id", F.posexplode(l2_normalize(F.col("embedding").cast("array<double>"))).alias("pos", "x"))
    return unit.withColumn("x", R("x"))


@query(
    "e1_change_points",
    f"WITH {a.SEGMENTS}, p AS (SELECT session_id, seg_ix, embedding AS e, lag(embedding) OVER (PARTITION BY session_id ORDER BY seg_ix) AS f FROM segments), "
    f"q AS (SELECT session_id, seg_ix, 1 - {COS.format('f', 'e')} AS distance FROM p WHERE f IS NOT NULL) SELECT session_id, seg_ix, round(distance, 6) AS distance FROM q WHERE distance > 0.6",
)
def e1(spark, d):
    found = m.change_points(a.segments(spark, d), ["session_id"], "seg_ix", "embedding")
    return found.select("session_id", "seg_ix", R("distance").alias("distance"))


RECENT = " + ".join(f"coalesce({COS.format('e', f'p{i}')}, 0)" for i in (1, 2, 3))


@query(
    "e4_recent_similarity",
    f"WITH {a.SEGMENTS}, p AS (SELECT session_id, speaker, seg_ix, embedding AS e, {', '.join(f'lag(embedding, {i}) OVER w AS p{i}' for i in (1, 2, 3))} "
    f"FROM segments WINDOW w AS (PARTITION BY session_id, speaker ORDER BY seg_ix)) SELECT session_id, speaker, seg_ix, "
    f"round(({RECENT}) / (2 + CASE WHEN p3 IS NULL THEN 0 ELSE 1 END), 6) AS recent FROM p WHERE p2 IS NOT NULL",
)
def e4(spark, d):
    w = Window.partitionBy("session_id", "speaker").orderBy("seg_ix").rowsBetween(-3, -1)
    v = F.col("embedding").cast("array<double>")
    rows = a.segments(spark, d).withColumn("past", F.collect_list(v).over(w)).where(F.size("past") >= 2)
    mean = F.aggregate(F.transform("past", lambda p: cosine_sim(v, p)), F.lit(0.0), lambda s, x: s + x) / F.size("past")
    return rows.select("session_id", "speaker", "seg_ix", R(mean).alias("recent"))


@query("b2_quality_gate", f"WITH {a.SEGMENTS} SELECT session_id, seg_ix FROM segments WHERE duration_sec * 16000 >= 24000 AND rms >= 0.003")
def b2(spark, d):
    return a.segments(spark, d).where("duration_sec * 16000 >= 24000 and rms >= 0.003").select("session_id", "seg_ix")


@query("b3_silence_gate", f"WITH {a.SEGMENTS} SELECT session_id, seg_ix FROM segments WHERE rms >= 0.005")
def b3(spark, d):
    return a.segments(spark, d).where("rms >= 0.005").select("session_id", "seg_ix")


@query(
    "b4_enrollment_filter",
    f"WITH {a.SEGMENTS} SELECT session_id, speaker, seg_ix FROM (SELECT *, max(duration_sec) OVER (PARTITION BY session_id, speaker) AS m FROM segments) WHERE duration_sec >= 3 OR m < 3",
)
def b4(spark, d):
    longest = F.max("duration_sec").over(Window.partitionBy("session_id", "speaker"))
    return a.segments(spark, d).withColumn("m", longest).where("duration_sec >= 3 or m < 3").select("session_id", "speaker", "seg_ix")


@query("b6_is_mature", f"WITH {a.PROFILES} SELECT id, n >= 10 AS mature FROM profiles")
def b6(spark, d):
    return a.profiles(spark, d).select("id", (F.col("n") >= 10).alias("mature"))


@query("b7_dimension_guard", "SELECT vec_id FROM embeddings WHERE len(embedding) = 64")
def b7(spark, d):
    return table(spark, d, "embeddings").where(F.size("embedding") == 64).select("vec_id")


@query(
    "c13_closest_pair",
    f"""WITH {a.SEGMENTS}, el AS (SELECT session_id, speaker, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM segments),
c AS (SELECT session_id, speaker, list(x ORDER BY pos) AS v FROM (SELECT session_id, speaker, pos, sum(x) AS x FROM el GROUP BY ALL) GROUP BY ALL),
p AS (SELECT a.session_id, a.speaker AS s1, b.speaker AS s2, {COS.format("a.v", "b.v")} AS score FROM c a JOIN c b ON a.session_id = b.session_id AND a.speaker < b.speaker)
SELECT session_id, s1, s2, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, s1, s2) AS rn FROM p) WHERE rn = 1""",
)
def c13(spark, d):
    sums = m.sum_vectors(a.segments(spark, d), ["session_id", "speaker"], "embedding")
    one, two = (sums.select("session_id", F.col("speaker").alias(f"s{i}"), F.col("total").alias(f"v{i}")) for i in (1, 2))
    pairs = one.join(two, "session_id").where("s1 < s2").withColumn("score", cosine_sim(F.col("v1"), F.col("v2")))
    best = pairs.groupBy("session_id").agg(F.max_by(F.struct("s1", "s2", "score"), F.struct("score", -F.col("s1"), -F.col("s2"))).alias("b"))
    return best.select("session_id", "b.s1", "b.s2", R("b.score").alias("score"))


@query(
    "d17_robust_centroid",
    f"""WITH {a.SEGMENTS}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, speaker ORDER BY seg_ix DESC) AS rn FROM segments) WHERE rn <= 30),
el AS (SELECT session_id, speaker, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM l),
mu AS (SELECT session_id, speaker, list(x ORDER BY pos) AS mean, max(n) AS n FROM (SELECT session_id, speaker, pos, avg(x) AS x, count(*) AS n FROM el GROUP BY ALL) GROUP BY ALL),
k AS (SELECT l.session_id, l.speaker FROM l JOIN mu USING (session_id, speaker) WHERE n >= 3 AND {COS.format("embedding", "mean")} > 0.3)
SELECT session_id, speaker, count(*) AS kept FROM k GROUP BY ALL HAVING count(*) >= 2""",
)
def d17(spark, d):
    w = Window.partitionBy("session_id", "speaker").orderBy(F.desc("seg_ix"))
    recent = a.segments(spark, d).withColumn("rn", F.row_number().over(w)).where("rn <= 30")
    mean = m.sum_vectors(recent, ["session_id", "speaker"], "embedding").where("n >= 3")
    near = cosine_sim(F.col("embedding").cast("array<double>"), F.col("total")) > 0.3
    kept = recent.join(mean, ["session_id", "speaker"]).where(near)
    return kept.groupBy("session_id", "speaker").agg(F.count("*").alias("kept")).where("kept >= 2")


@query("d6_session_counts", f"WITH {a.SEGMENTS} SELECT session_id, count(*) AS n_segments, count(DISTINCT speaker) AS n_speakers FROM segments GROUP BY session_id")
def d6(spark, d):
    return a.segments(spark, d).groupBy("session_id").agg(F.count("*").alias("n_segments"), F.countDistinct("speaker").alias("n_speakers"))


@query(
    "d7_profile_stats",
    f"""WITH {a.SEGMENTS}, ex AS (SELECT speaker AS id, embedding AS e FROM segments),
u AS (SELECT id, generate_subscripts(e, 1) AS pos, unnest(list_transform(e, lambda v: v / sqrt(list_dot_product(e, e)))) AS x FROM ex),
q AS (SELECT id, greatest(0.0, least(1.0, (sum(s * s) - max(n)) / (max(n) * (max(n) - 1)))) AS quality FROM (SELECT id, pos, sum(x) AS s, count(*) AS n FROM u GROUP BY id, pos) GROUP BY id)
SELECT speaker AS id, count(*) AS samples, round(sum(duration_sec), 6) AS total_sec, CAST(DATE '2024-01-01' + CAST(speaker AS INTEGER) AS DATE) AS created, DATE '2024-02-01' AS last_seen,
 round(max(quality), 6) AS quality, count(DISTINCT session_id) AS sessions FROM segments JOIN q ON speaker = q.id GROUP BY speaker""",
)
def d7(spark, d):
    known = create_profiles(a.exemplars(spark, d).withColumnRenamed("vec_id", "seq")).drop("quality")
    known = known.join(m.quality_score(a.exemplars(spark, d), ["id"], "embedding").drop("n"), "id")
    known = known.withColumn("created_at", F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int"))).withColumn("last_seen_at", F.lit("2024-02-01").cast("date"))
    mapping = a.segments(spark, d).select("session_id", F.col("speaker").alias("speaker_id"))
    return mt.profile_stats(known, mapping).withColumn("total_sec", R("total_sec")).withColumn("quality", R("quality"))


@query(
    "e11_first_last",
    f"WITH {a.SEGMENTS} SELECT session_id, speaker, seg_ix, row_number() OVER up <= 3 AS in_first, row_number() OVER down <= 30 AS in_last, row_number() OVER up <= 5 AS in_golden FROM segments "
    "WINDOW up AS (PARTITION BY session_id, speaker ORDER BY seg_ix), down AS (PARTITION BY session_id, speaker ORDER BY seg_ix DESC)",
)
def e11(spark, d):
    return segment_lists(a.segments(spark, d))


@query(
    "h6_format_duration",
    "WITH s AS (SELECT vec_id, CAST(vec_id * 37 AS INTEGER) AS s FROM embeddings) SELECT vec_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' "
    "ELSE (s // 3600) || 'h ' || lpad(CAST((s // 60) % 60 AS VARCHAR), 2, '0') || 'm' END AS txt FROM s",
)
def h6(spark, d):
    return table(spark, d, "embeddings").select("vec_id", format_duration(F.col("vec_id") * 37).alias("txt"))


@query(
    "h10_confidence_mark",
    "WITH s AS (SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'new' END AS tier, (vec_id % 100) / 128.0 AS score FROM embeddings) "
    "SELECT vec_id, CASE WHEN tier = 'medium' THEN '?' WHEN tier = 'high' AND score > 0 THEN ' ~' || CAST(floor(score * 100) AS BIGINT) || '%' WHEN tier = 'new' THEN ' *' ELSE '' END AS mark FROM s",
)
def h10(spark, d):
    tier = F.when(F.col("vec_id") % 3 == 0, "high").when(F.col("vec_id") % 3 == 1, "medium").otherwise("new")
    return table(spark, d, "embeddings").select("vec_id", confidence_mark(tier, (F.col("vec_id") % 100) / 128.0).alias("mark"))


@query(
    "d13_rms",
    "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id, round(sqrt(list_dot_product(e, e) / len(e)), 6) AS rms FROM e",
)
def d13(spark, d):
    v = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select("vec_id", R(F.sqrt(dot(v, v) / F.size(v))).alias("rms"))


LOGITS = """l AS (SELECT vec_id, unnest(range(9)) AS frame_ix, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
x AS (SELECT vec_id, CAST(frame_ix AS INTEGER) AS frame_ix, list_transform(e[frame_ix * 7 + 1 : frame_ix * 7 + 7], lambda v: exp(4 * v)) AS p FROM l),
a AS (SELECT vec_id, frame_ix, unnest([0, 1, 2]) AS spk, unnest([p[2] + p[5] + p[6], p[3] + p[5] + p[7], p[4] + p[6] + p[7]]) / list_sum(p) AS act FROM x),
b AS (SELECT vec_id, spk, avg(act) AS mean FROM a GROUP BY vec_id, spk HAVING max(act) >= 0.55)"""


def _activation(spark, d):
    """Nine frames of seven logits from each embedding, four times as large."""
    frames = table(spark, d, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("frame_ix"), F.transform("embedding", lambda v: 4 * v.cast("double")).alias("e"))
    logits = frames.withColumn("x", F.slice("e", F.col("frame_ix") * 7 + 1, F.lit(7)))
    return logits.select("vec_id", "frame_ix", F.posexplode(act.powerset_to_activation(F.col("x"))).alias("spk", "act"))


@query("h15_powerset_activation", f"WITH {LOGITS} SELECT vec_id, frame_ix, spk, round(act, 6) AS act FROM a")
def h15(spark, d):
    return _activation(spark, d).withColumn("act", R("act"))


@query("b10_active_speaker", f"WITH {LOGITS} SELECT vec_id, spk, mean >= 0.3 AS is_long FROM b")
def b10(spark, d):
    return act.active_speakers(_activation(spark, d), ["vec_id"]).select("vec_id", "spk", "is_long")


@query(
    "b11_solo_frame",
    f"WITH {LOGITS} SELECT p.vec_id, p.frame_ix, p.spk FROM a p WHERE p.act >= 0.5 AND NOT EXISTS (SELECT 1 FROM a q WHERE q.vec_id = p.vec_id AND q.frame_ix = p.frame_ix AND q.spk <> p.spk AND q.act > 0.3)",
)
def b11(spark, d):
    return act.solo_frames(_activation(spark, d), ["vec_id"]).select("vec_id", "frame_ix", "spk")


@query("d18_dominant_local", f"WITH {LOGITS} SELECT vec_id, spk FROM b QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(mean, 9) DESC, spk) = 1")
def d18(spark, d):
    found = act.active_speakers(_activation(spark, d), ["vec_id"]).withColumn("mean", F.round("mean", 9))
    return act.dominant_local(found, ["vec_id"])
