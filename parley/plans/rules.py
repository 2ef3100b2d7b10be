"""Queries on gates, thresholds, formats, joins of intervals and running sums."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parley.functions import rules as r
from parley.functions.vectors import l2_normalize
from parley.operators import identify as idf
from parley.operators import intervals as iv
from parley.operators import matching as m
from parley.operators.ordered import speech_segments
from parley.operators.scatter import within_scatter
from parley.operators.tags import merge_speakers
from parley.plans import adapters as a
from parley.plans.registry import query, table


def R(x, n=6):
    return F.round(F.col(x) if isinstance(x, str) else x, n)


@query("b16_known_or_default", "SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN lang ELSE 'en' END AS lang FROM documents")
def b16(spark, d):
    known = F.when(F.col("lang").isin("en", "de"), F.col("lang")).otherwise("en")
    return table(spark, d, "documents").select("doc_id", known.alias("lang"))


@query(
    "b9_chunk_gate",
    f"WITH {a.CHUNKS} SELECT stream_id, (seq - 1) // 16 AS chunk, round(sum(CASE WHEN is_speech THEN 1 ELSE 0 END) / count(*), 6) AS ratio FROM chunks "
    "GROUP BY ALL HAVING count(*) >= 8 AND sum(CASE WHEN is_speech THEN 1 ELSE 0 END) / count(*) >= 0.25",
)
def b9(spark, d):
    c = a.chunks(spark, d).groupBy("stream_id", F.floor((F.col("seq") - 1) / 16).alias("chunk"))
    c = c.agg(F.count("*").alias("n"), F.avg(F.col("is_speech").cast("int")).alias("ratio"))
    return c.where("n >= 8 and ratio >= 0.25").select("stream_id", "chunk", R("ratio").alias("ratio"))


@query("d22_speech_ratio", f"WITH {a.CHUNKS} SELECT stream_id, round(avg(CASE WHEN is_speech THEN 1.0 ELSE 0.0 END), 6) AS ratio FROM chunks GROUP BY ALL")
def d22(spark, d):
    return a.chunks(spark, d).groupBy("stream_id").agg(R(F.avg(F.col("is_speech").cast("int"))).alias("ratio"))


@query(
    "d14_chunk_speech_prob",
    f"WITH {a.CHUNKS} SELECT stream_id, (seq - 1) // 8 AS chunk, round(CASE WHEN count(*) = 8 THEN max(level) ELSE 0 END, 6) AS prob FROM chunks GROUP BY ALL",
)
def d14(spark, d):
    c = a.chunks(spark, d).groupBy("stream_id", F.floor((F.col("seq") - 1) / 8).alias("chunk"))
    return c.agg(R(F.when(F.count("*") == 8, F.max("level")).otherwise(0.0)).alias("prob"))


@query(
    "d15_envelope",
    f"WITH {a.CHUNKS}, b AS (SELECT stream_id, (seq - 1) // 16 AS bin, sqrt(avg(level * level)) AS rms FROM chunks GROUP BY ALL) "
    "SELECT stream_id, bin, round(CASE WHEN rms < 0.003 THEN 0 ELSE least(1.0, pow(45 * rms, 0.45)) END, 6) AS height FROM b",
)
def d15(spark, d):
    c = a.chunks(spark, d).groupBy("stream_id", F.floor((F.col("seq") - 1) / 16).alias("bin"))
    return c.agg(F.sqrt(F.avg(F.col("level") * F.col("level"))).alias("rms")).select("stream_id", "bin", R(r.envelope(F.col("rms"))).alias("height"))


@query(
    "a3_reblock",
    """WITH p AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) * 16 + 1 AS n, sum(CAST(floor(value) AS BIGINT) * 16 + 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stop FROM events),
b AS (SELECT user_id, stop - n AS start, stop, unnest(range(CAST((stop - n) // 1024 AS BIGINT), CAST((stop - 1) // 1024 + 1 AS BIGINT))) AS block FROM p)
SELECT user_id AS stream_id, block, count(*) AS pieces FROM b GROUP BY ALL HAVING sum(least(stop, (block + 1) * 1024) - greatest(start, block * 1024)) = 1024""",
)
def a3(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("n", F.floor("value") * 16 + 1).withColumn("stop", F.sum("n").over(w))
    e = e.select(F.col("user_id").alias("stream_id"), (F.col("stop") - F.col("n")).alias("start"), "stop")
    blocks = F.sequence(F.floor(F.col("start") / 1024), F.floor((F.col("stop") - 1) / 1024))
    e = e.withColumn("block", F.explode(blocks))
    inside = F.least("stop", (F.col("block") + 1) * 1024) - F.greatest("start", F.col("block") * 1024)
    return e.groupBy("stream_id", "block").agg(F.count("*").alias("pieces"), F.sum(inside).alias("n")).where("n = 1024").drop("n")


@query(
    "c4_suggest_names",
    "WITH p AS (SELECT DISTINCT c_mktsegment[1:3] AS prefix FROM customer), n AS (SELECT DISTINCT c_mktsegment AS name FROM customer) "
    "SELECT prefix, name FROM p JOIN n ON starts_with(name, prefix)",
)
def c4(spark, d):
    names = table(spark, d, "customer").select(F.col("c_mktsegment").alias("name")).distinct()
    starts = names.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda n: F.substring("name", F.lit(1), n))).alias("prefix"))
    typed = table(spark, d, "customer").select(F.substring("c_mktsegment", 1, 3).alias("prefix")).distinct()
    return starts.join(typed, "prefix").select("prefix", "name")


@query("c6_anti_existing", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def c6(spark, d):
    orders = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id")).join(orders, "id", "left_anti")


@query(
    "c8_intersect_intervals",
    f"""WITH {a.INTERVALS} SELECT h.file_id, speaker_id, speaker, round(greatest(h.start, r.start), 6) AS start, round(least(h."end", r."end"), 6) AS "end"
FROM hyp h JOIN ref r ON h.file_id = r.file_id AND least(h."end", r."end") - greatest(h.start, r.start) > 0.25""",
)
def c8(spark, d):
    ref, hyp = a.intervals(spark, d)
    found = iv.intersections(hyp, ref, 0.25, 24.0)
    return found.select("file_id", "speaker_id", "speaker", R("start").alias("start"), R("end").alias("end"))


@query(
    "c12_resample_frames",
    f"WITH {a.CHUNKS}, n AS (SELECT stream_id, count(*) AS n FROM chunks GROUP BY ALL), f AS (SELECT stream_id, n, unnest(range(0, n * 270 // 160)) AS i FROM n) "
    "SELECT f.stream_id, i, round(level, 6) AS level FROM f JOIN chunks c ON f.stream_id = c.stream_id AND c.seq - 1 = least(i * 160 // 270, n - 1)",
)
def c12(spark, d):
    c = a.chunks(spark, d)
    n = c.groupBy("stream_id").agg(F.count("*").alias("n"))
    fine = n.select("stream_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") * 270 / 160) - 1)).alias("i"))
    fine = fine.withColumn("seq", F.least(F.floor(F.col("i") * 160 / 270), F.col("n") - 1) + 1)
    return fine.join(c, ["stream_id", "seq"]).select("stream_id", "i", R("level").alias("level"))


@query(
    "d2_mean_centroid",
    f"WITH {a.PROFILES} SELECT id, CAST(pos - 1 AS INTEGER) AS pos, round(x, 6) AS x FROM (SELECT id, generate_subscripts(centroid, 1) AS pos, unnest(centroid) AS x FROM profiles)",
)
def d2(spark, d):
    sums = m.sum_vectors(a.exemplars(spark, d), ["id"], "embedding")
    mean = l2_normalize(F.transform("total", lambda x: x / F.col("n")))
    return sums.select("id", F.posexplode(mean).alias("pos", "x")).select("id", "pos", R("x").alias("x"))


@query(
    "d5_within_scatter",
    """WITH el AS (SELECT label, vec_id, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
c AS (SELECT *, x - avg(x) OVER (PARTITION BY label, pos) AS y, count(*) OVER (PARTITION BY label, pos) AS n FROM el)
SELECT CAST(a.pos AS INTEGER) AS i, CAST(b.pos AS INTEGER) AS j, round(sum(a.y * b.y) / count(*) + CASE WHEN a.pos = b.pos THEN 1e-4 ELSE 0 END, 6) AS x
FROM c a JOIN c b ON a.vec_id = b.vec_id WHERE a.n >= 2 GROUP BY a.pos, b.pos""",
)
def d5(spark, d):
    return within_scatter(table(spark, d, "embeddings"), "label", "embedding").select("i", "j", R("x").alias("x"))


FRAMES = f"""WITH {a.INTERVALS}, fr AS (SELECT file_id, unnest(range(0, CAST(floor(m) AS BIGINT) + 1)) AS frame FROM (SELECT file_id, max("end") AS m FROM ref GROUP BY file_id)),
c AS (SELECT f.file_id, r.speaker, h.speaker_id, count(*) AS n FROM fr f JOIN ref r ON f.file_id = r.file_id AND r.start <= frame AND frame < r."end"
 JOIN hyp h ON f.file_id = h.file_id AND h.start <= frame AND frame < h."end" GROUP BY ALL),
p AS (SELECT file_id, speaker, speaker_id FROM (SELECT *, row_number() OVER (PARTITION BY file_id, speaker ORDER BY n DESC, speaker_id) AS rn FROM c) WHERE rn = 1)"""


@query("d12_primary_id_separation", f"{FRAMES} SELECT file_id, count(*) AS speakers, count(DISTINCT speaker_id) AS ids FROM p GROUP BY file_id")
def d12(spark, d):
    ref, hyp = a.intervals(spark, d)
    return iv.primary_ids(iv.cooccurrence(hyp, ref, 1.0))


@query(
    "j4_cluster_merge_map",
    "WITH n AS (SELECT vec_id % 20 AS session_id, label % 3 AS cluster, label AS speaker, count(*) AS n FROM embeddings GROUP BY ALL) SELECT session_id, speaker, "
    "first_value(speaker) OVER (PARTITION BY session_id, cluster ORDER BY n DESC, speaker) AS target FROM n",
)
def j4(spark, d):
    e = table(spark, d, "embeddings")
    n = e.groupBy((F.col("vec_id") % 20).alias("session_id"), (F.col("label") % 3).alias("cluster"), F.col("label").alias("speaker")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("session_id", "cluster").orderBy(F.desc("n"), "speaker")
    return n.select("session_id", "speaker", F.first("speaker").over(w).alias("target"))


@query(
    "d19_benchmark_summary",
    f'WITH {a.INTERVALS} SELECT file_id, count(*) AS segments, count(DISTINCT speaker_id) AS speakers, round(max("end"), 6) AS duration, round(sum("end" - start) / max("end"), 6) AS rtf FROM hyp GROUP BY file_id',
)
def d19(spark, d):
    _, hyp = a.intervals(spark, d)
    length = F.max("end")
    return hyp.groupBy("file_id").agg(
        F.count("*").alias("segments"), F.countDistinct("speaker_id").alias("speakers"), R(length).alias("duration"),
        R(F.sum(F.col("end") - F.col("start")) / length).alias("rtf"),
    )


@query(
    "e5_is_stable",
    f"""WITH {a.SEGMENTS}, el AS (SELECT session_id, speaker, seg_ix, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM segments),
s AS (SELECT *, sum(x) OVER w AS s, row_number() OVER w AS n FROM el WINDOW w AS (PARTITION BY session_id, speaker, pos ORDER BY seg_ix)),
c AS (SELECT session_id, speaker, seg_ix, max(n) AS n, sum(s * (s - x)) / (sqrt(sum(s * s)) * sqrt(sum((s - x) * (s - x))) + 1e-10) AS cos FROM s GROUP BY ALL)
SELECT session_id, speaker, seg_ix, n >= 3 AND 1 - cos < 0.05 AS stable FROM c""",
)
def e5(spark, d):
    return idf.is_stable(a.segments(spark, d))


@query("f4_newest_snapshots", "SELECT user_id, day FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS rn FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events)) WHERE rn <= 7")
def f4(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("day"))
    days = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    return days.withColumn("rn", F.row_number().over(w)).where("rn <= 7").drop("rn")


@query(
    "g4_set_intersection",
    "SELECT user_id, list_sort(list_intersect(list(DISTINCT event_type) FILTER (WHERE value >= 50), list(DISTINCT event_type) FILTER (WHERE value < 20))) AS shared FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE value >= 50) > 0 AND count(*) FILTER (WHERE value < 20) > 0",
)
def g4(spark, d):
    e = table(spark, d, "events")
    high, low = (F.collect_set(F.when(c, F.col("event_type"))) for c in (F.col("value") >= 50, F.col("value") < 20))
    g = e.groupBy("user_id").agg(high.alias("high"), low.alias("low")).where("size(high) > 0 and size(low) > 0")
    return g.select("user_id", F.sort_array(F.array_intersect("high", "low")).alias("shared"))


@query(
    "h4_new_speaker_threshold",
    f"WITH {a.PROFILES}, s AS (SELECT vec_id % 20 AS session_id, count(DISTINCT label) AS n FROM embeddings GROUP BY ALL) "
    "SELECT session_id, round(CAST(CASE WHEN n >= 2 THEN greatest(0.10, 0.30 - 0.05 * (n - 2)) ELSE 0.30 END AS DOUBLE), 6) AS low FROM s",
)
def h4(spark, d):
    s = a.segments(spark, d).groupBy("session_id").agg(F.countDistinct("speaker").alias("n"))
    return s.select("session_id", R(r.new_speaker_threshold(F.col("n"))).alias("low"))


@query("h5_is_ambiguous", "SELECT event_id, value / 100 - CAST(event_id % 10 AS DOUBLE) / 20 < 0.05 OR (value / 100 > 0.30 AND CAST(event_id % 10 AS DOUBLE) / 20 > 0.25) AS ambiguous FROM events")
def h5(spark, d):
    second = (F.col("event_id") % 10).cast("double") / 20
    return table(spark, d, "events").select("event_id", r.is_ambiguous(F.col("value") / 100, second).alias("ambiguous"))


@query(
    "h8_time_formats",
    """SELECT event_id, strftime(ts, '%Y-%m-%d_%H%M%S') AS session, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN s < 60 THEN 'saved ' || s || 's ago' WHEN s < 3600 THEN 'saved ' || s // 60 || 'm ago'
ELSE 'saved ' || s // 3600 || 'h ago' END AS age FROM (SELECT event_id, ts, CAST(floor(value * 100) AS BIGINT) AS s FROM events)""",
)
def h8(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", r.session_name("ts").alias("session"), r.format_date(F.col("ts").cast("string")).alias("day"), r.age_text(F.floor(F.col("value") * 100)).alias("age"))


@query("h11_palette", f"SELECT vec_id, {r.COLOURS}[(label - 1 + 8) % 8 + 1] AS colour FROM embeddings")
def h11(spark, d):
    return table(spark, d, "embeddings").select("vec_id", r.palette(F.col("label")).alias("colour"))


@query("h13_samples", "SELECT event_id, round(CAST(floor(value * 100) AS BIGINT) / 32768.0, 9) AS x, round(greatest(-1.0, least(1.0, value / 100 - 1)), 9) AS clipped, floor(value * 100) / 16000 AS seconds FROM events")
def h13(spark, d):
    whole = F.floor(F.col("value") * 100)
    return table(spark, d, "events").select(
        "event_id", R(r.pcm16_to_float(whole), 9).alias("x"), R(r.clip(F.col("value") / 100 - 1), 9).alias("clipped"), (whole / 16000).alias("seconds")
    )


@query(
    "i11_merge_session_speakers",
    "WITH s AS (SELECT vec_id % 20 AS session_id, CASE WHEN label = 2 THEN 5 ELSE label END AS speaker, embedding FROM embeddings) "
    "SELECT session_id, CAST(speaker AS INTEGER) AS speaker, count(*) AS n, round(sum(CAST(embedding[1] AS DOUBLE)), 6) AS x0 FROM s GROUP BY ALL",
)
def i11(spark, d):
    s = a.segments(spark, d).withColumn("speaker", F.col("speaker").cast("int"))
    merges = s.where("speaker = 2").select("session_id", F.col("speaker").alias("source"), F.lit(5).alias("target")).distinct()
    return m.sum_vectors(merge_speakers(s, merges), ["session_id", "speaker"], "embedding").select("session_id", "speaker", "n", R(F.col("total")[0]).alias("x0"))


@query("i5_recolor_profiles", "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'cyan' ELSE c_mktsegment END AS color FROM customer")
def i5(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("color"))
    new = c.where("id % 4 = 0").select("id", F.lit("cyan").alias("new_color"))
    return c.join(new, "id", "left").select("id", F.coalesce("new_color", "color").alias("color"))


@query("i13_clear_session", f"WITH {a.TRANSCRIPT} SELECT session_id, count(*) AS n FROM transcript WHERE session_id % 3 <> 1 GROUP BY ALL")
def i13(spark, d):
    return a.transcript(spark, d).where("session_id % 3 <> 1").groupBy("session_id").agg(F.count("*").alias("n"))


@query(
    "s12_sliding_windows",
    """WITH w AS (SELECT user_id, ts, unnest(range(0, 4)) AS k FROM events), s AS (SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 6 HOUR AS start FROM w)
SELECT s.user_id, start, count(*) AS n FROM s JOIN (SELECT user_id, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY ALL) b ON s.user_id = b.user_id AND start >= lo AND start + INTERVAL 24 HOUR <= hi GROUP BY ALL""",
)
def s12(spark, d):
    e = table(spark, d, "events").select("user_id", "ts")
    span = e.groupBy("user_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    w = e.groupBy("user_id", F.window("ts", "24 hours", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return w.join(span, "user_id").where("w.start >= lo and w.end <= hi").select("user_id", F.col("w.start").alias("start"), "n")


@query("s3_identify")
def s3(spark, d):
    return idf.identify(a.segments(spark, d))


@query("e8_viterbi_smooth")
def e8(spark, d):
    return idf.viterbi_smooth(a.segments(spark, d), "session_id", "seg_ix", "speaker")


E7 = f"""WITH {a.CHUNKS}, o AS (SELECT stream_id, list(struct_pack(i := CAST(-1 AS BIGINT), first := CAST(NULL AS BIGINT), quiet := 0, loud := level >= 0.1,
 done := CAST([] AS STRUCT(first BIGINT, stop BIGINT)[])) ORDER BY seq) AS rows FROM chunks GROUP BY stream_id),
f AS (SELECT stream_id, len(rows) AS n, list_reduce(list_concat([struct_pack(i := CAST(-1 AS BIGINT), first := CAST(NULL AS BIGINT), quiet := 0, loud := false, done := CAST([] AS STRUCT(first BIGINT, stop BIGINT)[]))], rows),
 lambda s, x: CASE
 WHEN s.first IS NULL AND NOT x.loud THEN struct_pack(i := s.i + 1, first := s.first, quiet := s.quiet, loud := x.loud, done := s.done)
 WHEN NOT x.loud AND s.quiet + 1 >= 2 THEN struct_pack(i := s.i + 1, first := CAST(NULL AS BIGINT), quiet := 0, loud := x.loud,
  done := CASE WHEN s.i + 1 - s.quiet - coalesce(s.first, s.i + 1) >= 3 THEN list_append(s.done, struct_pack(first := coalesce(s.first, s.i + 1), stop := s.i + 1 - s.quiet)) ELSE s.done END)
 WHEN s.i + 1 - coalesce(s.first, s.i + 1) >= 20 THEN struct_pack(i := s.i + 1, first := CAST(NULL AS BIGINT), quiet := 0, loud := x.loud,
  done := list_append(s.done, struct_pack(first := coalesce(s.first, s.i + 1), stop := s.i + 2)))
 ELSE struct_pack(i := s.i + 1, first := coalesce(s.first, s.i + 1), quiet := CASE WHEN x.loud THEN 0 ELSE s.quiet + 1 END, loud := x.loud, done := s.done) END) AS s FROM o),
u AS (SELECT stream_id, unnest(CASE WHEN s.first IS NOT NULL AND n - s.first >= 3 THEN list_append(s.done, struct_pack(first := s.first, stop := n)) WHEN len(s.done) = 0 THEN [struct_pack(first := CAST(0 AS BIGINT), stop := n)] ELSE s.done END) AS u FROM f)
SELECT stream_id, u.first AS first, u.stop AS stop FROM u"""


@query("e7_speech_segments", E7)
def e7(spark, d):
    return speech_segments(a.chunks(spark, d), "stream_id", "seq", "level", limit=0.1, speech=3, silence=2, most=20)
