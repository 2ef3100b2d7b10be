"""Queries on chunk streams, intervals, incidents and settings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parley.functions import rules as r
from parley.functions.signal import settings
from parley.operators import intervals as iv
from parley.operators import maintenance as mt
from parley.operators import ordered
from parley.plans import adapters as a
from parley.plans.registry import query, table

S1 = f"""WITH {a.CHUNKS}, o AS (SELECT stream_id, list(struct_pack(seq := seq, sp := is_speech) ORDER BY seq) AS rows FROM chunks GROUP BY stream_id),
i AS (SELECT stream_id, list_concat([struct_pack(had := false, sil := 0, first := CAST(NULL AS BIGINT), n := 0, seq := CAST(0 AS BIGINT), sp := false, done := CAST([] AS STRUCT(first BIGINT, last BIGINT, n_chunks INTEGER)[]))],
 list_transform(rows, lambda r: struct_pack(had := false, sil := 0, first := CAST(NULL AS BIGINT), n := 0, seq := r.seq, sp := r.sp, done := CAST([] AS STRUCT(first BIGINT, last BIGINT, n_chunks INTEGER)[])))) AS rows FROM o),
f AS (SELECT stream_id, list_reduce(rows, lambda s, x: CASE
 WHEN ((s.had OR x.sp) AND (CASE WHEN x.sp THEN 0 ELSE s.sil + 1 END) * 0.064 > 0.3 AND (s.n + CASE WHEN s.had OR x.sp THEN 1 ELSE 0 END) * 0.064 > 1.0)
   OR (s.n + CASE WHEN s.had OR x.sp THEN 1 ELSE 0 END) * 0.064 >= 3.0
 THEN struct_pack(had := false, sil := 0, first := CAST(NULL AS BIGINT), n := 0, seq := x.seq, sp := x.sp,
   done := list_append(s.done, struct_pack(first := coalesce(s.first, x.seq), last := x.seq, n_chunks := s.n + CASE WHEN s.had OR x.sp THEN 1 ELSE 0 END)))
 ELSE struct_pack(had := s.had OR x.sp, sil := CASE WHEN x.sp THEN 0 ELSE s.sil + 1 END, first := CASE WHEN s.had OR x.sp THEN coalesce(s.first, x.seq) END,
   n := s.n + CASE WHEN s.had OR x.sp THEN 1 ELSE 0 END, seq := x.seq, sp := x.sp, done := s.done) END) AS s FROM i),
u AS (SELECT stream_id, unnest(s.done) AS u FROM f) SELECT stream_id, u.first AS first, u.last AS last, u.n_chunks AS n_chunks FROM u"""


@query("s1_endpoint", S1)
def s1(spark, d):
    return ordered.endpoint(a.chunks(spark, d))


@query(
    "e6_silence_runs",
    f"WITH {a.CHUNKS}, g AS (SELECT *, seq - row_number() OVER (PARTITION BY stream_id, is_speech ORDER BY seq) AS island FROM chunks) "
    "SELECT stream_id, min(seq) AS first, count(*) AS run, round(CAST(count(*) * 0.064 AS DOUBLE), 6) AS seconds FROM g WHERE NOT is_speech GROUP BY stream_id, island",
)
def e6(spark, d):
    w = Window.partitionBy("stream_id", "is_speech").orderBy("seq")
    g = a.chunks(spark, d).withColumn("island", F.col("seq") - F.row_number().over(w)).where(~F.col("is_speech"))
    g = g.groupBy("stream_id", "island").agg(F.min("seq").alias("first"), F.count("*").alias("run"))
    return g.select("stream_id", "first", "run", F.round(F.col("run") * 0.064, 6).alias("seconds"))


@query("b1_is_speech", f"WITH {a.CHUNKS}, c AS (SELECT *, CASE WHEN seq % 3 > 0 THEN level * 10 END AS prob FROM chunks) SELECT stream_id, seq, CASE WHEN prob IS NULL THEN level >= 0.012 ELSE prob >= 0.5 END AS speech FROM c")
def b1(spark, d):
    prob = F.when(F.col("seq") % 3 > 0, F.col("level") * 10)
    return a.chunks(spark, d).select("stream_id", "seq", r.is_speech(prob, F.col("level")).alias("speech"))


@query("f5_bounded_buffer", f"WITH {a.CHUNKS} SELECT stream_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY seq DESC) AS rn FROM chunks) WHERE rn <= 500")
def f5(spark, d):
    w = Window.partitionBy("stream_id").orderBy(F.desc("seq"))
    return a.chunks(spark, d).withColumn("rn", F.row_number().over(w)).where("rn <= 500").select("stream_id", "seq")


E12 = "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 259199999999 PRECEDING AND CURRENT ROW) AS failures FROM events WHERE event_type = 'error'"


@query("e12_restart_pressure", E12)
def e12(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'")
    return r.failure_bursts(e, "user_id", "ts", 3 * 86400, 1).select("event_id", "failures")


@query(
    "f3_newest_incidents",
    "SELECT event_id, user_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY user_id, kind, exempt ORDER BY ts DESC, event_id DESC) AS rn FROM "
    "(SELECT *, CASE WHEN event_id % 3 = 0 THEN 'json' ELSE 'log' END AS kind, event_type = 'error' AND event_id % 3 > 0 AS exempt FROM events)) WHERE exempt OR rn <= 50",
)
def f3(spark, d):
    e = table(spark, d, "events").withColumn("kind", F.when(F.col("event_id") % 3 == 0, "json").otherwise("log"))
    exempt = (F.col("event_type") == "error") & (F.col("kind") == "log")
    return mt.newest(e, ["user_id", "kind"], [F.desc("ts"), F.desc("event_id")], 50, exempt).select("event_id", "user_id", "kind")


@query("e14_slowness_tier", "SELECT event_id, CASE WHEN value > 30 THEN 'hung' WHEN value > 15 THEN 'reset' WHEN value > 8 THEN 'slow' ELSE 'ok' END AS tier FROM events")
def e14(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.when(v > 30, "hung").when(v > 15, "reset").when(v > 8, "slow").otherwise("ok").alias("tier"))


@query(
    "a14_read_settings",
    """WITH d AS (SELECT event_id, props, CASE WHEN json_type(props, '$.k') IN ('BIGINT', 'UBIGINT') THEN json_extract_string(props, '$.k') ELSE '0' END AS k,
 CASE WHEN json_type(props, '$.name') = 'VARCHAR' THEN json_extract_string(props, '$.name') ELSE 'none' END AS name FROM events)
SELECT event_id, 'k' AS key, k AS val FROM d UNION ALL SELECT event_id, 'name', name FROM d
UNION ALL SELECT event_id, key, json_extract_string(props, '$.' || key) FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM d) WHERE key NOT IN ('k', 'name')""",
)
def a14(spark, d):
    found = settings(F.col("props"), {"k": ("int", 0), "name": ("string", "none")})
    return table(spark, d, "events").select("event_id", F.explode(found).alias("key", "val"))


@query("s11_tumbling", "SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def s11(spark, d):
    g = table(spark, d, "events").groupBy("user_id", F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("user_id", F.col("w.start").alias("start"), "n", "total")


@query(
    "s13_session_windows",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""",
)
def s13(spark, d):
    g = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")


FRAMES = f"""WITH {a.INTERVALS}, fr AS (SELECT file_id, unnest(range(0, CAST(floor(m) AS BIGINT) + 1)) AS frame FROM (SELECT file_id, max("end") AS m FROM ref GROUP BY file_id)),
fl AS (SELECT file_id, frame, frame * 1.0 AS t FROM fr),
r AS (SELECT f.file_id, frame, speaker FROM fl f JOIN ref s ON f.file_id = s.file_id AND s.start <= t AND t < s."end"),
h AS (SELECT f.file_id, frame, speaker_id FROM fl f JOIN hyp s ON f.file_id = s.file_id AND s.start <= t AND t < s."end")"""


@query("c9_speakers_at", f"{FRAMES} SELECT file_id, frame, speaker, count(*) AS n FROM r GROUP BY ALL")
def c9(spark, d):
    ref, _ = a.intervals(spark, d)
    return iv.speakers_at_frames(ref, ref, 1.0).groupBy("file_id", "frame", "speaker").agg(F.count("*").alias("n"))


@query("d8_cooccurrence", f"{FRAMES} SELECT file_id, speaker_id, speaker, count(*) AS n_frames FROM r JOIN h USING (file_id, frame) GROUP BY ALL")
def d8(spark, d):
    ref, hyp = a.intervals(spark, d)
    return iv.cooccurrence(hyp, ref, 1.0).drop("first_frame")


@query(
    "c10_near_boundary",
    f"""{FRAMES} SELECT DISTINCT f.file_id, frame FROM fl f JOIN ref s ON f.file_id = s.file_id AND (abs(t - s.start) < 0.25 OR abs(t - s."end") < 0.25)""",
)
def c10(spark, d):
    ref, _ = a.intervals(spark, d)
    return iv.near_boundary(iv.frames(ref, 1.0), ref, 0.25, 24.0).select("file_id", "frame")


@query(
    "d10_dominant_speaker",
    f"{FRAMES} SELECT file_id, frame, speaker FROM (SELECT *, row_number() OVER (PARTITION BY file_id, frame ORDER BY n DESC, speaker) AS rn FROM (SELECT file_id, frame, speaker, count(*) AS n FROM r GROUP BY ALL)) WHERE rn = 1",
)
def d10(spark, d):
    ref, _ = a.intervals(spark, d)
    return iv.dominant_speaker(iv.speakers_at_frames(ref, ref, 1.0))


@query(
    "d11_consistency",
    f"""{FRAMES}, c AS (SELECT file_id, speaker, speaker_id, count(*) AS n FROM r JOIN h USING (file_id, frame) GROUP BY ALL),
e AS (SELECT file_id, speaker, max(n) AS most, sum(n) AS n FROM c GROUP BY ALL)
SELECT file_id, speaker, round(sum(most) * 1.0 / sum(n), 6) AS share FROM e GROUP BY ROLLUP (file_id, speaker)""",
)
def d11(spark, d):
    ref, hyp = a.intervals(spark, d)
    return iv.consistency(iv.cooccurrence(hyp, ref, 1.0)).withColumn("share", F.round("share", 6))


@query(
    "d9_der",
    f"""{FRAMES}, nb AS (SELECT DISTINCT f.file_id, frame FROM fl f JOIN ref s ON f.file_id = s.file_id AND (abs(t - s.start) < 0.25 OR abs(t - s."end") < 0.25)),
c AS (SELECT file_id, speaker_id, speaker, count(*) AS n, min(frame) AS f FROM r JOIN h USING (file_id, frame) GROUP BY ALL),
g AS (SELECT file_id, list(struct_pack(l := speaker_id, r := speaker) ORDER BY n DESC, f, speaker_id, speaker) AS items FROM c GROUP BY file_id),
w AS (SELECT file_id, unnest(list_reduce(list_concat([list_filter(items, lambda x: false)], list_transform(items, lambda x: [x])),
 lambda s, x: CASE WHEN len(list_filter(s, lambda y: y.l = x[1].l OR y.r = x[1].r)) = 0 THEN list_append(s, x[1]) ELSE s END)) AS p FROM g),
rs AS (SELECT file_id, frame, list(DISTINCT '=' || speaker) AS r FROM r ANTI JOIN nb USING (file_id, frame) GROUP BY ALL),
hn AS (SELECT h.file_id, h.frame, coalesce('=' || w.p.r, '?' || h.speaker_id) AS who FROM h LEFT JOIN w ON h.file_id = w.file_id AND h.speaker_id = w.p.l),
hs AS (SELECT file_id, frame, list(DISTINCT who) AS h FROM hn ANTI JOIN nb USING (file_id, frame) GROUP BY ALL),
b AS (SELECT file_id, coalesce(len(r), 0) AS nr, coalesce(len(h), 0) AS nh, coalesce(len(list_intersect(r, h)), 0) AS same FROM rs FULL JOIN hs USING (file_id, frame)),
s AS (SELECT file_id, CAST(sum(greatest(0, nr - nh)) AS BIGINT) AS miss, CAST(sum(greatest(0, nh - nr)) AS BIGINT) AS fa,
 CAST(sum(least(nr, nh) - same) AS BIGINT) AS confusion, CAST(sum(nr) AS BIGINT) AS speech FROM b GROUP BY file_id)
SELECT *, round((miss + fa + confusion) * 1.0 / greatest(speech, 1), 9) AS der FROM s""",
)
def d9(spark, d):
    ref, hyp = a.intervals(spark, d)
    return iv.der(ref, hyp, 1.0, 0.25).withColumn("der", F.round("der", 9))


@query("b8_ref_segments_min", f'WITH {a.INTERVALS} SELECT file_id, speaker, count(*) AS n FROM ref WHERE "end" - start >= 1.5 GROUP BY ALL')
def b8(spark, d):
    ref, _ = a.intervals(spark, d)
    return ref.where("end - start >= 1.5").groupBy("file_id", "speaker").agg(F.count("*").alias("n"))


@query(
    "c11_mix_streams",
    f"WITH {a.CHUNKS}, p AS (SELECT (stream_id + 1) // 2 AS pair, stream_id % 2 AS side, seq, level FROM chunks), m AS (SELECT * FROM p WHERE side = 1), s AS (SELECT * FROM p WHERE side = 0) "
    "SELECT coalesce(m.pair, s.pair) AS pair, coalesce(m.seq, s.seq) AS seq, round(CASE WHEN m.seq IS NULL THEN s.level WHEN s.seq IS NULL THEN m.level ELSE greatest(-1.0, least(1.0, m.level + s.level)) END, 9) AS level FROM m FULL JOIN s ON m.pair = s.pair AND m.seq = s.seq",
)
def c11(spark, d):
    c = a.chunks(spark, d).withColumn("pair", F.floor((F.col("stream_id") + 1) / 2))
    m, s = (c.where(f"stream_id % 2 = {i % 2}").select("pair", "seq", F.col("level").alias(f"l{i}")) for i in (1, 2))
    both = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("l1") + F.col("l2")))
    return m.join(s, ["pair", "seq"], "full_outer").select("pair", "seq", F.round(F.coalesce(F.when(F.col("l1").isNotNull() & F.col("l2").isNotNull(), both), "l1", "l2"), 9).alias("level"))


SMOOTH = "SELECT stream_id, seq, CASE WHEN p IS NULL OR q IS NULL THEN level ELSE (p + 2 * level + q) / 4 END AS level FROM (SELECT *, lag(level) OVER w AS p, lead(level) OVER w AS q FROM {0} WINDOW w AS (PARTITION BY stream_id ORDER BY seq))"


@query("e9_smooth3", f"WITH {a.CHUNKS}, x1 AS ({SMOOTH.format('chunks')}), x2 AS ({SMOOTH.format('x1')}), x3 AS ({SMOOTH.format('x2')}) SELECT stream_id, seq, round(level, 9) AS x FROM x3")
def e9(spark, d):
    rows = ordered.smooth(a.chunks(spark, d), "stream_id", "seq", "level")
    return rows.select("stream_id", "seq", F.round("level", 9).alias("x"))


@query("g3_distinct_speakers", f"WITH {a.INTERVALS} SELECT DISTINCT file_id, speaker FROM ref")
def g3(spark, d):
    return a.intervals(spark, d)[0].select("file_id", "speaker").distinct()
