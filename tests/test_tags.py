"""Several speakers, regrouping, tags, tables and bounded streams on small inputs."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from parley.functions.signal import setting
from parley.operators import regroup
from parley.operators import tags as tg
from parley.operators.exports import markdown_lines, write_lines
from parley.operators.identify import Limits, Session, identify_multi
from parley.operators.ordered import min_gap_points, prompt_budget, scd_segments, speech_segments
from parley.operators.scatter import whiten, within_scatter
from parley.sources import tables
from parley.streaming.live import failure_stream, prompt_stream

TURNS = "session_id long, seg_ix long, local_ix int, embedding array<double>, first_frame long, last_frame long, duration_sec double, rms double"


def axis(i, n=12):
    return [float(i == j) for j in range(n)]


def test_identify_multi(spark):
    rows = [
        (1, 0, 0, axis(0), 0, 9, 3.0, 0.1), (1, 0, 1, axis(1), 5, 19, 3.0, 0.1),
        (1, 1, 0, axis(1), 0, 9, 3.0, 0.1), (1, 1, 1, axis(2), 2, 4, 3.0, 0.1), (1, 1, 2, None, 2, 4, 3.0, 0.1),
        (1, 2, 0, axis(2), 0, 0, 3.0, 0.1), (2, 0, 0, None, 0, 0, 3.0, 0.1),
    ]
    got = {(r.session_id, r.seg_ix, r.local_ix): (r.speaker_id, r.start, r.stop, r.outcome) for r in identify_multi(spark.createDataFrame(rows, TURNS)).collect()}
    assert got == {
        (1, 0, 0): (1, 0, 2700, "several"), (1, 0, 1): (2, 1350, 5400, "several"), (1, 1, 0): (2, 0, 2700, "several"),
        (1, 1, 1): (3, 540, 1350, "several"), (1, 2, 0): (3, 0, 270, "several"), (2, 0, 0): (1, 0, 48000, "short"),
    }
    # A single poor voice opens a speaker too, its span ends with the audio, and a short utterance takes the last speaker that one alone was given.
    one = [(3, 0, 0, axis(0), 0, 9, 2.0, 0.1), (3, 1, 0, axis(1), 100, 900, 2.0, 0.0005), (3, 2, 0, axis(5), 0, 3, 1.0, 0.1), (3, 2, 1, axis(6), 0, 3, 1.0, 0.1)]
    got = [(r.seg_ix, r.local_ix, r.speaker_id, r.start, r.stop, r.outcome) for r in identify_multi(spark.createDataFrame(one, TURNS)).orderBy("seg_ix").collect()]
    assert got == [(0, 0, 1, 0, 2700, "several"), (1, 0, 2, 27000, 32000, "several"), (2, 0, 1, 0, 16000, "short")]
    many = [(1, 0, i, axis(i), 0, 1, 3.0, 0.1) for i in range(10)]
    ids = [r.speaker_id for r in identify_multi(spark.createDataFrame(many, TURNS)).collect()]
    assert sorted(ids) == list(range(1, 9)), "two local speakers find no free id"


def test_upkeep_merges_speakers():
    s = Session(Limits())
    for i in range(6):
        s.record(s.open(np.array([1.0, 0.1 * i, 0.0])) if i < 2 else 1, np.array([1.0, 0.1 * i, 0.0]))
    assert list(s.who) == [1, 2] and s.who[1].n == 5
    s.merge_closest()
    assert list(s.who) == [1] and s.who[1].n == 6 and [x for x, _ in s.who[1].held] == list(range(6))


def test_spectral_labels():
    rng = np.random.default_rng(1)
    groups = np.repeat(np.eye(8)[:2], 10, axis=0) + 0.02 * rng.standard_normal((20, 8))
    labels = regroup.spectral_labels(groups, 4)
    assert len(set(labels[:10])) == 1 and len(set(labels[10:])) == 1 and labels[0] != labels[-1]
    assert regroup.spectral_labels(groups, 2) is None and regroup.spectral_labels(groups[:3], 4) is None
    assert sorted(np.bincount(regroup.kmeans_pp(groups, 2))) == [10, 10] and len(regroup.kmeans_pp(np.ones((5, 2)), 3)) == 5


def test_scd_and_spacing(spark):
    at = [0, 16000, 32000, 40000, 80000]
    df = spark.createDataFrame([(1, x, x in (16000, 32000, 40000), 100000) for x in at] + [(2, 0, None, 30000), (3, 0, True, 90000)], "s long, at long, far boolean, total long")
    got = {(r.s, r.start, r.stop) for r in scd_segments(df, "s", "at", "far", "total").collect()}
    assert got == {(1, 0, 32000), (1, 32000, 100000), (2, 0, 30000), (3, 0, 90000)}
    short = spark.createDataFrame([(1, 0, False, 50000), (1, 30000, True, 50000)], "s long, at long, far boolean, total long")
    assert [(r.start, r.stop) for r in scd_segments(short, "s", "at", "far", "total").collect()] == [(0, 30000)], "the short tail goes"
    points = spark.createDataFrame([(1, x) for x in (5.0, 10.0, 14.0, 20.0)] + [(None, 30.0)], "k long, x double")
    assert sorted(r.x for r in min_gap_points(points, "k", "x", 10.0).collect()) == [10.0, 20.0, 30.0]


def test_speech_segments(spark):
    loud = [0] * 3 + [1] * 5 + [0] * 4 + [1] * 2 + [0] * 2
    frames = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(loud)] + [(2, 0, 0.0), (2, 1, None)], "k long, i long, p double")
    got = {(r.k, r["first"], r["stop"]) for r in speech_segments(frames, "k", "i", "p", speech=3, silence=2).collect()}
    assert got == {(1, 3, 8), (2, 0, 2)}


def test_tags(spark):
    seg = "session_id long, speaker int, seg_ix long, embedding array<double>, duration_sec double"
    rows = [(1, 1, 0, axis(0), 4.0), (1, 1, 1, axis(1), 1.0), (1, 2, 2, axis(2), 1.0), (2, 1, 3, axis(3), 5.0), (2, 2, 4, axis(4), 5.0), (1, 3, 5, None, 5.0)]
    tags = spark.createDataFrame([(1, 1, "ANN"), (1, 2, "Bob"), (2, 1, "bob"), (1, 3, "Cy")], "session_id long, speaker int, name string")
    known = spark.createDataFrame([("a", "Ann", [axis(5)])], "id string, name string, exemplars array<array<double>>")
    old, new, mapping = tg.apply_tags(tags, spark.createDataFrame(rows, seg), known)
    assert [(r.id, len(r.exemplars), r.confirmed_count, r.total_duration_sec) for r in old.collect()] == [("a", 2, 1, 4.0)]
    bob = new.first()
    assert new.count() == 1 and (bob.confirmed_count, bob.total_duration_sec, bob.quality) == (2, 6.0, 0.0) and np.isclose(np.linalg.norm(bob.centroid), 1)
    assert {(r.session_id, r.speaker, r.profile_id) for r in mapping.collect()} == {(1, 1, "a"), (1, 2, bob.id), (2, 1, bob.id)}
    merges = spark.createDataFrame([(1, 1, 2), (2, 1, 2)], "session_id long, source int, target int")
    assert {(r.source, r.target) for r in tg.merged_profiles(merges, mapping).collect()} == {("a", bob.id)}
    assert {(r.session_id, r.speaker) for r in tg.merge_speakers(tags, merges).collect()} == {(1, 2), (1, 3), (2, 2)}


def test_match_once(spark):
    seg = "session_id long, speaker int, seg_ix long, embedding array<double>, duration_sec double"
    rows = [(1, 1, i, axis(0), 2.0 + i) for i in range(6)] + [(1, 2, i, axis(i), 9.0) for i in range(2)]
    profiles = spark.createDataFrame([("a", "Ann", axis(0), 12), ("b", "Bob", axis(1), 2)], "id string, name string, centroid array<double>, n long")
    found = tg.match_once(spark.createDataFrame(rows, seg), profiles)
    assert [(r.session_id, r.speaker, r.seg_ix, r.tier, r.profile_id, r.name) for r in found.collect()] == [(1, 1, 2, "high", "a", "Ann")]
    assert [r.seq for r in tg.long_auto_update(spark.createDataFrame(rows, seg), found, profiles).orderBy("seq").collect()] == [1, 2]


def test_tables(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS voices LOCATION '{tmp_path}/voices'")
    assert tables.init_schema(spark, "voices") == 1 and tables.init_schema(spark, "voices") == 1
    spark.sql("INSERT INTO voices.profiles (id, name) VALUES ('a', 'Ann')")
    days = [datetime.date(2024, 1, d) for d in range(1, 10)]
    for d in (*days, days[-1]):
        kept = tables.snapshot(spark, "voices", d)
    assert kept == [d.isoformat() for d in days[2:]] and spark.table("voices.snapshots").count() == 7
    tables.export_profiles(spark.table("voices.profiles"), f"{tmp_path}/copy")
    assert spark.read.parquet(f"{tmp_path}/copy").first().name == "Ann"
    tables.delete_all(spark, "voices")
    assert spark.table("voices.profiles").count() == 0 and spark.table("voices.snapshots").count() == 0
    spark.sql("DROP DATABASE voices CASCADE")


def test_exports_and_settings(spark, tmp_path):
    lines = spark.createDataFrame([(1, 1, "00:01", "ann", "b"), (1, 0, "00:00", None, "a")], "session_id long, seq int, ts string, speaker string, content string")
    head = spark.createDataFrame([(1, "2024-01-01", "10:00", "m", None)], "session_id long, day string, time string, model string, language string")
    got = [r.line for r in markdown_lines(lines, head).orderBy("line_ix").collect()]
    assert got == ["# Transcript", "", "- **Date:** 2024-01-01", "- **Time:** 10:00", "- **Model:** m", "", "---", "**[00:00]** a", "**[00:01]** **ann:** b"]
    write_lines(markdown_lines(lines, head), f"{tmp_path}/out")
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").select("value").collect()] == got
    docs = spark.createDataFrame([('{"k": 3}',), ('{"k": "3"}',), ("{broken",), (None,)], "d string")
    assert [r.k for r in docs.select(setting(F.col("d"), "k", "int", 7).alias("k")).collect()] == [3, 7, 7, 7]


def test_whiten(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 3)) @ np.array([[2.0, 1, 0], [0, 1, 0], [0, 0, 0.1]]) + np.repeat(np.eye(3)[:2] * 5, 200, axis=0)
    df = spark.createDataFrame([(i, i // 200, v.tolist()) for i, v in enumerate(x)], "i long, who long, v array<double>")
    cells = within_scatter(whiten(df, "who", "v"), "who", "v", ridge=0.0).collect()
    assert all(abs(c.x - (c.i == c.j)) < 0.02 for c in cells)
    assert whiten(df.where("i < 3"), "who", "v").count() == 3


def test_streams_equal_batches(spark, tmp_path):
    times = [0, 10, 20, 30, 40, 50, 310, 650, 700, 800, 801, 802]
    df = spark.createDataFrame([(1, t) for t in times], "session_id long, t long")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    for name, made in (("shown", prompt_stream(stream())), ("bursts", failure_stream(stream(), "session_id"))):
        q = made.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    want = [r.t for r in prompt_budget(df, "session_id", "t").orderBy("t").collect()]
    assert [r.t for r in spark.sql("select t from shown order by t").collect()] == want == [0, 10, 20, 30, 40, 650, 800]
    assert spark.sql("select max(failures) as m from bursts").first().m == 6
