"""Streams by event time: the batch result whatever the micro-batches, late rows, closing sessions, matches."""

import datetime as dt

import numpy as np
import pytest

from parley.operators.identify import identify
from parley.operators.ordered import dedupe_recent, endpoint, prompt_budget

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=float(seconds))


class Feed:
    """Rows written as one file for each micro-batch and read one file at a time; the last file moves the watermark on."""

    def __init__(self, spark, folder, schema, batches):
        self.spark, self.folder, self.schema = spark, str(folder), schema
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in/part={i}")

    def stream(self, delay="100 seconds"):
        read = self.spark.readStream.schema(f"{self.schema}, part int").option("maxFilesPerTrigger", 1).option("latestFirst", "false")
        return read.parquet(f"{self.folder}/in").drop("part").withWatermark("ts", delay)

    def run(self, df, name, folder=None):
        query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
        dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
        return [tuple(r) for r in self.spark.table(name).collect()], dropped


def shuffled(rows, n, seed, window):
    """Rows in n batches, each out of order by at most ``window`` places."""
    draw = np.random.default_rng(seed)
    order = np.argsort(np.arange(len(rows)) + draw.uniform(0, window, len(rows)))
    return [[rows[i] for i in part] for part in np.array_split(order, n)]


def segments():
    draw = np.random.default_rng(5)
    voices, rows = draw.normal(size=(3, 12)), []
    for i in range(80):
        for session in (1, 2):
            x = voices[draw.integers(3)] + draw.normal(size=12) * (0.15 if i % 7 else 0.9)
            rows.append((session, i, x.tolist() if i % 11 else None, 1.0 if i % 13 == 5 else 3.0, 0.001 if i % 9 == 4 else 0.1, at(10 * i)))
    return rows


SEGMENTS = "session_id long, seg_ix long, embedding array<double>, duration_sec double, rms double, ts timestamp"


def test_identify_stream_equals_batch_and_closes_sessions(spark, tmp_path):
    from parley.streaming.sessions import identify_stream, session_mappings

    rows = segments()
    want = sorted(map(tuple, identify(spark.createDataFrame(rows, SEGMENTS)).collect()))
    again = [(1, 500, rows[0][2] or rows[2][2], 3.0, 0.1, at(5000)), (9, 0, None, 3.0, 0.1, at(9000))]
    feed = Feed(spark, tmp_path, SEGMENTS, [*shuffled(rows, 5, 1, 8), again[:1], again[1:]])
    got, dropped = feed.run(identify_stream(feed.stream(), idle=600), "identified")
    assert dropped == 0
    seen = sorted(r[:4] for r in got if r[3] != "closed" and r[1] != 500)
    assert seen == want
    counts = {}
    for s, _, who, what in want:
        counts[s, who] = counts.get((s, who), 0) + (what not in ("short", "kept"))
    closed = sorted((r[0], r[2], r[4]) for r in got if r[3] == "closed")
    assert (1, 1, 1) in closed, "the session that came back has one segment of speaker 1"
    closed.remove((1, 1, 1))
    assert sum(n for *_, n in closed) == sum(counts.values()) and {s for s, *_ in closed} == {1, 2}
    assert [r[2] for r in got if r[1] == 500] == [1], "and starts at speaker 1"
    identified = spark.table("identified")
    matched = spark.createDataFrame([(1, 1, "p7"), (2, 1, None)], "session_id long, speaker int, profile_id string")
    mapped = session_mappings(identified, matched).collect()
    assert {(r.session_id, r.profile_id, r.local_id) for r in mapped} == {(1, "p7", 1)}


def test_ordered_streams_equal_batch(spark, tmp_path):
    from parley.streaming.live import dedupe_stream, endpoint_stream, failure_stream, prompt_stream

    draw = np.random.default_rng(3)
    rows = [(s, i, bool(draw.random() < 0.6), f" Line {draw.integers(8)}.", 40 * i, at(40 * i)) for i in range(120) for s in (1, 2)]
    schema = "stream_id long, seq long, is_speech boolean, text string, t long, ts timestamp"
    df = spark.createDataFrame(rows, schema)
    late = (1, 3, True, "Line 3.", 120, at(120))
    end = (7, 0, False, "x", 99999, at(99999))
    feed = Feed(spark, tmp_path, schema, [*shuffled(rows, 5, 2, 4), [late], [end], [(8, 0, False, "y", 199999, at(199999))]])
    got, dropped = feed.run(endpoint_stream(feed.stream("400 seconds"), time="ts"), "by_time_ends")
    assert dropped == 1
    assert sorted(r for r in got if r[0] < 7) == sorted(map(tuple, endpoint(df).collect()))
    lines = lambda s: s.withColumnRenamed("stream_id", "session_id")
    got, _ = feed.run(dedupe_stream(lines(feed.stream("400 seconds")), time="ts"), "by_time_lines")
    assert sorted(r[:2] for r in got if r[0] < 7) == sorted(map(tuple, dedupe_recent(lines(df), "session_id", "seq", "text").collect()))
    got, _ = feed.run(prompt_stream(feed.stream("400 seconds"), "stream_id", time="ts"), "by_time_prompts")
    assert sorted(r for r in got if r[0] < 7) == sorted(map(tuple, prompt_budget(df, "stream_id", "t").collect()))
    got, _ = feed.run(failure_stream(feed.stream("400 seconds").where("not is_speech"), "stream_id", 200, 3, time="ts"), "by_time_failures")
    want = []
    for s in (1, 2):
        times = [r[4] for r in rows if r[0] == s and not r[2]]
        want += [(s, t, n) for t in times if (n := sum(t - 200 < x <= t for x in times)) >= 3]
    assert sorted(r for r in got if r[0] < 7) == sorted(want)


def test_matches_are_made_once(spark, tmp_path):
    from parley.streaming.sessions import match_stream, stable_stream

    axis = lambda i, e=0.0: [float(i == j) + e * (j == 5) for j in range(6)]
    rows = [(1, speaker, 10 * i + speaker, axis(speaker, 0.01 * i), at(60 * i)) for i in range(12) for speaker in (0, 1)]
    schema = "session_id long, speaker int, seg_ix long, embedding array<double>, ts timestamp"
    tail = [(5, 0, 900 + i, axis(4), at(5000 + 1000 * i)) for i in range(2)]
    versions = {"now": spark.createDataFrame([("a", "Ann", axis(0), 30)], "id string, name string, centroid array<double>, n long")}
    out, mark = str(tmp_path / "matches"), str(tmp_path / "mark")
    feed = Feed(spark, tmp_path, schema, [rows[:8], rows[8:16]])
    run = lambda: match_stream(stable_stream(feed.stream("10 seconds")), lambda: versions["now"], out, mark, available_now=True).awaitTermination(300)
    run()
    first = {tuple(r)[:7] for r in spark.read.parquet(out).drop("batch").collect()}
    assert {(r[0], r[1], r[3], r[4], r[5]) for r in first} == {(1, 0, "high", "a", "Ann")}
    versions["now"] = spark.createDataFrame([("b", "Bob", axis(0), 30), ("c", "Cid", axis(1), 30)], "id string, name string, centroid array<double>, n long")
    Feed(spark, tmp_path, schema, [])
    for i, part in enumerate([rows[16:], tail]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/part={10 + i}")
    run()
    after = {(r.session_id, r.speaker, r.tier, r.profile_id, r.name) for r in spark.read.parquet(out).collect()}
    assert after == {(1, 0, "high", "a", "Ann"), (1, 1, "high", "c", "Cid")}, "the first match stays; an open speaker finds the new version"


@pytest.mark.parametrize("labels", [1, 2, 5])
def test_viterbi_stream_equals_whole(spark, labels):
    from parley.operators import regroup
    from parley.operators.identify import viterbi_smooth

    draw = np.random.default_rng(labels)
    rows, want = [], {}
    for session in range(4):
        turns = np.repeat(draw.integers(0, labels, 60), draw.integers(1, 40, 60))
        seen = np.where(draw.random(len(turns)) < 0.2, draw.integers(0, labels, len(turns)), turns)
        rows += [(session, i, int(v) * 3) for i, v in enumerate(seen)]
        names, at_ = np.unique(seen, return_inverse=True)
        want[session] = (names[regroup.viterbi(at_, len(names))] * 3).tolist()
    rows += [(9, 0, 5), (None, 1, 4), (None, 2, 4)]
    got = {}
    for r in viterbi_smooth(spark.createDataFrame(rows, "s long, i long, label int"), "s", "i", "label").orderBy("s", "i").collect():
        got.setdefault(r.s, []).append(r.label)
    assert got == {**want, 9: [5], None: [4, 4]}


def test_viterbi_holds_little_of_a_long_session():
    from parley.operators import regroup
    from parley.operators.identify import Viterbi

    draw = np.random.default_rng(0)
    seen = np.where(draw.random(60_000) < 0.1, draw.integers(0, 4, 60_000), np.repeat(np.arange(600) % 4, 100))
    machine, out, most = Viterbi(0.99, 0.9), [], 0
    machine.row(0, None, None, [0, 1, 2, 3])
    for i, v in enumerate(seen.tolist()):
        out.extend(machine.row(1, i, v, None))
        most = max(most, len(machine.open))
    out.extend(machine.end())
    assert [v for _, v in out] == regroup.viterbi(seen, 4).tolist() and [i for i, _ in out] == list(range(len(seen)))
    assert most < 1000


def test_windows_drop_late_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    from parley.streaming.windows import sessions, sliding, tumbling

    schema = "user long, value double, ts timestamp"
    draw = np.random.default_rng(6)
    times = np.cumsum(draw.integers(5, 90, 60))
    rows = [(int(i % 2), float(i), at(t)) for i, t in enumerate(times)]
    end = (9, 0.0, at(99999))
    feed = Feed(spark, tmp_path, schema, [*shuffled(rows, 4, 3, 3), [end], [(1, 5.0, at(times[3]))]])
    batch, sums = spark.createDataFrame(rows, schema), [F.count("*").alias("n"), F.sum("value").alias("total")]
    for n, make in enumerate((lambda df: tumbling(df, ["user"], "ts", "5 minutes", sums), lambda df: sliding(df, ["user"], "ts", "5 minutes", "2 minutes", sums), lambda df: sessions(df, ["user"], "ts", "100 seconds", sums))):
        got, dropped = feed.run(make(feed.stream("600 seconds")), f"windows{n}")
        assert dropped >= 1
        assert sorted(r for r in got if r[0] < 9) == sorted(map(tuple, make(batch).collect()))


def test_chunks_to_speakers_in_one_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from parley.operators.embedding import with_embeddings
    from parley.sources.tables import chunk_source
    from parley.streaming.sessions import identify_stream

    draw = np.random.default_rng(8)
    wave = lambda hz: (np.sin(np.arange(800) * hz / 100) + draw.normal(size=800) * 0.01).tolist()
    rows = [(s, i, at(2 * i), wave(5 + 30 * (i % 2))) for i in range(12) for s in (1, 2)] + [(9, 0, at(9000), wave(1)), (9, 1, at(19000), wave(1))]
    schema = "stream_id bigint, seq bigint, ts timestamp, samples array<float>"
    for n, part in enumerate((rows[:10], rows[10:24], rows[24:25], rows[25:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def prepared(df):
        heard = with_embeddings(df).select(F.col("stream_id").alias("session_id"), F.col("seq").alias("seg_ix"), "embedding", F.lit(2.0).alias("duration_sec"), F.lit(0.1).alias("rms"), "ts")
        return heard

    live = identify_stream(prepared(chunk_source(spark, f"{tmp_path}/in", 1).withWatermark("ts", "60 seconds")))
    query = live.writeStream.format("memory").queryName("spoken").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = sorted((r.session_id, r.seg_ix, r.speaker_id, r.outcome) for r in spark.table("spoken").collect() if r.session_id < 9)
    want = identify(prepared(spark.read.schema(schema).parquet(f"{tmp_path}/in"))).where("session_id < 9")
    assert got == sorted(map(tuple, want.collect())) and len(got) == 24
