"""Speaker identity, smoothing, sources and streams on small inputs."""

import struct

import numpy as np
import pytest

from parley.operators.identify import identify, viterbi_smooth
from parley.sources.rttm import read_rttm, write_rttm
from parley.sources.wav import read_wav_corpus

A, B = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
SEGMENTS = "session_id long, seg_ix long, embedding array<float>, duration_sec double, rms double"


def test_identify(spark):
    rows = [
        (1, 0, A, 2.0, 0.1), (1, 1, B, 2.0, 0.1), (1, 2, A, 2.0, 0.1), (1, 3, B, 0.5, 0.1), (1, 4, [0.0, 0.0, 1.0], 2.0, 0.001),
        (1, 5, None, 2.0, 0.1), (2, 0, B, 2.0, 0.1),
    ]
    got = {(r.session_id, r.seg_ix): (r.speaker_id, r.outcome) for r in identify(spark.createDataFrame(rows, SEGMENTS)).collect()}
    assert got == {
        (1, 0): (1, "new"), (1, 1): (2, "new"), (1, 2): (1, "match"), (1, 3): (1, "short"), (1, 4): (1, "kept"), (1, 5): (1, "short"), (2, 0): (1, "new"),
    }


def test_identify_stops_at_the_cap(spark):
    rows = [(1, i, [float(i == j) for j in range(12)], 2.0, 0.1) for i in range(12)]
    got = identify(spark.createDataFrame(rows, SEGMENTS)).collect()
    assert max(r.speaker_id for r in got) == 8 and sum(r.outcome == "new" for r in got) == 8


@pytest.mark.parametrize(("labels", "turns"), [([0] * 10 + [1] * 10 + [0] * 10, 2), ([0] * 20, 0), ([0, 1], 1)])
def test_viterbi_keeps_turns(spark, labels, turns):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(labels)], "s long, i long, x long")
    got = [r.x for r in viterbi_smooth(df, "s", "i", "x").orderBy("i").collect()]
    assert sum(a != b for a, b in zip(got, got[1:])) <= turns and len(got) == len(labels)
    if len(labels) > 2:
        assert got == labels


def test_viterbi_drops_flicker(spark):
    df = spark.createDataFrame([(1, i, i % 2) for i in range(10)], "s long, i long, x long")
    got = [r.x for r in viterbi_smooth(df, "s", "i", "x").orderBy("i").collect()]
    assert sum(a != b for a, b in zip(got, got[1:])) < 9


def test_rttm(spark, tmp_path):
    (tmp_path / "a.rttm").write_text(
        "SPKR-INFO f 1 <NA> <NA> <NA> unknown a <NA>\nSPEAKER f 1 0.50 1.25 <NA> <NA> a <NA>\n  SPEAKER   g 1 2 1 <NA> <NA> b <NA> <NA>\nSPEAKER short\n\n"
    )
    got = read_rttm(spark, str(tmp_path / "a.rttm"))
    assert sorted(map(tuple, got.collect())) == [("f", "a", 0.5, 1.75), ("g", "b", 2.0, 3.0)]
    assert read_rttm(spark, str(tmp_path / "a.rttm"), "g").count() == 1
    write_rttm(got, str(tmp_path / "out"))
    assert sorted(map(tuple, read_rttm(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, got.collect()))


def _wav(code, bits, body):
    fmt = struct.pack("<HHIIHH", code, 1, 16000, 16000 * bits // 8, bits // 8, bits)
    body = b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WAVE" + body


def test_wav(spark, tmp_path):
    x = np.linspace(-1, 0.5, 2500)
    (tmp_path / "a.wav").write_bytes(_wav(3, 32, x.astype("<f4").tobytes()))
    (tmp_path / "b.wav").write_bytes(_wav(1, 16, (x * 32768).clip(-32768, 32767).astype("<i2").tobytes()))
    (tmp_path / "c.wav").write_bytes(b"no sound")
    got = read_wav_corpus(spark, str(tmp_path / "*.wav")).collect()
    for name in "ab":
        parts = sorted((r.chunk_ix, r.samples) for r in got if r.path.endswith(f"{name}.wav"))
        assert [len(s) for _, s in parts] == [1024, 1024, 452]
        assert np.allclose(np.concatenate([s for _, s in parts]), x, atol=1e-4)
    assert [r.error for r in got if r.path.endswith("c.wav")] == ["not a RIFF/WAVE file"]
    assert read_wav_corpus(spark, str(tmp_path / "a.wav"), 1000 / 16000).collect()[0].samples[-1] == pytest.approx(x[999], abs=1e-6)


def test_streams_equal_batch(spark, tmp_path):
    from parley.operators.ordered import dedupe_recent, endpoint
    from parley.streaming.live import append_live, dedupe_stream, endpoint_stream

    rng = np.random.default_rng(3)
    chunks = spark.createDataFrame([(s, i, bool(rng.random() < 0.6)) for s in range(3) for i in range(200)], "stream_id long, seq long, is_speech boolean")
    lines = spark.createDataFrame([(s, i, f"Line {rng.integers(8)}.") for s in range(3) for i in range(60)], "session_id long, seq long, text string")
    for df, cut, folder in ((chunks, 90, "chunks"), (lines, 25, "lines")):
        df.where(f"seq < {cut}").coalesce(1).write.parquet(str(tmp_path / folder))
        df.where(f"seq >= {cut}").coalesce(1).write.mode("append").parquet(str(tmp_path / folder))

    def run(stream, name):
        q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(map(tuple, spark.table(name).collect()))

    def read(folder, df):
        return spark.readStream.schema(df.schema).parquet(str(tmp_path / folder))

    assert run(endpoint_stream(read("chunks", chunks)), "ends") == sorted(map(tuple, endpoint(chunks).collect()))
    want = dedupe_recent(lines, "session_id", "seq", "text").collect()
    assert [(a, b) for a, b, _ in run(dedupe_stream(read("lines", lines)), "fresh")] == sorted(map(tuple, want))
    append_live(read("lines", lines), str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == lines.count()


def test_speech_segments(spark):
    from parley.operators.ordered import speech_segments

    probs = {
        "two": [0.1] * 5 + [0.9] * 20 + [0.1] * 9 + [0.9] * 30,
        "short": [0.1] * 20 + [0.9] * 4 + [0.1] * 20,
        "long": [0.9] * 200,
        "gap": [0.9] * 10 + [0.1] * 8 + [0.9] * 10 + [0.1] * 20,
    }
    df = spark.createDataFrame([(k, i, p) for k, x in probs.items() for i, p in enumerate(x)], "k string, i int, p double")
    got: dict = {}
    for row in speech_segments(df, "k", "i", "p").collect():
        got.setdefault(row.k, []).append((row.first, row.stop))
    assert {k: sorted(v) for k, v in got.items()} == {"two": [(5, 25), (34, 64)], "short": [(0, 44)], "long": [(0, 188)], "gap": [(0, 28)]}
