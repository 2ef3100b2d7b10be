"""Exemplars, silence, offers and settings against plain versions."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.functions import signal as s
from parley.operators.exemplars import sub_centroids, update_profiles

NEW = "id long, seq long, embedding array<double>, duration_sec double, confirmed boolean"


def test_update_profiles(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((25, 8))
    rows = [(1, i, x[i].tolist(), 1.0, i % 5 == 0) for i in range(25)] + [(2, 0, x[0].tolist(), None, None), (2, 1, None, 1.0, True), (None, 2, x[1].tolist(), 1.0, True)]
    got = {r.id: r for r in update_profiles(spark.createDataFrame(rows, NEW)).collect()}
    held = list(x[:20])
    for new in x[20:]:
        c = np.mean(held, axis=0)
        held[int(np.argmax([h @ c / np.linalg.norm(h) for h in held]))] = new
    assert np.allclose(got[1].exemplars, held) and np.isclose(np.linalg.norm(got[1].centroid), 1)
    assert (got[1].confirmed_count, got[1].auto_assigned_count, got[1].total_duration_sec, len(got[1].sub_centroids)) == (5, 20, 25.0, 3)
    assert (len(got[2].exemplars), got[2].sub_centroids, got[2].auto_assigned_count, got[2].total_duration_sec) == (1, [], 1, 0.0)
    first = update_profiles(spark.createDataFrame(rows[:12], NEW))
    again = update_profiles(spark.createDataFrame(rows[12:25], NEW), first.select("id", "exemplars")).first()
    assert np.allclose(again.exemplars, held) and again.auto_assigned_count + again.confirmed_count == 13
    assert update_profiles(spark.createDataFrame([], NEW)).count() == 0


def test_sub_centroids():
    groups = np.repeat(np.eye(3), 6, axis=0)
    assert sorted(sub_centroids(groups).round(6).tolist()) == sorted(np.eye(3).tolist())
    assert len(sub_centroids(groups[:14])) == 0


def test_trim_silence(spark):
    wave = [0.0] * 16 + [0.5] * 16 + [0.0] * 18
    df = spark.createDataFrame([(wave,), ([0.0] * 50,), ([0.5] * 7,), ([],), (None,)], "x array<double>")
    assert [r.n for r in df.select(F.size(s.trim_silence(F.col("x"), 0.1, 4)).alias("n")).collect()][:4] == [18, 50, 7, 0]


def test_settings(spark):
    doc = spark.createDataFrame([({"a": "1", "b": "2"},), (None,)], "doc map<string,string>")
    got = [r.m for r in doc.select(s.update_settings(F.col("doc"), F.create_map(F.lit("b"), F.lit("3"))).alias("m")).collect()]
    assert got == [{"a": "1", "b": "3"}, {"b": "3"}]
    docs = spark.createDataFrame([('{"k": 3, "name": "x", "other": [1]}',), ('{"k": "3", "name": 4}',), ("not json",), (None,)], "doc string")
    got = [r.m for r in docs.select(s.settings(F.col("doc"), {"k": ("int", 0), "name": ("string", "none")}).alias("m")).collect()]
    assert got == [{"k": "3", "name": "x", "other": "[1]"}, {"k": "0", "name": "none"}, {"k": "0", "name": "none"}, {"k": "0", "name": "none"}]
    kinds = {"k": "int", "name": "string"}
    good = spark.createDataFrame([('{"k": 3, "free": true}',), ('{"name": "y"}',), ("{}",)], "p string")
    assert [r.m for r in good.select(s.checked_patch(F.col("p"), kinds).alias("m")).collect()] == [{"k": "3", "free": "true"}, {"name": "y"}, {}]
    for wrong in ('{"k": "3"}', '{"name": 4}', '{"k": 2.5}'):
        with pytest.raises(Exception, match="invalid type for"):
            spark.createDataFrame([(wrong,)], "p string").select(s.checked_patch(F.col("p"), kinds)).collect()


def test_incidents(spark):
    from parley.operators.maintenance import incident_table

    schema = "event_id long, ts timestamp, context string, error_type string, error_message string, state string"
    rows = [(1, dt.datetime(2024, 1, 2, 3, 4, 5), "load", "ValueError", "bad", '{"n": 3, "deep": {"a": [1]}, "context": "own", "none": null}'), (2, None, "x", None, None, None)]
    got = {(r.event_id, r.key): r.val for r in incident_table(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        (1, "timestamp"): "2024-01-02T03:04:05", (1, "context"): "own", (1, "error_type"): "ValueError", (1, "error_message"): "bad", (1, "n"): "3", (1, "deep"): '{"a":[1]}', (1, "none"): None,
        (2, "timestamp"): None, (2, "context"): "x", (2, "error_type"): None, (2, "error_message"): None,
    }


def test_merges_go_to_the_end_of_their_chain(spark):
    from parley.operators.merging import final_targets

    pairs = [("a", "b"), ("b", "c"), ("x", "y"), ("x", "z"), ("r", "s"), ("s", "t"), ("t", "r"), ("q", "s"), ("k", "k"), (None, "a")] + [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(40)]
    got = {r.source: r.target for r in final_targets(spark.createDataFrame(pairs, "source string, target string")).collect()}
    assert got == {"a": "c", "b": "c", "x": "y", "s": "r", "t": "r", "q": "r", **{f"n{i:02d}": "n40" for i in range(40)}}
    assert final_targets(spark.createDataFrame([], "source string, target string")).count() == 0


def test_merge_profiles(spark):
    from parley.operators.merging import merge_profiles

    rng = np.random.default_rng(4)
    x = {i: rng.standard_normal((n, 6)) for i, n in (("a", 12), ("b", 5), ("c", 15), ("d", 3))}
    centre = lambda rows: np.mean(rows, axis=0) / np.linalg.norm(np.mean(rows, axis=0))
    rows = [(i, f"N{i}", v.tolist(), centre(v).tolist(), len(v), 1, 10.0 * len(v), 0.5, "old", f"note {i}") for i, v in x.items()]
    schema = "id string, name string, exemplars array<array<double>>, centroid array<double>, confirmed_count long, auto_assigned_count long, total_duration_sec double, quality double, updated_at string, notes string"
    merges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "nobody"), ("nobody", "d")], "source string, target string")
    mapping = spark.createDataFrame([(1, "a", 4), (1, "c", 9), (2, "a", 1), (2, "b", 2), (3, "c", 7), (4, "d", 8)], "session_id long, speaker_id string, segment_count long")
    made, mapped = merge_profiles(spark.createDataFrame(rows, schema), merges, mapping, now=F.lit("new"))
    got = {r.id: r for r in made.collect()}
    held, c = list(x["c"]), centre(x["c"])
    for source in ("a", "b"):
        for v in x[source]:
            if len(held) < 20:
                held.append(v)
            else:
                held[int(np.argmax([h @ c / (np.linalg.norm(h) * np.linalg.norm(c) + 1e-10) for h in held]))] = v
        c = centre(held)
    unit = np.array(held) / np.linalg.norm(held, axis=1, keepdims=True)
    mean = (unit @ unit.T)[np.triu_indices(20, 1)].mean()
    assert set(got) == {"c", "d"} and np.allclose(got["c"].exemplars, held) and np.allclose(got["c"].centroid, c)
    assert (got["c"].confirmed_count, got["c"].auto_assigned_count, got["c"].total_duration_sec, got["c"].updated_at, got["c"].notes) == (32, 3, 320.0, "new", "note c")
    assert got["c"].quality == pytest.approx(max(0.0, mean)) and (got["d"].quality, got["d"].updated_at) == (0.5, "old")
    assert sorted(map(tuple, mapped.collect())) == [(1, "c", 4), (2, "c", 2), (3, "c", 7), (4, "d", 8)]


def test_updates_give_quality_and_times(spark):
    rows = [(1, 0, [1.0, 0.0], 1.0, True), (1, 1, [0.0, 1.0], 1.0, True), (1, 2, [1.0, 0.0], 1.0, False)]
    known = spark.createDataFrame([(2, [[1.0, 0.0]])], "id long, exemplars array<array<double>>")
    got = {r.id: r for r in update_profiles(spark.createDataFrame(rows, NEW), known, now=F.lit("t")).collect()}
    assert got[1].quality == pytest.approx(1 / 3) and (got[1].updated_at, got[1].last_seen_at) == ("t", "t")
    assert got[2].quality == 0.0 and got[2].updated_at is None
