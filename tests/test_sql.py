"""Table functions equal the DataFrame forms; embeddings by a model hook."""

import numpy as np
import pytest

from parley import sql
from parley.operators.embedding import seeded_model, with_embeddings
from parley.operators.identify import identify, viterbi_smooth
from parley.operators.matching import quality_score, sum_vectors
from parley.operators.ordered import endpoint, scd_segments, speech_segments


@pytest.fixture(scope="module")
def frames(spark):
    draw = np.random.default_rng(2)
    rows = [(s, i, float(p) if i % 17 else None, bool(p > 0.5), int(draw.integers(3))) for s in range(4) for i, p in enumerate(np.repeat(draw.random(30), 10))]
    df = spark.createDataFrame(rows, "s long, i long, p double, loud boolean, label int").repartition(3)
    df.createOrReplaceTempView("frames")
    sql.register(spark)
    return df


def same(spark, query, df):
    assert sorted(map(tuple, spark.sql(query).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_ordered_functions(spark, frames):
    same(spark, "SELECT * FROM speech_segments(TABLE(SELECT s, i, p FROM frames) PARTITION BY s ORDER BY i)", speech_segments(frames, "s", "i", "p"))
    same(spark, "SELECT * FROM speech_segments(TABLE(SELECT s, i, p FROM frames) PARTITION BY s ORDER BY (i), 0.2D, 3, 2, 40)", speech_segments(frames, "s", "i", "p", 0.2, 3, 2, 40))
    same(spark, "SELECT * FROM endpoint(TABLE(SELECT s, i, loud FROM frames) PARTITION BY s ORDER BY i)", endpoint(frames.withColumnRenamed("loud", "is_speech"), "s", "i"))
    same(spark, "SELECT * FROM viterbi_smooth(TABLE(SELECT s, i, label FROM frames) PARTITION BY s ORDER BY i)", viterbi_smooth(frames, "s", "i", "label"))
    windows = frames.selectExpr("s", "i * 8000 AS at", "p > 0.8 AS far", "300 * 8000 AS total")
    windows.createOrReplaceTempView("windows")
    same(spark, "SELECT * FROM scd_segments(TABLE(windows) PARTITION BY s ORDER BY at)", scd_segments(windows, "s", "at", "far", "total"))
    with pytest.raises(Exception, match="takes a table with a key"):
        spark.sql("SELECT * FROM endpoint(TABLE(SELECT s, i FROM frames) PARTITION BY s ORDER BY i)").collect()


def test_identify_and_vectors(spark, frames):
    draw = np.random.default_rng(4)
    rows = [(s, i, draw.normal(size=6).tolist() if i % 9 else None, 2.0, 0.1) for s in range(3) for i in range(40)]
    segments = spark.createDataFrame(rows, "session_id long, seg_ix long, embedding array<double>, duration_sec double, rms double")
    segments.createOrReplaceTempView("segments")
    same(spark, "SELECT * FROM identify(TABLE(segments) PARTITION BY session_id ORDER BY seg_ix)", identify(segments))
    heard = segments.where("embedding is not null")
    totals = {r.session_id: np.array(r.total) for r in sum_vectors(heard, ["session_id"], "embedding").collect()}
    for r in spark.sql("SELECT * FROM centroid(TABLE(SELECT session_id, embedding FROM segments) PARTITION BY session_id)").collect():
        assert np.allclose(r.centroid, totals[r.session_id] / np.linalg.norm(totals[r.session_id]))
    want = {r.session_id: r.quality for r in quality_score(heard, ["session_id"], "embedding").collect()}
    got = {r.session_id: r.quality for r in spark.sql("SELECT * FROM quality_score(TABLE(SELECT session_id, embedding FROM segments) PARTITION BY session_id)").collect()}
    assert got == pytest.approx(want)
    cells = np.zeros((6, 6))
    for r in spark.sql("SELECT * FROM scatter(TABLE(SELECT session_id, embedding FROM segments) PARTITION BY session_id) WHERE session_id = 1").collect():
        cells[r.i, r.j] = r.x
    x = np.array([r[2] for r in rows if r[0] == 1 and r[2]])
    assert np.allclose(cells, (x - x.mean(axis=0)).T @ (x - x.mean(axis=0)))


def test_embeddings(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(size=50 + i).tolist(), "x") for i in range(30)] + [(100, None, "x"), (101, [], "x"), (102, [1.0, None], "x")]
    df = spark.createDataFrame(rows, "id long, samples array<double>, embedding string")
    one, many = ({r.id: r.embedding for r in with_embeddings(df.repartition(n)).collect()} for n in (1, 7))
    assert one == many and [one[i] for i in (100, 101, 102)] == [None] * 3
    assert np.allclose(one[3], seeded_model()([np.array(rows[3][1])])[0]) and np.isclose(np.linalg.norm(one[3]), 1)
    lengths = with_embeddings(df, make_model=lambda: lambda xs: np.array([[float(len(x))] for x in xs]), column="size", batch=4)
    assert lengths.columns == ["id", "samples", "embedding", "size"] and {r.id: r.size for r in lengths.collect()}[5] == [55.0]
    assert with_embeddings(df.where("false")).count() == 0
