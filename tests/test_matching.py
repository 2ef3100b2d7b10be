"""Matches with profiles: handed out or block by block, sub-centroids, odd queries."""

import numpy as np
import pytest

from parley.operators import matching as m


def _tables(spark, n=900, q=300, dim=16):
    draw = np.random.default_rng(2)
    p = draw.normal(size=(n, dim))
    p[100:110] = p[50]  # equal profiles: the smaller id comes first
    near = p[:, None] + draw.normal(size=(n, 2, dim)) * 0.4
    x = p[draw.integers(0, n, q)] + draw.normal(size=(q, dim)) * 0.4
    profiles = spark.createDataFrame([(f"p{i:04d}", f"N{i}", v.tolist(), int(i % 30), near[i].tolist() if i % 2 else []) for i, v in enumerate(p)],
                                     "id string, name string, centroid array<double>, n long, sub_centroids array<array<double>>")
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [1.0, 2.0]), (None, p[50].tolist())]
    return p, near, x, profiles, spark.createDataFrame(rows, "query_id long, embedding array<double>")


@pytest.mark.parametrize("small", [4096, 10])
def test_matches_equal_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(m, "SMALL", small)
    monkeypatch.setattr(m, "BLOCK_BYTES", 16 * 8 * 300)
    monkeypatch.setattr(m, "QUERY_BLOCK", 70)
    p, near, x, profiles, queries = _tables(spark)
    got = {}
    for r in m.match_profiles(queries, profiles).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, round(r.score, 9)))
    scores = x @ p.T / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(p, axis=1) + 1e-10)
    for i, row in enumerate(scores):
        order = sorted(range(len(p)), key=lambda j: (-row[j], j))[:3]
        assert sorted(got[i]) == [(k + 1, f"p{j:04d}", pytest.approx(row[j], abs=1e-8)) for k, j in enumerate(order)] or len({round(row[j], 9) for j in order}) < 3
    assert 1000 not in got and 1001 not in got
    assert [i for _, i, _ in sorted(got[None])] == ["p0050", "p0100", "p0101"]

    tiers = {r.query_id: r for r in m.classify_match(queries, profiles).collect()}
    plain = {r.query_id: r for r in m.classify_match(queries, profiles, multi_centroid=False).collect()}
    assert len(tiers) == 303 and (tiers[1000].tier, tiers[1000].score, tiers[1000].profile_id) == ("low", 0.0, None)
    raised = 0
    for i, row in enumerate(scores):
        j = int(row.argmax())
        subs = near[j] if j % 2 and j % 30 >= 15 else []
        want = max([row[j], *(float(x[i] @ s / (np.linalg.norm(x[i]) * np.linalg.norm(s))) for s in subs)])
        assert tiers[i].score == pytest.approx(want, abs=1e-6) and plain[i].score == pytest.approx(row[j], abs=1e-6)
        raised += want > row[j] + 1e-9
    assert raised


def test_no_profiles(spark):
    *_, profiles, queries = _tables(spark, 150, 5)
    assert {(r.tier, r.score) for r in m.classify_match(queries, profiles.where("false")).collect()} == {("low", 0.0)}
    assert m.match_profiles(queries, profiles.where("false")).count() == 0
