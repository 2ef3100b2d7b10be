"""Sweeps count the frames that frame by frame counting gives."""

import random
from collections import Counter

import pytest

from parley.operators import intervals as iv


def _rows(seed, n, who):
    draw = random.Random(seed)
    return [(f, draw.choice(who), s, s + draw.uniform(-0.2, 5)) for f in ("a", "b") for s in (round(draw.uniform(-1, 40), draw.choice([1, 2, 6])) for _ in range(n))]


def _frame_by_frame(ref, hyp, step, collar):
    together, errors = Counter(), {}
    for f in sorted({r[0] for r in ref}):
        own, other = [r for r in ref if r[0] == f], [h for h in hyp if h[0] == f]
        frames = range(int(max(r[3] for r in own) // step) + 1)
        at = lambda rows, i: [r[1] for r in rows if r[2] <= i * step < r[3]]
        first = {}
        for i in frames:
            for r in at(own, i):
                for h in at(other, i):
                    together[f, h, r] += 1
                    first.setdefault((h, r), i)
        names, used = {}, set()
        for h, r in sorted(first, key=lambda p: (-together[f, p[0], p[1]], first[p], p)):
            if h not in names and r not in used:
                names[h] = r
                used.add(r)
        sums, seen = [0, 0, 0, 0], False
        for i in frames:
            if any(abs(i * step - e) < collar for r in own for e in r[2:]):
                continue
            r, h = set(at(own, i)), {names.get(x, f"?{x}") for x in at(other, i)}
            seen |= bool(r or h)
            for k, x in enumerate((max(0, len(r) - len(h)), max(0, len(h) - len(r)), min(len(r), len(h)) - len(r & h), len(r))):
                sums[k] += x
        if seen:
            errors[f] = tuple(sums)
    return together, errors


@pytest.mark.parametrize("step,slot", [(0.1, 256), (0.25, 1), (0.07, 3), (1.0, 16)])
def test_sweep_equals_frames(spark, step, slot, monkeypatch):
    monkeypatch.setattr(iv, "SLOT", slot)
    ref, hyp = _rows(1, 25, ["x", "y", "z"]), _rows(2, 30, [1, 2, 3, 4])
    r = spark.createDataFrame(ref, "file_id string, speaker string, start double, end double")
    h = spark.createDataFrame(hyp, "file_id string, speaker_id int, start double, end double")
    together, errors = _frame_by_frame(ref, hyp, step, 0.25)
    got = {(x.file_id, x.speaker_id, x.speaker): x.n_frames for x in iv.cooccurrence(h, r, step).collect()}
    assert got == dict(together)
    assert {x.file_id: (x.miss, x.fa, x.confusion, x.speech) for x in iv.der(r, h, step, 0.25).collect()} == errors
    share = {(x.file_id, x.speaker): x.share for x in iv.consistency(iv.cooccurrence(h, r, step)).collect()}
    most, total = Counter(), Counter()
    for (f, _, s), n in together.items():
        most[f, s], total[f, s] = max(most[f, s], n), total[f, s] + n
    assert share[None, None] == pytest.approx(sum(most.values()) / sum(total.values()))
    assert share["a", "x"] == pytest.approx(most["a", "x"] / total["a", "x"])


def test_sweep_of_nothing(spark):
    r = spark.createDataFrame([], "file_id string, speaker string, start double, end double")
    h = spark.createDataFrame([("a", 1, 0.0, 1.0)], "file_id string, speaker_id int, start double, end double")
    assert iv.cooccurrence(h, r, 0.1).count() == 0 and iv.der(r, h).count() == 0
