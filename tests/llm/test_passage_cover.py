"""Passages that only hot seeds or repeated places show, and equal cover with a comparison of all pairs."""

import random

import numpy as np
import pytest

RNG = random.Random(3)
VOCAB = ["".join(RNG.choices("abcdefghij", k=6)) for _ in range(5000)]


def text(n, rng=RNG):
    return " ".join(rng.choices(VOCAB, k=n))


def cover(spark, rows):
    from parley.llm.passages import repeated_passages

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {i: set() for i, _ in rows}
    for r in repeated_passages(df).collect():
        assert r.other_id < r.doc_id and r.end_word - r.first_word >= 50 and r.n_same >= 0.8 * max(r.end_word - r.first_word, r.other_end - r.other_first)
        out[r.doc_id] |= set(range(r.first_word, r.end_word))
    return out


@pytest.mark.parametrize("before,between", [(0, 1), (0, 10), (10, 20)])
def test_halves_of_many_documents_hide_no_passage(spark, before, between):
    passage = text(61).split()
    other = [*passage[:30], "xxxxxx", *passage[31:]]
    half = lambda i: f"{text(20)} {' '.join(passage[:30] if i % 2 else passage[31:])} {text(20)}"
    texts = [half(i) for i in range(before)] + [f"{text(30)} {' '.join(passage)} {text(30)}"]
    texts += [half(i) for i in range(between)] + [f"{text(25)} {' '.join(other)} {text(30)}"]
    assert cover(spark, list(enumerate(texts)))[len(texts) - 1] == set(range(25, 86))


@pytest.mark.parametrize("parts", [[(0, 30), (32, 62)], [(0, 40), (22, 62)], [(0, 30), (10, 45), (0, 40), (22, 62)]])
def test_partial_copies_hide_no_whole_one(spark, parts):
    whole = text(62).split()
    own, at = [text(10)], 10
    for k, (a, b) in enumerate(parts):
        if k == len(parts) // 2:
            place = at
            own += [" ".join(whole), text(9)]
            at += 71
        own += [" ".join(whole[a:b]), text(9)]
        at += b - a + 9
    plain = f"{text(20)} {' '.join(whole)} {text(20)}"
    assert cover(spark, [(0, " ".join(own)), (1, plain)])[1] == set(range(20, 82))
    assert cover(spark, [(1, " ".join(own)), (0, plain)])[1] >= set(range(place, place + 62))


@pytest.mark.parametrize("before,between", [(10, 10), (2, 40)])
def test_partial_copies_in_many_documents_hide_no_passage(spark, before, between):
    # Every seed and wider seed but one is held by many documents, of which none has fifty words of the passage.
    rng = random.Random(before)
    passage = text(50, rng).split()
    part = lambda i: f"{text(20, rng)} {' '.join(passage[:49] if i % 2 else passage[1:])} {text(20, rng)}"
    texts = [part(i) for i in range(before)] + [f"{text(30, rng)} {' '.join(passage)} {text(30, rng)}"]
    texts += [part(i) for i in range(between)] + [f"{text(25, rng)} {' '.join(passage)} {text(30, rng)}"]
    assert cover(spark, list(enumerate(texts)))[len(texts) - 1] >= set(range(25, 75))


def _inner(words):
    """Without runs of at most sixteen words: ends of a passage that differ more than they match are left out."""
    out: list[list[int]] = []
    for w in sorted(words):
        if out and w == out[-1][-1] + 1:
            out[-1].append(w)
        else:
            out.append([w])
    return [(run[0], run[-1]) for run in out if len(run) > 16]


def _all_pairs(rows):
    """Words of each document on passages along one diagonal with an earlier one, by comparing all pairs."""
    ids: dict[str, int] = {}
    docs = [(i, np.array([ids.setdefault(w, len(ids)) for w in t.split()])) for i, t in rows]
    out = {i: set() for i, _ in rows}
    for i, a in docs:
        for j, b in docs:
            if j >= i or len(np.intersect1d(a, b)) < 40:
                continue
            x, y = np.nonzero(a[:, None] == b[None])
            for d in np.unique(x - y):
                at = np.sort(x[x - y == d])
                for p in range(len(at)):
                    n = np.arange(1, len(at) - p + 1)
                    size = at[p:] - at[p] + 1
                    good = np.flatnonzero((size >= 50) & (n >= 0.8 * size))
                    if len(good):
                        out[i] |= set(range(at[p], at[p + good[-1]] + 1))
    return out


def test_cover_equals_all_pairs(spark):
    rng = random.Random(17)
    families = [text(rng.randint(52, 90), rng).split() for _ in range(18)]

    def part(words):
        n = len(words)
        kind = rng.random()
        if kind < 0.35:
            a = rng.randint(0, n // 2)
            words = words[a : a + rng.randint(20, 45)]
        share = rng.choice([0.0, 0.0, 0.05, 0.1])
        return [w if k < 4 or k > len(words) - 5 or rng.random() >= share else f"s{rng.random()}" for k, w in enumerate(words)]

    rows = []
    for i in range(200):
        words: list[str] = text(rng.randint(5, 40), rng).split()
        for family in rng.sample(families, rng.randint(0, 3)):
            words += part(family) + text(rng.randint(40, 50), rng).split()
        rows.append((i, " ".join(words)))
    want, got = _all_pairs(rows), cover(spark, rows)
    assert sum(map(len, want.values())) > 5000
    lost = {i: _inner(want[i] - got[i]) for i in want if _inner(want[i] - got[i])}
    more = {i: _inner(got[i] - want[i]) for i in want if _inner(got[i] - want[i])}
    assert (lost, more) == ({}, {})
    assert sum(len(want[i] ^ got[i]) for i in want) < 0.01 * sum(map(len, want.values()))


@pytest.mark.parametrize("share", [0.0, 0.05, 0.1, 0.15, 0.2])
def test_recall_by_share_of_substituted_words(spark, share):
    rng = random.Random(int(share * 100))
    rows, want = [], {}
    for n in range(40):
        passage = [f"p{n}w{i}" for i in range(50 + n % 11)]
        places = set(rng.sample(range(1, len(passage) - 1), int(share * len(passage))))
        fuzzy = [f"q{n}w{i}" if i in places else w for i, w in enumerate(passage)]
        rows += [(2 * n, f"{text(40, rng)} {' '.join(passage)} {text(40, rng)}"), (2 * n + 1, f"{text(40, rng)} {' '.join(fuzzy)} {text(40, rng)}")]
        want[2 * n + 1] = set(range(40, 40 + len(passage)))
    got = cover(spark, rows)
    missed = [i for i in want if not got[i]]
    assert missed == [] and all(got[i] <= want.get(i, set()) for i in got)
