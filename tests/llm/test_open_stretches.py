"""Open stretches meet the places of hot seeds without links that grow with the square of them."""

import random

import numpy as np
import pyarrow as pa

from parley.llm import passages as P

WORDS = np.random.default_rng(5).integers(1, 1 << 31, 400).astype(np.uint32)


def met(rows):
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=list("abcdef"))
    return [tuple(r.values()) for b in P._met(50, 0.8)(iter([batch])) for r in b.to_pylist()]


def test_a_covered_stretch_aligns_no_more_copies(monkeypatch):
    calls, align = [], P.align
    monkeypatch.setattr(P, "align", lambda *args: calls.append(1) or align(*args))
    copies = [(0, 0, i, 10, WORDS[:60].tobytes(), None) for i in range(300)]
    found = met([*copies, (0, 1, 1000, 20, WORDS[:60].tobytes(), None)])
    assert len(calls) == 1 and [(r[0], *r[2:]) for r in found] == [(1000, 20, 80, 10, 70, 60)]
    assert met([*copies, (0, 1, 0, 20, WORDS[:60].tobytes(), None)]) == []
    assert met([*copies, (0, 1, 1000, 20, WORDS[:60].tobytes(), [20, 80])]) == []


def test_words_over_and_over_meet_at_their_begins_and_ends():
    a, b, c = (np.full(30, w, np.uint32) for w in (1, 2, 3))
    own = np.concatenate([WORDS[:70], a, b, WORDS[70:140]])
    short = np.concatenate([WORDS[140:210], a[:12], c, b[:28], WORDS[210:280]])
    whole = np.concatenate([WORDS[280:340], a, a[:25], b, c, WORDS[340:]])
    assert met([(0, 0, 1, 0, short.tobytes(), None), (0, 1, 9, 0, own.tobytes(), None)]) == []
    rows = [(0, 0, 1, 0, short.tobytes(), None), (0, 0, 2, 0, whole.tobytes(), None), (0, 1, 9, 0, own.tobytes(), None)]
    assert met(rows) == [(9, 2, 70, 130, 85, 145, 60)]


def test_repeated_words_of_many_documents_are_covered(spark):
    # Eight words over and over: links between all their places would be some 40 million.
    rng, vocabulary = random.Random(4), [f"w{i}" for i in range(8)]
    texts = []
    for _ in range(60):
        words: list[str] = []
        for _ in range(10):
            words += [rng.choice(vocabulary)] * rng.randint(20, 48)
        texts.append(words)
    pair = ["w1"] * 31 + ["w5"] * 26
    texts += [["x1", "x2", *pair, "x3"], ["y1", *pair, "y2", "y3"]]
    found = P.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert all(r.other_id < r.doc_id and r.n_same >= 0.8 * max(r.end_word - r.first_word, r.other_end - r.other_first) for r in found)
    covered = {w for r in found if r.doc_id == 61 for w in range(r.first_word, r.end_word)}
    assert covered >= set(range(1, 58))


def test_partners_without_a_run_of_enough_words_are_not_aligned(monkeypatch):
    # Forty-five words over and over and five shared words that stand too far from them.
    monkeypatch.setattr(P, "align", lambda *args: 1 / 0)
    many = np.full(45, 7, np.uint32)
    own = np.concatenate([WORDS[:5], WORDS[100:160], many, WORDS[160:230]])
    other = np.concatenate([WORDS[:5], WORDS[230:290], many, WORDS[290:360]])
    assert met([(0, 0, 1, 0, other.tobytes(), None), (0, 1, 9, 0, own.tobytes(), None)]) == []
