"""Class scores: every training word has a learned class, and scores equal those of a plain model with the same classes."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def scored(spark, rows):
    from parley.llm.brown import held_out, score_documents

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("held_out", held_out())
    return {r.doc_id: r for r in score_documents(df).collect()}


def test_words_that_few_tokens_are_have_learned_classes(spark):
    rng = random.Random(5)
    # Two kinds of words take turns; each word has less than 1e-4 of all tokens.
    kinds = [[f"{k}{i}" for i in range(5000)] for k in "xy"]
    turns = lambda one, two: " ".join(w for _ in range(60) for w in ("the", rng.choice(one), "of", rng.choice(two)))
    out = [i for i in range(1000, 3000) if held(i)][:80]
    rows = [(i, turns(*kinds)) for i in range(400)] + [(i, turns(*kinds[:: 1 - 2 * (n % 2)])) for n, i in enumerate(out)]
    got = scored(spark, rows)
    right, wrong = (sum(got[i].score - got[i].base_score for i in out[k::2]) / sum(got[i].n_tokens for i in out[k::2]) for k in (0, 1))
    assert right > wrong + 0.1


@pytest.mark.parametrize("frequent", [1e-6, 3e-3, 1.0])
def test_scores_match_a_plain_model(spark, monkeypatch, frequent):
    from parley.llm import brown

    rng, seen = random.Random(8), {}
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*rng.choices(vocabulary, weights=[1 / (1 + k) for k in range(400)], k=rng.randint(0, 60)), f"own{i}"])) for i in range(120)]
    rows += [(120, None), (121, ""), (122, "never seen before"), (123, "w1 never w2 seen seen w300")]
    exchange = brown._exchange

    def recorded(coded, words, *args):
        others = exchange(coded, words, *args)
        seen.update(zip(words.word.view(np.int64).tolist(), words.class_of.tolist(), strict=True))
        seen.update({r["word"]: r["class"] for r in others.collect()})
        return others

    monkeypatch.setattr(brown, "_exchange", recorded)
    monkeypatch.setattr(brown, "FREQUENT", frequent)
    got = scored(spark, rows)
    train = [[*(t or "").split(), None] for i, t in rows if not held(i)]
    count = Counter(w for ws in train for w in ws)
    total, unseen, end = sum(count.values()), 1 / (sum(count.values()) + len(count) + 1), 64
    words = sorted(w for w in count if w)
    data = " ".join(words).encode()
    start, stop, _ = brown.tk.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    hashes = brown.tk.word_hashes(np.frombuffer(data, np.uint8), start, stop).view(np.int64).tolist()
    cls = {w: seen[h] for w, h in zip(words, hashes, strict=True)} | {None: end}
    assert len(seen) == len(words) and set(cls.values()) <= set(range(65))
    pairs = Counter((a, b) for ws in train for a, b in zip([end, *(cls[w] for w in ws)], [cls[w] for w in ws], strict=False))
    into = Counter()
    for (_, b), n in pairs.items():
        into[b] += n / total
    size = Counter()
    for w in words:
        size[cls[w]] += count[w] + 1

    def p(before, w):
        if w not in count:
            return unseen
        move = (pairs[before, cls[w]] + into[cls[w]] + 1e-9) / (sum(pairs[before, b] for b in range(65)) + 1 + 65e-9)
        return 0.9 * (1 - unseen) * move * (1 if w is None else (count[w] + 1) / size[cls[w]]) + 0.1 * (count[w] + 1) * unseen

    for before in (end, 0, 17, 65):
        assert sum(p(before, w) for w in count) + unseen == pytest.approx(1, abs=0.9 * 65e-9 + 1e-6)
    for i, text in rows:
        ws = [*(text or "").split(), None]
        before = [end, *(cls.get(w, 65) for w in ws)]
        assert got[i].score == pytest.approx(sum(math.log10(p(b, w)) for b, w in zip(before, ws, strict=False)), abs=1e-6)
        assert got[i].n_known == sum(w in count for w in ws)
