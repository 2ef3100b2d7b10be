"""Open stretches visit the blocks of clusters in rounds, so that visits take no more disk as blocks grow in number."""

import random

import pyarrow.compute as pc

from parley.llm import passages as P


def test_visits_of_a_round_are_bounded_and_cover_the_same(spark, monkeypatch):
    rng, vocabulary = random.Random(4), [f"w{i}" for i in range(8)]
    texts = []
    for _ in range(60):
        words: list[str] = []
        for _ in range(10):
            words += [rng.choice(vocabulary)] * rng.randint(20, 48)
        texts.append(words)
    pair = ["w1"] * 31 + ["w5"] * 26
    texts += [["x1", "x2", *pair, "x3"], ["y1", *pair, "y2", "y3"]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    rounds, met = [], P._met

    def counted(*args):
        visits, run = spark.sparkContext.accumulator(0), met(*args)
        rounds.append(visits)

        def each(batches):
            for batch in batches:
                visits.add(pc.sum(batch.column(1)).as_py() or 0)
                yield batch

        return lambda batches: run(each(batches))

    monkeypatch.setattr(P, "_met", counted)
    monkeypatch.setattr(P, "VISITS", 0, raising=False)
    found = P.repeated_passages(docs).collect()
    # In the first round every open run visits one block.
    assert len(rounds) > 1 and rounds[0].value > 0 and max(r.value for r in rounds) == rounds[0].value
    covered = {w for r in found if r.doc_id == 61 for w in range(r.first_word, r.end_word)}
    assert covered >= set(range(1, 58))
    monkeypatch.setattr(P, "VISITS", 1000, raising=False)
    rounds.clear()
    cover = lambda rows: {(r.doc_id, w) for r in rows for w in range(r.first_word, r.end_word)}
    assert len(cover(P.repeated_passages(docs).collect()) ^ cover(found)) <= 0.02 * len(cover(found)) and len(rounds) == 2


def test_runs_with_more_seeds_than_go_at_once_share_the_same(monkeypatch):
    rng = P.np.random.default_rng(2)
    words = rng.integers(1, 60, 4000).astype(P.np.uint32)
    block = P._Block([(i, 0, words[a : a + 150]) for i, a in enumerate(rng.integers(0, 3800, 40).tolist())])
    names = [P._seed_names(words[a : a + 120]) for a in range(0, 3000, 90)] + [P._seed_names(words[:2])]
    whole = block.sharing([20] * len(names), names, 50)
    monkeypatch.setattr(P, "PAIRS", 7)
    for a, b in zip(whole, block.sharing([20] * len(names), names, 50), strict=True):
        assert a.tolist() == b.tolist() and (a[:, 0] < 20).all()
    assert sum(len(a) for a in whole) > 20
