"""Passages whose few seeds are held by many documents, of which only one has the passage itself."""

import random

import pytest

RNG = random.Random(11)
VOCAB = ["".join(RNG.choices("abcdefghij", k=6)) for _ in range(5000)]
OWN = 20


def corpus(n: int, changed: list[int], hot: list[int]) -> list[tuple[int, str]]:
    """A passage in document 5; in document OWN with the words ``changed`` replaced; the four words from each of ``hot`` on in all others."""
    rng = random.Random(n)
    some = lambda k: rng.choices(VOCAB, k=k)
    passage = some(n)
    rows = []
    for i in [*range(5), *range(6, OWN)]:
        order, words = rng.sample(hot, len(hot)), some(9)
        for k in order:
            words += passage[k : k + 4] + some(40)
        rows.append((i, " ".join(words)))
    own = [f"other{k}" if k in changed else w for k, w in enumerate(passage)]
    return [*rows, (5, " ".join(some(31) + passage + some(12))), (OWN, " ".join(some(17) + own + some(30)))]


@pytest.mark.parametrize(
    "n,changed,hot",
    [
        # Eleven seeds, all of many documents and none of them next to another.
        (54, list(range(4, 50, 5)), list(range(0, 51, 5))),
        # Four seeds that only the two documents hold and six between them of many: too few of either kind.
        (50, [*range(4, 45, 5), 41], list(range(10, 36, 5))),
    ],
)
def test_sparse_seeds_of_many_documents_hide_no_passage(spark, n, changed, hot):
    from parley.llm.passages import repeated_passages

    docs = spark.createDataFrame(corpus(n, changed, hot), "doc_id long, text string").repartition(3)
    found = [r for r in repeated_passages(docs).collect() if r.doc_id == OWN]
    assert [(r.other_id, r.first_word, r.end_word, r.other_first, r.other_end, r.n_same) for r in found] == [(5, 17, 17 + n, 31, 31 + n, n - len(changed))]


def test_groups_whose_words_are_many_are_aligned_in_rounds(spark, monkeypatch):
    from parley.llm import passages as P

    # One document of many partners: their words together are many times its own.
    rng = random.Random(6)
    passage = rng.choices(VOCAB, k=120)
    texts = [passage + rng.choices(VOCAB, k=3)] + [rng.choices(VOCAB, k=2) + passage[:60] + ["x"] + passage[60:] for _ in range(6)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    columns = P._names(P._GROUP)[:-1]
    rows = [(i, j, 0, 123, 0, 123, 0, 123, 0, 3) for i in range(1, 7) for j in range(i)]
    groups = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in columns))
    made, write = [], P.materialise
    monkeypatch.setattr(P, "materialise", lambda df, name: made.append(name) or write(df, name))
    found = P._align_groups(groups, docs, 50, 0.8, 2).collect()
    assert {(r.doc_id, r.other_id) for r in found} == {(r[0], r[1]) for r in rows}
    assert made.count("passages") > 2
