"""Vector codes, line dedup and tokenizer alignment against plain versions, on odd input."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

VECTORS = "vec_id long, embedding array<double>, label int, v int, entry string, error long"


def _vectors(n=300, dim=16, seed=3):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(20, dim))
    return [(i, (centres[i % 20] + draw.normal(size=dim) * 0.05).tolist(), i % 4 or None, 1, "x", 2) for i in range(n)]


def _plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(4096 * x) for x in r[1]] for r in kept]
    width = len(whole[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]

    def assign(v, p):
        return min((sum((x - y) ** 2 for x, y in zip(v[p], e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        taken = [[assign(v, p)[1] for v in cut] for p in range(parts)]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p] for v, a in zip(cut, taken[p]) if a == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    last = [[assign(v, p) for p in range(parts)] for v in cut]
    error = [sum(d for d, _ in row) for row in last]
    by_label = Counter()
    for r, e in zip(kept, error):
        by_label[r[2]] += e
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return sorted((str(r[0]), "".join(f"{i:02x}" for _, i in row), e, by_label[r[2]], digest) for r, row, e in zip(kept, last, error))


def _coded(df):
    from parley.llm.codes import code_digest

    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in code_digest(df).collect())


@pytest.mark.parametrize("n", [300, 5])
def test_codes_match_plain_rounds(spark, n):
    rows = _vectors(n)
    rows += [(7, rows[1][1], 2, 1, "x", 2), (7, rows[1][1], 2, 1, "x", 2), (None, rows[2][1], None, 1, "x", 2)]  # ties, repeats, no id
    odd = [(900, None, 1, 1, "x", 2), (901, [float("nan")] * 16, 1, 1, "x", 2), (902, [float("inf")] * 16, 1, 1, "x", 2), (903, [None] * 16, 1, 1, "x", 2)]
    assert _coded(spark.createDataFrame(rows + odd, VECTORS).repartition(5)) == _plain_codes(rows + odd)


def test_codes_of_odd_vectors(spark):
    rows = _vectors(40)
    odd = [(500, [1.0] * 8, 1, 1, "x", 2), (501, [1e30] * 16, 1, 1, "x", 2), (502, [], 1, 1, "x", 2)]
    got = _coded(spark.createDataFrame(rows + odd, VECTORS))
    assert [r for r in got if r[1] is None] == [(str(i), None, None, next(g[3] for g in got if g[0] == "1"), got[0][4]) for i in (500, 501, 502)]
    assert [r for r in got if r[1] is not None] == _plain_codes(rows)
    assert _coded(spark.createDataFrame([], VECTORS)) == []


def test_codes_pad_the_last_part(spark):
    rows = _vectors(60, dim=13)
    padded = [(i, v + [0.0] * 3, *r) for i, v, *r in rows]
    assert _coded(spark.createDataFrame(rows, VECTORS)) == _plain_codes(padded)


def test_bounds_spare_distances_and_decide_alike():
    from parley.llm.codes import Bounds, Codebooks

    draw = np.random.default_rng(1)
    x = draw.integers(-9000, 9000, (500, 4, 4)).astype(np.int64)
    history, bounds, spared = [x[:16].transpose(1, 0, 2).copy()], Bounds.unknown(500, 4), []
    for r in range(6):
        books = Codebooks(history)
        spared.append(bounds.settle(x, books))
        gap = ((x[:, :, None] - books.now[None]) ** 2).sum(axis=3)
        assert (bounds.own == gap.argmin(axis=2)).all()
        history.append(np.stack([[x[bounds.own[:, p] == e, p].sum(axis=0) // max(1, (bounds.own[:, p] == e).sum()) if (bounds.own[:, p] == e).any() else books.now[p, e] for e in range(16)] for p in range(4)]))
    assert spared[0][2] == 2000 and spared[-1][2] < 1500 and spared[-1][:2].sum() > 500


LETTERS = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _plain_lines(rows, chars=10):
    holders, out = {}, []
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LETTERS)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(math.inf if i is None else i)
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(key(x)) >= chars and len(holders[key(x)]) > 1 and min(holders[key(x)]) != (math.inf if i is None else i) for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((str(i), len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def _line_rows():
    draw = random.Random(8)
    pool = [" ".join(draw.choices(["Ab", "cd", "ÄÖ", "éf", "İx", "Gh ij"], k=draw.randint(1, 6))) for _ in range(60)]
    rows = [(i, "\n".join(draw.choice(["", " ", "\t"]) + draw.choice(pool) + draw.choice(["", "  ", "\r"]) for _ in range(draw.randint(1, 12)))) for i in range(80)]
    rows += [(i, "the same long line") for i in range(200, 260)]  # a line that most documents hold
    rows += [(5, rows[6][1]), (5, rows[6][1]), (None, rows[7][1]), (None, "only without id twice"), (None, "only without id twice")]
    return rows + [(300, None), (301, ""), (302, "\n\n"), (303, "short\nshort"), (304, "short"), (305, "\n".join(["in one only"] * 5000)), (306, "ＡＢＣ full width ABC"), (307, "ａｂｃ full width abc")]


def test_lines_match_plain_version(spark):
    from parley.llm.lines import line_digest

    rows = _line_rows()
    df = spark.createDataFrame([(*r, 1, 2, "y") for r in rows], "doc_id long, text string, n_lines int, h int, line string").repartition(4)
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in line_digest(df).collect()) == _plain_lines(rows)


def test_lines_keep_columns_and_nulls(spark):
    from parley.llm.lines import without_repeated_lines

    schema = "h int, doc_id long, text string, n_lines int, row string, cut string"
    rows = [(1, 1, "a line to keep\nb", 9, "r", "c"), (2, 2, "A LINE to keep \nc", 9, "r", "c"), (3, 3, None, 9, "r", None), (4, 4, " a line to keep", 9, "r", "c")]
    got = without_repeated_lines(spark.createDataFrame(rows, schema))
    assert got.columns == ["h", "doc_id", "text", "row", "cut", "n_lines", "n_dropped"]
    assert sorted(map(tuple, got.collect())) == [(1, 1, rows[0][2], "r", "c", 2, 0), (2, 2, "c", "r", "c", 2, 1), (3, 3, None, "r", None, 1, 0), (4, 4, "", "r", "c", 1, 1)]
    assert without_repeated_lines(spark.createDataFrame([], schema)).count() == 0
    three = without_repeated_lines(spark.createDataFrame(rows, schema), least_docs=4)
    assert sum(r.n_dropped for r in three.collect()) == 0


def _plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    from parley.llm.alignment import default_paths
    from parley.llm.tokens import _byte_alphabet

    paths, letter = default_paths(), {c: b for b, c in _byte_alphabet().items()}
    one, two = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    one.encode_special_tokens = True
    each, counts, out = [], Counter(), []
    for _, text in rows:
        groups, a, b = [], [], []
        if text:
            a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
            left = [bytes(letter[c] for c in one.id_to_token(i)) for i in a]
            right = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(left) == b"".join(right) == (" " + text).encode():
                ends = [list(np.cumsum([len(x) for x in side])) for side in (left, right)]
                low = 0
                for cut in sorted(set(ends[0]) & set(ends[1])):
                    groups.append([[t for t, e in zip(ids, own) if low < e <= cut] for ids, own in ((a, ends[0]), (b, ends[1]))])
                    low = cut
            else:
                a, b = [], []
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        counts.update(links.keys())
        each.append((a, b, groups, links))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    for (i, _), (a, b, groups, links) in zip(rows, each):
        written = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        sums = sum(links.values()), sum(m for p, m in links.items() if counts[p] == best[p[0]]), sum(m * counts[p] for p, m in links.items())
        out.append((str(i), len(a), len(b), len(groups), *sums, hashlib.sha256(written.encode()).hexdigest() if a else ""))
    return sorted(out)


ODD_TEXTS = [
    None, "", " ", "  a  b\n\n c \t\t d\n", "▁x y", "<|endoftext|> <s> </s> <unk> <0x41>", "日本語のテキスト，漢字 🎉🎉👨‍👩‍👧 é é", "-" * 3000 + " " * 2000 + "x",
    "a b c　d\x1c\x1de\x85f​\r\n\x0b", "I'm don't we'll 'S 12345 x1y2 ..., '''", "\x00\x01", "ÅÅﬁ①½", "\n", "\nx", "x \n", "fi\n\n\nfo",
]


@pytest.mark.parametrize("handed", [1 << 20, 50])
def test_alignment_matches_plain_version(spark, handed, monkeypatch):
    from parley.llm import alignment

    monkeypatch.setattr(alignment, "HANDED", handed)
    draw = random.Random(4)
    rows = [(i, " ".join(draw.choices(["the", "Straße", "token", "naïve", "x.y", "2024,", "(see", "漢字", "\n"], k=draw.randint(1, 60)))) for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(3, "again"), (3, "again"), (None, "no id")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, pair int, row string").repartition(3)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((str(r.doc_id), *(r[c] for c in names)) for r in alignment.alignment_digest(df).collect()) == _plain_alignment(rows)


def test_alignment_overlaps_and_empty_tables(spark):
    from parley.llm.alignment import align, alignment_digest

    row = align(spark.createDataFrame([(1, "naïve 漢字x")], "doc_id long, text string")).first()
    spans = lambda ends: list(zip([0, *ends[:-1]], ends))
    a, b = spans(row.a_end), spans(row.b_end)
    want = {(i, j) for i, (p, q) in enumerate(a) for j, (r, s) in enumerate(b) if p < s and r < q}
    assert set(zip(row.over_a, row.over_b)) == want and len(row.over_a) == len(want)
    assert row.cut == sorted(set(row.a_end) & set(row.b_end))
    assert alignment_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
