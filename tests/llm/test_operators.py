"""Edge cases and brute-force comparisons of the training-data operators."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
RNG = random.Random(5)
VOCAB = ["".join(RNG.choices("abcdefghij", k=5)) for _ in range(400)]


def text(n, rng=RNG):
    return " ".join(rng.choices(VOCAB, k=n))


def edited(t, share, rng=RNG):
    return " ".join(rng.choice(VOCAB) if rng.random() < share else w for w in t.split())


def docs_of(spark, rows):
    """Documents with an extra column of a name that operators use inside."""
    return spark.createDataFrame(
        [(i, t, "en", f"s{n}", len(t or ""), "x") for n, (i, t) in enumerate(rows)],
        "doc_id long, text string, lang string, source string, n_chars long, bucket string",
    )


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def shingles(t, k):
    w = words(t)
    return ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}) if w else set()


def components(n, links):
    up = list(range(n))

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in links:
        p, q = top(a), top(b)
        up[max(p, q)] = min(p, q)
    return [top(v) for v in range(n)]


EDGES = [(900, None), (901, ""), (902, "  \n "), (903, "one two"), (904, "One  TWO"), (905, "12 34"), (None, "one two"), (906, "w " * 5000)]


@pytest.fixture(scope="module")
def corpus():
    base = [text(60) for _ in range(12)]
    rows = list(enumerate(base)) + [(100 + i, edited(base[i % 4], 0.02 * (i % 4))) for i in range(60)] + [(200, base[0]), (201, base[0])]
    return rows + EDGES


def test_near_duplicates_match_brute_force(spark, corpus):
    from parley.llm.minhash import near_duplicates, without_near_duplicates

    rows = sorted((r for r in corpus if r[0] is not None), key=lambda r: r[0])
    sets = [shingles(t, 4) for _, t in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if (n := len(sets[a] & sets[b])) and 100 * n >= 80 * len(sets[a] | sets[b])]
    want = {rows[i][0]: (len(sets[i]), rows[c][0]) for i, c in enumerate(components(len(rows), links))}
    df = docs_of(spark, corpus)
    got = near_duplicates(df, k=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert len(got) == len(corpus)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    kept = without_near_duplicates(df, k=4)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for _, c in want.values()})
    assert near_duplicates(df.limit(0)).count() == 0


def test_urls(spark):
    from parley.llm.urls import judge_urls, rules_table

    urls = {
        1: ("http://A.Example.ORG/en/12?x", "example.org/en/1", "block"), 2: ("https://example.org/es", "org/", "allow"), 3: ("x://b.com/de/1", "com/de/", "block"),
        4: ("x://b.com/fr/", "com/fr/", "allow"), 5: ("x://b.com/FR/", None, "allow"), 6: (None, None, "allow"), 7: ("no scheme", None, "allow"),
        8: ("x://myexample.org/en/1", "org/", "allow"), 9: ("x://example.org", None, "allow"), 10: ("", None, "allow"), 11: ("x://example.org#/en/1", None, "allow"),
    }
    rows = [(k, v[0]) for k, v in urls.items()] * 2 + [(None, "x://b.com/de/")]
    df = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string").drop("host")
    got = judge_urls(df, rules_table(spark)).collect()
    assert len(got) == len(rows)
    assert {r.page_id: (r.rule, r.verdict) for r in got if r.page_id} == {k: v[1:] for k, v in urls.items()}
    assert judge_urls(df.limit(0), rules_table(spark)).count() == 0


def test_passages(spark):
    from parley.llm.passages import repeated_passages, without_repeated_passages

    shared = text(70)
    rows = [(i, text(80) + " " + (edited(shared, 0.05) if i else shared) + " " + text(30)) for i in range(6)] + [(10 + i, text(150)) for i in range(5)]
    df = docs_of(spark, rows + EDGES)
    found = repeated_passages(df).collect()
    assert {r.doc_id for r in found} == {1, 2, 3, 4, 5}
    assert all(r.other_id < r.doc_id and r.end_word - r.first_word >= 50 and r.n_same >= 0.8 * (r.end_word - r.first_word) for r in found)
    cut = without_repeated_passages(df)
    assert cut.columns == df.columns
    left = {r.doc_id: r.text for r in cut.collect()}
    assert len(left) == len(rows) + len({i for i, _ in EDGES})
    assert left[0] == rows[0][1] and left[10] == rows[6][1] and left[900] is None
    assert all(len(left[i].split()) < 130 for i in range(1, 6))
    assert repeated_passages(df.limit(0)).count() == 0


def test_language(spark):
    from parley.llm.language import learn_profiles, predict_language

    rows = [(i, " ".join(random.Random(i).choices(v.split(), k=30)), lang) for lang, v in (("en", "the of and to in that is was"), ("de", "der die und das nicht mit von")) for i in range(20)]
    rows += [(50, None, "en"), (51, "12 !?", None), (52, "", "de"), (53, "der und nicht " * 3000, None), (None, "the and of the", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = predict_language(df, learn_profiles(df.where("lang is not null")), ["doc_id", "lang"]).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.lang_pred == r.lang for r in got if r.lang and r.doc_id < 50)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (50, 51, 52, 53)} == {50: "und", 51: "und", 52: "und", 53: "de"}
    none = predict_language(df, learn_profiles(df.limit(0)), ["doc_id"]).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_decontamination(spark):
    from parley.llm.decontaminate import contaminated, without_contaminated

    items = [(i, text(n)) for i, n in enumerate((3, 5, 8, 20, 40, 60, 150))] + [(20, None), (21, ""), (None, text(30)), (22, text(4)), (23, "one two"), (24, "One two")]
    rows = [(i, text(3000) + " " + t + " " + text(40)) for i, (j, t) in enumerate(items) if t and j] + [(50 + i, text(300)) for i in range(10)] + [(70, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs_of(spark, rows + EDGES)
    rows += [(80, text(50) + " " + items[10][1] + " " + text(9)), (80, text(30)), (81, "one two three")]
    df = docs_of(spark, rows + EDGES)
    size = {i: min(5, len(words(t))) if len(words(t)) >= 3 else 5 for i, t in items}
    sets = {i: shingles(t, size[i]) for i, t in items}
    want = {(d, i) for d, t in rows + EDGES for i, s in sets.items() if s and len(s & shingles(t, size[i])) >= 0.8 * len(s)}
    assert {(80, 22), (70, 0), (903, 23), (904, 24)} <= want
    assert {(r.doc_id, r.item_id) for r in contaminated(df, bench).collect()} == want
    kept = {r.doc_id for r in without_contaminated(df, bench).collect()}
    assert kept == {d for d, _ in rows + EDGES} - {d for d, _ in want if d is not None}
    assert contaminated(df, bench.limit(0)).count() == 0 and contaminated(df.limit(0), bench).count() == 0
    assert without_contaminated(df.limit(0), bench).columns == df.columns


def test_pages(spark):
    from parley.llm.wrappers import extract_main_text

    menu = "<nav><a href=x>Home</a></nav><header>Site</header>"
    foot = "<div class='cookie-notice'>We use</div><div id=comments><p>Nice</p></div><footer>&copy; me</footer>"
    article = "<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body>{m}<article><h1>A &amp; B {i}</h1><p>one\n two {i}<br>three<p><b>four</b></article>{f}"
    plain = "<html><body>{m}<div class=box><div class=story><p>long text number {i} is here</p><p>more of {i}</p></div><div class=tail>Read on</div></div>{f}</body></html>"
    rows = [(i, "http://a.x/p", article.format(m=menu, f=foot, i=i)) for i in range(4)] + [(10 + i, "http://b.x/p", plain.format(m=menu, f=foot, i=i)) for i in range(4)]
    rows += [(90, None, None), (91, "http://a.x/", ""), (None, "http://a.x/", "<p>cut <b")]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and by[2] == "A & B 2\none two 2 three\nfour"
    assert by[12] == "long text number 2 is here\nmore of 2" and by[90] == by[91] == ""
    assert all(r.n_chars == len(r.text) for r in got)


def test_furniture_hides_no_article(spark):
    from parley.llm.wrappers import extract_main_text

    body = "<h1>T {i}</h1><p>first words of number {i}</p><p>more words of it</p>"
    aside = "<aside class=related><article><p>Teaser</p></article></aside><footer>me</footer>"
    pages = [
        f'<div class="layout has-sidebar"><article>{body}</article><div class=sidebar>S</div></div>{aside}',
        f'<main class="content no-comments">{body}</main>{aside}',
        f"<form><article>{body}</article><p>Send</p></form>{aside}",
        f'<article><div class="article-header"><h1>T {{i}}</h1></div><p>first words of number {{i}}</p><p>more words of it</p><div class="share">Share</div></article>{aside}',
        f"<nav>Home<article>{body}</article>{aside}",
        f'<article data-id="nav">{body}</article><section id=comments><article class=comment><p>Nice and a rather long comment it is, with many words</p></article></section>{aside}',
        f'<div class="page-menu wide">{body}</div>',
    ]
    rows = [(10 * n + i, f"http://h{n}.x/p", page.replace("{i}", str(i))) for n, page in enumerate(pages) for i in range(4)]
    rows += [(100, "http://q.x", '<p title="a > b">Hello</p><img alt="x > y"><p class=\'c>d\'>there</p><p it\'s>you</p><a title="open>end</a>')]
    by = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for n in range(len(pages)):
        for i in range(4):
            assert by[10 * n + i] == (f"T {i}\nfirst words of number {i}\nmore words of it" if n < 6 else f"T {i}\nfirst words of number {i}"), (n, i)
    assert by[100] == "Hello\nthere\nyou\nend"


def test_wrappers_choose_the_region(spark):
    from parley.llm.wrappers import extract_main_text, main_text

    page = "<html><body><div class=top>Welcome</div><div class=w><div class=a><p>first {i} with many more words than a counter has</p></div><div class=b><p>second {i} with many more words than a counter has</p><p>{i} third</p>"
    page += "<p>Read our other stories</p></div></div><div class=end>{i} hits</div></body></html>"
    marked = "<html><body><div>{i} x</div><article><p>one {i}</p><p>two {i}</p><p>Only here in all pages</p></article></body></html>"
    rows = [(i, "http://c.x/p", page.format(i=i)) for i in range(6)] + [(10 + i, "http://d.x/p", marked.format(i=i)) for i in range(6)]
    rows += [(20 + i, "http://e.x/p", "<article><p>a copy</p></article>") for i in range(5)] + [(30, "http://f.x", "<p>" + "long " * 300_000 + "</p>")]
    df = spark.createDataFrame([(*r, "own", "w") for r in rows], "page_id long, url string, html string, host string, wrapper string")
    by = {r.page_id: r.text for r in extract_main_text(df).collect()}
    for i in range(6):  # text in sibling containers stays; text of the template goes, but not from an article element
        assert by[i] == f"first {i} with many more words than a counter has\nsecond {i} with many more words than a counter has\n{i} third"
        assert by[10 + i] == f"one {i}\ntwo {i}\nOnly here in all pages"
    assert all(by[20 + i] == "a copy" for i in range(5)) and len(by[30]) == 5 * 300_000 - 1
    assert {r.page_id: r.text for r in extract_main_text(df.orderBy("url", "html").repartition(5)).collect()} == by
    assert extract_main_text(df.limit(0)).count() == 0
    wrong = {"fixed": {}, "region": ["html", "body", "div|end"], "marked": False}
    assert main_text(page.format(i=1), wrong) == "1 hits"


def test_shards_are_a_permutation_and_resume(spark, tmp_path):
    from tokenizers import Tokenizer

    from parley.llm.shards import digest, permute, read_shards, write_shards
    from parley.llm.tokens import default_path

    for n in (1, 2, 5, 64, 1000):
        assert sorted(permute(np.arange(n), n, 7).tolist()) == list(range(n))
    rows = [(i, text(RNG.randint(1, 400))) for i in range(60)] + [(3, "repeated <|endoftext|>"), (3, "repeated <|endoftext|>")] + EDGES
    n = write_shards(docs_of(spark, rows), f"{tmp_path}/a", stride=128, per_shard=50)
    got = read_shards(spark, f"{tmp_path}/a").collect()
    assert sorted(r.slot for r in got) == list(range(n)) and all(len(r.record) == 256 and r.shard == r.slot // 50 for r in got)
    assert digest(read_shards(spark, f"{tmp_path}/a", n - 7), stride=128).count() == 7
    want = Counter()
    tokenizer = Tokenizer.from_file(default_path())
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u2")
        for piece, at in enumerate(range(0, len(ids), 128)):
            want[i, piece, ids[at : at + 128].tobytes()] += 1
    assert Counter((r.doc_id, r.piece, bytes(r.record[: 2 * r.n_tokens])) for r in got) == want
    assert not any(any(r.record[2 * r.n_tokens :]) for r in got)
    assert {(r.slot, r.ids_crc32) for r in digest(read_shards(spark, f"{tmp_path}/a"), stride=128).collect()} == {(r.slot, zlib.crc32(bytes(r.record[: 2 * r.n_tokens]))) for r in got}
    assert write_shards(docs_of(spark, rows).limit(0), f"{tmp_path}/b") == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    from parley.llm.packing import pack, pieces
    from parley.llm.tokens import default_path

    rows = [(i, text(RNG.randint(1, 500)) + " Ünïcode\u00a0x\u2003y e\u0301 it's <|endoftext|>") for i in range(80)] + EDGES
    got = pack(pieces(docs_of(spark, rows), length=256), capacity=256).collect()
    tokenizer = Tokenizer.from_file(default_path())
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i)
        assert own == [(n, at, len(ids[at : at + 256]), zlib.crc32(ids[at : at + 256].tobytes())) for n, at in enumerate(range(0, len(ids), 256))]
    used = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id]
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 256 and len(used) <= 1.03 * math.ceil(sum(used.values()) / 256)


def test_vectors(spark):
    from parley.llm.vectors import near_vectors

    rng = np.random.default_rng(3)
    base = rng.standard_normal((30, 16))
    near = [base[i % 5] + rng.standard_normal(16) * 0.12 for i in range(120)]
    rows = [(i, v.astype(np.float32).astype(float).tolist()) for i, v in enumerate([*base, *near])]
    rows += [(500, rows[0][1]), (501, rows[0][1])]
    bad = [(600, None), (601, []), (602, [0.0] * 16), (603, [1.0, None] + [0.0] * 14), (604, [float("nan")] + [1.0] * 15), (605, [float("inf")] + [1.0] * 15), (None, rows[0][1])]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T >= 0.9
    np.fill_diagonal(s, False)
    roots = components(len(rows), zip(*np.nonzero(np.triu(s)), strict=True))
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")).collect()}
    assert len(got) == len(rows) + len(bad)
    assert [got[r[0]].n_links for r in rows] == s.sum(axis=1).tolist()
    assert [got[r[0]].component_id for r in rows] == [rows[c][0] for c in roots]
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, _ in bad)


def test_vectors_of_any_size(spark):
    from parley.llm.vectors import near_vectors

    rows = [(1, [1e-200, 2e-200]), (2, [1e200, 2e200]), (3, [1.0, 2.0]), (4, [2.0, -1.0]), (5, [1.0, 2.0, 0.0]), (6, [2.0, 4.0, 0.1]), (7, [9.0]), (7, [-9.0]), (7, [9.0])]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<double>, bucket int, digest string, n long")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect())
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True), (5, 1, 5, True), (6, 1, 5, False), (7, 0, 7, True), (7, 1, 7, True), (7, 1, 7, True)]
    assert near_vectors(df.limit(0)).count() == 0


def test_scores(spark):
    from parley.llm.brown import held_out, score_documents

    rows = [(i, text(RNG.randint(0, 80)) + " rare%d" % i) for i in range(200)] + [e for e in EDGES if e[0] is not None]
    df = docs_of(spark, rows).withColumn("held_out", held_out())
    got = {r.doc_id: r for r in score_documents(df).collect()}
    tokens = {i: [*words(t), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert -1e6 < r.score < 0
    assert score_documents(df.limit(0)).count() == 0


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    shared, item = text(70), text(30)
    clean = [(i, text(120)) for i in range(20)]
    near = clean[1][1].split()
    near[40], near[80] = "edit", "edit"  # similarity 106 / 126
    rows = clean + [(100, clean[0][1]), (101, " ".join(near)), (102, text(40) + " " + item), (103, "123 456"), (104, None)]
    rows += [(110, text(60) + " " + shared), (111, text(60) + " " + shared)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {i for i, _ in clean} | {110, 111}
    assert sum(r.length for r in got if r.doc_id == 111) < sum(r.length for r in got if r.doc_id == 110)


def test_passages_with_edits(spark):
    from parley.llm.passages import repeated_passages

    rng = random.Random(31)
    rows, want = [], {}
    for n in range(12):
        passage = [f"p{n}w{i}" for i in range(51 + n + n % 2 * 10)]
        fuzzy = [f"q{n}w{i}" if i % 5 == 4 and i < 50 else w for i, w in enumerate(passage)]
        if n % 2:
            fuzzy[20:21], fuzzy[30:31] = [], ["extra", fuzzy[30]]
        rows += [(2 * n, f"{text(40, rng)} {' '.join(passage)} {text(40, rng)}"), (2 * n + 1, f"{text(40, rng)} {' '.join(fuzzy)} {text(40, rng)}")]
        want[2 * n + 1] = 2 * n
    found = repeated_passages(docs_of(spark, rows)).collect()
    assert {r.doc_id: r.other_id for r in found} == want
    assert all(r.n_same >= 0.8 * max(r.end_word - r.first_word, r.other_end - r.other_first) for r in found)
    texts = {i: words(t) for i, t in rows}
    for r in found:
        own, other = texts[r.doc_id], texts[r.other_id]
        assert (own[r.first_word], own[r.end_word - 1]) == (other[r.other_first], other[r.other_end - 1])


def test_passages_between_middle_documents(spark):
    from parley.llm.passages import repeated_passages

    rows, want = [], set()
    for n in range(8):
        passage = [f"p{n}w{i}" for i in range(60)]
        line = " ".join(passage[:45])
        texts = [line, " ".join(passage), " ".join(passage), line]
        rows += [(4 * n + i, f"{' '.join(f'a{n}x{i}x{k}' for k in range(30))} {t} {' '.join(f'b{n}x{i}x{k}' for k in range(30))}") for i, t in enumerate(texts)]
        want.add((4 * n + 2, 4 * n + 1, 30, 90))
    found = {(r.doc_id, r.other_id, r.first_word, r.end_word) for r in repeated_passages(docs_of(spark, rows)).collect()}
    assert found == want


def test_passages_meet_holders_further_back(spark):
    from parley.llm.passages import repeated_passages

    rng = random.Random(33)
    halves = [" ".join(f"{c}{i}" for i in range(30)) for c in "ab"]
    both = [f"{halves[0]} one {halves[1]}", f"{halves[0]} two {halves[1]}"]
    other = [" ".join(f"z{i}" for i in range(60))] * 9
    texts = halves * 6 + both[:1] + halves + both[1:] + halves + other
    rows = [(i, f"{text(20, rng)} {t} {text(20, rng)}") for i, t in enumerate(texts)]
    found = {(r.doc_id, r.other_id) for r in repeated_passages(docs_of(spark, rows)).collect()}
    assert (15, 12) in found


def test_passages_twice_in_a_document(spark):
    from parley.llm.passages import repeated_passages

    filler = [" ".join(f"f{n}x{i}" for i in range(50)) for n in range(6)]
    passage = [f"w{i}" for i in range(60)]
    full = " ".join(passage)
    rows = [
        (0, f"{filler[0]} {full} {filler[1]}"),
        (1, f"{full} {filler[2]} {full} {filler[3]}"),
        (2, f"{' '.join(passage[10:40])} {filler[4]} {full} {filler[5]}"),
    ]
    covered = {i: set() for i in range(3)}
    for r in repeated_passages(docs_of(spark, rows)).collect():
        covered[r.doc_id].update(range(r.first_word, r.end_word))
    assert covered == {0: set(), 1: {*range(60), *range(110, 170)}, 2: set(range(80, 140))}


def test_passages_of_repeated_ids_and_clashing_names(spark):
    from parley.llm.passages import without_repeated_passages

    shared = text(70)
    long, short = f"{text(30)} {shared} {text(30)}", f"{shared}"
    rows = [(1, f"{shared} {text(10)}"), (2, long), (2, None), (2, "z z"), (2, long), (None, shared), (3, f"{shared} {text(9)}")]
    df = spark.createDataFrame([(*r, 7, "a", [n]) for n, r in enumerate(rows)], "doc_id long, text string, id long, row string, found array<int>")
    got = without_repeated_passages(df)
    assert got.columns == df.columns
    by = {r.found[0]: r.text for r in got.collect()}
    assert len(by) == len(rows) and by[3] == "z z" and by[2] is None and by[5] == shared
    assert len(by[6].split()) == 9 and {len(by[1].split()), len(by[4].split())} <= {60, 130}


def test_language_stage_with_clashing_names(spark):
    import corpus_pipeline

    rows = [(i, "the of and", "en", 0.5, "q", "r") for i in range(4)] + [(9, "1 2", "en", 0.1, "q", "r"), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string, row string")
    got = corpus_pipeline.identify_language(spark, df, "")
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [0, 1, 2, 3]
    assert corpus_pipeline.identify_language(spark, df.limit(0), "").count() == 0


def test_pack_spreads_equal_rows(spark):
    from parley.llm.packing import pack, pieces

    df = spark.createDataFrame([(None, "same text")] * 300 + [(1, "same text")] * 300, "doc_id long, text string")
    got = pack(pieces(df, length=64), capacity=64, pieces_per_task=100, run=50).collect()
    assert len(got) == 600 and all(len(r.ids) == r.length for r in got)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert pack(pieces(df.limit(0))).count() == 0
