"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

For each batch, ``merge_asof`` (keyed by document) finds for each token start of one side the covering token
of the other; both directions together are the overlaps.  An overlap whose tokens end at the same byte closes
a group.  Tokenizers work on units of text that no token crosses (pieces between blanks); each distinct unit
is encoded once for each worker.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.store import discard, materialise, small_batches
from parley.llm.textkit import list_array
from parley.llm.tokens import _byte_alphabet

#: Text of so many characters at most, or one document, is aligned at a time.
CHUNK = 1 << 18
#: Id pairs that are handed out with their counts, the most frequent ones; the others meet theirs in a join.
HANDED = 1 << 20
_CACHED = 300_000
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Side:
    """One tokenizer: ``token`` has the bytes of each id, ``size`` their lengths."""

    token: list[bytes]
    #: Cuts a text, with a blank before it, where no token can cross.
    pattern: re.Pattern

    def __init__(self):
        self.size = np.array([len(t) for t in self.token], dtype=np.int64)
        #: Ids of each unit met so far, as bytes of unsigned 32-bit numbers.
        self._known: dict[str, bytes] = {}

    def units(self, texts: list[str]) -> list[list[int]]:
        """Ids of each unit."""
        raise NotImplementedError

    def encode(self, cut: list[list[str]], fresh: set[str]) -> list[np.ndarray]:
        """Ids of texts given as their units; ``fresh`` are the different units of all."""
        if len(self._known) > _CACHED:
            self._known.clear()
        new = [u for u in fresh if u not in self._known]
        for at in range(0, len(new), 2000):
            part = new[at : at + 2000]
            self._known.update(zip(part, [array("I", ids).tobytes() for ids in self.units(part)], strict=True))
        known = self._known.__getitem__
        return [np.frombuffer(b"".join(map(known, own)), dtype=np.uint32) for own in cut]

    def spells(self, ids: np.ndarray, text: bytes) -> bool:
        """Whether the bytes of the tokens are those of the text."""
        return b"".join(map(self.token.__getitem__, ids.tolist())) == text


class ByteSide(Side):
    """Byte-level BPE that splits texts at blanks before it merges; a single blank goes with the word after it.

    Where ids are the order of merges and texts are split by the usual pattern, the same vocabulary is run by
    tiktoken, which is faster; otherwise by tokenizers.
    """

    pattern = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        letter = {c: b for b, c in _byte_alphabet().items()}
        own = self._tokenizer.get_vocab(with_added_tokens=False)
        marks = self._tokenizer.get_added_tokens_decoder()
        self.token, ranks = [b""] * (max(own.values(), default=-1) + 1), {}
        for written, i in own.items():
            self.token[i] = bytes(letter[c] for c in written) if set(written) <= letter.keys() else written.encode()
            if i not in marks:
                ranks[self.token[i]] = i
        self._ranked = self._by_rank(path, ranks, letter)
        super().__init__()

    @staticmethod
    def _by_rank(path: str, ranks: dict[bytes, int], letter: dict[str, int]):
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        pair = lambda m: m.split(" ") if isinstance(m, str) else m
        merged = [bytes(letter[c] for c in "".join(pair(m))) for m in made["model"].get("merges", []) if set("".join(pair(m))) <= letter.keys()]
        places, split = [ranks.get(m, -1) for m in merged], made.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True) and not made.get("normalizer")
        singles = [ranks.get(bytes([b]), 1 << 30) for b in range(256)]
        if not plain or len(merged) + 256 != len(ranks) or places != sorted(places) or max(singles) > min(places, default=1 << 30):
            return None
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def spells(self, ids: np.ndarray, text: bytes) -> bool:
        # With a rank for each single byte, merges only join the bytes of the text.
        return self._ranked is not None or super().spells(ids, text)

    def units(self, texts: list[str]) -> list[list[int]]:
        if self._ranked is not None:
            return list(map(self._ranked.encode_ordinary, texts))
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class PieceSide(Side):
    """Pieces with byte fallback; pieces have blanks only at their start and never a line end."""

    pattern = re.compile("\n| *[^ \n]+| +")

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        self.token = [bytes([int(p[3:5], 16)]) if self._model.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        if any("\u2581" in p.lstrip("\u2581") or "\n" in p for p in pieces):
            self.pattern = re.compile("(?s).+")
        self._before = self._model.encode("\n")
        super().__init__()

    def units(self, texts: list[str]) -> list[list[int]]:
        # A line end before the unit takes the blank that the model puts before every text.
        return [ids[len(self._before) :] for ids in self._model.encode(["\n" + t for t in texts], num_threads=1)]


def _simple(text: str) -> bool:
    """Whether all white space is single blanks and line ends between words: such a text has the same units on either side."""
    return " ".join(text.split()) == text.replace("\n", " ")


def _encoded(texts: list[str | None], sides: tuple[Side, Side]) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """Ids of blank + text on both sides; None where there are none or they do not spell blank + text."""
    alike = sides[0].pattern is ByteSide.pattern and sides[1].pattern is PieceSide.pattern
    cut = [sides[0].pattern.findall(" " + t) if t else [] for t in texts]
    other = [own if not t or alike and _simple(t) else sides[1].pattern.findall(" " + t) for t, own in zip(texts, cut, strict=True)]
    fresh = set().union(*cut)
    ids = [sides[0].encode(cut, fresh), sides[1].encode(other, fresh.union(*(o for o, c in zip(other, cut, strict=True) if o is not c)))]
    out = []
    for text, *pair in zip(texts, *ids, strict=True):
        raw = (" " + text).encode() if text else b""
        out.append(tuple(pair) if text and all(side.spells(own, raw) for side, own in zip(sides, pair, strict=True)) else None)
    return out


class Sides:
    """The two tokenizers of this worker process."""

    _made: dict[tuple[str, str], tuple[Side, Side]] = {}

    @classmethod
    def of(cls, paths: tuple[str, str]) -> tuple[Side, Side]:
        if paths not in cls._made:
            cls._made[paths] = ByteSide(paths[0]), PieceSide(paths[1])
        return cls._made[paths]


def default_paths() -> tuple[str, str]:
    """Where the environment keeps the two vocabularies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


_LISTS = ["a", "a_end", "b", "b_end", "over_a", "over_b", "cut"]


def _aligned(texts: list[str | None], sides: tuple[Side, Side]) -> list[pa.Array]:
    """The list columns of ``align`` for some texts."""
    both, none = _encoded(texts, sides), np.zeros(0, np.uint32)
    ids = [[none if pair is None else pair[s] for pair in both] for s in (0, 1)]
    n = [np.array([len(x) for x in own]) for own in ids]
    flat = [np.concatenate(own).astype(np.int64) if own else np.zeros(0, np.int64) for own in ids]
    doc = [np.repeat(np.arange(len(texts)), k) for k in n]
    size = [side.size[x] for side, x in zip(sides, flat, strict=True)]
    end = [np.cumsum(s) for s in size]
    first = [np.cumsum(k) - k for k in n]

    frame = [pd.DataFrame({"doc": doc[s], "at": end[s] - size[s], "ab"[s]: np.arange(len(flat[s]))}) for s in (0, 1)]
    there = pd.merge_asof(frame[0], frame[1], on="at", by="doc")
    back = pd.merge_asof(frame[1], frame[0], on="at", by="doc")
    back = back[frame[0]["at"].to_numpy()[back["a"].to_numpy()] != back["at"].to_numpy()]  # starts that are equal are in the other
    over = np.concatenate([there[["a", "b"]].to_numpy(), back[["a", "b"]].to_numpy()])
    over = over[np.lexsort((over[:, 1], over[:, 0]))]
    cut = end[0][over[:, 0]][end[0][over[:, 0]] == end[1][over[:, 1]]]

    base = np.concatenate([[0], np.cumsum(np.bincount(doc[0], weights=size[0], minlength=len(texts)))]).astype(np.int64)
    own, cut_doc = doc[0][over[:, 0]], np.searchsorted(base, cut, side="left") - 1
    per_over, per_cut = np.bincount(own, minlength=len(texts)), np.bincount(cut_doc, minlength=len(texts))
    values = [flat[0], end[0] - base[doc[0]], flat[1], end[1] - base[doc[1]], over[:, 0] - first[0][own], over[:, 1] - first[1][own], cut - base[cut_doc]]
    counts = [n[0], n[0], n[1], n[1], per_over, per_over, per_cut]
    return [list_array(v.astype(np.int32), k, pa.int32()) for v, k in zip(values, counts, strict=True)]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (doc_id, text) cut so that each has CHUNK characters at most, or one row."""
    for batch in batches:
        size = np.array([len(t or "") for t in batch.column(1).to_pylist()])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, at + int(np.searchsorted(np.cumsum(size[at:]), CHUNK, side="right")))
            yield batch.slice(at, to - at)
            at = to


def _align(paths: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = Sides.of(paths)
        for part in _chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), *_aligned(part.column(1).to_pylist(), sides)], names=["doc_id", *_LISTS])

    return run


def align(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): ids and end bytes of the tokens of both sides, the overlaps as places
    of tokens (over_a, over_b), and the bytes at which groups end (cut).

    ``paths``: a byte-level vocabulary of tokenizers (a) and a sentencepiece model (b).  Ends count from the first
    byte of blank + text.  Null and empty texts, and texts whose token bytes are not blank + text, have empty lists.
    Every row is a document, also one that repeats a doc_id or has none.  Other columns are not read.
    """
    small_batches(docs.sparkSession)
    schema = ", ".join(["doc_id long", *(f"{c} array<int>" for c in _LISTS)])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_align(paths or default_paths()), schema)


def _runs(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, number in each row) of a list column."""
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(column.offsets.to_numpy())


class Digest:
    """Counts, written groups and linked id pairs of aligned documents."""

    def __init__(self, sides: tuple[Side, Side]):
        na, nb = (len(s.token) for s in sides)
        self.shift, self._b = max(1, (nb - 1).bit_length()), 2 * na
        self._written = [f"{i}{c}" for i in range(na) for c in (",", "|")] + [f"{i}{c}" for i in range(nb) for c in (",", ";")]

    def of(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        docs = batch.num_rows
        (a, n_a), (a_end, _), (b, n_b), (b_end, _), (cut, n_cut) = (_runs(batch, c) for c in ("a", "a_end", "b", "b_end", "cut"))
        base = np.zeros(docs + 1, np.int64)
        np.cumsum(self._spans(cut, n_cut), out=base[1:])
        whole = cut + np.repeat(base[:-1], n_cut)
        group = [np.searchsorted(whole, end + np.repeat(base[:-1], n), side="left") for end, n in ((a_end, n_a), (b_end, n_b))]
        in_a, in_b = (np.bincount(g, minlength=len(whole)) for g in group)
        of_group = np.repeat(np.arange(docs), n_cut)
        links = np.bincount(of_group, weights=in_a * in_b, minlength=docs).astype(np.int64)
        keys, times = self._pairs(a, b, in_a, in_b, of_group)
        pair, row = keys & ((1 << (2 * self.shift + 1)) - 1), keys >> (2 * self.shift + 1)
        per_row = np.bincount(row, minlength=docs)
        columns = [
            batch.column("doc_id"), pa.array(n_a.astype(np.int64)), pa.array(n_b.astype(np.int64)), pa.array(n_cut.astype(np.int64)), pa.array(links),
            pa.array(self._texts(a, b, group, in_a, in_b, n_a + n_b), pa.string()), list_array(pair, per_row, pa.int64()), list_array(times, per_row, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pair", "times"])

    @staticmethod
    def _spans(cut: np.ndarray, n_cut: np.ndarray) -> np.ndarray:
        """The last cut of each row, its length in bytes; 0 without cuts."""
        out, has = np.zeros(len(n_cut), np.int64), n_cut > 0
        out[has] = cut[(np.cumsum(n_cut) - 1)[has]]
        return out

    def _pairs(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, a id, b id) as one number each, sorted, and how many links of the row each has.

        Groups of few links are written out; of larger ones only the distinct ids of both sides are paired.
        """
        width = 2 * self.shift + 1
        first_a, first_b, links = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b, in_a * in_b
        small = np.flatnonzero(links <= 256)
        g = np.repeat(small, links[small])
        nth = np.arange(len(g)) - np.repeat(np.cumsum(links[small]) - links[small], links[small])
        keys, times = [(row[g] << width) | (a[first_a[g] + nth // in_b[g]] << self.shift) | b[first_b[g] + nth % in_b[g]]], [np.ones(len(g), np.int64)]
        for g in np.flatnonzero(links > 256):
            own_a, of_a = np.unique(a[first_a[g] : first_a[g] + in_a[g]], return_counts=True)
            own_b, of_b = np.unique(b[first_b[g] : first_b[g] + in_b[g]], return_counts=True)
            keys.append(((row[g] << width) | (own_a[:, None] << self.shift) | own_b).reshape(-1))
            times.append((of_a[:, None] * of_b).reshape(-1))
        keys, times = np.concatenate(keys), np.concatenate(times)
        order = np.argsort(keys)
        keys, times = keys[order], times[order]
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        return keys[at], np.add.reduceat(times, at) if len(at) else times

    def _texts(self, a, b, group, in_a, in_b, n) -> list[str]:
        """SHA-256 of the groups of each row as they are written; empty for rows without tokens."""
        last = [np.r_[g[1:] != g[:-1], True] if len(g) else np.zeros(0, bool) for g in group]
        code = np.zeros(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group[0]]] = 2 * a + last[0]
        code[np.arange(len(b)) + np.cumsum(in_a)[group[1]]] = self._b + 2 * b + last[1]
        code, out, at = code.tolist(), [], 0
        for k in n.tolist():
            text = "".join(map(self._written.__getitem__, code[at : at + k]))
            out.append(hashlib.sha256(text[:-1].encode()).hexdigest() if k else "")
            at += k
        return out


def _digest(paths: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Digest(Sides.of(paths))
        for batch in _align(paths)(batches):
            yield own.of(batch)

    return run


def alignment_digest(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """Per row of ``docs``: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, by ``align``.

    Links are all pairs of an a and a b token of a group; the count of an id pair is the number of rows that hold
    it linked.  n_best counts the links whose pair has the highest count of its a id, ties included; count_sum
    adds up the counts over the links.  Rows without tokens have zeros and ''.  See ``align`` for odd rows.
    """
    spark, paths = docs.sparkSession, paths or default_paths()
    small_batches(spark)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair array<long>, times array<long>"
    rows = materialise(read.mapInArrow(_digest(paths), schema).withColumn("row", F.monotonically_increasing_id()), "alignments", "zstd")
    shift = Digest(Sides.of(paths)).shift

    counts = materialise(rows.select(F.explode("pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs", "zstd")
    # One row for each id of the vocabulary at most.
    best = counts.groupBy(F.shiftright("pair", shift).alias("a")).agg(F.max("n").alias("most"))
    told = counts.join(F.broadcast(best), F.shiftright("pair", shift) == best.a).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))

    levels = {r["level"]: r["k"] for r in counts.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count("*").alias("k")).collect()}
    least, handed = 63, 0
    while least > 0 and handed + levels.get(least - 1, 0) <= HANDED:
        least -= 1
        handed += levels.get(least, 0)
    rest = any(level < least for level in levels)
    table = told.where(F.col("n") >= F.lit(1 << least if least < 63 else 2**63 - 1)).toArrow()
    order = np.argsort(table["pair"].to_numpy())
    sent = spark.sparkContext.broadcast(tuple(table[c].to_numpy()[order] for c in ("pair", "n", "best")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, top = sent.value
        for batch in batches:
            pair, per_row = _runs(batch, "pair")
            times, row = _runs(batch, "times")[0], np.repeat(np.arange(batch.num_rows), per_row)
            at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            has = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            np.add.at(sums[0], row[has], times[has] * top[at[has]])
            np.add.at(sums[1], row[has], times[has] * n[at[has]])
            left = np.bincount(row[~has], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in _KEPT), *map(pa.array, sums), list_array(pair[~has], left, pa.int64()), list_array(times[~has], left, pa.int64())],
                names=[*_KEPT, "n_best", "count_sum", "pair", "times"],
            )

    schema = "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, pair array<long>, times array<long>"
    out = rows.select(*_KEPT, "pair", "times").mapInArrow(score, schema)
    if rest:
        out = materialise(out, "alignment_sums", "zstd")
        open_ = out.select("row", F.explode(F.arrays_zip("pair", "times")).alias("p")).select("row", "p.pair", "p.times")
        more = open_.join(told.where(F.col("n") < F.lit(1 << least if least < 63 else 2**63 - 1)), "pair").groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")
        )
        out = out.drop("pair", "times").join(more, "row", "left")
        out = out.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0)))
        discard(rows)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


_KEPT = ["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
