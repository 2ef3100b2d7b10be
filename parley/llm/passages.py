"""Fuzzy passages that repeat across documents: shared k-mers of words are chained, and chains aligned.

Every k-mer of K = 4 words is a seed.  A passage of n words of which four in five match has at least
0.2 n - 3 of them (at most 0.2 n + 1 runs of matching words, each of which loses K - 1), so seven for fifty
words.  Seeds travel as packed arrays by ranges of their hash and are sorted there; those of one document
alone go no further.  Links of a document are grouped by partner and diagonal.  A group whose seeds reach
over enough words is aligned with the partner's text: runs of matching words are chained with gap costs
through a Fenwick tree, and only the word-by-word comparison along a chain accepts a passage.

A seed that many documents hold, or one document several times, is linked with a few of its places only.
Stretches of such seeds, dense or not, that no passage covers then meet every earlier place of their seeds, however
many there are.  Links would grow with the square of the places, so none are made: the places are dealt into blocks
as runs of words, each open stretch visits each block, some blocks at a time, and counts of the seeds and words in
common tell which runs of words to align, until the stretch is covered.  Partners that share too few other seeds for
a group, but stand next to such seeds, are aligned as well.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm import textkit as tk
from parley.llm.store import discard, id_filter, map_only_ids, materialise, may_hold, small_batches, unused_name

K = 4
#: Words that a group's neighbours may be apart; difference of diagonals within a group; seeds it needs.
REACH, DRIFT, LEAST_SEEDS = 64, 24, 5
#: A group on more than twice so many diagonals (lines that recur within a document) is split into such bands.
WIDTH = 48
#: Words at either end of a passage in which its partner may share no seed.
EDGE = 8
#: A seed that so many documents hold is linked between all of them, if none holds it at PLACES and more.
HOLDERS, PLACES = 8, 3
#: Seeds of the denser runs within runs of hot seeds, and words they may be apart: these are asked for on their own
#: as well, as the best chains of a longer stretch may hide what a shorter one shows.
DENSE, APART = 14, 16
#: Words beside a group over which hot seeds may bring it to LEAST_SEEDS.
BESIDE = 4 * REACH
#: Words of a stretch, by which the second round asks for seeds.
STRETCH = 64
#: Words of the clusters of a block, about.
BLOCK = 1 << 23
#: Words of the visits of a round, in words of all clusters.
VISITS = 2
#: Pairs of a run's seed and a cluster that are looked at in one go.
PAIRS = 1 << 20
#: Cost of a word left out of either side of a chain; words by which its runs may overlap.
GAP, SLACK = 0.125, 3
_PART = 1 << 16
_SEEDS = "bucket int, keys binary, sizes binary, ids binary, places binary"
_SHARED = "counts binary, docs binary, places binary"
_HOT = "part int, docs binary, places binary"
_CLUSTER = "doc_id long, first long, end long"
_LINKS = "part int, docs binary, others binary, x binary, y binary, kinds binary"
_GROUP = "doc_id long, other long, left_word long, right_word long, above long, below long, first long, end long, low long, high long, kind long"
_SPAN = "doc_id long, other_id long, first_word long, end_word long, other_first long, other_end long, n_same long"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _packed(x: np.ndarray, kind) -> bytes:
    """Bytes of ``x``, all lowest bytes first, so that the zeros of high bytes compress."""
    x = x.astype(kind)
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unpacked(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(kind)[:, 0]


def _cuts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.r_[np.flatnonzero(np.r_[True, x[1:] != x[:-1]]), len(x)]


def _word_rows(column: pa.Array) -> Iterator[tuple]:
    for first, n, data, offsets in tk.text_chunks(column):
        start, end, row = tk.words(data, offsets)
        yield first, n, tk.word_hashes(data, start, end), row


def _seeds(buckets: int):
    """The seeds of a batch by ranges of their hash, in order of document and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys, docs, places = [], [], []
            for first, n, h, row in _word_rows(batch.column(1)):
                if len(h) < K:
                    continue
                begin = np.searchsorted(row, np.arange(n))
                total = np.zeros(len(h) - K + 1, dtype=np.uint64)
                for j in range(K):
                    total += h[j : len(h) - K + 1 + j] * tk._WORD[j]
                at = np.flatnonzero(row[: len(total)] == row[K - 1 :])
                keys.append(tk.mix(total[at]))
                docs.append((first + row[at]).astype(np.int32))
                places.append((at - begin[row[at]]).astype(np.int32))
            if not sum(map(len, keys)):
                continue
            key, doc, pos = np.concatenate(keys), np.concatenate(docs), np.concatenate(places)
            bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            key, doc, pos, bucket = key[order].astype(np.uint32), doc[order], pos[order], bucket[order]
            rows: list[tuple] = []
            cut = _cuts(bucket)
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                own = _cuts(doc[a:b])
                rows.append((int(bucket[a]), key[a:b].tobytes(), _packed(np.diff(own), np.uint32), _packed(ids[doc[a:b][own[:-1]]], np.int64), _packed(pos[a:b], np.int32)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*rows, strict=True))], names=_names(_SEEDS)
            )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of the seeds that several documents hold, sorted by seed, document and place."""

    def close(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        key, doc, pos = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        order = np.argsort(key, kind="stable")
        key, doc, pos = key[order], doc[order], pos[order]
        cut = _cuts(key)
        shared = np.minimum.reduceat(doc, cut[:-1]) < np.maximum.reduceat(doc, cut[:-1])
        keep = np.repeat(shared, np.diff(cut))
        key, doc, pos = key[keep], doc[keep], pos[keep]
        if not len(key):
            return
        order = np.lexsort((pos, doc, key))
        key, doc, pos = key[order], doc[order], pos[order]
        begins = _cuts(key)
        row = np.flatnonzero(np.diff(begins[:-1] // _PART, prepend=-1))
        for i, j in zip(row, np.r_[row[1:], len(begins) - 1], strict=True):
            a, b = begins[i], begins[j]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c], pa.binary()) for c in (_packed(np.diff(begins[i : j + 1]), np.int32), _packed(doc[a:b], np.int64), _packed(pos[a:b], np.int32))],
                names=_names(_SHARED),
            )

    held, now = [], None
    for batch in batches:
        for bucket, keys, sizes, ids, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != now:
                yield from close(held)
                now = bucket
            held.append((np.frombuffer(keys, np.uint32), np.repeat(_unpacked(ids, np.int64), _unpacked(sizes, np.uint32)), _unpacked(places, np.int32)))
    yield from close(held)


def _partners(holder: np.ndarray, rank: np.ndarray, held_by: np.ndarray) -> Iterator[tuple]:
    """(occurrences, holders that each meets): every earlier holder of a seed that up to HOLDERS documents have.

    In a seed that more have, each holder meets the first and the one before; what they leave open meets all in ``_meet``.
    """
    few = held_by <= HOLDERS
    for back in range(1, HOLDERS):
        at = np.flatnonzero((few | (back == 1)) & (rank >= back))
        yield at, holder[at] - back
    at = np.flatnonzero(~few & (rank >= 2))
    yield at, holder[at] - rank[at]


def _by_part(doc, other, x, y, kind, parts: int) -> pa.RecordBatch:
    """Links packed by the part of documents that they go to."""
    part = (tk.mix(doc.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part, doc, other, x, y, kind = (c[order] for c in (part, doc, other, x, y, kind))
    rows = []
    cut = _cuts(part) if len(part) else np.zeros(1, np.int64)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        rows.append((int(part[a]), _packed(doc[a:b], np.int64), _packed(other[a:b], np.int64), _packed(x[a:b], np.int32), _packed(y[a:b], np.int32), kind[a:b].astype(np.int8).tobytes()))
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(cols)], names=_names(_LINKS))


def _occurrences(counts: bytes, docs: bytes, places: bytes) -> tuple[np.ndarray, ...]:
    """(document, place, begin and end of the holders, number of the own one, its rank in the seed, holders, heat, first occurrence of the seed).

    Heat is 1 for a seed that more than HOLDERS documents hold, else 3 if one holds it at PLACES and more, else 0.
    """
    counts, doc, pos = _unpacked(counts, np.int32), _unpacked(docs, np.int64), _unpacked(places, np.int32)
    key = np.repeat(np.arange(len(counts)), counts)
    fresh = np.r_[True, key[1:] != key[:-1]]
    begin = np.flatnonzero(fresh | np.r_[True, doc[1:] != doc[:-1]])
    end = np.r_[begin[1:], len(key)]
    holder = np.repeat(np.arange(len(begin)), end - begin)
    seed = np.cumsum(fresh[begin]) - 1
    first = np.flatnonzero(fresh[begin])
    rank = (np.arange(len(begin)) - first[seed])[holder]
    held_by, most = np.bincount(seed)[seed][holder], np.maximum.reduceat(end - begin, first)[seed][holder]
    heat = np.where(held_by > HOLDERS, 1, np.where(most >= PLACES, 3, 0)).astype(np.int8)
    return doc, pos, begin, end, holder, rank, held_by, heat, np.flatnonzero(fresh)[key]


def _links(parts: int):
    """Links of each occurrence with earlier documents; its partner's first, last and like-numbered place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc, pos, begin, end, holder, rank, held_by, heat, _ = _occurrences(*row)
                nth = np.arange(len(doc)) - begin[holder]
                for at, other in _partners(holder, rank, held_by):
                    a, b = begin[other], end[other] - 1
                    same = np.minimum(a + nth[at], b)
                    for there, some in ((a, slice(None)), (b, b > a), (same, (same > a) & (same < b))):
                        i, j = at[some], there[some]
                        if len(i):
                            found.append((doc[i], doc[j], pos[i], pos[j], heat[i]))
                    if sum(len(f[0]) for f in found) > 2 * _PART:
                        yield _by_part(*(np.concatenate(c) for c in zip(*found, strict=True)), parts)
                        found.clear()
        if found:
            yield _by_part(*(np.concatenate(c) for c in zip(*found, strict=True)), parts)

    return run


def _hot(parts: int, wanted):
    """The places, by documents, of all hot seeds that stand in one of the stretches ``wanted`` of some document."""

    def packed(found: list[tuple]) -> pa.RecordBatch:
        doc, pos = (np.concatenate(c) for c in zip(*found, strict=True))
        found.clear()
        part = (tk.mix(doc.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part, doc, pos = part[order], doc[order], pos[order]
        cut = _cuts(part)
        rows = [(int(part[a]), _packed(doc[a:b], np.int64), _packed(pos[a:b], np.int32)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*rows, strict=True))], names=_names(_HOT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc, pos, *_, heat, first = _occurrences(*row)
                hot, asked = heat > 0, np.zeros(len(doc), dtype=bool)
                asked[hot] = wanted.value.holds(doc[hot] ^ (pos[hot].astype(np.int64) // STRETCH << 40))
                some = np.zeros(len(doc), dtype=bool)
                some[first[asked]] = True
                at = np.flatnonzero(some[first])
                if len(at):
                    found.append((doc[at], pos[at]))
                if sum(len(f[0]) for f in found) > 4 * _PART:
                    yield packed(found)
        if found:
            yield packed(found)

    return run


def _groups(least_words: int, share: float):
    """Groups of links of like diagonal that may be a passage (kind 0) or are one as they stand (kind: the
    words of their seeds, all on one diagonal), runs of hot seeds (kind 1), and groups that may be a passage only if
    their partner holds the hot seeds next to them as well (kind -1).  Links come with their heat.

    A group's words to align reach over the hot seeds next to it, as those may be linked with others
    than this partner.  Groups of which another partner's sure passage covers all but EDGE words go.
    """
    kinds = (np.int64, np.int64, np.int32, np.int32, np.int8)

    def group(doc, other, x, y, kind) -> Iterator[pa.RecordBatch]:
        order = np.argsort(doc, kind="stable")
        doc, other, x, y, kind = (c[order] for c in (doc, other, x, y, kind))
        whole = (np.cumsum(np.r_[True, doc[1:] != doc[:-1]]) << 32) + x
        hot, warm = np.unique(whole[kind == 1]), kind % 2 == 1
        run_of, at = np.unique(whole[warm], return_index=True)
        run_doc = doc[warm][at]
        breaks = np.flatnonzero(np.r_[True, np.diff(hot) > REACH]) if len(hot) else hot
        run = np.searchsorted(breaks, np.arange(len(hot)), side="right") - 1
        run_end = np.r_[breaks[1:], len(hot)] - 1
        for least_seeds, apart in ((LEAST_SEEDS, REACH), (DENSE, APART)) if len(run_of) else ():
            first = np.flatnonzero(np.r_[True, np.diff(run_of) > apart])
            last = np.r_[first[1:], len(run_of)] - 1
            enough = (last - first + 1 >= least_seeds) & (run_of[last] - run_of[first] + K >= least_words - 2 * EDGE)
            first, last = first[enough], last[enough]
            zero, low = np.zeros(len(first), np.int64), run_of[first] & 0xFFFFFFFF
            cols = [run_doc[first], zero, low, low + run_of[last] - run_of[first] + K, *[zero] * 6, zero + 1]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=_names(_GROUP))
        x, y = x.astype(np.int64), y.astype(np.int64)
        order = np.lexsort((x - y, other, whole >> 32))
        doc, other, x, y, whole, kind = (c[order] for c in (doc, other, x, y, whole, kind))
        diagonal = x - y
        line = np.cumsum(np.r_[False, (doc[1:] != doc[:-1]) | (other[1:] != other[:-1]) | (np.diff(diagonal) > DRIFT)])
        first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
        least, most = diagonal[first], diagonal[np.r_[first[1:], len(line)] - 1]
        cell = np.where((most - least > 2 * WIDTH)[line], (diagonal - least[line]) // WIDTH, 0)
        line = np.cumsum(np.r_[False, (line[1:] != line[:-1]) | (cell[1:] != cell[:-1])])
        order = np.lexsort((x, line))
        doc, other, x, y, whole, line, diagonal, kind = (c[order] for c in (doc, other, x, y, whole, line, diagonal, kind))
        begin = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (np.diff(x) > REACH)])
        end = np.r_[begin[1:], len(x)] - 1
        seeds = np.add.reduceat(np.r_[True, np.diff(whole) != 0].astype(np.int64), begin)
        p0, p1 = whole[begin], whole[end]
        good = (seeds >= LEAST_SEEDS) & (p1 + K - p0 >= least_words - 2 * EDGE)
        one = np.minimum.reduceat(diagonal, begin) == np.maximum.reduceat(diagonal, begin)
        low, high = np.searchsorted(hot, p0 - REACH), np.searchsorted(hot, p1 + REACH, side="right")
        own = high - low == np.searchsorted(hot, p1, side="right") - np.searchsorted(hot, p0)
        step = np.r_[np.minimum(np.diff(x), K), K]
        step[end] = K
        same = np.add.reduceat(step, begin)
        sure = one & own & (same >= share * (p1 + K - p0)) & (p1 + K - p0 >= least_words)
        before, after, hot_ones = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        some = np.flatnonzero(high > low)
        before[some] = np.maximum(0, p0[some] - hot[breaks[run[low[some]]]])
        after[some] = np.maximum(0, hot[run_end[run[high[some] - 1]]] - p1[some])
        f, e = p0 - np.minimum(before, BESIDE), p1 + np.minimum(after, BESIDE)
        hot_ones[some] = np.searchsorted(hot, e[some], side="right") - np.searchsorted(hot, f[some])
        mixed = ~good & (hot_ones > 0) & (seeds + hot_ones >= LEAST_SEEDS) & (e + K - f >= least_words - 2 * EDGE)
        mixed &= np.logical_or.reduceat(kind != 1, begin)
        f, e = np.where(mixed, f, p0), np.where(mixed, e, p1)
        by = np.flatnonzero(good & sure)
        if len(by):
            by = by[np.argsort(p0[by], kind="stable")]
            near = np.searchsorted(p0[by], f + EDGE, side="right") - 1
            left_open = (near < 0) | (np.maximum.accumulate(p1[by] + K)[near] < e + K - EDGE)
            good, mixed = good & (sure | left_open), mixed & left_open
        left, right = x[begin] - np.where(mixed, p0 - f, before), x[end] + np.where(mixed, e - p1, after)
        left, right = np.maximum(0, left - REACH), right + K + REACH
        above, below = np.maximum(0, np.minimum.reduceat(y, begin) - (x[begin] - left) - DRIFT), np.maximum.reduceat(y, begin) + right - x[end] + DRIFT
        cols = [doc[begin], other[begin], left, right, above, below, x[begin] - (p0 - f), x[end] + K + e - p1, np.minimum.reduceat(diagonal, begin), np.maximum.reduceat(diagonal, begin), np.where(mixed, -1, same * sure)]
        yield pa.RecordBatch.from_arrays([pa.array(c[good | mixed].astype(np.int64)) for c in cols], names=_names(_GROUP))

    def joined(held: list) -> list[np.ndarray]:
        """The columns of ``held``, which is emptied first: a part's links are held once."""
        columns = [list(c) for c in zip(*held, strict=True)]
        held.clear()
        return [np.concatenate(columns.pop(0)) for _ in range(len(kinds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for part, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now and held:
                    yield from group(*joined(held))
                now = part
                held.append([_unpacked(c, kind) for c, kind in zip(packed, kinds, strict=True)])
        if held:
            yield from group(*joined(held))

    return run


def _spans(i: np.ndarray, j: np.ndarray, least_words: int, share: float) -> list[tuple[int, int]]:
    """Fewest runs [p, q] of a path's matches that cover all its passages; each is one itself."""
    n = len(i)
    if n < share * least_words:
        return []
    at, limit = np.arange(n), 1 - share + 1e-9
    sides = [at - share * (x - x[0]) for x in (i, j)]
    # The greatest surplus from a match on never grows, so the last match of a side's passage is found by bisection.
    later = [np.maximum.accumulate(s[::-1])[::-1] for s in sides]
    longest = np.minimum(*(np.searchsorted(-x, limit - s, side="right") - 1 for s, x in zip(sides, later, strict=True)))
    while True:
        wrong = np.flatnonzero((longest > at) & ((sides[0][longest] < sides[0] - limit) | (sides[1][longest] < sides[1] - limit)))
        if not len(wrong):
            break
        longest[wrong] -= 1
    longest[np.minimum(i[longest] - i, j[longest] - j) + 1 < least_words] = -1
    found, done = [], -1
    while True:
        p = np.flatnonzero(longest > done)
        if not len(p):
            return found
        p = p[p <= max(done + 1, p[0])]
        best = int(p[longest[p].argmax()])
        done = int(longest[best])
        found.append((best, done))


def _trimmed(i: np.ndarray, j: np.ndarray, p: int, q: int, least_words: int, share: float) -> tuple[int, int]:
    """[p, q] without ends that differ more than they match, where what is left is a passage too."""
    others = np.maximum(np.diff(i[p : q + 1]), np.diff(j[p : q + 1])) - 1
    score = np.zeros(q - p + 1, np.int64)
    np.cumsum(1 - 2 * others, out=score[1:])
    a = p + int(score.argmin())
    b = a + int(score[a - p :].argmax())
    for first, end in ((a, b), (a, q), (p, p + int(score.argmax()))):
        longer = max(i[end] - i[first], j[end] - j[first]) + 1
        if min(i[end] - i[first], j[end] - j[first]) + 1 >= least_words and end - first + 1 >= share * longer - 1e-9:
            return first, end
    return p, q


def _may_hold(a: np.ndarray, b: np.ndarray, least_words: int, share: float) -> bool:
    """Whether some run of ``a`` is long enough and has ``share`` of its words anywhere in ``b``."""
    n = len(a)
    if n < least_words or not len(b):
        return False
    there = np.sort(b)
    inside = there[np.minimum(np.searchsorted(there, a), len(there) - 1)] == a
    gain = np.zeros(n + 1)
    np.cumsum(inside - share, out=gain[1:])
    return bool((gain[least_words:] - np.minimum.accumulate(gain)[: n + 1 - least_words] > -1e-6).any())


def _diagonal(a: np.ndarray, b: np.ndarray, d: int, first: int, end: int) -> np.ndarray:
    """Places first <= i < end of ``a`` that match ``b`` at i - d."""
    first, end = max(first, d, 0), min(end, len(a), len(b) + d)
    return np.flatnonzero(a[first:end] == b[first - d : end - d]) + first if end > first else np.zeros(0, np.int64)


def _path(a: np.ndarray, b: np.ndarray, run: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Matches along a chain of runs (i, j, length), the words between and around them compared as well."""
    i0, j0, _ = run[0]
    parts = [(_diagonal(a, b, i0 - j0, 0, i0), i0 - j0)]
    i, j = i0, j0
    for k, (p, q, length) in enumerate(run):
        before, d = i - j, p - q
        if k and d == before:
            parts.append((_diagonal(a, b, d, i, p), d))
        elif k:
            gap = min(p - i, q - j)
            one, two = np.zeros(gap + 1, np.int64), np.zeros(gap + 1, np.int64)
            one[1:] = np.cumsum(a[i : i + gap] == b[j : j + gap])
            two[:-1] = np.cumsum((a[p - gap : p] == b[q - gap : q])[::-1])[::-1]
            cut = int((one + two).argmax())
            parts += [(_diagonal(a, b, before, i, i + cut), before), (_diagonal(a, b, d, p - gap + cut, p), d)]
        parts.append((np.arange(p, p + length), d))
        i, j = p + length, q + length
    parts.append((_diagonal(a, b, i - j, i, len(a)), i - j))
    return np.concatenate([x for x, _ in parts]), np.concatenate([x - d for x, d in parts])


class _PrefixMax:
    """Fenwick tree: the greatest (score, owner) among the places before one."""

    def __init__(self, n: int):
        self._best: list[tuple[float, int]] = [(0.0, -1)] * (n + 1)

    def put(self, at: int, score: float, owner: int) -> None:
        at += 1
        while at < len(self._best):
            if score > self._best[at][0]:
                self._best[at] = (score, owner)
            at += at & -at

    def before(self, at: int) -> tuple[float, int]:
        found = (0.0, -1)
        while at:
            if self._best[at][0] > found[0]:
                found = self._best[at]
            at -= at & -at
        return found


def _best_chain(runs: list[tuple[int, int, int]]) -> tuple[float, list[int]]:
    """Score and members of the best chain of ``runs`` (i, j, length), which are sorted.

    A chain scores its matching words less GAP for each word between its runs on either side.  Sums of
    both sides' places turn the gap cost into a term of each run, so the best predecessor is a prefix maximum.
    """
    places = sorted({j + max(1, n - SLACK) for _, j, n in runs})
    rank = {j: at for at, j in enumerate(places)}
    starts = np.searchsorted(places, [j for _, j, _ in runs], side="right").tolist()
    tree, open_runs = _PrefixMax(len(places)), []
    score, back = [0.0] * len(runs), [-1] * len(runs)
    for k, (i, j, n) in enumerate(runs):
        while open_runs and open_runs[0][0] <= i:
            _, m = heapq.heappop(open_runs)
            p, q, length = runs[m]
            tree.put(rank[q + max(1, length - SLACK)], score[m] + GAP * (p + q + 2 * length), m)
        best, owner = tree.before(starts[k])
        best -= GAP * (i + j)
        score[k], back[k] = (n + best, owner) if owner >= 0 and best > 0 else (n, -1)
        heapq.heappush(open_runs, (i + max(1, n - SLACK), k))
    k = int(np.argmax(score))
    found, total = [], score[k]
    while k >= 0:
        found.append(k)
        k = back[k]
    return total, found[::-1]


def _runs(a: np.ndarray, b: np.ndarray, low: int, high: int) -> list[tuple[int, int, int]]:
    """Runs (i, j, length) of three matching words and more on the diagonals ``low`` to ``high``, sorted."""
    n, low, high = len(a), max(low, 1 - len(b)), min(high, len(a) - 1)
    if high < low:
        return []
    # Row r compares a[i] with b[i - high + r]; places outside b match nothing.
    padded = np.full(n + high - low, -1, dtype=np.int64)
    at = np.arange(max(0, -high), min(len(b), n - low))
    padded[at + high] = b[at]
    same = np.zeros((high - low + 1, n + 2), dtype=np.int8)
    same[:, 1:-1] = np.lib.stride_tricks.sliding_window_view(padded, n) == a
    turn = np.diff(same, axis=1)
    row, first = np.nonzero(turn == 1)
    length = np.nonzero(turn == -1)[1] - first
    row, first, length = row[length > 2], first[length > 2], length[length > 2]
    order = np.lexsort((row, first))
    return list(zip(first[order].tolist(), (first + row - high)[order].tolist(), length[order].tolist(), strict=True))


def align(a: np.ndarray, b: np.ndarray, low: int, high: int, first: int, end: int, least_words: int, share: float) -> list[tuple]:
    """Passages (first, end, first, end, matching words) of two runs of words near the diagonals ``low`` to ``high``.

    Chains are taken best first, as long as they have passages; runs within words found before are dropped.
    """

    def passages(i: np.ndarray, j: np.ndarray) -> list[tuple]:
        found = [_trimmed(i, j, p, q, least_words, share) for p, q in _spans(i, j, least_words, share)]
        return [(int(i[p]), int(i[q]) + 1, int(j[p]), int(j[q]) + 1, q - p + 1) for p, q in found]

    if not _may_hold(a, b, least_words, share) or not _may_hold(b, a, least_words, share):
        return []
    for d in {low, high}:
        i = _diagonal(a, b, d, 0, len(a))
        found = passages(i, i - d)
        if any(p[0] <= first and end <= p[1] for p in found):
            return found
    runs, found = _runs(a, b, low - DRIFT, high + DRIFT), []
    left = np.ones(len(a), dtype=np.int64)
    while sum(n for _, _, n in runs) >= 0.4 * least_words:
        score, members = _best_chain(runs)
        if score < 0.4 * least_words:
            break
        chain, i, j = [], 0, 0
        for k in members:
            p, q, n = runs[k]
            over = max(0, i - p, j - q)
            if over < n:
                chain.append((p + over, q + over, n - over))
                i, j = p + n, q + n
        more = passages(*_path(a, b, chain))
        if not more:
            break
        found += more
        for p in more:
            left[p[0] : p[1]] = 0
        before, used = np.r_[0, np.cumsum(left)].tolist(), set(members)
        runs = [r for k, r in enumerate(runs) if k not in used and before[r[0] + r[2]] - before[r[0]] > 2]
    return found


def _hash_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, n, h, row in _word_rows(batch.column(1)):
            short = (h >> np.uint64(32)).astype(np.uint32)
            cut = np.searchsorted(row, np.arange(n + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, n), pa.array([short[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())],
                names=["doc_id", "words"],
            )


def _aligned(least_words: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: set[tuple] = set()
            for doc, other, left, above, first, end, low, high, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shift = left - above
                for f, e, g, d, same in align(
                    np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32), low - shift, high - shift, first - left, end - left, least_words, share
                ):
                    out.add((doc, other, f + left, e + left, g + above, d + above, same))
            cols = list(zip(*sorted(out), strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=_names(_SPAN))

    return run


def _align_groups(groups: DataFrame, docs: DataFrame, least_words: int, share: float, tasks: int) -> DataFrame:
    """Passages of the groups; only the words of documents that stand in one are written and shuffled.

    The partners' words travel with the groups, in rounds that take about as many words as those documents have.
    """
    ids = groups.select("doc_id").unionByName(groups.select(F.col("other").alias("doc_id"))).distinct()
    words = materialise(map_only_ids(docs, ids, "doc_id", _hash_arrays, "doc_id long, words binary"), "words")
    size = words.agg(F.sum(F.length("words") / 4)).first()[0] or 1
    rounds, found = int((groups.agg(F.sum(F.col("below") - F.col("above"))).first()[0] or 0) // size) + 1, []
    two = words.select(F.col("doc_id").alias("other"), F.col("words").alias("theirs"))
    for k in range(rounds):
        some = groups.where(F.expr(f"pmod(xxhash64(doc_id, other), {rounds}) = {k}"))
        some = some.join(two, "other").withColumn("theirs", F.expr("substring(theirs, int(4 * above + 1), int(4 * (below - above)))"))
        # The partner may be one document for many groups, so they are dealt anew by document, however the joins run.
        cut = some.repartition(tasks, "doc_id").join(words, "doc_id").selectExpr(
            "doc_id", "other", "left_word", "above", "first", "end", "low", "high",
            "substring(words, int(4 * left_word + 1), int(4 * (right_word - left_word))) as own", "theirs",
        )
        found.append(materialise(cut.mapInArrow(_aligned(least_words, share), _SPAN), "passages"))
    discard(words)
    if rounds == 1:
        return found[0]
    out = materialise(functools.reduce(DataFrame.unionByName, found), "passages")
    for table in found:
        discard(table)
    return out


def _clusters(least_words: int, share: float):
    """Where the wanted seeds of each document stand: places no more than 2 * REACH apart, and REACH words around.

    A passage's seeds reach over all but 2 * EDGE of its words, and its sides differ by at most a part 1 - share.
    """
    reach = share * least_words - 2 * EDGE

    def close(held: list[tuple]) -> pa.RecordBatch:
        doc, pos = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((pos, doc))
        doc, pos = doc[order], pos[order].astype(np.int64)
        begin = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (np.diff(pos) > 2 * REACH)])
        end = np.r_[begin[1:], len(doc)] - 1
        some = (end - begin + 1 >= LEAST_SEEDS) & (pos[end] + K - pos[begin] >= reach)
        begin, end = begin[some], end[some]
        cols = [doc[begin], np.maximum(0, pos[begin] - REACH), pos[end] + K + REACH]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=_names(_CLUSTER))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for part, docs, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now and held:
                    yield close(held)
                now = part
                held.append((_unpacked(docs, np.int64), _unpacked(places, np.int32)))
        if held:
            yield close(held)

    return run


def _seed_names(words: np.ndarray) -> np.ndarray:
    total = np.zeros(max(0, len(words) - K + 1), dtype=np.uint64)
    for j in range(K):
        total += words[j : len(words) - K + 1 + j].astype(np.uint64) * tk._WORD[j]
    return tk.mix(total)


def _slot(words: np.ndarray) -> np.ndarray:
    return (words & np.uint32(0xFFFFF)).astype(np.int64)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class _Block:
    """Clusters of a block by their seeds and by their words.

    Seeds go by 40 bits of their names and words by 20: two that fall together make a cluster look closer than it is.
    """

    def __init__(self, rows: list[tuple[int, int, np.ndarray]]):
        self.doc = np.array([d for d, _, _ in rows], np.int64)
        self.first = [f for _, f, _ in rows]
        self.words = [w for _, _, w in rows]
        all_words, size = np.concatenate(self.words), np.array([len(w) for w in self.words])
        cluster = np.repeat(np.arange(len(rows)), size)
        pair, self._counts = self._counted((cluster << 20) + _slot(all_words))
        self._word, self._word_at = pair & 0xFFFFF, np.searchsorted(pair >> 20, np.arange(len(rows) + 1))
        name = _seed_names(all_words)
        inside = cluster[: len(name)] == cluster[len(cluster) - len(name) :]
        pair, self._times = self._counted((name[inside] >> np.uint64(24) << np.uint64(24)) + cluster[: len(name)][inside].astype(np.uint64))
        self._held_by = (pair & np.uint64(0xFFFFFF)).astype(np.int64)
        self._seed_at = _cuts(pair >> np.uint64(24)) if len(pair) else np.zeros(1, np.int64)
        self._seeds = pair[self._seed_at[:-1]] >> np.uint64(24)
        self._asked = np.zeros(1 << 20, np.int64)

    @staticmethod
    def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of ``x``, sorted, and how often each stands there."""
        x = np.sort(x)
        cut = _cuts(x) if len(x) else np.zeros(1, np.int64)
        return x[cut[:-1]], np.diff(cut)

    def sharing(self, docs: list[int], names: list[np.ndarray], least_words: int) -> list[np.ndarray]:
        """For each of several runs of words (cluster, first and last place of a shared seed) of the earlier documents' clusters that share enough seeds.

        Enough are LEAST_SEEDS over enough words.  Seeds are looked up for all runs at once.
        """
        n, size = len(self.doc), np.array([len(x) for x in names])
        out = [np.zeros((0, 3), np.int64)] * len(names)
        if not len(self._seeds) or not size.sum():
            return out
        name, at = np.unique(np.concatenate(names) >> np.uint64(24), return_inverse=True)
        seed = np.minimum(np.searchsorted(self._seeds, name), len(self._seeds) - 1)
        there = np.flatnonzero((self._seeds[seed] == name)[at])
        if not len(there):
            return out
        token = np.repeat(np.arange(len(names)), size)[there] * len(self._seeds) + seed[at[there]]
        place = _ranges(np.zeros(len(names), np.int64), size)[there]
        order = np.argsort(token, kind="stable")
        token, place = token[order], place[order]
        cut = _cuts(token)
        first, last, times = place[cut[:-1]], place[cut[1:] - 1], np.diff(cut)
        run, seed = np.divmod(token[cut[:-1]], len(self._seeds))
        begin = self._seed_at[seed]
        upto = np.r_[0, np.cumsum(self._seed_at[seed + 1] - begin)]
        of_run = np.searchsorted(run, np.arange(len(names) + 1))
        doc, reach = np.array(docs, np.int64), least_words - 2 * EDGE

        def pairs(a: int, b: int, runs_from: int) -> Iterator[tuple]:
            """(tokens, pairs of a run and a cluster, clusters) of the tokens a to b, PAIRS at a time."""
            while a < b:
                stop = min(b, max(a + 1, int(np.searchsorted(upto, upto[a] + PAIRS, side="right")) - 1))
                n_of = np.diff(upto[a : stop + 1])
                of, held = np.repeat(np.arange(a, stop), n_of), _ranges(begin[a:stop], n_of)
                early = np.flatnonzero(self.doc[self._held_by[held]] < doc[run[of]])
                of, held = of[early], held[early]
                yield of, (run[of] - runs_from) * n + self._held_by[held], self._times[held]
                a = stop

        a = 0
        while a < len(names):
            b = int(np.searchsorted(upto[of_run], upto[of_run[a]] + PAIRS, side="right")) - 1
            b = min(max(a + 1, min(b, a + max(1, 4 * PAIRS // n))), len(names))
            parts = pairs(of_run[a], of_run[b], a)
            if upto[of_run[b]] - upto[of_run[a]] <= PAIRS:
                parts = list(parts)
            seeds = np.zeros((b - a) * n)
            for of, pair, held in parts:
                seeds += np.bincount(pair, np.minimum(times[of], held), len(seeds))
            good = np.flatnonzero(seeds >= LEAST_SEEDS)
            low, high = np.full(len(good), np.iinfo(np.int64).max), np.full(len(good), -1)
            for of, pair, _ in parts if isinstance(parts, list) else pairs(of_run[a], of_run[b], a):
                some = np.flatnonzero(seeds[pair] >= LEAST_SEEDS)
                number = np.searchsorted(good, pair[some])
                np.minimum.at(low, number, first[of[some]])
                np.maximum.at(high, number, last[of[some]])
            far = high + K - low >= reach
            good, low, high = good[far], low[far], high[far]
            of, cluster = np.divmod(good, n)
            cut = np.searchsorted(of, np.arange(b - a + 1))
            for k in np.flatnonzero(np.diff(cut)):
                own = slice(cut[k], cut[k + 1])
                out[a + k] = np.stack([cluster[own], low[own], high[own]], axis=1)
            a = b
        return out

    def partners(self, a: np.ndarray, sharing: np.ndarray, least_words: int, share: float) -> np.ndarray:
        """Those of the rows ``sharing`` whose clusters may hold a passage of the words ``a``: with enough words in common, most first."""
        good, low, high = sharing.T
        word, number, count = np.unique(_slot(a), return_inverse=True, return_counts=True)
        self._asked[word] = count
        size = self._word_at[good + 1] - self._word_at[good]
        common = np.zeros(len(good), np.int64)
        for k in range(0, len(good), 1 << 12):
            some = slice(k, k + (1 << 12))
            entry = _ranges(self._word_at[good[some]], size[some])
            common[some] = np.add.reduceat(np.minimum(self._asked[self._word[entry]], self._counts[entry]), np.cumsum(size[some]) - size[some])
        order = np.argsort(-common, kind="stable")
        order = order[common[order] >= share * least_words - 1e-9]
        self._asked[word] = np.arange(1, len(word) + 1)
        rows = max(1, (1 << 19) // len(a))
        order = np.concatenate([k[self._dense(good[k], number + 1, least_words, share)] for k in (order[j : j + rows] for j in range(0, len(order), rows))] or [order])
        self._asked[word] = 0
        return np.stack([good[order], low[order], high[order]], axis=1)

    def _dense(self, clusters: np.ndarray, number: np.ndarray, least_words: int, share: float) -> np.ndarray:
        """Whether some run of the words numbered ``number`` (as in ``_asked``) is long enough, has ``share`` of them and its ends in the cluster."""
        n = len(number)
        if n < least_words:
            return np.zeros(len(clusters), dtype=bool)
        size = self._word_at[clusters + 1] - self._word_at[clusters]
        holds = np.zeros((len(clusters), int(number.max()) + 1), dtype=bool)
        holds[np.repeat(np.arange(len(clusters)), size), self._asked[self._word[_ranges(self._word_at[clusters], size)]]] = True
        inside = holds[:, number]
        gain = np.zeros((len(clusters), n + 1))
        np.cumsum(inside - share, axis=1, out=gain[:, 1:])
        least = np.minimum.accumulate(np.where(inside, gain[:, :-1], np.inf), axis=1)[:, : n + 1 - least_words]
        return ((gain[:, least_words:] - least > -1e-6) & inside[:, least_words - 1 :]).any(axis=1)


def _bands(names: np.ndarray, others: np.ndarray, least_words: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(first and last place, least and greatest diagonal, least and greatest place in the other) of the groups of links of two lists of seeds.

    Where a seed recurs at once (a word over and over), two such runs are linked from their begins and from their ends.
    """

    def runs(x: np.ndarray) -> tuple[np.ndarray, ...]:
        cut = _cuts(x)
        return x[cut[:-1]], cut[:-1], np.diff(cut)

    name, p, size = runs(names)
    other, q, other_size = runs(others)
    order = np.argsort(other, kind="stable")
    other, q, other_size = other[order], q[order], other_size[order]
    begin = np.searchsorted(other, name)
    n = np.searchsorted(other, name, side="right") - begin
    j, i = _ranges(begin, n), np.repeat(np.arange(len(name)), n)
    long, wide = size[i], other_size[j]
    k, of = _ranges(np.zeros(len(i), np.int64), long), np.repeat(np.arange(len(i)), long)
    x = p[i][of] + k
    y0 = q[j][of] + np.minimum(k, wide[of] - 1)
    y1 = q[j][of] + wide[of] - 1 - np.minimum(long[of] - 1 - k, wide[of] - 1)
    x, y = np.r_[x, x[y1 != y0]], np.r_[y0, y1[y1 != y0]]
    if not len(x):
        return
    order = np.argsort(x - y, kind="stable")
    x, y = x[order], y[order]
    d = x - y
    line = np.cumsum(np.r_[False, np.diff(d) > DRIFT])
    cut = _cuts(line)
    least, most = d[cut[:-1]], d[cut[1:] - 1]
    cell = np.where((most - least > 2 * WIDTH)[line], (d - least[line]) // WIDTH, 0)
    line = np.cumsum(np.r_[False, (np.diff(line) != 0) | (np.diff(cell) != 0)])
    order = np.lexsort((x, line))
    x, y, d, line = x[order], y[order], d[order], line[order]
    begin = np.flatnonzero(np.r_[True, (np.diff(line) != 0) | (np.diff(x) > REACH)])
    end = np.r_[begin[1:], len(x)] - 1
    seeds = np.add.reduceat(np.r_[True, (np.diff(x) != 0) | (np.diff(line) != 0)].astype(np.int64), begin)
    good = np.flatnonzero((seeds >= LEAST_SEEDS) & (x[end] + K - x[begin] >= least_words - 2 * EDGE))
    good = good[np.argsort(-seeds[good], kind="stable")]
    cols = [x[begin], x[end], np.minimum.reduceat(d, begin), np.maximum.reduceat(d, begin), np.minimum.reduceat(y, begin), np.maximum.reduceat(y, begin)]
    yield from zip(*(c[good].tolist() for c in cols), strict=True)


def _met(least_words: int, share: float):
    """Passages of open stretches (kind 1) with the clusters (kind 0) of earlier documents in their block.

    A stretch meets all clusters that may hold a passage of it, those with most words in common first; groups of
    links of which the passages found so far cover all but EDGE words are not aligned.
    """

    def passages(block: _Block, doc: int, left: int, a: np.ndarray, covered: np.ndarray, names: np.ndarray, sharing: np.ndarray) -> Iterator[tuple]:
        is_open = np.ones(len(a), np.int64)
        for f, e in zip(covered[::2] - left, covered[1::2] - left, strict=True):
            is_open[max(0, f) : max(0, e)] = 0
        before = np.r_[0, np.cumsum(is_open)]
        sharing = sharing[before[sharing[:, 2] + K - EDGE] > before[sharing[:, 1] + EDGE]]
        for c, low, high in block.partners(a, sharing, least_words, share).tolist() if len(sharing) else ():
            if before[high + K - EDGE] == before[low + EDGE]:
                continue
            b = block.words[c]
            for p0, p1, least, most, y0, y1 in _bands(names, _seed_names(b), least_words):
                if before[p1 + K - EDGE] == before[p0 + EDGE]:
                    continue
                f, e = max(0, p0 - REACH), p1 + K + REACH
                g, h = max(0, y0 - (p0 - f) - DRIFT), y1 + e - p1 + DRIFT
                shift = f - g
                found = align(a[f:e], b[g:h], least - shift, most - shift, p0 - f, p1 + K - f, least_words, share)
                for i, j, k, m, same in found:
                    is_open[f + i : f + j] = 0
                    yield doc, int(block.doc[c]), left + f + i, left + f + j, block.first[c] + g + k, block.first[c] + g + m, same
                if found:
                    before = np.r_[0, np.cumsum(is_open)]

    def met(block: _Block, visits: list[tuple]) -> Iterator[tuple]:
        all_names = _seed_names(np.concatenate([a for _, _, a, _ in visits]))
        begin = np.cumsum([0, *(len(a) for _, _, a, _ in visits)])
        names = [all_names[f : max(f, e - K + 1)] for f, e in zip(begin[:-1], begin[1:], strict=True)]
        for visit, own, sharing in zip(visits, names, block.sharing([v[0] for v in visits], names, least_words), strict=True):
            if len(sharing):
                yield from passages(block, *visit, own, sharing)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block, now = [], None, None
        for batch in batches:
            out: set[tuple] = set()
            visits: list[tuple] = []
            for of, kind, doc, first, words, covered in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != now:
                    out.update(met(block, visits) if visits else ())
                    held, block, now, visits = [], None, of, []
                words = np.frombuffer(words, np.uint32)
                if kind == 0:
                    held.append((doc, first, words))
                elif held or block:
                    if block is None:
                        block, held = _Block(held), []
                    visits.append((doc, first, words, np.array(covered or [], np.int64)))
            out.update(met(block, visits) if visits else ())
            cols = list(zip(*sorted(out), strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=_names(_SPAN))

    return run


def _one_text(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) with one row for each doc_id, and, if any repeats, those ids with the text taken."""
    again = materialise(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if again.isEmpty():
        return docs, None
    taken = materialise(docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")), "taken")
    return docs.join(again, "doc_id", "left_anti").unionByName(taken), taken


def _usable(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.where("doc_id is not null and text is not null")


def repeated_passages(docs: DataFrame, least_words: int = 50, share: float = 0.8) -> DataFrame:
    """Passages of at least ``least_words`` words that a document shares with an earlier one.

    Returns (doc_id, other_id, first_word, end_word, other_first, other_end, n_same), spans in words, end
    excluded, other_id < doc_id; n_same words, at least ``share`` of the longer span, are known to match in order.  A
    passage starts and ends with words that match; its partner shares a seed within EDGE words of either end.

    A document meets every earlier holder of its seeds that up to HOLDERS documents hold, and the first
    holder and the one before of others.  Runs of LEAST_SEEDS and more of such hot seeds that no passages cover
    meet every earlier place of their seeds, and so does a partner with fewer other seeds next to hot ones.

    Every repeated word is covered, but a partner whose passage lies within another one's may go unlisted.
    Null texts or ids have no passages; of rows that repeat a doc_id the least text counts; repetition
    within one document is not looked for; an empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    return _passages(_one_text(_usable(docs))[0], least_words, share)


def _islands(spans: DataFrame) -> DataFrame:
    """The words that passages cover: spans no more than EDGE words apart become one."""
    order = Window.partitionBy("doc_id").orderBy("first_word", "end_word")
    before = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.select("doc_id", "first_word", "end_word").distinct().withColumn("before", before)
    fresh = F.when(F.col("before").isNull() | (F.col("first_word") > F.col("before") + EDGE), 1).otherwise(0)
    islands = rows.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order)).groupBy("doc_id", "island")
    return islands.agg(F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"))


def _still_open(runs: DataFrame, covered: DataFrame, first: str = "left_word", end: str = "right_word") -> DataFrame:
    """The runs that no island of passages covers but for EDGE words."""
    within = F.expr(f"r.doc_id = s.doc_id and s.first_word <= r.{first} + {EDGE} and r.{end} <= s.end_word + {EDGE}")
    return runs.alias("r").join(covered.alias("s"), within, "left_anti")


def _meet(runs: DataFrame, clusters: DataFrame, spans: DataFrame, docs: DataFrame, least_words: int, share: float, tasks: int) -> DataFrame:
    """Passages of open runs with clusters of earlier documents, which are dealt into blocks.

    A run visits one block first; one that stays open visits all.  Visits of all blocks at once would take disk by
    the square of the input, so they go round by round: as many blocks at a time as keep the words of the visits within
    VISITS times those of the clusters.  Blocks of a round are dealt with parts of the runs to enough tasks.
    """
    ids = runs.select("doc_id").unionByName(clusters.select("doc_id")).distinct()
    words = materialise(map_only_ids(docs, ids, "doc_id", _hash_arrays, "doc_id long, words binary"), "words")
    size = clusters.agg(F.sum(F.col("end") - F.col("first"))).first()[0] or 0
    at_once = 2 * docs.sparkSession.sparkContext.defaultParallelism
    blocks = max(at_once, size // BLOCK + 1)
    cut = F.expr("substring(words, int(4 * first + 1), int(4 * (end - first)))")
    held = clusters.join(words, "doc_id").withColumn("words", cut).select(
        F.expr(f"int(pmod(xxhash64(doc_id, first), {blocks}))").alias("block"), F.lit(0).alias("kind"), "doc_id", "first", "words", F.lit(None).cast("array<bigint>").alias("covered")
    )
    asked = runs.withColumns({"first": F.greatest(F.lit(0).cast("long"), F.col("left_word") - REACH), "end": F.col("right_word") + REACH})
    asked = asked.join(words, "doc_id").withColumn("words", cut)
    # By blocks, so that a round reads few files of other blocks.
    held, asked, found = materialise(held.repartition(tasks, "block").sortWithinPartitions("block"), "held"), materialise(asked, "asked"), []
    discard(words)

    span = "doc_id", "first_word", "end_word"

    def visit(held: DataFrame, covered: DataFrame, part: Column, tasks: int) -> DataFrame:
        known = covered.groupBy("doc_id").agg(F.flatten(F.collect_list(F.array("first_word", "end_word"))).alias("covered"))
        visits = _still_open(asked, covered).join(known, "doc_id", "left").select(part.alias("part"), F.lit(1).alias("kind"), "doc_id", "first", "words", "covered")
        rows = held.unionByName(visits).repartition(tasks, "part").sortWithinPartitions("part", "kind", "doc_id", "first")
        found.append(materialise(rows.mapInArrow(_met(least_words, share), _SPAN), "passages"))
        return materialise(_islands(covered.select(*span).unionByName(found[-1].select(*span))), "covered")

    first = materialise(_islands(spans), "covered")
    covered = visit(held.withColumnRenamed("block", "part"), first, F.expr(f"int(pmod(xxhash64(doc_id), {blocks}))"), tasks)
    discard(first)
    still = _still_open(asked, covered).agg(F.sum(F.length("words") / 4)).first()[0] or 0
    each = int(min(blocks, max(1, VISITS * size // still))) if still else blocks
    for begin in range(0, blocks if still else 0, each):
        n = min(each, blocks - begin)
        slices = -(-at_once // n)
        parts = F.explode(F.expr(f"transform(sequence(0, {slices - 1}), i -> (block - {begin}) * {slices} + i)"))
        some = held.where(F.col("block").between(begin, begin + n - 1)).select(parts.alias("part"), *held.columns[1:])
        own = F.explode(F.expr(f"transform(sequence(0, {n - 1}), b -> b * {slices} + int(pmod(xxhash64(doc_id, first), {slices})))"))
        before, covered = covered, visit(some, covered, own, min(tasks, 4 * n * slices))
        discard(before)
    out = materialise(functools.reduce(DataFrame.unionByName, found), "met")
    for table in (held, asked, covered, *found):
        discard(table)
    return out


def _passages(docs: DataFrame, least_words: int, share: float) -> DataFrame:
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    buckets = 4 * tasks

    def dealt(rows: DataFrame, by: str) -> DataFrame:
        return rows.repartition(tasks, by).sortWithinPartitions(by)

    def found(links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(passages, groups, those of the passages that were aligned)"""
        groups = materialise(dealt(links, "part").mapInArrow(_groups(least_words, share), _GROUP), "groups")
        aligned = _align_groups(groups.where("kind = 0").drop("kind"), docs, least_words, share, tasks)
        sure = "doc_id", "other as other_id", "first as first_word", "end as end_word", "first - low as other_first", "end - low as other_end", "kind as n_same"
        return aligned.unionByName(groups.where("kind > 1").selectExpr(*sure)), groups, aligned

    shared = materialise(dealt(docs.mapInArrow(_seeds(buckets), _SEEDS), "bucket").mapInArrow(_shared, _SHARED), "shared")
    spans, *tables = found(shared.mapInArrow(_links(buckets), _LINKS))
    runs = tables[0].where("kind = 1").select("doc_id", "left_word", "right_word").distinct()
    stretch = F.explode(F.expr(f"sequence(greatest(left_word - {REACH}, 0L) div {STRETCH}, (right_word + {REACH}) div {STRETCH})"))

    covered = materialise(_islands(spans), "covered")
    mixed = materialise(_still_open(tables[0].where("kind = -1").drop("kind"), covered, "first", "end"), "mixed")
    tables += [covered, mixed]
    if not mixed.isEmpty():
        beside = _align_groups(mixed, docs, least_words, share, tasks)
        spans = spans.unionByName(beside)
        covered = materialise(_islands(spans), "covered")
        tables += [beside, covered]
    open_runs = materialise(_still_open(runs, covered), "open")
    needy = materialise(open_runs.select("doc_id", stretch.alias("stretch")).selectExpr("doc_id ^ shiftleft(stretch, 40) as id").distinct(), "needy")
    tables += [open_runs, needy]
    if not needy.isEmpty():
        hot = dealt(shared.mapInArrow(_hot(buckets, id_filter(needy, always=True)), _HOT), "part")
        clusters = materialise(hot.mapInArrow(_clusters(least_words, share), _CLUSTER), "clusters")
        more = _meet(open_runs, clusters, spans, docs, least_words, share, tasks)
        spans, tables = spans.unionByName(more), [*tables, clusters, more]
    out = materialise(spans.distinct(), "spans")
    for table in (shared, *tables):
        discard(table)
    return out


def without_repeated_passages(docs: DataFrame, least_words: int = 50, share: float = 0.8) -> DataFrame:
    """``docs`` with each repeated passage cut from all documents but an earlier one that holds it.

    Rows of which no word is left go, unless their text had none.  Columns and other rows are unchanged;
    a column ``n_chars`` is set to the new length.  Rows with a null doc_id or text stay as they are, and
    so do those of a repeated doc_id whose text is not the least; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    one, taken = _one_text(_usable(docs))
    spans = _passages(one, least_words, share)
    found = spans.groupBy("doc_id").agg(F.collect_set(F.struct("first_word", "end_word")).alias("found")).withColumnRenamed("doc_id", "id")
    found = materialise(found, "cuts")
    discard(spans)
    columns, schema = list(docs.columns), docs.schema
    text_at, extra = columns.index("text"), unused_name("found", columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for i, found in enumerate(batch.column(len(columns)).to_pylist()):
                data = np.frombuffer(batch.column(text_at)[i].as_py().encode(), dtype=np.uint8)
                start, end, _ = tk.words(data, np.array([0, len(data)]))
                keep = np.ones(len(data), dtype=bool)
                left = np.ones(len(start), dtype=bool)
                for s in found:
                    keep[start[s["first_word"]] : end[s["end_word"] - 1]] = False
                    left[s["first_word"] : s["end_word"]] = False
                texts.append(data[keep].tobytes().decode() if left.any() else None)
            arrays = list(batch.columns[: len(columns)])
            arrays[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"))
    # Only documents that may have passages are shuffled.
    maybe = may_hold(id_filter(found.select("id"), always=True), F.col("row.doc_id").cast("long"))
    joined = rows.where(maybe).join(found, F.col("row.doc_id").cast("long") == F.col("id"), "left")
    cuts = F.col("id").isNotNull() & F.col("row.text").isNotNull()
    if taken is not None:
        joined = joined.join(taken.select(F.col("doc_id").alias("taken_id"), F.col("text").alias("taken")), F.col("id") == F.col("taken_id"), "left")
        cuts = cuts & (F.col("taken").isNull() | (F.col("taken") == F.col("row.text")))
    same = rows.where(~maybe).select("row.*").unionByName(joined.where(~cuts).select("row.*"))
    cut = joined.where(cuts).select("row.*", F.col("found").alias(extra))
    cut = cut.mapInArrow(run, schema).where("text is not null")
    if "n_chars" in columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast(schema["n_chars"].dataType)).select(*(f"`{c}`" for c in columns))
    return same.unionByName(cut)
