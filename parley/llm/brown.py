"""Scoring by Brown class-based bigrams: P(word | class) * P(class | class before), mixed with unigrams.

Every word of the training corpus has one of the learned classes, found by distributed exchange (Uszkoreit and
Brants, 2008).  Words with at least FREQUENT of all tokens (1 / FREQUENT at most) are the only per-word table sent
to all tasks.  The most frequent of them begin with a class each, the others join these, and in each round all are
evaluated in parallel against the class bigram counts of the round before, and half of them may move.  The other
words, down to those seen once, are then put by the same gains into the class that fits their neighbours best; their
classes and counts stay a table that meets the documents in an equi-join, which has no hot key because none of them
is frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import textkit as tk
from parley.llm.passages import _cuts, _packed, _unpacked
from parley.llm.store import discard, materialise, small_batches

FREQUENT = 1e-6
END = np.uint64(1)
_FLUSH = 1 << 19
#: Places of words outside the table of frequent ones, and of the end.
REST, END_PLACE = -2, -1
#: Contexts of which the gains are taken at a time.
_CONTEXTS = 1 << 14
_PACKED = "part int, words binary, sizes binary, codes binary, counts binary"
_PACKED_NAMES = [c.split()[0] for c in _PACKED.split(", ")]


def _documents(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, hashes with one END after each document, row of each token)."""
    for first, n, data, offsets in tk.text_chunks(column):
        start, end, row = tk.words(data, offsets)
        h = tk.word_hashes(data, start, end)
        at = np.searchsorted(row, np.arange(n), side="right")
        yield first, n, np.insert(h, at, END), np.insert(row, at, np.arange(n))


class _Counter:
    """Sums counts by key and hands them out when there are many."""

    def __init__(self):
        self._parts: list[tuple[np.ndarray, np.ndarray]] = []
        self._held = 0

    def add(self, keys: np.ndarray) -> None:
        self._parts.append(np.unique(keys, return_counts=True))
        self._held += len(self._parts[-1][0])

    def full(self) -> bool:
        return self._held > _FLUSH and self._sum() > _FLUSH // 2

    def _sum(self) -> int:
        keys = np.concatenate([p[0] for p in self._parts])
        counts = np.concatenate([p[1] for p in self._parts])
        own, at = np.unique(keys, return_inverse=True)
        self._parts = [(own, np.bincount(at, weights=counts).astype(np.int64))]
        self._held = len(own)
        return self._held

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self._parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._sum()
        out, self._parts, self._held = self._parts[0], [], 0
        return out


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = _Counter()

    def rows() -> pa.RecordBatch:
        keys, counts = counter.take()
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["word", "n"])

    for batch in batches:
        for _, _, h, _ in _documents(batch.column(0)):
            counter.add(h)
            if counter.full():
                yield rows()
    yield rows()


class _Words:
    """The frequent words: hash, count and class; the classes of the end, and of words that are none of them."""

    def __init__(self, word: np.ndarray, count: np.ndarray, n_classes: int):
        order = np.argsort(word)
        self.word, self.count = word[order], count[order]
        self.n_classes, self.end, self.rest, self.all_classes = n_classes, n_classes, n_classes + 1, n_classes + 2
        #: The most frequent words begin with a class each, all others without one.
        self.class_of = np.full(len(word), self.rest)
        self.class_of[np.argsort(-self.count, kind="stable")[:n_classes]] = np.arange(min(n_classes, len(word)))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each word in the table, or REST."""
        if not len(self.word):
            return np.full(len(h), REST)
        at = np.minimum(np.searchsorted(self.word, h), len(self.word) - 1)
        return np.where(self.word[at] == h, at, REST)

    def classes(self, place: np.ndarray) -> np.ndarray:
        """Class of each place; that of words outside the table for REST, that of the end for END_PLACE."""
        return np.r_[self.class_of, self.rest, self.end][place]


def _coded(words):
    """Documents as places of their words among the frequent ones, and hashes of the others with the places beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, key = words.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, n, data, offsets in tk.text_chunks(batch.column(2)):
                start, end, row = tk.words(data, offsets)
                h = tk.word_hashes(data, start, end)
                place = own.find(h)
                cut = np.searchsorted(row, np.arange(n + 1))
                rest = np.flatnonzero(place == REST)
                beside = []
                for other in (rest - 1, rest + 1):
                    inside = (other >= 0) & (other < len(row))
                    at = np.where(inside, other, 0)
                    beside.append(np.where(inside & (row[at] == row[rest]), place[at], END_PLACE).astype(np.int32))
                width = np.bincount(row[rest], minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key + np.arange(n)),
                        batch.column(0).slice(first, n),
                        batch.column(1).slice(first, n),
                        pa.array([_packed(place[a:b], np.int32) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                        tk.list_array(h[rest].view(np.int64), width, pa.int64()),
                        *(tk.list_array(x, width, pa.int32()) for x in beside),
                    ],
                    names=["key", "doc_id", "held_out", "places", "rest", "before", "after"],
                )
                key += n

    return run


def _sequences(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of all words of a batch with an end after each document, row of each)."""
    parts = []
    for x in batch.column(at).to_pylist():
        parts += [_unpacked(x, np.int32), np.array([END_PLACE], np.int32)]
    place = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return place, np.cumsum(np.r_[0, place[:-1] == END_PLACE]) if len(place) else place


def _class_pairs(words):
    """Class bigram counts of coded documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = words.value
        n = own.all_classes
        total = np.zeros(n * n, dtype=np.int64)
        for batch in batches:
            c = own.classes(_sequences(batch, 0)[0])
            if len(c):
                total += np.bincount(np.r_[own.end, c[:-1]] * n + c, minlength=n * n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at // n), pa.array(at % n), pa.array(total[at])], names=["a", "b", "n"])

    return run


def _matrix(pairs: DataFrame, n: int) -> np.ndarray:
    """Class bigram counts (n x n, of fixed size) from rows a, b, n."""
    sums = pairs.groupBy("a", "b").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((n, n), dtype=np.int64)
    counts[sums["a"].to_numpy(dtype=int), sums["b"].to_numpy(dtype=int)] = sums["n"].to_numpy(dtype=int)
    return counts


def _contexts(words, half: int | None, parts: int):
    """Classes beside each word, counted and packed by ranges of words: of the frequent words of one half (0, 1) or those without a class (2), or of all others.

    Frequent words go by their places, others by their hashes.  A context is a class after the word, or one before it (then more by the number of classes).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, size = words.value, [], 0
        active = own.class_of == own.rest if half == 2 else tk.mix(own.word) & np.uint64(1) == np.uint64(half or 0)

        def packed() -> pa.RecordBatch:
            word, code = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            if half is None:
                kinds, at = np.unique(word, return_inverse=True)
                key, n = np.unique(at * (2 * own.all_classes) + code, return_counts=True)
                at, code = np.divmod(key, 2 * own.all_classes)
                part = (tk.mix(kinds) % np.uint64(parts)).astype(np.int32)[at]
                order = np.argsort(part, kind="stable")
                part, word, code, n = part[order], kinds[at[order]], code[order], n[order]
            else:
                # Places are in the order of hashes, so ranges of them are as good as random.
                key, n = np.unique(word * (2 * own.all_classes) + code, return_counts=True)
                word, code = np.divmod(key, 2 * own.all_classes)
                part, word = word * parts // len(own.word), word.astype(np.uint64)
            cut, rows = _cuts(part), []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                each = _cuts(word[a:b])
                rows.append((int(part[a]), _packed(word[a:b][each[:-1]], np.uint64), _packed(np.diff(each), np.uint32), _packed(code[a:b], np.uint16), _packed(n[a:b], np.uint32)))
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*rows, strict=True))], names=_PACKED_NAMES
            )

        for batch in batches:
            place, _ = _sequences(batch, 0)
            if not len(place):
                continue
            cls = own.classes(place)
            if half is None:
                at = np.flatnonzero(place == REST)
                word = np.asarray(batch.column(1).flatten()).view(np.uint64)
            else:
                at = np.flatnonzero(np.r_[active, False, False][place])
                word = place[at].astype(np.int64)
            if len(at):
                held += [(word, cls[at + 1]), (word, own.all_classes + np.r_[own.end, cls][at])]
                size += 2 * len(at)
            if size > 4 * _FLUSH:
                yield packed()
                size = 0
        if held:
            yield packed()

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def _gains(counts: np.ndarray, n_classes: int, begin: np.ndarray, code: np.ndarray, n: np.ndarray, own: np.ndarray | None) -> np.ndarray:
    """Gain (words x classes) of putting each word into each class, out of its own class if it has one.

    ``counts``: class bigrams; the contexts of a word are those from its ``begin`` to the next one's.
    """
    cells = np.concatenate([counts[:n_classes].T, counts[:, :n_classes]]).astype(float)
    sides = np.stack([counts[:n_classes].sum(axis=1), counts[:, :n_classes].sum(axis=0)]).astype(float)
    after = code < len(counts)
    totals = [np.add.reduceat(np.where(side, n, 0), begin).astype(float) for side in (after, ~after)]
    gain = np.add.reduceat(_xlogx(cells[code] + n[:, None]) - _xlogx(cells)[code], begin, axis=0)
    for side, total in zip(sides, totals, strict=True):
        gain -= _xlogx(side + total[:, None]) - _xlogx(side)
    if own is not None:
        word = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(code)]))
        own = np.minimum(own, n_classes)
        cell = np.c_[cells, np.zeros(len(cells))][code, own[word]]
        sides = np.c_[sides, np.zeros(2)]
        stay = np.add.reduceat(_xlogx(cell) - _xlogx(np.maximum(cell - n, 0)), begin)
        for side, total in zip(sides, totals, strict=True):
            stay -= _xlogx(side[own]) - _xlogx(np.maximum(side[own] - total, 0))
        has = np.flatnonzero(own < n_classes)
        gain[has, own[has]] = stay[has]
    return gain


def _best_classes(counts: np.ndarray, words=None):
    """The class of each word by its contexts, and how often it occurs; frequent words (those of ``words``) leave their class for a better one only."""

    def best(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        word, code, n = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        # Each task's contexts are in order already, which the stable sort makes use of.
        order = np.lexsort((code, word)) if words is None else np.argsort(word.astype(np.int64) * (2 * len(counts)) + code, kind="stable")
        word, code, n = word[order], code[order], n[order]
        fresh = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (code[1:] != code[:-1])])
        word, code, n = word[fresh], code[fresh], np.add.reduceat(n, fresh)
        begin, n_classes = _cuts(word), len(counts) - 2
        kinds = word[begin[:-1]]
        own = None if words is None else words.value.class_of[kinds.astype(np.int64)]
        a = 0
        while a < len(kinds):
            b = max(a + 1, int(np.searchsorted(begin, begin[a] + _CONTEXTS, side="right")) - 1)
            some = slice(begin[a], begin[b])
            gain = _gains(counts, n_classes, begin[a:b] - begin[a], code[some], n[some], None if own is None else own[a:b])
            cls = gain.argmax(axis=1)
            if own is not None:
                now = own[a:b]
                stays = (now < n_classes) & (gain.max(axis=1) <= gain[np.arange(b - a), np.minimum(now, n_classes - 1)] + 1e-9)
                cls = np.where(stays, now, cls)
            times = np.add.reduceat(np.where(code[some] < len(counts), n[some], 0), begin[a:b] - begin[a])
            yield pa.RecordBatch.from_arrays([pa.array(kinds[a:b].view(np.int64)), pa.array(cls.astype(np.int32)), pa.array(times)], names=["word", "class", "c"])
            a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for part, kinds, sizes, codes, ns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now and held:
                    yield from best(held)
                now = part
                word = np.repeat(_unpacked(kinds, np.uint64), _unpacked(sizes, np.uint32))
                held.append((word, _unpacked(codes, np.uint16).astype(np.int64), _unpacked(ns, np.uint32).astype(np.int64)))
        if held:
            yield from best(held)

    return run


def _exchange(coded: DataFrame, words: _Words, rounds: int, tasks: int) -> DataFrame:
    """Rounds of exchange; sets the classes of ``words`` and returns those of all other words: word, class, c."""
    spark = coded.sparkSession
    train, parts = coded.where("not held_out"), 4 * tasks

    def fit(half: int | None) -> DataFrame:
        known = spark.sparkContext.broadcast(words)
        counts = _matrix(train.select("places").mapInArrow(_class_pairs(known), "a long, b long, n long"), words.all_classes)
        contexts = train.select("places", "rest").mapInArrow(_contexts(known, half, parts), _PACKED)
        dealt = contexts.repartition(tasks, "part").sortWithinPartitions("part")
        return dealt.mapInArrow(_best_classes(counts, None if half is None else known), "word long, class int, c long")

    for half in [2, *(i % 2 for i in range(rounds))] if len(words.word) else []:
        new = fit(half).select("word", "class").toPandas()
        words.class_of[new["word"].to_numpy(dtype=np.int64)] = new["class"].to_numpy(dtype=np.int64)
    return materialise(fit(None), "classes")


def _known_rest(coded: DataFrame, classes: DataFrame, words: _Words) -> DataFrame:
    """For each document the words that are not frequent, in order, with their neighbours' places, class and count (unseen: the last class, 0)."""
    each = coded.select("key", "held_out", F.posexplode(F.arrays_zip("rest", "before", "after")).alias("at", "r"))
    each = each.select("key", "held_out", "at", F.col("r.rest").alias("word"), "r.before", "r.after")
    each = each.join(classes.hint("shuffle_hash"), "word", "left")
    one = F.struct("at", "before", "after", F.coalesce("class", F.lit(words.rest)).cast("int").alias("class"), F.coalesce("c", F.lit(0)).cast("long").alias("c"))
    return materialise(each.groupBy("key", "held_out").agg(F.sort_array(F.collect_list(one)).alias("rest")), "known")


def _rest_columns(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, ...]:
    """(row, place before, place after, class, count) of the words of a batch of ``_known_rest``."""
    lists = batch.column(at)
    row = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
    flat = lists.flatten()
    return row, *(np.asarray(flat.field(c)) for c in ("before", "after", "class", "c"))


def _rest_pairs(words):
    """Class bigrams of which one word or both are not frequent, less those that ``_class_pairs`` counted for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = words.value
        n = own.all_classes
        total = np.zeros(n * n, dtype=np.int64)
        for batch in batches:
            _, before, after, cls, _ = _rest_columns(batch, 0)
            if not len(cls):
                continue
            left = np.where(before == REST, np.r_[own.rest, cls[:-1]], own.classes(before))
            total += np.bincount(left * n + cls, minlength=n * n)
            total -= np.bincount(own.classes(before) * n + own.rest, minlength=n * n)
            last = after != REST
            total += np.bincount(cls[last] * n + own.classes(after[last]), minlength=n * n)
            total -= np.bincount(own.rest * n + own.classes(after[last]), minlength=n * n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at // n), pa.array(at % n), pa.array(total[at])], names=["a", "b", "n"])

    return run


def _log_tables(words: _Words, counts: np.ndarray, sizes: np.ndarray, ends: int, total: int, kinds: int, weight: float) -> dict:
    """What scoring needs: class transitions, tokens and words of each class, terms of the frequent words and the end.

    A word that was not seen has the same probability after every class, that of the unigrams.
    """
    n_class, v_class = sizes
    unseen = 1 / (total + kinds + 1)
    seen = counts[: words.rest, : words.rest]
    into = seen.sum(axis=0) / max(seen.sum(), 1)
    move = np.zeros((words.all_classes, words.all_classes))
    move[: words.rest, : words.rest] = seen
    move[:, : words.rest] += into + 1e-9
    move[:, : words.rest] *= (1 - unseen) / move[:, : words.rest].sum(axis=1, keepdims=True)
    move[:, words.rest] = unseen
    cls = words.class_of
    size = np.r_[n_class + v_class, 0, 0]
    return {
        "move": move * weight, "size": np.maximum(size, 1), "emit": np.r_[(words.count + 1) / size[cls], 1.0, 1.0],
        "plain": np.r_[(words.count + 1) * unseen, unseen, (ends + 1) * unseen], "unseen": unseen, "rest": 1 - weight, "end_known": ends > 0,
    }


def _scored(words, tables):
    """Sums over the frequent words and the end; scores are those of words whose predecessor is frequent too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, t = words.value, tables.value
        for batch in batches:
            place, row = _sequences(batch, 3)
            cls, n = own.classes(place), batch.num_rows
            before = np.r_[own.end, cls[:-1]]
            score = np.log10(t["move"][before, cls] * t["emit"][place] + t["rest"] * t["plain"][place]) if len(cls) else np.zeros(0)
            frequent = place != REST
            score[~frequent | (before == own.rest)] = 0
            known = frequent & ((place != END_PLACE) | t["end_known"])
            base = np.where(frequent, np.log10(t["plain"][place]), 0)
            sums = [np.bincount(row, weights=x, minlength=n) for x in (known, base, score)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.bincount(row, minlength=n), pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])],
                names=["key", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"],
            )

    return run


def _rest_scored(words, tables):
    """The same sums over the words that are not frequent, and the scores of frequent ones after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, t = words.value, tables.value
        for batch in batches:
            row, before, after, cls, c = _rest_columns(batch, 1)
            left = np.where(before == REST, np.r_[own.rest, cls[:-1]], own.classes(before))
            plain = (c + 1) * t["unseen"]
            emit = np.where(cls == own.rest, 1.0, (c + 1) / t["size"][cls])
            score = np.log10(t["move"][left, cls] * emit + t["rest"] * plain)
            last = np.flatnonzero(after != REST)
            then = after[last]
            score[last] += np.log10(t["move"][cls[last], own.classes(then)] * t["emit"][then] + t["rest"] * t["plain"][then])
            sums = [np.bincount(row, weights=x, minlength=batch.num_rows) for x in (c > 0, np.log10(plain), score)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], names=["key", "known", "more", "rest_score"]
            )

    return run


def score_documents(docs: DataFrame, classes: int = 64, rounds: int = 6, weight: float = 0.9) -> DataFrame:
    """Scores of whole texts: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``docs`` needs doc_id, text and held_out (boolean; true rows are not learned from, null counts as
    false).  Tokens are the words of the text (A-Z lower-cased) and one end; a null text has the end alone.
    base_score sums log10 of add-one unigrams; score is log10 of the class model, of which
    ``weight`` is the share and add-one unigrams the rest.  Repeated rows are scored each.  With nothing to
    learn from, every token is unknown.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    train = docs.where("not held_out").select("text")
    vocabulary = train.mapInArrow(_unigrams, "word long, n long").groupBy("word").agg(F.sum("n").alias("c"))
    vocabulary = materialise(vocabulary, "vocabulary")
    is_end = F.col("word") == int(END)
    total, kinds, ends = vocabulary.agg(*(F.coalesce(x, F.lit(0)) for x in (F.sum("c"), F.count("*"), F.max(F.when(is_end, F.col("c")))))).first()
    frequent = vocabulary.where((F.col("c") >= max(1.0, FREQUENT * total)) & ~is_end).toPandas()
    discard(vocabulary)
    words = _Words(frequent["word"].to_numpy(dtype=np.int64).view(np.uint64), frequent["c"].to_numpy(dtype=np.int64), classes)
    schema = f"key long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, "
    coded = docs.mapInArrow(_coded(spark.sparkContext.broadcast(words)), schema + "places binary, rest array<long>, before array<int>, after array<int>")
    coded = materialise(coded, "coded")
    others = _exchange(coded, words, rounds, tasks)
    rest, known = _known_rest(coded, others, words), spark.sparkContext.broadcast(words)
    pairs = coded.where("not held_out").select("places").mapInArrow(_class_pairs(known), "a long, b long, n long")
    pairs = pairs.unionByName(rest.where("not held_out").select("rest").mapInArrow(_rest_pairs(known), "a long, b long, n long"))
    counts = _matrix(pairs, words.all_classes)
    sizes = np.stack([np.bincount(words.class_of, weights=w, minlength=classes) for w in (words.count, np.ones(len(words.count)))])
    for r in others.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        sizes[:, r["class"]] += r["c"], r["v"]
    tables = spark.sparkContext.broadcast(_log_tables(words, counts, sizes, ends, total, kinds, weight))
    sums = "n_tokens long, n_known long, base double, score double"
    parts = materialise(coded.select("key", "doc_id", "held_out", "places").mapInArrow(_scored(known, tables), schema + sums), "scored")
    more = materialise(rest.select("key", "rest").mapInArrow(_rest_scored(known, tables), "key long, known long, more double, rest_score double"), "rest_scored")
    for table in (coded, others, rest):
        discard(table)
    return parts.join(more, "key", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rest_score", F.lit(0.0))).alias("score"),
    )


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text, modulo 7, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))
