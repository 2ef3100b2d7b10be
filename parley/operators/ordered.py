"""Ordered folds over each key: endpointing, recent duplicates, speech regions, spacing and budgets.

Each is a small state machine that a key's sorted rows pass through (see ``folds``).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import normalize_text
from parley.operators.folds import Machine, fold


def _fold(rows: DataFrame, key: str, order: str, machine, schema: str) -> DataFrame:
    return fold(rows, key, [order, *[c for c in rows.columns if c not in (key, order)]], machine, schema)


class Recent(Machine):
    """Rows whose form is not among the last ``n`` accepted ones; columns after the form pass through."""

    STATE = "forms array<string>"

    def __init__(self, n: int):
        self.forms = deque(maxlen=n)

    def row(self, at, form, *others) -> Iterable[tuple]:
        if form not in self.forms:
            self.forms.append(form)
            yield at, *others

    def save(self) -> tuple:
        return (list(self.forms),)

    def load(self, forms) -> None:
        self.forms.extend(forms)


def dedupe_recent(lines: DataFrame, key: str, order: str, text: str, n: int = 5) -> DataFrame:
    """Rows whose normal form is not among the last ``n`` accepted ones; a repeat does not refresh its slot."""
    rows = lines.where(F.col(text).isNotNull() & (F.col(text) != "")).select(key, order, normalize_text(F.col(text)).alias("__form"))
    return _fold(rows, key, order, lambda: Recent(n), f"`{order}` {dict(lines.dtypes)[order]}")


class Endpoint(Machine):
    """See ``endpoint``."""

    STATE = "first long, n int, silent int"

    def __init__(self, chunk_sec: float = 0.064):
        self.chunk_sec, self.first, self.n, self.silent = chunk_sec, None, 0, 0

    def save(self) -> tuple:
        return self.first, self.n, self.silent

    def load(self, first, n, silent) -> None:
        self.first, self.n, self.silent = first, n, silent

    def row(self, at, speech) -> Iterable[tuple]:
        self.silent = 0 if speech else self.silent + 1
        if self.n == 0 and not speech:
            return
        self.first, self.n = at if self.n == 0 else self.first, self.n + 1
        long = self.n * self.chunk_sec
        if long >= 3.0 or (self.silent * self.chunk_sec > 0.3 and long > 1.0):
            yield self.first, at, self.n
            self.n, self.silent = 0, 0


def endpoint(chunks: DataFrame, key: str = "stream_id", order: str = "seq", chunk_sec: float = 0.064) -> DataFrame:
    """Utterances (first, last, n_chunks) of a stream of speech and silence chunks.

    An utterance ends after over .3 s of silence once it is over 1 s long, or at 3 s.
    """
    rows = chunks.select(key, order, F.coalesce("is_speech", F.lit(False)).alias("is_speech"))
    return _fold(rows, key, order, lambda: Endpoint(chunk_sec), "first long, last long, n_chunks int")


class _Spaced(Machine):
    def __init__(self, gap: float):
        self.gap, self.last = gap, 0.0

    def row(self, at) -> Iterable[tuple]:
        if at - self.last >= self.gap:
            self.last = at
            yield (at,)


def min_gap_points(points: DataFrame, key: str, at: str, gap: float) -> DataFrame:
    """Points at least ``gap`` after the last accepted one (0 is accepted)."""
    return _fold(points.select(key, F.col(at).cast("double").alias(at)).where(F.col(at).isNotNull()), key, at, lambda: _Spaced(gap), f"`{at}` double")


class Segments(Machine):
    def __init__(self, least: int):
        self.least, self.last, self.given, self.total, self.windows = least, 0, False, 0, 0

    def row(self, at, far, total) -> Iterable[tuple]:
        self.total, self.windows = total, self.windows + 1
        if far and total >= 2 * self.least and at - self.last >= self.least:
            yield self.last, at
            self.last, self.given = at, True

    def end(self) -> Iterable[tuple]:
        if not self.given or self.total - self.last >= self.least:
            yield self.last if self.given else 0, self.total


def scd_segments(windows: DataFrame, key: str, at: str, far: str, total: str, least: int = 24000) -> DataFrame:
    """(start, stop) of the parts of a buffer between speaker changes.

    windows: the start sample of each window of a buffer, whether it is far from the window before (E1), and the
    samples of the buffer.  Changes closer than ``least`` samples to the last accepted one are passed over, a
    shorter tail is dropped, and a buffer below twice ``least`` or without changes is one part.
    """
    rows = windows.select(key, F.col(at).cast("long").alias("at"), F.coalesce(far, F.lit(False)).alias("far"), F.col(total).cast("long").alias("total"))
    return _fold(rows, key, "at", lambda: Segments(least), "start long, stop long")


class Speech(Machine):
    def __init__(self, speech: int, silence: int, most: int):
        self.speech, self.silence, self.most = speech, silence, most
        self.i, self.first, self.quiet, self.given = 0, None, 0, False

    def row(self, at, loud) -> Iterable[tuple]:
        i, self.i = self.i, self.i + 1
        if self.first is None and not loud:
            return
        self.first = i if self.first is None else self.first
        self.quiet = 0 if loud else self.quiet + 1
        first, stop = self.first, None
        if self.quiet >= self.silence:
            stop, self.first = i - self.quiet + 1, None
            self.quiet = 0
            if stop - first < self.speech:
                return
        elif i - first >= self.most:
            stop, self.first, self.quiet = i + 1, None, 0
        if stop is not None:
            self.given = True
            yield first, stop

    def end(self) -> Iterable[tuple]:
        if self.first is not None and self.i - self.first >= self.speech:
            yield self.first, self.i
        elif not self.given:
            yield 0, self.i


def speech_segments(frames: DataFrame, key: str, order: str, prob: str, limit: float = 0.5, speech: int = 15, silence: int = 9, most: int = 187) -> DataFrame:
    """(first, stop) frame numbers, counted from 0, of the speech of each key; ``stop`` is exclusive.

    A segment ends after ``silence`` quiet frames, where the first of them stands, and counts if it has
    ``speech`` frames; at ``most`` frames it is cut whatever its length.  A key without one is a segment as a whole.
    """
    rows = frames.select(key, order, F.coalesce(F.col(prob) >= limit, F.lit(False)).alias("__loud"))
    return _fold(rows, key, order, lambda: Speech(speech, silence, most), "first int, stop int")


class Prompts(Machine):
    """See ``prompt_budget``."""

    STATE = "began long, shown array<long>"

    def __init__(self):
        self.began, self.shown = None, deque()

    def save(self) -> tuple:
        return self.began, list(self.shown)

    def load(self, began, shown) -> None:
        self.began, self.shown = began, deque(shown)

    def row(self, t) -> Iterable[tuple]:
        self.began = t if self.began is None else self.began
        while self.shown and self.shown[0] <= t - 600:
            self.shown.popleft()
        last = self.shown[-1] if self.shown else None
        if len(self.shown) < 5 and not (t - self.began > 300 and last is not None and t - last < 120):
            self.shown.append(t)
            yield (t,)


def prompt_budget(offers: DataFrame, key: str, at: str) -> DataFrame:
    """The offers (whole seconds) that are shown: at most five in 600 seconds, and 120 seconds apart
    when more than 300 seconds have passed since the first offer."""
    return _fold(offers.select(key, F.col(at).cast("long").alias(at)).where(F.col(at).isNotNull()), key, at, Prompts, f"`{at}` long")


class Failures(Machine):
    """Whether the failures of the last ``seconds``, this one included, are ``least`` or more."""

    STATE = "recent array<long>"

    def __init__(self, seconds: int = 60, least: int = 3):
        self.seconds, self.least, self.recent = seconds, least, deque()

    def row(self, t) -> Iterable[tuple]:
        self.recent.append(t)
        while self.recent[0] <= t - self.seconds:
            self.recent.popleft()
        if len(self.recent) >= self.least:
            yield t, len(self.recent)

    def save(self) -> tuple:
        return (list(self.recent),)

    def load(self, recent) -> None:
        self.recent = deque(recent)


def smooth(rows: DataFrame, key: str, order: str, value: str, passes: int = 3) -> DataFrame:
    """(before + 2 x itself + after) / 4 in each of ``passes``; the ends of a key's rows stay. One shuffle for all passes."""
    w = Window.partitionBy(key).orderBy(order)
    for _ in range(passes):
        before, after, own = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
        rows = rows.withColumn(value, F.when(before.isNull() | after.isNull(), own).otherwise((before + 2 * own + after) / 4))
    return rows
