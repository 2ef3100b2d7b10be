"""Speaker identity inside a session: an ordered fold over the session's utterances.

Every decision depends on the centroids that earlier ones left, so a session is one sequence; sessions are
spread over the cluster.  State is a sum vector and the newest segments of at most ``cap`` speakers.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.operators import regroup
from parley.operators.folds import Machine, fold


@dataclass
class Limits:
    """Fixed values of the rules; ``held`` is the number of newest segments of a speaker that upkeep looks at."""

    match: float = 0.35
    new: float = 0.30
    margin: float = 0.05
    quality_rms: float = 0.003
    min_seconds: float = 1.5
    cap: int = 8
    merge: float = 0.50
    regroup_every: int = 8
    merge_every: int = 3
    held: int = 60


@dataclass
class Speaker:
    total: np.ndarray
    n: int = 0
    held: list[tuple[int, np.ndarray]] = field(default_factory=list)


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-10))


class Session(Machine):
    """Speakers of a session by id, in the order they came."""

    def __init__(self, limits: Limits):
        self.lim, self.who, self.next_id, self.last, self.calls, self.serial = limits, {}, 1, 1, 0, 0

    def open(self, x: np.ndarray) -> int:
        self.who[self.next_id] = Speaker(x.copy())
        self.next_id += 1
        return self.next_id - 1

    def record(self, who: int, x: np.ndarray) -> None:
        s = self.who[who]
        s.n, s.held, self.serial = s.n + 1, [*s.held[1 - self.lim.held :], (self.serial, x)], self.serial + 1

    def absorb(self, source: int, target: int) -> None:
        """Segments and sums of the source go to the target."""
        gone, stays = self.who.pop(source), self.who[target]
        stays.total, stays.n = stays.total + gone.total, stays.n + gone.n
        stays.held = sorted(stays.held + gone.held, key=lambda h: h[0])[-self.lim.held :]

    def upkeep(self, several: bool = False) -> None:
        """What is due after this call; calls with several speakers have a cadence of their own."""
        regroup_due, merge_due = self.calls % self.lim.regroup_every == 0, self.calls % self.lim.merge_every == 0
        if regroup_due:
            self.regroup()
        if regroup_due if several else merge_due:
            self.refresh()
        if merge_due and not (several and regroup_due):
            self.merge_closest()

    def refresh(self) -> None:
        """Sums of the newest 30 segments that lie near their mean, for speakers with three and more."""
        for s in self.who.values():
            rows = np.array([x for _, x in s.held[-30:]])
            if len(rows) >= 3:
                near = rows[[cosine(x, rows.mean(axis=0)) > 0.3 for x in rows]]
                if len(near) >= 2:
                    s.total = near.sum(axis=0)

    def merge_closest(self) -> None:
        """The most similar pair becomes one if it is similar enough; of equal sizes the older stays."""
        ids = list(self.who)
        if len(ids) < 2:
            return
        m = np.stack([self.who[i].total for i in ids])
        size = np.linalg.norm(m, axis=1)
        sim = np.triu(m @ m.T / (np.outer(size, size) + 1e-10), 1) + np.tril(np.full((len(ids), len(ids)), -2.0))
        a, b = np.unravel_index(sim.argmax(), sim.shape)
        if sim[a, b] >= self.lim.merge:
            a, b = ids[a], ids[b]
            source, target = (b, a) if self.who[a].n >= self.who[b].n else (a, b)
            self.absorb(source, target)

    def regroup(self) -> None:
        """Speakers whose segments fall into one cluster become one, the one with the most segments."""
        ids = list(self.who)
        # In the order of time, whoever spoke: the smoothing of the labels is over neighbours.
        held = sorted(((i, serial, x) for i in ids for serial, x in self.who[i].held), key=lambda h: h[1])
        if len(held) < 4 or len(ids) < 2:
            return
        labels = regroup.spectral_labels(np.stack([x for *_, x in held]), len(ids), self.lim.cap)
        for label in () if labels is None else dict.fromkeys(labels.tolist()):
            own = dict.fromkeys(i for (i, *_), at in zip(held, labels) if at == label)
            target, *rest = sorted(own, key=lambda i: -self.who[i].n if i in self.who else 0)
            for source in rest:
                if source in self.who and target in self.who:
                    self.absorb(source, target)

    def recent(self, who: int, x: np.ndarray, least: int) -> float | None:
        """Mean similarity to the three newest segments, if there are ``least`` of them."""
        own = self.who[who].held[-3:]
        return float(np.mean([cosine(x, y) for _, y in own])) if len(own) >= least else None

    def decide(self, x: np.ndarray, good: bool) -> tuple[int | None, str]:
        """(speaker or None, what was done); centroids change here, segments do not."""
        lim, ids = self.lim, list(self.who)
        score = {i: cosine(x, self.who[i].total) for i in ids}
        order = sorted(ids, key=lambda i: (-score[i], -i))
        pick, best = (order[0], score[order[0]]) if order else (None, -1.0)
        second = score[order[1]] if len(order) > 1 else None
        close = second is not None and best - second < lim.margin
        ambiguous = close or (second is not None and best > 0.30 and second > 0.25)
        if close and self.who[order[1]].n > self.who[order[0]].n:
            pick, best = order[1], second
        n = len(ids)
        low = max(0.10, lim.new - 0.05 * (n - 2)) if n >= 2 else lim.new
        if best >= lim.match:
            update, seen = good and not ambiguous, self.recent(pick, x, 2)
            if seen is not None and seen < lim.match * 0.6:
                update = False
                near = ((i, self.recent(i, x, 1)) for i in ids if i != pick and score[i] > 0.9 * best)
                pick = next((i for i, own in near if own is not None and own > seen), pick)
            if update:
                self.who[pick].total = self.who[pick].total + x
            return pick, "match"
        if n and best >= low:
            return pick, "uncertain"
        if n >= lim.cap:
            return pick, "full"
        frozen = self.calls > 20 and self.next_id > 4 and best > max(0.05, 0.20 - 0.03 * (self.next_id - 5))
        return (self.open(x), "new") if good and not frozen else (None, "kept")

    def one(self, x: np.ndarray | None, seconds: float, rms: float) -> str:
        """S3 for one utterance; ``last`` is its speaker."""
        if x is None or not seconds >= self.lim.min_seconds:
            return "short"
        x = np.asarray(x, dtype=float)
        who, what = self.decide(x, bool(rms >= self.lim.quality_rms))
        if who is not None:
            self.record(who, x)
            self.last, self.calls = who, self.calls + 1
            self.upkeep()
        return what

    def several(self, local: list[np.ndarray]) -> list[int | None]:
        """A different speaker for each local one: C14 best pairs first, then C15 for the rest."""
        known = list(self.who)
        pairs = sorted(((cosine(x, self.who[i].total), at, i) for at, x in enumerate(local) for i in known), key=lambda p: -p[0])
        found: dict[int, int] = {}
        for score, at, i in pairs:
            if score >= self.lim.match and at not in found and i not in found.values():
                found[at] = i
        for at, x in enumerate(local):
            if at not in found and len(self.who) < self.lim.cap:
                found[at] = self.open(x)
            elif at not in found:
                free = [i for i in self.who if i not in found.values()]
                if free:
                    found[at] = max(free, key=lambda i: cosine(x, self.who[i].total))
        for at in sorted(found):
            self.record(found[at], local[at])
        self.calls += 1
        self.upkeep(several=True)
        return [found.get(at) for at in range(len(local))]


class _One(Session):
    def row(self, seg_ix, embedding, seconds, rms) -> Iterable[tuple]:
        what = self.one(embedding, seconds, rms)
        yield seg_ix, self.last, what


class Live(_One):
    """Rows as they are decided, and at the end the number of segments of each speaker."""

    def row(self, seg_ix, embedding, seconds, rms) -> Iterable[tuple]:
        for seg_ix, who, what in super().row(seg_ix, embedding, seconds, rms):
            yield seg_ix, who, what, None

    def end(self) -> Iterable[tuple]:
        return [(None, who, "closed", s.n) for who, s in self.who.items()]


def identify(segments: DataFrame, limits: Limits | None = None) -> DataFrame:
    """speaker_id (from 1) and outcome of each utterance.

    segments: session_id, seg_ix, embedding, duration_sec, rms.  Utterances that are too short or have no
    embedding take the speaker before and change nothing; so do poor ones that match nobody.  After every
    eighth recorded utterance speakers are regrouped, after every third centroids are made anew and the
    closest pair may become one; rows given out before keep their id.
    """
    lim = limits or Limits()
    rows = segments.select("session_id", "seg_ix", "embedding", "duration_sec", "rms")
    return fold(rows, "session_id", ["seg_ix"], lambda: _One(lim), f"seg_ix {dict(segments.dtypes)['seg_ix']}, speaker_id int, outcome string")


class _Several(Session):
    """Rows of an utterance come together; the utterance is decided when the next one begins."""

    def __init__(self, limits: Limits, frame: int, rate: int):
        super().__init__(limits)
        self.frame, self.rate, self.at, self.rows = frame, rate, None, []

    def row(self, seg_ix, local, embedding, first, last, seconds, rms) -> Iterable[tuple]:
        done = self.end() if seg_ix != self.at else ()
        self.at = seg_ix
        self.rows.append((local, embedding, first, last, seconds, rms))
        return done

    def end(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        if not rows:
            return []
        seconds = rows[0][4]
        samples = int(round(seconds * self.rate)) if seconds == seconds and seconds is not None else 0
        heard = [r for r in rows if r[1] is not None]
        if not heard or not seconds >= self.lim.min_seconds:
            local, x, *_, rms = (heard or rows)[0]
            what = self.one(x, seconds, rms)
            return [(self.at, local, self.last, 0, samples, what)]
        ids = self.several([np.asarray(r[1], dtype=float) for r in heard])
        cut = lambda f: min(f * self.frame, samples)
        return [(self.at, r[0], i, cut(int(r[2])), cut(int(r[3]) + 1), "several") for r, i in zip(heard, ids) if i is not None]


def identify_multi(turns: DataFrame, limits: Limits | None = None, frame: int = 270, rate: int = 16000) -> DataFrame:
    """The speakers of utterances in which several may speak, each with its own span of samples.

    turns: session_id, seg_ix, local_ix, embedding, first_frame, last_frame, duration_sec, rms, one row for each
    active local speaker.  Each, also a single one, takes the best free speaker of the session or opens one,
    and keeps its own embedding as segment; spans end with the audio.  An utterance of which nobody has an embedding,
    or that is too short, is one span of one speaker, as by ``identify``.
    Returns session_id, seg_ix, local_ix, speaker_id, start, stop, outcome.
    """
    lim, kind = limits or Limits(), dict(turns.dtypes)
    rows = turns.select("session_id", "seg_ix", "local_ix", "embedding", "first_frame", "last_frame", "duration_sec", "rms")
    schema = f"seg_ix {kind['seg_ix']}, local_ix {kind['local_ix']}, speaker_id int, start long, stop long, outcome string"
    return fold(rows, "session_id", ["seg_ix", "local_ix"], lambda: _Several(lim, frame, rate), schema)


class Stable(Machine):
    """E5: the sum of a speaker at each segment at which it has settled."""

    STATE = "total array<double>, n int"

    def __init__(self):
        self.total, self.n = None, 0

    def save(self) -> tuple:
        return None if self.total is None else self.total.tolist(), self.n

    def load(self, total, n) -> None:
        self.total, self.n = None if total is None else np.asarray(total, dtype=float), n

    def row(self, seg_ix, embedding) -> Iterable[tuple]:
        x = np.asarray(embedding, dtype=float)
        before, self.total, self.n = self.total, x if self.total is None else self.total + x, self.n + 1
        if self.n >= 3 and 1 - cosine(before, self.total) < 0.05:
            yield seg_ix, self.total.tolist()


class _Settled(Stable):
    """E5 as a mark of every segment."""

    def row(self, seg_ix, embedding) -> Iterable[tuple]:
        yield seg_ix, bool(list(super().row(seg_ix, embedding)))


def _by_speaker(segments: DataFrame, machine, schema: str) -> DataFrame:
    rows = segments.where("embedding is not null").select("session_id", "speaker", "seg_ix", "embedding")
    return fold(rows, ["session_id", "speaker"], ["seg_ix"], machine, f"seg_ix {dict(segments.dtypes)['seg_ix']}, {schema}")


def is_stable(segments: DataFrame) -> DataFrame:
    """E5: (session_id, speaker, seg_ix, stable): whether the speaker has settled at the segment, by its running sum.

    segments: session_id, speaker, seg_ix, embedding; rows without embedding are left out.
    """
    return _by_speaker(segments, _Settled, "stable boolean")


def stable_centroids(segments: DataFrame) -> DataFrame:
    """E5: the running sum of each speaker of a session at every segment at which it has settled.

    segments: session_id, speaker, seg_ix, embedding.  Returns who (struct of session_id, speaker), seg_ix, centroid.
    """
    found = _by_speaker(segments, Stable, "centroid array<double>")
    return found.select(F.struct("session_id", "speaker").alias("who"), "seg_ix", "centroid")


def segment_lists(segments: DataFrame, first: int = 3, last: int = 30, golden: int = 5) -> DataFrame:
    """(session_id, speaker, seg_ix, in_first, in_last, in_golden): whether a segment is among the ``first`` or the
    ``golden`` oldest or the ``last`` newest ones of its speaker."""
    w = Window.partitionBy("session_id", "speaker")
    up, down = F.row_number().over(w.orderBy("seg_ix")), F.row_number().over(w.orderBy(F.desc("seg_ix")))
    return segments.select("session_id", "speaker", "seg_ix", (up <= first).alias("in_first"), (down <= last).alias("in_last"), (up <= golden).alias("in_golden"))


class Viterbi(Machine):
    """E8 over a stream of labels: what all survivors agree on is given out, so only the open end is held."""

    def __init__(self, stay: float, hit: float, every: int = 64):
        self.stay, self.hit, self.every, self.names, self.open, self.check = stay, hit, every, [], [], every

    def row(self, part, at, label, names) -> Iterable[tuple]:
        if not part:  # the first row has the labels of the key
            self.names = sorted(names)
            k = len(self.names)
            self.place = {name: i for i, name in enumerate(self.names)}
            if k > 1:
                same = np.eye(k, dtype=bool)
                self.move, self.emit = np.log(np.where(same, self.stay, (1 - self.stay) / (k - 1))), np.log(np.where(same, self.hit, 1 - self.hit))
                self.score = None
            return ()
        if len(self.names) < 2:
            return ((at, label),)
        seen = self.place[label]
        if self.score is None:
            self.score, back = self.emit[seen] - np.log(len(self.names)), None
        else:
            ways = self.score[:, None] + self.move
            back = ways.argmax(axis=0)
            self.score = ways.max(axis=0) + self.emit[seen]
        self.open.append((at, back))
        return self.agreed() if len(self.open) >= self.check else ()

    def agreed(self) -> list[tuple]:
        """Walk the best paths to all labels back to where they are one; rows up to there are decided."""
        state, i = np.arange(len(self.names)), len(self.open) - 1
        while i > 0 and (state != state[0]).any():
            state, i = self.open[i][1][state], i - 1
        out = self.give(i, int(state[0])) if (state == state[0]).all() else []
        self.check = len(self.open) + self.every if out else 2 * len(self.open)
        return out

    def give(self, i: int, state: int) -> list[tuple]:
        """Rows up to the i-th, which is in ``state``; later rows stay open."""
        out = []
        for j in range(i, -1, -1):
            at, back = self.open[j]
            out.append((at, self.names[state]))
            state = int(back[state]) if back is not None else state
        self.open = self.open[i + 1 :]
        return out[::-1]

    def end(self) -> Iterable[tuple]:
        return self.give(len(self.open) - 1, int(self.score.argmax())) if self.open else ()


def viterbi_smooth(labels: DataFrame, key: str, order: str, label: str, stay: float = 0.99, hit: float = 0.9) -> DataFrame:
    """The likeliest sequence of labels of each session when speakers seldom change.

    Sequences of fewer than two rows or labels stay; of equally likely labels the first in order is taken.  A task
    holds the rows of one session of which the best labels still differ by how it goes on.  Rows without a label are
    left out.
    """
    kind = dict(labels.dtypes)
    rows = labels.where(F.col(label).isNotNull())
    heads = rows.groupBy(key).agg(F.collect_set(label).alias("names"), F.min(order).alias("at"), F.min(label).alias("label")).select(
        key, F.lit(0).alias("part"), "at", "label", "names"
    )
    each = rows.select(key, F.lit(1).alias("part"), F.col(order).alias("at"), F.col(label).alias("label"), F.lit(None).cast(f"array<{kind[label]}>").alias("names"))
    return fold(heads.unionByName(each), key, ["part", "at"], lambda: Viterbi(stay, hit), f"`{order}` {kind[order]}, `{label}` {kind[label]}")
