"""Intervals: bucketed range joins, and sweeps that count frames by arithmetic.

A range join explodes each interval over buckets of a fixed width and joins on (file, bucket); the exact
predicate follows.  Counts of frames need no frames: intervals become ranges of frame numbers, these are cut at
the borders of slots, and a fold passes over the ends within a slot with what is open there.  Slots are as
wide as many mean intervals, so cuts add few rows whatever the step, and a long file is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.folds import Machine, fold

#: Width of a slot in mean lengths of the intervals.
SLOT = 256


def frames(ref: DataFrame, step: float) -> DataFrame:
    """Frames i * step of each file up to its last reference end."""
    ends = ref.groupBy("file_id").agg(F.max("end").alias("last"))
    n = F.floor(F.col("last") / step).cast("long")
    return ends.select("file_id", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("frame")).withColumn("t", F.col("frame") * F.lit(float(step)))


def covering(segments: DataFrame, times: DataFrame, width: float = 60.0) -> DataFrame:
    """Segments that hold each time, start <= t < end."""
    b = lambda c: F.floor(F.col(c) / width).cast("long")
    wide = segments.where("end > start").withColumn("bucket", F.explode(F.sequence(b("start"), b("end"))))
    return times.withColumn("bucket", b("t")).join(wide, ["file_id", "bucket"]).where("start <= t and t < end").drop("bucket")


def near_boundary(times: DataFrame, segments: DataFrame, collar: float, width: float = 60.0) -> DataFrame:
    """Times within ``collar`` of a start or end of some segment."""
    edges = segments.select("file_id", F.explode(F.array("start", "end")).alias("edge")).distinct()
    b = lambda c: F.floor(c / width).cast("long")
    wide = edges.withColumn("bucket", F.explode(F.sequence(b(F.col("edge") - collar), b(F.col("edge") + collar))))
    near = times.withColumn("bucket", b(F.col("t"))).join(wide, ["file_id", "bucket"]).where(F.abs(F.col("t") - F.col("edge")) < collar)
    return near.select(*times.columns).distinct()


def first_frame(t: Column, step: float) -> Column:
    """The least frame number i with i * step >= t."""
    i, size = F.ceil(t / step).cast("long"), F.lit(float(step))
    return F.when((i - 1) * size >= t, i - 1).when(i * size < t, i + 1).otherwise(i)


def frame_ranges(segments: DataFrame, ends: DataFrame, step: float) -> DataFrame:
    """Segments with the frames [a, b) that they hold (start <= frame time < end), of those of ``last_frames``."""
    a = F.greatest(F.lit(0).cast("long"), first_frame(F.col("start"), step))
    rows = segments.where("end > start").withColumn("a", a).withColumn("b", first_frame(F.col("end"), step))
    return rows.join(ends, "file_id").withColumn("b", F.least("b", F.col("frames"))).drop("frames").where("b > a")


def last_frames(ref: DataFrame, step: float) -> DataFrame:
    """Number of frames of each file: those up to its last reference end."""
    return ref.groupBy("file_id").agg((F.floor(F.max("end") / step) + 1).cast("long").alias("frames"))


def speakers_at_frames(segments: DataFrame, ref: DataFrame, step: float) -> DataFrame:
    """C9 at the frames of each file: a row for each frame and segment that holds it."""
    rows = frame_ranges(segments, last_frames(ref, step), step)
    return rows.withColumn("frame", F.explode(F.sequence("a", F.col("b") - 1))).drop("a", "b")


def dominant_speaker(at: DataFrame) -> DataFrame:
    """The speaker with the most segments at each frame, ties by name."""
    n = at.groupBy("file_id", "frame", "speaker").agg(F.count("*").alias("n"))
    w = Window.partitionBy("file_id", "frame").orderBy(F.desc("n"), "speaker")
    return n.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("file_id", "frame", "speaker")


class _Sweep(Machine):
    """Ends of ranges in order; ``span`` is told what is open on each stretch between them."""

    def __init__(self):
        self.at, self.open = 0, {}

    def row(self, at, side, who, change) -> Iterable[tuple]:
        if at > self.at and self.open:
            self.span(self.at, at - self.at)
        self.at, own = at, self.open.setdefault(side, {})
        own[who] = own.get(who, 0) + change
        if not own[who]:
            del own[who]
            if not own:
                del self.open[side]
        return ()

    def span(self, first: int, n: int) -> None:
        pass


class _Together(_Sweep):
    """Frames that each hypothesis id shares with each reference speaker, and the first of them."""

    def __init__(self):
        super().__init__()
        self.sums: dict[tuple, list[int]] = {}

    def span(self, first: int, n: int) -> None:
        for h, m in self.open.get(1, {}).items():
            for r, k in self.open.get(0, {}).items():
                self.sums.setdefault((h, r), [0, first])[0] += n * m * k

    def end(self) -> Iterable[tuple]:
        return [(h, r, n, first) for (h, r), (n, first) in self.sums.items()]


class _Errors(_Sweep):
    """Frames of miss, false alarm, confusion and speech where no border is near."""

    def __init__(self):
        super().__init__()
        self.sums, self.seen = [0, 0, 0, 0], False

    def span(self, first: int, n: int) -> None:
        if 2 in self.open:
            return
        r, h = self.open.get(0, {}).keys(), self.open.get(1, {}).keys()
        self.seen = True
        miss, alarm = max(0, len(r) - len(h)), max(0, len(h) - len(r))
        confused = min(len(r), len(h)) - len(r & h)
        self.sums = [s + n * x for s, x in zip(self.sums, (miss, alarm, confused, len(r)))]

    def end(self) -> Iterable[tuple]:
        return [tuple(self.sums)] if self.seen else []


def _swept(ranges: DataFrame, machine, schema: str) -> DataFrame:
    """The machine over the ends of ``ranges`` (file_id, side, who, a, b), slot by slot."""
    size = ranges.agg(F.sum(F.col("b") - F.col("a")).alias("frames"), F.count("*").alias("n")).first()
    width = max(1, -(-SLOT * (size["frames"] or 0) // max(size["n"], 1)))
    slot = lambda c: F.floor(c / width).cast("long")
    cut = ranges.withColumn("slot", F.explode(F.sequence(slot(F.col("a")), slot(F.col("b") - 1))))
    a, b = F.greatest("a", F.col("slot") * width), F.least("b", (F.col("slot") + 1) * width)
    ends = F.explode(F.array(F.struct(a.alias("at"), F.lit(1).alias("change")), F.struct(b.alias("at"), F.lit(-1).alias("change"))))
    rows = cut.select("file_id", "slot", "side", "who", ends.alias("e")).select("file_id", "slot", "e.at", "side", "who", "e.change")
    return fold(rows, ["file_id", "slot"], ["at"], machine, schema)


def cooccurrence(hyp: DataFrame, ref: DataFrame, step: float) -> DataFrame:
    """Frames that a hypothesis id and a reference speaker share; overlapping segments of one count each."""
    frames_of = last_frames(ref, step)
    side = lambda df, n, who: frame_ranges(df, frames_of, step).select("file_id", F.lit(n).alias("side"), F.col(who).cast("string").alias("who"), "a", "b")
    both = side(ref, 0, "speaker").unionByName(side(hyp, 1, "speaker_id"))
    part = _swept(both, _Together, "speaker_id string, speaker string, n_frames long, first_frame long")
    sums = part.groupBy("file_id", "speaker_id", "speaker").agg(F.sum("n_frames").alias("n_frames"), F.min("first_frame").alias("first_frame"))
    return sums.withColumn("speaker_id", F.col("speaker_id").cast(dict(hyp.dtypes)["speaker_id"])).withColumn("speaker", F.col("speaker").cast(dict(ref.dtypes)["speaker"]))


def consistency(together: DataFrame) -> DataFrame:
    """The share of a speaker's frames that its most frequent id has, over ``cooccurrence``.

    Without speaker: over all speakers of a file; without either: over all files.
    """
    each = together.groupBy("file_id", "speaker").agg(F.max("n_frames").alias("most"), F.sum("n_frames").alias("n"))
    return each.rollup("file_id", "speaker").agg((F.sum("most") / F.sum("n")).alias("share"))


def primary_ids(together: DataFrame) -> DataFrame:
    """(file_id, speakers, ids): speakers with frames, and the different ids that are some speaker's most frequent one."""
    w = Window.partitionBy("file_id", "speaker").orderBy(F.desc("n_frames"), "speaker_id")
    best = together.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return best.groupBy("file_id").agg(F.count("*").alias("speakers"), F.countDistinct("speaker_id").alias("ids"))


def greedy_one_to_one(scores: DataFrame, key: str, left: str, right: str, order: list) -> DataFrame:
    """C14: pairs of each key in order, accepted while both sides are free (an ordered fold; a file's few speakers)."""
    item = F.struct(*order, F.col(left).alias("l"), F.col(right).alias("r"))
    lists = scores.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("items"))
    kind_l, kind_r = dict(scores.dtypes)[left], dict(scores.dtypes)[right]
    start = F.expr(f"named_struct('l', cast(array() as array<{kind_l}>), 'r', cast(array() as array<{kind_r}>))")

    def step(s, x):
        free = ~F.array_contains(s["l"], x["l"]) & ~F.array_contains(s["r"], x["r"])
        return F.when(free, F.struct(F.array_append(s["l"], x["l"]).alias("l"), F.array_append(s["r"], x["r"]).alias("r"))).otherwise(s)

    won = lists.select(key, F.aggregate("items", start, step).alias("s"))
    return won.select(key, F.explode(F.arrays_zip("s.l", "s.r")).alias("p")).select(key, F.col("p.l").alias(left), F.col("p.r").alias(right))


def _near_borders(ref: DataFrame, frames_of: DataFrame, step: float, collar: float) -> DataFrame:
    """Frames [a, b) whose time is less than ``collar`` from each start or end of a segment."""
    edges = ref.select("file_id", F.explode(F.array("start", "end")).alias("edge")).distinct()
    near = lambda i: F.abs(i * F.lit(float(step)) - F.col("edge")) < collar
    low = F.floor((F.col("edge") - collar) / step).cast("long")
    high = F.floor((F.col("edge") + collar) / step).cast("long")
    # The division may be off by one: the first and the last frame that pass the test itself.
    a = F.coalesce(*[F.when(near(low + i), low + i) for i in range(-1, 3)])
    b = F.coalesce(*[F.when(near(high + i), high + i) for i in range(1, -3, -1)]) + 1
    rows = edges.select("file_id", a.alias("a"), b.alias("b")).where("a is not null").withColumn("a", F.greatest(F.lit(0).cast("long"), "a"))
    return rows.join(frames_of, "file_id").withColumn("b", F.least("b", F.col("frames"))).where("b > a").drop("frames")


def der(ref: DataFrame, hyp: DataFrame, step: float = 0.1, collar: float = 0.25) -> DataFrame:
    """Per file frames of miss, false alarm, confusion and reference speech, and their rate."""
    order, frames_of = [(-F.col("n_frames")).alias("neg"), "first_frame"], last_frames(ref, step)
    mapping = greedy_one_to_one(cooccurrence(hyp, ref, step), "file_id", "speaker_id", "speaker", order)
    named = frame_ranges(hyp, frames_of, step).join(mapping, ["file_id", "speaker_id"], "left")
    who = F.coalesce(F.concat(F.lit("="), F.col("speaker").cast("string")), F.concat(F.lit("?"), F.col("speaker_id").cast("string")))
    said = frame_ranges(ref, frames_of, step).select("file_id", F.lit(0).alias("side"), F.concat(F.lit("="), F.col("speaker").cast("string")).alias("who"), "a", "b")
    heard = named.select("file_id", F.lit(1).alias("side"), who.alias("who"), "a", "b")
    border = _near_borders(ref, frames_of, step, collar).select("file_id", F.lit(2).alias("side"), F.lit("").alias("who"), "a", "b")
    part = _swept(said.unionByName(heard).unionByName(border), _Errors, "miss long, fa long, confusion long, speech long")
    sums = part.groupBy("file_id").agg(*[F.sum(c).alias(c) for c in ("miss", "fa", "confusion", "speech")])
    rate = (F.col("miss") + F.col("fa") + F.col("confusion")) / F.greatest(F.col("speech"), F.lit(1))
    return sums.withColumn("der", rate)


def intersections(hyp: DataFrame, speech: DataFrame, least: float, width: float = 60.0) -> DataFrame:
    """Overlaps of over ``least`` of two interval sets of a file, with the columns of both.

    Both sides are cut into time slots of ``width``; a pair counts in the slot where its overlap starts.
    """

    def slotted(df: DataFrame, tag: str) -> DataFrame:
        df = df.withColumnsRenamed({"start": f"s{tag}", "end": f"e{tag}"})
        return df.withColumn("slot", F.explode(F.sequence(F.floor(F.col(f"s{tag}") / width), F.floor(F.col(f"e{tag}") / width))))

    both = slotted(hyp, "1").join(slotted(speech, "2"), ["file_id", "slot"])
    start, end = F.greatest("s1", "s2"), F.least("e1", "e2")
    both = both.withColumn("start", start).withColumn("end", end).where((F.col("end") - F.col("start") > least) & (F.floor(F.col("start") / width) == F.col("slot")))
    return both.drop("s1", "s2", "e1", "e2", "slot")
