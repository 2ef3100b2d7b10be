"""Speaker identity as a stream: sessions that outlive micro-batches, their close, and matches with profiles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle, StreamingQuery

from parley.operators.identify import Limits, Live, Speaker, Stable
from parley.operators.matching import classify_match
from parley.operators.tags import as_match
from parley.streaming.events import Keeper, fold_events


class SessionKeeper(Keeper):
    """A session in state: its counters, each speaker's sum, and each held segment under a key of its own.

    Only what a micro-batch changes is written.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getValueState("counters", "next_id int, last int, calls long, serial long")
        self.speakers = handle.getMapState("speakers", "id int", "total array<double>, n long")
        self.segments = handle.getMapState("segments", "serial long", "id int, x array<double>")

    def load(self) -> Live:
        session = self.make()
        self.known, self.held = {}, {}
        if self.counters.exists():
            session.next_id, session.last, session.calls, session.serial = self.counters.get()
            self.known = {k[0]: (list(v[0]), v[1]) for k, v in self.speakers.iterator()}
            self.held = {k[0]: (v[0], list(v[1])) for k, v in self.segments.iterator()}
            for i in sorted(self.known):
                total, n = self.known[i]
                session.who[i] = Speaker(np.array(total), n)
            for serial in sorted(self.held):
                i, x = self.held[serial]
                session.who[i].held.append((serial, np.array(x)))
        return session

    def save(self, session: Live) -> None:
        self.counters.update((session.next_id, session.last, session.calls, session.serial))
        known = {i: (s.total.tolist(), s.n) for i, s in session.who.items()}
        held = {serial: (i, x.tolist()) for i, s in session.who.items() for serial, x in s.held}
        for state, before, now in ((self.speakers, self.known, known), (self.segments, self.held, held)):
            for k in before.keys() - now.keys():
                state.removeKey((k,))
            for k, v in now.items():
                if before.get(k) != v:
                    state.updateValue((k,), v)
        self.known, self.held = known, held

    def clear(self) -> None:
        for state in (self.counters, self.speakers, self.segments):
            state.clear()


def identify_stream(segments: DataFrame, time: str = "ts", limits: Limits | None = None, idle: float | None = None) -> DataFrame:
    """A stream of (session_id, seg_ix, speaker_id, outcome, segment_count).

    segments: as for ``identify``, with a watermark on ``time``.  A row comes out once the watermark has passed it,
    with the speaker and outcome that ``identify`` gives (segment_count null).  A session without rows for ``idle``
    seconds is closed: one row for each of its speakers with outcome ``closed`` and its segment_count (seg_ix null),
    then its state is dropped; a session that comes back starts with speaker 1.
    """
    lim = limits or Limits()
    rows = segments.select("session_id", "seg_ix", "embedding", "duration_sec", "rms", time)
    schema = f"seg_ix {dict(segments.dtypes)['seg_ix']}, speaker_id int, outcome string, segment_count long"
    return fold_events(rows, "session_id", ["seg_ix"], time, lambda: Live(lim), schema, idle, SessionKeeper)


def session_mappings(identified: DataFrame, matched: DataFrame) -> DataFrame:
    """(session_id, profile_id, local_id, segment_count) of closed sessions whose speakers have a profile.

    identified: rows of ``identify_stream``, as a stream or stored; matched: rows of ``match_stream``.
    """
    sure = matched.where("profile_id is not null").select("session_id", F.col("speaker").alias("speaker_id"), "profile_id")
    closed = identified.where("outcome = 'closed'")
    return closed.join(sure, ["session_id", "speaker_id"]).select("session_id", "profile_id", F.col("speaker_id").alias("local_id"), "segment_count")


def stable_stream(segments: DataFrame, time: str = "ts", idle: float | None = None) -> DataFrame:
    """E5: (who, seg_ix, centroid) for each segment of (session_id, speaker, seg_ix, embedding) at which a speaker has settled."""
    kind = dict(segments.dtypes)
    rows = segments.where("embedding is not null").select(F.struct("session_id", "speaker").alias("who"), "seg_ix", F.col("embedding").cast("array<double>").alias("embedding"), time)
    rows = rows.withColumn("who", F.to_json("who"))
    found = fold_events(rows, "who", ["seg_ix"], time, Stable, f"seg_ix {kind['seg_ix']}, centroid array<double>", idle)
    return found.withColumn("who", F.from_json("who", f"session_id {kind['session_id']}, speaker {kind['speaker']}"))


def match_stream(settled: DataFrame, profiles: Callable[[], DataFrame], path: str, checkpoint: str, high=None, medium: float = 0.35, margin: float = 0.05, available_now: bool = False) -> StreamingQuery:
    """Appends the first match of each settled speaker to the table at ``path`` (session_id, speaker, seg_ix, tier,
    profile_id, name, score); what came first stays, whatever profiles say later.

    settled: rows of ``stable_stream``; profiles: gives the version of the profile table to match with (id, name,
    centroid, n), asked at each micro-batch.  Matches of a micro-batch stand in a folder of its number; a batch that is run
    again after a restart replaces its own and looks only at those before, so each is done once.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(F.struct("who", "seg_ix").alias("query_id"), F.col("centroid").alias("embedding"))
        schema = f"{_fields(batch)}, tier string, profile_id {dict(profiles().dtypes)['id']}, name string, score double"
        before = spark.read.schema(f"{schema}, batch long").parquet(path).where(F.col("batch") < number) if _exists(spark, path) else None
        if before is not None:
            done = before.select("session_id", "speaker").distinct()
            at = (F.col("query_id.who.session_id") == F.col("session_id")) & (F.col("query_id.who.speaker") == F.col("speaker"))
            rows = rows.join(done, at, "left_anti")
        found = as_match(classify_match(rows, profiles(), high, medium, margin))
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = settled.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _fields(batch: DataFrame) -> str:
    who = batch.schema["who"].dataType
    return ", ".join(f"{n} {t}" for n, t in [("session_id", who["session_id"].dataType.simpleString()), ("speaker", who["speaker"].dataType.simpleString()), ("seg_ix", dict(batch.dtypes)["seg_ix"])])


def _exists(spark, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
