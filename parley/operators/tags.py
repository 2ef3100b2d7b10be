"""Names that users give to speakers of a session, and what follows for profiles, mappings and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.vectors import l2_normalize
from parley.operators.exemplars import MOST, update_profiles
from parley.operators.identify import stable_centroids
from parley.operators.maintenance import link_by_name
from parley.operators.matching import classify_match, sum_vectors


def enrollment_filter(segments: DataFrame, keys: list[str], least: float = 3.0) -> DataFrame:
    """Segments of ``least`` seconds and more; a speaker without one keeps all."""
    longest = segments.groupBy(*keys).agg(F.max("duration_sec").alias("__longest"))
    return segments.join(longest, keys).where((F.col("duration_sec") >= least) | (F.col("__longest") < least)).drop("__longest")


def create_profiles(tagged: DataFrame, now=None, most: int = MOST) -> DataFrame:
    """A profile for each id from its embeddings: mean direction, the first ``most`` exemplars, counts, times.

    tagged: id, seq, embedding, duration_sec.  Rows without embedding are left out, a null duration adds nothing.
    """
    rows = tagged.where("id is not null and embedding is not null")
    nth = Window.partitionBy("id").orderBy("seq")
    first = rows.withColumn("rn", F.row_number().over(nth)).where(F.col("rn") <= most)
    kept = first.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "embedding"))), lambda r: r["embedding"]).alias("exemplars"))
    seconds = rows.groupBy("id").agg(F.coalesce(F.sum("duration_sec"), F.lit(0.0)).alias("total_duration_sec"))
    now = F.current_timestamp() if now is None else now
    return (
        sum_vectors(rows, ["id"], "embedding")
        .join(kept, "id")
        .join(seconds, "id")
        .select(
            "id", l2_normalize(F.col("total")).alias("centroid"), "exemplars", F.col("n").alias("confirmed_count"), F.lit(0).cast("long").alias("auto_assigned_count"),
            "total_duration_sec", F.lit(0.0).alias("quality"), *[now.alias(c) for c in ("created_at", "updated_at", "last_seen_at")],
        )
    )


def rename_in_transcript(lines: DataFrame, tags: DataFrame) -> DataFrame:
    """Lines (session_id, speaker, ...) under the names of ``tags`` (session_id, speaker, name); a confidence is cleared."""
    names = tags.select("session_id", "speaker", F.col("name").alias("__name"))
    both = lines.join(names, ["session_id", "speaker"], "left").withColumn("speaker", F.coalesce("__name", "speaker"))
    if "confidence" in lines.columns:
        both = both.withColumn("confidence", F.when(F.col("__name").isNull(), F.col("confidence")))
    return both.select(lines.columns)


def apply_tags(tags: DataFrame, segments: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(updated profiles, new profiles, mapping) after speakers of sessions were named.

    tags: session_id, speaker, name, at most one name a speaker. segments: session_id, speaker, seg_ix, embedding,
    duration_sec. profiles: id (string), name, exemplars.  A name that a profile has, in any case, updates it as
    confirmed; other names open one profile each, of the segments of all their speakers.  Speakers without
    embeddings are mapped only to profiles that exist.
    """
    low = F.substring(F.sha2(F.lower("name"), 256), 1, 16)
    named = link_by_name(tags.withColumn("tag", F.col("name")), profiles).withColumn("id", F.coalesce("profile_id", low)).drop("tag")
    rows = enrollment_filter(segments.where("embedding is not null"), ["session_id", "speaker"]).join(named, ["session_id", "speaker"])
    rows = rows.withColumn("seq", F.col("seg_ix")).withColumn("confirmed", F.lit(True))
    old, new = rows.where("profile_id is not null"), rows.where("profile_id is null")
    held = profiles.join(named.select(F.col("profile_id").alias("id")).distinct(), "id", "left_semi")
    heard = rows.select("session_id", "speaker").distinct().withColumn("heard", F.lit(True))
    mapping = named.join(heard, ["session_id", "speaker"], "left").where("profile_id is not null or heard")
    return update_profiles(old, held), create_profiles(new), mapping.select("session_id", "speaker", F.col("id").alias("profile_id"))


def match_once(segments: DataFrame, profiles: DataFrame, high=None, medium: float = 0.35, margin: float = 0.05) -> DataFrame:
    """The first match, high or medium, that a speaker of a session gets once it has settled.

    segments: session_id, speaker, seg_ix, embedding. profiles: id, name, centroid, n.  A speaker without a match is
    tried again with each further segment; later matches change nothing.  A medium match is only an offer: its
    name ends in a question mark and it maps no profile.  A settled speaker that never finds one is tier ``new``.
    """
    tried = stable_centroids(segments).select(F.struct("who", "seg_ix").alias("query_id"), F.col("centroid").alias("embedding"))
    return as_match(classify_match(tried, profiles, high, medium, margin), new=True)


def as_match(classified: DataFrame, new: bool = False) -> DataFrame:
    """The first match of each speaker: classified has query_id as struct of who (session_id, speaker) and seg_ix.

    With ``new``, a speaker without a match is tier ``new`` at the first segment that was tried.
    """
    low = F.col("tier") == "low"
    found = classified if new else classified.where(~low)
    tried = F.struct("query_id.seg_ix", F.when(low, "new").otherwise(F.col("tier")).alias("tier"), "profile_id", "name", "score")
    first = found.groupBy(F.col("query_id.who").alias("who")).agg(F.min_by(tried, F.struct(low.alias("low"), F.col("query_id.seg_ix").alias("at"))).alias("m"))
    sure, offer = F.col("m.tier") == "high", F.col("m.tier") == "medium"
    return first.select(
        "who.session_id", "who.speaker", "m.seg_ix", "m.tier", F.when(sure, F.col("m.profile_id")).alias("profile_id"),
        F.when(offer, F.concat("m.name", F.lit("?"))).otherwise(F.col("m.name")).alias("name"), F.col("m.score").alias("score"),
    )


def long_auto_update(segments: DataFrame, matches: DataFrame, profiles: DataFrame, least: float = 3.0, mature: int = 10) -> DataFrame:
    """Segments that may update a profile on their own: sure match, mature profile, ``least`` seconds.

    Those up to the segment of the match count.  Returns (id, seq, embedding, duration_sec, confirmed) for I2.
    """
    sure = matches.where("tier = 'high'").select("session_id", "speaker", F.col("profile_id").alias("id"), F.col("seg_ix").alias("__at"))
    rows = segments.where(F.col("duration_sec") >= least).join(sure, ["session_id", "speaker"]).where("seg_ix <= __at")
    grown = rows.join(profiles.where(F.col("n") >= mature).select("id"), "id", "left_semi")
    return grown.select("id", F.col("seg_ix").alias("seq"), "embedding", "duration_sec", F.lit(False).alias("confirmed"))


def merge_speakers(segments: DataFrame, merges: DataFrame) -> DataFrame:
    """Segments or transcript rows of (session_id, speaker) under the speakers that ``merges`` (session_id, source,
    target) name; relabelled rows keep all else."""
    to = merges.select("session_id", F.col("source").alias("speaker"), F.col("target").alias("__to"))
    return segments.join(to, ["session_id", "speaker"], "left").withColumn("speaker", F.coalesce("__to", "speaker")).drop("__to").select(segments.columns)


def merged_profiles(merges: DataFrame, mapping: DataFrame) -> DataFrame:
    """(source, target) profiles that a merge of speakers joins: both are mapped, and not to the same."""
    to = lambda side: mapping.select("session_id", F.col("speaker").alias(side), F.col("profile_id").alias(f"{side}_profile"))
    both = merges.join(to("source"), ["session_id", "source"]).join(to("target"), ["session_id", "target"]).where("source_profile <> target_profile")
    return both.select(F.col("source_profile").alias("source"), F.col("target_profile").alias("target")).distinct()
