"""Table maintenance: each operation returns the next version of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def import_profiles(table: DataFrame, incoming: DataFrame, merge: bool = True, key: str = "id") -> DataFrame:
    """Merge keeps rows that exist; otherwise imported rows replace them."""
    keep, add = (table, incoming) if merge else (incoming, table)
    return keep.unionByName(add.join(keep.select(key), key, "left_anti"))


def rename_profiles(table: DataFrame, names: DataFrame, key: str = "id", now=None) -> DataFrame:
    """I4: names: id, new_name.  Where the table has updated_at, it is set for the profiles that are renamed."""
    both = table.join(names, key, "left")
    if "updated_at" in table.columns:
        at = (F.current_timestamp() if now is None else now).cast(dict(table.dtypes)["updated_at"])
        both = both.withColumn("updated_at", F.when(F.col("new_name").isNotNull(), at).otherwise(F.col("updated_at")))
    return both.withColumn("name", F.coalesce("new_name", "name")).drop("new_name")


def newest(rows: DataFrame, keys: list[str], order: list, most: int, exempt: Column | None = None) -> DataFrame:
    """the ``most`` first rows of each key in ``order``; exempt rows stay and do not count."""
    free = F.lit(False) if exempt is None else F.coalesce(exempt, F.lit(False))
    w = Window.partitionBy(*keys, "free__").orderBy(*order)
    return rows.withColumn("free__", free).withColumn("rn__", F.row_number().over(w)).where(f"free__ or rn__ <= {most}").drop("free__", "rn__")


def profile_stats(profiles: DataFrame, mapping: DataFrame) -> DataFrame:
    """Samples, seconds, times, quality and the number of sessions of each profile; none are 0.

    profiles: id, confirmed_count, auto_assigned_count, total_duration_sec, created_at, last_seen_at, quality;
    mapping: session_id, speaker_id.
    """
    sessions = mapping.groupBy(F.col("speaker_id").alias("id")).agg(F.countDistinct("session_id").alias("sessions"))
    return profiles.join(sessions, "id", "left").select(
        "id", (F.col("confirmed_count") + F.col("auto_assigned_count")).alias("samples"), F.col("total_duration_sec").alias("total_sec"),
        F.col("created_at").alias("created"), F.col("last_seen_at").alias("last_seen"), "quality", F.coalesce("sessions", F.lit(0)).alias("sessions"),
    )


def incident_table(events: DataFrame) -> DataFrame:
    """(event_id, key, val) of timestamp, context, error type and message, and of each value of the state.

    events: event_id, ts, context, error_type, error_message, state (a JSON object).  Scalars are as written, nested values
    as JSON; state keys that are named like a field take its place; a null field or value is null.
    """
    fields = {
        "timestamp": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "context": F.col("context"), "error_type": F.col("error_type"), "error_message": F.col("error_message"),
    }
    own = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))])
    state = F.coalesce(F.from_json("state", "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))
    both = F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(state, k)), state)
    return events.select("event_id", F.explode(both).alias("key", "val"))


def delete_profiles(table: DataFrame, mapping: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The profiles and their session mappings without those of ``gone`` (id)."""
    return table.join(gone, "id", "left_anti"), mapping.join(gone.withColumnRenamed("id", "speaker_id"), "speaker_id", "left_anti")


def upsert(table: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """I8: insert or replace."""
    return table.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)


def link_by_name(tags: DataFrame, profiles: DataFrame) -> DataFrame:
    """Case-insensitive name, the first profile wins."""
    w = Window.partitionBy(F.lower("name")).orderBy("id")
    first = profiles.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(F.lower("name").alias("low"), F.col("id").alias("profile_id"))
    return tags.withColumn("low", F.lower("tag")).join(first, "low", "left").drop("low")
