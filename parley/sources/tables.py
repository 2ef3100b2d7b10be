"""Profile tables in the catalog: schema, export, daily snapshots, and chunk files as a stream."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession

VERSION = 1
TABLES = {
    "profiles": "id string, name string, color string, centroid array<double>, exemplars array<array<double>>, sub_centroids array<array<double>>, "
    "confirmed_count bigint, auto_assigned_count bigint, total_duration_sec double, quality double, created_at timestamp, updated_at timestamp, last_seen_at timestamp",
    "session_speakers": "session_id string, speaker_id int, profile_id string, segment_count bigint",
    "schema_version": "version int",
}


def init_schema(spark: SparkSession, database: str) -> int:
    """The tables that are missing are made; the version is recorded once and returned."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
    days = ", ".join(c.split(" ", 1)[0] for c in TABLES["profiles"].split(", "))
    if not spark.catalog.tableExists(f"{database}.snapshots"):
        spark.sql(f"CREATE TABLE {database}.snapshots USING parquet PARTITIONED BY (snap) AS SELECT {days}, '' AS snap FROM {database}.profiles WHERE false")
    if spark.table(f"{database}.schema_version").isEmpty():
        spark.sql(f"INSERT INTO {database}.schema_version VALUES ({VERSION})")
    return spark.table(f"{database}.schema_version").first().version


def export_profiles(profiles: DataFrame, path: str) -> None:
    """A10: a full copy of the table that any reader of Parquet can open."""
    profiles.write.mode("overwrite").parquet(path)


def snapshot_days(spark: SparkSession, database: str) -> list[str]:
    """Days of which a snapshot is kept, oldest first."""
    return sorted(r.partition.split("=", 1)[1] for r in spark.sql(f"SHOW PARTITIONS {database}.snapshots").collect())


def snapshot(spark: SparkSession, database: str, day: datetime.date, keep: int = 7) -> list[str]:
    """The profiles as they are under ``day``, unless that day has a snapshot; the newest ``keep`` days stay."""
    snap = day.isoformat()
    if snap not in snapshot_days(spark, database):
        spark.sql(f"INSERT INTO {database}.snapshots PARTITION (snap = '{snap}') SELECT * FROM {database}.profiles")
        for old in snapshot_days(spark, database)[:-keep]:
            spark.sql(f"ALTER TABLE {database}.snapshots DROP IF EXISTS PARTITION (snap = '{old}')")
    return snapshot_days(spark, database)


def delete_all(spark: SparkSession, database: str) -> None:
    """Profiles, mappings and snapshots are emptied; the schema stays."""
    for name in ("profiles", "session_speakers", "snapshots"):
        spark.sql(f"TRUNCATE TABLE {database}.{name}")


def chunk_source(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A4: Parquet files of chunks (stream_id, seq, ts, samples) as a stream, as they arrive in a folder."""
    schema = "stream_id bigint, seq bigint, ts timestamp, samples array<float>"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
