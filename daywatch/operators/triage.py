"""Alert dispositions as an append-only log of (user, day, status, note, timestamp).

A stored log is a base, the newest entry of each alert, and a tail of what came since. Compaction
merges the two into a base of a few files, as a new version: readers see the log before or after.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daywatch.sources import versions

KEYS = ["user", "day"]
ENTRY = "user string, day date, status string, note string, timestamp timestamp_ntz"


def latest_dispositions(log: DataFrame) -> DataFrame:
    """The newest entry per alert. An aggregate, so an alert edited very often stays cheap."""
    newest = F.max(F.struct("timestamp", "status", "note")).alias("_e")
    return log.groupBy(*KEYS).agg(newest).select(
        *KEYS, F.col("_e.status").alias("status"), F.col("_e.note").alias("note"), F.col("_e.timestamp").alias("timestamp")
    )


def append_disposition(log_path: str, entries: DataFrame) -> None:
    """Record entries; an update is a later entry for the same alert."""
    entries.select(*KEYS, "status", F.coalesce("note", F.lit("")).alias("note"), "timestamp").write.mode(
        "append"
    ).parquet(log_path)


def disposition_of(log: DataFrame, user: str, day: str) -> DataFrame:
    """One row or none."""
    return latest_dispositions(log.where((F.col("user") == user) & (F.col("day") == F.lit(day).cast("date"))))


def newest_first(log: DataFrame) -> DataFrame:
    return latest_dispositions(log).orderBy(F.desc("timestamp"), *KEYS)


def with_status(alerts: DataFrame, log: DataFrame) -> DataFrame:
    """Alerts plus ``status``, NEW without an entry."""
    status = latest_dispositions(log).select(*KEYS, F.col("status").alias("_status"))
    return alerts.join(status, KEYS, "left").select(
        *[c for c in alerts.columns if c != "status"], F.coalesce("_status", F.lit("NEW")).alias("status")
    )


def record(root: str, entries: DataFrame) -> None:
    """Append entries to the tail of a stored log."""
    append_disposition(f"{root.rstrip('/')}/tail", entries)


def stored_log(spark: SparkSession, root: str, version: versions.Version | None = None) -> DataFrame:
    """The entries of a stored log: its base (the current or a given version) and the tail that it has not taken in."""
    found = versions.versions(spark, root)
    pinned = version or (found[-1] if found else None)
    taken = set(pinned.about["taken"]) if pinned else set()
    paths = [pinned.path] if pinned else []
    paths += [f for name, f in _tail(spark, root).items() if name not in taken]
    return spark.read.schema(ENTRY).parquet(*paths) if paths else spark.createDataFrame([], ENTRY)


def compact(spark: SparkSession, root: str, files: int = 1) -> versions.Version:
    """Merge base and tail into a new base of a few files, only the newest entry of each alert left.

    The new version names the tail files that it has taken in; others, appended meanwhile, are read
    with it. Files that the version before had taken in go now: a reader of that version has no use
    for them, and one of the version before keeps its files until the next compaction. Raises
    ``versions.Conflict`` if another compaction is faster.
    """
    found = versions.versions(spark, root)
    base = found[-1] if found else None
    tail, done_with = _tail(spark, root), set(base.about["taken"]) if base else set()
    fresh = {name: path for name, path in tail.items() if name not in done_with}
    paths = [*([base.path] if base else []), *fresh.values()]
    log = spark.read.schema(ENTRY).parquet(*paths) if paths else spark.createDataFrame([], ENTRY)
    done = versions.publish(
        spark, root, lambda path: latest_dispositions(log).coalesce(files).write.parquet(path), base, {"taken": sorted(fresh)}
    )
    hadoop = spark._jvm.org.apache.hadoop.fs
    for name in done_with & tail.keys():
        path = hadoop.Path(tail[name])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)
    return done


def _tail(spark: SparkSession, root: str) -> dict[str, str]:
    """Names and paths of the tail's files."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    pattern = hadoop.Path(f"{root.rstrip('/')}/tail/*.parquet")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return {status.getPath().getName(): status.getPath().toString() for status in found or []}
