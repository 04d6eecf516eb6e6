"""Writing and re-reading tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daywatch import fixed
from daywatch.session import scratch_path


def nested_as_json(df: DataFrame) -> DataFrame:
    """Arrays, structs and maps become JSON text."""
    nested = ("array", "struct", "map")
    return df.select(
        *[F.to_json(n).alias(n) if kind.startswith(nested) else F.col(n) for n, kind in df.dtypes]
    )


def doubles_as_float(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.col(n).cast("float").alias(n) if kind == "double" else F.col(n) for n, kind in df.dtypes]
    )


def write_table(df: DataFrame, path: str, fmt: str | None = None, **options: str) -> str:
    """Write parquet or CSV, by ``fmt`` or the path's extension (parquet without one)."""
    tail = path.rstrip("/").rsplit("/", 1)[-1]
    fmt = fmt or (tail.rsplit(".", 1)[1] if "." in tail else "parquet")
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"tables are written as 'csv' or 'parquet', not {fmt!r}")
    writer = df.write.mode("overwrite").options(**options)
    if fmt == "csv":
        nested_as_json(df).write.mode("overwrite").options(header="true", **options).csv(path)
    else:
        writer.parquet(path)
    return path


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back, which also ends its lineage."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def save_items(items: DataFrame, path: str) -> str:
    """Store the distinct-item rows, one folder per channel, as the restart point of the collapse."""
    items.write.mode("overwrite").partitionBy("channel").parquet(path)
    return path


def load_items(spark: SparkSession, path: str) -> DataFrame:
    """Read the stored items; a missing folder raises Spark's path-not-found error."""
    return spark.read.parquet(path).select("user", "pc", "day", "channel", "item")


def convert_csv(spark: SparkSession, csv_path: str, parquet_path: str, schema: str) -> bool:
    """CSV to parquet unless the parquet is at least as new. True when it was written."""

    def newest(path: str) -> int:
        hadoop = spark._jvm.org.apache.hadoop.fs
        target = hadoop.Path(path)
        fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(target):
            return -1
        status = fs.getFileStatus(target)
        if not status.isDirectory():
            return status.getModificationTime()
        return max((s.getModificationTime() for s in fs.listStatus(target)), default=-1)

    source = newest(csv_path)
    if source < 0 or newest(parquet_path) >= source:
        return False
    spark.read.schema(schema).option("header", True).csv(csv_path).write.mode("overwrite").parquet(parquet_path)
    return True


def write_by_user(df: DataFrame, path: str, files: int | None = None) -> str:
    """Range-partitioned and sorted by user, so that a one-user read skips nearly all row groups.

    The day is a second sort key: a user with very many rows spreads over files.
    """
    keys = ["user", "day"]
    placed = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    placed.sortWithinPartitions(*keys).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def write_user_details(df: DataFrame, path: str) -> str:
    """Alert details in the layout of ``write_by_user``: a read of one user skips all other row groups."""
    return write_by_user(df.select("user", "day", "top_contributors", "explanation"), path)


def wanted_present(df: DataFrame, wanted: list[str]) -> tuple[list[str], list[str]]:
    """The wanted columns that exist, and those that do not."""
    return [c for c in wanted if c in df.columns], [c for c in wanted if c not in df.columns]


SERVING_COLUMNS = ["user", "day", *fixed.RAW_FEATURES, *fixed.CROSS_FLAGS, *fixed.PROFILE_COLUMNS, "baseline_complete"]
SERVING_SCORES = ["user", "day", *fixed.SCORE_COLUMNS]


def serving_table(user_day: DataFrame, alerts: DataFrame) -> DataFrame:
    """The slim table behind the serving queries: wanted columns that exist, scores left-joined, narrow types."""
    from daywatch.functions.cleaning import narrow_types

    left = user_day.select(*wanted_present(user_day, SERVING_COLUMNS)[0])
    right_cols = wanted_present(alerts, SERVING_SCORES)[0]
    right = alerts.select("user", "day", *[c for c in right_cols if c not in left.columns])
    return narrow_types(left.join(right, ["user", "day"], "left"))
