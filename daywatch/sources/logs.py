"""Readers for activity logs, directory snapshots, labelled windows and stored splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daywatch import fixed
from daywatch.functions.cleaning import normalise_log, tidy
from daywatch.operators.profiles import clean_directory


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _text_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, named by the header; the reader then prunes to what is selected."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def read_logs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The five logs (``<name>.csv``, a file or a folder of parts), needed columns only, normalised.

    All missing logs are named in one error.
    """
    missing = [f"{name}.csv" for name in fixed.LOG_COLUMNS if not _exists(spark, f"{folder}/{name}.csv")]
    if missing:
        raise FileNotFoundError("missing required logs: " + ", ".join(missing))
    return {
        name: normalise_log(_text_csv(spark, f"{folder}/{name}.csv").select(*columns))
        for name, columns in fixed.LOG_COLUMNS.items()
    }


def read_directory(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly snapshots ``YYYY-MM.csv``, files or folders of parts; the month comes from the path."""
    if not _exists(spark, folder):
        raise FileNotFoundError(f"directory snapshots not found at {folder}")
    month = F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{4}-\d{2})[^/]*\.csv(?:/[^/]*)?$", 1)
    raw = _text_csv(spark, f"{folder}/*.csv").select(
        "user_id", "employee_name", "role", "department", "team", "functional_unit", "supervisor",
        F.to_date(F.concat(month, F.lit("-01"))).alias("snapshot"),
    )
    return clean_directory(raw)


def parse_windows(raw: DataFrame, version: str | float | None = None) -> DataFrame:
    """Labelled windows from text columns (dataset, scenario, user, start, end); all versions when none is named."""
    named = raw.toDF(*[c.strip() for c in raw.columns])
    tidy_version = F.btrim(F.col("dataset").cast("string"))
    rows = named if version is None else named.where(tidy_version == str(version))
    return rows.select(
        tidy(F.col("user")).alias("user"),
        F.to_date(F.btrim("start").try_cast("timestamp_ntz")).alias("start_day"),
        F.to_date(F.btrim("end").try_cast("timestamp_ntz")).alias("end_day"),
        F.col("scenario").cast("int").alias("scenario"),
        *([tidy_version.alias("dataset")] if version is None else []),
    )


def read_windows(spark: SparkSession, path: str, version: str | float | None = None) -> DataFrame:
    raw = _text_csv(spark, path)
    by_name = {c.strip(): c for c in raw.columns}
    start = F.col(f"`{by_name['start']}`")
    us_date = r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})(.*)$"
    end = F.col(f"`{by_name['end']}`")
    iso = {
        by_name["start"]: F.regexp_replace(start, us_date, "$3-$1-$2$4"),
        by_name["end"]: F.regexp_replace(end, us_date, "$3-$1-$2$4"),
    }
    return parse_windows(raw.withColumns(iso), version)


def gated_split(df: DataFrame) -> DataFrame:
    """A stored split as the models use it: tidy user, day as date, history gate applied."""
    return (
        df.withColumn("day", F.to_date("day"))
        .withColumn("user", tidy(F.col("user")))
        .where("baseline_complete")
    )


def read_split(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".csv"):
        frame = spark.read.option("header", True).option("inferSchema", True).csv(path)
    else:
        frame = spark.read.parquet(path)
    return gated_split(frame)


def read_user_detail(df: DataFrame, user: str, columns: list[str]) -> DataFrame:
    """A few columns of one user; on a table written by ``write_by_user`` the filter skips row groups."""
    return df.where(F.col("user") == user).select(*columns)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


LIVE_SCHEMA = T.StructType(
    [
        T.StructField("user", T.StringType()),
        T.StructField("day", T.StringType()),
        T.StructField("cert_timestamp", T.StringType()),
        T.StructField("if_anomaly_score", T.DoubleType()),
        T.StructField("if_percentile_rank", T.DoubleType()),
        T.StructField("if_risk_band", T.StringType()),
        T.StructField("event_index", T.LongType()),
        T.StructField("_eos", T.BooleanType()),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)
