"""Chronological splits, labelled windows and training preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def day_at_ratio(df: DataFrame, ratio: float) -> DataFrame:
    """One row with the day at position floor(days * ratio) of the sorted distinct days.

    Distinct days are few (one per calendar day), so ordering them is one small task.
    """
    if not 0 <= ratio < 1:
        raise ValueError("the split ratio must be at least 0 and below 1")
    days = df.select("day").distinct().withColumn(
        "_at", F.row_number().over(Window.orderBy("day")) - 1
    )
    count = F.count(F.lit(1)).over(Window.partitionBy())
    return (
        days.withColumn("_days", count)
        .where(F.col("_at") == F.floor(F.col("_days") * F.lit(ratio)))
        .select("day")
    )


def chronological_split(df: DataFrame, ratio: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """Rows up to and including the cutoff day, and the rows after it."""
    cutoff = day_at_ratio(df, ratio).scalar()
    return df.where(F.col("day") <= cutoff), df.where(F.col("day") > cutoff)


def merged_windows(windows: DataFrame) -> DataFrame:
    """Each user's windows without overlaps: ``user, start_day, end_day`` of runs of days covered.

    A sweep by start: a window opens a new run if it starts more than a day after everything before
    it has ended. Windows that end before they start cover nothing.
    """
    usable = windows.where("start_day <= end_day").select("user", "start_day", "end_day")
    in_order = Window.partitionBy("user").orderBy("start_day", "end_day")
    reached = F.max("end_day").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opens = reached.isNull() | (F.col("start_day") > F.date_add(reached, 1))
    run = F.sum(opens.cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = usable.withColumn("_reached", reached).withColumn("_run", run)
    return (
        runs.groupBy("user", "_run").agg(F.min("start_day").alias("start_day"), F.max("end_day").alias("end_day")).drop("_run")
    )


def with_label(df: DataFrame, windows: DataFrame) -> DataFrame:
    """All rows with ``label`` 1 inside a window of their user, bounds included, else 0.

    Windows are merged first, so a row meets one at most and the rows are read and joined once.
    """
    merged = merged_windows(windows).select(
        F.col("user").alias("_user"), F.col("start_day").alias("_start"), F.col("end_day").alias("_end")
    )
    inside = (F.col("user") == F.col("_user")) & F.col("day").between(F.col("_start"), F.col("_end"))
    return df.join(merged, inside, "left").select(
        *[F.col(f"`{c}`") for c in df.columns], F.col("_user").isNotNull().cast("int").alias("label")
    )


def labelled_rows(df: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows inside any window of their user, bounds included; overlapping windows count once."""
    return with_label(df, windows).where("label = 1").drop("label")


def unlabelled_rows(df: DataFrame, windows: DataFrame) -> DataFrame:
    return with_label(df, windows).where("label = 0").drop("label")


def without_labelled_users(df: DataFrame, windows: DataFrame) -> DataFrame:
    return df.join(windows.select("user").distinct(), "user", "left_anti")


def train_calibration_test(df: DataFrame, windows: DataFrame) -> dict[str, DataFrame]:
    """80/10/10 by day, plus the calibration part without labelled users."""
    rest, test = chronological_split(df, 0.9)
    train, calibration = chronological_split(rest, 8 / 9)
    return {
        "train": train,
        "calibration": calibration,
        "calibration_clean": without_labelled_users(calibration, windows),
        "test_stream": test,
    }


def training_parts(df: DataFrame, windows: DataFrame, validation_ratio: float = 0.15) -> dict[str, DataFrame]:
    """Gate on history, take labelled rows out, split the normal rows into fit and validation by day."""
    gated = df.where("baseline_complete")
    normal = unlabelled_rows(gated, windows)
    fit, validation = chronological_split(normal, 1.0 - validation_ratio)
    return {"gated": gated, "normal": normal, "fit": fit, "validation": validation}


def replay_rows(df: DataFrame, ratio: float = 0.90) -> DataFrame:
    """The last part of the days, the cutoff day included, re-dated to follow the last day."""
    cutoff = day_at_ratio(df, ratio).scalar()
    tail = df.where(F.col("day") >= cutoff)
    shift = tail.agg(F.date_diff(F.max("day"), F.min("day")) + 1).scalar()
    return tail.withColumn("day", F.date_add("day", shift))
