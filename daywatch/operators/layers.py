"""The machine-day table and its collapse to user-days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daywatch import fixed
from daywatch.functions.cleaning import require_columns
from daywatch.operators import channels as ch


def aligned_channels(
    activity: DataFrame,
    channels: list[str],
    schedules: DataFrame | None = None,
    default_hours: tuple[int, int] = fixed.WORK_HOURS,
    truncate: bool = True,
) -> DataFrame:
    """One row per (user, pc, day) with the features of all channels, from a stored activity table.

    ``truncate`` keeps the published behaviour of storing entropies and run
    minutes as whole numbers.
    """
    daily = ch.daily_from_activity(activity, channels, schedules=schedules, default_hours=default_hours)
    if not truncate:
        return daily
    features = [c for c in daily.columns if c not in ch.KEYS]
    return daily.select(*ch.KEYS, *[F.col(c).cast("int").alias(c) for c in features])


def collapse_to_user_days(machine_day: DataFrame, distinct: DataFrame | None = None) -> DataFrame:
    """(user, pc, day) to (user, day): sums, maxima and means of the columns that exist,
    activity on machines other than the primary one, and exact distinct counts."""
    require_columns(machine_day, ["user", "pc", "day"], "machine-day table")
    present = set(machine_day.columns)

    def aggregated(names: list[str], fn) -> list[Column]:
        return [fn(n).alias(n) for n in names if n in present]

    other_machine = F.col("pc_is_primary") == 0 if "pc_is_primary" in present else F.lit(False)

    def elsewhere(name: str | None, alias: str) -> Column:
        value = F.lit(1) if name is None else F.col(name) if name in present else F.lit(0)
        return F.coalesce(F.sum(F.when(other_machine, value)), F.lit(0)).cast("long").alias(alias)

    means = [
        F.avg(n).alias("primary_pc_activity_ratio" if n == "pc_is_primary" else n)
        for n in fixed.MEAN_FEATURES
        if n in present
    ]
    user_day = machine_day.groupBy("user", "day").agg(
        *aggregated(fixed.SUM_FEATURES, F.sum),
        *aggregated(fixed.MAX_FEATURES, F.max),
        *means,
        *aggregated(fixed.CONTEXT_MAX_FEATURES, F.max),
        F.count(F.lit(1)).alias("pcs_used_count"),
        elsewhere(None, "non_primary_pc_used_flag"),
        elsewhere("http_total_requests", "non_primary_pc_http_requests_flag"),
        elsewhere("usb_insert_count", "non_primary_pc_usb_flag"),
        elsewhere("file_copy_count", "non_primary_pc_file_copy_flag"),
    )
    if distinct is not None:
        user_day = user_day.join(distinct, ["user", "day"], "left")
    return user_day.fillna(0)


def base_features(df: DataFrame) -> list[str]:
    return [name for name in fixed.BASE_FEATURES if name in df.columns]


def flag_rules(columns: list[str]) -> dict[str, Column]:
    """Seven 0/1 expressions that combine channels; an absent input reads 0."""

    def active(name: str) -> Column:
        return F.col(name) > 0 if name in columns else F.lit(False)

    any_off_hours = F.lit(False)
    for name in columns:
        if name in fixed.BASE_FEATURES and name.startswith("off_hours"):
            any_off_hours = any_off_hours | active(name)
    rules = {
        "off_hours_activity_flag": any_off_hours,
        "usb_file_activity_flag": active("usb_insert_count") & active("file_write_count"),
        "external_comm_activity_flag": active("external_emails_sent"),
        "jobsite_usb_activity_flag": active("http_jobsite_visits") & active("usb_insert_count"),
        "suspicious_upload_flag": active("http_jobsite_visits") & active("http_upload_count"),
        "cloud_upload_flag": active("http_upload_count") & active("http_cloud_storage_visits"),
        "non_primary_pc_risk_flag": active("non_primary_pc_http_requests_flag")
        | active("non_primary_pc_usb_flag")
        | active("non_primary_pc_file_copy_flag"),
    }
    return {name: F.coalesce(rule, F.lit(False)).cast("int") for name, rule in rules.items()}


def cross_channel_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(flag_rules(df.columns))


def peer_baselines(df: DataFrame, features: list[str], by: str = "department") -> DataFrame:
    """Mean of each feature per department and day."""
    return df.groupBy(by, "day").agg(*[F.avg(f).alias(f) for f in features])
