"""The feature build, lazily as DataFrames or as stored tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daywatch import fixed
from daywatch.operators import baselines as bl
from daywatch.operators import channels as ch
from daywatch.operators import layers, profiles, splits
from daywatch.operators.machines import machine_history
from daywatch.sources import sinks


@dataclass(frozen=True)
class BuildSettings:
    schedule_min_days: int = 30
    machine_min_history: int = 10
    windows: bl.BaselineWindows = field(default_factory=bl.BaselineWindows)
    peer_col: str = "role"
    default_hours: tuple[int, int] = fixed.WORK_HOURS
    internal_domain: str = fixed.INTERNAL_EMAIL_DOMAIN
    personal_schedules: bool = True
    truncate: bool = True


def activity(
    spark: SparkSession, logs: Mapping[str, DataFrame], settings: BuildSettings = BuildSettings(), path: str | None = None
) -> DataFrame:
    """The stored activity table of all logs: the only step of the build that reads them."""
    table = ch.activity_table(logs, settings.internal_domain)
    if path is None:
        return sinks.stored(spark, table, "activity")
    sinks.write_table(table, path)
    return spark.read.parquet(path)


def schedules_of(table: DataFrame, settings: BuildSettings) -> DataFrame | None:
    """Personal work hours from the activity table, if the settings want them."""
    if not settings.personal_schedules:
        return None
    return ch.schedules_from(table, settings.schedule_min_days, settings.default_hours)


def machine_day_table(
    spark: SparkSession,
    table: DataFrame,
    settings: BuildSettings = BuildSettings(),
    schedules: DataFrame | None = None,
    channels: list[str] = list(ch.CHANNELS),  # noqa: B006
) -> DataFrame:
    """(user, pc, day) features from a stored activity table.

    The aligned channel features are stored first: the machine history reads them
    three times, each time only the key columns.
    """
    schedules = schedules if schedules is not None else schedules_of(table, settings)
    daily = layers.aligned_channels(table, channels, schedules, settings.default_hours, settings.truncate)
    return machine_history(sinks.stored(spark, daily, "aligned"), settings.machine_min_history)


def collapsed_user_days(machine_day: DataFrame, items: DataFrame | None) -> DataFrame:
    distinct = ch.distinct_counts(items, ["user", "day"]) if items is not None else None
    return layers.collapse_to_user_days(machine_day, distinct)


def enriched_user_days(
    collapsed: DataFrame, directory: DataFrame | None = None, settings: BuildSettings = BuildSettings()
) -> DataFrame:
    """The collapsed table with baselines, flags, peer comparison and profiles.

    Joins come first, on the plain table; windows, statistics and the one wide
    projection that names all columns come on top of them.
    """
    features = layers.base_features(collapsed)
    kept = [f"`{c}`" for c in collapsed.columns]
    named, extra = [], []
    table = collapsed
    if directory is not None:
        peers = profiles.peer_assignment(directory, settings.peer_col)
        table = bl.with_peer_scores(collapsed, features, peers, settings.peer_col, profiles.latest_profiles(directory))
        named, extra = bl.peer_columns(features), fixed.PROFILE_COLUMNS
    table = bl.with_history(table, features, settings.windows)
    flags = layers.flag_rules(collapsed.columns)
    return table.select(
        *[F.expr(e) for e in [*kept, *bl.statistic_columns(features, settings.windows), *named]],
        *[rule.alias(name) for name, rule in flags.items()],
        *extra,
    )


def build_tables(
    spark: SparkSession,
    logs: Mapping[str, DataFrame],
    directory: DataFrame,
    windows: DataFrame,
    out_dir: str,
    settings: BuildSettings = BuildSettings(),
) -> dict[str, str]:
    """Store every table of the build below ``out_dir`` and return the paths.

    Each raw log is read once, into the activity table; schedules, machine-days and distinct
    items come from there. All of them and the user-day table are written and read back, so a
    lost executor never recomputes more than one stage.
    """
    paths = {
        name: f"{out_dir}/{name}"
        for name in (
            "activity", "schedules", "machine_days", "items", "user_days", "train", "calibration",
            "calibration_clean", "test_stream", "peer_baselines",
        )
    }
    table = activity(spark, logs, settings, paths["activity"])
    schedules = schedules_of(table, settings)
    if schedules is not None:
        sinks.write_table(schedules, paths["schedules"])
        schedules = spark.read.parquet(paths["schedules"])
    machine_days = machine_day_table(spark, table, settings, schedules, [c for c in ch.CHANNELS if c in logs])
    sinks.write_table(machine_days, paths["machine_days"])
    sinks.save_items(ch.items_of(table), paths["items"])
    machine_day, items = spark.read.parquet(paths["machine_days"]), sinks.load_items(spark, paths["items"])
    collapsed = sinks.stored(spark, collapsed_user_days(machine_day, items), "collapsed")
    sinks.write_table(enriched_user_days(collapsed, directory, settings), paths["user_days"])
    user_day = spark.read.parquet(paths["user_days"])
    parts = splits.train_calibration_test(user_day, windows)
    for name in ("train", "calibration", "calibration_clean", "test_stream"):
        sinks.write_table(parts[name], paths[name])
    train = spark.read.parquet(paths["train"])
    features = [
        n for n, kind in train.dtypes
        if n not in fixed.NON_FEATURE_COLUMNS and kind in ("int", "bigint", "float", "double")
    ]
    sinks.write_table(layers.peer_baselines(train, features), paths["peer_baselines"])
    return paths
