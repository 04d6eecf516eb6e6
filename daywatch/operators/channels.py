"""Daily features per activity channel.

Every event first collapses to one row per (key, channel, time slot) with counts
and the first and last time in the slot. This happens on the map side, so a user,
machine or day that holds a large share of all events still reaches the shuffle as
at most 48 rows per map task and day. Hours, off-hours, late-night counts, entropy,
peaks and runs all follow exactly from those slots, and the schedule join touches
slots instead of events.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daywatch import fixed
from daywatch.functions import cleaning
from daywatch.sources.sinks import stored

KEYS = ["user", "pc", "day"]
ENTROPY_FLOOR = 1e-10


@dataclass(frozen=True)
class Channel:
    """What one log contributes. ``base`` names the count that a derived count restricts; empty means all events."""

    counts: tuple[str, ...]
    off_hours: tuple[str, str]
    late_night: tuple[str, str]
    distinct: str | None = None
    peak: bool = True
    run: bool = True


CHANNELS = {
    "logon": Channel(
        ("logon_count", "logoff_count"),
        ("off_hours_logon", "logon_count"),
        ("logon_late_night_count", "logon_count"),
    ),
    "file": Channel(
        ("file_open_count", "file_write_count", "file_copy_count", "file_delete_count"),
        ("off_hours_files_accessed", ""),
        ("file_late_night_count", ""),
        distinct="unique_files_accessed",
    ),
    "device": Channel(
        ("usb_insert_count", "usb_remove_count"),
        ("off_hours_usb_usage", ""),
        ("device_late_night_count", ""),
        peak=False,
    ),
    "email": Channel(
        ("emails_sent", "external_emails_sent", "attachments_sent"),
        ("off_hours_emails", ""),
        ("email_late_night_count", ""),
        distinct="unique_recipients",
        run=False,
    ),
    "http": Channel(
        (
            "http_total_requests", "http_visit_count", "http_download_count", "http_upload_count",
            "http_jobsite_visits", "http_cloud_storage_visits", "http_suspicious_site_visits",
            "http_long_url_count",
        ),
        ("off_hours_http_requests", ""),
        ("http_late_night_count", ""),
        distinct="unique_domains_visited",
        run=False,
    ),
}


def _event_flags(channel: str, internal_domain: str) -> tuple[dict[str, Column], Column]:
    """The counted predicates of a channel and the value whose distinct count it reports."""
    activity, no_item = F.col("activity"), F.lit(None).cast("string")
    if channel == "logon":
        return {"logon_count": activity == "Logon", "logoff_count": activity == "Logoff"}, no_item
    if channel == "file":
        flags = {
            "file_open_count": activity == "File Open",
            "file_write_count": activity == "File Write",
            "file_copy_count": activity == "File Copy",
            "file_delete_count": activity == "File Delete",
        }
        return flags, F.col("filename")
    if channel == "device":
        return {"usb_insert_count": activity == "Connect", "usb_remove_count": activity == "Disconnect"}, no_item
    if channel == "email":
        flags = {
            "emails_sent": F.col("to").isNotNull(),
            "external_emails_sent": cleaning.external_recipient(F.col("to"), internal_domain),
            "attachments_sent": F.col("attachments").isNotNull(),
        }
        return flags, F.col("to")
    url = cleaning.clean_url(F.col("url"))
    host = cleaning.host_before_slash(url)
    flags = {
        "http_total_requests": F.lit(True),
        "http_visit_count": activity == "WWW Visit",
        "http_download_count": activity == "WWW Download",
        "http_upload_count": activity == "WWW Upload",
        "http_jobsite_visits": cleaning.listed(host, fixed.JOB_DOMAINS),
        "http_cloud_storage_visits": cleaning.listed(host, fixed.CLOUD_STORAGE_DOMAINS),
        "http_suspicious_site_visits": cleaning.listed(host, fixed.SUSPICIOUS_DOMAINS),
        "http_long_url_count": cleaning.is_long_url(url),
    }
    return flags, host


def tagged_events(
    logs: Mapping[str, DataFrame],
    internal_domain: str = fixed.INTERNAL_EMAIL_DOMAIN,
    without_machine: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Normalised logs as one frame: key, channel, time of day, counted flags and distinct-count item.

    Events without a user go, and those without a machine too unless ``without_machine``. Columns to
    ``keep`` come along.
    """
    parts = []
    for channel, log in logs.items():
        flags, item = _event_flags(channel, internal_domain)
        usable = F.col("user").isNotNull()
        parts.append(
            log.where(usable if without_machine else usable & F.col("pc").isNotNull()).select(
                *KEYS,
                *keep,
                F.lit(channel).alias("channel"),
                cleaning.micros_of_day(F.col("timestamp")).alias("at"),
                item.alias("item"),
                *[F.coalesce(flag, F.lit(False)).cast("long").alias(name) for name, flag in flags.items()],
            )
        )
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def slot_minutes(gap_minutes: int) -> int:
    """Widest slot that nests in an hour and cannot hide a gap of more than ``gap_minutes``."""
    if gap_minutes < 1:
        raise ValueError("the gap must be at least one minute")
    return max(width for width in (1, 2, 3, 4, 5, 6, 10, 12, 15, 20, 30, 60) if width <= gap_minutes)


def counted(table: DataFrame) -> list[str]:
    """The counts of events that a table has."""
    return [name for spec in CHANNELS.values() for name in spec.counts if name in table.columns]


def time_slots(
    events: DataFrame, keys: list[str] = KEYS, gap_minutes: int = fixed.RUN_GAP_MINUTES
) -> DataFrame:
    """Partial sums per (key, channel, slot) with the first and last time in the slot."""
    width = slot_minutes(gap_minutes)
    slot = F.floor(F.col("at") / (width * 60_000_000)).cast("int")
    return events.groupBy(*keys, "channel", slot.alias("slot")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("at").alias("first_at"),
        F.max("at").alias("last_at"),
        *[F.sum(name).alias(name) for name in counted(events)],
    ).withColumn("hour", F.floor(F.col("slot") * width / 60).cast("int"))


def activity_table(
    logs: Mapping[str, DataFrame],
    internal_domain: str = fixed.INTERNAL_EMAIL_DOMAIN,
    gap_minutes: int = fixed.RUN_GAP_MINUTES,
) -> DataFrame:
    """All that the daily features, distinct counts and schedules need, from one scan of each log.

    One row per (user, pc, day, channel, slot, item), summed in the tasks first. Store it: what
    is derived from it (``slots_of``, ``items_of``, ``schedules_from``) then never reads a log again.
    """
    events = tagged_events(logs, internal_domain, without_machine=True)
    return time_slots(events, [*KEYS, "item"], gap_minutes)


def slots_of(activity: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The rows of ``time_slots``, from a stored ``activity_table``."""
    return (
        activity.where(F.col("pc").isNotNull())
        .groupBy(*keys, "channel", "slot", "hour")
        .agg(
            F.sum("n").alias("n"),
            F.min("first_at").alias("first_at"),
            F.max("last_at").alias("last_at"),
            *[F.sum(name).alias(name) for name in counted(activity)],
        )
    )


def items_of(activity: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The rows of ``distinct_items``, from a stored ``activity_table``."""
    return distinct_items(activity.where(F.col("pc").isNotNull()), keys)


def schedules_from(
    activity: DataFrame, min_days: int = 30, default_hours: tuple[int, int] = fixed.WORK_HOURS
) -> DataFrame:
    """``work_schedules``, from a stored ``activity_table``."""
    hourly = (
        activity.where("logon_count > 0").groupBy("user", "day", "hour").agg(F.sum("logon_count").alias("n"))
    )
    return _schedules(hourly, min_days, default_hours)


def hour_and_run_measures(
    slots: DataFrame, keys: list[str], gap_minutes: int = fixed.RUN_GAP_MINUTES
) -> DataFrame:
    """Adds per slot: its hour's count, its entropy share and minutes since its run began.

    One sort on (keys, channel, hour, slot) serves all three windows, each over at
    most one day of slots.
    """
    day = Window.partitionBy(*keys, "channel")
    in_order = day.orderBy("hour", "slot")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = F.col("first_at") - F.lag("last_at").over(in_order)
    run_began = F.max(F.when(F.col("opens"), F.col("first_at"))).over(so_far)
    share = F.col("n") / F.col("day_n")
    hour_share = F.col("hour_n") / F.col("day_n")
    return (
        slots.withColumn("opens", gap.isNull() | (gap > gap_minutes * 60_000_000))
        .withColumn("run_minutes", (F.col("last_at") - run_began) / 60_000_000)
        .withColumn("hour_n", F.sum("n").over(Window.partitionBy(*keys, "channel", "hour")))
        .withColumn("day_n", F.sum("n").over(day))
        .withColumn("entropy_part", -share * F.log(hour_share + ENTROPY_FLOOR))
    )


def _daily_columns(channels: list[str], available: list[str]) -> list[Column]:
    out = []
    for name in channels:
        spec = CHANNELS[name]
        here = F.col("channel") == name

        def restricted(base: str, condition: Column, alias: str, here: Column = here) -> Column:
            counted = F.col(base) if base else F.col("n")
            return F.coalesce(F.sum(F.when(here & condition, counted)), F.lit(0)).alias(alias)

        out += [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in spec.counts if c in available]
        out.append(restricted(spec.off_hours[1], F.col("off_hours"), spec.off_hours[0]))
        out.append(restricted(spec.late_night[1], F.col("late_night"), spec.late_night[0]))
        out.append(F.coalesce(F.sum(F.when(here, F.col("entropy_part"))), F.lit(0.0)).alias(f"{name}_hourly_entropy"))
        if spec.peak:
            out.append(
                F.coalesce(F.max(F.when(here, F.col("hour_n"))), F.lit(0)).alias(f"{name}_peak_hour_count")
            )
        if spec.run:
            out.append(
                F.coalesce(F.max(F.when(here, F.col("run_minutes"))), F.lit(0.0)).alias(
                    f"{name}_longest_active_run_minutes"
                )
            )
    return out


def daily_from_slots(
    slots: DataFrame,
    channels: list[str],
    keys: list[str] = KEYS,
    schedules: DataFrame | None = None,
    default_hours: tuple[int, int] = fixed.WORK_HOURS,
    gap_minutes: int = fixed.RUN_GAP_MINUTES,
) -> DataFrame:
    """One row per key with every count, entropy, peak and run of the given channels."""
    start, end = F.lit(default_hours[0]), F.lit(default_hours[1])
    if schedules is not None:
        slots = slots.join(schedules.select("user", "start_hour", "end_hour"), "user", "left")
        start, end = F.coalesce("start_hour", start), F.coalesce("end_hour", end)
    slots = slots.withColumns(
        {
            "off_hours": cleaning.outside_hours(F.col("hour"), start, end),
            "late_night": cleaning.late_night(F.col("hour")),
        }
    )
    # Slots are already summed; placing them by key serves the windows and the final sum.
    measured = hour_and_run_measures(slots.repartition(*keys), keys, gap_minutes)
    return measured.groupBy(*keys).agg(*_daily_columns(channels, slots.columns))


def distinct_items(events: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The distinct (key, channel, item) rows; persisted, they are the restart point for exact distinct counts."""
    return events.where(F.col("item").isNotNull()).select(*keys, "channel", "item").distinct()


def distinct_counts(items: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Exact distinct counts per key. ``items`` may hold finer keys (an item on two machines counts once).

    Two aggregations: duplicates go first, spread over (key, item), so no key's
    items gather in one task before they are counted.
    """
    wanted = {name: spec.distinct for name, spec in CHANNELS.items() if spec.distinct}
    once = items.groupBy(*keys, "channel", "item").agg(F.lit(1).alias("_one"))
    return once.groupBy(*keys).agg(
        *[F.count_if(F.col("channel") == name).alias(alias) for name, alias in wanted.items()]
    )


def channel_daily(
    logs: Mapping[str, DataFrame],
    keys: list[str] = KEYS,
    schedules: DataFrame | None = None,
    default_hours: tuple[int, int] = fixed.WORK_HOURS,
    gap_minutes: int = fixed.RUN_GAP_MINUTES,
    internal_domain: str = fixed.INTERNAL_EMAIL_DOMAIN,
) -> DataFrame:
    """Daily features of one or more channels, aligned on the key; a channel without events reads 0.

    Logs with distinct counts are reduced to their ``activity_table``, stored, first.
    """
    channels = list(logs)
    if any(CHANNELS[name].distinct for name in channels):
        activity = activity_table(logs, internal_domain, gap_minutes)
        activity = stored(activity.sparkSession, activity, "activity")
        return daily_from_activity(activity, channels, keys, schedules, default_hours, gap_minutes)
    slots = time_slots(tagged_events(logs, internal_domain), keys, gap_minutes)
    return daily_from_slots(slots, channels, keys, schedules, default_hours, gap_minutes)


def daily_from_activity(
    activity: DataFrame,
    channels: list[str],
    keys: list[str] = KEYS,
    schedules: DataFrame | None = None,
    default_hours: tuple[int, int] = fixed.WORK_HOURS,
    gap_minutes: int = fixed.RUN_GAP_MINUTES,
) -> DataFrame:
    """``channel_daily`` from a stored ``activity_table`` of at least these channels."""
    rows = activity.where(F.col("channel").isin(channels))
    daily = daily_from_slots(slots_of(rows, keys), channels, keys, schedules, default_hours, gap_minutes)
    distinct = [CHANNELS[name].distinct for name in channels if CHANNELS[name].distinct]
    if not distinct:
        return daily
    counted = distinct_counts(items_of(rows, keys), keys).select(*keys, *distinct)
    return daily.join(counted, keys, "left").fillna(0, distinct)


def merge_daily(tables: list[DataFrame], keys: list[str] = KEYS) -> DataFrame:
    """Align separate daily tables on the key with one shuffle; absent activity is 0, values become int.

    The tables must have disjoint feature columns and unique keys
    (see ``duplicate_keys``).
    """
    if not tables:
        raise ValueError("no feature tables to merge")
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    features = [c for c in stacked.columns if c not in keys]
    return stacked.groupBy(*keys).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("int").alias(c) for c in features]
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; empty for a valid table."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def sum_partials(partials: list[DataFrame], keys: list[str]) -> DataFrame:
    """Add up additive partial aggregates by key."""
    stacked = reduce(lambda a, b: a.unionByName(b), partials)
    measures = [c for c in stacked.columns if c not in keys]
    return stacked.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in measures])


def work_schedules(
    logon: DataFrame,
    min_days: int = 30,
    default_hours: tuple[int, int] = fixed.WORK_HOURS,
    low: float = 0.10,
    high: float = 0.90,
) -> DataFrame:
    """Each user's usual hours: interpolated low and high percentile of logon hours, truncated.

    Events reduce to counts per (user, day, hour) first, so a user brings at most
    24 rows per day and the percentile buffer holds at most 24 values.
    """
    hourly = (
        logon.where((F.col("activity") == "Logon") & F.col("user").isNotNull())
        .groupBy("user", "day", F.hour("timestamp").alias("hour"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return _schedules(hourly, min_days, default_hours, low, high)


def _schedules(
    hourly: DataFrame,
    min_days: int,
    default_hours: tuple[int, int],
    low: float = 0.10,
    high: float = 0.90,
) -> DataFrame:
    per_day = hourly.groupBy("user").agg(
        F.count_distinct("day").alias("days"),
        F.percentile("hour", F.array(F.lit(low), F.lit(high)), F.col("n")).alias("p"),
    )
    start, end = F.col("p")[0].cast("int"), F.col("p")[1].cast("int")
    complete = (F.col("days") >= min_days) & (start < end)
    return per_day.select(
        "user",
        F.when(complete, start).otherwise(default_hours[0]).alias("start_hour"),
        F.when(complete, end).otherwise(default_hours[1]).alias("end_hour"),
        complete.alias("schedule_complete"),
    )


def off_hours_flags(
    events: DataFrame,
    schedules: DataFrame | None,
    default_hours: tuple[int, int] = fixed.WORK_HOURS,
) -> DataFrame:
    """Events plus ``off_hours``; needs an ``hour`` or a ``timestamp`` column."""
    if "hour" in events.columns:
        hour = F.col("hour")
    elif "timestamp" in events.columns:
        hour = F.hour("timestamp")
    else:
        raise ValueError("events need an 'hour' or a 'timestamp' column")
    start, end = F.lit(default_hours[0]), F.lit(default_hours[1])
    if schedules is None:
        return events.withColumn("off_hours", cleaning.outside_hours(hour, start, end))
    hours = schedules.select("user", F.col("start_hour").alias("_start"), F.col("end_hour").alias("_end"))
    return (
        events.join(hours, "user", "left")
        .withColumn(
            "off_hours",
            cleaning.outside_hours(hour, F.coalesce("_start", start), F.coalesce("_end", end)),
        )
        .drop("_start", "_end")
    )


def users_without_schedule(users: DataFrame, schedules: DataFrame | None) -> DataFrame:
    distinct = users.select("user").distinct()
    if schedules is None:
        return distinct
    return distinct.join(schedules.where("schedule_complete"), "user", "left_anti")
