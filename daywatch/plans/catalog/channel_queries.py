"""Queries over the activity logs: cleaning, flags and daily channel features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daywatch import fixed
from daywatch.functions import cleaning
from daywatch.operators import channels as ch
from daywatch.plans.catalog.registry import query
from daywatch.plans.catalog.sql_views import view, with_views
from daywatch.sources import sample_views as sv

# The sample covers 30 days, so a schedule needs fewer days here than the default 30.
SCHEDULE_DAYS = 3


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Fractions to so many places; a double that is whole stays as it is, which spares most of them decimal text."""
    whole = "CASE WHEN rint(`{c}`) = `{c}` THEN `{c}` + 0D ELSE round(`{c}`, {places}) END AS `{c}`"
    forms = {"double": whole, "float": "round(`{c}`, {places}) AS `{c}`"}
    return df.selectExpr(*[forms.get(kind, "`{c}`").format(c=c, places=places) for c, kind in df.dtypes])


view(
    "schedules",
    f"""SELECT "user", CAST(CASE WHEN ok THEN lo ELSE 9 END AS INT) AS start_hour,
  CAST(CASE WHEN ok THEN hi ELSE 17 END AS INT) AS end_hour, ok AS schedule_complete
FROM (SELECT *, days >= {SCHEDULE_DAYS} AND lo < hi AS ok FROM (
  SELECT "user", count(DISTINCT day) AS days, trunc(quantile_cont(hour, 0.1)) AS lo, trunc(quantile_cont(hour, 0.9)) AS hi
  FROM logon_log WHERE activity = 'Logon' GROUP BY "user"))""",
)

COUNT_SQL = {
    "logon": {"logon_count": "activity = 'Logon'", "logoff_count": "activity = 'Logoff'"},
    "file": {
        "file_open_count": "activity = 'File Open'", "file_write_count": "activity = 'File Write'",
        "file_copy_count": "activity = 'File Copy'", "file_delete_count": "activity = 'File Delete'",
    },
    "device": {"usb_insert_count": "activity = 'Connect'", "usb_remove_count": "activity = 'Disconnect'"},
    "email": {
        "emails_sent": '"to" IS NOT NULL',
        "external_emails_sent": """NOT coalesce(regexp_matches("to", 'dtaa.com'), false)""",
        "attachments_sent": "attachments IS NOT NULL",
    },
    "http": {
        "http_total_requests": "true", "http_visit_count": "activity = 'WWW Visit'",
        "http_download_count": "activity = 'WWW Download'", "http_upload_count": "activity = 'WWW Upload'",
        "http_jobsite_visits": "host IN ('careerbuilder.com', 'indeed.com', 'monster.com', 'simplyhired.com', 'linkedin.com', 'www.linkedin.com')",
        "http_cloud_storage_visits": "host IN ('dropbox.com', 'www.dropbox.com', 'drive.google.com', 'docs.google.com', 'yousendit.com', 'www.yousendit.com')",
        "http_suspicious_site_visits": "host IN ('wikileaks.org', 'www.wikileaks.org')",
        "http_long_url_count": "length(clean) >= 90",
    },
}
ITEM_SQL = {"file": "filename", "email": '"to"', "http": "host"}


def daily_sql(channel: str, keys: str = '"user", pc, day', gap: int = 30, schedules: bool = True) -> str:
    """SELECT with every daily feature of one channel, unrounded."""
    spec = ch.CHANNELS[channel]
    counts = COUNT_SQL[channel]
    start = "coalesce(s.start_hour, 9)" if schedules else "9"
    end = "coalesce(s.end_hour, 17)" if schedules else "17"
    join = ' LEFT JOIN schedules s USING ("user")' if schedules else ""
    off = f"(hour < {start} OR hour > {end})"
    late = "(hour >= 22 OR hour < 5)"
    cols = [f"count(*) FILTER ({cond}) AS {name}" for name, cond in counts.items()]
    cols.append(f"count(*) FILTER ({off} AND {counts.get(spec.off_hours[1], 'true')}) AS {spec.off_hours[0]}")
    cols.append(f"count(*) FILTER ({late} AND {counts.get(spec.late_night[1], 'true')}) AS {spec.late_night[0]}")
    if spec.distinct:
        cols.append(f"count(DISTINCT {ITEM_SQL[channel]}) AS {spec.distinct}")
    peak = f", max(c) AS {channel}_peak_hour_count" if spec.peak else ""
    parts = [
        f"(SELECT {keys}, {', '.join(cols)} FROM {channel}_log{join} GROUP BY {keys})",
        f"(SELECT {keys}, -sum(c / total * ln(c / total + 1e-10)) AS {channel}_hourly_entropy{peak} FROM ("
        f"SELECT {keys}, hour, count(*) AS c, sum(count(*)) OVER (PARTITION BY {keys}) AS total "
        f"FROM {channel}_log GROUP BY {keys}, hour) GROUP BY {keys})",
    ]
    if spec.run:
        parts.append(
            f"(SELECT {keys}, max(minutes) AS {channel}_longest_active_run_minutes FROM ("
            f"SELECT {keys}, run, CAST(max(us) - min(us) AS DOUBLE) / 60000000 AS minutes FROM ("
            f"SELECT {keys}, us, sum(fresh) OVER (PARTITION BY {keys} ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM ("
            f"SELECT {keys}, us, CASE WHEN us - lag(us) OVER (PARTITION BY {keys} ORDER BY us) <= {gap * 60_000_000} THEN 0 ELSE 1 END AS fresh "
            f"FROM {channel}_log)) GROUP BY {keys}, run) GROUP BY {keys})"
        )
    names = ", ".join(feature_names(channel))
    return f"SELECT {keys}, {names} FROM {parts[0]} JOIN {f' USING ({keys}) JOIN '.join(parts[1:])} USING ({keys})"


def feature_names(channel: str) -> list[str]:
    spec = ch.CHANNELS[channel]
    names = [*spec.counts, spec.off_hours[0], spec.late_night[0]]
    names += [spec.distinct] if spec.distinct else []
    names.append(f"{channel}_hourly_entropy")
    names += [f"{channel}_peak_hour_count"] if spec.peak else []
    names += [f"{channel}_longest_active_run_minutes"] if spec.run else []
    return names


def rounded_sql(keys: str, names: list[str], body: str) -> str:
    cols = [f"round({n}, 6) + 0.0 AS {n}" if n.endswith(("_entropy", "_minutes")) else n for n in names]
    return with_views(f"SELECT {keys}, {', '.join(cols)} FROM ({body})")


# --- cleaning -------------------------------------------------------------------


@query(
    "normalise_log",
    with_views(
        """SELECT "user", pc, date_trunc('second', "timestamp") AS "timestamp", day, activity, event_id AS source_row
FROM logon_log WHERE event_id % 11 <> 0"""
    ),
)
def normalise_log(spark, sf_dir):
    return cleaning.normalise_log(sv.raw_log(spark, sf_dir)).select(
        "user", "pc", "timestamp", "day", "activity", "source_row"
    )


@query(
    "off_hours_by_schedule",
    with_views(
        """SELECT "user", day, count(*) FILTER (hour < coalesce(start_hour, 9) OR hour > coalesce(end_hour, 17)) AS off_hours,
  count(*) FILTER (hour < 9 OR hour > 17) AS off_default_hours, count(*) FILTER (hour >= 22 OR hour < 5) AS late_night
FROM file_log LEFT JOIN schedules USING ("user") GROUP BY "user", day"""
    ),
)
def off_hours_by_schedule(spark, sf_dir):
    schedules = ch.work_schedules(sv.activity_log(spark, sf_dir, "logon"), SCHEDULE_DAYS)
    events = sv.activity_log(spark, sf_dir, "file")
    flagged = ch.off_hours_flags(events, None).withColumnRenamed("off_hours", "off_default")
    flagged = ch.off_hours_flags(flagged, schedules)
    return flagged.groupBy("user", "day").agg(
        F.count_if("off_hours").alias("off_hours"),
        F.count_if("off_default").alias("off_default_hours"),
        F.count_if(cleaning.late_night(F.hour("timestamp"))).alias("late_night"),
    )


@query(
    "email_flags",
    with_views(
        """SELECT "to" AS recipient, NOT coalesce(regexp_matches("to", 'dtaa.com'), false) AS is_external,
  count(*) AS mails, count(attachments) AS with_attachment FROM email_log GROUP BY "to" """
    ),
)
def email_flags(spark, sf_dir):
    mail = sv.activity_log(spark, sf_dir, "email")
    return mail.groupBy(F.col("to").alias("recipient")).agg(
        F.first(cleaning.external_recipient(F.col("to"))).alias("is_external"),
        F.count(F.lit(1)).alias("mails"),
        F.count("attachments").alias("with_attachment"),
    )


@query(
    "url_fields",
    with_views(
        f"""SELECT event_id, clean AS url, length(clean) AS url_length, length(clean) >= 90 AS is_long, host,
  CASE WHEN clean = '' THEN '' ELSE regexp_extract(CASE WHEN regexp_matches(clean, '^https?://') THEN clean ELSE 'http://' || clean END, '^https?://([^/?#]*)', 1) END AS netloc,
  {COUNT_SQL['http']['http_jobsite_visits']} AS is_job, {COUNT_SQL['http']['http_cloud_storage_visits']} AS is_cloud,
  {COUNT_SQL['http']['http_suspicious_site_visits']} AS is_suspicious FROM http_log"""
    ),
)
def url_fields(spark, sf_dir):
    url = cleaning.clean_url(F.col("url"))
    host = cleaning.host_before_slash(url)
    return sv.activity_log(spark, sf_dir, "http").select(
        "event_id",
        url.alias("url"),
        F.length(url).cast("long").alias("url_length"),
        cleaning.is_long_url(url).alias("is_long"),
        host.alias("host"),
        cleaning.network_location(F.col("url")).alias("netloc"),
        cleaning.listed(host, fixed.JOB_DOMAINS).alias("is_job"),
        cleaning.listed(host, fixed.CLOUD_STORAGE_DOMAINS).alias("is_cloud"),
        cleaning.listed(host, fixed.SUSPICIOUS_DOMAINS).alias("is_suspicious"),
    )


@query("work_schedules", with_views("SELECT * FROM schedules"))
def work_schedules(spark, sf_dir):
    return ch.work_schedules(sv.activity_log(spark, sf_dir, "logon"), SCHEDULE_DAYS)


@query(
    "users_without_schedule",
    with_views("""SELECT DISTINCT "user" FROM ev WHERE "user" NOT IN (SELECT "user" FROM schedules WHERE schedule_complete)"""),
)
def users_without_schedule(spark, sf_dir):
    schedules = ch.work_schedules(sv.activity_log(spark, sf_dir, "logon"), SCHEDULE_DAYS)
    return ch.users_without_schedule(sv.user_days(spark, sf_dir), schedules)


# --- daily features per channel ---------------------------------------------------


def _register_daily(channel: str) -> None:
    @query(f"{channel}_daily", rounded_sql('"user", pc, day', feature_names(channel), daily_sql(channel)))
    def run(spark, sf_dir):
        schedules = ch.work_schedules(sv.activity_log(spark, sf_dir, "logon"), SCHEDULE_DAYS)
        daily = ch.channel_daily({channel: sv.activity_log(spark, sf_dir, channel)}, schedules=schedules)
        return rounded(daily.select(*ch.KEYS, *feature_names(channel)))


for _name in ch.CHANNELS:
    _register_daily(_name)


@query(
    "hourly_entropy_peak",
    with_views(
        """SELECT "user", day, round(-sum(c / total * ln(c / total + 1e-10)), 6) + 0.0 AS entropy, max(c) AS peak_hour_count FROM (
  SELECT "user", day, hour, count(*) AS c, sum(count(*)) OVER (PARTITION BY "user", day) AS total FROM ev GROUP BY "user", day, hour)
GROUP BY "user", day"""
    ),
)
def hourly_entropy_peak(spark, sf_dir):
    slots = ch.time_slots(all_events(spark, sf_dir), ["user", "day"])
    measured = ch.hour_and_run_measures(slots, ["user", "day"])
    return rounded(
        measured.groupBy("user", "day").agg(
            F.sum("entropy_part").alias("entropy"), F.max("hour_n").alias("peak_hour_count")
        )
    )


@query(
    "longest_active_run",
    with_views(
        """SELECT "user", day, round(max(minutes), 6) AS longest_run_minutes FROM (
  SELECT "user", day, run, CAST(max(us) - min(us) AS DOUBLE) / 60000000 AS minutes FROM (
    SELECT "user", day, us, sum(fresh) OVER (PARTITION BY "user", day ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM (
      SELECT "user", day, us, CASE WHEN us - lag(us) OVER (PARTITION BY "user", day ORDER BY us) <= 240 * 60000000::BIGINT THEN 0 ELSE 1 END AS fresh FROM ev))
  GROUP BY "user", day, run) GROUP BY "user", day"""
    ),
)
def longest_active_run(spark, sf_dir):
    """A four-hour gap, because the sample has only a few events per user and day."""
    slots = ch.time_slots(all_events(spark, sf_dir), ["user", "day"], gap_minutes=240)
    measured = ch.hour_and_run_measures(slots, ["user", "day"], gap_minutes=240)
    return rounded(measured.groupBy("user", "day").agg(F.max("run_minutes").alias("longest_run_minutes")))


def all_events(spark, sf_dir):
    """Every event as one activity stream."""
    events = sv.table(spark, sf_dir, "events")
    return events.select(
        F.expr("concat('u', user_id)").alias("user"),
        F.to_date("ts").alias("day"),
        F.lit("any").alias("channel"),
        cleaning.micros_of_day(F.col("ts")).alias("at"),
    )


@query(
    "partial_sums",
    with_views("""SELECT "user", day, CAST(sum(n) AS BIGINT) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM user_day GROUP BY "user", day"""),
)
def partial_sums(spark, sf_dir):
    """Additive partials built per event type, then added up by key."""
    events = sv.table(spark, sf_dir, "events")
    partials = [
        events.where(F.col("event_type") == kind)
        .groupBy(F.expr("concat('u', user_id)").alias("user"), F.to_date("ts").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
        for kind in sv.EVENT_CHANNELS.values()
    ]
    return ch.sum_partials(partials, ["user", "day"])


@query(
    "distinct_items_per_user_day",
    with_views(
        """SELECT "user", day, CAST(sum(f) AS BIGINT) AS unique_files_accessed, CAST(sum(r) AS BIGINT) AS unique_recipients, CAST(sum(d) AS BIGINT) AS unique_domains_visited FROM (
  SELECT "user", day, count(DISTINCT filename) AS f, 0 AS r, 0 AS d FROM file_log WHERE filename IS NOT NULL GROUP BY ALL
  UNION ALL SELECT "user", day, 0, count(DISTINCT "to"), 0 FROM email_log WHERE "to" IS NOT NULL GROUP BY "user", day
  UNION ALL SELECT "user", day, 0, 0, count(DISTINCT host) FROM http_log GROUP BY "user", day) GROUP BY "user", day"""
    ),
)
def distinct_items_per_user_day(spark, sf_dir):
    """True distinct counts: an item used on two machines counts once."""
    logs = sv.activity_logs(spark, sf_dir)
    events = ch.tagged_events({name: logs[name] for name in ("file", "email", "http")})
    return ch.distinct_counts(ch.distinct_items(events), ["user", "day"])


@query(
    "merge_daily_tables",
    with_views(
        """SELECT "user", pc, day, CAST(coalesce(a, 0) AS INT) AS file_rows, CAST(coalesce(b, 0) AS INT) AS mail_rows, CAST(coalesce(c, 0) AS INT) AS device_rows FROM
  (SELECT "user", pc, day, count(*) AS a FROM file_log GROUP BY ALL)
  FULL JOIN (SELECT "user", pc, day, count(*) AS b FROM email_log GROUP BY ALL) USING ("user", pc, day)
  FULL JOIN (SELECT "user", pc, day, count(*) AS c FROM device_log GROUP BY ALL) USING ("user", pc, day)"""
    ),
)
def merge_daily_tables(spark, sf_dir):
    tables = [
        sv.activity_log(spark, sf_dir, channel).groupBy(*ch.KEYS).agg(F.count(F.lit(1)).alias(alias))
        for channel, alias in (("file", "file_rows"), ("email", "mail_rows"), ("device", "device_rows"))
    ]
    return ch.merge_daily(tables)


@query(
    "duplicate_machine_days",
    with_views("""SELECT "user", day, count(*) AS rows FROM (SELECT DISTINCT "user", pc, day FROM ev) GROUP BY "user", day HAVING count(*) > 1"""),
)
def duplicate_machine_days(spark, sf_dir):
    """The key check on a coarser key, so that it has something to report."""
    events = sv._events(spark, sf_dir).select(*ch.KEYS).distinct()
    return ch.duplicate_keys(events, ["user", "day"])
