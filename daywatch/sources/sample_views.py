"""The engine's inputs, expressed over the sample tables (events, customer, nation, pages, ...).

Each view has the same definition in SQL in ``daywatch.plans.catalog.sql_views``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_CHANNELS = {"logon": "signup", "file": "click", "device": "error", "email": "purchase", "http": "view"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str, channel: str | None = None) -> DataFrame:
    events = table(spark, sf_dir, "events")
    if channel:
        events = events.where(F.col("event_type") == EVENT_CHANNELS[channel])
    return events.select(
        "event_id",
        F.expr("concat('u', user_id)").alias("user"),
        F.expr(
            "concat('pc', CASE WHEN (event_id * 7 + user_id) % 10 < 7 THEN user_id % 97 ELSE 100 + event_id % 5 END)"
        ).alias("pc"),
        F.col("ts").alias("timestamp"),
        F.to_date("ts").alias("day"),
        "event_type",
        "value",
    )


ACTIVITY = {
    "logon": "CASE WHEN event_id % 2 = 0 THEN 'Logon' ELSE 'Logoff' END",
    "file": "CASE event_id % 4 WHEN 0 THEN 'File Open' WHEN 1 THEN 'File Write' WHEN 2 THEN 'File Copy' ELSE 'File Delete' END",
    "device": "CASE WHEN event_id % 2 = 0 THEN 'Connect' ELSE 'Disconnect' END",
    "http": "CASE event_id % 5 WHEN 3 THEN 'WWW Download' WHEN 4 THEN 'WWW Upload' ELSE 'WWW Visit' END",
}
FILENAME = "CASE WHEN event_id % 31 <> 0 THEN concat('f', event_id % 97) END"
RECIPIENT = (
    "CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN concat('u', event_id % 53, '@dtaa.com') "
    "WHEN 2 THEN 'x@dtaaxcom.org' WHEN 3 THEN concat('a', event_id % 41, '@mail.example;b@dtaa.com') "
    "ELSE concat('p', event_id % 67, '@example.org') END"
)
ATTACHMENT = "CASE WHEN event_id % 3 = 0 THEN 'a.doc' END"
URL = (
    "CASE event_id % 13 WHEN 0 THEN 'https://indeed.com/jobs' WHEN 1 THEN 'http://dropbox.com' "
    "WHEN 2 THEN ' HTTPS://www.wikileaks.org/Leak ' "
    "WHEN 3 THEN concat('http://cdn.example.net:8080/?q=', repeat('x', CAST(event_id % 90 AS INT))) "
    "WHEN 4 THEN NULL WHEN 5 THEN 'www.linkedin.com?x=1' WHEN 6 THEN 'https://linkedin.com/in' ELSE page_url END"
)


def activity_log(spark: SparkSession, sf_dir: str, channel: str) -> DataFrame:
    """One normalised activity log."""
    log = _events(spark, sf_dir, channel)
    base = ["event_id", "user", "pc", "timestamp", "day"]
    if channel == "email":
        return log.select(
            *base, F.expr(RECIPIENT).alias("to"), F.expr(ATTACHMENT).alias("attachments")
        )
    log = log.withColumn("activity", F.expr(ACTIVITY[channel]))
    if channel == "file":
        return log.select(*base, "activity", F.expr(FILENAME).alias("filename"))
    if channel == "http":
        pages = table(spark, sf_dir, "pages")
        count = pages.agg(F.max("page_id") + 1).scalar()
        urls = pages.select(F.col("page_id").alias("_page"), F.col("url").alias("page_url"))
        return (
            log.withColumn("_page", F.col("event_id") % count)
            .join(urls, "_page", "left")
            .select(*base, "activity", F.expr(URL).alias("url"))
        )
    return log.select(*base, "activity")


def activity_logs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {channel: activity_log(spark, sf_dir, channel) for channel in EVENT_CHANNELS}


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logon events as text, with stray case and spaces and some unreadable dates."""
    return _events(spark, sf_dir, "logon").select(
        F.expr(
            "CASE WHEN event_id % 11 = 0 THEN 'not a date' "
            "WHEN event_id % 11 = 1 THEN date_format(timestamp, 'M/d/yyyy HH:mm:ss') "
            "ELSE date_format(timestamp, 'MM/dd/yyyy HH:mm:ss') END"
        ).alias(" Date "),
        F.expr("CASE WHEN event_id % 3 = 0 THEN concat('  ', upper(user), ' ') ELSE user END").alias("USER"),
        F.expr("CASE WHEN event_id % 4 = 0 THEN concat(upper(pc), '  ') ELSE pc END").alias("Pc"),
        F.expr(ACTIVITY["logon"]).alias("activity"),
        F.col("event_id").alias("id"),
        F.col("event_id").alias("source_row"),
    )


def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two monthly directory snapshots, as read from the snapshot files; low balances have left by the second."""
    people = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    both = people.select("*", F.explode(F.array(F.lit("2024-01"), F.lit("2024-02"))).alias("month"))
    return both.where("month = '2024-01' OR c_acctbal >= 2000").selectExpr(
        "concat(' U', c_custkey, ' ') AS user_id",
        "CASE WHEN c_custkey % 17 <> 0 THEN c_name END AS employee_name",
        "CASE WHEN month = '2024-02' AND c_custkey % 9 = 0 THEN NULL WHEN c_mktsegment = 'BUILDING' THEN 'Manager' "
        "WHEN c_mktsegment = 'AUTOMOBILE' THEN 'Director' WHEN c_mktsegment = 'MACHINERY' THEN 'Engineer' "
        "WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Salesman' ELSE 'Florist' END AS role",
        "CASE c_nationkey % 5 WHEN 0 THEN '1 - Accounting' WHEN 1 THEN ' 2 - Payroll ' ELSE n_name END AS department",
        "concat('T', c_nationkey % 7) AS team",
        "concat('FU', c_nationkey % 4) AS functional_unit",
        "CASE WHEN month = '2024-02' AND c_custkey % 8 = 3 THEN NULL WHEN c_custkey % 6 = 0 THEN NULL "
        "WHEN c_custkey % 6 = 1 THEN 'None' ELSE concat(' U', c_custkey % 40, ' ') END AS supervisor",
        "to_date(concat(month, '-01')) AS snapshot",
    )


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain counts per user and day; ``cents`` is the exact integer total of the event values."""
    events = table(spark, sf_dir, "events").withColumn("user", F.expr("concat('u', user_id)"))
    return events.groupBy("user", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("event_type") == kind).alias(f"n_{name}") for name, kind in EVENT_CHANNELS.items()],
        F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"),
    )


def labelled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth: from two days before to three days after every very large event value; windows may overlap."""
    events = table(spark, sf_dir, "events").where("value >= 280")
    return events.selectExpr(
        "concat('u', user_id) AS user",
        "date_sub(to_date(ts), 2) AS start_day",
        "date_add(to_date(ts), 3) AS end_day",
        "hour(ts) % 3 + 1 AS scenario",
    )


def scored_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User-days with two deterministic score signals and a history gate."""
    return user_days(spark, sf_dir).selectExpr(
        "user",
        "day",
        "n",
        "cents",
        "n_logon", "n_file", "n_device", "n_email", "n_http",
        "(cents * 37 % 10007 + n_device * 400) / 100.0D AS total_reconstruction_error",
        "(cents * 7 + n * 211) % 997 / 997.0D AS if_anomaly_score",
    )
