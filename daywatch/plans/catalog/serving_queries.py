"""Queries behind the analyst views, the triage state and the live table."""

from __future__ import annotations

from pyspark.sql import functions as F

from daywatch.functions import bands, cleaning
from daywatch.operators import layers, live, profiles, serving, triage
from daywatch.operators.ranking import row_numbers
from daywatch.plans.catalog.channel_queries import rounded
from daywatch.plans.catalog.registry import query
from daywatch.plans.catalog.risk_queries import alert_rows, band_sql, r6
from daywatch.plans.catalog.sql_views import view, with_views
from daywatch.sources import logs as log_sources
from daywatch.sources import sample_views as sv
from daywatch.session import scratch_path
from daywatch.sources import sinks, versions

FIRST, LAST, RISK, USER = "2024-01-05", "2024-01-25", ["MEDIUM", "HIGH", "CRITICAL"], "u3"
FEATURES = {
    "logon_count": "n_logon", "file_copy_count": "n_file", "usb_insert_count": "n_device",
    "emails_sent": "n_email", "http_upload_count": "n_http", "pcs_used_count": "n",
}
CHANNEL_OF = {
    "Authentication": "logon_count", "File Access": "file_copy_count", "Removable Media": "usb_insert_count",
    "Email": "emails_sent", "HTTP Activity": "http_upload_count", "PC Activity": "pcs_used_count",
}
FLAGS = {
    "usb_file_activity_flag": "CAST(n_device > 0 AND n_file > 0 AS INT)",
    "cloud_upload_flag": "CAST(n_http > 1 AS INT)",
}

view(
    "serving",
    f"""SELECT s."user", day, {', '.join(f'{src} AS {f}' for f, src in FEATURES.items())}, {', '.join(f'{e} AS {f}' for f, e in FLAGS.items())},
  if_anomaly_score, ae_percentile_rank, {band_sql('ae_percentile_rank')} AS ae_risk_band, coalesce(department, 'Unknown') AS department, CASE WHEN cents % 17 = 0 THEN 'suppressed' END AS status
FROM (SELECT *, CAST(cents * 37 % 10007 AS DOUBLE) / 100.07::DOUBLE AS ae_percentile_rank FROM scored) s LEFT JOIN profile p ON p."user" = s."user" """,
)
RISK_SQL = "ae_risk_band IN ('MEDIUM', 'HIGH', 'CRITICAL')"
view("sliced", f"SELECT * FROM serving WHERE {RISK_SQL} AND day BETWEEN '{FIRST}' AND '{LAST}'")
view(
    "peer_base",
    f"""SELECT department, day, {', '.join(f'avg({f}) AS {f}' for f in FEATURES)} FROM serving GROUP BY department, day""",
)
STATUS_SQL = "CASE n_file % 4 WHEN 0 THEN 'INVESTIGATING' WHEN 1 THEN 'RESOLVED' WHEN 2 THEN 'DISMISSED' ELSE 'NEW' END"
view(
    "disposition_log",
    f"""SELECT "user", day, {STATUS_SQL} AS status, concat('note ', cents % 7) AS note, CAST(day + CAST(cents % 5 AS INT) AS TIMESTAMP) AS "timestamp" FROM scored WHERE if_anomaly_score < 0.33
UNION ALL SELECT "user", day, 'RESOLVED', 'closed', CAST(day + 9 AS TIMESTAMP) FROM scored WHERE if_anomaly_score < 0.16""",
)
view("latest_status", """SELECT "user", day, status, note, "timestamp" FROM (SELECT *, row_number() OVER (PARTITION BY "user", day ORDER BY "timestamp" DESC) AS r FROM disposition_log) WHERE r = 1""")


def serving_of(spark, sf_dir):
    people = profiles.latest_profiles(profiles.clean_directory(sv.directory(spark, sf_dir))).select("user", "department")
    rows = sv.scored_days(spark, sf_dir).withColumn("ae_percentile_rank", F.expr("(cents * 37 % 10007) / 100.07D"))
    return rows.join(people, "user", "left").select(
        "user", "day",
        *[F.col(src).alias(f) for f, src in FEATURES.items()],
        *[F.expr(e).alias(f) for f, e in FLAGS.items()],
        "if_anomaly_score", "ae_percentile_rank",
        bands.band_of_percentile(F.col("ae_percentile_rank")).alias("ae_risk_band"),
        F.coalesce("department", F.lit("Unknown")).alias("department"),
        F.expr("CASE WHEN cents % 17 = 0 THEN 'suppressed' END").alias("status"),
    )


def sliced_of(spark, sf_dir):
    return serving.filtered_slice(serving_of(spark, sf_dir), FIRST, LAST, RISK)


def peer_base_of(spark, sf_dir):
    return layers.peer_baselines(serving_of(spark, sf_dir), list(FEATURES))


def disposition_log(spark, sf_dir):
    rows = sv.scored_days(spark, sf_dir)
    first = rows.where("if_anomaly_score < 0.33").select(
        "user", "day", F.expr(STATUS_SQL).alias("status"), F.expr("concat('note ', cents % 7)").alias("note"),
        F.expr("CAST(date_add(day, CAST(cents % 5 AS INT)) AS TIMESTAMP_NTZ)").alias("timestamp"),
    )
    later = rows.where("if_anomaly_score < 0.16").select(
        "user", "day", F.lit("RESOLVED").alias("status"), F.lit("closed").alias("note"),
        F.expr("CAST(date_add(day, 9) AS TIMESTAMP_NTZ)").alias("timestamp"),
    )
    return first.unionByName(later)


def _values(pairs: dict[str, str], name: str, value: str, source: str, keys: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {keys}'{k}' AS {name}, {v} AS {value} FROM {source}" for k, v in pairs.items())


def _register(name: str, sql: str, fn) -> None:
    query(name, with_views(sql))(fn)


def positioned(df):
    """Rows with the position they come out in: what an operator's order is held to."""
    return row_numbers(df.withColumn("_at", F.monotonically_increasing_id()), ["_at"], "position").drop("_at")


_register(
    "filtered_slice",
    f"""SELECT "user", day, ae_risk_band, {r6('ae_percentile_rank')} AS ae_percentile_rank FROM sliced""",
    lambda s, d: rounded(sliced_of(s, d).select("user", "day", "ae_risk_band", "ae_percentile_rank")),
)
_register(
    "population_channel_averages",
    _values({c: r6(f"avg({f})") for c, f in CHANNEL_OF.items()}, "channel", "average", "serving"),
    lambda s, d: rounded(serving.channel_averages(serving_of(s, d))),
)
_register(
    "department_channel_averages",
    _values({c: r6(f"avg({f})") for c, f in CHANNEL_OF.items()}, "channel", "average", f"(SELECT * FROM peer_base WHERE upper(department) = '1 - ACCOUNTING' AND day BETWEEN '{FIRST}' AND '{LAST}')"),
    lambda s, d: rounded(serving.peer_channel_averages(peer_base_of(s, d), "1 - accounting", FIRST, LAST)),
)
_register(
    "channel_time_series",
    " UNION ALL ".join(f"SELECT day, '{c}' AS channel, CAST(sum({f}) AS DOUBLE) AS volume FROM sliced GROUP BY day" for c, f in CHANNEL_OF.items()),
    lambda s, d: serving.channel_time_series(sliced_of(s, d)),
)
_register(
    "channel_totals",
    _values({c: f"CAST(sum({f}) AS DOUBLE)" for c, f in CHANNEL_OF.items()}, "channel", "total", "sliced"),
    lambda s, d: serving.channel_totals(sliced_of(s, d)),
)
_register(
    "feature_correlations",
    " UNION ALL ".join(f"SELECT '{a}' AS feature, '{b}' AS other, {r6(f'corr({a}, {b})')} AS correlation FROM sliced" for a in FEATURES for b in FEATURES),
    lambda s, d: rounded(serving.correlations(sliced_of(s, d), list(FEATURES))),
)
_register(
    "overview",
    f"""SELECT count(DISTINCT "user") AS total_users, count(*) AS total_records, count(DISTINCT "user") FILTER (ae_risk_band = 'CRITICAL') AS critical_users,
count(DISTINCT "user") FILTER (ae_risk_band = 'HIGH') AS high_users, count(DISTINCT "user") FILTER (ae_risk_band = 'MEDIUM') AS medium_users, {r6('avg(if_anomaly_score)')} AS avg_anomaly,
{r6(f'count(*) FILTER ({RISK_SQL}) * 100.0::DOUBLE / count(*)')} AS detection_rate FROM serving""",
    lambda s, d: rounded(serving.overview(serving_of(s, d))),
)
_register(
    "band_counts",
    "SELECT ae_risk_band AS risk_level, count(*) AS count FROM sliced GROUP BY 1",
    lambda s, d: serving.band_counts(sliced_of(s, d)),
)
_register(
    "daily_band_counts",
    "SELECT day, ae_risk_band AS risk_level, count(*) AS count FROM sliced GROUP BY 1, 2",
    lambda s, d: serving.daily_band_counts(sliced_of(s, d)),
)


def _histogram_sql(source: str, score: str, band: str, bins: int) -> str:
    return f"""SELECT {band} AS risk_level, CAST(least(floor(({score} - lo) / (hi - lo) * {bins}), {bins - 1}) AS INT) AS bin, count(*) AS count
FROM {source}, (SELECT min({score}) AS lo, max({score}) AS hi FROM {source}) GROUP BY 1, 2"""


_register(
    "score_histogram",
    _histogram_sql("sliced", "if_anomaly_score", "ae_risk_band", 80),
    lambda s, d: serving.score_histogram(sliced_of(s, d)),
)
_register(
    "flag_counts",
    " UNION ALL ".join(f"SELECT '{f}' AS flag, CAST(sum({f}) AS BIGINT) AS count, {r6(f'sum({f}) * 100.0::DOUBLE / count(*)')} AS percent FROM sliced" for f in FLAGS),
    lambda s, d: rounded(serving.flag_counts(sliced_of(s, d))),
)
_register(
    "user_flag_counts",
    " UNION ALL ".join(f"SELECT '{f}' AS flag, CAST(sum({f}) AS BIGINT) AS count, {r6(f'sum({f}) * 100.0::DOUBLE / count(*)')} AS percent FROM (SELECT * FROM serving WHERE \"user\" = '{USER}')" for f in FLAGS),
    lambda s, d: rounded(serving.flag_counts(serving_of(s, d).where(F.col("user") == USER))),
)
_register(
    "top_users",
    f"""SELECT "user", {r6('max(ae_percentile_rank)')} AS max_percentile, count(*) FILTER (ae_risk_band = 'CRITICAL') AS critical_count, count(*) FILTER (ae_risk_band = 'HIGH') AS high_count
FROM sliced GROUP BY "user" ORDER BY max(ae_percentile_rank) DESC, "user" LIMIT 10""",
    lambda s, d: rounded(serving.top_users(sliced_of(s, d))),
)
_register(
    "feature_spread",
    f"""SELECT ae_risk_band AS risk_level, count(*) AS rows, CAST(min(cents_like) AS DOUBLE) AS min, CAST(max(cents_like) AS DOUBLE) AS max, {r6('quantile_cont(cents_like, 0.25)')} AS q1, {r6('quantile_cont(cents_like, 0.5)')} AS median, {r6('quantile_cont(cents_like, 0.75)')} AS q3
FROM (SELECT ae_risk_band, CAST(pcs_used_count AS DOUBLE) * if_anomaly_score AS cents_like FROM sliced) GROUP BY 1""".replace("CAST(min(cents_like) AS DOUBLE)", r6("min(cents_like)")).replace("CAST(max(cents_like) AS DOUBLE)", r6("max(cents_like)")),
    lambda s, d: rounded(
        serving.feature_spread(sliced_of(s, d).withColumn("v", F.col("pcs_used_count") * F.col("if_anomaly_score")), "v")
    ),
)
_register(
    "user_risk_summary",
    f"""SELECT "user", {r6('max(if_anomaly_score)')} AS max_score, {r6('avg(if_anomaly_score)')} AS mean_score, {r6('max(ae_percentile_rank)')} AS max_percentile, count(DISTINCT day) AS alert_days,
count(*) FILTER (ae_risk_band = 'CRITICAL') AS critical_count, count(*) FILTER (ae_risk_band = 'HIGH') AS high_count, count(*) FILTER (ae_risk_band = 'MEDIUM') AS medium_count FROM serving GROUP BY "user" """,
    lambda s, d: rounded(serving.user_risk_summary(serving_of(s, d))),
)
_register(
    "risk_ordered_users",
    f"""SELECT row_number() OVER (ORDER BY p DESC NULLS LAST, "user") AS position, "user", {r6('p')} AS max_percentile FROM
(SELECT DISTINCT "user" FROM serving) LEFT JOIN (SELECT "user", max(ae_percentile_rank) AS p FROM serving WHERE ae_risk_band = 'CRITICAL' GROUP BY "user") USING ("user")""",
    lambda s, d: rounded(
        serving.risk_ordered_users(serving_of(s, d).where("ae_risk_band = 'CRITICAL'"), serving_of(s, d))
    ),
)
_register(
    "disposition_breakdown",
    """SELECT coalesce(l.status, 'NEW') AS status, count(*) AS count FROM sliced s LEFT JOIN latest_status l ON l."user" = s."user" AND l.day = s.day GROUP BY 1""",
    lambda s, d: serving.disposition_breakdown(sliced_of(s, d), disposition_log(s, d)),
)
_feed_order = {
    "highest_score": ("Highest score first", "ae_percentile_rank DESC"),
    "lowest_score": ("Lowest score first", "ae_percentile_rank"),
    "highest_severity": ("Highest severity first", "sev DESC, ae_percentile_rank DESC"),
    "lowest_severity": ("Lowest severity first", "sev, ae_percentile_rank DESC"),
    "most_recent": ("Most recent first", "day DESC"),
    "oldest": ("Oldest first", "day"),
    "user_a_z": ("User A-Z", '"user"'),
    "user_z_a": ("User Z-A", '"user" DESC'),
}
_FEED_SQL = """SELECT s."user", s.day, s.ae_risk_band, s.ae_percentile_rank, coalesce(l.status, 'NEW') AS status,
  CASE ae_risk_band WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 ELSE 3 END AS sev
FROM serving s LEFT JOIN latest_status l ON l."user" = s."user" AND l.day = s.day WHERE s.status IS NULL AND ae_percentile_rank >= 40"""
for _key, (_label, _order) in _feed_order.items():
    _register(
        f"alert_feed_{_key}",
        f"""SELECT "user", day, ae_risk_band, {r6('ae_percentile_rank')} AS ae_percentile_rank, status, row_number() OVER (ORDER BY {_order}, "user", day) AS position
FROM ({_FEED_SQL}) WHERE status = 'NEW' ORDER BY position LIMIT 50""",
        lambda s, d, label=_label: rounded(
            positioned(serving.alert_feed(serving_of(s, d), disposition_log(s, d), 40.0, "NEW", label, 50)).select(
                "user", "day", "ae_risk_band", "ae_percentile_rank", "status", "position"
            )
        ),
    )
_register(
    "alert_feed_suppressed",
    f"""SELECT "user", day, {r6('ae_percentile_rank')} AS ae_percentile_rank, row_number() OVER (ORDER BY ae_percentile_rank DESC, "user", day) AS position
FROM serving WHERE status = 'suppressed' AND ae_percentile_rank >= 40""",
    lambda s, d: rounded(
        positioned(serving.alert_feed(serving_of(s, d), disposition_log(s, d), 40.0, suppressed=True)).select("user", "day", "ae_percentile_rank", "position")
    ),
)
_register(
    "history_page",
    f"""SELECT "user", day, {r6('ae_percentile_rank')} AS ae_percentile_rank, row_number() OVER (ORDER BY ae_percentile_rank DESC, "user", day) - 20 AS position
FROM sliced ORDER BY position LIMIT 10 OFFSET 20""",
    lambda s, d: rounded(
        positioned(serving.page(sliced_of(s, d), [F.desc("ae_percentile_rank"), "user", "day"], 2)).select("user", "day", "ae_percentile_rank", "position")
    ),
)
PAGE_ORDER = [("ae_percentile_rank", True), ("user", False), ("day", False)]


def _sought_page(spark, sf_dir, number):
    """The page of a sorted copy that many pages on, each sought after the last row of the one before."""
    path = serving.write_sorted(sliced_of(spark, sf_dir), PAGE_ORDER, scratch_path(spark, "sorted"), 4)
    rows, last = spark.read.parquet(path), None
    for _ in range(number):
        last = serving.page_after(rows, PAGE_ORDER, last).collect()[-1]  # ten rows
    return serving.page_after(rows, PAGE_ORDER, last)


_register(
    "history_page_sought",
    f"""SELECT "user", day, {r6('ae_percentile_rank')} AS ae_percentile_rank, row_number() OVER (ORDER BY ae_percentile_rank DESC, "user", day) - 20 AS position
FROM sliced ORDER BY position LIMIT 10 OFFSET 20""",
    lambda s, d: rounded(positioned(_sought_page(s, d, 2)).select("user", "day", "ae_percentile_rank", "position")),
)
_register(
    "machine_drill_down",
    f"""SELECT "user", pc, day, n FROM ev_days WHERE "user" = '{USER}' AND day = (SELECT max(day) FROM ev_days WHERE "user" = '{USER}')""",
    lambda s, d: _drill(s, d),
)


def _drill(spark, sf_dir):
    days = sv._events(spark, sf_dir).groupBy("user", "pc", "day").agg(F.count(F.lit(1)).alias("n"))
    last = days.where(F.col("user") == USER).agg(F.max("day").cast("string")).scalar()
    return serving.drill_down(days, USER, last, ["n", "pc"])


_register(
    "contributor_shares",
    """SELECT "user", day, CAST(rn - 1 AS INT) AS position, feature, CASE feature WHEN 'logon_count' THEN 'elevated logon frequency' WHEN 'file_copy_count_zscore' THEN 'unusually high file copy activity'
  WHEN 'usb_insert_count' THEN 'USB device insertion' WHEN 'emails_sent_rolling_delta' THEN 'sudden spike in email volume' ELSE 'cloud storage upload activity' END AS phrase, round(value * 100, 6) + 0.0 AS percent FROM top3""",
    lambda s, d: rounded(serving.contributor_shares(alert_rows(s, d))),
)
_register(
    "alert_detail",
    f"""SELECT explanation, contributors FROM alert_text JOIN (SELECT "user", day, string_agg(printf('%s=%.4f', feature, value), ', ' ORDER BY rn) AS contributors FROM top3 GROUP BY "user", day) USING ("user", day)
WHERE "user" = '{USER}' AND day = (SELECT max(day) FROM alert_rows WHERE "user" = '{USER}')""",
    lambda s, d: _alert_detail(s, d),
)


def _alert_detail(spark, sf_dir):
    rows = alert_rows(spark, sf_dir)
    last = rows.where(F.col("user") == USER).agg(F.max("day").cast("string")).scalar()
    shown = F.transform("top_contributors", lambda c: F.concat(c["feature"], F.lit("="), F.format_string("%.4f", c["value"])))
    return serving.alert_detail(rows, USER, last).select("explanation", F.array_join(shown, ", ").alias("contributors"))


_register(
    "user_radar",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS channel, (SELECT {r6(f'avg({f})')} FROM serving WHERE "user" = '{USER}') AS user_average,
  (SELECT {r6(f'avg({f})')} FROM peer_base, (SELECT min(day) AS a, max(day) AS b, max(department) AS d FROM serving WHERE "user" = '{USER}') u WHERE department = d AND day BETWEEN a AND b) AS peer_average,
  (SELECT {r6(f'avg({f})')} FROM serving) AS population_average""" for c, f in CHANNEL_OF.items()
    ),
    lambda s, d: rounded(serving.user_radar(serving_of(s, d), peer_base_of(s, d), USER)),
)
_register(
    "feature_heat",
    " UNION ALL ".join(f"SELECT day, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM (SELECT * FROM serving WHERE \"user\" = '{USER}' ORDER BY day DESC LIMIT 12)" for f in FEATURES),
    lambda s, d: serving.feature_heat(serving_of(s, d), USER, days=12),
)
_register(
    "user_extent",
    f"""SELECT count(*) AS alerts, min(day) AS first_day, max(day) AS last_day FROM serving WHERE "user" = '{USER}'""",
    lambda s, d: serving.user_extent(serving_of(s, d), USER),
)
_register("bounds", "SELECT min(day) AS first_day, max(day) AS last_day FROM serving", lambda s, d: serving.bounds(serving_of(s, d)))
_register("user_list", """SELECT DISTINCT "user" FROM serving""", lambda s, d: serving.users(serving_of(s, d)))

# --- serving table, wanted columns, one-user read -------------------------------------------

CHECK_SERVING = f"""SELECT s."user", day, CAST(logon_count AS INT) AS logon_count, CAST(emails_sent AS INT) AS emails_sent, department, round(CAST(a.if_anomaly_score AS DOUBLE), 4) + 0.0 AS if_anomaly_score, a.composite_risk_band
FROM serving s LEFT JOIN alert_rows a USING ("user", day)"""
_register(
    "serving_table",
    CHECK_SERVING,
    lambda s, d: sinks.serving_table(
        serving_of(s, d).select("user", "day", "logon_count", "emails_sent", "department"),
        alert_rows(s, d).select("user", "day", "if_anomaly_score", "composite_risk_band"),
    ).withColumn("if_anomaly_score", F.round(F.col("if_anomaly_score").cast("double"), 4)),
)


def _replaced_serving(spark, sf_dir):
    """The serving table published twice; what is read is the second version, whole."""
    root = scratch_path(spark, "serving")
    rows = serving_of(spark, sf_dir).select("user", "day", "logon_count", "emails_sent", "department")
    versions.replace(sinks.serving_table(rows, alert_rows(spark, sf_dir).select("user", "day", "composite_risk_band").limit(0)), root)
    scored = alert_rows(spark, sf_dir).select("user", "day", "if_anomaly_score", "composite_risk_band")
    versions.replace(sinks.serving_table(rows, scored), root)
    return versions.read(spark, root).withColumn("if_anomaly_score", F.round(F.col("if_anomaly_score").cast("double"), 4))


_register("replaced_serving_table", CHECK_SERVING, _replaced_serving)
_register(
    "overview_of_days",
    f"""SELECT count(DISTINCT "user") AS total_users, count(*) AS total_records, count(DISTINCT CASE WHEN ae_risk_band = 'CRITICAL' THEN "user" END) AS critical_users,
  count(DISTINCT CASE WHEN ae_risk_band = 'HIGH' THEN "user" END) AS high_users, count(DISTINCT CASE WHEN ae_risk_band = 'MEDIUM' THEN "user" END) AS medium_users,
  {r6('avg(if_anomaly_score)')} AS avg_anomaly, {r6("count(*) FILTER (ae_risk_band IN ('CRITICAL', 'HIGH', 'MEDIUM')) * 100.0 / greatest(count(*), 1)")} AS detection_rate
FROM serving WHERE day BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'""",
    lambda s, d: rounded(
        serving.overview_of(
            serving.merged_user_bands(
                serving.user_bands(serving_of(s, d), ["day"]).where("day BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'")
            )
        )
    ),
)
_register(
    "narrow_types",
    """SELECT "user", day, CAST(n AS INT) AS n, CAST(cents AS INT) AS cents FROM user_day""",
    lambda s, d: cleaning.narrow_types(sv.user_days(s, d).select("user", "day", "n", "cents")),
)
_register(
    "wanted_columns",
    """SELECT "user", day, n_file FROM user_day""",
    lambda s, d: (lambda t: t.select(*sinks.wanted_present(t, ["user", "day", "n_file", "not_there"])[0]))(sv.user_days(s, d)),
)
_register(
    "one_user_read",
    f"""SELECT day, cents FROM user_day WHERE "user" = '{USER}'""",
    lambda s, d: _one_user(s, d),
)


def _one_user(spark, sf_dir):
    from daywatch.session import scratch_path

    path = sinks.write_by_user(sv.user_days(spark, sf_dir), scratch_path(spark, "by-user"))
    return log_sources.read_user_detail(spark.read.parquet(path), USER, ["day", "cents"])


# --- triage -----------------------------------------------------------------------------------

_register(
    "latest_dispositions",
    """SELECT "user", day, status, note, "timestamp" FROM latest_status""",
    lambda s, d: triage.latest_dispositions(disposition_log(s, d)),
)
_register(
    "disposition_of_alert",
    f"""SELECT "user", day, status, note, "timestamp" FROM latest_status WHERE "user" = '{USER}' AND day = (SELECT max(day) FROM disposition_log WHERE "user" = '{USER}')""",
    lambda s, d: _one_disposition(s, d),
)


def _one_disposition(spark, sf_dir):
    log = disposition_log(spark, sf_dir)
    return triage.disposition_of(log, USER, log.where(F.col("user") == USER).agg(F.max("day").cast("string")).scalar())


_register(
    "dispositions_newest_first",
    """SELECT "user", day, status, note, "timestamp", row_number() OVER (ORDER BY "timestamp" DESC, "user", day) AS position FROM latest_status""",
    lambda s, d: positioned(triage.newest_first(disposition_log(s, d))),
)


def _compacted(spark, sf_dir):
    """The log recorded in pieces, compacted between them, read through its base and tail."""
    root, log = scratch_path(spark, "triage"), disposition_log(spark, sf_dir)
    for part in range(4):
        triage.record(root, log.where(F.col("status") == "RESOLVED" if part == 3 else (F.col("status") != "RESOLVED") & (F.dayofmonth("day") % 3 == part)))
        if part in (1, 2):
            triage.compact(spark, root)
    return triage.latest_dispositions(triage.stored_log(spark, root))


_register("compacted_dispositions", """SELECT "user", day, status, note, "timestamp" FROM latest_status""", _compacted)
_register(
    "alert_status",
    """SELECT s."user", s.day, coalesce(l.status, 'NEW') AS status FROM scored s LEFT JOIN latest_status l ON l."user" = s."user" AND l.day = s.day""",
    lambda s, d: triage.with_status(sv.scored_days(s, d).select("user", "day"), disposition_log(s, d)),
)

# --- live table ---------------------------------------------------------------------------------

view(
    "live_records",
    """SELECT event_id AS event_index, concat('u', user_id) AS "user", CASE WHEN event_id % 50 = 7 THEN 'unknown' ELSE strftime(ts, '%Y-%m-%d') END AS cert_timestamp,
  CAST(event_id * 7919 % 10007 AS DOUBLE) / 10007::DOUBLE AS if_anomaly_score, CASE WHEN event_id % 40 = 3 THEN NULL ELSE CAST(event_id * 7919 % 10007 AS DOUBLE) / 100.07::DOUBLE END AS if_percentile_rank,
  CASE WHEN event_id % 9 = 0 THEN 'high' ELSE 'low' END AS if_risk_band FROM events""",
)


def live_records(spark, sf_dir):
    """Events as scored records, through the JSON text form the stream writes, with the odd broken line."""
    events = sv.table(spark, sf_dir, "events")
    record = F.struct(
        F.col("event_id").alias("event_index"),
        F.expr("concat('u', user_id)").alias("user"),
        F.expr("CASE WHEN event_id % 50 = 7 THEN 'unknown' ELSE date_format(ts, 'yyyy-MM-dd') END").alias("cert_timestamp"),
        F.expr("(event_id * 7919 % 10007) / 10007D").alias("if_anomaly_score"),
        F.expr("CASE WHEN event_id % 40 = 3 THEN NULL ELSE (event_id * 7919 % 10007) / 100.07D END").alias("if_percentile_rank"),
        F.expr("CASE WHEN event_id % 9 = 0 THEN 'high' ELSE 'low' END").alias("if_risk_band"),
    )
    lines = events.select(F.explode(F.when(F.col("event_id") % 30 == 1, F.array(F.to_json(record), F.lit('{"user": "u1", "ev'))).otherwise(F.array(F.to_json(record)))).alias("line"))
    schema = log_sources.LIVE_SCHEMA
    parsed = lines.select(F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return live.valid_records(parsed.select("r.*"))


_register(
    "live_recent_tail",
    f"""SELECT event_index, "user", cert_timestamp, {r6('if_anomaly_score')} AS if_anomaly_score FROM live_records ORDER BY event_index DESC LIMIT 5000""",
    lambda s, d: rounded(live.recent_tail(live_records(s, d)).select("event_index", "user", "cert_timestamp", "if_anomaly_score")),
)
_register(
    "live_worst_of_day",
    f"""SELECT "user", CAST(cert_timestamp AS DATE) AS day, {r6('if_anomaly_score')} AS if_anomaly_score, {r6('if_percentile_rank')} AS ae_percentile_rank, upper(if_risk_band) AS ae_risk_band, true AS live_row
FROM (SELECT *, row_number() OVER (PARTITION BY cert_timestamp ORDER BY if_percentile_rank DESC NULLS LAST, event_index) AS r FROM live_records WHERE "user" = '{USER}' AND cert_timestamp <> 'unknown') WHERE r = 1""",
    lambda s, d: rounded(live.worst_of_day(live_records(s, d), USER)),
)
_register(
    "live_progress",
    "SELECT count(*) AS rows, greatest(max(CAST(CASE WHEN cert_timestamp <> 'unknown' THEN cert_timestamp END AS DATE)), DATE '2024-01-15') AS latest_day FROM live_records",
    lambda s, d: live.progress(live_records(s, d), "2024-01-15"),
)
_register(
    "live_history_merge",
    f"""SELECT "user", day, ae_risk_band FROM serving WHERE "user" = '{USER}' AND ae_risk_band IN ('LOW', 'MEDIUM') UNION ALL
SELECT "user", day, 'LOW' FROM (SELECT "user", CAST(cert_timestamp AS DATE) AS day, if_risk_band, row_number() OVER (PARTITION BY cert_timestamp ORDER BY if_percentile_rank DESC NULLS LAST, event_index) AS r FROM live_records WHERE "user" = '{USER}' AND cert_timestamp <> 'unknown')
WHERE r = 1 AND if_risk_band = 'low' AND day NOT IN (SELECT day FROM serving WHERE "user" = '{USER}' AND ae_risk_band IN ('LOW', 'MEDIUM'))""",
    lambda s, d: live.merge_history(
        serving_of(s, d).where(F.col("user") == USER).select("user", "day", "ae_risk_band"),
        live.worst_of_day(live_records(s, d), USER).select("user", "day", "ae_risk_band"),
        ["LOW", "MEDIUM"],
    ),
)
LIVE_BAND = f"CASE WHEN if_percentile_rank IS NULL THEN 'LOW' ELSE {band_sql('if_percentile_rank')} END"
_register(
    "live_table",
    f"""SELECT "user", event_index, {r6('if_percentile_rank')} AS ui_percentile, {r6('if_anomaly_score')} AS ui_anomaly_score, {r6('if_percentile_rank')} AS ui_composite_score, {LIVE_BAND} AS ui_risk_band,
  row_number() OVER (ORDER BY CASE WHEN cert_timestamp <> 'unknown' THEN cert_timestamp END DESC NULLS LAST, event_index DESC) AS position FROM live_records""",
    lambda s, d: rounded(
        positioned(live.live_table(live_records(s, d))).select("user", "event_index", "ui_percentile", "ui_anomaly_score", "ui_composite_score", "ui_risk_band", "position")
    ),
)
_register(
    "live_band_counts",
    f"SELECT {LIVE_BAND} AS risk_level, count(*) AS count FROM live_records GROUP BY 1",
    lambda s, d: serving.band_counts(live.live_table(live_records(s, d)), "ui_risk_band"),
)
_register(
    "live_histogram",
    _histogram_sql(f"(SELECT *, {LIVE_BAND} AS band FROM live_records)", "if_anomaly_score", "band", 50),
    lambda s, d: serving.score_histogram(live.live_table(live_records(s, d)), "ui_anomaly_score", "ui_risk_band", 50),
)
