"""Queries over machine-days, user-days, baselines, peers and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from daywatch import fixed
from daywatch.operators import baselines as bl
from daywatch.operators import channels as ch
from daywatch.operators import layers, machines, profiles
from daywatch.plans import build
from daywatch.plans.catalog.channel_queries import (
    SCHEDULE_DAYS,
    all_events,
    daily_sql,
    feature_names,
    rounded,
)
from daywatch.plans.catalog.registry import query
from daywatch.plans.catalog.sql_views import view, with_views
from daywatch.sources import sample_views as sv
from daywatch.sources import sinks

# Shorter windows than the defaults, so that 30 days of sample data exercise them.
WINDOWS = bl.BaselineWindows(delta=5, z=14, z_min=7, z_long=20, z_long_min=10, short_sum=7, long_sum=10)
SETTINGS = build.BuildSettings(schedule_min_days=SCHEDULE_DAYS, machine_min_history=3, windows=WINDOWS)
COUNTS = ["n_logon", "n_file", "n_device", "n_email", "n_http"]


def machine_history_sql(source: str, keep: list[str], min_history: int) -> str:
    return f"""SELECT "user", pc, day, {', '.join(keep)}{',' if keep else ''}
  used AS pc_prior_use_count, CAST(used > 0 AS INT) AS pc_seen_before,
  CASE WHEN before > 0 THEN used / before ELSE 0.0::DOUBLE END AS pc_prior_use_ratio,
  CAST(pc = primary_pc AS INT) AS pc_is_primary,
  CAST(sum(CAST(used = 0 AS INT)) OVER (PARTITION BY "user" ORDER BY day, pc ROWS UNBOUNDED PRECEDING) - CAST(used = 0 AS INT) AS BIGINT) AS distinct_pcs_used_prior,
  count(*) OVER (PARTITION BY "user", day) AS n_pcs_used_today,
  CAST(used = 0 AND before >= {min_history} AS INT) AS new_pc_after_stable_history
FROM (SELECT *, row_number() OVER (PARTITION BY "user", pc ORDER BY day) - 1 AS used,
    row_number() OVER (PARTITION BY "user" ORDER BY day, pc) - 1 AS before FROM {source})
  JOIN (SELECT "user", pc AS primary_pc FROM (SELECT "user", pc, row_number() OVER (PARTITION BY "user" ORDER BY count(*) DESC, pc) AS r
    FROM {source} GROUP BY "user", pc) WHERE r = 1) USING ("user")"""


view("ev_days", """SELECT "user", pc, day, count(*) AS n FROM ev GROUP BY "user", pc, day""")

_channel_features = [name for channel in ch.CHANNELS for name in feature_names(channel)]
view(
    "aligned",
    'SELECT "user", pc, day, '
    + ", ".join(f"CAST(trunc(coalesce({n}, 0)) AS INT) AS {n}" for n in _channel_features)
    + " FROM "
    + " FULL JOIN ".join(
        f"({daily_sql(c)})" + (' USING ("user", pc, day)' if i else "") for i, c in enumerate(ch.CHANNELS)
    ),
)
view("machine_day", machine_history_sql("aligned", _channel_features, SETTINGS.machine_min_history))
_distinct_sql = """SELECT "user", day, CAST(sum(f) AS BIGINT) AS unique_files_accessed, CAST(sum(r) AS BIGINT) AS unique_recipients, CAST(sum(d) AS BIGINT) AS unique_domains_visited FROM (
  SELECT "user", day, count(DISTINCT filename) AS f, 0 AS r, 0 AS d FROM file_log GROUP BY ALL
  UNION ALL SELECT "user", day, 0, count(DISTINCT "to"), 0 FROM email_log GROUP BY "user", day
  UNION ALL SELECT "user", day, 0, 0, count(DISTINCT host) FROM http_log GROUP BY "user", day) GROUP BY "user", day"""
view(
    "collapsed",
    'SELECT c.*, ' + ", ".join(f"coalesce(d.{n}, 0) AS {n}" for n in fixed.DISTINCT_FEATURES)
    + ' FROM (SELECT "user", day, '
    + ", ".join(
        [f"CAST(sum({n}) AS BIGINT) AS {n}" for n in fixed.SUM_FEATURES]
        + [f"max({n}) AS {n}" for n in fixed.MAX_FEATURES]
        + ["avg(pc_prior_use_ratio) AS pc_prior_use_ratio", "avg(pc_is_primary) AS primary_pc_activity_ratio"]
        + ["max(distinct_pcs_used_prior) AS distinct_pcs_used_prior", "count(*) AS pcs_used_count"]
        + ["CAST(sum(CAST(pc_is_primary = 0 AS INT)) AS BIGINT) AS non_primary_pc_used_flag"]
        + [
            f"CAST(sum(CASE WHEN pc_is_primary = 0 THEN {src} ELSE 0 END) AS BIGINT) AS {name}"
            for src, name in (
                ("http_total_requests", "non_primary_pc_http_requests_flag"),
                ("usb_insert_count", "non_primary_pc_usb_flag"),
                ("file_copy_count", "non_primary_pc_file_copy_flag"),
            )
        ]
    )
    + f' FROM machine_day GROUP BY "user", day) c LEFT JOIN ({_distinct_sql}) d USING ("user", day)',
)


def z_sql(x: str, window: str, minimum: int) -> str:
    return (
        f"CASE WHEN count({x}) OVER {window} >= {minimum} AND stddev_samp({x}) OVER {window} > 1e-9 "
        f"THEN greatest(-10.0, least(10.0, ({x} - avg({x}) OVER {window}) / stddev_samp({x}) OVER {window})) ELSE 0.0 END"
    )


def baseline_columns_sql(feature: str, w: bl.BaselineWindows) -> list[str]:
    x = f"CAST({feature} AS DOUBLE)"
    return [
        f"sum({x}) OVER short_w AS {feature}_7d_sum",
        f"sum({x}) OVER long_w AS {feature}_30d_sum",
        f"CASE WHEN sum({x}) OVER long_w IS NOT NULL THEN greatest(0.0, least(50.0, {x} / (sum({x}) OVER long_w / {w.long_sum} + 0.5))) END AS {feature}_1d_over_30d_ratio",
        f"{z_sql(x, 'z_w', w.z_min)} AS {feature}_zscore",
        f"{z_sql(x, 'zl_w', w.z_long_min)} AS {feature}_zscore_90d",
        f"coalesce({x} - avg({x}) OVER delta_w, 0.0) AS {feature}_rolling_delta",
    ]


def baseline_windows_sql(w: bl.BaselineWindows) -> str:
    def rows(name: str, depth: int) -> str:
        return f'{name} AS (PARTITION BY "user" ORDER BY day ROWS BETWEEN {depth} PRECEDING AND 1 PRECEDING)'

    return "WINDOW " + ", ".join(
        [rows("short_w", w.short_sum), rows("long_w", w.long_sum), rows("z_w", w.z), rows("zl_w", w.z_long), rows("delta_w", w.delta)]
    )


def baseline_names(feature: str) -> list[str]:
    return [f"{feature}_{s}" for s in ("7d_sum", "30d_sum", "1d_over_30d_ratio", "zscore", "zscore_90d", "rolling_delta")]


view(
    "profile",
    """SELECT "user", arg_max(employee_name, snapshot) FILTER (employee_name IS NOT NULL) AS employee_name,
  arg_max(role, snapshot) FILTER (role IS NOT NULL) AS role, arg_max(department, snapshot) FILTER (department IS NOT NULL) AS department,
  arg_max(functional_unit, snapshot) FILTER (functional_unit IS NOT NULL) AS functional_unit,
  arg_max(supervisor, snapshot) FILTER (supervisor IS NOT NULL) AS supervisor,
  max(snapshot) = (SELECT max(snapshot) FROM directory_clean) AS is_active FROM directory_clean GROUP BY "user" """,
)
view(
    "weight",
    "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in fixed.ROLE_SENSITIVITY.items()) + ") t(role, weight)",
)
view(
    "weighted_profile",
    """SELECT profile.*, coalesce(CASE WHEN department IN ('1 - Accounting', '2 - Payroll', '3 - FinancialPlanning', '2 - Pricing') THEN
  CASE WHEN weight IS NOT NULL THEN greatest(weight, 0.7::DOUBLE) END ELSE weight END, 0.5::DOUBLE) AS role_sensitivity FROM profile LEFT JOIN weight USING (role)""",
)
view("peer_of", """SELECT "user", arg_max(coalesce(role, 'Unknown'), snapshot) AS role FROM directory_clean GROUP BY "user" """)


def peer_z_sql(x: str) -> str:
    """Leave-one-out z-score over the window ``peer_w`` (peer group and day)."""
    n, s, q = f"(count({x}) OVER peer_w - 1)", f"(sum({x}) OVER peer_w - {x})", f"(sum({x} * {x}) OVER peer_w - {x} * {x})"
    var = f"(({q} - {s} * {s} / {n}) / ({n} - 1))"
    return (
        f"CASE WHEN {n} > 1 THEN CASE WHEN {var} > 1e-9 THEN greatest(-10.0, least(10.0, ({x} - {s} / {n}) / sqrt({var}))) ELSE 0.0 END ELSE 0.0 END"
    )


FLAG_SQL = {
    "off_hours_activity_flag": "off_hours_logon + off_hours_files_accessed + off_hours_usb_usage + off_hours_emails + off_hours_http_requests > 0",
    "usb_file_activity_flag": "usb_insert_count > 0 AND file_write_count > 0",
    "external_comm_activity_flag": "external_emails_sent > 0",
    "jobsite_usb_activity_flag": "http_jobsite_visits > 0 AND usb_insert_count > 0",
    "suspicious_upload_flag": "http_jobsite_visits > 0 AND http_upload_count > 0",
    "cloud_upload_flag": "http_upload_count > 0 AND http_cloud_storage_visits > 0",
    "non_primary_pc_risk_flag": "non_primary_pc_http_requests_flag > 0 OR non_primary_pc_usb_flag > 0 OR non_primary_pc_file_copy_flag > 0",
}


def machine_days_of(spark, sf_dir):
    activity = build.activity(spark, sv.activity_logs(spark, sf_dir), SETTINGS)
    return build.machine_day_table(spark, activity, SETTINGS)


def collapsed_of(spark, sf_dir):
    activity = build.activity(spark, sv.activity_logs(spark, sf_dir), SETTINGS)
    distinct = ch.distinct_counts(ch.items_of(activity), ["user", "day"])
    return layers.collapse_to_user_days(build.machine_day_table(spark, activity, SETTINGS), distinct)


# --- machines and layers ------------------------------------------------------------

_history = "pc_prior_use_count pc_seen_before pc_prior_use_ratio pc_is_primary distinct_pcs_used_prior n_pcs_used_today new_pc_after_stable_history".split()


def _round_sql(names: list[str], doubles: set[str]) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" if n in doubles else n for n in names)


@query(
    "machine_history",
    with_views(
        f"""SELECT "user", pc, day, {_round_sql(_history, {'pc_prior_use_ratio'})} FROM ({machine_history_sql('ev_days', ['n'], 3)})"""
    ),
)
def machine_history(spark, sf_dir):
    days = sv._events(spark, sf_dir).groupBy("user", "pc", "day").agg(F.count(F.lit(1)).alias("n"))
    return rounded(machines.machine_history(days, min_history=3).drop("n"))


@query(
    "primary_machine",
    with_views(
        """SELECT "user", pc AS primary_pc FROM (SELECT "user", pc, row_number() OVER (PARTITION BY "user" ORDER BY count(*) DESC, pc) AS r
FROM ev_days GROUP BY "user", pc) WHERE r = 1"""
    ),
)
def primary_machine(spark, sf_dir):
    return machines.primary_machine(sv._events(spark, sf_dir).select("user", "pc", "day").distinct())


@query(
    "machine_day_table",
    with_views(f"""SELECT "user", pc, day, {_round_sql(_channel_features + _history, {'pc_prior_use_ratio'})} FROM machine_day"""),
)
def machine_day_table(spark, sf_dir):
    return rounded(machine_days_of(spark, sf_dir))


_collapsed = [
    *fixed.SUM_FEATURES, *fixed.MAX_FEATURES, "pc_prior_use_ratio", "primary_pc_activity_ratio",
    *fixed.CONTEXT_MAX_FEATURES, *fixed.CROSS_MACHINE_FEATURES, *fixed.DISTINCT_FEATURES,
]
_ratios = {"pc_prior_use_ratio", "primary_pc_activity_ratio"}


@query("collapse_to_user_days", with_views(f"""SELECT "user", day, {_round_sql(_collapsed, _ratios)} FROM collapsed"""))
def collapse_to_user_days(spark, sf_dir):
    return rounded(collapsed_of(spark, sf_dir))


@query(
    "cross_channel_flags",
    with_views(
        """SELECT "user", day, """ + ", ".join(f"CAST({rule} AS INT) AS {name}" for name, rule in FLAG_SQL.items()) + " FROM collapsed"
    ),
)
def cross_channel_flags(spark, sf_dir):
    return layers.cross_channel_flags(collapsed_of(spark, sf_dir)).select("user", "day", *FLAG_SQL)


# --- baselines ------------------------------------------------------------------------


def _baseline_query(name: str, suffixes: list[str], gate: bool = False) -> None:
    columns = [c for f in COUNTS for c in baseline_names(f) if c.removeprefix(f + "_") in suffixes]
    inner = ", ".join(c for f in COUNTS for c in baseline_columns_sql(f, WINDOWS))
    gate_sql = f""", row_number() OVER (PARTITION BY "user" ORDER BY day) > {WINDOWS.z_min} AS baseline_complete"""
    sql = f"""SELECT "user", day, {_round_sql(columns, set(columns))}{', baseline_complete' if gate else ''}
FROM (SELECT "user", day, {inner}{gate_sql} FROM user_day {baseline_windows_sql(WINDOWS)})"""

    @query(name, with_views(sql))
    def run(spark, sf_dir):
        table = bl.user_baselines(sv.user_days(spark, sf_dir), COUNTS, WINDOWS)
        return rounded(table.select("user", "day", *columns, *(["baseline_complete"] if gate else [])))


_baseline_query("causal_zscore", ["zscore"], gate=True)
_baseline_query("long_zscore", ["zscore_90d"])
_baseline_query("rolling_delta", ["rolling_delta"])
_baseline_query("multi_horizon_sums", ["7d_sum", "30d_sum", "1d_over_30d_ratio"])

_peer_counts = {f: f"CAST({f} AS DOUBLE)" for f in COUNTS}


@query(
    "peer_zscore",
    with_views(
        f"""SELECT "user", day, {', '.join(f'round({f}_peer_zscore, 6) + 0.0 AS {f}_peer_zscore' for f in COUNTS)} FROM (
SELECT "user", day, {', '.join(f'{peer_z_sql(x)} AS {f}_peer_zscore' for f, x in _peer_counts.items())}
FROM (SELECT u.*, coalesce(p.role, 'Unknown') AS peer FROM user_day u LEFT JOIN peer_of p USING ("user"))
WINDOW peer_w AS (PARTITION BY peer, day))"""
    ),
)
def peer_zscore(spark, sf_dir):
    peers = profiles.peer_assignment(profiles.clean_directory(sv.directory(spark, sf_dir)))
    table = bl.peer_zscores(sv.user_days(spark, sf_dir), COUNTS, peers)
    return rounded(table.select("user", "day", *[f"{f}_peer_zscore" for f in COUNTS]))


# Scores don't depend on the level of the values: the SQL has them at the level of the counts.
_LEVEL, _BURST = 10_000_000, 2_000_000_000
_burst = f"CASE WHEN row_number() OVER (PARTITION BY \"user\" ORDER BY day) = 1 THEN {_BURST} ELSE n END"


@query(
    "zscore_large_values",
    with_views(
        f"""SELECT "user", day, {', '.join(f'round({z_sql(f"CAST({x} AS DOUBLE)", w, m)}, 3) + 0.0 AS {x}_{name}' for x in ('high', 'burst') for name, w, m in (('zscore', 'z_w', WINDOWS.z_min), ('zscore_90d', 'zl_w', WINDOWS.z_long_min)))}
FROM (SELECT "user", day, n AS high, {_burst} AS burst FROM user_day) {baseline_windows_sql(WINDOWS)}"""
    ),
)
def zscore_large_values(spark, sf_dir):
    """Scores of counts on a high level, and of counts after one very large day."""
    table = sv.user_days(spark, sf_dir).select(
        "user", "day", (F.col("n") + _LEVEL).alias("high"), F.expr(_burst.replace('"', "`")).cast("long").alias("burst")
    )
    names = [f"{x}_{z}" for x in ("high", "burst") for z in ("zscore", "zscore_90d")]
    return rounded(bl.user_baselines(table, ["high", "burst"], WINDOWS).select("user", "day", *names), 3)


#: Columns of one query: level, and what is added to it. Eighths are exact in a double at each level.
_PEER_LEVELS = {
    **{f"high_e{e}": (10**e, "n / 8.0") for e in (2, 5, 7, 9, 11)},
    **{f"coarse_e{e}": (10**e, "floor(n / 4.0) * 0.125") for e in (2, 5, 7, 9, 11)},
}


def _peer_levels_sql() -> str:
    plain = {f: f"CAST({x} AS DOUBLE)" for f, (_, x) in _PEER_LEVELS.items()} | {"exact": "CAST(n AS DOUBLE)"}
    scores = ", ".join(f"round({peer_z_sql(x)}, 3) + 0.0 AS {f}_peer_zscore" for f, x in plain.items())
    return f"""SELECT "user", day, {scores}
FROM (SELECT u.*, coalesce(p.role, 'Unknown') AS peer FROM user_day u LEFT JOIN peer_of p USING ("user"))
WINDOW peer_w AS (PARTITION BY peer, day)"""


@query("peer_zscore_large_values", with_views(_peer_levels_sql()))
def peer_zscore_large_values(spark, sf_dir):
    """Peer scores of counts on high levels, as doubles with many and with few distinct values, and as whole numbers."""
    peers = profiles.peer_assignment(profiles.clean_directory(sv.directory(spark, sf_dir)))
    table = sv.user_days(spark, sf_dir).select(
        "user", "day",
        *[(F.lit(float(level)) + F.expr(x).cast("double")).alias(f) for f, (level, x) in _PEER_LEVELS.items()],
        (F.col("n") + _LEVEL * _LEVEL // 1000).alias("exact"),
    )
    features = [*_PEER_LEVELS, "exact"]
    scored = bl.peer_zscores(table, features, peers)
    return rounded(scored.select("user", "day", *[f"{f}_peer_zscore" for f in features]), 3)


@query(
    "unusual_user_days",
    with_views(
        f"""SELECT "user", day, n, round(entropy_z, 6) + 0.0 AS entropy_z, round(n_z, 6) + 0.0 AS n_z FROM (
  SELECT "user", day, n, {z_sql('entropy', 'w', 14)} AS entropy_z, {z_sql('CAST(n AS DOUBLE)', 'w', 14)} AS n_z FROM (
    SELECT "user", day, round(-sum(c / total * ln(c / total + 1e-10)), 6) + 0.0 AS entropy, CAST(sum(c) AS BIGINT) AS n FROM (
      SELECT "user", day, hour, count(*) AS c, sum(count(*)) OVER (PARTITION BY "user", day) AS total FROM ev GROUP BY "user", day, hour)
    GROUP BY "user", day)
  WINDOW w AS (PARTITION BY "user" ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
ORDER BY round(n_z, 6) DESC, "user", day LIMIT 10"""
    ),
)
def unusual_user_days(spark, sf_dir):
    """The ten user-days whose activity volume departs most from the user's own past."""
    slots = ch.time_slots(all_events(spark, sf_dir), ["user", "day"])
    measured = ch.hour_and_run_measures(slots, ["user", "day"])
    daily = measured.groupBy("user", "day").agg(
        F.round(F.sum("entropy_part"), 6).alias("entropy"), F.sum("n").alias("n")
    )
    scored = bl.user_baselines(daily, ["entropy", "n"])
    return rounded(
        scored.select("user", "day", "n", F.col("entropy_zscore").alias("entropy_z"), F.col("n_zscore").alias("n_z"))
    ).orderBy(F.desc("n_z"), "user", "day").limit(10)


_derived = [c for f in fixed.BASE_FEATURES for c in baseline_names(f)]
_peer_z = [f"{f}_peer_zscore" for f in fixed.BASE_FEATURES]
_profile_cols = ["employee_name", "department", "role", "supervisor", "functional_unit", "is_active", "role_sensitivity"]


@query(
    "user_day_table",
    with_views(
        f"""WITH stats AS (SELECT c.*, coalesce(p.role, 'Unknown') AS peer, {', '.join(c for f in fixed.BASE_FEATURES for c in baseline_columns_sql(f, WINDOWS))},
    row_number() OVER (PARTITION BY c."user" ORDER BY day) > {WINDOWS.z_min} AS baseline_complete
  FROM collapsed c LEFT JOIN peer_of p USING ("user") {baseline_windows_sql(WINDOWS)}),
peered AS (SELECT *, {', '.join(f"{peer_z_sql(f'CAST({f} AS DOUBLE)')} AS {f}_peer_zscore" for f in fixed.BASE_FEATURES)} FROM stats
  WINDOW peer_w AS (PARTITION BY peer, day))
SELECT "user", day, {_round_sql(_collapsed, _ratios)}, {_round_sql(_derived + _peer_z, set(_derived + _peer_z))}, baseline_complete,
  {', '.join(f'CAST({rule} AS INT) AS {name}' for name, rule in FLAG_SQL.items())},
  coalesce(employee_name, "user") AS employee_name, coalesce(department, 'Unknown') AS department, coalesce(role, 'Unknown') AS role, supervisor,
  coalesce(functional_unit, 'Unknown') AS functional_unit, coalesce(is_active, false) AS is_active, coalesce(role_sensitivity, 0.5::DOUBLE) AS role_sensitivity
FROM peered LEFT JOIN weighted_profile USING ("user")"""
    ),
)
def user_day_table(spark, sf_dir):
    """The whole 414-column user-day table from raw logs."""
    directory = profiles.clean_directory(sv.directory(spark, sf_dir))
    collapsed = sinks.stored(spark, collapsed_of(spark, sf_dir), "collapsed")
    table = build.enriched_user_days(collapsed, directory, SETTINGS)
    return rounded(table)


# --- profiles ---------------------------------------------------------------------------


@query("directory_snapshots", with_views("SELECT * FROM directory_clean"))
def directory_snapshots(spark, sf_dir):
    return profiles.clean_directory(sv.directory(spark, sf_dir))


def profiles_of(spark, sf_dir):
    return profiles.latest_profiles(profiles.clean_directory(sv.directory(spark, sf_dir)))


@query("latest_profiles", with_views("SELECT * FROM profile"))
def latest_profiles(spark, sf_dir):
    return profiles_of(spark, sf_dir)


@query("peer_assignment", with_views("SELECT * FROM peer_of"))
def peer_assignment(spark, sf_dir):
    return profiles.peer_assignment(profiles.clean_directory(sv.directory(spark, sf_dir)))


@query(
    "role_sensitivity",
    with_views(
        """SELECT "user", role, department, role_sensitivity, CASE WHEN role_sensitivity >= 0.85 THEN 'CRITICAL' WHEN role_sensitivity >= 0.7 THEN 'HIGH'
WHEN role_sensitivity >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS sensitivity_band FROM weighted_profile"""
    ),
)
def role_sensitivity(spark, sf_dir):
    weight = profiles.role_sensitivity(F.col("role"), F.col("department"))
    return profiles_of(spark, sf_dir).select(
        "user", "role", "department", weight.alias("role_sensitivity"),
        profiles.sensitivity_band(weight).alias("sensitivity_band"),
    )


@query(
    "profile_join",
    with_views(
        """SELECT "user", day, coalesce(employee_name, "user") AS employee_name, coalesce(department, 'Unknown') AS department, coalesce(role, 'Unknown') AS role,
  supervisor, coalesce(functional_unit, 'Unknown') AS functional_unit, coalesce(is_active, false) AS is_active, coalesce(role_sensitivity, 0.5::DOUBLE) AS role_sensitivity
FROM user_day LEFT JOIN (SELECT * FROM weighted_profile WHERE "user" NOT LIKE '%7') USING ("user")"""
    ),
)
def profile_join(spark, sf_dir):
    """Users whose name ends in 7 are not in this directory and get the defaults."""
    listed = profiles_of(spark, sf_dir).where("user NOT LIKE '%7'")
    return profiles.with_profiles(sv.user_days(spark, sf_dir).select("user", "day"), listed)


@query(
    "supervisor_names",
    with_views(
        """SELECT p."user", p.supervisor, coalesce(s.employee_name, p.supervisor) AS supervisor_name
FROM profile p LEFT JOIN profile s ON p.supervisor = s."user" """
    ),
)
def supervisor_names(spark, sf_dir):
    return profiles.supervisor_names(profiles_of(spark, sf_dir))


@query(
    "peer_baselines",
    with_views(
        f"""SELECT coalesce(department, 'Unknown') AS department, day, {', '.join(f'round(avg({c}), 6) + 0.0 AS {c}' for c in COUNTS)}
FROM user_day LEFT JOIN profile USING ("user") GROUP BY 1, 2"""
    ),
)
def peer_baselines(spark, sf_dir):
    table = profiles.with_profiles(sv.user_days(spark, sf_dir), profiles_of(spark, sf_dir))
    return rounded(layers.peer_baselines(table, COUNTS))
