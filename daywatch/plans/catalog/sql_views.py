"""SQL twins of ``daywatch.sources.sample_views`` as reusable WITH clauses for the check SQL."""

from __future__ import annotations

import re

from daywatch.sources import sample_views as sv

VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it mentions, in definition order."""
    needed: set[str] = set()

    def collect(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                collect(body)

    collect(sql)
    clauses = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in needed)
    if not clauses:
        return sql
    if sql.lstrip().upper().startswith("WITH "):
        return f"WITH {clauses},\n{sql.lstrip()[5:]}"
    return f"WITH {clauses}\n{sql}"


view(
    "ev",
    """SELECT event_id, user_id, concat('u', user_id) AS "user",
  concat('pc', CASE WHEN (event_id * 7 + user_id) % 10 < 7 THEN user_id % 97 ELSE 100 + event_id % 5 END) AS pc,
  ts AS "timestamp", CAST(ts AS DATE) AS day, CAST(hour(ts) AS INT) AS hour, event_type, value,
  epoch_us(ts) - epoch_us(date_trunc('day', ts)) AS us FROM events""",
)
for _channel in ("logon", "file", "device"):
    _extra = f", {sv.FILENAME} AS filename" if _channel == "file" else ""
    view(
        f"{_channel}_log",
        f"SELECT *, {sv.ACTIVITY[_channel]} AS activity{_extra} FROM ev "
        f"WHERE event_type = '{sv.EVENT_CHANNELS[_channel]}'",
    )
view(
    "email_log",
    f"""SELECT *, {sv.RECIPIENT} AS "to", {sv.ATTACHMENT} AS attachments FROM ev WHERE event_type = 'purchase'""",
)
view(
    "http_log",
    f"""SELECT *, lower(trim(coalesce(url, ''))) AS clean,
  split_part(regexp_replace(lower(trim(coalesce(url, ''))), '^https?://', ''), '/', 1) AS host
FROM (SELECT ev.*, {sv.ACTIVITY['http']} AS activity, {sv.URL} AS url
  FROM ev LEFT JOIN (SELECT page_id AS p, url AS page_url FROM pages) ON p = event_id % (SELECT max(page_id) + 1 FROM pages)
  WHERE event_type = 'view')""",
)
view(
    "directory_raw",
    """SELECT concat(' U', c_custkey, ' ') AS user_id,
  CASE WHEN c_custkey % 17 <> 0 THEN c_name END AS employee_name,
  CASE WHEN month = '2024-02' AND c_custkey % 9 = 0 THEN NULL WHEN c_mktsegment = 'BUILDING' THEN 'Manager'
    WHEN c_mktsegment = 'AUTOMOBILE' THEN 'Director' WHEN c_mktsegment = 'MACHINERY' THEN 'Engineer'
    WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Salesman' ELSE 'Florist' END AS role,
  CASE c_nationkey % 5 WHEN 0 THEN '1 - Accounting' WHEN 1 THEN ' 2 - Payroll ' ELSE n_name END AS department,
  concat('T', c_nationkey % 7) AS team, concat('FU', c_nationkey % 4) AS functional_unit,
  CASE WHEN month = '2024-02' AND c_custkey % 8 = 3 THEN NULL WHEN c_custkey % 6 = 0 THEN NULL
    WHEN c_custkey % 6 = 1 THEN 'None' ELSE concat(' U', c_custkey % 40, ' ') END AS supervisor,
  CAST(concat(month, '-01') AS DATE) AS snapshot
FROM customer JOIN nation ON c_nationkey = n_nationkey, (VALUES ('2024-01'), ('2024-02')) months(month)
WHERE month = '2024-01' OR c_acctbal >= 2000""",
)
view(
    "directory_clean",
    """SELECT lower(trim(user_id)) AS "user", trim(coalesce(employee_name, 'Unknown')) AS employee_name,
  trim(coalesce(role, 'Unknown')) AS role, trim(coalesce(department, 'Unknown')) AS department,
  trim(coalesce(team, 'Unknown')) AS team, trim(coalesce(functional_unit, 'Unknown')) AS functional_unit,
  CASE WHEN lower(trim(supervisor)) IN ('', 'nan', 'none') THEN NULL ELSE lower(trim(supervisor)) END AS supervisor,
  snapshot FROM directory_raw""",
)
view(
    "user_day",
    """SELECT "user", day, count(*) AS n,
  count(*) FILTER (event_type = 'signup') AS n_logon, count(*) FILTER (event_type = 'click') AS n_file,
  count(*) FILTER (event_type = 'error') AS n_device, count(*) FILTER (event_type = 'purchase') AS n_email,
  count(*) FILTER (event_type = 'view') AS n_http,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
FROM ev GROUP BY "user", day""",
)
view(
    "win",
    """SELECT concat('u', user_id) AS "user", CAST(CAST(ts AS DATE) - 2 AS DATE) AS start_day,
  CAST(CAST(ts AS DATE) + 3 AS DATE) AS end_day, CAST(hour(ts) % 3 + 1 AS INT) AS scenario FROM events WHERE value >= 280""",
)
view(
    "scored",
    """SELECT "user", day, n, cents, n_logon, n_file, n_device, n_email, n_http,
  CAST(cents * 37 % 10007 + n_device * 400 AS DOUBLE) / 100.0::DOUBLE AS total_reconstruction_error,
  CAST((cents * 7 + n * 211) % 997 AS DOUBLE) / 997.0::DOUBLE AS if_anomaly_score FROM user_day""",
)
