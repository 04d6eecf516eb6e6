"""Queries for splits, calibration, bands, alerts, cases and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from daywatch import fixed
from daywatch.functions import bands, naming
from daywatch.operators import alerts, evaluate, ranking, splits
from daywatch.plans.catalog.channel_queries import rounded
from daywatch.plans.catalog.registry import query
from daywatch.plans.catalog.sql_views import view, with_views
from daywatch.sources import logs as log_sources
from daywatch.sources import sample_views as sv

R6 = "round({}, 6) + 0.0"


def r6(expr: str) -> str:
    return R6.format(expr)


# --- shared frames and their SQL twins ----------------------------------------------


def gated(spark, sf_dir):
    """Scored rows with a history gate: the user's first seven days are cold start."""
    first = F.min("day").over(Window.partitionBy("user"))
    return sv.scored_days(spark, sf_dir).withColumn("baseline_complete", F.date_diff("day", first) >= 7)


view("gated_rows", """SELECT *, day - min(day) OVER (PARTITION BY "user") >= 7 AS baseline_complete FROM scored""")


def cutoff_sql(table: str, ratio: float) -> str:
    return (
        f"(SELECT day FROM (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n "
        f"FROM (SELECT DISTINCT day FROM {table})) WHERE i = floor(n * {ratio!r}::DOUBLE))"
    )


view("reference_rows", f"SELECT * FROM scored WHERE day <= {cutoff_sql('scored', 0.5)}")
view("recent_rows", f"SELECT * FROM scored WHERE day > {cutoff_sql('scored', 0.5)}")
view(
    "labelled_recent",
    """SELECT "user", day, total_reconstruction_error AS score, CAST(EXISTS (SELECT 1 FROM win w WHERE w."user" = r."user" AND day BETWEEN start_day AND end_day) AS INT) AS label FROM recent_rows r""",
)
view("doc_scores", "SELECT doc_id, CAST(n_chars AS DOUBLE) AS score, 1 - quality AS label FROM labels JOIN documents USING (doc_id)")
view("clean_scores", "SELECT CAST(n_chars AS DOUBLE) AS score FROM labels JOIN documents USING (doc_id) WHERE quality = 1 AND toxic = 0")


def reference_and_recent(spark, sf_dir):
    return splits.chronological_split(sv.scored_days(spark, sf_dir), 0.5)


def labelled_recent(spark, sf_dir):
    _, recent = reference_and_recent(spark, sf_dir)
    rows = recent.select("user", "day", F.col("total_reconstruction_error").alias("score"))
    return splits.with_label(rows, sv.labelled_windows(spark, sf_dir))


def reference_scores(spark, sf_dir):
    reference, _ = reference_and_recent(spark, sf_dir)
    return reference.select(F.col("total_reconstruction_error").alias("score"))


def documents_scored(spark, sf_dir):
    docs = sv.table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return sv.table(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("label", 1 - F.col("quality"))


def pct_rank_sql(value: str, base: str) -> str:
    return f"(SELECT count(*) FILTER ({base} < {value}) / count(*) FROM reference_rows b) * 100.0::DOUBLE"


CONTRIBUTION_NAMES = {
    "logon_count": "n_logon", "file_copy_count_zscore": "n_file", "usb_insert_count": "n_device",
    "emails_sent_rolling_delta": "n_email", "cloud_upload_flag": "n_http",
}


def with_contributions(df):
    squares = " + ".join(f"{c} * {c}" for c in CONTRIBUTION_NAMES.values())
    shares = ", ".join(f"'{name}', ({c} * {c}) / CAST({squares} AS DOUBLE)" for name, c in CONTRIBUTION_NAMES.items())
    return df.withColumns(
        {
            "contributions": F.expr(f"map({shares})"),
            "zscores": F.expr("map('file_copy_count_zscore', n_file / 8D - 1, 'usb_insert_count', n_device / 4D)"),
            "deltas": F.expr("map('usb_insert_count', n_device / 4D - 1.5D)"),
        }
    )


_squares = " + ".join(f"{c} * {c}" for c in CONTRIBUTION_NAMES.values())
view(
    "shares",
    " UNION ALL ".join(
        f"""SELECT "user", day, '{name}' AS feature, ({c} * {c}) / CAST({_squares} AS DOUBLE) AS value,
  {'n_file / 8::DOUBLE - 1' if name == 'file_copy_count_zscore' else 'n_device / 4::DOUBLE' if name == 'usb_insert_count' else 'NULL'} AS z,
  {'n_device / 4::DOUBLE - 1.5' if name == 'usb_insert_count' else 'NULL'} AS delta FROM recent_rows"""
        for name, c in CONTRIBUTION_NAMES.items()
    ),
)
view(
    "top3",
    """SELECT *, row_number() OVER (PARTITION BY "user", day ORDER BY value DESC, feature) AS rn FROM shares QUALIFY rn <= 3""",
)


def band_sql(p: str) -> str:
    return f"CASE WHEN {p} >= 95 THEN 'CRITICAL' WHEN {p} >= 90 THEN 'HIGH' WHEN {p} >= 80 THEN 'MEDIUM' ELSE 'LOW' END"


view(
    "ranked_recent",
    f"""SELECT *, {pct_rank_sql('r.total_reconstruction_error', 'b.total_reconstruction_error')} AS ae_percentile_rank,
  {pct_rank_sql('r.if_anomaly_score', 'b.if_anomaly_score')} AS if_percentile_rank FROM recent_rows r""",
)
view(
    "alert_rows",
    f"""SELECT *, {band_sql('composite_score')} AS composite_risk_band,
  ae_risk_band IN ('HIGH', 'CRITICAL') AND if_risk_band IN ('HIGH', 'CRITICAL') AS both_signals_high
FROM (SELECT *, 0.5 * ae_percentile_rank + 0.5 * if_percentile_rank AS composite_score,
  CASE WHEN total_reconstruction_error <= 60 THEN 'LOW' WHEN total_reconstruction_error <= 85 THEN 'MEDIUM' WHEN total_reconstruction_error <= 95 THEN 'HIGH' ELSE 'CRITICAL' END AS ae_risk_band,
  {band_sql('if_percentile_rank')} AS if_risk_band FROM ranked_recent)""",
)
CEILINGS = {"LOW": 60.0, "MEDIUM": 85.0, "HIGH": 95.0, "CRITICAL": None}


def alert_rows(spark, sf_dir):
    reference, recent = reference_and_recent(spark, sf_dir)
    return alerts.alert_table(with_contributions(recent), reference, reference, ae_ceilings=CEILINGS)


# --- splits and labels ---------------------------------------------------------------


@query(
    "chronological_split",
    with_views(f"""SELECT "user", day, CASE WHEN day <= {cutoff_sql('scored', 0.9)} THEN 'train' ELSE 'test' END AS part FROM scored"""),
)
def chronological_split(spark, sf_dir):
    train, test = splits.chronological_split(sv.scored_days(spark, sf_dir).select("user", "day"), 0.9)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query(
    "train_calibration_test",
    with_views(
        f"""WITH rest AS (SELECT "user", day FROM scored WHERE day <= {cutoff_sql('scored', 0.9)}),
parts AS (SELECT 'train' AS part, * FROM rest WHERE day <= {cutoff_sql('rest', 8 / 9)}
  UNION ALL SELECT 'calibration', * FROM rest WHERE day > {cutoff_sql('rest', 8 / 9)}
  UNION ALL SELECT 'calibration_clean', * FROM rest WHERE day > {cutoff_sql('rest', 8 / 9)} AND "user" NOT IN (SELECT "user" FROM win)
  UNION ALL SELECT 'test_stream', "user", day FROM scored WHERE day > {cutoff_sql('scored', 0.9)})
SELECT part, day, count(*) AS rows, count(DISTINCT "user") AS users FROM parts GROUP BY part, day"""
    ),
)
def train_calibration_test(spark, sf_dir):
    rows = sv.scored_days(spark, sf_dir).select("user", "day")
    parts = splits.train_calibration_test(rows, sv.labelled_windows(spark, sf_dir))
    named = [df.withColumn("part", F.lit(name)) for name, df in parts.items()]
    return log_sources.union_all(named).groupBy("part", "day").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("user").alias("users")
    )


@query(
    "labelled_window_mask",
    with_views(
        """SELECT "user", day, CAST(EXISTS (SELECT 1 FROM win w WHERE w."user" = r."user" AND day BETWEEN start_day AND end_day) AS INT) AS label FROM user_day r"""
    ),
)
def labelled_window_mask(spark, sf_dir):
    return splits.with_label(sv.user_days(spark, sf_dir).select("user", "day"), sv.labelled_windows(spark, sf_dir))


@query("without_labelled_users", with_views("""SELECT "user", day, n FROM user_day WHERE "user" NOT IN (SELECT "user" FROM win)"""))
def without_labelled_users(spark, sf_dir):
    return splits.without_labelled_users(
        sv.user_days(spark, sf_dir).select("user", "day", "n"), sv.labelled_windows(spark, sf_dir)
    )


@query(
    "training_parts",
    with_views(
        f"""WITH normal AS (SELECT "user", day FROM gated_rows g WHERE baseline_complete
  AND NOT EXISTS (SELECT 1 FROM win w WHERE w."user" = g."user" AND day BETWEEN start_day AND end_day))
SELECT "user", day, CASE WHEN day <= {cutoff_sql('normal', 1.0 - 0.15)} THEN 'fit' ELSE 'validation' END AS part FROM normal"""
    ),
)
def training_parts(spark, sf_dir):
    rows = gated(spark, sf_dir).select("user", "day", "baseline_complete")
    parts = splits.training_parts(rows, sv.labelled_windows(spark, sf_dir))
    named = [parts[name].select("user", "day", F.lit(name).alias("part")) for name in ("fit", "validation")]
    return log_sources.union_all(named)


@query(
    "gated_split",
    with_views("""SELECT "user", day, n FROM gated_rows WHERE baseline_complete"""),
)
def gated_split(spark, sf_dir):
    raw = gated(spark, sf_dir).select(
        F.concat(F.lit(" "), F.upper("user"), F.lit(" ")).alias("user"), F.col("day").cast("timestamp_ntz").alias("day"),
        "n", "baseline_complete",
    )
    return log_sources.gated_split(raw).select("user", "day", "n")


@query(
    "labelled_windows",
    with_views("""SELECT "user", start_day, end_day, scenario FROM win WHERE scenario < 3"""),
)
def labelled_windows(spark, sf_dir):
    raw = sv.labelled_windows(spark, sf_dir).select(
        F.when(F.col("scenario") < 3, " 6.2 ").otherwise("5.1").alias(" dataset"),
        F.col("scenario").cast("string").alias("scenario"),
        F.concat(F.lit(" "), F.upper("user")).alias("user "),
        F.concat(F.col("start_day").cast("string"), F.lit(" 08:15:00 ")).alias("start"),
        F.concat(F.col("end_day").cast("string"), F.lit(" 17:00:00")).alias("end"),
    )
    return log_sources.parse_windows(raw, 6.2)


@query(
    "replay_rows",
    with_views(
        f"""SELECT "user", CAST(day + (SELECT CAST(max(day) - min(day) + 1 AS INT) FROM scored WHERE day >= {cutoff_sql('scored', 0.9)}) AS DATE) AS day, if_anomaly_score
FROM scored WHERE day >= {cutoff_sql('scored', 0.9)}"""
    ),
)
def replay_rows(spark, sf_dir):
    return splits.replay_rows(sv.scored_days(spark, sf_dir).select("user", "day", "if_anomaly_score"))


@query(
    "missing_key_rows",
    with_views("""SELECT "user", day FROM recent_rows UNION SELECT "user", day FROM reference_rows"""),
)
def missing_key_rows(spark, sf_dir):
    """Concatenate overlapping pieces and drop duplicate rows."""
    reference, recent = reference_and_recent(spark, sf_dir)
    pieces = [recent.select("user", "day"), reference.select("user", "day"), recent.select("user", "day")]
    return log_sources.union_all(pieces).dropDuplicates()


# --- calibration and bands ---------------------------------------------------------------


@query(
    "calibrated_thresholds",
    with_views(
        f"""SELECT signal, {r6('quantile_cont(v, 0.95)')} AS low, {r6('quantile_cont(v, 0.99)')} AS medium, {r6('quantile_cont(v, 0.995)')} AS high, NULL::DOUBLE AS critical
FROM (SELECT 'ae' AS signal, total_reconstruction_error AS v FROM reference_rows UNION ALL SELECT 'if', if_anomaly_score FROM reference_rows) GROUP BY signal"""
    ),
)
def calibrated_thresholds(spark, sf_dir):
    reference, _ = reference_and_recent(spark, sf_dir)
    signals = reference.select(
        F.explode(
            F.array(
                F.struct(F.lit("ae").alias("signal"), F.col("total_reconstruction_error").alias("v")),
                F.struct(F.lit("if").alias("signal"), F.col("if_anomaly_score").alias("v")),
            )
        ).alias("s")
    ).select("s.signal", "s.v")
    wide = ranking.percentiles(signals, "v", list(fixed.CALIBRATION_PERCENTILES.values()), ["signal"])
    return rounded(
        wide.select("signal", F.col("p95").alias("low"), F.col("p99").alias("medium"), F.col("p995").alias("high"),
                    F.lit(None).cast("double").alias("critical"))
    )


@query(
    "percentile_ranks",
    with_views(f"""SELECT "user", day, {r6('ae_percentile_rank')} AS ae_percentile_rank, {r6('if_percentile_rank')} AS if_percentile_rank FROM ranked_recent"""),
)
def percentile_ranks(spark, sf_dir):
    reference, recent = reference_and_recent(spark, sf_dir)
    ranked = ranking.percentile_ranks(
        recent,
        {
            "ae_percentile_rank": ("total_reconstruction_error", reference, "total_reconstruction_error"),
            "if_percentile_rank": ("if_anomaly_score", reference, "if_anomaly_score"),
        },
    )
    return rounded(ranked.select("user", "day", "ae_percentile_rank", "if_percentile_rank"))


@query(
    "risk_bands",
    with_views(
        f"""SELECT "user", day, {band_sql('total_reconstruction_error')} AS percentile_band,
  CASE WHEN total_reconstruction_error <= 60 THEN 'LOW' WHEN total_reconstruction_error <= 85 THEN 'MEDIUM' WHEN total_reconstruction_error <= 95 THEN 'HIGH' ELSE 'CRITICAL' END AS score_band,
  CASE WHEN NOT baseline_complete AND total_reconstruction_error >= 95 THEN 'HIGH' ELSE {band_sql('total_reconstruction_error')} END AS gated_band,
  CASE WHEN total_reconstruction_error >= 70 THEN 'High AE' ELSE 'Low AE' END || ' / ' || CASE WHEN if_anomaly_score * 100 >= 70 THEN 'High IF' ELSE 'Low IF' END AS risk_quadrant,
  {r6('0.6 * total_reconstruction_error + 0.4 * (if_anomaly_score * 100)')} AS hybrid_score FROM gated_rows"""
    ),
)
def risk_bands(spark, sf_dir):
    score, other = F.col("total_reconstruction_error"), F.col("if_anomaly_score") * 100
    band = bands.band_of_percentile(score, {"LOW": 80, "MEDIUM": 90, "HIGH": 95, "CRITICAL": 100})
    return rounded(
        gated(spark, sf_dir).select(
            "user",
            "day",
            band.alias("percentile_band"),
            bands.band_of_score(score, {"CRITICAL": None, "HIGH": 95.0, "LOW": 60.0, "MEDIUM": 85.0}).alias("score_band"),
            bands.demote_cold_start(band, F.col("baseline_complete")).alias("gated_band"),
            bands.quadrant(score, other, 70.0).alias("risk_quadrant"),
            bands.composite(score, other, 0.6, 0.4).alias("hybrid_score"),
        )
    )


@query(
    "distribution_summary",
    with_views(
        f"""SELECT {r6('avg(if_anomaly_score)')} AS mean, {r6('stddev_pop(if_anomaly_score)')} AS std, {r6('min(if_anomaly_score)')} AS min, {r6('max(if_anomaly_score)')} AS max,
{r6('quantile_cont(if_anomaly_score, 0.9)')} AS p90, {r6('quantile_cont(if_anomaly_score, 0.95)')} AS p95, {r6('quantile_cont(if_anomaly_score, 0.99)')} AS p99, {r6('quantile_cont(if_anomaly_score, 0.995)')} AS p995 FROM scored"""
    ),
)
def distribution_summary(spark, sf_dir):
    return rounded(ranking.distribution_summary(sv.scored_days(spark, sf_dir), "if_anomaly_score"))


# --- alerts and cases -----------------------------------------------------------------------


@query(
    "top_contributors",
    with_views(f"""SELECT "user", day, CAST(rn AS INT) AS position, feature, {r6('value')} AS value FROM top3"""),
)
def top_contributors(spark, sf_dir):
    _, recent = reference_and_recent(spark, sf_dir)
    top = alerts.top_contributors(F.col("contributions"))
    rows = with_contributions(recent).select("user", "day", F.posexplode(top).alias("i", "c"))
    return rounded(
        rows.select("user", "day", (F.col("i") + 1).alias("position"), F.col("c.feature").alias("feature"), F.col("c.value").alias("value"))
    )


@query(
    "alert_table",
    with_views(
        f"""SELECT "user", day, {r6('ae_percentile_rank')} AS ae_percentile_rank, ae_risk_band, {r6('if_anomaly_score')} AS if_anomaly_score,
{r6('if_percentile_rank')} AS if_percentile_rank, if_risk_band, {r6('composite_score')} AS composite_score, composite_risk_band, both_signals_high FROM alert_rows"""
    ),
)
def alert_table(spark, sf_dir):
    return rounded(alert_rows(spark, sf_dir).drop("top_contributors", "explanation"))


view(
    "alert_text",
    """SELECT "user", day, printf('AE deviation at %.1fth pct (%s); IF anomaly at %.1fth pct (%s). Composite: %s (%.1fth pct). Drivers: %s',
  ae_percentile_rank, ae_risk_band, if_percentile_rank, if_risk_band, composite_risk_band, composite_score, drivers) AS explanation
FROM alert_rows JOIN (SELECT "user", day, string_agg(CASE WHEN z IS NULL THEN printf('%s (%.2f)', feature, value)
    WHEN delta IS NULL THEN printf('%s (z=%.1f, contrib=%.2f)', feature, z, value)
    ELSE printf('%s (z=%.1f, %+.1f vs 5-day avg, contrib=%.2f)', feature, z, delta, value) END, '; ' ORDER BY rn) AS drivers
  FROM top3 GROUP BY "user", day) USING ("user", day)""",
)


@query("alert_explanations", with_views("SELECT * FROM alert_text"))
def alert_explanations(spark, sf_dir):
    return alert_rows(spark, sf_dir).select("user", "day", "explanation")


@query(
    "case_table",
    with_views(
        f"""WITH kept AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY "user" ORDER BY day) <= 3 THEN 0 ELSE 1 END AS opens FROM alert_rows WHERE composite_score >= 80),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY "user" ORDER BY day) AS case_id FROM kept),
placed AS (SELECT *, row_number() OVER (PARTITION BY "user", case_id ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY "user", case_id) AS c FROM numbered)
SELECT "user", min(day) AS case_start, max(day) AS case_end, count(*) AS anomalous_days, {r6('max(composite_score)')} AS max_composite, {r6('avg(composite_score)')} AS mean_composite,
  {r6('max(ae_percentile_rank)')} AS peak_ae_percentile, {r6('max(if_percentile_rank)')} AS peak_if_percentile, count(*) FILTER (both_signals_high) AS confirmed_days,
  CASE WHEN count(*) = 1 THEN 'SINGLE_DAY' WHEN avg(composite_score) FILTER (i >= c // 2) > avg(composite_score) FILTER (i < c // 2) THEN 'ESCALATING' ELSE 'DE-ESCALATING' END AS trend,
  {band_sql('max(composite_score)')} AS case_risk_band FROM placed GROUP BY "user", case_id"""
    ),
)
def case_table(spark, sf_dir):
    return rounded(alerts.case_table(alert_rows(spark, sf_dir), window_days=3, min_risk="MEDIUM"))


# --- names ---------------------------------------------------------------------------------

# Every base feature with every statistic suffix, flags included, as names over the labelled days.
NAME_SQL = ", ".join(f"'{n}'" for n in [*fixed.BASE_FEATURES, *fixed.CROSS_FLAGS, "pc_seen_before", "primary_pc_activity_ratio"])
SUFFIX_SQL = ", ".join(f"'{s}'" for s in ["", "_zscore", "_rolling_delta", "_7d_sum", "_30d_sum", "_zscore_90d", "_peer_zscore", "_1d_over_30d_ratio"])
view(
    "named_values",
    f"""SELECT "user", day, list_extract([{NAME_SQL}], CAST(cents % 58 AS INT) + 1) || list_extract([{SUFFIX_SQL}], CAST(cents // 58 % 8 AS INT) + 1) AS feature, if_anomaly_score AS value FROM scored""",
)


def named_values(spark, sf_dir):
    """User-days that each carry one feature name and a value."""
    return sv.scored_days(spark, sf_dir).select(
        "user", "day",
        F.expr(f"concat(element_at(array({NAME_SQL}), CAST(cents % 58 AS INT) + 1), element_at(array({SUFFIX_SQL}), CAST(cents div 58 % 8 AS INT) + 1))").alias("feature"),
        F.col("if_anomaly_score").alias("value"),
    )


def _prefix_sql(name: str) -> str:
    rule = " OR ".join(f"starts_with(feature, '{p}')" for p in fixed.CHANNEL_PREFIXES[name])
    flags = fixed.CHANNEL_FLAGS.get(name, [])
    return rule + "".join(f" OR feature = '{f}'" for f in flags)


@query(
    "feature_names",
    with_views(
        f"""SELECT feature, count(*) AS rows, CASE {' '.join(f"WHEN {_prefix_sql(n)} THEN '{n}'" for n in fixed.CHANNEL_PREFIXES)} ELSE 'other' END AS channel,
  CASE {' '.join(f"WHEN regexp_matches(feature, '{p}') THEN '{n}'" for n, p in fixed.ERROR_CHANNEL_PATTERNS)} ELSE 'Other' END AS error_channel,
  regexp_replace(feature, '({'|'.join(fixed.FAMILY_SUFFIXES)})$', '') AS family,
  CASE WHEN known IS NOT NULL THEN known
    WHEN feature LIKE '%\\_zscore' ESCAPE '\\' THEN 'unusually high ' || coalesce(base_known, replace(base, '_', ' '))
    WHEN feature LIKE '%\\_rolling\\_delta' ESCAPE '\\' THEN CASE WHEN regexp_matches(base, '(_count|_sent)$') THEN 'sudden spike in ' ELSE 'sudden increase in ' END || coalesce(base_known, replace(base, '_', ' '))
    ELSE replace(feature, '_', ' ') END AS phrase
FROM (SELECT feature, regexp_replace(feature, '(_zscore|_rolling_delta)$', '') AS base FROM named_values)
LEFT JOIN (VALUES {', '.join(f"('{k}', '{v}')" for k, v in fixed.FEATURE_PHRASES.items())}) f(k, known) ON k = feature
LEFT JOIN (VALUES {', '.join(f"('{k}', '{v}')" for k, v in fixed.BASE_PHRASES.items())}) b(bk, base_known) ON bk = base
GROUP BY feature, base, known, base_known"""
    ),
)
def feature_names(spark, sf_dir):
    name = F.col("feature")
    return named_values(spark, sf_dir).groupBy("feature").agg(F.count(F.lit(1)).alias("rows")).select(
        "feature", "rows",
        naming.channel_of(name).alias("channel"),
        naming.error_channel_of(name).alias("error_channel"),
        naming.family_of(name).alias("family"),
        naming.phrase_of(name).alias("phrase"),
    )


@query(
    "alert_sentences",
    with_views(
        """WITH phrases AS (SELECT * FROM (VALUES ('logon_count', 'elevated logon frequency', 'Authentication'), ('file_copy_count_zscore', 'unusually high file copy activity', 'File Access'),
  ('usb_insert_count', 'USB device insertion', 'Removable Media'), ('emails_sent_rolling_delta', 'sudden spike in email volume', 'Email'), ('cloud_upload_flag', 'cloud storage upload activity', 'Cross-Channel')) t(feature, phrase, category)),
l AS (SELECT "user", day, list(phrase ORDER BY rn) AS p, string_agg(category, ', ' ORDER BY rn) AS threat_categories FROM top3 JOIN phrases USING (feature) WHERE value > 0.2 GROUP BY "user", day)
SELECT r."user", r.day, coalesce(threat_categories, '') AS threat_categories, CASE WHEN p IS NULL THEN 'No contributor detail available for this alert.' WHEN len(p) = 1 THEN 'This alert is primarily driven by ' || p[1] || '.'
  WHEN len(p) = 2 THEN 'This alert is mainly driven by ' || p[1] || ' and ' || p[2] || '.' ELSE 'This alert is mainly driven by ' || p[1] || ', ' || p[2] || ', and ' || p[3] || '.' END AS sentence
FROM recent_rows r LEFT JOIN l USING ("user", day)"""
    ),
)
def alert_sentences(spark, sf_dir):
    """Contributors above a fifth, stored as text and parsed back."""
    _, recent = reference_and_recent(spark, sf_dir)
    large = F.filter(alerts.top_contributors(F.col("contributions")), lambda c: c["value"] > 0.2)
    stored = with_contributions(recent).select("user", "day", F.to_json(large).alias("top_contributors"))
    names = F.transform(naming.parse_contributors(F.col("top_contributors")), lambda c: c["feature"])
    return stored.select(
        "user", "day",
        F.array_join(naming.threat_categories(names), ", ").alias("threat_categories"),
        naming.alert_sentence(names).alias("sentence"),
    )


# --- evaluation --------------------------------------------------------------------------------

view(
    "doc_curve",
    """SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n
FROM (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM doc_scores GROUP BY score) WINDOW w AS (ORDER BY score DESC)""",
)


@query(
    "separation_ratio",
    with_views(
        f"""SELECT {r6('avg(score) FILTER (label = 1)')} AS mean_labelled, {r6('avg(score) FILTER (label = 0)')} AS mean_normal, {r6('avg(score) FILTER (label = 1) / avg(score) FILTER (label = 0)')} AS ratio FROM doc_scores"""
    ),
)
def separation_ratio(spark, sf_dir):
    return rounded(evaluate.separation_ratio(documents_scored(spark, sf_dir)))


@query("roc_auc", with_views(f"SELECT {r6('sum(neg * (tp - pos + pos / 2)) / (max(p) * max(n))')} AS roc_auc FROM doc_curve"))
def roc_auc(spark, sf_dir):
    return rounded(evaluate.roc_auc(documents_scored(spark, sf_dir)))


@query(
    "average_precision",
    with_views(f"SELECT {r6('sum(pos / p * (tp / (tp + fp)))')} AS average_precision FROM doc_curve"),
)
def average_precision(spark, sf_dir):
    return rounded(evaluate.average_precision(documents_scored(spark, sf_dir)))


@query(
    "roc_pr_points",
    with_views(f"SELECT score AS threshold, {r6('fp / n')} AS fpr, {r6('tp / p')} AS tpr, {r6('tp / (tp + fp)')} AS precision, {r6('tp / p')} AS recall FROM doc_curve"),
)
def roc_pr_points(spark, sf_dir):
    return rounded(evaluate.roc_pr_points(documents_scored(spark, sf_dir)))


@query(
    "precision_at_recall",
    with_views(
        f"""SELECT target::DOUBLE AS target, {r6('coalesce(max(tp / (tp + fp)) FILTER (tp / p >= target), 0)')} AS precision FROM doc_curve, (VALUES (0.22::DOUBLE), (0.5::DOUBLE), (0.8::DOUBLE)) t(target) GROUP BY target"""
    ),
)
def precision_at_recall(spark, sf_dir):
    return rounded(evaluate.precision_at_recall(documents_scored(spark, sf_dir)))


def quantiles_sql(table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {p}::DOUBLE AS percentile, (SELECT quantile_cont(score, {p / 100}) FROM {table}) AS threshold" for p in (80, 90, 95)
    )


view("doc_levels", quantiles_sql("clean_scores"))
view("day_reference", "SELECT total_reconstruction_error AS score FROM reference_rows")
view("day_levels", quantiles_sql("day_reference"))


@query(
    "recall_at_percentiles",
    with_views(
        f"""SELECT percentile, {r6('count(*) FILTER (label = 1 AND score >= threshold) / count(*) FILTER (label = 1)')} AS recall FROM doc_scores, doc_levels GROUP BY percentile"""
    ),
)
def recall_at_percentiles(spark, sf_dir):
    docs = documents_scored(spark, sf_dir)
    return rounded(evaluate.recall_at_percentiles(docs, docs.where("quality = 1 AND toxic = 0")))


@query(
    "confusion",
    with_views(
        f"""SELECT percentile, tn, fp, fn, tp, {r6('CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END')} AS precision, {r6('CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END')} AS recall,
{r6('CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END')} AS fpr FROM (SELECT percentile, count(*) FILTER (label = 0 AND score < threshold) AS tn, count(*) FILTER (label = 0 AND score >= threshold) AS fp,
  count(*) FILTER (label = 1 AND score < threshold) AS fn, count(*) FILTER (label = 1 AND score >= threshold) AS tp FROM doc_scores, doc_levels GROUP BY percentile)"""
    ),
)
def confusion(spark, sf_dir):
    docs = documents_scored(spark, sf_dir)
    return rounded(evaluate.confusion(docs, docs.where("quality = 1 AND toxic = 0")))


view(
    "active_win",
    """SELECT * FROM win WHERE start_day <= (SELECT max(day) FROM recent_rows) AND end_day >= (SELECT min(day) FROM recent_rows)""",
)


@query(
    "user_detection_rate",
    with_views(
        f"""SELECT percentile, count(*) FILTER (peak >= threshold) AS detected, count(*) AS total_labelled, {r6('count(*) FILTER (peak >= threshold) / count(*)')} AS rate
FROM (SELECT DISTINCT "user" FROM active_win) LEFT JOIN (SELECT "user", max(total_reconstruction_error) AS peak FROM recent_rows GROUP BY "user") USING ("user"), day_levels GROUP BY percentile"""
    ),
)
def user_detection_rate(spark, sf_dir):
    return rounded(
        evaluate.user_detection_rate(
            labelled_recent(spark, sf_dir), sv.labelled_windows(spark, sf_dir), reference_scores(spark, sf_dir)
        )
    )


@query(
    "alert_volume",
    with_views(
        f"""SELECT percentile, total_flagged, {r6('total_flagged / days')} AS alerts_per_day, true_positives, {r6('CASE WHEN total_flagged > 0 THEN true_positives / total_flagged ELSE 0 END')} AS alert_precision
FROM (SELECT percentile, count(*) FILTER (score >= threshold) AS total_flagged, max(day) - min(day) + 1 AS days, count(*) FILTER (score >= threshold AND label = 1) AS true_positives FROM labelled_recent, day_levels GROUP BY percentile)"""
    ),
)
def alert_volume(spark, sf_dir):
    return rounded(evaluate.alert_volume(labelled_recent(spark, sf_dir), reference_scores(spark, sf_dir)))


@query(
    "time_to_first_alert",
    with_views(
        f"""SELECT "user", start_day AS threat_start, end_day, first_alert_day, CAST(first_alert_day - start_day AS DOUBLE) AS days_delta,
  coalesce(first_alert_day BETWEEN start_day AND end_day, false) AS in_window, {r6('peak')} AS peak_score FROM active_win
LEFT JOIN (SELECT "user", min(day) FILTER (total_reconstruction_error >= (SELECT threshold FROM day_levels WHERE percentile = 95)) AS first_alert_day, max(total_reconstruction_error) AS peak FROM recent_rows GROUP BY "user") USING ("user")"""
    ),
)
def time_to_first_alert(spark, sf_dir):
    limit = evaluate.thresholds(reference_scores(spark, sf_dir), (95.0,)).select("threshold").scalar()
    first = evaluate.time_to_first_alert(labelled_recent(spark, sf_dir), sv.labelled_windows(spark, sf_dir), limit)
    return rounded(first.withColumn("days_delta", F.col("days_delta").cast("double")))


@query(
    "user_ranking",
    with_views(
        f"""SELECT row_number() OVER (ORDER BY peak DESC, "user") AS rank, "user", {r6('peak')} AS peak_score, "user" IN (SELECT "user" FROM win) AS is_labelled
FROM (SELECT "user", max(total_reconstruction_error) AS peak FROM recent_rows GROUP BY "user")"""
    ),
)
def user_ranking(spark, sf_dir):
    return rounded(evaluate.user_ranking(labelled_recent(spark, sf_dir), sv.labelled_windows(spark, sf_dir)))


@query(
    "ks_shift",
    with_views(
        f"""SELECT {r6('max(abs(a - b))')} AS ks_statistic FROM (SELECT sum(a) OVER w / sum(a) OVER () AS a, sum(b) OVER w / sum(b) OVER () AS b FROM (
  SELECT score, sum(a) AS a, sum(b) AS b FROM (SELECT score, 1 AS a, 0 AS b FROM day_reference UNION ALL SELECT score, 0, 1 FROM labelled_recent) GROUP BY score) WINDOW w AS (ORDER BY score))"""
    ),
)
def ks_shift(spark, sf_dir):
    shift = evaluate.ks_shift(reference_scores(spark, sf_dir), labelled_recent(spark, sf_dir))
    return rounded(shift.select("ks_statistic"))


@query("ks_shift_p_value")
def ks_shift_p_value(spark, sf_dir):
    return evaluate.ks_shift(reference_scores(spark, sf_dir), labelled_recent(spark, sf_dir))
