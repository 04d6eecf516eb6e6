"""Detection under fixed models, stored rank indexes and merged windows, each with its SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from daywatch.functions import cleaning
from daywatch.operators import alerts, models, ranking, serving, splits
from daywatch.plans.catalog.channel_queries import rounded
from daywatch.plans.catalog.layer_queries import COUNTS
from daywatch.plans.catalog.registry import query
from daywatch.plans.catalog.risk_queries import band_sql, r6, reference_and_recent
from daywatch.plans.catalog.sql_views import view, with_views
from daywatch.session import scratch_path
from daywatch.sources import logs, sinks
from daywatch.sources import sample_views as sv
from daywatch.streaming import scoring

# A model with given numbers, so that SQL can say what its scores are.
MEANS, STDS = [0.5, 1.0, 0.25, 0.4, 1.25], [0.75, 1.0, 0.5, 0.6, 1.5]
WEIGHTS = [[0.6, 0.0], [0.8, 0.1], [0.0, -0.5], [0.1, 0.7], [-0.2, 0.5]]
CENTRES = [[0.0, 0.0, 0.0, 0.0, 0.0], [1.0, 0.5, -0.5, 0.0, 2.0], [-0.5, 2.0, 1.0, -1.0, 0.0]]
SAMPLE = 64
#: tree, node, left, right, feature, threshold, path
NODES = [
    (0, 0, 1, 2, 0, 0.1234, None), (0, 1, 3, 4, 1, -0.4321, None), (0, 2, -1, -1, -1, 0.0, 3.5),
    (0, 3, -1, -1, -1, 0.0, 2.0), (0, 4, -1, -1, -1, 0.0, 9.25),
    (1, 0, 1, 2, 1, 0.3217, None), (1, 1, -1, -1, -1, 0.0, 8.0), (1, 2, 3, 4, 0, 1.2345, None),
    (1, 3, -1, -1, -1, 0.0, 5.0), (1, 4, 5, 6, 1, 1.5678, None), (1, 5, -1, -1, -1, 0.0, 4.5), (1, 6, -1, -1, -1, 0.0, 3.0),
    (2, 0, -1, -1, -1, 0.0, 6.0),
]


def fixed_forest() -> models.Forest:
    columns = ["tree", "node", "left", "right", "feature", "threshold", "path"]
    return models.Forest(pd.DataFrame(NODES, columns=columns).astype({"path": float}), SAMPLE)


def fixed_model(reconstruction=None) -> models.DetectionModel:
    scaler = models.Scaler(COUNTS, MEANS, STDS)
    return models.DetectionModel(scaler, reconstruction or models.Components(np.array(WEIGHTS)), fixed_forest())


def stored_model(spark, model):
    """Through storage and back."""
    root = scratch_path(spark, "model")
    models.save_model(spark, model, root)
    return models.load_model(spark, root)


def forest_sql(source: str, keys: str, parts: list[str]) -> str:
    """Scores of a forest whose nodes are a table, its paths walked by recursion; ``parts`` are the embedding's entries."""
    rows = ", ".join(
        f"({t}, {n}, {a}, {b}, {f}, CAST({x!r} AS DOUBLE), {'NULL' if p is None else f'CAST({p!r} AS DOUBLE)'})"
        for t, n, a, b, f, x, p in NODES
    )
    own = "CASE n.feature " + " ".join(f"WHEN {i} THEN w.{c}" for i, c in enumerate(parts)) + " END"
    return f"""(WITH RECURSIVE nodes(tree, node, l, r, feature, threshold, path) AS (VALUES {rows}),
  walk AS (
    SELECT {keys}, {', '.join(parts)}, tree, 0 AS node FROM {source}, (SELECT DISTINCT tree FROM nodes)
    UNION ALL
    SELECT {', '.join('w.' + k for k in keys.split(', '))}, {', '.join('w.' + p for p in parts)}, w.tree, CASE WHEN {own} <= n.threshold THEN n.l ELSE n.r END
    FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node WHERE n.l >= 0)
  SELECT {keys}, power(2.0, -avg(path) / CAST({models.expected_path(SAMPLE)!r} AS DOUBLE)) AS if_anomaly_score
  FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node WHERE n.l < 0 GROUP BY {keys})"""


_scaled = [f"(CAST({c} AS DOUBLE) - {m}::DOUBLE) / {s}::DOUBLE" for c, m, s in zip(COUNTS, MEANS, STDS)]
_latent = [" + ".join(f"s{i} * CAST({row[j]} AS DOUBLE)" for i, row in enumerate(WEIGHTS)) for j in range(2)]
_rebuilt = [" + ".join(f"e{j} * CAST({row[j]} AS DOUBLE)" for j in range(2)) for row in WEIGHTS]
_errors = [f"(s{i} - ({r})) * (s{i} - ({r}))" for i, r in enumerate(_rebuilt)]
view("fixed_scaled", f"""SELECT "user", day, {', '.join(f'{x} AS s{i}' for i, x in enumerate(_scaled))} FROM user_day""")
view("fixed_latent", f"""SELECT *, {', '.join(f'{x} AS e{j}' for j, x in enumerate(_latent))} FROM fixed_scaled""")
view(
    "fixed_scores",
    f"""SELECT l."user", l.day, e0, e1, {' + '.join(_errors)} AS total_reconstruction_error, {_errors[1]} AS file_error, f.if_anomaly_score
FROM fixed_latent l JOIN {forest_sql('fixed_latent', '"user", day', ['e0', 'e1'])} f ON f."user" = l."user" AND f.day = l.day""",
)


@query(
    "fixed_model_scores",
    with_views(
        f"""SELECT "user", day, {r6('e0')} AS e0, {r6('e1')} AS e1, {r6('total_reconstruction_error')} AS total_reconstruction_error,
  {r6('CASE WHEN total_reconstruction_error > 0 THEN file_error / total_reconstruction_error ELSE 0 END')} AS file_share,
  {r6('if_anomaly_score')} AS if_anomaly_score, CASE WHEN if_anomaly_score > 0.5 THEN -1 ELSE 1 END AS anomaly FROM fixed_scores"""
    ),
)
def fixed_model_scores(spark, sf_dir):
    """Embedding, reconstruction error, a contribution and forest score under a stored model of given numbers."""
    scored = models.score_rows(sv.user_days(spark, sf_dir), stored_model(spark, fixed_model()), ["user", "day"])
    return rounded(
        scored.select(
            "user", "day", F.col("embedding")[0].alias("e0"), F.col("embedding")[1].alias("e1"),
            "total_reconstruction_error", F.col("contributions")["n_file"].alias("file_share"),
            "if_anomaly_score", models.anomaly_label(F.col("if_anomaly_score")).alias("anomaly"),
        )
    )


def _distance(i: int) -> str:
    return "sqrt(" + " + ".join(f"(s{k} - CAST({v} AS DOUBLE)) * (s{k} - CAST({v} AS DOUBLE))" for k, v in enumerate(CENTRES[i])) + ")"


@query(
    "centre_model_scores",
    with_views(
        f"""SELECT "user", day, {', '.join(f"{r6(f'd{i}')} AS e{i}" for i in range(3))}, {r6('least(d0, d1, d2) * least(d0, d1, d2)')} AS total_reconstruction_error
FROM (SELECT "user", day, {', '.join(f'{_distance(i)} AS d{i}' for i in range(3))} FROM fixed_scaled)"""
    ),
)
def centre_model_scores(spark, sf_dir):
    """Another reconstruction model in the same place: distances to typical rows."""
    model = stored_model(spark, fixed_model(models.Centres(np.array(CENTRES))))
    scored = models.score_rows(sv.user_days(spark, sf_dir), model, ["user", "day"])
    parts = [F.col("embedding")[i].alias(f"e{i}") for i in range(3)]
    return rounded(scored.select("user", "day", *parts, "total_reconstruction_error"))


# Scores are rounded before they are ranked: what is equal on paper stays equal.
view(
    "fixed_days",
    """SELECT s."user", s.day, round(total_reconstruction_error, 6) AS ae, round(if_anomaly_score, 6) AS iso FROM fixed_scores s""",
)
view("fixed_clean", """SELECT * FROM fixed_days WHERE "user" NOT IN (SELECT "user" FROM win)""")
view(
    "fixed_alerts",
    """SELECT d."user", d.day, (SELECT count(*) FROM fixed_clean c WHERE c.ae < d.ae) / CAST((SELECT count(*) FROM fixed_clean) AS DOUBLE) * 100.0 AS ae_rank,
  (SELECT count(*) FROM fixed_clean c WHERE c.iso < d.iso) / CAST((SELECT count(*) FROM fixed_clean) AS DOUBLE) * 100.0 AS if_rank,
  (SELECT quantile_cont(ae, 0.95) FROM fixed_clean) AS low, (SELECT quantile_cont(ae, 0.99) FROM fixed_clean) AS medium, (SELECT quantile_cont(ae, 0.995) FROM fixed_clean) AS high, ae
FROM fixed_days d""",
)


@query(
    "fixed_model_alerts",
    with_views(
        f"""SELECT "user", day, {r6('ae_rank')} AS ae_percentile_rank, {r6('if_rank')} AS if_percentile_rank, {r6('composite')} AS composite_score,
  CASE WHEN ae <= low THEN 'LOW' WHEN ae <= medium THEN 'MEDIUM' WHEN ae <= high THEN 'HIGH' ELSE 'CRITICAL' END AS ae_risk_band,
  {band_sql('if_rank')} AS if_risk_band, {band_sql('composite')} AS composite_risk_band
FROM (SELECT *, 0.5::DOUBLE * ae_rank + 0.5::DOUBLE * if_rank AS composite FROM fixed_alerts)"""
    ),
)
def fixed_model_alerts(spark, sf_dir):
    """Scores, ceilings and rank indexes calibrated on users without labels, stored; alerts of all user-days."""
    model = stored_model(spark, fixed_model())
    scored = models.score_rows(sv.user_days(spark, sf_dir), model, ["user", "day"])
    scored = scored.withColumns(
        {c: F.round(c, 6) for c in ("total_reconstruction_error", "if_anomaly_score")}
    )
    scored = sinks.stored(spark, scored.drop("embedding"), "scored")
    clean = splits.without_labelled_users(scored, sv.labelled_windows(spark, sf_dir))
    wide = ranking.percentiles(clean, "total_reconstruction_error", [95, 99, 99.5]).first()
    ceilings = {"LOW": wide["p95"], "MEDIUM": wide["p99"], "HIGH": wide["p995"], "CRITICAL": None}
    indexes = []
    for column in ("total_reconstruction_error", "if_anomaly_score"):
        root = scratch_path(spark, "index")
        ranking.build_index(clean, column, root)
        indexes.append(ranking.load_index(spark, root))
    days = sv.user_days(spark, sf_dir).select("user", "day")
    joined = alerts.aligned_join(scored, days, "scores and days")
    table = alerts.alert_table(joined, *indexes, ae_ceilings=ceilings)
    return rounded(
        table.select(
            "user", "day", "ae_percentile_rank", "if_percentile_rank", "composite_score",
            "ae_risk_band", "if_risk_band", "composite_risk_band",
        )
    )


@query(
    "merged_rank_index",
    with_views(f"""SELECT "user", day, {r6('ae_percentile_rank')} AS ae_percentile_rank FROM ranked_recent"""),
)
def merged_rank_index(spark, sf_dir):
    """Ranks from an index that days were added to one third after the other."""
    reference, recent = reference_and_recent(spark, sf_dir)
    root, column = scratch_path(spark, "index"), "total_reconstruction_error"
    for third in range(3):
        part = ranking.build_index(reference.where(F.dayofyear("day") % 3 == third), column)
        known = [ranking.load_index(spark, root)] if third else []
        ranking.merge_indexes([*known, part], root)
    ranked = ranking.load_index(spark, root).ranked(recent, column, "ae_percentile_rank")
    return rounded(ranked.select("user", "day", "ae_percentile_rank"))


@query(
    "live_bands_by_ceilings",
    with_views(
        f"""SELECT "user", strftime(day, '%Y-%m-%d') AS day, {r6('if_anomaly_score')} AS if_anomaly_score, round(if_percentile_rank, 2) + 0.0 AS if_percentile_rank,
  CASE WHEN if_anomaly_score <= 0.5 THEN 'LOW' WHEN if_anomaly_score <= 0.7 THEN 'MEDIUM' WHEN if_anomaly_score <= 0.9 THEN 'HIGH' ELSE 'CRITICAL' END AS if_risk_band FROM ranked_recent"""
    ),
)
def live_bands_by_ceilings(spark, sf_dir):
    """Live records whose bands calibrated ceilings decide, before the percentile."""
    reference, recent = reference_and_recent(spark, sf_dir)
    index = ranking.build_index(reference, "if_anomaly_score")
    records = scoring.live_records(recent, index, [], {"LOW": 0.5, "MEDIUM": 0.7, "HIGH": 0.9, "CRITICAL": None})
    return records.select("user", "day", "if_anomaly_score", "if_percentile_rank", "if_risk_band")


@query(
    "merged_windows",
    with_views(
        """SELECT "user", min(start_day) AS start_day, max(end_day) AS end_day FROM (
  SELECT *, sum(opens) OVER (PARTITION BY "user" ORDER BY start_day, end_day ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT *, CASE WHEN start_day <= max(end_day) OVER (PARTITION BY "user" ORDER BY start_day, end_day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS opens FROM win))
GROUP BY "user", run"""
    ),
)
def merged_windows(spark, sf_dir):
    return splits.merged_windows(sv.labelled_windows(spark, sf_dir))


@query(
    "context_columns",
    with_views("""SELECT "user", day, CAST(n AS DOUBLE) / 2 AS n_zscore, CAST(cents AS DOUBLE) AS cents_rolling_delta FROM user_day"""),
)
def context_columns(spark, sf_dir):
    """Keys with the z-score and delta columns of a wide table, and no others."""
    rows = sv.user_days(spark, sf_dir).select(
        "*", (F.col("n").cast("double") / 2).alias("n_zscore"), F.col("cents").cast("double").alias("cents_rolling_delta")
    )
    return alerts.context_columns(rows)


@query(
    "day_moments",
    with_views(
        f"""SELECT count(*) AS n, {', '.join(f'{r6(f"avg({c})")} AS mean_{c}' for c in COUNTS)},
  {', '.join(f'{r6(f"covar_pop({a}, {b}) * count(*)")} AS p_{a}_{b}' for i, a in enumerate(COUNTS) for b in COUNTS[i:])} FROM user_day"""
    ),
)
def day_moments(spark, sf_dir):
    """Moments kept by day and merged: those of all rows."""
    by_day = sinks.stored(spark, models.moments(sv.user_days(spark, sf_dir), COUNTS, ["day"]), "moments")
    row, size = models.merged_moments(by_day.drop("day")), len(COUNTS)
    cells = [F.col("mean")[i].alias(f"mean_{c}") for i, c in enumerate(COUNTS)]
    cells += [F.col("products")[i * size + j].alias(f"p_{COUNTS[i]}_{COUNTS[j]}") for i in range(size) for j in range(i, size)]
    return rounded(row.select("n", *cells))


@query(
    "written_by_user",
    with_views("""SELECT "user", day, n FROM user_day WHERE "user" = 'u3'"""),
)
def written_by_user(spark, sf_dir):
    """One user's rows of a table in the layout of user reads."""
    path = sinks.write_by_user(sv.user_days(spark, sf_dir).select("user", "day", "n", "cents"), scratch_path(spark, "by_user"), 4)
    return logs.read_user_detail(spark.read.parquet(path), "u3", ["user", "day", "n"])


@query(
    "exported_csv",
    with_views(f"""SELECT "user", day, n, {r6('CAST(cents AS DOUBLE) / 100')} AS amount FROM user_day"""),
)
def exported_csv(spark, sf_dir):
    """Rows exported as text and read back."""
    path = scratch_path(spark, "export")
    rows = sv.user_days(spark, sf_dir).select("user", "day", "n", (F.col("cents") / 100).alias("amount"))
    serving.export_csv(rows, path)
    return rounded(spark.read.schema("user string, day date, n bigint, amount double").option("header", True).csv(path))


@query(
    "feature_matrix",
    with_views(f"""SELECT {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in COUNTS)}, CAST(sum(n) AS BIGINT) AS n FROM user_day"""),
)
def feature_matrix(spark, sf_dir):
    """Sums of the columns that a model takes from a table with keys and names beside them."""
    rows = sv.user_days(spark, sf_dir).withColumn("employee_name", F.col("user"))
    features = cleaning.feature_columns(rows, ["user", "day", "employee_name", "cents"])
    return rows.agg(*[F.sum(f).alias(f) for f in features])
