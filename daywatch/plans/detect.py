"""The detection run that follows the feature build: every result a stored, versioned table.

Train on normal days, calibrate on the slice without labelled users, then alert, case and serve
each split. Each step reads what the one before has published, so a run can be taken up at any
step and readers keep a whole version while it goes on.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daywatch import fixed
from daywatch.functions import cleaning
from daywatch.operators import alerts, models, ranking, splits
from daywatch.sources import logs, sinks, versions

SPLITS = ("train", "calibration", "test_stream")
SIGNALS = {"ae": "total_reconstruction_error", "if": "if_anomaly_score"}
KEYS = ["user", "day"]


@dataclass(frozen=True)
class DetectionSettings:
    components: int = 16
    trees: int = 200
    sample: int = 256
    case_window_days: int = 5
    case_min_risk: str = "HIGH"


def model_features(table: DataFrame) -> list[str]:
    return cleaning.feature_columns(table, fixed.NON_FEATURE_COLUMNS)


def train(
    spark: SparkSession, tables: Mapping[str, str], windows: DataFrame, root: str, settings: DetectionSettings = DetectionSettings()
) -> models.DetectionModel:
    """Fit on the normal gated rows of the train split; store the model with that split's scores."""
    gated = logs.read_split(spark, tables["train"])
    features = model_features(gated)
    normal = splits.unlabelled_rows(gated, windows)
    model = models.fit_detection(normal, features, KEYS, settings.components, settings.trees, settings.sample)
    models.save_model(spark, model, f"{root}/model", models.score_rows(gated, model, KEYS))
    return model


def calibrate(spark: SparkSession, tables: Mapping[str, str], root: str) -> dict[str, dict[str, float | None]]:
    """Score the clean slice; store both signals' rank indexes and band ceilings."""
    model = models.load_model(spark, f"{root}/model")
    clean = models.score_rows(logs.read_split(spark, tables["calibration_clean"]), model, KEYS)
    clean = sinks.stored(spark, clean.select(*SIGNALS.values()), "clean_scores")
    rows = []
    for signal, column in SIGNALS.items():
        ranking.build_index(clean, column, f"{root}/baseline_{signal}")
        limits = ranking.percentiles(clean, column, list(fixed.CALIBRATION_PERCENTILES.values())).first()
        rows += [(signal, band, limits[ranking.label(p)]) for band, p in fixed.CALIBRATION_PERCENTILES.items()]
        rows.append((signal, "CRITICAL", None))
    versions.replace(spark.createDataFrame(rows, "signal string, band string, ceiling double").coalesce(1), f"{root}/ceilings")
    return ceilings(spark, root)


def ceilings(spark: SparkSession, root: str) -> dict[str, dict[str, float | None]]:
    """The stored band ceilings of each signal."""
    found: dict[str, dict[str, float | None]] = {s: {} for s in SIGNALS}
    for r in versions.read(spark, f"{root}/ceilings").collect():
        found[r["signal"]][r["band"]] = r["ceiling"]
    return found


def scored_split(spark: SparkSession, tables: Mapping[str, str], root: str, split: str) -> DataFrame:
    """Scores of a split under the stored model: those stored with it for train, else computed and stored."""
    version = versions.current(spark, f"{root}/model")
    if split == "train":
        return models.load_scored(spark, f"{root}/model", version)
    model = models.load_model(spark, f"{root}/model", version)
    scored = models.score_rows(logs.read_split(spark, tables[split]), model, KEYS)
    return versions.read(spark, f"{root}/scores_{split}", versions.replace(scored, f"{root}/scores_{split}"))


def alert_split(
    spark: SparkSession, tables: Mapping[str, str], root: str, split: str, settings: DetectionSettings = DetectionSettings()
) -> tuple[DataFrame, DataFrame]:
    """Alerts and cases of a split, stored; scores and context must hold the same user-days."""
    if split not in SPLITS:
        raise ValueError(f"unknown split: {split}")
    rows = logs.read_split(spark, tables[split])
    context = alerts.context_maps(rows, fixed.BASE_FEATURES)
    joined = alerts.aligned_join(scored_split(spark, tables, root, split).drop("embedding"), context, f"scores and context of {split}")
    limits = ceilings(spark, root)
    table = alerts.alert_table(
        joined,
        ranking.load_index(spark, f"{root}/baseline_ae"),
        ranking.load_index(spark, f"{root}/baseline_if"),
        limits["ae"],
        limits["if"],
    )
    table = versions.read(spark, f"{root}/alerts_{split}", versions.replace(table, f"{root}/alerts_{split}"))
    cases = alerts.case_table(table, settings.case_window_days, settings.case_min_risk)
    return table, versions.read(spark, f"{root}/cases_{split}", versions.replace(cases, f"{root}/cases_{split}"))


def serve(spark: SparkSession, tables: Mapping[str, str], root: str) -> DataFrame:
    """The serving table over all splits' alerts, replaced as a whole."""
    found = [versions.read(spark, f"{root}/alerts_{s}") for s in SPLITS]
    every = logs.union_all([f.select(found[0].columns) for f in found])
    table = sinks.serving_table(spark.read.parquet(tables["user_days"]), every)
    return versions.read(spark, f"{root}/serving", versions.replace(table, f"{root}/serving"))


def run(
    spark: SparkSession, tables: Mapping[str, str], windows: DataFrame, root: str, settings: DetectionSettings = DetectionSettings()
) -> dict[str, DataFrame]:
    """All steps over the tables of ``build.build_tables``; the stored results by name."""
    train(spark, tables, windows, root, settings)
    calibrate(spark, tables, root)
    out = {}
    for split in SPLITS:
        out[f"alerts_{split}"], out[f"cases_{split}"] = alert_split(spark, tables, root, split, settings)
    out["serving"] = serve(spark, tables, root)
    return out
