"""Reading the live record stream: tail, per-user view, progress and the live table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daywatch.functions.bands import band_of_percentile


def valid_records(lines: DataFrame) -> DataFrame:
    """Records without unreadable lines and without the end marker."""
    bad = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in lines.columns else F.lit(False)
    end = F.coalesce("_eos", F.lit(False)) if "_eos" in lines.columns else F.lit(False)
    return lines.where(~bad & ~end).drop("_corrupt_record", "_eos")


def stream_done(lines: DataFrame) -> DataFrame:
    return lines.agg(F.coalesce(F.max("_eos"), F.lit(False)).alias("done"))


def recent_tail(records: DataFrame, rows: int = 5000) -> DataFrame:
    """The latest records by arrival."""
    return records.orderBy(F.desc("event_index")).limit(rows)


def worst_of_day(records: DataFrame, user: str) -> DataFrame:
    """One user's record with the highest percentile per day, shaped like the stored rows."""
    own = records.where(F.col("user") == user).withColumn(
        "day", F.to_date(F.col("cert_timestamp").try_cast("timestamp_ntz"))
    )
    worst = F.max(F.struct("if_percentile_rank", (-F.col("event_index")).alias("order"), "if_anomaly_score", "if_risk_band"))
    return own.where(F.col("day").isNotNull()).groupBy("day").agg(worst.alias("w")).select(
        F.lit(user).alias("user"), "day",
        F.col("w.if_anomaly_score").alias("if_anomaly_score"),
        F.col("w.if_percentile_rank").alias("ae_percentile_rank"),
        F.upper(F.coalesce("w.if_risk_band", F.lit("LOW"))).alias("ae_risk_band"),
        F.lit(True).alias("live_row"),
    )


def merge_history(history: DataFrame, live: DataFrame, risk: list[str]) -> DataFrame:
    """Stored rows plus live rows for (user, day) pairs the history lacks."""
    stored = history.where(F.col("ae_risk_band").isin(risk))
    fresh = live.where(F.col("ae_risk_band").isin(risk)).join(stored, ["user", "day"], "left_anti")
    return stored.unionByName(fresh, allowMissingColumns=True)


def progress(records: DataFrame, known_until: Column | str) -> DataFrame:
    """Record count and the latest date, never before the stored maximum."""
    last_known = F.lit(known_until).cast("date") if isinstance(known_until, str) else known_until
    latest = F.max(F.to_date(F.col("cert_timestamp").try_cast("timestamp_ntz")))
    counted = records.agg(F.count(F.lit(1)).alias("rows"), latest.alias("_latest")).withColumn("_known", last_known)
    return counted.select("rows", F.greatest("_latest", "_known").alias("latest_day"))


def live_table(records: DataFrame) -> DataFrame:
    """Display columns with fallbacks, band from the composite, newest first and latest arrival on ties."""

    def first_of(*names: str) -> Column:
        for name in names:
            if name in records.columns:
                return F.col(name).try_cast("double")
        return F.lit(None).cast("double")

    composite = first_of("if_percentile_rank", "composite_score")
    order = [F.desc_nulls_last(F.col("cert_timestamp").try_cast("timestamp_ntz"))] if "cert_timestamp" in records.columns else []
    if "event_index" in records.columns:
        order.append(F.desc("event_index"))
    elif "if_percentile_rank" in records.columns:
        order.append(F.desc("if_percentile_rank"))
    shown = records.withColumns(
        {
            "ui_percentile": first_of("ae_percentile_rank", "if_percentile_rank"),
            "ui_anomaly_score": first_of("if_anomaly_score", "anomaly_score"),
            "ui_composite_score": composite,
            "ui_risk_band": band_of_percentile(composite),
        }
    )
    return shown.orderBy(*order) if order else shown
