"""Alert rows and multi-day cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daywatch import fixed
from daywatch.functions import bands, naming
from daywatch.operators.ranking import RankIndex, percentile_ranks
from daywatch.sources.sinks import stored

Ceilings = dict[str, float | Column | None]


def top_contributors(contributions: Column, k: int = 3) -> Column:
    """The k largest entries of a map, ties by name, as array<struct<feature, value>>."""
    ranked = F.sort_array(
        F.transform(F.map_entries(contributions), lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("feature")))
    )
    return F.transform(
        F.slice(ranked, 1, k), lambda e: F.struct(e["feature"].alias("feature"), (-e["minus"]).alias("value"))
    )


def fixed_point(value: Column, pattern: str) -> Column:
    """Decimal text rounded half to even on the exact binary value."""
    return F.call_function("format_number", value, F.lit(pattern))


def driver_text(item: Column, z: Column, delta: Column) -> Column:
    """One contributor with z-score and delta from the given maps where they have it."""
    own_z, own_delta = z[item["feature"]], delta[item["feature"]]
    share = fixed_point(item["value"], "0.00")
    change = F.coalesce(
        F.concat(F.lit(", "), fixed_point(own_delta, "+0.0;-0.0"), F.lit(" vs 5-day avg")), F.lit("")
    )
    detailed = F.concat(
        item["feature"], F.lit(" (z="), fixed_point(own_z, "0.0"), change, F.lit(", contrib="), share, F.lit(")")
    )
    return F.coalesce(detailed, F.concat(item["feature"], F.lit(" ("), share, F.lit(")")))


def explanation(z: Column, delta: Column) -> Column:
    """The alert text from the columns of the alert row and the two context maps."""

    def rank(name: str) -> Column:
        return fixed_point(F.col(name), "0.0")

    drivers = F.array_join(F.transform("top_contributors", lambda item: driver_text(item, z, delta)), "; ")
    return F.concat(
        F.lit("AE deviation at "), rank("ae_percentile_rank"), F.lit("th pct ("), F.col("ae_risk_band"),
        F.lit("); IF anomaly at "), rank("if_percentile_rank"), F.lit("th pct ("), F.col("if_risk_band"),
        F.lit("). Composite: "), F.col("composite_risk_band"), F.lit(" ("), rank("composite_score"),
        F.lit("th pct). Drivers: "), drivers,
    )


def alert_table(
    scored: DataFrame,
    ae_baseline: DataFrame | RankIndex,
    if_baseline: DataFrame | RankIndex,
    ae_ceilings: Ceilings | None = None,
    if_ceilings: Ceilings | None = None,
    thresholds: dict[str, float] | None = None,
    w1: float = 0.5,
    w2: float = 0.5,
    top_k: int = 3,
) -> DataFrame:
    """Alerts from rows with ``total_reconstruction_error``, ``if_anomaly_score``, a
    ``contributions`` map and optional ``zscores`` / ``deltas`` maps.

    Signals are ranked against their baselines (rows with the same column names, or stored
    indexes of them) and banded by calibrated ceilings when given, else by percentile; the composite always by
    percentile.
    """
    bands.check_weights(w1, w2)
    ranked = percentile_ranks(
        scored,
        {
            "ae_percentile_rank": ("total_reconstruction_error", ae_baseline, "total_reconstruction_error"),
            "if_percentile_rank": ("if_anomaly_score", if_baseline, "if_anomaly_score"),
        },
    )

    def band(score: str, rank: str, ceilings: Ceilings | None) -> Column:
        if ceilings is not None:
            return bands.band_of_score(F.col(score), ceilings)
        return bands.band_of_percentile(F.col(rank), thresholds)

    no_context = F.lit(None).cast("map<string,double>")
    z = F.col("zscores") if "zscores" in scored.columns else no_context
    delta = F.col("deltas") if "deltas" in scored.columns else no_context
    return (
        ranked.withColumns(
            {
                "ae_risk_band": band("total_reconstruction_error", "ae_percentile_rank", ae_ceilings),
                "if_risk_band": band("if_anomaly_score", "if_percentile_rank", if_ceilings),
                "top_contributors": top_contributors(F.col("contributions"), top_k),
                "composite_score": bands.composite(F.col("ae_percentile_rank"), F.col("if_percentile_rank"), w1, w2),
            }
        )
        .withColumn("composite_risk_band", bands.band_of_percentile(F.col("composite_score"), thresholds))
        .withColumn("both_signals_high", bands.both_high(F.col("ae_risk_band"), F.col("if_risk_band")))
        .withColumn("explanation", explanation(z, delta))
        .select(
            "user", "day", "ae_percentile_rank", "ae_risk_band", "top_contributors", "if_anomaly_score",
            "if_percentile_rank", "if_risk_band", "composite_score", "composite_risk_band",
            "both_signals_high", "explanation",
        )
    )


def case_rows(alerts: DataFrame, window_days: int = 7, min_risk: str = "HIGH") -> DataFrame:
    """Alert rows at or above ``min_risk`` with a case number per user.

    A gap of more than ``window_days`` opens a new case. One row per user and day,
    so a user's window is bounded by the calendar.
    """
    if min_risk not in fixed.BANDS:
        raise ValueError(f"min_risk must be one of {fixed.BANDS}, not {min_risk!r}")
    kept = alerts.where(bands.severity(F.col("composite_risk_band")) >= fixed.BANDS.index(min_risk))
    order = Window.partitionBy("user").orderBy("day")
    gap = F.date_diff("day", F.lag("day").over(order))
    opens = F.coalesce(gap > window_days, F.lit(True)).cast("int")
    return kept.withColumn("_opens", opens).withColumn(
        "case_id", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ).drop("_opens")


def case_table(
    alerts: DataFrame,
    window_days: int = 7,
    min_risk: str = "HIGH",
    thresholds: dict[str, float] | None = None,
) -> DataFrame:
    """One row per user and case, most severe first, then by peak score, user and start."""
    rows = case_rows(alerts, window_days, min_risk)
    case = Window.partitionBy("user", "case_id")
    rows = rows.withColumn("_at", F.row_number().over(case.orderBy("day")) - 1).withColumn(
        "_half", F.floor(F.count(F.lit(1)).over(case) / 2)
    )
    later = F.avg(F.when(F.col("_at") >= F.col("_half"), F.col("composite_score")))
    earlier = F.avg(F.when(F.col("_at") < F.col("_half"), F.col("composite_score")))
    trend = (
        F.when(F.count(F.lit(1)) <= 1, "SINGLE_DAY").when(later > earlier, "ESCALATING").otherwise("DE-ESCALATING")
    )
    cases = rows.groupBy("user", "case_id").agg(
        F.min("day").alias("case_start"),
        F.max("day").alias("case_end"),
        F.count(F.lit(1)).alias("anomalous_days"),
        F.max("composite_score").alias("max_composite"),
        F.avg("composite_score").alias("mean_composite"),
        F.max("ae_percentile_rank").alias("peak_ae_percentile"),
        F.max("if_percentile_rank").alias("peak_if_percentile"),
        F.count_if("both_signals_high").alias("confirmed_days"),
        trend.alias("trend"),
    )
    return (
        cases.drop("case_id")
        .withColumn("case_risk_band", bands.band_of_percentile(F.col("max_composite"), thresholds))
        .orderBy(
            bands.severity(F.col("case_risk_band")).desc(), F.desc("max_composite"), "user", "case_start"
        )
    )


def context_columns(df: DataFrame) -> DataFrame:
    """Keys with all z-score and delta columns."""
    return df.select("user", "day", *naming.suffix_columns(df.columns))


def context_maps(df: DataFrame, features: list[str]) -> DataFrame:
    """Keys with ``zscores`` and ``deltas`` maps from wide columns."""

    def gathered(suffix: str) -> Column:
        present = [f for f in features if f"{f}{suffix}" in df.columns]
        return F.map_from_arrays(
            F.array(*[F.lit(f) for f in present]), F.array(*[F.col(f"{f}{suffix}").cast("double") for f in present])
        )

    return df.select(
        "user", "day", gathered("_zscore").alias("zscores"), gathered("_rolling_delta").alias("deltas")
    )


def aligned_join(left: DataFrame, right: DataFrame, what: str = "tables") -> DataFrame:
    """Inner join on (user, day) of tables that must hold exactly the same keys; else an error with the counts."""
    keys = ["user", "day"]
    joined = stored(left.sparkSession, left.join(right, keys), "aligned")
    sides = [
        d.select(F.lit(i).alias("side"))
        for i, d in enumerate((left.select(*keys), right.select(*keys), joined.select(*keys)))
    ]
    counts = dict.fromkeys(range(3), 0)
    tally = sides[0].unionByName(sides[1]).unionByName(sides[2]).groupBy("side").count()
    counts.update({row["side"]: row["count"] for row in tally.collect()})
    if len(set(counts.values())) != 1:
        raise ValueError(f"{what} do not align: left={counts[0]}, right={counts[1]}, joined={counts[2]}")
    return joined
