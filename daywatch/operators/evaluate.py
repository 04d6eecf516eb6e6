"""Detection quality against labels. Input rows carry ``score`` and ``label`` (0/1)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daywatch.operators.ranking import label as percent_label
from daywatch.operators.ranking import percentiles, prefix_scan, row_numbers

PERCENTS = (80.0, 90.0, 95.0)


def separation_ratio(scored: DataFrame) -> DataFrame:
    """Mean labelled score, mean normal score and their ratio."""
    means = scored.agg(
        F.avg(F.when(F.col("label") == 1, F.col("score"))).alias("mean_labelled"),
        F.avg(F.when(F.col("label") == 0, F.col("score"))).alias("mean_normal"),
    )
    return means.withColumn("ratio", F.try_divide("mean_labelled", "mean_normal"))


def curve(scored: DataFrame) -> DataFrame:
    """One row per distinct score, as a threshold: counts at it, above it, and in total."""
    points = scored.groupBy("score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    total = scored.agg(
        F.struct(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    ).scalar()
    return prefix_scan(points, [F.desc("score")], ["pos", "neg"]).withColumn("_t", total).select(
        "score", "pos", "neg", "pos_before", "neg_before",
        F.col("_t")["p"].alias("positives"), F.col("_t")["n"].alias("negatives"),
    )


def roc_auc(scored: DataFrame) -> DataFrame:
    """Chance that a labelled row scores above a normal one, ties counting half."""
    wins = F.sum(F.col("neg") * (F.col("pos_before") + F.col("pos") / 2))
    pairs = F.max(F.col("positives").cast("double") * F.col("negatives"))
    return curve(scored).agg(F.try_divide(wins, pairs).alias("roc_auc"))


def average_precision(scored: DataFrame) -> DataFrame:
    """Precision at each threshold weighted by the recall gained there."""
    tp = F.col("pos_before") + F.col("pos")
    precision = tp / (tp + F.col("neg_before") + F.col("neg"))
    gain = F.try_divide(F.col("pos"), F.col("positives"))
    return curve(scored).agg(F.sum(gain * precision).alias("average_precision"))


def roc_pr_points(scored: DataFrame) -> DataFrame:
    """False and true positive rate, precision and recall at every distinct score."""
    tp, fp = F.col("pos_before") + F.col("pos"), F.col("neg_before") + F.col("neg")
    recall = F.try_divide(tp, F.col("positives"))
    return curve(scored).select(
        F.col("score").alias("threshold"),
        F.try_divide(fp, F.col("negatives")).alias("fpr"),
        recall.alias("tpr"),
        (tp / (tp + fp)).alias("precision"),
        recall.alias("recall"),
    )


def precision_at_recall(scored: DataFrame, targets: tuple[float, ...] = (0.22, 0.50, 0.80)) -> DataFrame:
    """Best precision among thresholds that reach each recall; the curve's end point (recall 0, precision 1) never helps a positive target."""
    points = roc_pr_points(scored)
    best = points.select("precision", "recall", F.explode(F.array(*[F.lit(t) for t in targets])).alias("target"))
    return best.groupBy("target").agg(
        F.coalesce(F.max(F.when(F.col("recall") >= F.col("target"), F.col("precision"))), F.lit(0.0)).alias("precision")
    )


def thresholds(reference: DataFrame, percents: tuple[float, ...] = PERCENTS, score: str = "score") -> DataFrame:
    """One row per percentile of the reference scores: ``percentile``, ``threshold``."""
    wide = percentiles(reference, score, list(percents))
    pairs = F.array(
        *[F.struct(F.lit(float(p)).alias("percentile"), F.col(percent_label(p)).alias("threshold")) for p in percents]
    )
    return wide.select(F.inline(pairs))


def _at_thresholds(
    scored: DataFrame, reference: DataFrame, percents: tuple[float, ...], measures: Callable[[Column], list[Column]]
) -> DataFrame:
    """``percentile`` and the aggregates of ``measures(flagged)`` for each threshold, in one pass over the scores.

    One row per threshold, also without scores.
    """
    wide = percentiles(reference, "score", list(percents))
    limits = scored.withColumn("_t", wide.select(F.struct(*wide.columns)).scalar())
    rows = [
        F.struct(F.lit(float(p)).alias("percentile"), *measures(F.col("score") >= F.col("_t")[percent_label(p)]))
        for p in percents
    ]
    return limits.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def confusion(
    scored: DataFrame, reference: DataFrame, percents: tuple[float, ...] = PERCENTS
) -> DataFrame:
    """Confusion counts and rates per percentile threshold; a rate without cases is 0."""
    positive = F.col("label") == 1
    counts = _at_thresholds(
        scored, reference, percents,
        lambda hit: [
            F.count_if(~hit & ~positive).alias("tn"),
            F.count_if(hit & ~positive).alias("fp"),
            F.count_if(~hit & positive).alias("fn"),
            F.count_if(hit & positive).alias("tp"),
        ],
    )

    def rate(part: str, other: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part), F.col(part) + F.col(other)), F.lit(0.0))

    return counts.select(
        "*", rate("tp", "fp").alias("precision"), rate("tp", "fn").alias("recall"), rate("fp", "tn").alias("fpr")
    )


def recall_at_percentiles(
    scored: DataFrame, reference: DataFrame | None = None, percents: tuple[float, ...] = PERCENTS
) -> DataFrame:
    """Share of labelled rows flagged, with thresholds from the reference or from the scores themselves."""
    positive = F.col("label") == 1
    return _at_thresholds(
        scored, reference if reference is not None else scored, percents,
        lambda hit: [F.try_divide(F.count_if(hit & positive), F.count_if(positive)).alias("recall")],
    )


def active_windows(scored: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows that overlap the scored period."""
    period = scored.agg(F.struct(F.min("day").alias("first"), F.max("day").alias("last"))).scalar()
    return (
        windows.withColumn("_p", period)
        .where((F.col("start_day") <= F.col("_p")["last"]) & (F.col("end_day") >= F.col("_p")["first"]))
        .drop("_p")
    )


def user_detection_rate(
    scored: DataFrame, windows: DataFrame, reference: DataFrame, percents: tuple[float, ...] = PERCENTS
) -> DataFrame:
    """Of the users with a window in the period, how many have a peak at or above each threshold."""
    users = active_windows(scored, windows).select("user").distinct()
    peaks = scored.groupBy("user").agg(F.max("score").alias("score"))
    watched = users.join(peaks, "user", "left")
    return _at_thresholds(
        watched, reference, percents,
        lambda hit: [
            F.count_if(hit).alias("detected"),
            F.count(F.lit(1)).alias("total_labelled"),
            F.coalesce(F.try_divide(F.count_if(hit), F.count(F.lit(1))), F.lit(0.0)).alias("rate"),
        ],
    )


def alert_volume(scored: DataFrame, reference: DataFrame, percents: tuple[float, ...] = PERCENTS) -> DataFrame:
    """Flagged rows in total and per calendar day, and how many of them are labelled."""
    counts = _at_thresholds(
        scored, reference, percents,
        lambda hit: [
            F.count_if(hit).alias("total_flagged"),
            (F.date_diff(F.max("day"), F.min("day")) + 1).alias("_days"),
            F.count_if(hit & (F.col("label") == 1)).alias("true_positives"),
        ],
    )
    return counts.select(
        "percentile", "total_flagged",
        F.coalesce(F.col("total_flagged") / F.col("_days"), F.lit(0.0)).alias("alerts_per_day"),
        "true_positives",
        F.coalesce(F.try_divide("true_positives", "total_flagged"), F.lit(0.0)).alias("alert_precision"),
    )


def time_to_first_alert(scored: DataFrame, windows: DataFrame, threshold: float | Column) -> DataFrame:
    """Per window in the period: the user's first flagged day relative to the window, and the peak score."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    per_user = scored.withColumn("_limit", limit).groupBy("user").agg(
        F.min(F.when(F.col("score") >= F.col("_limit"), F.col("day"))).alias("first_alert_day"),
        F.max("score").alias("peak_score"),
    )
    return active_windows(scored, windows).join(per_user, "user", "left").select(
        "user", F.col("start_day").alias("threat_start"), "end_day", "first_alert_day",
        F.date_diff("first_alert_day", "start_day").alias("days_delta"),
        F.coalesce(F.col("first_alert_day").between(F.col("start_day"), F.col("end_day")), F.lit(False)).alias("in_window"),
        "peak_score",
    )


def user_ranking(scored: DataFrame, labelled_users: DataFrame) -> DataFrame:
    """Users by peak score, ties by name, with label membership."""
    peaks = scored.groupBy("user").agg(F.max("score").alias("peak_score"))
    ranked = row_numbers(peaks, [F.desc("peak_score"), "user"])
    marks = labelled_users.select("user").distinct().withColumn("_is", F.lit(True))
    return ranked.join(marks, "user", "left").select(
        "rank", "user", "peak_score", F.coalesce("_is", F.lit(False)).alias("is_labelled")
    )


def ks_shift(reference: DataFrame, current: DataFrame, score: str = "score") -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and its asymptotic p-value."""
    both = reference.select(F.col(score).alias("score"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        current.select(F.col(score).alias("score"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    points = both.groupBy("score").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sizes = both.agg(F.struct(F.sum("a").alias("a"), F.sum("b").alias("b"))).scalar()
    scanned = prefix_scan(points, ["score"], ["a", "b"]).withColumn("_n", sizes)
    at = F.abs(
        (F.col("a_before") + F.col("a")) / F.col("_n")["a"] - (F.col("b_before") + F.col("b")) / F.col("_n")["b"]
    )
    result = scanned.agg(F.max(at).alias("ks_statistic"), F.first("_n").alias("_n"))
    effective = F.col("_n")["a"].cast("double") * F.col("_n")["b"] / (F.col("_n")["a"] + F.col("_n")["b"])
    x2 = F.col("ks_statistic") * F.col("ks_statistic") * effective
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x2),
    )
    p = F.when(x2 < 0.04, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))
    return result.select("ks_statistic", p.alias("p_value"))
