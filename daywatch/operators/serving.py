"""Queries behind the analyst views, over the serving table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daywatch import fixed
from daywatch.functions import bands, naming
from daywatch.operators.ranking import percentiles, row_numbers
from daywatch.operators.triage import with_status

Channels = Mapping[str, list[str]]


def feature_groups(df: DataFrame) -> tuple[list[str], list[str], dict[str, list[str]]]:
    """Raw features, flags and display channels that the table has."""
    have = set(df.columns)
    channels = {name: [f for f in members if f in have] for name, members in fixed.DISPLAY_CHANNELS.items()}
    return (
        [f for f in fixed.RAW_FEATURES if f in have],
        [f for f in fixed.CROSS_FLAGS if f in have],
        {name: members for name, members in channels.items() if members},
    )


def _channels(df: DataFrame, channels: Channels | None) -> Channels:
    return channels if channels is not None else feature_groups(df)[2]


def filtered_slice(df: DataFrame, first: str | None, last: str | None, risk: list[str]) -> DataFrame:
    kept = df.where(F.col("ae_risk_band").isin(risk))
    if first is not None:
        kept = kept.where(F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        kept = kept.where(F.col("day") <= F.lit(last).cast("date"))
    return kept


def _added(values: list[Column]) -> Column:
    total = values[0]
    for v in values[1:]:
        total = total + v
    return total


def _as_rows(df: DataFrame, values: dict[str, Column], keys: list[str], name: str, value: str) -> DataFrame:
    """One row per entry of ``values``, next to the keys."""
    items = [F.struct(F.lit(k).alias(name), v.cast("double").alias(value)) for k, v in values.items()]
    return df.select(*keys, F.inline(F.array(*items)))


def channel_averages(df: DataFrame, channels: Channels | None = None) -> DataFrame:
    """Per channel the sum of its features' means; an empty input gives no rows."""
    channels = _channels(df, channels)
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.avg(f).alias(f) for fs in channels.values() for f in fs]).where("_n > 0")
    return _as_rows(row, {c: _added([F.coalesce(f, F.lit(0.0)) for f in fs]) for c, fs in channels.items()}, [], "channel", "average")


def peer_channel_averages(
    peer_baselines: DataFrame, department: str, first: str | None = None, last: str | None = None,
    channels: Channels | None = None,
) -> DataFrame:
    """The same from the department's daily means, department matched without case."""
    rows = peer_baselines.where(F.upper("department") == department.upper())
    if first is not None:
        rows = rows.where(F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        rows = rows.where(F.col("day") <= F.lit(last).cast("date"))
    return channel_averages(rows, channels)


def channel_time_series(df: DataFrame, channels: Channels | None = None) -> DataFrame:
    """Volume per day and channel."""
    channels = _channels(df, channels)
    daily = df.groupBy("day").agg(*[F.sum(_added([F.col(f) for f in fs])).alias(c) for c, fs in channels.items()])
    return _as_rows(daily, {c: F.col(f"`{c}`") for c in channels}, ["day"], "channel", "volume")


def channel_totals(df: DataFrame, channels: Channels | None = None) -> DataFrame:
    channels = _channels(df, channels)
    row = df.agg(*[F.sum(_added([F.col(f) for f in fs])).alias(c) for c, fs in channels.items()])
    return _as_rows(row, {c: F.col(f"`{c}`") for c in channels}, [], "channel", "total")


def correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """Pearson correlation of every feature pair, all rows in one pass."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = []
    for a, b in pairs:
        for x, y in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(x).alias("feature"), F.lit(y).alias("other"), F.col(f"`{a}|{b}`").alias("correlation")))
    return row.select(F.inline(F.array(*cells)))


def user_bands(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per user and ``by`` columns: rows, rows per band, and count and sum of the scores.

    Such rows add up (``merged_user_bands``): a table by user and day is kept by adding days, and any
    range of days is summed from it.
    """
    band = F.col("ae_risk_band")
    return df.groupBy("user", *(by or [])).agg(
        F.count(F.lit(1)).alias("records"),
        *[F.count_if(band == name).alias(name.lower()) for name in ("CRITICAL", "HIGH", "MEDIUM")],
        F.count("if_anomaly_score").alias("scores"),
        F.sum("if_anomaly_score").alias("score_sum"),
    )


def merged_user_bands(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows of ``user_bands`` added up to coarser ones."""
    sums = [c for c in ("records", "critical", "high", "medium", "scores", "score_sum")]
    return parts.groupBy("user", *(by or [])).agg(*[F.sum(c).alias(c) for c in sums])


def overview(df: DataFrame) -> DataFrame:
    """Users, records, users per band, mean score and share of MEDIUM and above."""
    return overview_of(user_bands(df))


def overview_of(users: DataFrame) -> DataFrame:
    """``overview`` from one row per user: distinct users are counts of rows."""

    def with_any(name: str) -> Column:
        return F.count_if((F.col(name) > 0) & F.col("user").isNotNull())

    total = F.coalesce(F.sum("records"), F.lit(0))
    raised = F.sum(F.col("critical") + F.col("high") + F.col("medium"))
    return users.agg(
        F.count("user").alias("total_users"),
        total.alias("total_records"),
        with_any("critical").alias("critical_users"),
        with_any("high").alias("high_users"),
        with_any("medium").alias("medium_users"),
        F.try_divide(F.sum("score_sum"), F.sum("scores")).alias("avg_anomaly"),
        (F.coalesce(raised, F.lit(0)) * 100.0 / F.greatest(total, F.lit(1))).alias("detection_rate"),
    )


def band_counts(df: DataFrame, band: str = "ae_risk_band") -> DataFrame:
    """Rows per band; a missing band counts as LOW."""
    return df.groupBy(F.coalesce(band, F.lit("LOW")).alias("risk_level")).agg(F.count(F.lit(1)).alias("count"))


def daily_band_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("day", F.col("ae_risk_band").alias("risk_level")).agg(F.count(F.lit(1)).alias("count"))


def score_histogram(
    df: DataFrame, score: str = "if_anomaly_score", band: str = "ae_risk_band", bins: int = 80
) -> DataFrame:
    """Equal-width bins between the extremes of all rows, counted per band."""
    edges = df.agg(F.struct(F.min(score).alias("lo"), F.max(score).alias("hi"))).scalar()
    width = F.col("_e")["hi"] - F.col("_e")["lo"]
    at = F.floor(F.coalesce(F.try_divide(F.col(score) - F.col("_e")["lo"], width), F.lit(0.0)) * bins)
    placed = df.where(F.col(score).isNotNull()).withColumn("_e", edges)
    return placed.groupBy(
        F.coalesce(band, F.lit("LOW")).alias("risk_level"), F.least(at, F.lit(bins - 1)).cast("int").alias("bin")
    ).agg(F.count(F.lit(1)).alias("count"))


def flag_counts(df: DataFrame, flags: list[str] | None = None) -> DataFrame:
    """Per flag how many rows raise it, and their share in percent."""
    flags = flags if flags is not None else feature_groups(df)[1]
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.coalesce(F.sum(f), F.lit(0)).cast("long").alias(f) for f in flags])
    items = [
        F.struct(
            F.lit(f).alias("flag"), F.col(f).alias("count"),
            (F.col(f) * 100.0 / F.greatest("_n", F.lit(1))).alias("percent"),
        )
        for f in flags
    ]
    return row.select(F.inline(F.array(*items)))


def top_users(df: DataFrame, count: int = 10) -> DataFrame:
    """Users with the highest percentile, ties by name."""
    band = F.col("ae_risk_band")
    return (
        df.groupBy("user")
        .agg(
            F.max("ae_percentile_rank").alias("max_percentile"),
            F.count_if(band == "CRITICAL").alias("critical_count"),
            F.count_if(band == "HIGH").alias("high_count"),
        )
        .orderBy(F.desc("max_percentile"), "user")
        .limit(count)
    )


def feature_spread(df: DataFrame, feature: str) -> DataFrame:
    """Box-plot numbers of a feature per band: quartiles, extremes and rows."""
    rows = df.select(F.col("ae_risk_band").alias("risk_level"), F.col(feature).cast("double").alias("v"))
    basics = rows.groupBy("risk_level").agg(
        F.count("v").alias("rows"), F.min("v").alias("min"), F.max("v").alias("max")
    )
    quartiles = percentiles(rows, "v", [25, 50, 75], ["risk_level"]).toDF("risk_level", "q1", "median", "q3")
    return basics.join(quartiles, "risk_level", "left")


def user_risk_summary(df: DataFrame) -> DataFrame:
    band = F.col("ae_risk_band")
    return df.groupBy("user").agg(
        F.max("if_anomaly_score").alias("max_score"),
        F.avg("if_anomaly_score").alias("mean_score"),
        F.max("ae_percentile_rank").alias("max_percentile"),
        F.count_distinct("day").alias("alert_days"),
        F.count_if(band == "CRITICAL").alias("critical_count"),
        F.count_if(band == "HIGH").alias("high_count"),
        F.count_if(band == "MEDIUM").alias("medium_count"),
    )


def risk_ordered_users(df: DataFrame, all_users: DataFrame) -> DataFrame:
    """All users, those with a risk summary first by falling percentile, the rest by name."""
    peaks = df.groupBy("user").agg(F.max("ae_percentile_rank").alias("max_percentile"))
    listed = all_users.select("user").distinct().join(peaks, "user", "left")
    return row_numbers(listed, [F.desc_nulls_last("max_percentile"), "user"], "position")


def disposition_breakdown(df: DataFrame, log: DataFrame) -> DataFrame:
    return with_status(df.select("user", "day"), log).groupBy("status").agg(F.count(F.lit(1)).alias("count"))


FEED_ORDERS = {
    "Highest score first": lambda: [F.desc("ae_percentile_rank")],
    "Lowest score first": lambda: [F.asc("ae_percentile_rank")],
    "Highest severity first": lambda: [F.desc("_severity"), F.desc("ae_percentile_rank")],
    "Lowest severity first": lambda: [F.asc("_severity"), F.desc("ae_percentile_rank")],
    "Most recent first": lambda: [F.desc("day")],
    "Oldest first": lambda: [F.asc("day")],
    "User A-Z": lambda: [F.asc("user")],
    "User Z-A": lambda: [F.desc("user")],
}


def alert_feed(
    df: DataFrame,
    log: DataFrame,
    min_percentile: float = 0.0,
    status: str | None = "NEW",
    order: str = "Highest score first",
    max_rows: int = 500,
    suppressed: bool = False,
) -> DataFrame:
    """The alert list: not suppressed, at or above a percentile, with one triage status, in one of eight orders.

    ``suppressed`` lists the suppressed alerts instead, highest percentile first.
    """
    hidden = F.upper(F.coalesce("status", F.lit(""))) == "SUPPRESSED" if "status" in df.columns else F.lit(False)
    rows = df.where(F.col("ae_percentile_rank") >= min_percentile)
    if suppressed:
        return rows.where(hidden).orderBy(F.desc("ae_percentile_rank"), "user", "day")
    visible = with_status(rows.where(~hidden), log)
    if status is not None:
        visible = visible.where(F.col("status") == status)
    return (
        visible.withColumn("_severity", F.coalesce(bands.severity(F.col("ae_risk_band")), F.lit(-1)))
        .orderBy(*FEED_ORDERS[order](), "user", "day")
        .limit(max_rows)
        .drop("_severity")
    )


def page(df: DataFrame, order: list[Column | str], number: int, size: int = 10) -> DataFrame:
    return df.orderBy(*order).offset(number * size).limit(size)


Order = list[tuple[str, bool]]


def _ordered(order: Order) -> list[Column]:
    return [F.desc(c) if falling else F.asc(c) for c, falling in order]


def write_sorted(df: DataFrame, order: Order, path: str, files: int | None = None) -> str:
    """A copy by ranges of the order, sorted, so that a page's filter skips the row groups before it."""
    keys = _ordered(order)
    placed = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    placed.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
    return path


def page_after(df: DataFrame, order: Order, last: Mapping | None = None, size: int = 10) -> DataFrame:
    """The page that follows the row with the keys ``last`` (the first page without).

    ``order`` names columns that are never null and together unique, each with whether it falls. Rows up
    to the last key are filtered out and the next ``size`` taken, so page 1000 costs what page 1 does;
    nothing is sorted to be skipped.
    """
    rows = df
    if last is not None:
        after, equal = F.lit(False), F.lit(True)
        for column, falling in order:
            value = F.lit(last[column])
            after = after | (equal & (F.col(column) < value if falling else F.col(column) > value))
            equal = equal & (F.col(column) == value)
        first, falling = order[0]
        bound = F.col(first) <= F.lit(last[first]) if falling else F.col(first) >= F.lit(last[first])
        rows = df.where(bound & after)  # the bound alone reaches the scan
    return rows.orderBy(*_ordered(order)).limit(size)


def drill_down(machine_day: DataFrame, user: str, day: str, sort: list[str] | None = None) -> DataFrame:
    rows = machine_day.where((F.col("user") == user) & (F.col("day") == F.lit(day).cast("date")))
    return rows.orderBy(*[F.desc(c) for c in sort]) if sort else rows


def alert_detail(alerts: DataFrame, user: str, day: str) -> DataFrame:
    """Contributors and explanation of one alert; no row when there is none."""
    rows = alerts.where((F.col("user") == user) & (F.col("day") == F.lit(day).cast("date")))
    return rows.select("top_contributors", F.coalesce("explanation", F.lit("")).alias("explanation"))


def contributor_shares(alerts: DataFrame) -> DataFrame:
    """Per alert its contributors in order, each feature once, with phrase and share in percent."""
    items = F.posexplode("top_contributors").alias("position", "c")
    exploded = alerts.select("user", "day", items).select("user", "day", "position", "c.feature", "c.value")
    first = exploded.groupBy("user", "day", "feature").agg(F.min(F.struct("position", "value")).alias("f"))
    return first.select(
        "user", "day", F.col("f.position").alias("position"), "feature",
        naming.phrase_of(F.col("feature")).alias("phrase"), (F.col("f.value") * 100).alias("percent"),
    )


def user_radar(df: DataFrame, peer_baselines: DataFrame, user: str, channels: Channels | None = None) -> DataFrame:
    """Channel averages of one user, the department over the user's days, and everyone."""
    channels = _channels(df, channels)
    own = df.where(F.col("user") == user)
    span = own.agg(
        F.struct(F.min("day").alias("a"), F.max("day").alias("b"), F.max(F.upper("department")).alias("d"))
    ).scalar()
    peers = (
        peer_baselines.withColumn("_s", span)
        .where((F.upper("department") == F.col("_s")["d"]) & F.col("day").between(F.col("_s")["a"], F.col("_s")["b"]))
    )
    mine = channel_averages(own, channels).withColumnRenamed("average", "user_average")
    theirs = channel_averages(peers, channels).withColumnRenamed("average", "peer_average")
    everyone = channel_averages(df, channels).withColumnRenamed("average", "population_average")
    return mine.join(theirs, "channel", "left").join(everyone, "channel", "left").fillna(0.0, ["peer_average"])


def feature_heat(df: DataFrame, user: str, features: list[str] | None = None, days: int = 30) -> DataFrame:
    """One user's last days as (feature, day, value)."""
    features = features if features is not None else feature_groups(df)[0]
    recent = df.where(F.col("user") == user).orderBy(F.desc("day")).limit(days)
    return _as_rows(recent, {f: F.col(f) for f in features}, ["day"], "feature", "value")


def user_extent(df: DataFrame, user: str) -> DataFrame:
    return df.where(F.col("user") == user).agg(
        F.count(F.lit(1)).alias("alerts"), F.min("day").alias("first_day"), F.max("day").alias("last_day")
    )


def bounds(df: DataFrame) -> DataFrame:
    return df.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def users(df: DataFrame) -> DataFrame:
    return df.select("user").distinct().orderBy("user")


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
