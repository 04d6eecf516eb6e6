"""Exact global ranks, running totals and percentiles without a single-task sort."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daywatch.session import shared_dir, shuffle_width
from daywatch.sources import versions
from daywatch.sources.sinks import stored


def prefix_scan(
    df: DataFrame, order: list[Column | str], measures: list[str], group: list[str] | None = None
) -> DataFrame:
    """Adds ``<measure>_before``: the total over all rows that sort earlier (within the group).

    Rows are range-partitioned by the order and checkpointed, so each knows its
    partition for good. Every partition sums on its own; the partition totals, at
    most one row per partition and group, give the starting offsets. ``order``
    must be unique per group.
    """
    spark, group = df.sparkSession, group or []
    shared_dir(spark)
    placed = (
        df.repartitionByRange(shuffle_width(spark), *group, *order)
        .withColumn("_part", F.spark_partition_id())
        .checkpoint()
    )
    earlier = (Window.unboundedPreceding, -1)
    of_parts = Window.partitionBy(*group).orderBy("_part").rowsBetween(*earlier)
    offsets = placed.groupBy(*group, "_part").agg(*[F.sum(m).alias(m) for m in measures])
    offsets = offsets.select(
        *group, "_part", *[F.coalesce(F.sum(m).over(of_parts), F.lit(0)).alias(f"_off_{m}") for m in measures]
    )
    in_part = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(*earlier)
    inside = placed.select(
        "*", *[F.coalesce(F.sum(m).over(in_part), F.lit(0)).alias(f"_in_{m}") for m in measures]
    )
    return inside.join(offsets, [*group, "_part"]).select(
        *df.columns, *[(F.col(f"_in_{m}") + F.col(f"_off_{m}")).alias(f"{m}_before") for m in measures]
    )


def percentile_ranks(
    values: DataFrame, columns: dict[str, tuple[str, DataFrame | RankIndex, str]]
) -> DataFrame:
    """Adds percentile ranks 0-100: the share of a baseline strictly below each value.

    ``columns`` maps an output name to (value column, baseline, baseline column); a baseline is
    rows or a stored ``RankIndex`` of them. Rows are indexed once, here; the values are then looked
    up, not sorted.
    """
    out = values
    for name, (value, baseline, base) in columns.items():
        index = baseline if isinstance(baseline, RankIndex) else build_index(baseline, base)
        out = index.ranked(out, value, name)
    return out


#: Entries of a rank index that every task may hold, 16 bytes each; a larger one is joined by page.
HELD_ENTRIES = 1_000_000
#: Pages of a rank index at most, and entries of a page at least.
PAGES, PAGE_ENTRIES = 65_536, 4096


@dataclass(frozen=True)
class RankIndex:
    """A baseline's distinct scores with the rows below each, stored by page.

    ``entries`` has ``score, n, below, page`` and rises by score from page to page; ``size`` rows are known.
    """

    entries: DataFrame
    size: int
    distinct: int

    def ranked(self, values: DataFrame, value: str, name: str) -> DataFrame:
        """Add the share of known rows strictly below each value, times 100; null for null or without rows.

        An index of up to ``HELD_ENTRIES`` scores travels to the tasks, and rows stay where they are.
        Of a larger one the distinct values meet their pages by a join, and their ranks the rows.
        """
        if not self.size:
            return values.withColumn(name, F.lit(None).cast("double"))
        if self.distinct <= HELD_ENTRIES:
            held = self.entries.select("score", "below").toPandas().sort_values("score")
            search = _search(values.sparkSession, held["score"].to_numpy(), np.append(held["below"].to_numpy(), self.size))
            return values.withColumn(name, search(F.col(value).cast("double")) / F.lit(self.size) * 100.0)
        shares = self._joined(values.select(F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL").distinct())
        same = F.col(value).cast("double") == F.col("_v")
        return values.join(shares, same, "left").withColumn(name, F.col("_below") / F.lit(self.size) * 100.0).drop("_v", "_below")

    def _joined(self, distinct: DataFrame) -> DataFrame:
        """``_v, _below`` of distinct values, found in their pages."""
        lows = self.entries.groupBy("page").agg(F.min("score").alias("low")).toPandas().sort_values("page")
        page_of = _search(distinct.sparkSession, lows["low"].to_numpy(), np.arange(len(lows) + 1))
        # A value's page is the last that begins below it; of a value below all, the first.
        placed = distinct.withColumn("_page", F.greatest(page_of(F.col("_v")) - 1, F.lit(0)))
        size = self.size

        def find(found: pa.Table, page: pa.Table) -> pa.Table:
            if not found.num_rows:
                return found.select(["_v"]).append_column("_below", pa.array([], pa.int64()))
            scores, below, n = (page.column(c).to_numpy() for c in ("score", "below", "n"))
            order = np.argsort(scores)
            upto = np.append(below[order], below[order[-1]] + n[order[-1]] if len(order) else size)
            at = np.searchsorted(scores[order], found.column("_v").to_numpy(), "left")
            return found.select(["_v"]).append_column("_below", pa.array(upto[at], pa.int64()))

        pages = self.entries.select(F.col("page").cast("long").alias("page"), "score", "below", "n")
        return placed.groupBy("_page").cogroup(pages.groupBy("page")).applyInArrow(find, "_v double, _below long")


def _search(spark: SparkSession, keys: np.ndarray, results: np.ndarray) -> Callable[[Column], Column]:
    """A column function: the result at the number of keys below a value; null for null."""
    held = spark.sparkContext.broadcast((keys.astype(float), results.astype(np.int64)))

    @F.pandas_udf("long")
    def search(value: pd.Series) -> pd.Series:
        keys, results = held.value
        found = pd.Series(results[np.searchsorted(keys, value.to_numpy(float), "left")], index=value.index, dtype="Int64")
        # Of a double column a null arrives as not a number; one that is stays above all.
        return found.mask(value.isna())

    return lambda value: F.when(F.isnan(value), F.lit(int(results[-1]))).otherwise(search(value))


def build_index(rows: DataFrame, column: str, root: str | None = None) -> RankIndex:
    """The index of a column's values that are not null; stored as the next version of ``root``, if given."""
    counts = (
        rows.where(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("double").alias("score"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return _index_of(counts, root)


def merge_indexes(indexes: list[RankIndex], root: str | None = None) -> RankIndex:
    """The index of all rows of several: equal scores add up."""
    stacked = reduce(lambda a, b: a.union(b), [i.entries.select("score", "n") for i in indexes])
    return _index_of(stacked.groupBy("score").agg(F.sum("n").alias("n")), root)


def _index_of(counts: DataFrame, root: str | None) -> RankIndex:
    spark = counts.sparkSession
    scanned = prefix_scan(counts.withColumn("_one", F.lit(1)), ["score"], ["n", "_one"])
    entries = scanned.select("score", "n", F.col("n_before").alias("below"), F.col("_one_before").alias("at"))
    if root is None:
        return _index(stored(spark, entries, "ranks"))
    return load_index(spark, root, versions.replace(entries, root))


def load_index(spark: SparkSession, root: str, version: versions.Version | None = None) -> RankIndex:
    """A stored index: its current version, or a given one."""
    return _index(versions.read(spark, root, version))


def _index(entries: DataFrame) -> RankIndex:
    size, distinct = entries.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    per_page = max(PAGE_ENTRIES, -(-distinct // PAGES))
    page = F.expr(f"CAST(at div {per_page} AS INT)").alias("page")
    return RankIndex(entries.select("score", "n", "below", page), size, distinct)


def percentiles(
    df: DataFrame, value: str, percents: list[float], group: list[str] | None = None
) -> DataFrame:
    """Exact linearly interpolated percentiles, one row (per group) with columns ``p<percent>``."""
    group = group or []
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*group, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    scanned = prefix_scan(counts, ["_v"], ["_n"], group)
    sizes = counts.groupBy(*group).agg(F.sum("_n").alias("_size"))
    if group:
        sized = scanned.join(sizes, group)
    else:
        sized = scanned.withColumn("_size", sizes.scalar())
    first, last = F.col("_n_before"), F.col("_n_before") + F.col("_n")
    picks = []
    for p in percents:
        at = F.col("_size").cast("double") - 1
        position = at * (p / 100.0)
        for side, index in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            picks.append(F.max(F.when((first <= index) & (index < last), F.col("_v"))).alias(f"_{side}_{label(p)}"))
        picks.append(F.max(position - F.floor(position)).alias(f"_frac_{label(p)}"))
    picked = sized.groupBy(*group).agg(*picks)
    return picked.select(
        *group,
        *[
            (
                F.col(f"_lo_{label(p)}")
                + (F.col(f"_hi_{label(p)}") - F.col(f"_lo_{label(p)}")) * F.col(f"_frac_{label(p)}")
            ).alias(label(p))
            for p in percents
        ],
    )


def label(percent: float) -> str:
    """80 -> p80, 99.5 -> p995."""
    return "p" + f"{percent:g}".replace(".", "")


def distribution_summary(df: DataFrame, value: str, percents: tuple[float, ...] = (90, 95, 99, 99.5)) -> DataFrame:
    """Mean, population deviation, extremes and upper percentiles of one column, as one row."""
    basics = df.agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    row = percentiles(df, value, list(percents))
    return basics.withColumn("_p", row.select(F.struct(*row.columns)).scalar()).select(
        "mean", "std", "min", "max", *[F.col("_p")[label(p)].alias(label(p)) for p in percents]
    )


def row_numbers(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """Global 1-based position; ``order`` must be unique."""
    counted = prefix_scan(df.withColumn("_one", F.lit(1)), order, ["_one"])
    return counted.withColumn(name, (F.col("_one_before") + 1).cast("long")).drop("_one", "_one_before")
