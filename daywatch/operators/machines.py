"""How a user's machines compare with their history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def primary_machine(daily: DataFrame) -> DataFrame:
    """The machine with most rows per user, smallest name on a tie, over the whole history."""
    uses = daily.groupBy("user", "pc").agg(F.count(F.lit(1)).alias("uses"))
    best = F.min(F.struct((-F.col("uses")).alias("rank"), F.col("pc")))
    return uses.groupBy("user").agg(best.alias("best")).select("user", F.col("best.pc").alias("primary_pc"))


def machine_history(daily: DataFrame, min_history: int = 10) -> DataFrame:
    """Adds machine history to a (user, pc, day) table, counting rows in (day, pc) order.

    Windows run over one (user, pc), one (user, day) and one user's day totals.
    None spans all of a user's machine-days, so a service account on very many
    machines is still split by machine and by day.
    """
    of_machine = Window.partitionBy("user", "pc").orderBy("day")
    of_day = Window.partitionBy("user", "day")
    in_day = of_day.orderBy("pc")
    within_day = (
        daily.withColumn("pc_prior_use_count", F.row_number().over(of_machine) - 1)
        .withColumn("_first", (F.col("pc_prior_use_count") == 0).cast("int"))
        .withColumn("_rows_earlier_today", F.row_number().over(in_day) - 1)
        .withColumn(
            "_firsts_earlier_today",
            F.coalesce(
                F.sum("_first").over(in_day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .withColumn("n_pcs_used_today", F.count(F.lit(1)).over(of_day))
        .withColumn("_firsts_today", F.sum("_first").over(of_day))
    )
    earlier_days = Window.partitionBy("user").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = within_day.where("_rows_earlier_today = 0").select(
        "user",
        "day",
        F.coalesce(F.sum("n_pcs_used_today").over(earlier_days), F.lit(0)).alias("_rows_before_today"),
        F.coalesce(F.sum("_firsts_today").over(earlier_days), F.lit(0)).alias("_firsts_before_today"),
    )
    prior_rows = F.col("_rows_before_today") + F.col("_rows_earlier_today")
    return (
        within_day.join(days, ["user", "day"])
        .join(primary_machine(daily), "user")
        .select(
            *daily.columns,
            F.col("pc_prior_use_count").cast("long").alias("pc_prior_use_count"),
            (F.col("pc_prior_use_count") > 0).cast("int").alias("pc_seen_before"),
            F.coalesce(F.try_divide(F.col("pc_prior_use_count"), prior_rows), F.lit(0.0)).alias("pc_prior_use_ratio"),
            (F.col("pc") == F.col("primary_pc")).cast("int").alias("pc_is_primary"),
            (F.col("_firsts_before_today") + F.col("_firsts_earlier_today")).alias("distinct_pcs_used_prior"),
            F.col("n_pcs_used_today"),
            ((F.col("pc_prior_use_count") == 0) & (prior_rows >= min_history))
            .cast("int")
            .alias("new_pc_after_stable_history"),
        )
    )
