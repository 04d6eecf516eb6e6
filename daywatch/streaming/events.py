"""Extension: daily channel features kept up to date from streams of raw events.

The final state equals the batch result; late events within the watermark are included,
and ``dropped_rows`` says how many rows came after it.

``daily_counts`` counts events that satisfy conditions. ``streamed_activity`` and ``keep_days`` keep
all features of the five channels, in two stages. The streaming state holds the activity table:
partial sums per half-hour slot and item, so items are distinct by their key and a day's state
ends with the watermark. Each micro-batch stores the rows it changed, and derives the features of the machine-days
they belong to from their newest rows, by the same expressions as the batch build: off-hours by schedule,
late-night, entropy, peak, longest run and distinct counts.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from daywatch import fixed
from daywatch.operators import channels as ch
from daywatch.sources.sinks import stored

ACTIVITY_KEYS = [*ch.KEYS, "channel", "slot", "item"]


def daily_counts(
    events: DataFrame, flags: dict[str, str], time: str = "ts", delay: str = "1 day"
) -> DataFrame:
    """Counts per user and day of the events that satisfy each SQL condition."""
    return (
        events.withWatermark(time, delay)
        .groupBy(F.window(time, "1 day").alias("w"), "user")
        .agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.expr(cond)).alias(name) for name, cond in flags.items()])
        .select("user", F.to_date("w.start").alias("day"), "n", *flags)
    )


def write_updates(counts: DataFrame, out_path: str, checkpoint: str) -> StreamingQuery:
    """Write the rows each micro-batch changed; see ``current_counts``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return (
        counts.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_counts(updates: DataFrame) -> DataFrame:
    """The newest version of every (user, day)."""
    values = [c for c in updates.columns if c not in ("user", "day", "batch", "batch_id")]
    newest = F.max_by(F.struct(*values), "batch_id").alias("v")
    return updates.groupBy("user", "day").agg(newest).select("user", "day", *[f"v.{c}" for c in values])


def dropped_rows(query: StreamingQuery) -> int:
    """Rows (counts of a micro-batch, per day and user) that came later than the watermark allows."""
    states = [state for progress in query.recentProgress for state in progress.get("stateOperators", [])]
    return sum(state.get("numRowsDroppedByWatermark", 0) for state in states)


def streamed_activity(
    logs: Mapping[str, DataFrame],
    delay: str = "1 day",
    internal_domain: str = fixed.INTERNAL_EMAIL_DOMAIN,
    gap_minutes: int = fixed.RUN_GAP_MINUTES,
) -> DataFrame:
    """The ``activity_table`` of streamed, normalised logs, as rows that change with each micro-batch.

    An event up to ``delay`` behind the newest counts in its day; later ones are dropped with the day's state.
    """
    events = ch.tagged_events(logs, internal_domain, without_machine=True, keep=("timestamp",))
    width = ch.slot_minutes(gap_minutes)
    slot = F.floor(F.col("at") / (width * 60_000_000)).cast("int").alias("slot")
    return (
        events.withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", "1 day").alias("w"), *ch.KEYS, "channel", slot, "item")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("at").alias("first_at"),
            F.max("at").alias("last_at"),
            *[F.sum(c).alias(c) for c in ch.counted(events)],
        )
        .drop("w")
        .withColumn("hour", F.floor(F.col("slot") * width / 60).cast("int"))
    )


def keep_days(
    activity: DataFrame,
    out_path: str,
    checkpoint: str,
    schedules: DataFrame | None = None,
    default_hours: tuple[int, int] = fixed.WORK_HOURS,
    gap_minutes: int = fixed.RUN_GAP_MINUTES,
) -> StreamingQuery:
    """Store what each micro-batch changes of ``streamed_activity`` and of the daily features; see ``current_days``.

    Changed rows lie by day, so a batch reads back only the days it touches. A batch that is retried writes
    its own folders again and reads none but earlier ones.
    """
    channels = [name for name, spec in ch.CHANNELS.items() if set(spec.counts) <= set(activity.columns)]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
        rows.write.mode("overwrite").partitionBy("day").parquet(f"{out_path}/activity/batch={batch_id}")
        changed = spark.read.schema(rows.schema).parquet(f"{out_path}/activity/batch={batch_id}").where("pc IS NOT NULL")
        if changed.isEmpty():  # a batch that only moves the watermark on
            return
        touched = changed.select(*ch.KEYS).distinct()
        # Rows of this batch are the newest there are; only days that came before have others beside them.
        rows = changed.where("user IS NOT NULL AND day IS NOT NULL").drop("batch_id")
        if batch_id and (earlier := _earlier(spark, out_path, batch_id)) is not None:
            days = touched.select("day").distinct()
            before = earlier.join(days, "day", "left_semi").join(touched, ch.KEYS, "left_semi")
            own = rows.select(*[F.col(c).alias(f"_{c}") for c in ACTIVITY_KEYS])
            same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ACTIVITY_KEYS]
            rows = rows.unionByName(before.join(own, same, "left_anti").select(rows.columns))
        daily = ch.daily_from_activity(
            stored(spark, rows, "touched"), channels, ch.KEYS, schedules, default_hours, gap_minutes
        )
        daily.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{out_path}/days/batch={batch_id}")

    return (
        activity.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _newest(updates: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in updates.columns if c not in (*keys, "batch", "batch_id")]
    newest = F.max_by(F.struct(*values), "batch_id").alias("v")
    return updates.groupBy(*keys).agg(newest).select(*keys, *[f"v.{c}" for c in values])


def _earlier(spark: SparkSession, out_path: str, batch_id: int) -> DataFrame | None:
    """The newest version, before a batch, of every row of the streamed activity table; None before the first rows."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    pattern = hadoop.Path(f"{out_path}/activity/batch=*/day=*")
    folders = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    if not any(int(f.getPath().getParent().getName().removeprefix("batch=")) < batch_id for f in folders):
        return None
    return current_activity(spark, out_path, batch_id - 1)


def current_activity(spark: SparkSession, out_path: str, upto: int | None = None) -> DataFrame:
    """The newest version of every row of the streamed activity table, after a batch if given."""
    updates = spark.read.option("basePath", f"{out_path}/activity").parquet(f"{out_path}/activity/batch=*")
    if upto is not None:
        updates = updates.where(F.col("batch") <= upto)
    return _newest(updates, ACTIVITY_KEYS)


def current_days(spark: SparkSession, out_path: str) -> DataFrame:
    """The newest features of every machine-day that ``keep_days`` has stored."""
    return _newest(spark.read.option("basePath", f"{out_path}/days").parquet(f"{out_path}/days/batch=*"), ch.KEYS)
