"""Scoring user-day rows as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from daywatch.functions import bands
from daywatch.operators.alerts import Ceilings
from daywatch.operators.ranking import RankIndex, build_index, percentile_ranks

TIME_COLUMNS = ["timestamp", "datetime", "date", "day"]


def row_source(spark, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """Rows of a parquet folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def live_records(
    scored: DataFrame, baseline: DataFrame | RankIndex, passthrough: list[str], ceilings: Ceilings | None = None
) -> DataFrame:
    """Scored rows as output records: identity, source time, rounded score and rank, band, raw features.

    ``baseline`` has the scores ranked against, as rows or as a stored index of them. Calibrated
    ceilings decide the band when given, else the percentile. NaN features become null.
    """
    ranked = percentile_ranks(
        scored, {"if_percentile_rank": ("if_anomaly_score", baseline, "if_anomaly_score")}
    )
    score, rank = F.col("if_anomaly_score"), F.col("if_percentile_rank")
    band = bands.band_of_score(score, ceilings) if ceilings else bands.band_of_percentile(rank)
    time_column = next((c for c in TIME_COLUMNS if c in scored.columns), None)
    kinds = dict(scored.dtypes)
    extras = [c for c in passthrough if c in scored.columns]

    def plain(name: str):
        value = F.col(name)
        if kinds[name] in ("double", "float"):
            value = F.when(~F.isnan(value), value)
        return value.alias(name)

    return ranked.select(
        *[F.col(c).cast("string").alias(c) for c in ("user", "pc", "day") if c in scored.columns],
        *([F.col(time_column).cast("string").alias("cert_timestamp")] if time_column else []),
        F.round(score, 6).alias("if_anomaly_score"),
        F.round(rank, 2).alias("if_percentile_rank"),
        band.alias("if_risk_band"),
        *([F.col("event_index")] if "event_index" in scored.columns else []),
        *[plain(c) for c in extras],
    )


def score_stream(
    source: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    baseline: DataFrame | RankIndex,
    out_path: str,
    checkpoint: str,
    passthrough: list[str] | None = None,
    ceilings: Ceilings | None = None,
) -> StreamingQuery:
    """Score every micro-batch and write its records as JSON until the source is drained.

    ``score`` adds ``if_anomaly_score``. The baseline is indexed once, before the stream begins; a
    micro-batch looks its scores up there and neither sorts the baseline nor checkpoints. A batch
    overwrites its own folder, so a batch that is retried after a failure leaves no duplicates.
    ``mark_end`` leaves the record that tells readers of the folder that the stream is over.
    """
    index = baseline if isinstance(baseline, RankIndex) else build_index(baseline, "if_anomaly_score")

    def write(batch: DataFrame, batch_id: int) -> None:
        records = live_records(score(batch), index, passthrough or [], ceilings)
        records.write.mode("overwrite").json(f"{out_path}/batch={batch_id}")

    return (
        source.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def mark_end(spark, out_path: str) -> None:
    """The end-of-stream record, in a folder beside the batches, so that their numbers stay numbers."""
    spark.range(1).select(F.lit(True).alias("_eos")).coalesce(1).write.mode("overwrite").json(f"{out_path}/_end")


def ended(spark, out_path: str) -> bool:
    """Whether the stream that writes to this folder has left its end-of-stream record."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{out_path}/_end/_SUCCESS")
    return pattern.getFileSystem(spark._jsc.hadoopConfiguration()).exists(pattern)


def score_to_end(spark, out_path: str, query: StreamingQuery) -> None:
    """Wait until the source is drained, then leave the end-of-stream record."""
    query.awaitTermination()
    mark_end(spark, out_path)


def cold_start_notices(source: DataFrame, schedules: DataFrame) -> DataFrame:
    """One row per streamed user without a complete schedule, the first time the user appears."""
    complete = schedules.where("schedule_complete").select("user")
    return source.select("user").where("user IS NOT NULL").join(complete, "user", "left_anti").dropDuplicates(["user"])


def write_notices(notices: DataFrame, out_path: str, checkpoint: str) -> StreamingQuery:
    return (
        notices.writeStream.format("json")
        .option("path", out_path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
