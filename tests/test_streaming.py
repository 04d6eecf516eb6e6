"""The daily counts stream: several micro-batches, late rows, and a count of those too late."""

from pyspark.sql import functions as F

from daywatch.plans.catalog.model_queries import stream_event_files, write_event_files
from daywatch.session import scratch_path
from daywatch.sources import sample_views as sv
from daywatch.streaming import events as event_stream

SAMPLE = "/root/testdata/sf0.001"


def test_batches_and_late_rows(spark):
    events = sv.table(spark, SAMPLE, "events")
    path, out = scratch_path(spark, "events"), scratch_path(spark, "counts")
    write_event_files(events, path)
    query = stream_event_files(spark, path, out)
    query.awaitTermination()
    batches = [p for p in query.recentProgress if p["numInputRows"]]
    assert len(batches) >= 4 and sum(p["numInputRows"] for p in batches) == events.count()
    late = events.where("event_id % 11 = 0").groupBy("user_id", F.to_date("ts").alias("day")).count().orderBy("day")
    first = late.first()["day"]
    assert event_stream.dropped_rows(query) == late.where(F.col("day") == first).count() > 0
    counts = event_stream.current_counts(spark.read.option("basePath", out).parquet(f"{out}/batch=*"))
    kept = events.where((F.col("event_id") % 11 != 0) | (F.to_date("ts") > first)).count()
    assert counts.agg(F.sum("n")).first()[0] == kept


def test_the_end_is_marked_beside_the_batches(spark):
    from daywatch.operators import ranking
    from daywatch.streaming import scoring

    rows, out = scratch_path(spark, "rows"), scratch_path(spark, "scores")
    scores = spark.range(40).select(F.concat(F.lit("u"), F.col("id")).alias("user"), (F.col("id") / 40).alias("if_anomaly_score"))
    scores.repartition(2).write.parquet(rows)
    index = ranking.build_index(scores, "if_anomaly_score")
    source = scoring.row_source(spark, rows, scores.schema)
    query = scoring.score_stream(source, lambda batch: batch, index, out, scratch_path(spark, "stream"))
    assert not scoring.ended(spark, out)
    scoring.score_to_end(spark, out, query)
    assert scoring.ended(spark, out)
    found = spark.read.json(out)
    assert dict(found.dtypes)["batch"] == "int" and found.count() == 40
    assert {r["if_percentile_rank"] for r in found.collect()} == {round(i / 40 * 100, 2) for i in range(40)}


def test_streamed_machine_days_without_the_rows_that_come_too_late(spark, tmp_path):
    """Features of a stream equal those of a batch over the rows that were in time; the others are counted."""
    from datetime import datetime, timedelta

    from daywatch.operators import channels as ch

    start = datetime(2024, 1, 1)
    schema = "user string, pc string, timestamp timestamp, activity string, filename string, day date"

    def rows(days, minute):
        out = []
        for d in days:
            for m in minute:
                at = start + timedelta(days=d, minutes=m)
                out.append((f"u{m % 3}", f"p{m % 2}" if m % 5 else None, at, "File Copy" if m % 2 else "File Open", f"f{m % 7}", at.date()))
        return out

    slices = [rows([0, 1], range(0, 1440, 41)), rows([2, 3], range(3, 1440, 37)) + rows([1], [1437, 1438]), rows([4], range(0, 700, 23)) + rows([3], [5, 11])]
    too_late = rows([0], [100, 101, 102])
    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    for i, part in enumerate([*slices, too_late]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{path}/s{i}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/s*")
    schedules = spark.createDataFrame([("u0", 6, 14, True), ("u1", 9, 17, False)], "user string, start_hour int, end_hour int, schedule_complete boolean")
    query = event_stream.keep_days(event_stream.streamed_activity({"file": source}), out, str(tmp_path / "c"), schedules)
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 4
    assert event_stream.dropped_rows(query) == 3  # a slot, an item and a row each
    log = spark.createDataFrame([r for s in slices for r in s], schema)
    want = ch.channel_daily({"file": log}, schedules=schedules)
    got = event_stream.current_days(spark, out).select(want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert got.where("off_hours_files_accessed > 0 AND unique_files_accessed > 1").count() > 0


def test_a_batch_reads_earlier_batches_only(spark, tmp_path):
    """The rows a batch has just written are the newest as they are; beside them are only those of batches before."""
    from datetime import date

    out = str(tmp_path / "out")
    row = {"user": "u", "pc": "p", "channel": "file", "slot": 1, "hour": 0, "first_at": 1, "last_at": 2}
    schema = "user string, pc string, channel string, slot int, item string, hour int, first_at long, last_at long, n long, batch_id long, day date"
    for batch, items in enumerate([["a", None], ["a"], ["b"]]):
        rows = [{**row, "item": i, "n": batch + 1, "batch_id": batch, "day": date(2024, 1, 1)} for i in items]
        spark.createDataFrame(rows, schema).write.partitionBy("day").parquet(f"{out}/activity/batch={batch}")
    assert event_stream._earlier(spark, out, 0) is None
    assert sorted((str(r["item"]), r["n"]) for r in event_stream._earlier(spark, out, 2).collect()) == [("None", 1), ("a", 2)]
