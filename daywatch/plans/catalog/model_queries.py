"""Queries for scaling, reconstruction, the isolation forest, stored inputs and the streams."""

from __future__ import annotations


from pyspark.sql import functions as F

from daywatch import fixed
from daywatch.functions import cleaning
from daywatch.operators import alerts, channels, explain, models, ranking, splits
from daywatch.plans.catalog.channel_queries import SCHEDULE_DAYS, rounded
from daywatch.plans.catalog.layer_queries import COUNTS, WINDOWS, _channel_features
from daywatch.plans.catalog.registry import query
from daywatch.plans.catalog.risk_queries import cutoff_sql, r6
from daywatch.plans.catalog.sql_views import view, with_views
from daywatch.operators import baselines as bl
from daywatch.session import scratch_path
from daywatch.sources import logs as log_sources
from daywatch.sources import sample_views as sv
from daywatch.sources import sinks
from daywatch.streaming import events as event_stream
from daywatch.streaming import scoring

# --- scaler and error decomposition --------------------------------------------------


@query(
    "standard_scaler",
    with_views(
        "SELECT u.\"user\", day, "
        + ", ".join(r6(f"(CAST({c} AS DOUBLE) - m_{c}) / s_{c}") + f" AS {c}_scaled" for c in COUNTS)
        + " FROM user_day u, (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in COUNTS)
        + f" FROM user_day WHERE day <= {cutoff_sql('user_day', 0.5)})"
    ),
)
def standard_scaler(spark, sf_dir):
    days = sv.user_days(spark, sf_dir)
    fit, _ = splits.chronological_split(days, 0.5)
    scaler = models.fit_scaler(fit, COUNTS)
    out = days.withColumn("_s", models.scaled(scaler))
    return rounded(out.select("user", "day", *[F.col("_s")[i].alias(f"{c}_scaled") for i, c in enumerate(COUNTS)]))


# 64 feature names for the 64 positions of an embedding.
POSITIONS = [*fixed.BASE_FEATURES, *[f"{f}_zscore" for f in fixed.BASE_FEATURES[:13]], "cloud_upload_flag", "usb_file_activity_flag"]
view(
    "cell_errors",
    f"""SELECT vec_id, label, i, list_extract([{', '.join(f"'{p}'" for p in POSITIONS)}], i) AS feature, (x - round(x * 4) / 4) * (x - round(x * 4) / 4) AS e
FROM (SELECT vec_id, label, CAST(i AS INT) AS i, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS i FROM embeddings))""",
)


def embedding_errors(spark, sf_dir):
    """Embeddings against a rounded copy of themselves."""
    vectors = F.col("embedding").cast("array<double>")
    rebuilt = F.transform(vectors, lambda x: F.round(x * 4, 0) / 4)
    return sv.table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", explain.feature_errors(vectors, rebuilt).alias("errors")
    )


@query(
    "reconstruction_error",
    with_views(f"SELECT vec_id, {r6('sum(e)')} AS total_error, round(avg(e), 8) + 0.0 AS mean_error FROM cell_errors GROUP BY vec_id"),
)
def reconstruction_error(spark, sf_dir):
    return embedding_errors(spark, sf_dir).select(
        "vec_id",
        F.round(explain.total_error(F.col("errors")), 6).alias("total_error"),
        F.round(explain.mean_error(F.col("errors")), 8).alias("mean_error"),
    )


@query(
    "contribution_ratios",
    with_views(f"SELECT vec_id, feature, {r6('e / sum(e) OVER (PARTITION BY vec_id)')} AS share FROM cell_errors"),
)
def contribution_ratios(spark, sf_dir):
    errors = F.col("errors")
    shares = explain.as_map(POSITIONS, explain.contribution_ratios(errors, explain.total_error(errors)))
    return rounded(embedding_errors(spark, sf_dir).select("vec_id", F.explode(shares).alias("feature", "share")))


_groups = explain.feature_groups(POSITIONS)
_group_case = " ".join(f"WHEN feature IN ({', '.join(repr(f) for f in fs)}) THEN '{g}'" for g, fs in _groups.items())


@query(
    "group_errors",
    with_views(
        f"""SELECT vec_id, grp, {r6('avg(m)')} AS error FROM (SELECT vec_id, CASE {_group_case} END AS grp, avg(e) AS m FROM cell_errors
GROUP BY vec_id, grp, regexp_replace(feature, '({'|'.join(fixed.FAMILY_SUFFIXES)})$', '')) GROUP BY vec_id, grp"""
    ),
)
def group_errors(spark, sf_dir):
    groups = explain.group_errors("errors", POSITIONS)
    cells = F.array(*[F.struct(F.lit(g).alias("grp"), e.alias("error")) for g, e in groups.items()])
    return rounded(embedding_errors(spark, sf_dir).select("vec_id", F.inline(cells)))


@query(
    "channel_errors_by_label",
    with_views(
        f"""SELECT channel, {r6('avg(e) FILTER (positive = 0)')} AS normal_mse, {r6('avg(e) FILTER (positive = 1)')} AS labelled_mse, {r6('avg(e) FILTER (positive = 1) / avg(e) FILTER (positive = 0)')} AS ratio
FROM (SELECT e, CAST(label = 1 AS INT) AS positive, CASE {' '.join(f"WHEN regexp_matches(feature, '{p}') THEN '{n}'" for n, p in fixed.ERROR_CHANNEL_PATTERNS)} ELSE 'Other' END AS channel FROM cell_errors) GROUP BY channel"""
    ),
)
def channel_errors_by_label(spark, sf_dir):
    rows = embedding_errors(spark, sf_dir).withColumn("label", (F.col("label") == 1).cast("int"))
    return rounded(explain.channel_errors(rows, "errors", POSITIONS))


# --- fitted models (no SQL equivalent; see tests/test_models.py) --------------------------


@query("embedding_projection")
def embedding_projection(spark, sf_dir):
    rows = sv.table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return rounded(models.projection(rows, "embedding").select("vec_id", "label", "p1", "p2"))


@query("forest_scores")
def forest_scores(spark, sf_dir):
    rows = sv.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    forest = models.fit_forest(rows, "v", ["vec_id"])
    scored = rows.select("vec_id", "label", models.anomaly_score(F.col("v"), forest).alias("score"))
    return rounded(scored.withColumn("anomaly", models.anomaly_label(F.col("score"))))


def detection_inputs(spark, sf_dir):
    table = bl.user_baselines(sv.user_days(spark, sf_dir), COUNTS, WINDOWS)
    rows = sinks.stored(spark, table.where("baseline_complete"), "user-days")
    return rows, cleaning.feature_columns(rows, [*fixed.NON_FEATURE_COLUMNS, "cents"])


def fitted(spark, sf_dir):
    """A model fitted on unlabelled early rows, through storage and back, with all gated rows."""
    rows, features = detection_inputs(spark, sf_dir)
    train, _ = splits.chronological_split(rows, 0.7)
    normal = splits.unlabelled_rows(train, sv.labelled_windows(spark, sf_dir))
    model = models.fit_detection(normal, features, ["user", "day"], k=8, trees=100)
    path = scratch_path(spark, "model")
    models.save_model(spark, model, path)
    return rows, features, models.load_model(spark, path)


@query("score_user_days")
def score_user_days(spark, sf_dir):
    rows, _, model = fitted(spark, sf_dir)
    scored = models.score_rows(rows, model, ["user", "day"])
    return rounded(scored.drop("embedding", "contributions"))


@query("detect_and_alert")
def detect_and_alert(spark, sf_dir):
    """Train, calibrate on a clean slice, score, alert: the whole detection on user-days."""
    rows, features, model = fitted(spark, sf_dir)
    scored = sinks.stored(spark, models.score_rows(rows, model, ["user", "day"]), "scored")
    train, recent = splits.chronological_split(scored, 0.7)
    clean = splits.without_labelled_users(train, sv.labelled_windows(spark, sf_dir))

    def ceilings(score: str):
        wide = ranking.percentiles(clean, score, list(fixed.CALIBRATION_PERCENTILES.values()))
        limits = wide.select(F.struct("*")).scalar()
        levels = {b: limits[ranking.label(p)] for b, p in fixed.CALIBRATION_PERCENTILES.items()}
        return {**levels, "CRITICAL": None}

    context = alerts.context_maps(rows, features)
    joined = alerts.aligned_join(recent, context.join(recent.select("user", "day"), ["user", "day"], "left_semi"), "scores and context")
    table = alerts.alert_table(
        joined, clean, clean, ceilings("total_reconstruction_error"), ceilings("if_anomaly_score")
    )
    return rounded(table.withColumn("top_contributors", F.to_json("top_contributors")))


# --- stored inputs: write the text form, read it back -----------------------------------------


@query(
    "read_logs",
    with_views(
        """SELECT channel, "user", count(*) AS rows, count(DISTINCT day) AS days, count(item) AS items FROM (
  SELECT 'logon' AS channel, "user", day, NULL::VARCHAR AS item FROM logon_log UNION ALL SELECT 'file', "user", day, filename FROM file_log
  UNION ALL SELECT 'device', "user", day, NULL FROM device_log UNION ALL SELECT 'email', "user", day, "to" FROM email_log UNION ALL SELECT 'http', "user", day, url FROM http_log)
GROUP BY channel, "user" """
    ),
)
def read_logs(spark, sf_dir):
    folder = scratch_path(spark, "logs")
    for name, log in sv.activity_logs(spark, sf_dir).items():
        text = log.withColumn("date", F.date_format("timestamp", "MM/dd/yyyy HH:mm:ss")).withColumnRenamed("event_id", "id")
        text.select("id", *fixed.LOG_COLUMNS[name]).write.option("header", True).csv(f"{folder}/{name}.csv")
    items = {"file": "filename", "email": "to", "http": "url"}
    parts = [
        log.select(
            F.lit(name).alias("channel"), "user", "day",
            F.col(items[name]).alias("item") if name in items else F.lit(None).cast("string").alias("item"),
        )
        for name, log in log_sources.read_logs(spark, folder).items()
    ]
    return log_sources.union_all(parts).groupBy("channel", "user").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("day").alias("days"), F.count("item").alias("items")
    )


@query("read_directory", with_views("SELECT * FROM directory_clean"))
def read_directory(spark, sf_dir):
    """Snapshots named by month, a folder of parts each."""
    folder = scratch_path(spark, "directory")
    named = sv.directory(spark, sf_dir).withColumn("month", F.date_format("snapshot", "yyyy-MM"))
    for month in ("2024-01", "2024-02"):
        part = named.where(F.col("month") == month).drop("snapshot", "month")
        part.write.option("header", True).csv(f"{folder}/{month}.csv")
    return log_sources.read_directory(spark, folder)


@query(
    "stored_items",
    with_views(
        """SELECT "user", day, count(*) AS items FROM (SELECT DISTINCT "user", pc, day, 'file' AS c, filename AS i FROM file_log WHERE filename IS NOT NULL
UNION ALL SELECT DISTINCT "user", pc, day, 'email', "to" FROM email_log WHERE "to" IS NOT NULL UNION ALL SELECT DISTINCT "user", pc, day, 'http', host FROM http_log) GROUP BY "user", day"""
    ),
)
def stored_items(spark, sf_dir):
    """Distinct items through the restart point."""
    logs = sv.activity_logs(spark, sf_dir)
    events = channels.tagged_events({n: logs[n] for n in ("file", "email", "http")})
    path = sinks.save_items(channels.distinct_items(events), scratch_path(spark, "items"))
    return sinks.load_items(spark, path).groupBy("user", "day").agg(F.count(F.lit(1)).alias("items"))


@query("converted_csv", with_views("""SELECT "user", day, n, cents FROM user_day"""))
def converted_csv(spark, sf_dir):
    csv, parquet = scratch_path(spark, "csv"), scratch_path(spark, "parquet")
    sinks.write_table(sv.user_days(spark, sf_dir).select("user", "day", "n", "cents"), csv, "csv")
    sinks.convert_csv(spark, csv, parquet, "user string, day date, n bigint, cents bigint")
    return spark.read.parquet(parquet)


# --- streams ------------------------------------------------------------------------------------


def streamed_rows(spark, sf_dir):
    """Recent scored days as numbered rows in several files, and the reference scores."""
    reference, recent = splits.chronological_split(sv.scored_days(spark, sf_dir), 0.5)
    numbered = ranking.row_numbers(recent, ["day", "user"], "event_index")
    path = scratch_path(spark, "rows")
    numbered.withColumn("raw", F.when(F.col("n") > 4, F.lit(float("nan"))).otherwise(F.col("n").cast("double"))).repartition(3).write.parquet(path)
    return path, reference


@query(
    "stream_scores",
    with_views(
        f"""SELECT "user", strftime(day, '%Y-%m-%d') AS day, row_number() OVER (ORDER BY day, "user") AS event_index, {r6('if_anomaly_score')} AS if_anomaly_score, round(if_percentile_rank, 2) + 0.0 AS if_percentile_rank,
  CASE WHEN if_percentile_rank >= 95 THEN 'CRITICAL' WHEN if_percentile_rank >= 90 THEN 'HIGH' WHEN if_percentile_rank >= 80 THEN 'MEDIUM' ELSE 'LOW' END AS if_risk_band,
  CASE WHEN n <= 4 THEN CAST(n AS DOUBLE) END AS raw FROM ranked_recent"""
    ),
)
def stream_scores(spark, sf_dir):
    path, reference = streamed_rows(spark, sf_dir)
    schema = spark.read.parquet(path).schema
    out = scratch_path(spark, "scores")
    baseline = sinks.stored(spark, reference.select("if_anomaly_score"), "baseline")
    running = scoring.score_stream(
        scoring.row_source(spark, path, schema), lambda batch: batch, baseline, out, scratch_path(spark, "stream"), ["raw"]
    )
    running.awaitTermination()
    written = spark.read.schema(
        "user string, day string, cert_timestamp string, if_anomaly_score double, if_percentile_rank double, if_risk_band string, event_index bigint, raw double"
    ).json(f"{out}/batch=*")
    return written.select("user", "day", "event_index", "if_anomaly_score", "if_percentile_rank", "if_risk_band", "raw")


@query("stream_model_scores")
def stream_model_scores(spark, sf_dir):
    """The fitted model applied to a stream of user-days, ceilings first."""
    rows, features, model = fitted(spark, sf_dir)
    train, recent = splits.chronological_split(rows, 0.7)
    path, out = scratch_path(spark, "rows"), scratch_path(spark, "scores")
    recent.repartition(2).write.parquet(path)

    def score(batch):
        kept = ["user", "day", "n_file"]
        return models.score_rows(batch, model, kept).select(*kept, "if_anomaly_score")

    baseline = sinks.stored(spark, score(train).select("if_anomaly_score"), "baseline")
    scoring.score_stream(
        scoring.row_source(spark, path, rows.schema), score, baseline, out, scratch_path(spark, "stream"), ["n_file"],
        {"LOW": 0.5, "MEDIUM": 0.6, "HIGH": 0.7, "CRITICAL": None},
    ).awaitTermination()
    return spark.read.schema(
        "user string, day string, cert_timestamp string, if_anomaly_score double, if_percentile_rank double, if_risk_band string, n_file bigint"
    ).json(f"{out}/batch=*")


@query(
    "cold_start_notices",
    with_views("""SELECT DISTINCT "user" FROM recent_rows WHERE "user" NOT IN (SELECT "user" FROM schedules WHERE schedule_complete)"""),
)
def cold_start_notices(spark, sf_dir):
    path, _ = streamed_rows(spark, sf_dir)
    schedules = channels.work_schedules(sv.activity_log(spark, sf_dir, "logon"), SCHEDULE_DAYS)
    schedules = sinks.stored(spark, schedules, "schedules")
    out = scratch_path(spark, "notices")
    source = scoring.row_source(spark, path, spark.read.parquet(path).schema)
    scoring.write_notices(scoring.cold_start_notices(source, schedules), out, scratch_path(spark, "stream")).awaitTermination()
    return spark.read.schema("user string").json(out)


@query(
    "stream_daily_counts",
    with_views(
        """SELECT "user", day, count(*) AS n, count(*) FILTER (event_type = 'click') AS files, count(*) FILTER (event_type = 'view') AS visits
FROM ev WHERE NOT (event_id % 11 = 0 AND day = (SELECT min(day) FROM ev)) GROUP BY "user", day"""
    ),
)
def stream_daily_counts(spark, sf_dir):
    """Raw events in time-ordered files, one a micro-batch; the final state equals the batch counts.

    Some events come a file later, within the watermark, and count; some of the first day
    come last, beyond it, and are dropped.
    """
    path, out = scratch_path(spark, "events"), scratch_path(spark, "counts")
    write_event_files(sv.table(spark, sf_dir, "events"), path)
    stream_event_files(spark, path, out).awaitTermination()
    return event_stream.current_counts(spark.read.option("basePath", out).parquet(f"{out}/batch=*"))


STREAM_DAYS = 5
#: Files of a slice of days, which a trigger takes together.
SLICE_FILES = 2


def slice_of(ts, first, event_id):
    """The slice of ``STREAM_DAYS`` days that an event comes with; in the last quarter day some come with the next."""
    age = (F.unix_micros(ts.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / 86_400_000_000
    late = (F.pmod(age, F.lit(float(STREAM_DAYS))) > STREAM_DAYS - 0.25) & (event_id % 7 == 0)
    return age, F.floor(age / STREAM_DAYS) + F.when(late, 1).otherwise(0)


def write_slices(rows, path):
    """Rows by ``part``, written in one job, ``SLICE_FILES`` files each, dated in the order of the parts."""
    spark = rows.sparkSession
    parts = rows.select("part").distinct().count()
    rows = rows.withColumn("file", F.pmod(F.xxhash64(*rows.columns), F.lit(SLICE_FILES)))
    # A number that is given isn't reduced: every part and file is one task's.
    rows.repartition(max(1, parts * SLICE_FILES), "part", "file").write.partitionBy("part", "file").parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files = fs.globStatus(hadoop.Path(f"{path}/part=*/file=*/*.parquet"))
    begun = min((f.getModificationTime() for f in files), default=0)
    for f in files:  # a few a slice
        part = int(f.getPath().getParent().getParent().getName().removeprefix("part="))
        fs.setTimes(f.getPath(), begun - 10_000_000 + 1000 * min(part, 9000), -1)


def write_event_files(events, path):
    """Slices of ``STREAM_DAYS`` days in order, and a last one with what is far too late."""
    first = events.agg(F.min(F.to_date("ts")).cast("timestamp_ntz")).scalar()
    age, part = slice_of(F.col("ts"), first, F.col("event_id"))
    part = F.when((F.col("event_id") % 11 == 0) & (age < 1), 9000).otherwise(part)
    rows = events.select(
        F.expr("concat('u', user_id)").alias("user"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "event_id", part.cast("int").alias("part")
    )
    write_slices(rows, path)


def stream_event_files(spark, path, out):
    schema = "user string, ts timestamp, event_type string"
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", SLICE_FILES).parquet(f"{path}/part=*/file=*")
    counts = event_stream.daily_counts(source, {"files": "event_type = 'click'", "visits": "event_type = 'view'"})
    return event_stream.write_updates(counts, out, scratch_path(spark, "stream"))


def stream_logs(spark, sf_dir, path):
    """The sample logs as streams of slices, with timestamps as a watermark wants them."""
    streams = {}
    for name, log in sv.activity_logs(spark, sf_dir).items():
        first = sv.table(spark, sf_dir, "events").agg(F.min(F.to_date("ts")).cast("timestamp_ntz")).scalar()
        _, part = slice_of(F.col("timestamp"), first, F.col("event_id"))
        rows = log.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withColumn("part", part.cast("int"))
        write_slices(rows, f"{path}/{name}")
        source = spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", SLICE_FILES)
        streams[name] = source.parquet(f"{path}/{name}/part=*/file=*")
    return streams


@query(
    "stream_machine_days",
    with_views(f"""SELECT "user", pc, day, {', '.join(_channel_features)} FROM aligned"""),
)
def stream_machine_days(spark, sf_dir):
    """All features of the five channels, kept from streams of the logs with late rows: the batch table's."""
    schedules = channels.work_schedules(sv.activity_log(spark, sf_dir, "logon"), SCHEDULE_DAYS)
    schedules = sinks.stored(spark, schedules, "schedules")
    out = scratch_path(spark, "machine_days")
    activity = event_stream.streamed_activity(stream_logs(spark, sf_dir, scratch_path(spark, "logs")))
    event_stream.keep_days(activity, out, scratch_path(spark, "stream"), schedules).awaitTermination()
    days = event_stream.current_days(spark, out)
    return days.select("user", "pc", "day", *[F.col(c).cast("int").alias(c) for c in _channel_features])
