from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from daywatch import fixed
from daywatch.operators import live, serving, triage
from daywatch.operators.profiles import clean_directory, latest_profiles, peer_assignment, role_sensitivity, sensitivity_band
from daywatch.plans import build
from daywatch.sources import logs as log_sources
from daywatch.sources import sample_views as sv
from daywatch.sources import sinks

DAY = date(2010, 1, 1)
SAMPLE = "/root/testdata/sf0.001"


def test_missing_logs_are_named_together(spark, tmp_path):
    (tmp_path / "logon.csv").write_text("id,date,user,pc,activity\n1,01/02/2010 07:00:00,A ,PC1,Logon\n")
    with pytest.raises(FileNotFoundError, match="file.csv, device.csv, email.csv, http.csv"):
        log_sources.read_logs(spark, str(tmp_path))
    for name in ("file", "device", "email", "http"):
        (tmp_path / f"{name}.csv").write_text(",".join(["id", *fixed.LOG_COLUMNS[name]]) + "\n")
    logs = log_sources.read_logs(spark, str(tmp_path))
    assert logs["logon"].first()["user"] == "a" and logs["http"].count() == 0


def test_directory_files_and_profiles(spark, tmp_path):
    head = "employee_name,user_id,email,role,department,team,functional_unit,supervisor\n"
    (tmp_path / "2010-01.csv").write_text(head + "Ann, A1 ,x,Director,1 - Accounting,t,f,Bob\nCy,C1,x,Nurse,d,t,f,None\n")
    (tmp_path / "2010-02.csv").write_text(head + "Ann,A1,x,,1 - Accounting,t,f,\n")
    rows = log_sources.read_directory(spark, str(tmp_path))
    assert {r["snapshot"] for r in rows.collect()} == {date(2010, 1, 1), date(2010, 2, 1)}
    got = {r["user"]: r for r in latest_profiles(rows).collect()}
    assert got["a1"]["role"] == "Unknown" and got["a1"]["supervisor"] == "bob" and got["a1"]["is_active"]
    assert got["c1"]["supervisor"] is None and not got["c1"]["is_active"]
    assert {r["user"]: r["role"] for r in peer_assignment(rows).collect()} == {"a1": "Unknown", "c1": "Nurse"}
    with pytest.raises(FileNotFoundError):
        log_sources.read_directory(spark, str(tmp_path / "none"))


def test_finance_floor_needs_a_known_role(spark):
    rows = spark.createDataFrame(
        [("Nurse", "2 - Payroll"), ("Florist", "2 - Payroll"), ("President", "2 - Payroll"), ("Nurse", "x"), (None, "x")], "r string, d string"
    ).select(role_sensitivity(F.col("r"), F.col("d")).alias("s"), sensitivity_band(F.lit(0.7)).alias("b"), sensitivity_band(F.lit(None).cast("double")).alias("n")).collect()
    assert [r["s"] for r in rows] == [0.7, 0.5, 1.0, 0.4, 0.5]
    assert rows[0]["b"] == "HIGH" and rows[0]["n"] is None


def test_windows_file(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_text("dataset, scenario , user,start,end\n6.2,1, ABC ,08/18/2010 21:47:42,8/24/2010 03:48:51\n5.1,2,d,08/18/2010 21:47:42,08/24/2010 03:48:51\n")
    row = log_sources.read_windows(spark, str(path), 6.2).collect()
    assert [tuple(r) for r in row] == [("abc", date(2010, 8, 18), date(2010, 8, 24), 1)]
    assert log_sources.read_windows(spark, str(path)).count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("u/1", DAY, 1.5, ["a"])], "user string, day date, x double, top_contributors array<string>").withColumn("explanation", F.lit("e"))
    sinks.write_table(df, str(tmp_path / "t.csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "t.csv")).first()["x"] == "1.5"
    with pytest.raises(ValueError):
        sinks.write_table(df, str(tmp_path / "t.xlsx"))
    assert dict(sinks.doubles_as_float(df).dtypes)["x"] == "float"
    assert sinks.nested_as_json(df).first()["top_contributors"] == '["a"]'
    sinks.write_user_details(df, str(tmp_path / "details"))
    assert spark.read.parquet(str(tmp_path / "details")).where("user = 'u/1'").count() == 1
    sinks.write_by_user(df, str(tmp_path / "by_user"))
    assert log_sources.read_user_detail(spark.read.parquet(str(tmp_path / "by_user")), "u/1", ["x"]).first()["x"] == 1.5
    assert sinks.convert_csv(spark, str(tmp_path / "t.csv"), str(tmp_path / "p"), "user string, day date, x double, top_contributors string, explanation string")
    assert not sinks.convert_csv(spark, str(tmp_path / "t.csv"), str(tmp_path / "p"), "user string")
    with pytest.raises(Exception):
        sinks.load_items(spark, str(tmp_path / "missing"))
    log_sources.read_split(spark, sinks.write_table(df.withColumn("baseline_complete", F.lit(True)), str(tmp_path / "s"))).first()


def test_dispositions(spark, tmp_path):
    path = str(tmp_path / "log")
    for status, hour in (("NEW", 1), ("RESOLVED", 3), ("INVESTIGATING", 2)):
        entry = [("u", DAY, status, None, datetime(2010, 1, 2, hour))]
        triage.append_disposition(path, spark.createDataFrame(entry, "user string, day date, status string, note string, timestamp timestamp_ntz"))
    log = spark.read.parquet(path)
    row = triage.disposition_of(log, "u", "2010-01-01").collect()
    assert [r["status"] for r in row] == ["RESOLVED"] and row[0]["note"] == ""
    assert triage.disposition_of(log, "u", "2010-01-02").count() == 0
    alerts = spark.createDataFrame([("u", DAY), ("v", DAY)], "user string, day date")
    assert {r["user"]: r["status"] for r in triage.with_status(alerts, log).collect()} == {"u": "RESOLVED", "v": "NEW"}


def test_live_records_skip_bad_lines_and_end(spark, tmp_path):
    path = tmp_path / "live.json"
    path.write_text('{"user":"a","cert_timestamp":"2010-01-05","if_percentile_rank":96.0,"event_index":0}\n{"user":"a","cert\n{"_eos":true}\n')
    lines = spark.read.schema(log_sources.LIVE_SCHEMA).json(str(path)).cache()
    records = live.valid_records(lines)
    assert records.count() == 1 and live.stream_done(lines).first()["done"]
    row = live.progress(records, "2010-01-09").first()
    assert row["rows"] == 1 and row["latest_day"] == date(2010, 1, 9)
    shown = live.live_table(records).first()
    assert shown["ui_risk_band"] == "CRITICAL" and shown["ui_anomaly_score"] is None
    assert live.recent_tail(records, 1).count() == 1


def test_serving_helpers_on_empty_input(spark, tmp_path):
    df = spark.createDataFrame([("u", DAY, 1, "LOW", 1.0, 0.5)], "user string, day date, logon_count int, ae_risk_band string, ae_percentile_rank double, if_anomaly_score double")
    none = df.where("user = 'x'")
    assert serving.channel_averages(none).count() == 0
    assert serving.overview(none).first()["detection_rate"] in (None, 0.0)
    assert serving.score_histogram(df).first()["bin"] == 0
    assert serving.feature_groups(df) == (["logon_count"], [], {"Authentication": ["logon_count"]})
    serving.export_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 1


def test_build_writes_consistent_tables(spark, tmp_path):
    settings = build.BuildSettings(schedule_min_days=3, machine_min_history=3)
    paths = build.build_tables(
        spark, sv.activity_logs(spark, SAMPLE), clean_directory(sv.directory(spark, SAMPLE)), sv.labelled_windows(spark, SAMPLE), str(tmp_path), settings
    )
    user_days = spark.read.parquet(paths["user_days"])
    assert len(user_days.columns) == 414
    parts = sum(spark.read.parquet(paths[p]).count() for p in ("train", "calibration", "test_stream"))
    assert parts == user_days.count() == sv.user_days(spark, SAMPLE).count()
    machine_days = spark.read.parquet(paths["machine_days"])
    assert len(machine_days.columns) == 54 and machine_days.count() == machine_days.select("user", "pc", "day").distinct().count()
    assert spark.read.parquet(paths["peer_baselines"]).count() > 0
    (first,) = user_days.agg(F.min("day")).first()
    assert first + timedelta(days=20) > first


def test_the_detection_run_stores_every_result(spark, tmp_path):
    from daywatch.operators import ranking
    from daywatch.plans import detect
    from daywatch.sources import versions

    windows = sv.labelled_windows(spark, SAMPLE)
    small = build.bl.BaselineWindows(delta=3, z=6, z_min=3, z_long=8, z_long_min=4, short_sum=3, long_sum=5)
    tables = build.build_tables(
        spark, sv.activity_logs(spark, SAMPLE), clean_directory(sv.directory(spark, SAMPLE)), windows, str(tmp_path / "build"),
        build.BuildSettings(schedule_min_days=3, machine_min_history=3, windows=small),
    )
    root = str(tmp_path / "detect")
    found = detect.run(spark, tables, windows, root, detect.DetectionSettings(4, 10, 64, 5, "LOW"))
    clean = log_sources.read_split(spark, tables["calibration_clean"]).count()
    for signal in ("ae", "if"):
        assert ranking.load_index(spark, f"{root}/baseline_{signal}").size == clean > 0
    limits = detect.ceilings(spark, root)
    assert all(limits[s]["LOW"] <= limits[s]["MEDIUM"] <= limits[s]["HIGH"] and limits[s]["CRITICAL"] is None for s in limits)
    total = 0
    for split in detect.SPLITS:
        rows = found[f"alerts_{split}"]
        gated = log_sources.read_split(spark, tables[split]).count()
        total += gated
        assert rows.count() == gated and rows.where("ae_percentile_rank < 0 OR ae_percentile_rank > 100").count() == 0
        worst = rows.where("composite_risk_band <> 'LOW'").count()
        assert found[f"cases_{split}"].agg(F.sum("anomalous_days")).first()[0] in (None, rows.count()) or worst
    serving = found["serving"]
    assert serving.count() == spark.read.parquet(tables["user_days"]).count()
    assert serving.where("if_anomaly_score IS NOT NULL").count() == total
    # A second run publishes new versions beside the ones being read.
    before = versions.current(spark, f"{root}/serving").number
    detect.alert_split(spark, tables, root, "test_stream", detect.DetectionSettings(4, 10, 64))
    detect.serve(spark, tables, root)
    assert versions.current(spark, f"{root}/serving").number == before + 1 and serving.count() > 0
    with pytest.raises(ValueError, match="unknown split"):
        detect.alert_split(spark, tables, root, "other")
