from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from daywatch.functions import cleaning
from daywatch.operators import channels as ch


def test_normalise_log_parses_tidies_and_drops(spark):
    raw = spark.createDataFrame(
        [
            (1, "01/02/2010 07:08:09", " ABC1 ", "PC-9 ", "Logon"),
            (2, "1/2/2010 7:8:9", "abc1", "pc-9", "Logon"),
            (3, "2010-01-02 07:08:09", "abc1", "pc-9", "Logon"),
            (4, None, "abc1", "pc-9", "Logon"),
            (5, "13/45/2010 07:08:09", "abc1", "pc-9", "Logon"),
        ],
        "ID int, ` Date` string, User string, PC string, activity string",
    )
    out = cleaning.normalise_log(raw)
    assert out.columns == ["timestamp", "user", "pc", "activity", "day"]
    rows = out.collect()
    assert len(rows) == 2
    assert {(r["timestamp"], r["day"], r["user"], r["pc"]) for r in rows} == {
        (datetime(2010, 1, 2, 7, 8, 9), date(2010, 1, 2), "abc1", "pc-9")
    }
    cleaning.require_columns(out, ["user", "pc", "timestamp", "day"])
    with pytest.raises(ValueError, match="missing"):
        cleaning.require_columns(out.drop("pc"), ["user", "pc"])
    with pytest.raises(TypeError):
        cleaning.require_columns(out.withColumn("day", F.col("timestamp")), ["day"])
    with pytest.raises(KeyError):
        cleaning.normalise_log(out.drop("timestamp"))


def test_hour_bounds_belong_to_the_day(spark):
    hours = spark.createDataFrame([(h,) for h in (5, 6, 14, 15, 4, 21, 22)], "hour int")
    rows = hours.select(
        "hour",
        cleaning.outside_hours(F.col("hour"), F.lit(6), F.lit(14)).alias("off"),
        cleaning.late_night(F.col("hour")).alias("late"),
    ).collect()
    assert {r["hour"]: (r["off"], r["late"]) for r in rows} == {
        5: (True, False), 6: (False, False), 14: (False, False), 15: (True, False),
        4: (True, True), 21: (True, False), 22: (True, True),
    }


def test_schedule_lookup_falls_back(spark):
    schedules = spark.createDataFrame(
        [("a", 6, 14, True), ("b", 9, 17, False)], "user string, start_hour int, end_hour int, schedule_complete boolean"
    )
    events = spark.createDataFrame([("a", 7), ("a", 15), ("b", 8), ("c", 18), ("c", 17)], "user string, hour int")
    flags = {(r["user"], r["hour"]): r["off_hours"] for r in ch.off_hours_flags(events, schedules).collect()}
    assert flags == {("a", 7): False, ("a", 15): True, ("b", 8): True, ("c", 18): True, ("c", 17): False}
    assert {r["user"] for r in ch.users_without_schedule(events, schedules).collect()} == {"b", "c"}
    assert {r["user"] for r in ch.users_without_schedule(events, None).collect()} == {"a", "b", "c"}
    with pytest.raises(ValueError):
        ch.off_hours_flags(events.drop("hour"), None)


def test_urls(spark):
    urls = ["HTTPS://Www.Indeed.com:80/x?y ", None, "a.b?q=1", "x" * 89, "x" * 90, "http://[bad/x"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select(
        cleaning.host_before_slash(cleaning.clean_url(F.col("url"))).alias("host"),
        cleaning.network_location(F.col("url")).alias("net"),
        cleaning.is_long_url(cleaning.clean_url(F.col("url"))).alias("long"),
    ).collect()
    assert [r["host"] for r in rows][:3] == ["www.indeed.com:80", "", "a.b?q=1"]
    assert [r["net"] for r in rows][:3] == ["www.indeed.com:80", "", "a.b"]
    assert rows[5]["net"] == ""
    assert [r["long"] for r in rows[3:5]] == [False, True]


def test_external_recipient_is_a_pattern(spark):
    mails = ["x@dtaa.com", "x@dtaaxcom", "a@else.org;b@dtaa.com", "a@else.org", None]
    rows = spark.createDataFrame([(m,) for m in mails], "to string").select(
        cleaning.external_recipient(F.col("to")).alias("e")
    ).collect()
    assert [r["e"] for r in rows] == [False, False, False, True, True]


def test_feature_columns_reject_text(spark):
    df = spark.createDataFrame([("u", 1, 2.0, True)], "user string, a int, b double, baseline_complete boolean")
    assert cleaning.feature_columns(df) == ["a", "b"]
    with pytest.raises(ValueError, match="extra"):
        cleaning.feature_columns(df.withColumn("extra", F.lit("x")))
