"""Versioned tables, compacted logs and stored rank indexes."""

import threading
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from daywatch.operators import ranking, triage
from daywatch.sources import versions

DAY = date(2010, 1, 1)


def test_readers_see_the_old_table_or_the_new_one(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        versions.read(spark, root)
    first = versions.replace(spark.range(10).withColumn("v", F.lit(1)), root)
    pinned = versions.read(spark, root)
    seen, stop = [], threading.Event()

    def watch():
        while not stop.is_set():
            seen.append({tuple(r) for r in versions.read(spark, root).groupBy("v").count().collect()})

    reader = threading.Thread(target=watch)
    reader.start()
    second = versions.replace(spark.range(20).withColumn("v", F.lit(2)), root)
    stop.set()
    reader.join()
    assert (first.number, second.number) == (1, 2)
    assert all(s in ({(1, 10)}, {(2, 20)}) for s in seen) and seen
    assert pinned.count() == 10 and versions.read(spark, root).count() == 20
    assert versions.read(spark, root, first).count() == 10


def test_a_failed_write_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    versions.replace(spark.range(3), root)
    bad = spark.range(5).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        versions.replace(bad, root)
    assert [v.number for v in versions.versions(spark, root)] == [1] and versions.read(spark, root).count() == 3


def test_writers_do_not_overwrite_each_other(spark, tmp_path):
    root = str(tmp_path / "t")
    base = versions.replace(spark.range(1), root)
    versions.replace(spark.range(2), root, base=base)
    with pytest.raises(versions.Conflict):
        versions.replace(spark.range(3), root, base=base)
    assert versions.read(spark, root).count() == 2
    # A taken number is passed over by writers without a base.
    assert not versions._claim(spark, root, versions.Version(2, "x", {}))
    assert versions.replace(spark.range(4), root, about={"why": "w"}).number == 3
    assert versions.current(spark, root).about == {"why": "w"}


def test_old_versions_go(spark, tmp_path):
    root = str(tmp_path / "t")
    for i in range(5):
        versions.replace(spark.range(i), root, keep=2)
    assert [v.number for v in versions.versions(spark, root)] == [4, 5]
    assert len(list((tmp_path / "t" / "data").iterdir())) == 2


def entries(spark, rows):
    return spark.createDataFrame(rows, triage.ENTRY)


def test_compaction_keeps_what_reads_see(spark, tmp_path):
    root, at = str(tmp_path / "log"), datetime(2020, 1, 1)
    assert triage.stored_log(spark, root).count() == 0
    for i in range(40):  # one small file an append
        triage.record(root, entries(spark, [(f"u{i % 7}", DAY, f"S{i}", None, at + timedelta(minutes=i))]).coalesce(1))
    latest = lambda: sorted(map(tuple, triage.latest_dispositions(triage.stored_log(spark, root)).collect()))
    before = latest()
    assert len(before) == 7 and {r[2] for r in before} == {f"S{i}" for i in range(33, 40)}
    triage.compact(spark, root)
    assert latest() == before and triage.stored_log(spark, root).count() == 7
    assert len(triage.stored_log(spark, root).inputFiles()) == 1
    triage.record(root, entries(spark, [("u1", DAY, "LATE", "n", at + timedelta(days=1)), ("u2", DAY, "OLD", "n", at - timedelta(days=1))]).coalesce(1))
    held = triage.stored_log(spark, root)
    after = latest()
    assert after != before and [r[2] for r in after if r[0] == "u1"] == ["LATE"] and [r[2] for r in after if r[0] == "u2"] != ["OLD"]
    triage.compact(spark, root)
    # The first compaction's tail has gone, the second's waits for readers like this one.
    assert latest() == after and held.count() == 9
    assert len(triage._tail(spark, root)) == 1
    triage.compact(spark, root)
    assert latest() == after and not triage._tail(spark, root)


def test_entries_that_arrive_during_a_compaction_are_kept(spark, tmp_path, monkeypatch):
    root, at = str(tmp_path / "log"), datetime(2020, 1, 1)
    triage.record(root, entries(spark, [("u", DAY, "A", "", at)]))
    plain = versions.publish

    def slow(*args, **how):
        triage.record(root, entries(spark, [("u", DAY, "B", "", at + timedelta(hours=1))]))
        return plain(*args, **how)

    monkeypatch.setattr(versions, "publish", slow)
    triage.compact(spark, root)
    assert [r["status"] for r in triage.latest_dispositions(triage.stored_log(spark, root)).collect()] == ["B"]


def expected_ranks(base, values):
    known = np.sort([b for b in base if b is not None])
    return [None if v is None else np.searchsorted(known, v, "left") / len(known) * 100 for v in values]


@pytest.mark.parametrize("held", [ranking.HELD_ENTRIES, 0])
def test_ranks_from_a_stored_index(spark, tmp_path, monkeypatch, held):
    monkeypatch.setattr(ranking, "HELD_ENTRIES", held)
    monkeypatch.setattr(ranking, "PAGE_ENTRIES", 16)
    rng = np.random.default_rng(1)
    base = [None, *rng.normal(size=400).round(2).tolist(), *[0.5] * 200]
    values = [None, -100.0, 100.0, 0.5, *rng.normal(size=50).round(2).tolist(), *rng.normal(size=50).tolist(), min(base[1:]), max(base[1:])]
    rows = spark.createDataFrame([(b,) for b in base], "v double")
    root = str(tmp_path / "index")
    ranking.build_index(rows, "v", root)
    index = ranking.load_index(spark, root)
    assert index.size == 600 and index.entries.select("page").distinct().count() > 5
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(values)], "i int, s double, _below string").repartition(3)
    if held == 0:
        df = df.drop("_below")
    got = index.ranked(df, "s", "rank").orderBy("i").collect()
    want = expected_ranks(base, values)
    assert [r["rank"] for r in got] == [w if w is None else pytest.approx(w, abs=1e-12) for w in want]
    # Two halves merge into the whole; the rank of rows is that of their index.
    halves = [ranking.build_index(rows.where(F.col("v") < 0.3), "v"), ranking.build_index(rows.where("v IS NULL OR v >= 0.3"), "v")]
    merged = ranking.merge_indexes(halves, root)
    assert sorted(map(tuple, merged.entries.collect())) == sorted(map(tuple, index.entries.collect()))
    same = ranking.percentile_ranks(df, {"a": ("s", rows, "v"), "b": ("s", merged, "v")}).collect()
    assert all(r["a"] == r["b"] for r in same)
    empty = ranking.build_index(rows.where("v IS NULL"), "v")
    assert {r["rank"] for r in empty.ranked(df, "s", "rank").collect()} == {None}


def test_a_lookup_neither_sorts_nor_joins(spark):
    index = ranking.build_index(spark.range(1000).select((F.col("id") / 7).alias("v")), "v")
    plan = index.ranked(spark.range(50).select(F.col("id").cast("double").alias("s")), "s", "rank")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert not any(word in text for word in ("Sort", "Join", "Exchange", "Scan parquet"))
