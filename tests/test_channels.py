import math
from datetime import datetime, timedelta

from daywatch.functions.cleaning import normalise_log
from daywatch.operators import channels as ch
from daywatch.operators import layers, machines

START = datetime(2010, 1, 4)


def log(spark, rows, columns):
    text = [(t.strftime("%m/%d/%Y %H:%M:%S"), *rest) for t, *rest in rows]
    return normalise_log(spark.createDataFrame(text, "date string, " + columns))


def brute_run(times, gap):
    times = sorted(times)
    best, start = 0.0, times[0]
    for before, now in zip([times[0], *times], times):
        if (now - before).total_seconds() > gap * 60:
            start = now
        best = max(best, (now - start).total_seconds() / 60)
    return best


def test_run_splits_only_beyond_the_gap(spark):
    cases = {
        "exact": [0, 30 * 60], "over": [0, 30 * 60 + 1], "single": [600],
        "chain": [0, 1700, 3500, 5200, 9000, 9100], "midday": [43199, 43200, 44999, 46800],
    }
    rows = [(START + timedelta(seconds=s), user, "pc", "Logon") for user, at in cases.items() for s in at]
    daily = ch.channel_daily({"logon": log(spark, rows, "user string, pc string, activity string")})
    got = {r["user"]: r["logon_longest_active_run_minutes"] for r in daily.collect()}
    assert got == {u: brute_run([START + timedelta(seconds=s) for s in at], 30) for u, at in cases.items()}
    assert got["exact"] == 30.0 and got["over"] == 0.0


def test_slot_width_never_hides_a_gap():
    assert [ch.slot_minutes(g) for g in (1, 7, 25, 30, 59, 60, 240)] == [1, 6, 20, 30, 30, 60, 60]


def test_logon_counts_entropy_and_null_machine(spark):
    at = [(8, "Logon"), (8, "Logoff"), (18, "Logon"), (23, "Logon"), (23, "Logoff")]
    rows = [(START + timedelta(hours=h, minutes=i), "u", "p", a) for i, (h, a) in enumerate(at)]
    rows.append((START, "u", None, "Logon"))
    row = ch.channel_daily({"logon": log(spark, rows, "user string, pc string, activity string")}).collect()
    assert len(row) == 1
    row = row[0]
    assert (row["logon_count"], row["logoff_count"]) == (3, 2)
    assert (row["off_hours_logon"], row["logon_late_night_count"]) == (3, 1)
    shares = [2 / 5, 1 / 5, 2 / 5]
    assert math.isclose(row["logon_hourly_entropy"], -sum(p * math.log(p + 1e-10) for p in shares), abs_tol=1e-12)
    assert row["logon_peak_hour_count"] == 2


def test_file_distinct_counts_once_across_machines(spark):
    rows = [
        (START, "u", "p1", "File Open", "a"), (START, "u", "p2", "File Copy", "a"),
        (START, "u", "p2", "File Copy", "b"), (START, "u", "p2", "File Write", None),
    ]
    logs = {"file": log(spark, rows, "user string, pc string, activity string, filename string")}
    events = ch.tagged_events(logs)
    items = ch.distinct_items(events)
    per_day = ch.distinct_counts(items, ["user", "day"]).collect()[0]
    assert per_day["unique_files_accessed"] == 2
    daily = {r["pc"]: r for r in ch.channel_daily(logs).collect()}
    assert [daily[p]["unique_files_accessed"] for p in ("p1", "p2")] == [1, 2]
    assert daily["p2"]["off_hours_files_accessed"] == 3


def test_schedule_percentiles_truncate_and_fall_back(spark):
    rows = []
    for d in range(3):
        rows += [(START + timedelta(days=d, hours=h), "steady", "p", "Logon") for h in (7, 8, 15)]
        rows += [(START + timedelta(days=d, hours=10), "flat", "p", "Logon")]
    rows += [(START + timedelta(hours=h), "short", "p", "Logon") for h in (1, 23)]
    schedules = {
        r["user"]: tuple(r)[1:]
        for r in ch.work_schedules(log(spark, rows, "user string, pc string, activity string"), 3).collect()
    }
    assert schedules == {"steady": (7, 15, True), "flat": (9, 17, False), "short": (9, 17, False)}


def test_machine_history_matches_row_by_row(spark):
    import random

    rng = random.Random(7)
    rows = sorted({(f"u{rng.randrange(3)}", rng.randrange(12), f"p{rng.randrange(5)}") for _ in range(120)})
    frame = spark.createDataFrame([(u, p, START.date() + timedelta(days=d)) for u, d, p in rows], "user string, pc string, day date")
    got = {(r["user"], r["day"], r["pc"]): r for r in machines.machine_history(frame, 10).collect()}
    for user in ("u0", "u1", "u2"):
        mine = [(d, p) for u, d, p in rows if u == user]
        uses = {p: sum(1 for _, q in mine if q == p) for _, p in mine}
        primary = min(uses, key=lambda p: (-uses[p], p))
        seen: dict[str, int] = {}
        for i, (d, p) in enumerate(mine):
            r = got[user, START.date() + timedelta(days=d), p]
            prior = seen.get(p, 0)
            assert r["pc_prior_use_count"] == prior
            assert r["pc_prior_use_ratio"] == (prior / i if i else 0.0)
            assert r["distinct_pcs_used_prior"] == len(seen)
            assert r["n_pcs_used_today"] == sum(1 for e, _ in mine if e == d)
            assert r["pc_is_primary"] == int(p == primary)
            assert r["new_pc_after_stable_history"] == int(prior == 0 and i >= 10)
            seen[p] = prior + 1


def test_collapse_uses_columns_that_exist(spark):
    frame = spark.createDataFrame(
        [("u", "a", START.date(), 2, 1), ("u", "b", START.date(), 3, 0)],
        "user string, pc string, day date, http_total_requests int, pc_is_primary int",
    )
    row = layers.collapse_to_user_days(frame).collect()[0]
    assert row["http_total_requests"] == 5 and row["pcs_used_count"] == 2
    assert row["non_primary_pc_http_requests_flag"] == 3 and row["non_primary_pc_usb_flag"] == 0
    assert row["primary_pc_activity_ratio"] == 0.5


def test_merge_and_duplicates(spark):
    a = spark.createDataFrame([("u", 1, 2.9)], "user string, day int, x double")
    b = spark.createDataFrame([("v", 1, 4)], "user string, day int, y int")
    rows = {r["user"]: (r["x"], r["y"]) for r in ch.merge_daily([a, b], ["user", "day"]).collect()}
    assert rows == {"u": (2, 0), "v": (0, 4)}
    assert ch.duplicate_keys(a.unionByName(a), ["user", "day"]).count() == 1


def test_hot_machine_day_shrinks_to_slots_and_keeps_every_event(spark):
    import random

    rng = random.Random(3)
    rows = [(START + timedelta(seconds=rng.randrange(86400)), "hot", "p", "Connect") for _ in range(2000)]
    rows += [
        (START + timedelta(days=rng.randrange(5), seconds=rng.randrange(86400)), f"u{rng.randrange(40)}", "p", "Connect")
        for _ in range(4000)
    ]
    logs = {"device": log(spark, rows, "user string, pc string, activity string")}
    slots = ch.time_slots(ch.tagged_events(logs))
    assert slots.where("user = 'hot'").count() <= 48
    daily = {(r["user"], r["day"]): r for r in ch.channel_daily(logs).collect()}
    assert sum(r["usb_insert_count"] for r in daily.values()) == 6000
    hot = [t for t, user, *_ in rows if user == "hot"]
    assert daily["hot", START.date()]["usb_insert_count"] == 2000
    assert math.isclose(daily["hot", START.date()]["device_longest_active_run_minutes"], brute_run(hot, 30))


def test_the_activity_table_gives_what_the_logs_give(spark):
    rng = __import__("random").Random(7)
    rows = [
        (START + timedelta(seconds=rng.randrange(3 * 86_400)), rng.choice(["u", "v", None]), rng.choice(["p", "q", None]), rng.choice(["Logon", "Logoff"]), rng.choice(["a", "b", None]))
        for _ in range(400)
    ]
    logs = {
        "logon": log(spark, [r[:4] for r in rows], "user string, pc string, activity string"),
        "file": log(spark, [(*r[:3], "File Open", r[4]) for r in rows[:200]], "user string, pc string, activity string, filename string"),
    }
    activity = ch.activity_table(logs).cache()
    same = lambda a, b: sorted(map(repr, a.select(b.columns).collect())) == sorted(map(repr, b.collect()))
    events = ch.tagged_events(logs)
    assert same(ch.slots_of(activity), ch.time_slots(events))
    assert same(ch.items_of(activity), ch.distinct_items(events))
    assert same(ch.schedules_from(activity, 2), ch.work_schedules(logs["logon"], 2))


def test_the_build_reads_each_log_once(spark, tmp_path):
    """Only the activity table's plan has the raw files in it, each once."""
    from daywatch.plans import build
    from daywatch.sources import logs as log_sources

    texts = {
        "logon": "activity\n1,01/02/2010 07:00:00,a,p,Logon", "device": "activity\n1,01/02/2010 07:00:00,a,p,Connect",
        "file": "filename,activity\n1,01/02/2010 07:00:00,a,p,f,File Open", "email": "to,attachments\n1,01/02/2010 07:00:00,a,p,x@y.org,",
        "http": "url,activity\n1,01/02/2010 07:00:00,a,p,http://x.org/,WWW Visit",
    }
    for name, rest in texts.items():
        (tmp_path / f"{name}.csv").write_text("id,date,user,pc," + rest + "\n")
    logs = log_sources.read_logs(spark, str(tmp_path))
    raw = ch.activity_table(logs)
    plan = raw._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 5
    table = build.activity(spark, logs)
    machine_days = build.machine_day_table(spark, table, build.BuildSettings())
    for df in (machine_days, ch.items_of(table), build.schedules_of(table, build.BuildSettings())):
        assert not [f for f in df.inputFiles() if f.endswith(".csv")]
    row = machine_days.first()
    assert row["logon_count"] == row["unique_files_accessed"] == row["unique_recipients"] == row["unique_domains_visited"] == 1
