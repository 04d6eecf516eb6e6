from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from daywatch.functions import bands, naming
from daywatch.operators import alerts, evaluate, ranking

DAY = date(2010, 1, 1)


def column(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def listed(df, expr):
    return [r["o"] for r in df.orderBy("i").select(expr.alias("o")).collect()]


def test_percentile_band_edges(spark):
    df = column(spark, [0.0, 79.99, 80.0, 89.99, 90.0, 94.99, 95.0, 100.0, float("nan"), None])
    want = ["LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL", "CRITICAL", "LOW", "LOW"]
    assert listed(df, bands.band_of_percentile(F.col("v"))) == want
    legacy = {"LOW": 80, "MEDIUM": 90, "HIGH": 95, "CRITICAL": 100}
    assert listed(df, bands.band_of_percentile(F.col("v"), legacy)) == want


@pytest.mark.parametrize("top", [None, float("inf")])
def test_score_band_edges_any_order(spark, top):
    df = column(spark, [0.5, 1.0, 1.01, 2.0, 3.0, 3.01])
    want = ["LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "CRITICAL"]
    assert listed(df, bands.band_of_score(F.col("v"), {"CRITICAL": top, "HIGH": 3, "LOW": 1, "MEDIUM": 2})) == want
    assert listed(df, bands.band_of_score(F.col("v"), {"LOW": 1.0, "MEDIUM": 2.0}))[-1] == "MEDIUM"


def test_weights_must_add_up(spark):
    with pytest.raises(ValueError):
        bands.composite(F.lit(1.0), F.lit(1.0), 0.5, 0.6)
    bands.composite(F.lit(1.0), F.lit(1.0), 0.1 + 0.2, 0.7)


def test_rank_counts_strictly_below(spark):
    base = column(spark, [1.0, 2.0, 2.0, 2.0, 3.0])
    values = column(spark, [0.5, 1.0, 2.0, 2.5, 3.0, 9.0])
    out = ranking.percentile_ranks(values, {"r": ("v", base, "v")})
    assert listed(out, F.col("r")) == [0, 0, 20, 80, 80, 100]


def test_prefix_scan_and_percentiles_match_numpy_with_heavy_ties(spark):
    rng = np.random.default_rng(5)
    values = np.where(rng.random(3000) < 0.35, 7.0, rng.normal(size=3000).round(2))
    df = spark.createDataFrame([("g" if i % 3 else "h", float(v)) for i, v in enumerate(values)], "g string, v double")
    row = ranking.percentiles(df, "v", [0, 12.5, 50, 99.5, 100]).first()
    np.testing.assert_allclose(list(row), np.percentile(values, [0, 12.5, 50, 99.5, 100]), atol=1e-12)
    for r in ranking.percentiles(df, "v", [25, 75], ["g"]).collect():
        mine = values[[i for i in range(3000) if ("g" if i % 3 else "h") == r["g"]]]
        np.testing.assert_allclose([r["p25"], r["p75"]], np.percentile(mine, [25, 75]), atol=1e-12)
    numbers = ranking.row_numbers(df.withColumn("k", F.monotonically_increasing_id()), ["v", "k"], "n")
    assert [r["n"] for r in numbers.orderBy("v", "k").collect()] == list(range(1, 3001))


def scored(spark, rows):
    return spark.createDataFrame(rows, "user string, day date, score double, label int")


def test_metrics_against_brute_force(spark):
    rng = np.random.default_rng(11)
    s, y = rng.integers(0, 20, 400) / 4, (rng.random(400) < 0.2).astype(int)
    df = scored(spark, [("u", DAY, float(a), int(b)) for a, b in zip(s, y)])
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])
    assert evaluate.roc_auc(df).first()[0] == pytest.approx(auc)
    ap, before = 0.0, 0
    for t in sorted(set(s), reverse=True):
        tp = (pos >= t).sum()
        ap += (tp - before) / len(pos) * tp / (s >= t).sum()
        before = tp
    assert evaluate.average_precision(df).first()[0] == pytest.approx(ap)
    ks = max(abs((neg <= t).mean() - (pos <= t).mean()) for t in s)
    shift = evaluate.ks_shift(df.where("label = 0"), df.where("label = 1")).first()
    assert shift["ks_statistic"] == pytest.approx(ks) and 0 <= shift["p_value"] <= 1
    limit = np.percentile(s, 90)
    row = evaluate.confusion(df, df).where("percentile = 90").first()
    assert (row["tp"], row["fp"]) == (((s >= limit) & (y == 1)).sum(), ((s >= limit) & (y == 0)).sum())


def test_metrics_without_positives(spark):
    df = scored(spark, [("u", DAY, 1.0, 0), ("u", DAY, 2.0, 0)])
    assert evaluate.roc_auc(df).first()[0] is None
    assert evaluate.confusion(df, df).where("percentile = 80").first()["recall"] == 0.0


def test_time_to_first_alert_before_window_and_never(spark):
    df = scored(
        spark,
        [("early", DAY, 9.0, 0), ("early", DAY + timedelta(days=5), 9.0, 1), ("quiet", DAY + timedelta(days=5), 1.0, 1)],
    )
    windows = spark.createDataFrame(
        [(u, DAY + timedelta(days=4), DAY + timedelta(days=6), 1) for u in ("early", "quiet")],
        "user string, start_day date, end_day date, scenario int",
    )
    rows = {r["user"]: r for r in evaluate.time_to_first_alert(df, windows, 5.0).collect()}
    assert rows["early"]["days_delta"] == -4 and not rows["early"]["in_window"]
    assert rows["quiet"]["first_alert_day"] is None and rows["quiet"]["days_delta"] is None


def alert_rows(spark, rows):
    return spark.createDataFrame(
        [(u, DAY + timedelta(days=d), s, s, s, bands_name(s), s >= 95) for u, d, s in rows],
        "user string, day date, composite_score double, ae_percentile_rank double, if_percentile_rank double, composite_risk_band string, both_signals_high boolean",
    )


def bands_name(s):
    return "CRITICAL" if s >= 95 else "HIGH" if s >= 90 else "MEDIUM" if s >= 80 else "LOW"


def test_cases(spark):
    rows = [("u", 0, 91.0), ("u", 5, 92.0), ("u", 11, 96.0), ("v", 0, 93.0), ("v", 1, 93.0), ("w", 0, 90.0), ("w", 1, 80.0), ("w", 2, 99.0)]
    cases = alerts.case_table(alert_rows(spark, rows), window_days=5).collect()
    got = {(r["user"], (r["case_start"] - DAY).days): (r["anomalous_days"], r["trend"], r["case_risk_band"], r["confirmed_days"]) for r in cases}
    assert got == {
        ("u", 0): (2, "ESCALATING", "HIGH", 0), ("u", 11): (1, "SINGLE_DAY", "CRITICAL", 1),
        ("v", 0): (2, "DE-ESCALATING", "HIGH", 0), ("w", 0): (2, "ESCALATING", "CRITICAL", 1),
    }
    assert [r["max_composite"] for r in cases] == [99.0, 96.0, 93.0, 92.0]
    empty = alerts.case_table(alert_rows(spark, [("u", 0, 10.0)]))
    assert empty.count() == 0 and "case_risk_band" in empty.columns
    with pytest.raises(ValueError):
        alerts.case_table(alert_rows(spark, rows), min_risk="SEVERE")


def test_explanation_rounds_half_to_even(spark):
    base = spark.createDataFrame([(float(i), i / 100) for i in range(100)], "total_reconstruction_error double, if_anomaly_score double")
    row = spark.createDataFrame(
        [("u", DAY, 25.0, 0.9, {"a": 0.125, "b": 0.625, "c": 0.25}, {"b": 2.25, "c": 1.0}, {"b": -0.04})],
        "user string, day date, total_reconstruction_error double, if_anomaly_score double, contributions map<string,double>, zscores map<string,double>, deltas map<string,double>",
    )
    text = alerts.alert_table(row, base, base).first()["explanation"]
    assert text == (
        "AE deviation at 25.0th pct (LOW); IF anomaly at 90.0th pct (HIGH). Composite: LOW (57.5th pct). "
        "Drivers: b (z=2.2, -0.0 vs 5-day avg, contrib=0.62); c (z=1.0, contrib=0.25); a (0.12)"
    )


def test_aligned_join_reports_mismatch(spark):
    left = spark.createDataFrame([("u", DAY), ("v", DAY)], "user string, day date")
    assert alerts.aligned_join(left, left.withColumn("x", F.lit(1))).count() == 2
    with pytest.raises(ValueError, match="left=2, right=1"):
        alerts.aligned_join(left, left.limit(1).withColumn("x", F.lit(1)))


def test_contributor_text_forms(spark):
    texts = ['[["a_zscore", 0.5], ["b", 0.1]]', "[('a_zscore', 0.5), ('b', 0.1)]", '[{"feature":"a_zscore","value":0.5}]', "['a', 'b']", "", "nonsense", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [[tuple(c) for c in r] for r in listed(df, naming.parse_contributors(F.col("t")))]
    assert got[0] == got[1] == [("a_zscore", 0.5), ("b", 0.1)]
    assert got[2] == [("a_zscore", 0.5)] and got[3] == [("a", None), ("b", None)]
    assert got[4:] == [[], [], []]


def test_sentences(spark):
    lists = [None, [], ["logon_count"], ["x_y", "emails_sent"], ["off_hours_logon", "off_hours_logon_count"], ["a", "b", "c"], ["a", "b", "c", "d"]]
    df = column(spark, lists, "array<string>")
    got = listed(df, naming.alert_sentence(F.col("v")))
    none = "No contributor detail available for this alert."
    assert got == [
        none, none, "This alert is primarily driven by elevated logon frequency.",
        "This alert is mainly driven by x y and high email volume.",
        "This alert is primarily driven by after-hours logon activity.",
        "This alert is mainly driven by a, b, and c.",
        "This alert is mainly driven by a, b, and c, and additional signals.",
    ]
    phrases = listed(column(spark, ["foo_count_zscore", "foo_count_rolling_delta", "foo_rolling_delta", "contribution_logon_count"], "string"), naming.phrase_of(F.col("v")))
    assert phrases == ["unusually high foo count", "sudden spike in foo count", "sudden increase in foo", "elevated logon frequency"]


def test_every_threshold_has_a_row_without_scores_or_windows(spark):
    schema = "user string, day date, score double, label int"
    day = date(2010, 1, 1)
    scored = spark.createDataFrame([("a", day, 1.0, 0), ("b", day, 3.0, 1)], schema)
    windows = spark.createDataFrame([("a", date(2011, 1, 1), date(2011, 1, 2), 1)], "user string, start_day date, end_day date, scenario int")
    rate = {r["percentile"]: tuple(r)[1:] for r in evaluate.user_detection_rate(scored, windows, scored).collect()}
    assert rate == {p: (0, 0, 0.0) for p in rate} and len(rate) == 3
    none = scored.limit(0)
    assert {tuple(r)[1:5] for r in evaluate.confusion(none, scored).collect()} == {(0, 0, 0, 0)}
    assert {r["recall"] for r in evaluate.recall_at_percentiles(none, scored).collect()} == {None}
    assert [tuple(r)[1:] for r in evaluate.alert_volume(none, scored).collect()] == [(0, 0.0, 0, 0.0)] * 3
