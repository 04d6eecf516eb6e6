from datetime import date, timedelta
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest

from daywatch.operators import baselines as bl
from daywatch.operators import splits

DAY = date(2010, 1, 1)


def test_user_baselines_equal_pandas_windows(spark):
    rng = np.random.default_rng(3)
    rows = []
    for user, days in (("long", 130), ("mid", 40), ("one", 1), ("flat", 60)):
        offset = 0
        for i in range(days):
            offset += int(rng.integers(1, 4))
            value = 3 if user == "flat" else int(rng.integers(0, 50))
            rows.append((user, DAY + timedelta(days=offset), value, float(rng.normal())))
    df = spark.createDataFrame(rows, "user string, day date, n int, x double")
    got = bl.user_baselines(df, ["n", "x"]).toPandas().sort_values(["user", "day"]).reset_index(drop=True)
    pdf = pd.DataFrame(rows, columns=["user", "day", "n", "x"]).sort_values(["user", "day"]).reset_index(drop=True)
    for f in ("n", "x"):
        past = pdf.groupby("user")[f].shift(1).groupby(pdf["user"])

        def roll(window, low, how, past=past):
            return getattr(past.rolling(window, min_periods=low), how)().reset_index(level=0, drop=True)

        for name, window, low in (("zscore", 30, 14), ("zscore_90d", 90, 30)):
            sd = roll(window, low, "std")
            sd = sd.where(sd > 1e-9)
            want = ((pdf[f] - roll(window, low, "mean")) / sd).fillna(0).clip(-10, 10)
            np.testing.assert_allclose(got[f"{f}_{name}"], want, atol=1e-8)
        np.testing.assert_allclose(got[f"{f}_rolling_delta"], (pdf[f] - roll(5, 1, "mean")).fillna(0), atol=1e-9)
        np.testing.assert_allclose(got[f"{f}_7d_sum"], roll(7, 1, "sum"), atol=1e-9)
        month = roll(30, 1, "sum")
        np.testing.assert_allclose(got[f"{f}_30d_sum"], month, atol=1e-9)
        if f == "n":
            np.testing.assert_allclose(got["n_1d_over_30d_ratio"], (pdf[f] / (month / 30 + 0.5)).clip(0, 50), atol=1e-9)
    assert (got["baseline_complete"] == (pdf.groupby("user").cumcount() >= 14)).all()
    assert (got.loc[got["user"] == "flat", "n_zscore"] == 0).all()


def test_peer_zscores_leave_the_user_out(spark):
    rows = [(f"a{i}", DAY, v) for i, v in enumerate([1, 2, 3, 50])] + [("b0", DAY, 1), ("b1", DAY, 9), ("c0", DAY, 4), ("c1", DAY, 4), ("c2", DAY, 4)]
    df = spark.createDataFrame(rows, "user string, day date, n int")
    peers = spark.createDataFrame([(u, u[0]) for u, _, _ in rows if u[0] != "c"], "user string, role string")
    got = {r["user"]: r["n_peer_zscore"] for r in bl.peer_zscores(df, ["n"], peers).collect()}
    values = [1, 2, 3, 50]
    for i, v in enumerate(values):
        others = np.array(values[:i] + values[i + 1 :])
        assert got[f"a{i}"] == pytest.approx(np.clip((v - others.mean()) / others.std(ddof=1), -10, 10))
    assert [got[u] for u in ("b0", "b1", "c0", "c1", "c2")] == [0, 0, 0, 0, 0]


def past_z(values, i, window, low):
    past = np.array([v for v in values[max(0, i - window) : i] if v is not None], float)
    if values[i] is None or len(past) < low or past.std(ddof=1) == 0:
        return 0
    return np.clip((values[i] - past.mean()) / past.std(ddof=1), -10, 10)


@pytest.mark.parametrize("level", [10**6, 10**8, 10**10])
def test_a_large_past_does_not_spoil_later_scores(spark, level):
    rng = np.random.default_rng(1)
    values = [level + int(v) for v in rng.integers(-8, 9, 120)] + [2_000_000_000] + [int(v) for v in rng.integers(1, 20, 150)]
    values[200] = None
    for i in range(230, 240):
        values[i] = None
    rows = [("u", DAY + timedelta(days=i), v, None if v is None else v / 8) for i, v in enumerate(values)]
    got = bl.user_baselines(spark.createDataFrame(rows, "user string, day date, n long, x double"), ["n", "x"]).toPandas().sort_values("day")
    for name, window, low in (("zscore", 30, 14), ("zscore_90d", 90, 30)):
        want = [past_z(values, i, window, low) for i in range(len(values))]
        for f in ("n", "x"):
            np.testing.assert_allclose(got[f"{f}_{name}"], want, atol=1e-6)


def test_peer_scores_at_any_level(spark):
    rng = np.random.default_rng(2)
    groups = {
        "a": [10**7 + int(v) for v in rng.integers(-5, 6, 12)], "b": [10**12 + int(v) for v in rng.integers(-5, 6, 12)],
        "c": [int(v) for v in rng.integers(0, 9, 12)] + [2_000_000_000], "d": [10**9] * 6, "e": [3, 4, None, 9, 2],
    }
    rows = [(f"{g}{i}", DAY, v, None if v is None else v / 4) for g, vs in groups.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "user string, day date, n long, x double")
    peers = spark.createDataFrame([(u, u[0]) for u, *_ in rows], "user string, role string")
    got = {r["user"]: r for r in bl.peer_zscores(df, ["n", "x"], peers).collect()}
    for g, vs in groups.items():
        for i, v in enumerate(vs):
            others = np.array([0 if v is None else w - v for j, w in enumerate(vs) if j != i and w is not None], float)
            want = 0 if v is None or others.std(ddof=1) == 0 else np.clip(-others.mean() / others.std(ddof=1), -10, 10)
            assert got[f"{g}{i}"]["n_peer_zscore"] == pytest.approx(want, abs=1e-6)
            assert got[f"{g}{i}"]["x_peer_zscore"] == pytest.approx(want, abs=1e-6)


def exact_z(values):
    """Leave-one-out scores in fractions; 0 where the others are equal."""
    known = [Fraction(v) for v in values if v is not None]
    total, squares, n = sum(known), sum(v * v for v in known), len(known) - 1
    out = []
    for v in values:
        if v is None or n < 2:
            out.append(0.0)
            continue
        x = Fraction(v)
        mean, spread = (total - x) / n, (squares - x * x - (total - x) ** 2 / n) / (n - 1)
        out.append(float(np.clip(float(x - mean) / float(spread) ** 0.5, -10, 10)) if spread else 0.0)
    return out


def peer_groups(rng):
    """Groups of doubles on many levels; in most of them some member's others are all equal."""
    for level in (1e2, 1e3, 1e5, 1e7, 1e9, 1e11):
        for size in (3, 5, 7, 30, 300) if level in (1e2, 1e11) else (3, 7, 30):
            yield [level] * size
            yield [level] * (size - 1) + [level + 0.7]
            yield [level + 0.7] + [level] * (size - 1)
            yield [level] * (size - 1) + [-level * 1e3]
            yield [level] * (size - 2) + [level + 0.3, level - 0.4]
            yield [level + float(v) for v in rng.normal(size=size)]
            yield [float(v) for v in rng.normal(size=size - 1)] + [level]
            yield [0.1 + float(v) * 1e-3 for v in rng.normal(size=size - 2)] + [level, None]
    yield [1e7, 2e7]
    yield [5.0]
    yield [0.1, 0.1, 0.3]


def test_peer_scores_of_doubles_are_right_at_every_level(spark):
    rng = np.random.default_rng(4)
    groups = {f"g{k}": vs for k, vs in enumerate(peer_groups(rng))}
    rows = [(f"{g}-{i}", DAY, v) for g, vs in groups.items() for i, v in enumerate(vs)]
    peers = spark.createDataFrame([(u, u.split("-")[0]) for u, *_ in rows], "user string, role string")
    df = spark.createDataFrame(rows, "user string, day date, x double").repartition(7)
    got = {r["user"]: r["x_peer_zscore"] for r in bl.peer_zscores(df, ["x"], peers).collect()}
    for g, vs in groups.items():
        for i, want in enumerate(exact_z(vs)):
            if want == 0:
                assert abs(got[f"{g}-{i}"]) < 1e-9, (vs[:3], len(vs), i)
            else:
                assert got[f"{g}-{i}"] == pytest.approx(want, rel=1e-6, abs=1e-9), (vs[:3], len(vs), i)


def test_whole_numbers_of_seventeen_digits_over_more_rows_than_a_batch(spark):
    rng = np.random.default_rng(3)
    level = 10**17
    values = [level + int(v) for v in rng.integers(-8, 9, 40)] + [int(v) for v in rng.integers(0, 9, 2400)]
    values[700] = None
    rows = [("u", DAY + timedelta(days=i), v) for i, v in enumerate(values)] + [("v", DAY + timedelta(days=i), i % 3) for i in range(60)]
    rows += [(None, DAY + timedelta(days=i), 1) for i in range(3)]
    df = spark.createDataFrame(rows, "user string, day date, n long")
    got = bl.user_baselines(df, ["n"]).toPandas().sort_values(["user", "day"])
    own = got[got.user == "u"].reset_index(drop=True)
    # Scores are differences of doubles, which hold fifteen digits; the large values must leave none behind.
    want = [past_z(values, i, 30, 14) for i in range(70, len(values))]
    np.testing.assert_allclose(own.n_zscore[70:], want, atol=1e-6)
    assert list(own.baseline_complete) == [i >= 14 for i in range(len(values))]
    assert own["n_7d_sum"][40] == float(sum(values[33:40])) and own["n_30d_sum"][2200] == sum(values[2170:2200])
    other = got[got.user == "v"].reset_index(drop=True)
    assert other["n_7d_sum"][8] == sum(i % 3 for i in range(1, 8)) and not other.baseline_complete[13] and other.baseline_complete[14]
    nobody = spark.createDataFrame([], "user string, role string")
    members = {"u": values[0], "v": 0, None: 1, "w": level - 4, "x": level + 4, "y": None}
    rows = [(u, DAY, v) for u, v in members.items()]
    scored = {r["user"]: r["n_peer_zscore"] for r in bl.peer_zscores(spark.createDataFrame(rows, df.schema), ["n"], nobody).collect()}
    assert scored == pytest.approx(dict(zip(members, exact_z(members.values()))), rel=1e-9)


def test_peer_scores_do_not_depend_on_the_order_of_rows(spark):
    rng = np.random.default_rng(5)
    values = [1e7 + 0.7] + [1e7] * 6
    other = [1e5 + float(v) for v in rng.normal(size=30)]
    rows = []
    for order in range(100):  # each day has the same values, in an order of its own
        day = DAY + timedelta(days=order)
        rows += [(f"a{i}", day, values[i]) for i in rng.permutation(len(values))]
        rows += [(f"b{i}", day, other[i]) for i in rng.permutation(len(other))]
    peers = spark.createDataFrame([(f"a{i}", "a") for i in range(7)] + [(f"b{i}", "b") for i in range(30)], "user string, role string")
    df = spark.createDataFrame(rows, "user string, day date, x double")
    got = bl.peer_zscores(df.repartition(13), ["x"], peers).toPandas()
    for user, scores in got.groupby("user").x_peer_zscore:
        want = exact_z(values if user[0] == "a" else other)[int(user[1:])]
        assert len(scores) == 100 and np.abs(scores - want).max() < 1e-9


def test_chronological_split(spark):
    df = spark.createDataFrame([(DAY + timedelta(days=i % 30), i) for i in range(90)], "day date, i int")
    train, test = splits.chronological_split(df, 0.9)
    assert train.select("day").distinct().count() == 28 and test.select("day").distinct().count() == 2
    assert train.count() + test.count() == 90
    with pytest.raises(ValueError):
        splits.chronological_split(df, 1.0)


def test_windows_are_inclusive_and_overlaps_count_once(spark):
    df = spark.createDataFrame([(u, DAY + timedelta(days=i)) for u in "ab" for i in range(8)], "user string, day date")
    windows = spark.createDataFrame(
        [("a", DAY + timedelta(days=2), DAY + timedelta(days=4), 1), ("a", DAY + timedelta(days=4), DAY + timedelta(days=5), 2)],
        "user string, start_day date, end_day date, scenario int",
    )
    rows = splits.with_label(df, windows).collect()
    assert len(rows) == 16
    assert sorted((r["day"] - DAY).days for r in rows if r["label"]) == [2, 3, 4, 5]
    assert splits.labelled_rows(df, windows.limit(0)).count() == 0
    assert {r["user"] for r in splits.without_labelled_users(df, windows).collect()} == {"b"}


def test_replay_follows_the_last_day(spark):
    df = spark.createDataFrame([("u", DAY + timedelta(days=i)) for i in range(30)], "user string, day date")
    days = sorted((r["day"] - DAY).days for r in splits.replay_rows(df).collect())
    assert days == [30, 31, 32]
