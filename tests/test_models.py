from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from daywatch.operators import explain, models

DAY = date(2010, 1, 1)


@pytest.fixture(scope="module")
def cloud(spark):
    """300 ordinary points near a line and 6 planted outliers, with a constant third feature."""
    rng = np.random.default_rng(1)
    t = rng.normal(size=300)
    rows = [(f"u{i}", DAY, float(v + rng.normal() * 0.1), float(2 * v + rng.normal() * 0.1), 5.0) for i, v in enumerate(t)]
    rows += [(f"x{i}", DAY, 8.0 + i, -9.0 - i, 5.0) for i in range(6)]
    return spark.createDataFrame(rows, "user string, day date, a double, b double, c double").cache()


def test_scaler_uses_population_deviation(spark, cloud):
    normal = cloud.where("user LIKE 'u%'")
    scaler = models.fit_scaler(normal, ["a", "b", "c"])
    data = normal.select("a", "b", "c").toPandas()
    np.testing.assert_allclose(scaler.mean, data.mean())
    np.testing.assert_allclose(scaler.std, [data["a"].std(ddof=0), data["b"].std(ddof=0), 1.0])
    with pytest.raises(ValueError, match="non-finite"):
        models.fit_scaler(normal.withColumn("a", F.when(F.col("user") == "u3", float("nan")).otherwise(F.col("a"))), ["a"])


def test_components_and_projection_match_numpy(spark, cloud):
    normal = cloud.where("user LIKE 'u%'").withColumn("v", F.array("a", "b", "c"))
    data = np.vstack(normal.select("v").toPandas()["v"].to_numpy())
    centred = data - data.mean(axis=0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    first = vt[0] * np.sign(vt[0][np.abs(vt[0]).argmax()])
    got = models.projection(normal, "v").select("p1").toPandas()["p1"].to_numpy()
    np.testing.assert_allclose(np.sort(got), np.sort(centred @ first), atol=1e-8)


def test_full_rank_rebuild_is_exact(spark, cloud):
    df = cloud.select(F.array("a", "b", "c").alias("v"))
    weights = models.fit_components(df, "v", 3)
    out = df.withColumn("r", models.rebuild(models.embed(F.col("v"), weights), weights))
    worst = out.select(F.max(explain.total_error(explain.feature_errors(F.col("v"), F.col("r"))))).first()[0]
    assert worst < 1e-16


def test_forest_finds_planted_outliers_and_is_repeatable(spark, cloud):
    df = cloud.select("user", "day", F.array("a", "b").alias("v"))
    forest = models.fit_forest(df.where("user LIKE 'u%'"), "v", ["user", "day"], trees=60, sample=128)
    again = models.fit_forest(df.where("user LIKE 'u%'").repartition(7), "v", ["user", "day"], trees=60, sample=128)
    assert forest.nodes.sort_values(["tree", "node"]).reset_index(drop=True).equals(
        again.nodes.sort_values(["tree", "node"]).reset_index(drop=True)
    )
    assert forest.nodes["tree"].nunique() == 60
    assert forest.nodes.groupby("tree").size().max() <= 2 * 128 - 1
    scores = df.select("user", models.anomaly_score(F.col("v"), forest).alias("s")).toPandas()
    assert scores["s"].between(0, 1).all()
    planted = scores[scores["user"].str.startswith("x")]["s"]
    ordinary = scores[scores["user"].str.startswith("u")]["s"]
    assert planted.min() > ordinary.quantile(0.95) and planted.min() > models.ANOMALY_SCORE


def test_scores_follow_each_tree(spark, cloud):
    df = cloud.select("user", "day", F.array("a", "b").alias("v"))
    forest = models.fit_forest(df, "v", ["user", "day"], trees=5, sample=32)
    nodes = {(r.tree, r.node): r for r in forest.nodes.itertuples()}
    for row in df.select("v", models.anomaly_score(F.col("v"), forest).alias("s")).limit(20).collect():
        paths = []
        for tree in range(5):
            at = nodes[tree, 0]
            while at.left >= 0:
                at = nodes[tree, at.left if row["v"][at.feature] <= at.threshold else at.right]
            paths.append(at.path)
        assert row["s"] == pytest.approx(2 ** (-np.mean(paths) / models.expected_path(32)))


def test_saved_model_scores_the_same(spark, cloud, tmp_path):
    model = models.fit_detection(cloud.where("user LIKE 'u%'"), ["a", "b", "c"], ["user", "day"], k=1, trees=20, sample=64)
    models.save_model(spark, model, str(tmp_path / "m"))
    loaded = models.load_model(spark, str(tmp_path / "m"))
    one, two = (models.score_rows(cloud, m, ["user", "day"]).orderBy("user").toPandas() for m in (model, loaded))
    assert (one["if_anomaly_score"] == two["if_anomaly_score"]).all()
    np.testing.assert_allclose(one["total_reconstruction_error"], two["total_reconstruction_error"])
    shares = one["contributions"].map(lambda m: sum(m.values()))
    assert shares.between(1 - 1e-9, 1 + 1e-9).all()
    with pytest.raises(ValueError, match="lack"):
        models.score_rows(cloud.drop("b"), model, ["user"])


def test_group_errors_average_families(spark):
    features = ["logon_count", "logon_count_zscore", "logoff_count", "file_open_count", "surprise"]
    row = spark.createDataFrame([([1.0, 3.0, 8.0, 5.0, 7.0],)], "e array<double>")
    groups = explain.group_errors("e", features)
    got = row.select(*[c.alias(g) for g, c in groups.items()]).first().asDict()
    assert got == {"logon": 5.0, "file": 5.0, "other": 7.0}
    assert row.select(explain.group_errors("e", features, {"none": []})["none"].alias("n")).first()["n"] == 0.0


def test_zero_error_contributes_nothing(spark):
    row = spark.createDataFrame([([0.0, 0.0],)], "e array<double>")
    assert row.select(explain.contribution_ratios(F.col("e"), explain.total_error(F.col("e"))).alias("r")).first()["r"] == [0.0, 0.0]


def test_another_reconstruction_model_takes_its_place(spark, cloud, tmp_path):
    """Fitted, scored, stored with its scores and read back through the same calls."""
    normal, keys = cloud.where("user LIKE 'u%'"), ["user", "day"]
    centres = lambda rows, column, k: models.fit_centres(rows, column, 5)
    model = models.fit_detection(normal, ["a", "b", "c"], keys, k=3, trees=10, sample=32, reconstruct=centres)
    scored = models.score_rows(cloud, model, keys)
    points = model.reconstruction.points
    assert points.shape == (5, 3)
    for r in scored.join(cloud, keys).limit(40).collect():
        own = (np.array([r["a"], r["b"], r["c"]]) - model.scaler.mean) / model.scaler.std
        distances = np.sqrt(((points - own) ** 2).sum(1))
        np.testing.assert_allclose(r["embedding"], distances, atol=1e-9)
        assert r["total_reconstruction_error"] == pytest.approx(distances.min() ** 2, abs=1e-9)
    root = str(tmp_path / "m")
    first = models.save_model(spark, model, root, scored)
    models.save_model(spark, models.fit_detection(normal, ["a", "b", "c"], keys, k=1, trees=5, sample=32), root)
    assert isinstance(models.load_model(spark, root).reconstruction, models.Components)
    loaded = models.load_model(spark, root, first)
    assert isinstance(loaded.reconstruction, models.Centres)
    stored = models.load_scored(spark, root, first).select(scored.columns).orderBy("user").toPandas()
    again = models.score_rows(cloud, loaded, keys).orderBy("user").toPandas()
    np.testing.assert_allclose(stored["if_anomaly_score"], again["if_anomaly_score"])
    np.testing.assert_allclose(np.vstack(stored["embedding"]), np.vstack(again["embedding"]))


def test_days_added_one_by_one_give_the_model_of_all_rows(spark):
    rng = np.random.default_rng(2)
    mix = rng.normal(size=(6, 6)) * np.exp(-np.arange(6))[:, None]
    data = rng.normal(size=(600, 6)) @ mix + [0, 1e6, 3, -50, 0, 7]
    data[:, 4] = 2.5
    features = [f"f{i}" for i in range(6)]
    rows = [(f"u{i}", date(2010, 1, 1 + i % 9), *map(float, r)) for i, r in enumerate(data)]
    df = spark.createDataFrame(rows, "user string, day date, " + ", ".join(f"{f} double" for f in features)).repartition(5)
    kept = None
    for d in range(1, 10):
        day = models.moments(df.where(F.dayofmonth("day") == d), features, ["day"])
        kept = day.cache() if kept is None else kept.union(day).cache()
    assert sum(r["n"] for r in kept.collect()) == 600
    scaler, components = models.fit_from_moments(kept, features, 3)
    whole = models.fit_scaler(df, features)
    np.testing.assert_allclose(scaler.mean, whole.mean, rtol=1e-12)
    np.testing.assert_allclose(scaler.std, whole.std, rtol=1e-8)
    direct = models.fit_components(df.select(models.scaled(whole).alias("v")), "v", 3)
    np.testing.assert_allclose(components.weights, direct, atol=1e-5)
    bad = df.withColumn("f0", F.when(F.col("user") != "u3", F.col("f0")))
    with pytest.raises(Exception, match="non-finite"):
        models.moments(bad, features, ["day"]).collect()


def test_errors_of_a_row_are_worked_out_once(spark):
    """Put in wherever they are used, errors and total cost the square of the features a row."""
    import pandas as pd

    features = ["a", "b", "c"]
    leaf = pd.DataFrame([[0, 0, -1, -1, -1, 0.0, 1.0]], columns=["tree", "node", "left", "right", "feature", "threshold", "path"])
    scaler = models.Scaler(features, [0.0] * 3, [1.0] * 3)
    model = models.DetectionModel(scaler, models.Components(np.eye(3)[:, :2]), models.Forest(leaf, 1))
    rows = spark.range(1, 4).selectExpr("id AS user", "id AS a", "2 * id AS b", "3 * id AS c")
    scored = models.score_rows(rows, model, ["user"])
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1 and plan.count("zip_with(") == 1
    for r in scored.collect():
        assert r["total_reconstruction_error"] == 9.0 * r["user"] ** 2
        assert r["contributions"] == {"a": 0.0, "b": 0.0, "c": 1.0}
