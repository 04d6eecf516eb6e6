"""Scaler, linear reconstruction model and isolation forest, fitted and applied on Spark.

Fitted parts are small: two numbers per feature, ``k`` weights per feature, and a
tree table bounded by trees x (2 x sample - 1) nodes. None grows with the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from daywatch.operators import explain
from daywatch.sources import versions

EULER_GAMMA = 0.5772156649015329
ANOMALY_SCORE = 0.5


# --- scaler --------------------------------------------------------------------------


@dataclass(frozen=True)
class Scaler:
    features: list[str]
    mean: list[float]
    std: list[float]


def fit_scaler(df: DataFrame, features: list[str]) -> Scaler:
    """Mean and population deviation per feature; a constant feature keeps scale 1; non-finite values are an error."""
    values = [f"CAST(`{f}` AS DOUBLE)" for f in features]
    bad = " OR ".join(f"({v} IS NULL OR isnan({v}) OR abs({v}) = double('Infinity'))" for v in values)
    row = df.agg(
        F.expr(f"array({', '.join(f'avg({v})' for v in values)})").alias("mean"),
        F.expr(f"array({', '.join(f'stddev_pop({v})' for v in values)})").alias("std"),
        F.expr(f"count_if({bad})").alias("bad"),
    ).first()
    if row["bad"]:
        raise ValueError(f"{row['bad']} rows hold missing or non-finite features")
    return Scaler(features, list(row["mean"]), [s if s > 0 else 1.0 for s in row["std"]])


def scaled(scaler: Scaler) -> Column:
    """Array of scaled features, in the scaler's order."""
    parts = zip(scaler.features, scaler.mean, scaler.std)
    return F.expr("array(" + ", ".join(f"(CAST(`{f}` AS DOUBLE) - {m!r}D) / {s!r}D" for f, m, s in parts) + ")")


# --- linear reconstruction -------------------------------------------------------------


def fit_components(df: DataFrame, vectors: str, k: int) -> np.ndarray:
    """Principal directions of an array column, features x k, with a fixed sign."""
    rows = df.select(array_to_vector(F.col(vectors).cast("array<double>")).alias("v"))
    return signed(PCA(k=k, inputCol="v", outputCol="p").fit(rows).pc.toArray())


def embed(vectors: Column, weights: np.ndarray, center: np.ndarray | None = None) -> Column:
    """Array column times weights."""
    offset = np.zeros(weights.shape[0]) if center is None else center

    @F.pandas_udf("array<double>")
    def project(batch: pd.Series) -> pd.Series:
        if batch.empty:
            return pd.Series([], dtype=object)
        return pd.Series(list((np.vstack(batch.to_numpy()) - offset) @ weights))

    return project(vectors)


def rebuild(embedding: Column, weights: np.ndarray) -> Column:
    """Embedding back to feature space."""
    back = weights.T

    @F.pandas_udf("array<double>")
    def lift(batch: pd.Series) -> pd.Series:
        if batch.empty:
            return pd.Series([], dtype=object)
        return pd.Series(list(np.vstack(batch.to_numpy()) @ back))

    return lift(embedding)


class Reconstruction(Protocol):
    """What a reconstruction model offers: an embedding of a scaled row, the way back, and its rows in storage.

    Implementations are registered in ``RECONSTRUCTIONS`` under their ``kind``.
    """

    kind: str

    def embed(self, vectors: Column) -> Column: ...

    def rebuild(self, embedding: Column) -> Column: ...

    def rows(self) -> list[list[float]]:
        """The fitted numbers, a list of numbers a row."""

    @classmethod
    def of_rows(cls, rows: list[list[float]]) -> Reconstruction: ...


@dataclass(frozen=True)
class Components:
    """Principal directions, features x k: the embedding is the projection on them."""

    weights: np.ndarray
    kind = "components"

    def embed(self, vectors: Column) -> Column:
        return embed(vectors, self.weights)

    def rebuild(self, embedding: Column) -> Column:
        return rebuild(embedding, self.weights)

    def rows(self) -> list[list[float]]:
        return self.weights.tolist()

    @classmethod
    def of_rows(cls, rows: list[list[float]]) -> Components:
        return cls(np.array(rows, float))


@dataclass(frozen=True)
class Centres:
    """Typical rows, k x features: the embedding has the distance to each, the nearest is the way back."""

    points: np.ndarray
    kind = "centres"

    def embed(self, vectors: Column) -> Column:
        points = self.points

        @F.pandas_udf("array<double>")
        def distances(batch: pd.Series) -> pd.Series:
            if batch.empty:
                return pd.Series([], dtype=object)
            rows = np.vstack(batch.to_numpy())
            squares = [((rows - p) ** 2).sum(1) for p in points]
            return pd.Series(list(np.sqrt(np.stack(squares, 1))))

        return distances(vectors)

    def rebuild(self, embedding: Column) -> Column:
        points = F.array(*[F.array(*map(F.lit, p)) for p in self.points.tolist()])
        nearest = F.array_position(embedding, F.array_min(embedding)).cast("int")
        return F.element_at(points, nearest)

    def rows(self) -> list[list[float]]:
        return self.points.tolist()

    @classmethod
    def of_rows(cls, rows: list[list[float]]) -> Centres:
        return cls(np.array(rows, float))


RECONSTRUCTIONS: dict[str, type] = {c.kind: c for c in (Components, Centres)}


def fit_centres(df: DataFrame, vectors: str, k: int, seed: int = 42) -> Centres:
    """Centres of an array column by k-means."""
    rows = df.select(array_to_vector(F.col(vectors).cast("array<double>")).alias("features"))
    return Centres(np.array(KMeans(k=k, seed=seed).fit(rows).clusterCenters()))


# --- moments -------------------------------------------------------------------------------

MOMENTS = "n long, mean array<double>, products array<double>"


def moments(df: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """Per group the count, means and summed products of distances from the means: ``*by, n, mean, products``.

    Groups merge exactly as rows would have (``merged_moments``), so a table by day is kept up to date by adding days
    and a model is refitted from it without the old rows. Tasks reduce their rows first. Missing and non-finite values are an error.
    """
    size = len(features)
    schema = StructType([*[df.schema[c] for c in by], *StructType.fromDDL(MOMENTS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(len(by)).flatten().to_numpy(zero_copy_only=False), float).reshape(b.num_rows, size)
            if not np.isfinite(x).all():
                raise ValueError("moments are taken of rows without missing or non-finite features")
            keys = pa.Table.from_batches([b]).select(by)
            codes = keys.to_pandas().groupby(by, dropna=False, sort=False).ngroup().to_numpy()
            first, n, mean, products = [], [], [], []
            for code in range(codes.max() + 1 if len(codes) else 0):
                rows = np.nonzero(codes == code)[0]
                centre = x[rows].mean(0)
                off = x[rows] - centre
                first.append(int(rows[0]))
                n.append(len(rows))
                mean.append(centre)
                products.append((off.T @ off).ravel())
            columns = [b.column(i).take(pa.array(first, pa.int64())) for i in range(len(by))]
            columns += [pa.array(n, pa.int64()), pa.array(mean, pa.list_(pa.float64())), pa.array(products, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    values = F.array(*[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(float("nan"))) for f in features])
    return merged_moments(df.select(*by, values.alias("_x")).mapInArrow(run, schema), by)


def merged_moments(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Moments of the rows of several groups together, per coarser group or, without ``by``, of all."""
    by = by or []
    schema = StructType([*[parts.schema[c] for c in by], *StructType.fromDDL(MOMENTS).fields])

    def merge(table: pa.Table) -> pa.Table:
        total, mean, products = 0, None, None
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("n", "mean", "products"))))
        for n, m, p in rows:
            m, p = np.array(m), np.array(p)
            if mean is None:
                total, mean, products = n, m, p
                continue
            off = m - mean
            products = products + p + np.outer(off, off).ravel() * (total * n / (total + n))
            mean = mean + off * (n / (total + n))
            total += n
        out = [pa.array([total], pa.int64()), *(pa.array([a], pa.list_(pa.float64())) for a in (mean, products))]
        return pa.Table.from_arrays([*[table.column(c).slice(0, 1) for c in by], *out], names=schema.names)

    if by:
        # Parts of a group meet in a few tasks first.
        salted = parts.withColumn("_salt", F.pmod(F.xxhash64("n", "mean"), F.lit(16)))
        half = StructType([*schema.fields])
        first = salted.groupBy(*by, "_salt").applyInArrow(lambda t: merge(t.drop_columns(["_salt"])), half)
        return first.groupBy(*by).applyInArrow(merge, schema)
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("n", "mean"), F.lit(16)))
    first = salted.groupBy("_salt").applyInArrow(lambda t: merge(t.drop_columns(["_salt"])), schema)
    return first.groupBy().applyInArrow(merge, schema)


def fit_from_moments(parts: DataFrame, features: list[str], k: int) -> tuple[Scaler, Components]:
    """Scaler and components of all rows behind a moment table: those of a fit on the rows themselves."""
    row = merged_moments(parts.select("n", "mean", "products")).first()
    size = len(features)
    covariance = np.array(row["products"]).reshape(size, size) / row["n"]
    std = np.sqrt(np.diagonal(covariance))
    std = np.where(std > 0, std, 1.0)
    values, vectors = np.linalg.eigh(covariance / np.outer(std, std))
    weights = vectors[:, np.argsort(-values, kind="stable")[: min(k, size)]]
    return Scaler(features, list(row["mean"]), std.tolist()), Components(signed(weights))


def signed(weights: np.ndarray) -> np.ndarray:
    """Directions turned so that the largest entry of each is positive."""
    largest = weights[np.abs(weights).argmax(axis=0), np.arange(weights.shape[1])]
    return weights * np.sign(np.where(largest == 0, 1.0, largest))


def projection(df: DataFrame, vectors: str, k: int = 2) -> DataFrame:
    """Centred principal components of an array column as ``p1`` .. ``pk``."""
    size = df.select(F.size(vectors)).first()[0]
    center = df.agg(F.expr(f"array({', '.join(f'avg(CAST({vectors}[{i}] AS DOUBLE))' for i in range(size))})")).first()[0]
    weights = fit_components(df, vectors, k)
    out = df.withColumn("_p", embed(F.col(vectors), weights, np.array(center)))
    return out.select(*df.columns, *[F.col("_p")[i].alias(f"p{i + 1}") for i in range(k)])


# --- isolation forest --------------------------------------------------------------------

NODE_SCHEMA = "tree int, node int, left int, right int, feature int, threshold double, path double"


def expected_path(n: float) -> float:
    """Mean depth at which a random tree isolates one of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


def _grow(points: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    nodes: list[list] = []
    waiting = [(np.arange(len(points)), 0, -1, "")]
    while waiting:
        rows, depth, parent, side = waiting.pop()
        here = len(nodes)
        if parent >= 0:
            nodes[parent][1 if side == "left" else 2] = here
        low, high = points[rows].min(axis=0), points[rows].max(axis=0)
        splittable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(splittable):
            nodes.append([here, -1, -1, -1, 0.0, depth + expected_path(len(rows))])
            continue
        feature = int(rng.choice(splittable))
        threshold = float(rng.uniform(low[feature], high[feature]))
        nodes.append([here, -1, -1, feature, threshold, None])
        left = points[rows, feature] <= threshold
        waiting.append((rows[~left], depth + 1, here, "right"))
        waiting.append((rows[left], depth + 1, here, "left"))
    return nodes


@dataclass(frozen=True)
class Forest:
    nodes: pd.DataFrame
    sample: int


def fit_forest(
    df: DataFrame, vectors: str, keys: list[str], trees: int = 200, sample: int = 256, seed: int = 42
) -> Forest:
    """Grow each tree on its own random sample of rows.

    Draws are hashes of the row key and tree, so a recomputed partition draws the
    same rows. A first hash keeps a pool a few times the needed size; each pool row
    goes only to the trees that may take it, about twice the sample per tree, and
    the tree keeps the smallest draws.
    """
    rows = df.count()
    size = min(sample, rows)
    pool_share = min(1.0, 4.0 * trees * size / max(rows, 1))
    pool_rows = rows * pool_share
    tree_share = 1.0 if pool_rows <= 4 * size else 2.0 * size / pool_rows
    whole = 1 << 31

    def draw(*salt: Column) -> Column:
        return F.pmod(F.xxhash64(*keys, *salt, F.lit(seed)), F.lit(whole))

    pool = df.select(*keys, F.col(vectors).cast("array<double>").alias("v")).where(
        draw(F.lit("pool")) < int(pool_share * whole)
    )
    takers = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < int(tree_share * whole))
    offered = pool.withColumn("tree", F.explode(takers)).select("tree", draw(F.col("tree")).alias("d"), "v")
    limit = math.ceil(math.log2(max(size, 2)))

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        chosen = group.assign(s=group["v"].map(tuple)).sort_values(["d", "s"]).head(size)
        nodes = _grow(np.vstack(chosen["v"].to_numpy()), np.random.default_rng([seed, tree]), limit)
        out = pd.DataFrame(nodes, columns=["node", "left", "right", "feature", "threshold", "path"])
        out.insert(0, "tree", tree)
        return out

    # At most trees x (2 x sample - 1) small rows, whatever the size of the data.
    return Forest(offered.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas(), size)


def anomaly_score(vectors: Column, forest: Forest) -> Column:
    """2 ** (-mean path / expected path): near 1 is isolated quickly, below 0.5 is ordinary."""
    nodes = forest.nodes.sort_values(["tree", "node"])
    roots = nodes.groupby("tree").size().cumsum().shift(fill_value=0)
    start = nodes["tree"].map(roots).to_numpy()
    leaf = nodes["path"].notna().to_numpy()
    own = np.arange(len(nodes))
    left = np.where(leaf, own, nodes["left"].to_numpy() + start)
    right = np.where(leaf, own, nodes["right"].to_numpy() + start)
    feature = np.where(leaf, 0, nodes["feature"].to_numpy())
    threshold = nodes["threshold"].to_numpy()
    path = nodes["path"].fillna(0.0).to_numpy()
    depth = math.ceil(math.log2(max(forest.sample, 2)))
    norm = expected_path(forest.sample) or 1.0
    first = roots.to_numpy()

    @F.pandas_udf("double")
    def score(batch: pd.Series) -> pd.Series:
        if batch.empty:
            return pd.Series([], dtype=float)
        points = np.vstack(batch.to_numpy())
        out = np.empty(len(points))
        for begin in range(0, len(points), 2000):
            part = points[begin : begin + 2000]
            at = np.broadcast_to(first, (len(part), len(first)))
            row = np.arange(len(part))[:, None]
            for _ in range(depth):
                at = np.where(part[row, feature[at]] <= threshold[at], left[at], right[at])
            out[begin : begin + 2000] = np.exp2(-path[at].mean(axis=1) / norm)
        return pd.Series(out)

    return score(vectors)


def anomaly_label(score: Column) -> Column:
    """-1 for anomalous, 1 for normal."""
    return F.when(score > ANOMALY_SCORE, -1).otherwise(1)


# --- the detection model as a whole -----------------------------------------------------------


@dataclass(frozen=True)
class DetectionModel:
    scaler: Scaler
    reconstruction: Reconstruction
    forest: Forest


def fit_detection(
    df: DataFrame,
    features: list[str],
    keys: list[str],
    k: int = 16,
    trees: int = 200,
    sample: int = 256,
    seed: int = 42,
    reconstruct: Callable[[DataFrame, str, int], Reconstruction] | None = None,
) -> DetectionModel:
    """Scaler, reconstruction model and forest from normal rows.

    ``reconstruct`` fits another model than the principal components: it gets rows, their array column and ``k``.
    """
    scaler = fit_scaler(df, features)
    rows = df.select(*keys, scaled(scaler).alias("scaled"))
    size = min(k, len(features))
    found = reconstruct(rows, "scaled", size) if reconstruct else Components(fit_components(rows, "scaled", size))
    latent = rows.select(*keys, found.embed(F.col("scaled")).alias("embedding"))
    return DetectionModel(scaler, found, fit_forest(latent, "embedding", keys, trees, sample, seed))


def score_rows(df: DataFrame, model: DetectionModel, keep: list[str]) -> DataFrame:
    """Rows with embedding, summed reconstruction error, contributions, group errors and forest score."""
    features = model.scaler.features
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"rows lack model features: {missing}")
    out = df.select(*keep, scaled(model.scaler).alias("_scaled"))
    out = out.withColumn("embedding", model.reconstruction.embed(F.col("_scaled")))
    out = out.withColumn("_rebuilt", model.reconstruction.rebuild(F.col("embedding")))
    # Exploded from arrays of one, errors and total are worked out once a row; as plain columns they would be
    # put in wherever they are used, the total once a feature.
    out = out.withColumn("_errors", F.explode(F.array(explain.feature_errors(F.col("_scaled"), F.col("_rebuilt")))))
    out = out.withColumn("total_reconstruction_error", F.explode(F.array(explain.total_error(F.col("_errors")))))
    shares = explain.contribution_ratios(F.col("_errors"), F.col("total_reconstruction_error"))
    groups = explain.group_errors("_errors", features)
    return out.select(
        *keep,
        "embedding",
        "total_reconstruction_error",
        explain.as_map(features, shares).alias("contributions"),
        *[error.alias(f"group_error_{name}") for name, error in groups.items()],
        anomaly_score(F.col("embedding"), model.forest).alias("if_anomaly_score"),
    )


def save_model(
    spark: SparkSession, model: DetectionModel, root: str, scored: DataFrame | None = None
) -> versions.Version:
    """Publish the feature contract, scaler, reconstruction and trees as the next version of ``root``.

    With ``scored`` (rows of ``score_rows``) the scores and embeddings that belong to the model are
    stored in the same version: a reader never meets scores of another model.
    """
    scaler = list(zip(range(len(model.scaler.features)), model.scaler.features, model.scaler.mean, model.scaler.std))
    weights = [(i, [float(w) for w in row]) for i, row in enumerate(model.reconstruction.rows())]
    nodes = model.forest.nodes.assign(sample=model.forest.sample)

    def write(path: str) -> None:
        for part, rows, schema in (
            ("features", scaler, "position int, feature string, mean double, std double"),
            ("reconstruction", weights, "position int, weights array<double>"),
            ("trees", nodes, NODE_SCHEMA + ", sample int"),
        ):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{part}")
        if scored is not None:
            scored.drop("embedding").write.parquet(f"{path}/scores")
            keys = [c for c in scored.columns if c in ("user", "day", "pc")]
            scored.select(*keys, "embedding").write.parquet(f"{path}/embeddings")

    about = {"reconstruction": model.reconstruction.kind, "scored": scored is not None}
    return versions.publish(spark, root, write, about=about)


def load_model(spark: SparkSession, root: str, version: versions.Version | None = None) -> DetectionModel:
    """The current or a given version of a stored model."""
    pinned = version or versions.current(spark, root)
    read = lambda part: versions.read(spark, root, pinned, part)
    rows = read("features").orderBy("position").collect()
    scaler = Scaler([r["feature"] for r in rows], [r["mean"] for r in rows], [r["std"] for r in rows])
    weights = [list(r["weights"]) for r in read("reconstruction").orderBy("position").collect()]
    nodes = read("trees").toPandas()
    sample = int(nodes.pop("sample").iloc[0])
    return DetectionModel(scaler, RECONSTRUCTIONS[pinned.about["reconstruction"]].of_rows(weights), Forest(nodes, sample))


def load_scored(spark: SparkSession, root: str, version: versions.Version | None = None) -> DataFrame:
    """The scores and embeddings stored with a model."""
    pinned = version or versions.current(spark, root)
    scores, embeddings = (versions.read(spark, root, pinned, part) for part in ("scores", "embeddings"))
    keys = [c for c in embeddings.columns if c != "embedding"]
    return scores.join(embeddings, keys)
