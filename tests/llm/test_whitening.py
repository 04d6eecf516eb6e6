import math

import numpy as np
import pytest

from daywatch.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string, component int"
COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def vectors(rng, n, size):
    return (rng.normal(size=(n, size)) * np.exp(-np.arange(size) / 6)).astype(np.float32).tolist()


def run(spark, rows, **how):
    got = whitening.whiten(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3), **how)
    assert got.columns == COLUMNS
    return got.toPandas().sort_values(["vec_id", "component"]).reset_index(drop=True)


def check(got, rows, k=8):
    """Against numpy's eigenvectors and exact integers."""
    good = sorted((i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v))
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in good]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[c - s / n for c, s in zip(v, sums)] for v in x])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    assert got.vec_id.tolist() == [i for i, _ in good for _ in range(k)]
    assert got.component.tolist() == [*range(1, k + 1)] * n and (got.n == n).all()
    assert got.deviation.tolist() == [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x for _ in range(k)]
    own = got.whitened.to_numpy().reshape(n, k)
    want = centred @ vectors / np.sqrt(values)
    assert np.abs(own * np.sign((own * want).sum(0)) - want).max() < 1e-6
    assert np.allclose(got.explained.to_numpy().reshape(n, k), values / np.trace(covariance), rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-8
    assert abs(np.abs(np.cov(own.T, bias=True) - np.eye(k)).max() - got.identity_error[0]) < 1e-9


def test_against_numpy(spark):
    rng = np.random.default_rng(0)
    rows = list(enumerate(vectors(rng, 400, 24)))
    check(run(spark, rows), rows)
    check(run(spark, rows[:30], components=3), rows[:30], 3)


def test_unusable_rows_are_left_out(spark):
    rng = np.random.default_rng(1)
    rows = list(enumerate(vectors(rng, 60, 12)))
    odd = [(100, None), (101, [None] + [1.0] * 11), (102, [math.nan] * 12), (103, [math.inf] + [0.0] * 11), (104, [])]
    other = [(105, [1.0] * 5)]
    check(run(spark, rows + odd + other), rows)
    assert run(spark, odd).empty and run(spark, []).empty


def test_repeated_rows_and_missing_ids(spark):
    rng = np.random.default_rng(2)
    few = vectors(rng, 20, 10)
    got = run(spark, [(i % 20, few[i % 20]) for i in range(60)] + [(None, few[0])])
    assert len(got) == 61 * 8 and got.vec_id.isna().sum() == 8 and (got.n == 61).all()
    assert got[got.vec_id == 3].groupby("component").whitened.nunique().eq(1).all()


def test_few_dimensions_or_rows(spark):
    assert run(spark, [(1, [2.0, 3.0])]).empty
    assert run(spark, [(i, [2.0, 3.0]) for i in range(9)]).empty  # no variance
    got = run(spark, [(i, [float(i), 3.0]) for i in range(9)])
    assert got.component.tolist() == [1] * 9 and got.explained.tolist() == [1.0] * 9
    assert got.identity_error[0] < 1e-12


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=9) * 5e3).astype(np.float32).tolist()) for i in range(50)]
    check(run(spark, rows), rows)
    beyond = run(spark, [(i, [c * 1e3 for c in v]) for i, v in rows])  # deviations that no long holds
    assert beyond.deviation.isna().all() and beyond.identity_error[0] < 1e-8
    with pytest.raises(Exception, match="beyond"):
        run(spark, [(1, [1e30, 0.0]), (2, [0.0, 1.0])])


def test_inertia_counts_signs():
    rng = np.random.default_rng(4)
    for size in (1, 2, 5, 30):
        a = rng.normal(size=(size, size))
        values = np.linalg.eigvalsh(a + a.T)
        assert whitening.inertia(a + a.T) == ((values < 0).sum(), (values > 0).sum())
    assert whitening.inertia(np.array([[0.0, 1], [1, 0]])) == (1, 1)
    assert whitening.inertia(np.zeros((3, 3))) == (0, 0)


@pytest.mark.parametrize(
    "values",
    [[9, 7, 5, 3, 1], [5, 5, 5, 2, 2, 1, 1, 1, 1, 0.5], [1, 1 - 1e-9, 1 - 2e-9, 0.1], [1, 0, 0, 0], [3] * 12, [1e12, 1e3, 1e-3]],
)
def test_leading_pairs(values):
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(len(values), len(values))))
    matrix = q @ np.diag(np.array(values, float)) @ q.T
    matrix = (matrix + matrix.T) / 2
    found, rows = whitening.leading(matrix)
    want = [v for v in values if v > 1e-11 * sum(values)][:8]
    assert np.allclose(found, want, rtol=1e-9, atol=1e-12 * max(values))
    assert np.abs(rows @ rows.T - np.eye(len(want))).max() < 1e-10
    assert np.abs(matrix @ rows.T - rows.T * found).max() < 1e-10 * max(values)
