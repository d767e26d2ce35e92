"""One-pass Gram algebra against per-column regressions and a direct lasso solver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakscreen.operators import linalg as la


def _frame(spark, X, names, y=None):
    rows = [tuple(float(v) for v in r) + ((float(y[i]),) if y is not None else ())
            for i, r in enumerate(X)]
    schema = ", ".join(f"{n} double" for n in names) + (", y double" if y is not None else "")
    return spark.createDataFrame(rows, schema)


def _vif_regression(X, i, centred):
    others = np.delete(X, i, axis=1)
    beta, *_ = np.linalg.lstsq(others, X[:, i], rcond=None)
    rss = ((X[:, i] - others @ beta) ** 2).sum()
    tss = ((X[:, i] - X[:, i].mean()) ** 2).sum() if centred else (X[:, i] ** 2).sum()
    return tss / rss


def test_vif_uncentred(spark):
    rng = np.random.RandomState(0)
    a = rng.rand(300)
    X = np.column_stack([a, a * 2 + rng.rand(300) * 0.3, rng.rand(300) + 1])
    got = dict(la.vif(_frame(spark, X, ["a", "b", "c"]), ["a", "b", "c"]).collect())
    for i, n in enumerate("abc"):
        assert abs(got[n] - _vif_regression(X, i, centred=False)) < 1e-6 * got[n]


def test_vif_implicit_constant_uses_centred(spark):
    rng = np.random.RandomState(1)
    g = rng.randint(0, 3, 400)
    onehot = np.eye(3)[g]
    x = rng.rand(400) + g * 0.5
    X = np.column_stack([x, onehot])
    names = ["x", "o0", "o1", "o2"]
    got = dict(la.vif(_frame(spark, X, names), names).collect())
    assert abs(got["x"] - _vif_regression(X, 0, centred=True)) < 1e-6 * got["x"]


def test_correlation_long(spark):
    rng = np.random.RandomState(2)
    X = rng.rand(200, 3)
    X[:, 1] += X[:, 0]
    df = _frame(spark, X, ["a", "b", "c"])
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in la.correlation_long(df, ["a", "b", "c"]).collect()}
    c = np.corrcoef(X.T)
    for i, a in enumerate("abc"):
        for j, b in enumerate("abc"):
            assert abs(got[(a, b)] - c[i, j]) < 1e-9


def _ista(Z, y, alpha, iters=20000):
    n = len(y)
    L = np.linalg.eigvalsh(Z.T @ Z / n).max()
    w = np.zeros(Z.shape[1])
    for _ in range(iters):
        g = Z.T @ (Z @ w - y) / n
        u = w - g / L
        w = np.sign(u) * np.maximum(np.abs(u) - alpha / L, 0)
    return w


def test_lasso_path_matches_direct_solver(spark):
    rng = np.random.RandomState(4)
    X = rng.rand(500, 4)
    y = (X[:, 0] * 2 - X[:, 2] + rng.rand(500) * 0.1 > 0.6).astype(float)
    df = _frame(spark, X, ["a", "b", "c", "d"], y)
    path = la.lasso_path(df, ["a", "b", "c", "d"], "y", alphas=[1e-3, 1e-1]).collect()
    Z = (X - X.mean(0)) / X.std(0)
    for alpha in (1e-3, 1e-1):
        w = _ista(Z, y, alpha)
        got = {r["feature"]: r["coef"] for r in path if r["alpha"] == alpha}
        for j, f in enumerate("abcd"):
            assert abs(got[f] - w[j]) < 1e-5
    assert {r["rank"] for r in path} == {1, 2, 3, 4}
    assert any(r["highlight"] for r in path) and F is not None


def test_vif_and_lasso_on_mixed_scales(spark):
    """Columns of scale 1e7, 0.1 and 1e-3 with a collinear pair; a mean far above the deviation."""
    from peakscreen.operators import linalg

    rng = np.random.default_rng(0)
    area, width = rng.normal(1e7, 2e6, 400), rng.normal(0.1, 0.02, 400)
    twin, tiny = width + rng.normal(0, 2e-4, 400), rng.normal(1e-3, 1e-4, 400)
    x = np.column_stack([area, width, twin, tiny])
    df = spark.createDataFrame([(*map(float, r), float(1e8 + i % 3)) for i, r in enumerate(x)], "a double, w double, t double, s double, far double")
    got = {r["feature"]: r["vif"] for r in linalg.vif(df, ["a", "w", "t", "s"]).collect()}
    for j, c in enumerate("awts"):
        others = np.delete(x, j, axis=1)
        scaled = others / np.linalg.norm(others, axis=0)
        rest = x[:, j] - scaled @ np.linalg.lstsq(scaled, x[:, j], rcond=None)[0]
        assert got[c] == pytest.approx((x[:, j] ** 2).sum() / (rest ** 2).sum(), rel=1e-4)
    path = linalg.lasso_path(df, ["far", "w"], "s", alphas=[1e-9]).collect()
    assert all(np.isfinite(r["coef"]) for r in path)
