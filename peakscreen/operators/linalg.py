"""One-pass moment aggregates and the small p x p algebra built on them.

Correlation, VIF and the lasso path all need only the first and second moments
of the feature columns. Those come from a single aggregate over the table
(map-side partial sums, one tiny result row); the algebra then runs on p x p
matrices on the driver, whose size depends on the number of features, never on
the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _c(name: str):
    return F.col(f"`{name}`")


def moments(df: DataFrame, cols: Sequence[str], target: str | None = None) -> dict:
    """n, column sums, Gram matrix X'X (and X'y, y'y, sum y) in one aggregate."""
    cols = list(cols)
    p = len(cols)
    x = [_c(c).cast("double") for c in cols]
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(x[i]).alias(f"s{i}") for i in range(p)]
    aggs += [F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)]
    if target is not None:
        y = _c(target).cast("double")
        aggs += [F.sum(y).alias("sy"), F.sum(y * y).alias("syy")]
        aggs += [F.sum(x[i] * y).alias(f"c{i}") for i in range(p)]
    r = df.agg(*aggs).first()
    g = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            g[i, j] = g[j, i] = r[f"g{i}_{j}"] or 0.0
    out = {"n": int(r["n"]), "s": np.array([r[f"s{i}"] or 0.0 for i in range(p)]), "G": g}
    if target is not None:
        out.update(sy=r["sy"] or 0.0, syy=r["syy"] or 0.0,
                   c=np.array([r[f"c{i}"] or 0.0 for i in range(p)]))
    return out


def correlation_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every ordered column pair, long form (A10).

    One aggregate of ``corr`` expressions (numerically stable, JVM-side).
    A constant column yields null.
    """
    cols = list(cols)
    p = len(cols)
    aggs = [F.corr(_c(cols[i]).cast("double"), _c(cols[j]).cast("double")).alias(f"r{i}_{j}")
            for i in range(p) for j in range(i, p)]
    wide = df.agg(*aggs)
    pairs = []
    for i in range(p):
        for j in range(p):
            a, b = min(i, j), max(i, j)
            pairs.append(F.struct(F.lit(cols[i]).alias("col_a"), F.lit(cols[j]).alias("col_b"),
                                  F.col(f"r{a}_{b}").alias("corr")))
    return wide.select(F.inline(F.array(*pairs)))


def _has_implicit_constant(g: np.ndarray, s: np.ndarray, n: int, tol: float = 1e-9) -> bool:
    """Does the column span contain the all-ones vector? (least squares of 1 on X)."""
    if n == 0 or g.size == 0:
        return False
    beta = np.linalg.pinv(g) @ s
    rss = n - 2 * s @ beta + beta @ g @ beta
    return rss / n < tol


def vif_values(m: dict, cols: Sequence[str]) -> list[tuple[str, float]]:
    """VIF_i = TSS_i / RSS_i for the regression of x_i on the other columns, no intercept added.

    RSS_i = 1 / (G^-1)_ii. TSS_i is uncentred (G_ii) unless the other columns
    contain a constant (explicit or a complete one-hot set), in which case it
    is centred, as an OLS fit reports R^2 in that case. Near-singular Gram
    matrices use the pseudo-inverse; a perfectly explained column gets inf.
    Columns are scaled to unit length first, so no column is taken for noise
    because its unit is small (VIF does not depend on units).
    """
    length = np.sqrt(np.diag(m["G"]))
    length = np.where(length > 0, length, 1.0)
    g, s, n = m["G"] / np.outer(length, length), m["s"] / length, m["n"]
    p = len(cols)
    out = []
    for i in range(p):
        others = [j for j in range(p) if j != i]
        go = g[np.ix_(others, others)]
        gi = g[others, i]
        beta = np.linalg.pinv(go) @ gi if others else np.zeros(0)
        rss = g[i, i] - 2 * gi @ beta + beta @ go @ beta if others else g[i, i]
        if others and _has_implicit_constant(go, s[others], n):
            tss = g[i, i] - s[i] ** 2 / n
        else:
            tss = g[i, i]
        out.append((cols[i], float("inf") if rss <= 1e-12 * max(tss, 1e-300) else float(tss / rss)))
    return out


def vif(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Variance inflation factor per feature, sorted descending."""
    m = moments(df, cols)
    rows = vif_values(m, cols)
    spark = df.sparkSession
    return spark.createDataFrame(rows, "feature string, vif double").orderBy(F.col("vif").desc())


def lasso_coordinate_descent(zz: np.ndarray, zy: np.ndarray, alpha: float, n: int,
                             w0: np.ndarray | None = None, tol: float = 1e-10,
                             max_iter: int = 100000) -> np.ndarray:
    """min_w (1/2n)||y - Zw||^2 + alpha ||w||_1 from Z'Z and Z'y (cyclic coordinate descent)."""
    p = zz.shape[0]
    w = np.zeros(p) if w0 is None else w0.copy()
    a = zz / n
    b = zy / n
    for _ in range(max_iter):
        delta = 0.0
        for j in range(p):
            if a[j, j] <= 0:
                continue
            rho = b[j] - a[j] @ w + a[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - alpha, 0.0) / a[j, j]
            delta = max(delta, abs(new - w[j]))
            w[j] = new
        if delta < tol:
            return w
    raise RuntimeError(f"coordinate descent did not converge in {max_iter} rounds")


def lasso_path(df: DataFrame, features: Sequence[str], target: str,
               alphas: Sequence[float] | None = None, highlight: float = 0.2) -> DataFrame:
    """Lasso coefficients on standardised features for each penalty, long form.

    Features are centred and scaled by their population standard deviation,
    no intercept is fitted and the target is used as is. One aggregate gives
    every quantity needed for all penalties.
    """
    feats = list(features)
    alphas = list(alphas if alphas is not None else np.logspace(-6, -1, 50))
    # Covariance aggregates merge without cancellation, unlike sums of products.
    p = len(feats)
    x, y = [_c(f).cast("double") for f in feats], _c(target).cast("double")
    r = df.agg(F.count(F.lit(1)).alias("n"),
               *[F.covar_pop(x[i], x[j]).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)],
               *[F.covar_pop(x[i], y).alias(f"c{i}") for i in range(p)]).first()
    n = int(r["n"])
    cov = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(p)] for i in range(p)]).reshape(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    sd_safe = np.where(sd > 0, sd, 1.0)
    zz = n * cov / np.outer(sd_safe, sd_safe)
    zy = n * np.array([r[f"c{i}"] or 0.0 for i in range(p)]) / sd_safe
    w = None
    rows = []
    path = []
    for a in sorted(alphas, reverse=True):   # warm start from strong penalties
        w = lasso_coordinate_descent(zz, zy, a, n, w)
        path.append((a, w.copy()))
    path.sort(key=lambda t: t[0])
    coefs = np.array([w for _, w in path])           # (n_alpha, p)
    strong = (np.abs(coefs) > highlight).any(axis=0)
    order = np.argsort(-np.abs(coefs[0]), kind="stable")
    rank = np.empty(len(feats), dtype=int)
    rank[order] = np.arange(1, len(feats) + 1)
    for k, (a, w) in enumerate(path):
        for j, f in enumerate(feats):
            rows.append((k, float(a), f, float(w[j]), bool(strong[j]), int(rank[j])))
    spark: SparkSession = df.sparkSession
    return spark.createDataFrame(
        rows, "alpha_idx int, alpha double, feature string, coef double, highlight boolean, rank int")
