"""One-pass optimality checks of fitted models.

A fit is iterative and has no closed form, but its optimum has: an unpenalised logistic regression reproduces the
observed feature moments, a lasso solution has bounded residual correlations, a principal component is an
eigenvector. Each check is a single pass over the rows with sums of fixed size, and is stated
in quantities that SQL computes from the data alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakscreen.session import ship_package


def _columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(F.array(*[F.col(f"`{c}`").cast("double") for c in cols]).alias("x"))


def _scaling(df: DataFrame, cols: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and population deviations (1 for a constant column)."""
    r = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
               *[F.stddev_pop(F.col(f"`{c}`").cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    mean = np.array([r[f"m{i}"] or 0.0 for i in range(len(cols))])
    return int(r["n"]), mean, np.array([r[f"s{i}"] or 1.0 for i in range(len(cols))])


def _sums(rows: DataFrame, width: int, shape: tuple[int, ...], add) -> np.ndarray:
    """Sum of ``add(matrix of a batch)`` over all rows."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                total += add(b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
        flat = total.reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["at", "x"])

    out = np.zeros(int(np.prod(shape)))
    for r in rows.mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[r["at"]] = r["x"]
    return out.reshape(shape)


def logistic_moments(scored: DataFrame, features: Sequence[str], prob: str = "probas", weight: str | None = None) -> DataFrame:
    """``feature, fitted``: mean of (weighted) probability times standardised feature, and the mean probability.

    At the optimum of an unpenalised fit with intercept and these weights they equal the means with the labels
    in place of the probabilities.
    """
    feats = list(features)
    n, mean, sd = _scaling(scored, feats)
    p = F.col(prob) if weight is None else F.col(prob) * F.col(weight)
    row = scored.agg(F.avg(p).alias("b"), *[F.avg(p * (F.col(f"`{c}`").cast("double") - mean[i]) / sd[i]).alias(f"f{i}")
                                            for i, c in enumerate(feats)]).first()
    rows = [("(intercept)", row["b"]), *((c, row[f"f{i}"]) for i, c in enumerate(feats))]
    return scored.sparkSession.createDataFrame(rows, "feature string, fitted double")


def lasso_conditions(df: DataFrame, features: Sequence[str], target: str, path: DataFrame) -> DataFrame:
    """Per penalty and feature of a lasso ``path``: ``excess`` of the residual correlation over the penalty, ``slack`` of an
    active feature's correlation from it, and ``null_model``: whether every coefficient is zero. Both are zero at the optimum."""
    feats = list(features)
    p = len(feats)
    got = path.select("alpha_idx", "alpha", "feature", "coef").collect()       # penalties x features
    alphas = {r["alpha_idx"]: r["alpha"] for r in got}
    at = {f: j for j, f in enumerate(feats)}
    w = np.zeros((p, len(alphas)))
    for r in got:
        w[at[r["feature"]], r["alpha_idx"]] = r["coef"]
    n, mean, sd = _scaling(df, feats)

    def add(m):
        z, y = (m[:, :p] - mean) / sd, m[:, p:]
        return z.T @ (y - z @ w)

    g = _sums(_columns(df, [*feats, target]), p + 1, w.shape, add) / max(n, 1)
    rows = []
    for k, a in sorted(alphas.items()):
        for j, f in enumerate(feats):
            over = abs(float(g[j, k])) - a
            rows.append((k, f, max(0.0, over), abs(g[j, k] - a * np.sign(w[j, k])).item() if w[j, k] else 0.0, not w[:, k].any()))
    return df.sparkSession.createDataFrame(rows, "alpha_idx int, feature string, excess double, slack double, null_model boolean")


def component_residuals(df: DataFrame, features: Sequence[str], components: np.ndarray, values: np.ndarray) -> list[float]:
    """Largest entry of C v - lambda v for each column v, with C the correlation matrix, from one pass."""
    feats = list(features)
    n, mean, sd = _scaling(df, feats)

    def add(m):
        z = (m - mean) / sd
        return z.T @ (z @ components)

    cv = _sums(_columns(df, feats), len(feats), components.shape, add) / max(n, 1)
    return [float(x) for x in np.abs(cv - components * values).max(axis=0)]


def spectral_moments(values: np.ndarray, powers: Sequence[int]) -> list[float]:
    """Sums of powers of all eigenvalues: the traces of the matrix's powers."""
    return [float((values ** k).sum()) for k in powers]
