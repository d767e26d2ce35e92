"""Optimality checks accept optima and notice what is off."""

import numpy as np
from pyspark.sql import functions as F

from peakscreen.operators import certificates as ce
from peakscreen.operators import linalg as la
from peakscreen.operators import modeling as md


def _table(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3)) * [1, 100, 5]
    y = (x[:, 0] + x[:, 1] / 100 + rng.normal(size=300) > 0).astype(int)
    return spark.createDataFrame([(i, *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y))],
                                 "row_id long, a double, b double, c double, reported int"), x, y


def test_logistic_moments(spark):
    df, x, y = _table(spark)
    fitted = md.fit_model(df, ["a", "b", "c"], "logistic", weighted=False, tol=1e-12)
    got = {r.feature: r.fitted for r in ce.logistic_moments(md.score(fitted, df), ["a", "b", "c"]).collect()}
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    assert np.allclose([got["(intercept)"], got["a"], got["b"], got["c"]], [y.mean(), *(z * y[:, None]).mean(axis=0)], atol=1e-3)
    off = ce.logistic_moments(df.withColumn("probas", F.lit(0.3)), ["a", "b", "c"]).collect()
    assert abs(off[0].fitted - y.mean()) > .05


def test_lasso_conditions(spark):
    df, _, _ = _table(spark)
    path = la.lasso_path(df, ["a", "b", "c"], "reported")
    good = ce.lasso_conditions(df, ["a", "b", "c"], "reported", path).collect()
    assert len(good) == 150 and max(max(r.excess, r.slack) for r in good) < 1e-8
    bad = ce.lasso_conditions(df, ["a", "b", "c"], "reported", path.withColumn("coef", F.col("coef") * 1.05)).collect()
    assert max(max(r.excess, r.slack) for r in bad) > 1e-3


def test_component_residuals(spark):
    df, x, _ = _table(spark)
    model = md.fit_pca(df, ["a", "b", "c"], 3).stages[-1]
    values, vectors = model.explainedVariance.toArray() * 3, model.pc.toArray()
    assert max(ce.component_residuals(df, ["a", "b", "c"], vectors, values)) < 1e-9
    assert max(ce.component_residuals(df, ["a", "b", "c"], np.roll(vectors, 1, axis=1), values)) > 1e-3
    c = np.corrcoef(x.T)
    assert np.allclose(ce.spectral_moments(values, (1, 2, 3)), [np.trace(np.linalg.matrix_power(c, k)) for k in (1, 2, 3)])
