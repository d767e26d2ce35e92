"""Model operators: invariants on a small separable table (scores in [0,1], AUC floor, shapes)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakscreen.operators import boosting as bo
from peakscreen.operators import evaluation as ev
from peakscreen.operators import modeling as md

FEATS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.RandomState(7)
    n = 600
    a, b, c = rng.rand(n), rng.rand(n), rng.rand(n)
    y = ((a + 0.5 * b + rng.rand(n) * 0.3) > 1.0).astype(int)
    rows = [(i, float(a[i]), float(b[i]), float(c[i]), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double, reported int").cache()


def test_population_scaler_matches_numpy(spark, table):
    fm = md.fit_model(table, FEATS, "logistic")
    scaled = fm.model.stages[2].transform(fm.model.stages[1].transform(
        fm.model.stages[0].transform(table.withColumn("label", F.col("reported").cast("double")))))
    from pyspark.ml.functions import vector_to_array
    z = np.array([r[0] for r in scaled.select(vector_to_array("scaled")).orderBy("row_id").collect()])
    X = np.array([[r["a"], r["b"], r["c"]] for r in table.orderBy("row_id").collect()])
    ref = (X - X.mean(0)) / X.std(0)
    assert np.abs(z - ref).max() < 1e-9


@pytest.mark.parametrize("kind", ["logistic", "forest", "gbt", "mlp"])
def test_scores_and_auc(table, kind):
    fm = md.fit_model(table, FEATS, kind, maxIter=20) if kind in ("gbt", "mlp") else \
        md.fit_model(table, FEATS, kind)
    s = md.score(fm, table)
    rng = s.agg(F.min("probas"), F.max("probas")).first()
    assert 0.0 <= rng[0] <= rng[1] <= 1.0
    assert ev.roc_auc(s) > 0.8
    if kind in ("logistic", "forest", "gbt"):
        w = md.coefficients(fm)
        assert [n for n, _ in w] == FEATS


def test_balanced_weights(table):
    w = md.balanced_weights(table).groupBy("reported").agg(F.first("weight"), F.count("*")).collect()
    n = sum(r[2] for r in w)
    for r in w:
        assert abs(r[1] - n / (2 * r[2])) < 1e-12


def test_compare_search_curve_pca_early_stop(spark, table):
    tr = table.where(F.col("row_id") % 3 != 0)
    va = table.where(F.col("row_id") % 3 == 0)
    res, fitted = md.compare_models(["logistic"], tr, va, va, FEATS)
    row = res.first()
    assert row["model"] == "logistic" and 0 <= row["threshold"] <= 1 and row["f1"] > 0.5
    assert 0.8 < row["auc"] <= 1.0
    best, f1 = md.random_search(table, FEATS, "logistic", {"regParam": (0.0, 0.5)}, n_iter=3, k=3)
    assert set(best) == {"regParam"} and 0.7 <= f1 <= 1.0
    lc = md.learning_curve(table, FEATS, "logistic", (0.5, 1.0), 3).collect()
    assert len(lc) == 2 and all(0 <= r["test_f1_mean"] <= 1 for r in lc)
    ratios, pts = md.pca_summary(table, FEATS, 2)
    assert len(ratios) == 2 and sum(ratios) <= 100.0 + 1e-9 and pts.count() == 600
    es = md.early_stopped_gbt(table, FEATS, max_iter=15)
    assert 1 <= es.extras["rounds"] <= 15
    assert not math.isnan(ev.roc_auc(md.score(es, table)))


def test_boosting_fits_in_a_task_that_gets_the_chosen_rows_alone(spark, monkeypatch):
    kind = type(spark.range(1))
    plans, real = [], kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **k: (plans.append(self._jdf.queryExecution().toString()), real(self, *a, **k))[1])
    rows = spark.range(0, 400, 1, 8).selectExpr("id AS row_id", "CAST(id % 7 AS DOUBLE) AS a", "CAST(id % 7 > 3 AS INT) AS reported")
    bo.fit_boosted(rows, ["a"], fit_rows=50, rounds=3)
    assert any("REPARTITION_BY_NUM" in p for p in plans) and not any("Coalesce 1" in p for p in plans)
