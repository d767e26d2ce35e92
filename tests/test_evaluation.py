"""Single-pass evaluation operators against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakscreen.operators import evaluation as ev


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.RandomState(3)
    p = np.concatenate([rng.rand(400), np.arange(51) * 0.02, [1.0, 0.0, -0.1, 1.2]])
    y = (rng.rand(len(p)) < p).astype(int)
    rows = [(i, float(a), int(b)) for i, (a, b) in enumerate(zip(p, y))]
    return spark.createDataFrame(rows, "row_id long, probas double, reported int"), p, y


def test_threshold_sweep_brute_force(scored):
    df, p, y = scored
    sw = {r["i"]: r for r in ev.threshold_sweep(df).collect()}
    grid = np.linspace(0, 1, 51)
    for i, t in enumerate(grid):
        pred = p >= t
        tp, fp = int((pred & (y == 1)).sum()), int((pred & (y == 0)).sum())
        fn, tn = int((~pred & (y == 1)).sum()), int((~pred & (y == 0)).sum())
        r = sw[i]
        assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (tp, fp, fn, tn)
        f1 = 0.0 if 2 * tp + fp + fn == 0 else 2 * tp / (2 * tp + fp + fn)
        assert abs(r["f1"] - f1) < 1e-12
    best = ev.best_threshold(ev.threshold_sweep(df)).first()
    f1s = [sw[i]["f1"] for i in range(51)]
    assert best["threshold"] == grid[int(np.argmax(f1s))]


def test_roc_and_auc_brute_force(scored):
    df, p, y = scored
    roc = {round(r["threshold"], 12): r for r in ev.roc_points(df).collect()}
    P, N = (y == 1).sum(), (y == 0).sum()
    for t in np.unique(p):
        r = roc[round(float(t), 12)]
        assert r["tps"] == int(((p >= t) & (y == 1)).sum())
        assert r["fps"] == int(((p >= t) & (y == 0)).sum())
    ts = np.sort(np.unique(p))[::-1]
    fpr = np.array([0.0] + [((p >= t) & (y == 0)).sum() / N for t in ts])
    tpr = np.array([0.0] + [((p >= t) & (y == 1)).sum() / P for t in ts])
    auc = float(np.sum((fpr[1:] - fpr[:-1]) * (tpr[1:] + tpr[:-1]) / 2))
    assert abs(ev.roc_auc(df) - auc) < 1e-12


def test_histogram_matches_numpy(spark):
    rng = np.random.RandomState(5)
    vals = rng.rand(300)
    rows = [("a", 0, float(v)) for v in vals] + [("b", 1, 0.25)] * 4
    df = spark.createDataFrame(rows, "analyte string, reported int, probas double")
    h = ev.score_histogram(df).collect()
    got_a = {r["bin"]: r["n"] for r in h if r["analyte"] == "a"}
    counts, _ = np.histogram(vals, bins=10)
    assert [got_a.get(i, 0) for i in range(10)] == list(counts)
    got_b = {r["bin"]: r["n"] for r in h if r["analyte"] == "b"}
    cb, _ = np.histogram([0.25] * 4, bins=10)
    assert [got_b.get(i, 0) for i in range(10)] == list(cb)


def test_class_report_and_pivot(spark):
    df = spark.createDataFrame([(0.9, 1), (0.2, 1), (0.7, 0), (0.1, 0)], "probas double, reported int")
    rep = {r["class"]: r for r in ev.class_report(df, threshold=0.5).collect()}
    assert rep["1"]["precision"] == 0.5 and rep["1"]["recall"] == 0.5 and rep["1"]["support"] == 2
    assert rep["accuracy"]["support"] == 0.5          # accuracy repeated in every column
    assert rep["macro avg"]["support"] == 4
    pv = spark.createDataFrame([("A", 0, "s"), ("A", 1, "s"), ("B", 0, "s"), ("B", 0, None)],
                               "analyte string, reported int, `Sample Name` string")
    out = {r["analyte"]: r for r in ev.class_pivot(pv).collect()}
    assert (out["A"]["n_0"], out["A"]["n_1"], out["A"]["total"]) == (1, 1, 2)
    assert out["B"]["n_0"] == 1 and out["B"]["n_1"] is None and out["B"]["total"] is None


def test_profit_curve_parity_formula(spark):
    roc = spark.createDataFrame([(0.5, 1, 2, 0.25, 0.5)],
                                "threshold double, fps long, tps long, fpr double, tpr double")
    c = {r["threshold"]: r for r in ev.profit_curve(roc, positives=4, negatives=4, extra_negatives=10,
                                                    parity=True).collect()}
    fp_n, tn_n = 0.25 * 4, 0.75 * 4 + 10
    expect = -(1 - 0.5) + 0.5 * tn_n / (tn_n + fp_n)
    assert abs(c[0.5]["profit"] - expect) < 1e-12
    assert c[1.0]["tpr"] == 0.0                          # curve starts at threshold 1


def test_roc_drop_intermediate(scored):
    df, p, y = scored
    ts = np.sort(np.unique(p))[::-1]
    fps = np.array([((p >= t) & (y == 0)).sum() for t in ts])
    tps = np.array([((p >= t) & (y == 1)).sum() for t in ts])
    keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
    got = sorted(round(r["threshold"], 12) for r in ev.roc_points(df, drop_intermediate=True).collect())
    assert got == sorted(round(float(t), 12) for t in ts[keep])


def test_rounded_f1_loss(spark):
    df = spark.createDataFrame([(0.5, 1), (0.51, 1), (0.2, 0), (0.7, 0)], "probas double, reported int")
    # 0.5 rounds to 0 (half to even): tp=1, fp=1, fn=1 -> F1 = 0.5
    assert abs(ev.rounded_f1_loss(df) - 0.5) < 1e-12


def test_histogram_counts_null_groups(spark):
    df = spark.createDataFrame([(.1, None, 1), (.2, "a", None), (.3, "a", 0)], "probas double, analyte string, reported int")
    out = ev.score_histogram(df).collect()
    assert sum(r.n for r in out) == 3 and {(r.analyte, r.reported) for r in out} == {(None, 1), ("a", None), ("a", 0)}


def test_best_profit_is_the_curve_s_maximum(spark):
    rng = np.random.default_rng(7)
    for cost in ((0.0, 0.0, -1.0, 0.5), (-2.0, 1.0, -1.0, 0.0)):
        score = np.round(rng.random(2000), 3)
        y = (rng.random(2000) < score ** 2).astype(int)
        df = spark.createDataFrame([(float(s), int(t)) for s, t in zip(score, y)] + [(None, 1)], "probas double, reported int")
        curve = ev.profit_curve(ev.roc_points(df), int(y.sum()), int((1 - y).sum()), cost, 500)
        want = curve.orderBy(F.desc("profit"), F.desc("threshold")).first()
        for n in (1, 4, 64):
            got = ev.best_profit(df, cost=cost, extra_negatives=500, n_blocks=n).first()
            assert got.threshold == want.threshold and np.isclose(got.profit, want.profit)
    empty = spark.createDataFrame([], "probas double, reported int")
    assert ev.best_profit(empty).first().threshold == 1.0
