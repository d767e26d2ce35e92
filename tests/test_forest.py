"""The forest grown by shuffles: cuts, partitions, passes over large nodes, scores, copies, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakscreen.operators import evaluation as ev
from peakscreen.operators import forest as fo
from peakscreen.operators import modeling as md
from peakscreen.sources import tables as st

FEATS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.RandomState(5)
    a, b, c = rng.rand(900), rng.randint(0, 5, 900), rng.rand(900)
    y = (a + 0.1 * b + 0.5 * rng.rand(900) > 0.9).astype(int)
    return spark.createDataFrame([(i, float(a[i]), float(b[i]), float(c[i]), int(y[i])) for i in range(900)],
                                 "row_id long, a double, b double, c double, reported int").cache()


def scores(fm, df):
    return [(r["row_id"], r["probas"]) for r in md.score(fm, df).select("row_id", "probas").orderBy("row_id", "probas").collect()]


def test_best_cuts_are_those_of_all_cuts():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 4, (5, 2, fo.BINS, 2))
    full = np.flatnonzero(counts.sum(axis=3).reshape(-1))
    code, gain, left, whole = fo._best_cuts(full, *(counts[..., c].reshape(-1)[full] for c in (0, 1)), 2, (1.0, 2.0))
    for node in range(5):
        def purity(n):
            w = n * np.array([1.0, 2.0])
            return (w ** 2).sum() / w.sum() if w.sum() else 0.0
        every = [purity(counts[node, j, :b + 1].sum(0)) + purity(counts[node, j, b + 1:].sum(0)) - purity(counts[node, j].sum(0))
                 for j in range(2) for b in range(fo.BINS - 1)]
        assert np.isclose(gain[node], max(every))
        j, b = code[node] // fo.BINS % 2, code[node] % fo.BINS
        assert [left[0][node], left[1][node]] == counts[node, j, :b + 1].sum(0).tolist()
        assert [whole[0][node], whole[1][node]] == counts[node, j].sum(0).tolist()


def test_grown_tree_tells_rows_apart():
    x = np.array([[i % 32, i // 32] for i in range(256)], np.uint8)
    y = ((x[:, 0] % 5 > 1) & (x[:, 1] > 2)).astype(int)
    tree, gains = fo.grow(x, 1 - y, y, 30, 2, (1.0, 1.0), np.random.default_rng(0))
    assert (tree.predict(x) == y).all() and (gains > 0).all()
    stump, _ = fo.grow(x, 1 - y, y, 0, 2, (1.0, 1.0), np.random.default_rng(0))
    assert stump.predict(x).tolist() == [y.mean()] * 256


@pytest.mark.parametrize("subtree_rows", [1 << 16, 250])
def test_forest_does_not_depend_on_partitions(table, subtree_rows):
    one = md.fit_model(table, FEATS, "forest", trees=4, subtree_rows=subtree_rows)
    two = md.fit_model(table.repartition(7), FEATS, "forest", trees=4, subtree_rows=subtree_rows)
    assert scores(one, table) == scores(two, table.repartition(3))
    assert (max(len(t.feature) for t in one.model.tops) > 3) == (subtree_rows == 250)
    s = md.score(one, table)
    assert 0.8 < ev.roc_auc(s) <= 1 and s.columns == [*table.columns, "probas"] and s.count() == 900
    weights = dict(md.coefficients(one))
    assert abs(sum(weights.values()) - 1) < 1e-9 and weights["a"] == max(weights.values())


def test_equal_rows_count_as_often_as_they_occur(spark):
    rows = spark.createDataFrame([(1, 0.0, 1)] * 300 + [(1, 0.0, 0)] * 100 + [(None, 1.0, 0)] * 200 + [(None, None, 0)] * 200,
                                 "row_id long, a double, reported int")
    fm = md.fit_model(rows, ["a"], "forest", weighted=False, trees=40)
    got = {r["a"]: (r["p"], r["n"]) for r in md.score(fm, rows).groupBy("a").agg(F.avg("probas").alias("p"), F.count("*").alias("n")).collect()}
    assert abs(got[0.0][0] - 0.75) < 0.03 and got[0.0][1] == 400
    assert got[1.0] == (0.0, 200) and got[None] == (0.0, 200)
    assert abs(np.mean([fo._drawn_counts(np.array([k], np.uint64), np.array([300]), 1, 7)[0] for k in range(400)]) - 300) < 5


def test_saved_forest_scores_as_before(spark, table, tmpdir_path):
    fm = md.fit_model(table, FEATS, "forest", trees=5, max_depth=4)
    st.save_fitted(spark, fm, f"{tmpdir_path}/m")
    assert scores(st.load_fitted(spark, f"{tmpdir_path}/m"), table) == scores(fm, table)


def test_no_labelled_rows(spark):
    with pytest.raises(ValueError):
        md.fit_model(spark.createDataFrame([(1, 1.0, None)], "row_id long, a double, reported int"), ["a"], "forest")
