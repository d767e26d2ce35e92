"""Boosted trees learn from all rows, however these are dealt out."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from peakscreen.operators import binned as bi
from peakscreen.operators import boosting as bo
from peakscreen.operators import trees as tr

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    x = np.c_[rng.normal(size=(24_000, 2)), rng.integers(0, 9, 24_000), rng.integers(0, 2, 24_000)].astype(float)
    y = (x[:, 0] + x[:, 2] / 4 + rng.normal(size=24_000) > 1.5).astype(float)
    return x, y


@pytest.fixture(scope="module")
def table(spark, rows):
    x, y = rows
    return spark.createDataFrame([(i, *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y))],
                                 "row_id long, a double, b double, c double, d double, reported int").repartition(5).cache()


def test_edges_are_those_of_all_rows(table, rows):
    x, _ = rows
    fold = (F.col("row_id") % 3).cast("int")
    edges, n = bi.edges_without(table.select(F.array(*FEATURES).alias("x"), fold.alias("fold")), 4, [0, 2, 7])
    for got, k in zip(edges, (0, 2, 7)):
        want = tr.bin_edges(x[np.arange(len(x)) % 3 != k])
        assert all(np.array_equal(a, b) for a, b in zip(got, want))
        among = bi.united(edges)
        codes = tr.binned(x, among)
        assert all(np.array_equal(bi.lookup(e, u)[codes[:, f]], np.searchsorted(e, x[:, f], "left")) for f, (e, u) in enumerate(zip(got, among)))
    assert n == [16_000, 16_000, 24_000]


@pytest.mark.parametrize("task_rows", [1 << 16, 7000])
def test_a_fit_learns_from_every_row(table, rows, task_rows):
    """The same trees as boosting all rows in one place; 20,000 of these 24,000 rows were used before."""
    x, y = rows
    model = bo.fit_boosted(table, FEATURES, rounds=4, task_rows=task_rows)
    bins, kept = tr.binned(x, tr.bin_edges(x)), []
    how = tr.Growth(**{k: bo.STUDY[k] for k in ("max_depth", "min_child_weight", "gamma", "reg_lambda", "reg_alpha")})
    for _ in tr.boosted_margins(bins, y, bins[:0], 4, bo.STUDY["eta"], how, 43, bo.STUDY["subsample"], bo.STUDY["columns"], bo.STUDY["pos_weight"], keep=kept):
        pass
    for (cols, tree), (want, other) in zip(model.rounds, kept):
        assert np.array_equal(cols, want) and np.array_equal(tree.feature, other.feature) and np.array_equal(tree.cut, other.cut)
        assert np.allclose(tree.value, other.value, atol=1e-9)


def test_parts_grow_the_tree_of_the_whole():
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 16, (900, 5))
    g, h, n = (np.rint(a * 2 ** 20) for a in (rng.normal(size=900), rng.random(900), np.ones(900)))
    for how in (tr.Growth(max_depth=7, gamma=.01), tr.Growth(max_depth=9, min_child_weight=.5, reg_lambda=.1, reg_alpha=.1),
                tr.Growth(max_depth=6, features=2, min_split=9)):
        whole = tr.grow(bins, g / 2 ** 20, h / 2 ** 20, n / 2 ** 20, how, np.random.default_rng(1))
        parts = [(bins[lo:lo + 250].T.astype(np.uint8), [a[lo:lo + 250] for a in (g, h, n)]) for lo in range(0, 900, 250)]
        tree = tr.grow_parts(parts, 5, 16, how, np.random.default_rng(1), 3, lambda x: x / 2 ** 20)
        assert all(np.array_equal(getattr(whole, k), getattr(tree, k)) for k in ("feature", "cut", "left", "value"))
        assert np.array_equal(whole.predict(bins), tr.predict_lines(tree, bins.T))


def test_tasks_that_share_no_files_add_up_through_spark(table):
    def run(batches):
        for _ in batches:
            pass
        s = bo.Sums(None)
        yield pa.RecordBatch.from_arrays([pa.array([float(s(np.full(3, s.me + 1.0)).sum())])], names=["x"])

    assert [r.x for r in table.limit(300).repartition(2).mapInArrow(run, "x double", barrier=True).collect()] == [9.0, 9.0]
