"""Hash-ordered sampling: sizes, determinism across partitionings, exact neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakscreen.operators import knn
from peakscreen.operators import sampling as sm


def _labels(spark, n=1000, pos_every=7):
    return spark.createDataFrame([(i, 1 if i % pos_every == 0 else 0) for i in range(n)],
                                 "row_id long, reported int")


def _ids(df):
    return sorted(r[0] for r in df.select("row_id").collect())


def test_stratified_split_sizes_and_determinism(spark):
    df = _labels(spark)
    out = sm.stratified_split(df, "reported", "row_id", 0.33, 42)
    test = out.where(F.col("split") == "test")
    n_test = int(np.ceil(0.33 * 1000))
    assert test.count() == n_test
    counts = dict(test.groupBy("reported").count().collect())
    assert counts == sm.allocate({0: 857, 1: 143}, n_test)
    for parts in (1, 7, 64):
        again = sm.stratified_split(df.repartition(parts), "reported", "row_id", 0.33, 42)
        assert _ids(again.where(F.col("split") == "test")) == _ids(test)


def test_hash_cut_equals_plain_rank(spark):
    df = _labels(spark, 3000, 3)
    need = {0: 1234, 1: 77}
    got = sm.mark_first_n(df, "reported", "row_id", need, 42).where("_selected")
    from pyspark.sql import Window
    w = Window.partitionBy("reported").orderBy(sm.hash_order("row_id", 42), "row_id")
    ref = df.withColumn("rk", F.row_number().over(w)).where(
        ((F.col("reported") == 0) & (F.col("rk") <= 1234)) | ((F.col("reported") == 1) & (F.col("rk") <= 77)))
    assert _ids(got) == _ids(ref)


def test_under_over_folds(spark):
    df = _labels(spark)
    us = sm.under_sample(df, "reported", "row_id")
    assert dict(us.groupBy("reported").count().collect()) == {0: 143, 1: 143}
    os_ = sm.over_sample(df, "reported", "row_id")
    assert dict(os_.groupBy("reported").count().collect()) == {0: 857, 1: 857}
    assert os_.where(F.col("copy_no") >= 0).select("row_id").subtract(
        df.where("reported = 1").select("row_id")).count() == 0
    folds = sm.stratified_folds(df, "reported", "row_id", 5)
    sizes = folds.groupBy("reported", "fold").count().collect()
    by_cls = {}
    for r in sizes:
        by_cls.setdefault(r["reported"], []).append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in by_cls.values())


def test_knn_exact_and_smote(spark):
    rng = np.random.RandomState(0)
    X = rng.rand(60, 3)
    rows = [(i, 1 if i < 20 else 0, [float(v) for v in X[i]]) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, reported int, vec array<double>")
    mino = df.where("reported = 1")
    for tile in (1000, 7):                    # whole cells, and cells in several tiles
        nb = sm.knn_within(mino, "row_id", "vec", k=3, tile=tile).collect()
        got = {}
        for r in nb:
            got.setdefault(r["row_id"], {})[r["nb_rank"]] = r["nb_id"]
        M = X[:20]
        for i in range(20):
            d = ((M - M[i]) ** 2).sum(1)
            d[i] = np.inf
            assert [got[i][k] for k in range(3)] == list(np.lexsort((np.arange(20), d))[:3])
    out = sm.smote(df, "reported", "row_id", "vec", k=3, seed=1)
    assert dict(out.groupBy("reported").count().collect()) == {0: 40, 1: 40}
    syn = out.where("synthetic").collect()
    assert len(syn) == 20 and all(r["row_id"] < 0 for r in syn)
    lo, hi = X[:20].min(0), X[:20].max(0)
    for r in syn:
        v = np.array(r["vec"])
        assert np.all(v >= lo - 1e-12) and np.all(v <= hi + 1e-12)


def test_null_labels_are_a_class(spark):
    rows = [(i, None if i < 11 else i % 2) for i in range(31)]
    df = spark.createDataFrame(rows, "row_id long, reported int")
    out = sm.stratified_split(df, "reported", "row_id", 0.33, 42)
    test = out.where("split = 'test'")
    assert out.count() == 31 and test.count() == 11
    assert dict(test.groupBy("reported").count().collect()) == sm.allocate({None: 11, 0: 10, 1: 10}, 11)
    assert dict(sm.under_sample(df, "reported", "row_id").groupBy("reported").count().collect()) == {None: 10, 0: 10, 1: 10}
    assert dict(sm.over_sample(df, "reported", "row_id").groupBy("reported").count().collect()) == {None: 11, 0: 11, 1: 11}
    subsets = sm.nested_subsets(df, "reported", "row_id", (0.5, 1.0))
    assert subsets.where("subset IS NULL").isEmpty()


def test_empty_tables(spark):
    df = spark.createDataFrame([], "row_id long, reported int, vec array<double>")
    for out in (sm.stratified_split(df, "reported", "row_id"), sm.random_split(df, "row_id"), sm.under_sample(df, "reported", "row_id"),
                sm.over_sample(df, "reported", "row_id"), sm.smote(df, "reported", "row_id", "vec"),
                sm.knn_within(df, "row_id", "vec"), sm.stratified_folds(df, "reported", "row_id"),
                sm.nested_subsets(df, "reported", "row_id", (0.5, 1.0))):
        assert out.collect() == []


def test_cut_narrows_and_keeps_equal_ids_together(spark, monkeypatch):
    """Many rows with one id share a hash; a bucket beyond the limit is narrowed digit by digit."""
    monkeypatch.setattr(sm, "CUT_ROWS", 2)
    monkeypatch.setattr(sm, "DIGITS", 1)
    df = _labels(spark, 3000, 3)
    need = {0: 1234, 1: 77}
    got = sm.mark_first_n(df, "reported", "row_id", need, 42).where("_selected")
    assert dict(got.groupBy("reported").count().collect()) == need
    same = spark.createDataFrame([(None if i % 3 else 5, 0, i) for i in range(90)] + [(i, 0, i) for i in range(100, 130)],
                                 "row_id long, reported int, x int")
    sides = sm.random_split(same, "row_id", 0.4).groupBy("row_id").agg(F.count_distinct("split").alias("n"))
    assert sides.where("n > 1").isEmpty()


def test_cut_reads_its_input_once_and_ranks_nothing(spark):
    plan = sm.under_sample(_labels(spark), "reported", "row_id")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Union" not in plan and plan.count("Scan ExistingRDD") <= 2


def _plain_knn(rows, k):
    out = []
    for i, v in rows:
        near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w in rows if j != i)[:k]
        out += [(i, n, j, round(d, 9)) for n, (d, j) in enumerate(near)]
    return sorted(out)


def _knn_rows(spark, rows, k, **params):
    df = spark.createDataFrame(rows, "row_id long, vec array<double>").repartition(3)
    return sorted((r[0], r[1], r[2], round(r[3], 9)) for r in sm.knn_within(df, "row_id", "vec", k, **params).collect())


def test_knn_with_ties_copies_and_clusters(spark):
    """A third of all rows are one vector, others lie on a grid with many equal distances."""
    rng = np.random.RandomState(1)
    grid = rng.randint(0, 6, (120, 3)).astype(float)
    blobs = np.concatenate([c + rng.normal(size=(30, 3)) * .05 for c in rng.normal(size=(4, 3)) * 9])
    vecs = [*grid.tolist(), *blobs.tolist(), *[[1.0, 2.0, 3.0]] * 110]
    ids = rng.permutation(len(vecs)).tolist()
    rows = list(zip(ids, vecs))
    want = _plain_knn(rows, 4)
    for params in ({}, {"tile": 16, "pivots": 9}, {"tile": 5, "pivots": 1}, {"pivots": 200}):
        assert _knn_rows(spark, rows, 4, **params) == want


def test_knn_prunes(spark):
    """Compared pairs grow far slower than all pairs."""
    rng = np.random.RandomState(2)
    share = []
    for n in (500, 2000, 8000):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 3)))], "row_id long, vec array<double>")
        share.append(knn.compared_pairs(df, "row_id", "vec", 5) / n ** 2)
    assert share[0] > share[1] > share[2] and share[2] < 0.1


def test_knn_compares_a_vector_with_a_few_leaves_however_large_its_cell(spark):
    rng = np.random.RandomState(4)
    each = []
    for n in (2000, 16000):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 3)))], "row_id long, vec array<double>")
        each.append(knn.compared_pairs(df, "row_id", "vec", 5, pivots=1) / n)
    assert each[1] < 1.3 * each[0] < 0.25 * 2000


def test_knn_reports_equal_distances_in_one_tile(spark):
    """More vectors at the k-th distance than a leaf holds; ids are negative, too."""
    spokes = np.concatenate([s * np.eye(40) for s in (1.0, -1.0)]).tolist()
    rows = list(zip(range(-30, 51), [[0.0] * 40, *spokes]))
    for params in ({}, {"tile": 10, "pivots": 3}):
        assert _knn_rows(spark, rows, 6, **params) == _plain_knn(rows, 6)


def test_knn_refuses_null_vectors(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0])], "row_id long, vec array<double>")
    with pytest.raises(Exception, match="no neighbours"):
        sm.knn_within(df, "row_id", "vec").collect()


def test_folds_and_subsets_from_one_ranking(spark):
    df = spark.createDataFrame([(i, i % 3 % 2) for i in range(200)], "row_id long, reported int").repartition(5)
    both = sm.folds_with_subsets(df, "reported", "row_id", 4, [.3, .6, .9])
    apart = sm.nested_subsets(sm.stratified_folds(df, "reported", "row_id", 4), "reported", "row_id", [.3, .6, .9])
    order = lambda t: sorted((r["row_id"], r["fold"], -1 if r["subset"] is None else r["subset"]) for r in t.collect())
    assert order(both) == order(apart)


def test_knn_measures_few_vectors_against_the_pivots_at_a_time():
    import pyarrow as pa
    whole = pa.RecordBatch.from_arrays([pa.array(range(10_000))], names=["node"])
    parts = list(knn._slices(iter([whole, whole.slice(0, 0)])))
    assert max(p.num_rows for p in parts) <= knn._ROWS and [x for p in parts for x in p.column("node").to_pylist()] == list(range(10_000))
