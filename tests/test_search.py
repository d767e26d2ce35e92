"""Search: trees, logistic candidates fitted together, the resumable trial table, boosting rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakscreen.operators import search as sr
from peakscreen.operators import trees as tr

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3)) * [1, 10, .1] + [0, 5, 0]
    y = (x[:, 0] + (x[:, 1] - 5) / 10 + rng.normal(size=400) > .5).astype(int)
    rows = [(i, *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double, reported int").repartition(3).cache()


def test_one_split_is_the_best_split():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4))
    g, h = rng.normal(size=200), rng.random(200) + .1
    bins = tr.binned(x, tr.bin_edges(x))
    how = tr.Growth(max_depth=1, reg_lambda=.7, min_child_weight=8)
    tree = tr.grow(bins, g, h, np.ones(200), how, rng)
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + .7)
    options = [(score(left) + score(~left), f, c) for f in range(4) for c in range(bins[:, f].max())
               if (left := bins[:, f] <= c).any() and h[left].sum() >= 8 and h[~left].sum() >= 8]
    best = max(options)
    left = bins[:, tree.feature[0]] <= tree.cut[0]
    assert np.isclose(score(left) + score(~left), best[0])
    assert np.allclose(tree.predict(bins)[left], -g[left].sum() / (h[left].sum() + .7))


def test_growth_limits():
    rng = np.random.default_rng(2)
    bins = rng.integers(0, 16, (300, 3))
    y = (bins[:, 0] > 7).astype(float)
    full = tr.grow(bins, -y, np.ones(300), np.ones(300), tr.Growth(max_depth=30), rng)
    assert np.allclose(full.predict(bins), y)
    assert len(tr.grow(bins, -y, np.ones(300), np.ones(300), tr.Growth(min_split=301), rng).value) == 1
    leaves = tr.grow(bins, -rng.random(300), np.ones(300), np.ones(300), tr.Growth(max_depth=30, min_child_weight=40), rng)
    assert np.bincount(leaves.leaf_of(bins))[np.unique(leaves.leaf_of(bins))].min() >= 40


def test_boosting_goes_on_where_it_stopped():
    rng = np.random.default_rng(3)
    bins, y = rng.integers(0, 8, (200, 4)), rng.integers(0, 2, 200).astype(float)
    args = (bins[:150], y[:150], bins[150:])
    whole = list(tr.boosted_margins(*args, 12, .2, tr.Growth(max_depth=3), 5, .7, .5))
    half = list(tr.boosted_margins(*args, 5, .2, tr.Growth(max_depth=3), 5, .7, .5))[-1]
    rest = list(tr.boosted_margins(*args, 7, .2, tr.Growth(max_depth=3), 5, .7, .5, start=half))
    assert [r for r, *_ in rest] == list(range(6, 13))
    assert all(np.array_equal(a, b) for x, z in zip(whole[5:], rest) for a, b in zip(x[1:], z[1:]))


def test_logistic_candidates_are_optimal(table):
    """Every candidate in every fold fulfils its own optimality conditions."""
    folds = 3
    rows = table.select(F.array(*FEATURES).alias("x"), F.col("reported").cast("double").alias("y"), (F.col("row_id") % folds).cast("int").alias("fold"), F.lit(0).alias("level"))
    penalties = [(0, 0), (5, 0), (0, 30), (4, 4), (1000, 0)]
    batch = sr.fit_logistic_batch(rows, 3, folds, penalties)
    got = rows.collect()
    x, y, fold = np.array([r.x for r in got]), np.array([r.y for r in got]), np.array([r.fold for r in got])
    for f in range(folds):
        use = fold != f
        z = (x[use] - x[use].mean(axis=0)) / x[use].std(axis=0)
        w = np.where(y[use] == 1, 1 / (2 * y[use].mean()), 1 / (2 * (1 - y[use].mean())))
        for c, (l1, l2) in enumerate(penalties):
            b = batch.coef[f, c]
            slope = w * (1 / (1 + np.exp(-(z @ b[:-1] + b[-1]))) - y[use])
            g = z.T @ slope + l2 * b[:-1]
            assert abs(slope.sum()) < 1e-3
            assert np.all(np.where(b[:-1] != 0, np.abs(g + l1 * np.sign(b[:-1])) < 1e-3, np.abs(g) <= l1 + 1e-3))
    assert (batch.coef[:, 4, :3] == 0).all()


def test_draws_follow_the_seed():
    one = sr.draw(sr.SPACES["boosting"], 100)
    assert one == sr.draw(sr.SPACES["boosting"], 100) and one[:7] == sr.draw(sr.SPACES["boosting"], 7)
    assert {c["max_features"] for c in sr.draw(sr.SPACES["forest"], 100)} == {"sqrt", "log2", "all"}


def test_search_resumes(spark, table, tmpdir_path):
    small = {"logistic": sr.SPACES["logistic"], "forest": {**sr.SPACES["forest"], "trees": [5]},
             "boosting": {**sr.SPACES["boosting"], "rounds": [5]}}
    run = lambda name, n: sr.search(table, FEATURES, f"file://{tmpdir_path}/{name}", spaces=small, draws=n, folds=3, sample_rows=150, wave=6)
    first = run("a", 2)
    assert first.count() == 6
    before = {(r.family, r.trial): r for r in first.collect()}
    after = {(r.family, r.trial): r for r in run("a", 5).collect()}
    fresh = {(r.family, r.trial): r for r in run("b", 5).collect()}
    assert len(after) == 15 and all(after[k] == before[k] for k in before)
    assert all(after[k].params == fresh[k].params and np.allclose(after[k].fold_f1, fresh[k].fold_f1, atol=.02) for k in fresh)
    assert all(after[k] == fresh[k] for k in fresh if k[0] != "logistic")
    best = sr.best_trials(run("a", 5)).where("best").collect()
    assert {r.family: r.mean_f1 for r in best} == {f: max(r.mean_f1 for k, r in after.items() if k[0] == f) for f in small}
    assert max(r.mean_f1 for r in best) > .6


def test_tree_trials_learn_from_every_row(spark, tmpdir_path):
    """Each trial's scores are those of fits on all rows of the other folds; 2,000 of these rows were used before."""
    from peakscreen.operators import sampling as sm
    rng = np.random.default_rng(8)
    x = np.c_[rng.normal(size=(3000, 2)), rng.integers(0, 4, 3000)]
    y = (x[:, 0] * x[:, 1] + x[:, 2] / 3 + rng.normal(size=3000) / 2 > .5).astype(int)
    rows = spark.createDataFrame([(i, *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y))],
                                 "row_id long, a double, b double, c double, reported int").repartition(3).cache()
    spaces = {"forest": {**sr.SPACES["forest"], "trees": [4], "min_samples_leaf": (.03, .1)},
              "boosting": {**sr.SPACES["boosting"], "rounds": [4], "max_depth": [3], "scale_pos_weight": [1, 2]}}
    found = sr.search(rows, FEATURES, f"file://{tmpdir_path}/whole", families=("forest", "boosting"), spaces=spaces, draws=3, folds=3, wave=6).collect()
    fold = np.array([r.fold for r in sm.stratified_folds(rows, "reported", "row_id", 3, sr.SEED).orderBy("row_id").collect()])
    for r in found:
        c = sr.draw(spaces[r.family], 3)[r.trial]
        for k, f1 in enumerate(r.fold_f1):
            bins, own, held, truth = sr.Sample(x, y.astype(float), fold).cut(k)
            if r.family == "forest":
                n = {"sqrt": 1, "log2": 1, "all": 3}[c["max_features"]]
                says = tr.forest_probabilities(bins, own, held, 4, c["min_samples_split"], c["min_samples_leaf"], n, sr.SEED) >= .5
            else:
                how = tr.Growth(**{a: c[a] for a in ("max_depth", "min_child_weight", "gamma", "reg_lambda", "reg_alpha")})
                says = [*tr.boosted_margins(bins, own, held, 4, c["eta"], how, sr.SEED, c["subsample"], pos_weight=c["scale_pos_weight"])][-1][2] >= 0
            assert len(own) + len(truth) == 3000 and abs(sr.f1_of(says, truth) - f1) < 1e-9


def test_fitting_sample_is_bounded_and_stratified(table):
    s = sr.fitting_sample(table.withColumn("reported", F.when(F.col("row_id") % 10 != 0, F.col("reported"))), FEATURES, "reported", "row_id", 100, 5, 1)
    assert s.x.shape == (100, 3) and set(np.bincount(s.fold)) <= {19, 20, 21}


def _area(score, y):
    order = sorted(set(score), reverse=True)
    total = 0.0
    for t in order:
        hit, all_ = ((score >= t) & (y == 1)).sum(), (score >= t).sum()
        total += ((score == t) & (y == 1)).sum() * hit / all_
    return total / (y == 1).sum()


def test_pr_auc_equals_plain(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), float(s), int(t)) for g, s, t in zip(rng.integers(0, 3, 300), rng.integers(0, 20, 300) / 20, rng.integers(0, 2, 300))]
    df = spark.createDataFrame(rows + [(9, .5, 0)], "g int, s double, y int")
    got = {r.g: r.pr_auc for r in sr.pr_auc(df, ["g"], "s", "y").collect()}
    assert got.pop(9) is None
    for g, area in got.items():
        own = [(s, y) for k, s, y in rows if k == g]
        assert np.isclose(area, _area(*map(np.array, zip(*own))))


def test_rounds_by_patience(table):
    args = {"folds": 3, "patience": 6, "sample_rows": 200, "settings": {**sr.STUDY, "eta": .3, "max_depth": 3}}
    out = sr.rounds_by_patience(table, FEATURES, segment=4, **args).orderBy("round").collect()
    means = [r.mean_pr_auc for r in out]
    chosen = [r.round for r in out if r.chosen]
    assert chosen == [int(np.argmax(means)) + 1] and len(out) == chosen[0] + 6
    again = sr.rounds_by_patience(table, FEATURES, segment=50, **args).orderBy("round").collect()
    assert np.allclose(means, [r.mean_pr_auc for r in again])
    assert len(sr.rounds_by_patience(table, FEATURES, max_rounds=3, **args).collect()) == 3


def test_learning_curve_equals_single_fits(spark, table):
    """Every size and fold agrees with a fit of its own on the rows it may learn from."""
    from peakscreen.operators import sampling as sm
    fractions, folds = [0.3, 0.6, 1.0], 3
    out = {(round(r.fraction, 2), r.fold): r for r in sr.logistic_learning_curve(table, FEATURES, fractions, folds).collect()}
    placed = sm.nested_subsets(sm.stratified_folds(table, "reported", "row_id", folds, 42), "reported", "row_id", fractions, 42).collect()
    for c, x in enumerate(fractions):
        for f in range(folds):
            own = [r for r in placed if r.fold != f and r.subset <= c]
            assert out[x, f].train_size == len(own)
            rows = spark.createDataFrame([([r.a, r.b, r.c], float(r.reported), 1, 0) for r in own], "x array<double>, y double, fold int, level int")
            batch = sr.fit_logistic_batch(rows, 3, 2, [(0, 0)])
            held = [r for r in placed if r.fold == f]
            says = batch.scaled(np.array([[r.a, r.b, r.c] for r in held]), 0) @ batch.coef[0, 0] >= 0
            assert abs(out[x, f].test_f1 - sr.f1_of(says, np.array([r.reported for r in held]))) < .02


def test_boosting_model(spark, table):
    from peakscreen.operators import evaluation as ev
    from peakscreen.operators import modeling as md
    fitted = md.fit_model(table, FEATURES, "boosting", rounds=30)
    scored = md.score(fitted, table.withColumn("x.y", F.lit(1)))
    assert scored.columns == [*table.columns, "x.y", "probas"] and ev.roc_auc(scored, "probas", "reported") > .8
    again = md.score(md.fit_model(table.repartition(7), FEATURES, "boosting", rounds=30), table)
    assert scored.select("row_id", "probas").exceptAll(again.select("row_id", "probas")).isEmpty()
    few = md.fit_model(table, FEATURES, "boosting", rounds=3, fit_rows=40)
    assert len(few.model.rounds) == 3 and abs(sum(w for _, w in md.coefficients(few)) - 1) < 1e-9
    curves = md.profit_by_model([fitted, md.fit_model(table, FEATURES, "logistic")], table)
    assert {r.model for r in curves.select("model").distinct().collect()} == {"boosting", "logistic"}
    report = md.comparison_reports([fitted], table).collect()
    assert [r["class"] for r in report] == ["0", "1", "accuracy", "macro avg", "weighted avg"]


def test_a_newton_step_takes_one_pass(table, monkeypatch):
    passes, steps = [], []
    one, step = sr._fit_pass, sr._newton_step
    monkeypatch.setattr(sr, "_fit_pass", lambda *a, **k: (passes.append(len(a[3])), one(*a, **k))[1])
    monkeypatch.setattr(sr, "_newton_step", lambda *a: (steps.append(1), step(*a))[1])
    folded = table.select(F.array(*FEATURES).alias("x"), F.col("reported").cast("double").alias("y"),
                          (F.col("row_id") % 4).cast("int").alias("fold"), (F.col("row_id") % 3).cast("int").alias("level")).where("level < 2")
    batch = sr.fit_logistic_batch(folded, 3, 4, [(0.0, 0.0), (2.0, 1.0)], nested=True)
    # Before, a step took the losses of six tables and a pass of its own for the curvature.
    assert sum(passes) <= 8 * (1 + 2 * len(steps)) and max(passes) <= 8 * len(sr.STEPS)
    rows = folded.toPandas()
    x, y = np.stack(rows.x), rows.y.to_numpy()
    for f in range(4):
        own = (rows.fold != f).to_numpy()
        z = np.hstack([(x - x[own].mean(axis=0)) / x[own].std(axis=0), np.ones((len(x), 1))])
        for c, (l1, l2) in enumerate([(0.0, 0.0), (2.0, 1.0)]):
            use = own & (rows.level <= c).to_numpy()
            n1 = y[use].sum()
            w = np.where(y[use] == 1, use.sum() / (2 * n1), use.sum() / (2 * (use.sum() - n1)))
            b = batch.coef[f, c]
            slope = (w * (1 / (1 + np.exp(-z[use] @ b)) - y[use])) @ z[use] + np.append(l2 * b[:-1], 0)
            # At the minimum the slope is zero, or within the l1 penalty where a coefficient is zero.
            off = np.where(np.append(b[:-1] == 0, False), np.maximum(np.abs(slope) - l1, 0), np.abs(slope + np.append(l1 * np.sign(b[:-1]), 0)))
            assert off.max() < .02


def test_shorter_steps_when_the_whole_one_raises_the_cost(table, monkeypatch):
    folded = table.select(F.array(*FEATURES).alias("x"), F.col("reported").cast("double").alias("y"),
                          (F.col("row_id") % 2).cast("int").alias("fold"), F.lit(0).alias("level"))
    want = sr.fit_logistic_batch(folded, 3, 2, [(0.0, 1.0)]).coef
    step, shortened = sr._newton_step, []
    real = sr._shorten
    monkeypatch.setattr(sr, "_newton_step", lambda batch, g, h: batch.coef + 6 * (step(batch, g, h) - batch.coef))
    monkeypatch.setattr(sr, "_shorten", lambda *a: (shortened.append(1), real(*a))[1])
    assert np.allclose(sr.fit_logistic_batch(folded, 3, 2, [(0.0, 1.0)]).coef, want, atol=.01)
    assert shortened
