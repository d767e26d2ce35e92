"""The network: gradients, optimizers, the distributed fit against a plain one, recovery, odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakscreen.operators import modeling as md
from peakscreen.operators import network as nn
from peakscreen.operators import search as sr

FEATURES = ["a", "b c", "k"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 2)) * [1, 20] + [0, 7]
    y = (x[:, 0] * (x[:, 1] - 7) / 20 > 0).astype(int)          # not linear
    data = [(i, float(a), float(b), 3.0, int(t)) for i, ((a, b), t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "row_id long, a double, `b c` double, k double, reported int").repartition(5).cache()


@pytest.mark.parametrize("one", sorted(nn.ACTIVATIONS))
def test_gradient_of_every_activation(one):
    rng = np.random.default_rng(1)
    how = nn.Settings(activation1=one, activation2=one, init_mode="he_normal")
    shape = nn.Shape(4, 3, 2)
    w, x, y = rng.normal(size=shape.size) * .6, rng.normal(size=(30, 4)), rng.integers(0, 2, 30).astype(float)
    factors = nn.kept_units(np.arange(30), 0, 3, .4, 1)
    g, _ = nn.gradient(shape, how, w, x, y, factors)
    for i in range(shape.size):
        step = np.zeros(shape.size)
        step[i] = 1e-6
        slope = (nn.gradient(shape, how, w + step, x, y, factors)[1] - nn.gradient(shape, how, w - step, x, y, factors)[1]) / 2e-6
        assert abs(slope - g[i]) < 1e-4


@pytest.mark.parametrize("one", sorted(nn.RATES))
def test_every_optimizer_lowers_a_bowl(one):
    w = np.array([2.0, -1.0])
    m = nn.first_moments(one, 2)
    for t in range(1, 2001):
        nn.move(one, w, 2 * w * [1, 3], m, t)
    assert w[0] ** 2 + 3 * w[1] ** 2 < 4 + 3


def test_first_steps_have_the_known_size():
    """A first step of the adaptive rules is about the step size, whatever the gradient's size."""
    for one in ("Adam", "Adamax"):
        w = np.zeros(2)
        nn.move(one, w, np.array([5.0, -0.3]), nn.first_moments(one, 2), 1)
        assert np.allclose(w, [-.001, .001], rtol=1e-3)
    w = np.zeros(1)
    nn.move("Adagrad", w, np.array([2.0]), nn.first_moments("Adagrad", 1), 1)
    assert np.isclose(w[0], -.001 * 2 / np.sqrt(4.1), rtol=1e-6)


def test_dropout_share_and_norms():
    f = nn.kept_units(np.arange(20_000), 3, 12, .4, 42)
    assert set(np.unique(f)) == {0.0, 1 / .6} and abs((f == 0).mean() - .4) < .01 and abs(f.mean() - 1) < .02
    assert abs(np.corrcoef(f[:, 0], f[:, 1])[0, 1]) < .03 and (f != nn.kept_units(np.arange(20_000), 4, 12, .4, 42)).any()
    shape = nn.Shape(5, 4, 2)
    w = np.ones(shape.size) * 2
    nn.constrain(shape, w, 3)
    assert np.allclose(np.sqrt((shape.parts(w)[0] ** 2).sum(axis=0)), 3) and (shape.parts(w)[2] == 2).all()
    for mode in sr.SPACES["network"]["init_mode"]:
        assert nn.initial(mode, 28, 12, np.random.default_rng(0)).shape == (28, 12)


HOW = dict(optimizer="Nadam", init_mode="he_uniform", activation1="tanh", activation2="relu", batch_size=60, epochs=3, dropout_rate=.4)


def test_same_weights_as_one_plain_loop(spark, rows):
    fit = nn.fit_network(rows, FEATURES, **HOW)
    got = rows.select(F.xxhash64("row_id", F.lit(42)).alias("key"), "reported", *[f"`{c}`" for c in FEATURES]).toPandas()
    x = got[FEATURES].to_numpy()
    spread = x.std(axis=0)
    x = (x - x.mean(axis=0)) / np.where(spread > 0, spread, 1)
    keys = got["key"].to_numpy()
    w = nn.fit_local(x, got["reported"].to_numpy().astype(float), keys, keys % 9, nn.Settings(**HOW))
    assert np.allclose(fit.weights, w, atol=1e-9) and len(fit.losses) == 3
    p = nn.probabilities(nn.Shape(3, 12, 8), fit.settings, w, x)
    scored = md.score(md.FittedModel("n", fit, FEATURES), rows).select(F.sum("probas")).first()[0]
    assert np.isclose(scored, p.sum())


def test_goes_on_after_a_stop(spark, rows, tmpdir_path):
    path = f"{tmpdir_path}/epochs"
    whole = nn.fit_network(rows, FEATURES, **HOW)
    nn.fit_network(rows, FEATURES, path=path, **{**HOW, "epochs": 1})
    rest = nn.fit_network(rows.repartition(2), FEATURES, path=path, **HOW)
    assert np.allclose(whole.weights, rest.weights, atol=1e-9) and np.allclose(whole.losses, rest.losses)
    again = nn.fit_network(rows, FEATURES, path=path, **HOW)
    assert np.array_equal(again.weights, rest.weights)


def test_learns_what_is_not_linear(rows):
    fm = md.fit_model(rows, FEATURES, "network", optimizer="Adam", init_mode="he_normal", activation1="relu", activation2="relu",
                      dropout_rate=0.0, batch_size=20, epochs=40, neurons1=24)
    hit = md.score(fm, rows).select(F.avg(((F.col("probas") >= .5).cast("int") == F.col("reported")).cast("int"))).first()[0]
    assert hit > .85 and fm.model.losses[-1] < fm.model.losses[0]
    with pytest.raises(TypeError):
        md.coefficients(fm)


def test_odd_tables(spark, rows):
    odd = rows.unionByName(spark.createDataFrame([(None, None, 1.0, 3.0, 1), (7, 1.0, None, 3.0, None)], rows.schema)).withColumn("probas_", F.lit("x"))
    fit = nn.fit_network(odd, FEATURES, epochs=1)
    out = fit.score(odd)
    assert out.count() == 502 and out.where("probas IS NULL OR isnan(probas)").count() == 0 and "probas_" in out.columns
    assert fit.score(odd.where("false")).collect() == []
    with pytest.raises(ValueError):
        nn.fit_network(odd.where("reported IS NULL"), FEATURES, epochs=1)


def test_search_space(rows, spark, tmpdir_path):
    out = sr.search(rows, ["a", "b c"], f"{tmpdir_path}/t", families=("network",), draws=12, folds=2, sample_rows=300)
    got = sr.best_trials(out).collect()
    assert len(got) == 12 and sum(r["best"] for r in got) == 1 and all(0 <= r["mean_f1"] <= 1 for r in got)
