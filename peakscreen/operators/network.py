"""The study's feed-forward network (L5): two hidden layers, dropout after the first, max-norm on the first layer's weights.

Training is data-parallel. Rows are dealt into batches by a hash of their id and written once, a folder per
batch; a step reads its batch, every task sums the gradient of its rows, and the driver adds the sums and moves
the weights (some hundred numbers). Dropout is a hash of row, epoch and unit, so a task that is run again, on whatever
executor, drops the same units. After every epoch weights and optimizer state are appended to a table; a fit that is started
again on that table goes on after its last whole epoch.

Defined cases: null labels are left out, a null feature counts as 0, a constant feature as 0 after scaling; rows with
equal ids share batch and dropout; a table without labelled rows is an error.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakscreen.session import drop_tables, ensure_checkpoint_dir, ship_package

#: Batches of an epoch at most; a table with more rows has larger batches, never fewer rows.
MAX_BATCHES = 32
#: Rows of a batch that one task sums.
TASK_ROWS = 200_000
_STATE = "epoch int, step long, weights array<double>, moments array<double>, loss double"


@dataclass(frozen=True)
class Settings:
    """Defaults are the study's."""
    optimizer: str = "Adagrad"
    init_mode: str = "zero"
    activation1: str = "softsign"
    activation2: str = "softsign"
    dropout_rate: float = 0.5
    weight_constraint: float = 3.0
    neurons1: int = 12
    neurons2: int = 8
    batch_size: int = 300
    epochs: int = 15
    seed: int = 42


# ---------------------------------------------------------------------------
# Activations: value, and gradient by the input from value and gradient by the value
# ---------------------------------------------------------------------------


def _sigmoid(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1.0, e) / (1.0 + e)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


ACTIVATIONS = {
    "linear": (lambda z: z, lambda z, a, g: g),
    "relu": (lambda z: np.maximum(z, 0.0), lambda z, a, g: g * (z > 0)),
    "tanh": (np.tanh, lambda z, a, g: g * (1 - a * a)),
    "sigmoid": (_sigmoid, lambda z, a, g: g * a * (1 - a)),
    "hard_sigmoid": (lambda z: np.clip(0.2 * z + 0.5, 0.0, 1.0), lambda z, a, g: g * 0.2 * (np.abs(z) < 2.5)),
    "softplus": (lambda z: np.logaddexp(0.0, z), lambda z, a, g: g * _sigmoid(z)),
    "softsign": (lambda z: z / (1 + np.abs(z)), lambda z, a, g: g / (1 + np.abs(z)) ** 2),
    "softmax": (_softmax, lambda z, a, g: a * (g - (g * a).sum(axis=1, keepdims=True))),
}


# ---------------------------------------------------------------------------
# Weights
# ---------------------------------------------------------------------------


def _truncated(rng: np.random.Generator, size: tuple[int, int], std: float) -> np.ndarray:
    """Normal draws within two deviations, scaled back to ``std``."""
    out = rng.normal(size=size)
    while (far := np.abs(out) > 2).any():
        out[far] = rng.normal(size=int(far.sum()))
    return out * std / 0.87962566103423978


def initial(mode: str, fan_in: int, fan_out: int, rng: np.random.Generator) -> np.ndarray:
    size = (fan_in, fan_out)
    if mode == "zero":
        return np.zeros(size)
    if mode in ("normal", "uniform"):
        return rng.normal(0, 0.05, size) if mode == "normal" else rng.uniform(-0.05, 0.05, size)
    scheme, shape = mode.split("_")
    variance = {"lecun": 1.0 / fan_in, "he": 2.0 / fan_in, "glorot": 2.0 / (fan_in + fan_out)}[scheme]
    if shape == "normal":
        return _truncated(rng, size, math.sqrt(variance))
    limit = math.sqrt(3 * variance)
    return rng.uniform(-limit, limit, size)


@dataclass(frozen=True)
class Shape:
    p: int
    h1: int
    h2: int

    @property
    def size(self) -> int:
        return (self.p + 1) * self.h1 + (self.h1 + 1) * self.h2 + self.h2 + 1

    def parts(self, w: np.ndarray) -> list[np.ndarray]:
        """Views of kernels and biases, layer by layer."""
        out, at = [], 0
        for dims in ((self.p, self.h1), (self.h1,), (self.h1, self.h2), (self.h2,), (self.h2, 1), (1,)):
            n = math.prod(dims)
            out.append(w[at:at + n].reshape(dims))
            at += n
        return out

    def start(self, how: Settings) -> np.ndarray:
        """First layer by ``init_mode``, the others Glorot uniform, biases zero."""
        rng = np.random.default_rng(how.seed)
        w = np.zeros(self.size)
        k1, _, k2, _, k3, _ = self.parts(w)
        k1[:] = initial(how.init_mode, self.p, self.h1, rng)
        k2[:] = initial("glorot_uniform", self.h1, self.h2, rng)
        k3[:] = initial("glorot_uniform", self.h2, 1, rng)
        return w


def constrain(shape: Shape, w: np.ndarray, most: float) -> None:
    """Scale the incoming weights of each first-layer unit down to a norm of at most ``most``, in place."""
    k1 = shape.parts(w)[0]
    norms = np.sqrt((k1 * k1).sum(axis=0))
    k1 *= np.clip(norms, 0, most) / (norms + 1e-7)


def kept_units(keys: np.ndarray, epoch: int, units: int, rate: float, seed: int) -> np.ndarray:
    """Dropout factors: 0, or 1 / (1 - rate), from a hash of row key, epoch and unit."""
    if rate <= 0:
        return np.ones((len(keys), units))
    with np.errstate(over="ignore"):
        z = keys.view(np.uint64)[:, None] + np.arange(1, units + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) \
            + np.uint64(seed * 1_000_003 + epoch + 1) * np.uint64(0xD1B54A32D192ED03)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    draw = (z ^ z >> np.uint64(31)) >> np.uint64(11)
    return (draw * 2.0 ** -53 >= rate) / (1 - rate)


def probabilities(shape: Shape, how: Settings, w: np.ndarray, x: np.ndarray) -> np.ndarray:
    k1, b1, k2, b2, k3, b3 = shape.parts(w)
    a1 = ACTIVATIONS[how.activation1][0](x @ k1 + b1)
    return _sigmoid(ACTIVATIONS[how.activation2][0](a1 @ k2 + b2) @ k3 + b3)[:, 0]


def gradient(shape: Shape, how: Settings, w: np.ndarray, x: np.ndarray, y: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, float]:
    """Gradient and value of the cross-entropy, summed over the rows."""
    k1, b1, k2, b2, k3, b3 = shape.parts(w)
    (f1, d1), (f2, d2) = ACTIVATIONS[how.activation1], ACTIVATIONS[how.activation2]
    z1 = x @ k1 + b1
    a1 = f1(z1)
    dropped = a1 * factors
    z2 = dropped @ k2 + b2
    a2 = f2(z2)
    margin = (a2 @ k3 + b3)[:, 0]
    loss = float((np.logaddexp(0.0, margin) - y * margin).sum())
    out = np.zeros(shape.size)
    g1, c1, g2, c2, g3, c3 = shape.parts(out)
    back = (_sigmoid(margin) - y)[:, None]
    g3[:], c3[:] = a2.T @ back, back.sum(axis=0)
    back = d2(z2, a2, back @ k3.T)
    g2[:], c2[:] = dropped.T @ back, back.sum(axis=0)
    back = d1(z1, a1, (back @ k2.T) * factors)
    g1[:], c1[:] = x.T @ back, back.sum(axis=0)
    return out, loss


# ---------------------------------------------------------------------------
# Optimizers: (weights, gradient, two moments, step from 1), in place. Rates are the usual defaults.
# ---------------------------------------------------------------------------

EPS = 1e-7
#: Step sizes.
RATES = {"SGD": 0.01, "RMSprop": 0.001, "Adagrad": 0.001, "Adadelta": 0.001, "Adam": 0.001, "Adamax": 0.001, "Nadam": 0.001}
_B1, _B2 = 0.9, 0.999


def first_moments(optimizer: str, size: int) -> np.ndarray:
    """Two moments per weight, and the running product of Nadam's momenta."""
    m = np.zeros(2 * size + 1)
    m[-1] = 1.0
    if optimizer == "Adagrad":
        m[:size] = 0.1
    return m


def move(optimizer: str, w: np.ndarray, g: np.ndarray, moments: np.ndarray, step: int) -> None:
    n, lr = len(w), RATES[optimizer]
    m, v = moments[:n], moments[n:2 * n]
    if optimizer == "SGD":
        w -= lr * g
    elif optimizer == "RMSprop":
        m += (1 - 0.9) * (g * g - m)
        w -= lr * g / (np.sqrt(m) + EPS)
    elif optimizer == "Adagrad":
        m += g * g
        w -= lr * g / (np.sqrt(m) + EPS)
    elif optimizer == "Adadelta":
        m += (1 - 0.95) * (g * g - m)
        change = np.sqrt(v + EPS) / np.sqrt(m + EPS) * g
        v += (1 - 0.95) * (change * change - v)
        w -= lr * change
    elif optimizer == "Adamax":
        m += (1 - _B1) * (g - m)
        np.maximum(_B2 * v, np.abs(g), out=v)
        w -= lr / (1 - _B1 ** step) * m / (v + EPS)
    elif optimizer == "Adam":
        m += (1 - _B1) * (g - m)
        v += (1 - _B2) * (g * g - v)
        w -= lr * math.sqrt(1 - _B2 ** step) / (1 - _B1 ** step) * m / (np.sqrt(v) + EPS)
    elif optimizer == "Nadam":
        now, ahead = (_B1 * (1 - 0.5 * 0.96 ** (0.004 * t)) for t in (step, step + 1))
        moments[-1] *= now
        m += (1 - _B1) * (g - m)
        v += (1 - _B2) * (g * g - v)
        mean = (1 - now) * g / (1 - moments[-1]) + ahead * m / (1 - moments[-1] * ahead)
        w -= lr * mean / (np.sqrt(v / (1 - _B2 ** step)) + EPS)
    else:
        raise ValueError(f"unknown optimizer {optimizer!r}")


def batch_order(how: Settings, epoch: int, n: int) -> list[int]:
    return np.random.default_rng([how.seed, epoch]).permutation(n).tolist()


def n_batches(rows: int, how: Settings, most: int = MAX_BATCHES) -> int:
    return max(1, min(most, -(-rows // how.batch_size)))


def fit_local(x: np.ndarray, y: np.ndarray, keys: np.ndarray, batch: np.ndarray, how: Settings) -> np.ndarray:
    """Weights from rows that one task holds (a trial of the search), by the same steps as :func:`fit_network`."""
    shape = Shape(x.shape[1], how.neurons1, how.neurons2)
    w, moments, step = shape.start(how), first_moments(how.optimizer, shape.size), 0
    groups = [np.flatnonzero(batch == b) for b in range(int(batch.max()) + 1)]
    for epoch in range(how.epochs):
        for b in batch_order(how, epoch, len(groups)):
            own = groups[b]
            if len(own):
                step += 1
                g, _ = gradient(shape, how, w, x[own], y[own], kept_units(keys[own], epoch, shape.h1, how.dropout_rate, how.seed))
                move(how.optimizer, w, g / len(own), moments, step)
                constrain(shape, w, how.weight_constraint)
    return w


# ---------------------------------------------------------------------------
# Data-parallel fit
# ---------------------------------------------------------------------------


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


@dataclass
class Network:
    """A fitted network with the scaling of its inputs."""
    features: list[str]
    mean: np.ndarray
    scale: np.ndarray
    settings: Settings
    weights: np.ndarray
    losses: list[float]

    def score(self, df: DataFrame, out: str = "probas") -> DataFrame:
        """Append the probability of class 1; a null feature counts as 0."""
        ship_package(df.sparkSession)
        mean, scale, how, w = self.mean, self.scale, self.settings, self.weights
        shape = Shape(len(self.features), how.neurons1, how.neurons2)
        boxed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), _inputs(self.features).alias("x"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    p = probabilities(shape, how, w, (_matrix(b) - mean) / scale)
                    yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(p)], names=["row", "p"])

        schema = T.StructType([boxed.schema["row"], T.StructField("p", T.DoubleType())])
        return boxed.mapInArrow(run, schema).select("row.*", F.col("p").alias(out))


def _inputs(features: Sequence[str]):
    return F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in features])


def _saved(spark: SparkSession, path: str | None) -> list:
    """The last whole epoch, if any."""
    if path is None:
        return []
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return []
    return spark.read.schema(_STATE).parquet(path).orderBy("epoch").collect()


def _step_sums(rows: DataFrame, shape: Shape, how: Settings, w: np.ndarray, epoch: int) -> tuple[np.ndarray, int, float]:
    """Summed gradient, rows and loss of a batch; partial sums are added in the order of their partitions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, loss = np.zeros(shape.size), 0, 0.0
        for b in batches:
            if b.num_rows:
                keys = b.column("key").to_numpy()
                g, one = gradient(shape, how, w, _matrix(b), b.column("y").to_numpy(),
                                  kept_units(keys, epoch, shape.h1, how.dropout_rate, how.seed))
                total, n, loss = total + g, n + b.num_rows, loss + one
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()]), pa.array([n]), pa.array([loss])], names=["g", "n", "loss"])

    got = rows.mapInArrow(run, "g array<double>, n long, loss double").collect()
    return (np.sum([r["g"] for r in got], axis=0) if got else np.zeros(shape.size), sum(r["n"] for r in got),
            math.fsum(r["loss"] for r in got))


def _by_batch(rows: DataFrame, count: int, splits: int) -> tuple[DataFrame, str]:
    """Rows written with a folder per batch, a batch in at most ``splits`` files, and their path."""
    path = f"{ensure_checkpoint_dir(rows.sparkSession)}/network-{uuid.uuid4().hex}"
    part = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(splits))
    rows.repartition(min(count * splits, 4096), "batch", part).write.partitionBy("batch").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path), path


def fit_network(train: DataFrame, features: Sequence[str], label: str = "reported", id_col: str = "row_id", path: str | None = None,
                most_batches: int = MAX_BATCHES, **settings) -> Network:
    """Fit on all labelled rows. ``path`` names the table of epochs by which a fit can go on."""
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    how, feats = Settings(**settings), list(features)
    shape = Shape(len(feats), how.neurons1, how.neurons2)
    key = F.xxhash64(F.col(f"`{id_col}`"), F.lit(how.seed))
    labelled = train.where(F.col(f"`{label}`").isNotNull())
    x = _inputs(feats)
    about = labelled.select(x.alias("x")).agg(F.count(F.lit(1)).alias("n"), *[f(F.col("x")[i]).alias(f"{k}{i}")
                            for i in range(len(feats)) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not about["n"]:
        raise ValueError("no labelled rows to fit on")
    mean = np.array([about[f"m{i}"] for i in range(len(feats))])
    spread = np.array([about[f"s{i}"] for i in range(len(feats))])
    scale = np.where(spread > 0, spread, 1.0)
    count = n_batches(about["n"], how, most_batches)
    splits = -(-about["n"] // (count * TASK_ROWS))
    scaled = F.transform(F.arrays_zip(x.alias("v"), F.array(*map(F.lit, mean.tolist())).alias("m"), F.array(*map(F.lit, scale.tolist())).alias("s")),
                         lambda t: (t["v"] - t["m"]) / t["s"])
    rows = labelled.select(key.alias("key"), F.pmod(key, F.lit(count)).cast("int").alias("batch"),
                           F.col(f"`{label}`").cast("double").alias("y"), scaled.alias("x"))
    dealt, spot = _by_batch(rows, count, splits)

    saved = _saved(spark, path)
    w, moments, step, first = shape.start(how), first_moments(how.optimizer, shape.size), 0, 0
    losses = [r["loss"] for r in saved]
    if saved:
        last = saved[-1]
        w, moments, step, first = np.array(last["weights"]), np.array(last["moments"]), last["step"], last["epoch"] + 1
    try:
        for epoch in range(first, how.epochs):
            loss = 0.0
            for b in batch_order(how, epoch, count):
                g, n, one = _step_sums(dealt.where(F.col("batch") == b), shape, how, w, epoch)
                loss += one
                if n:
                    step += 1
                    move(how.optimizer, w, g / n, moments, step)
                    constrain(shape, w, how.weight_constraint)
            losses.append(loss / about["n"])
            if path is not None:
                spark.createDataFrame([(epoch, step, w.tolist(), moments.tolist(), losses[-1])], _STATE) \
                    .coalesce(1).write.mode("append").parquet(path)
    finally:
        drop_tables(spark, spot)
    return Network(feats, mean, scale, how, w, losses)
