"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Model: P(grade >= k) = sigmoid(w . x - t_k) with one weight vector for all
thresholds t_1 < t_2 < ...; the output is the expected severity, the sum of
these probabilities. ``x`` holds hashed 0/1 features: the words of the text (runs of
letters, lower case), and the word prefixes of 4 to 7 letters, which stand
for inflected and compound forms, each with the levels of frequency it
reaches (once, twice, four times, 4 and 10 in a thousand words).

Fit: an L1 penalty on the weights, by proximal gradient, on a bounded sample of
labelled rows (``MAX_TRAIN_ROWS``: the rows with the smallest hash of their id);
then the features found are refitted with a small ridge, which undoes the
shrinkage. Features whose score at the null model is far below the penalty
cannot enter first and are screened out, so the fit is small. Scoring covers
every row and whole texts, in Arrow batches.

``severity_grades`` derives the ordered grades from 0/1 labels: 0 is clean, a
toxic row is 2 if it holds at least the toxic rows' median number of markers (features
whose toxic rate in the sample is five times the base rate), else 1.

Defined cases: null, empty and letterless texts have no feature and get the
intercept's severity; a sample with one grade only gives a constant model (severity 0
for all-clean or unlabelled data); rows with equal texts get equal scores; an empty table
gives an empty table; columns of the input are kept as they are.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakscreen.llm.common import map_arrow

WORD = re.compile(r"[^\W\d_]+")
#: Feature numbers fill 31 bits, so that unrelated words hardly ever share one.
UNIT_BITS, LEVELS = 28, 8
PREFIXES = (4, 5, 6, 7)
#: Bound on the labelled rows of a fit.
MAX_TRAIN_ROWS = 6_000
#: Penalty as a share of the smallest one that leaves no feature in the model.
L1_SHARE = 0.15
#: Ridge of the refit, as the weight of prior rows.
RIDGE = 0.02
#: A document with at least this expected severity is rejected.
REJECT_AT = 0.5
_CACHE = 1 << 20


def _number(unit: str) -> int:
    return zlib.crc32(unit.encode("utf-8", "surrogatepass")) & ((1 << UNIT_BITS) - 1)


def units(word: str) -> tuple[int, ...]:
    """Numbers of a word's units: the word itself, then its proper prefixes."""
    return (_number(word), *(_number("^" + word[:k]) for k in PREFIXES if len(word) > k))


def _levels(count: int, n_words: int) -> list[int]:
    """Levels that a prefix reaches by occurring ``count`` times in ``n_words`` words."""
    out = [0]
    if count >= 2:
        out.append(1)
        if count >= 4:
            out.append(2)
        if 250 * count >= n_words:
            out.append(3)
        if 100 * count >= n_words:
            out.append(4)
    return out


def features(text: str | None, only: frozenset[int] | set[int] | None = None,
             cache: dict[str, tuple] | None = None) -> set[int]:
    """Distinct feature numbers of a text: ``LEVELS * unit + level``.

    ``only`` restricts them to the units that a model uses; ``cache`` then keeps
    each word's remaining units.
    """
    words = WORD.findall((text or "").lower())
    found: set[int] = set()
    counts: dict[int, int] = {}
    for word, c in Counter(words).items():
        own = cache.get(word) if cache is not None else None
        if own is None:
            own = units(word)
            if only is not None:
                own = (own[0] if own[0] in only else None, *(u for u in own[1:] if u in only))
                own = own if own != (None,) else ()
            if cache is not None:
                if len(cache) >= _CACHE:
                    cache.clear()
                cache[word] = own
        if own:
            if own[0] is not None:
                found.add(LEVELS * own[0] + LEVELS - 1)
            for u in own[1:]:
                counts[u] = counts.get(u, 0) + c
    for u, c in counts.items():
        found.update(LEVELS * u + level for level in _levels(c, len(words)))
    return found


def packed(text: str | None) -> bytes:
    found = features(text)
    return np.sort(np.fromiter(found, dtype=np.int32, count=len(found))).tobytes()


def sigmoid(z):
    return 0.5 * (1.0 + np.tanh(0.5 * z))


@dataclass
class OrdinalModel:
    """Sparse weights by feature number, and the ordered thresholds."""

    thresholds: np.ndarray
    weights: dict[int, float] = field(default_factory=dict)

    def severity(self, eta) -> np.ndarray:
        eta = np.asarray(eta, dtype=float)
        return sum((sigmoid(eta - t) for t in self.thresholds), np.zeros_like(eta))


def _gradients(eta: np.ndarray, y: np.ndarray, t: np.ndarray):
    """Mean negative log-likelihood's derivatives by ``eta`` (per row, / n) and by each threshold."""
    edges = np.concatenate([[-np.inf], t, [np.inf]])
    with np.errstate(over="ignore"):
        above_low = np.where(y > 0, sigmoid(eta - edges[y]), 1.0)                  # P(grade >= y)
        above_high = np.where(y < len(t), sigmoid(eta - edges[y + 1]), 0.0)        # P(grade >= y + 1)
    p = np.maximum(above_low - above_high, 1e-12)
    d_low = np.where(y > 0, above_low * (1 - above_low), 0.0) / p
    d_high = np.where(y < len(t), above_high * (1 - above_high), 0.0) / p
    n = len(y)
    by_t = np.array([d_low[y == k + 1].sum() - d_high[y == k].sum() for k in range(len(t))]) / n
    return -(d_low - d_high) / n, by_t, -np.log(p).mean()


def _start(y: np.ndarray, n_grades: int) -> np.ndarray:
    share = np.array([(y >= k).mean() for k in range(1, n_grades)])
    share = np.clip(share, 1e-6, 1 - 1e-6)
    return np.log((1 - share) / share)


def _proximal(x: np.ndarray, y: np.ndarray, t: np.ndarray, l1: float, l2: np.ndarray | float,
              w: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """FISTA with backtracking; ``t`` is kept increasing."""
    both = np.concatenate([w, t])
    k = len(w)

    def smooth(v):
        g_eta, g_t, loss = _gradients(x @ v[:k], y, v[k:])
        return loss + 0.5 * (l2 * v[:k]) @ v[:k], np.concatenate([x.T @ g_eta + l2 * v[:k], g_t])

    def prox(v, step):
        out = v.copy()
        out[:k] = np.sign(v[:k]) * np.maximum(np.abs(v[:k]) - step * l1, 0)
        out[k:] = np.maximum.accumulate(v[k:] + 1e-6 * np.arange(len(v) - k))
        return out

    step, momentum, ahead = 1.0, 1.0, both
    for _ in range(steps):
        loss, grad = smooth(ahead)
        while True:
            new = prox(ahead - step * grad, step)
            move = new - ahead
            if smooth(new)[0] <= loss + grad @ move + move @ move / (2 * step) + 1e-12 or step < 1e-8:
                break
            step *= 0.5
        later = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        if (ahead - new) @ (new - both) > 0:      # restart when the momentum points uphill
            later, ahead = 1.0, new
        else:
            ahead = new + (momentum - 1) / later * (new - both)
        moved = np.abs(new - both).max()
        both, momentum = new, later
        step *= 1.2
        if moved < 1e-6:
            break
    return both[:k], both[k:]


def _columns(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct feature numbers, column of every entry, row of every entry)."""
    names, flat = np.unique(np.concatenate(rows), return_inverse=True)
    sizes = np.array([len(r) for r in rows])
    return names, flat.astype(np.int32), np.repeat(np.arange(len(rows), dtype=np.int32), sizes)


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_grades: int) -> OrdinalModel:
    """Fit the model to rows given as distinct feature numbers and grades 0 ... n_grades - 1."""
    y = np.asarray(grades, dtype=np.int64)
    if len(y) == 0 or y.min() == y.max():
        g = int(y[0]) if len(y) else 0
        return OrdinalModel(np.where(np.arange(1, n_grades) <= g, -20.0, 20.0))
    t = _start(y, n_grades)
    g_eta, _, _ = _gradients(np.zeros(len(y)), y, t)
    names, flat, row = _columns(rows)
    if not len(names):
        return OrdinalModel(t)
    score = np.abs(np.bincount(flat, weights=g_eta[row], minlength=len(names)))
    l1 = L1_SHARE * score.max()
    kept = np.flatnonzero(score > 0.5 * l1)
    column = np.full(len(names), -1, dtype=np.int32)
    column[kept] = np.arange(len(kept))
    inside = column[flat] >= 0
    x = np.zeros((len(y), len(kept)))
    x[row[inside], column[flat[inside]]] = 1.0
    del flat, row, inside
    w, t1 = _proximal(x, y, t, l1, 0.0, np.zeros(len(kept)), 300)
    chosen = np.flatnonzero(w)
    # Columns scaled to one second moment: rare words converge as fast as frequent ones.
    x = x[:, chosen]
    scale = np.sqrt((x * x).mean(axis=0))
    w, t1 = _proximal(x / scale, y, t1, 0.0, RIDGE / len(y) / scale ** 2, w[chosen] * scale, 1000)
    return OrdinalModel(t1, {int(names[kept[c]]): float(v) for c, v in zip(chosen, w / scale)})


def severity_grades(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Grades 0, 1, 2 from 0/1 labels; see the module's docstring."""
    toxic = np.asarray(toxic, dtype=np.int64)
    if not toxic.any():
        return toxic
    names, flat, row = _columns(rows)
    seen = np.bincount(flat, minlength=len(names))
    bad = np.bincount(flat, weights=toxic[row], minlength=len(names))
    marker = bad > np.maximum(5 * toxic.mean() * seen, 0.02 * toxic.sum())
    held = np.bincount(row, weights=marker[flat], minlength=len(toxic))
    return np.where(toxic == 1, 1 + (held >= max(1.0, np.median(held[toxic == 1]))), 0)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id",
                  limit: int = MAX_TRAIN_ROWS) -> list[tuple[bytes, int]]:
    """(packed features, label) of at most ``limit`` labelled rows."""
    labelled = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
    # At most ``limit`` rows of two numbers: the bound that makes the broadcast safe.
    sample = F.broadcast(labelled.orderBy(F.xxhash64("_key"), "_key", "_label").limit(limit))
    labelled = docs.join(sample, docs[key] == sample["_key"]).select("text", "_label")

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [packed(x.as_py()) for x in b.column("text")]
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), b.column("_label")],
                                          names=["packed", "label"])

    # Rows that repeat an id could exceed the bound: it holds for what is collected, too.
    found = map_arrow(labelled, batch, "packed binary, label int").orderBy(
        F.xxhash64("packed"), "packed", "label").limit(limit)
    return [(bytes(r["packed"]), int(r["label"])) for r in found.collect()]


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN_ROWS) -> OrdinalModel:
    """The severity model learned from ``labels(doc_id, toxic)``."""
    rows = training_rows(docs, labels, "toxic", limit=limit)
    marks = [np.frombuffer(p, dtype=np.int32) for p, _ in rows]
    return fit_ordinal(marks, severity_grades(marks, np.array([y for _, y in rows], dtype=np.int64)), 3)


def score(docs: DataFrame, model: OrdinalModel, out: str = "severity") -> DataFrame:
    """Append the expected severity (0 to the number of thresholds)."""
    weights = model.weights
    only = frozenset(f // LEVELS for f in weights)
    known: dict[str, tuple] = {}

    def eta(text: str | None) -> float:
        return sum(weights.get(f, 0.0) for f in sorted(features(text, only, known)))

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        i = b.schema.get_field_index("text")
        severity = model.severity([eta(t.as_py()) for t in b.column(i)])
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(severity, pa.float64())],
                                          names=[*b.schema.names, out])

    schema = docs.withColumn(out, F.lit(0.0)).schema
    return map_arrow(docs, batch, schema)


def toxicity_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, severity, toxic``: the expected severity and whether the document is rejected."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", "severity", (F.col("severity") >= REJECT_AT).alias("toxic"))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents below the rejection severity, same columns."""
    # Numbered names meet neither ours nor a dot, which the Arrow functions take for a field.
    numbered = docs.toDF(*["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)])
    scored = score(numbered, fit(docs, labels), "severity")
    return scored.where(F.col("severity") < REJECT_AT).drop("severity").toDF(*docs.columns)
