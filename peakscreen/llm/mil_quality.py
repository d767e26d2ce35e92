"""Quality classifier: gated-attention multiple-instance learning over passages.

A text is a bag of passages of ``PASSAGE`` words. Each passage becomes a dense vector
(measures of its characters and words, and hashed words and word shapes), an encoder
layer maps it to ``HIDDEN`` values, and gated attention ``w . (tanh(V h) * sigmoid(U h))``
gives each passage a weight by a softmax over the text's passages. The weighted mean
of the encoded passages is scored by a logistic layer. All layers are learned
together from document labels, by Adam on a bounded sample of labelled rows
(``MAX_TRAIN_ROWS``: those with the smallest hash of their id).

Scoring covers every passage of every text, one Arrow batch at a time.

Defined cases: a null, empty or wordless text is one empty passage and gets a score
like any other; repeated rows get equal scores; without usable labels (none, or one class
only) the score is the labels' smoothed mean; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakscreen.llm.common import map_arrow

PASSAGE = 64
HASHED = 48
MEASURES = 10
WIDTH = HASHED + MEASURES
HIDDEN, GATE = 16, 12
#: Bound on the labelled rows of a fit.
MAX_TRAIN_ROWS = 6_000
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.01, 1e-4
PREDICT_AT = 0.3
_CACHE = 400_000
_TEXTS = 500


def shape(word: str) -> str:
    """Classes of a word's characters, runs shortened: ``Thing,`` is ``Xx.``."""
    out = []
    for ch in word:
        c = "x" if ch.islower() else "X" if ch.isupper() else "0" if ch.isdigit() else "a" if ch.isalpha() else ch
        if not out or out[-1] != c:
            out.append(c)
    return "".join(out)


class Featurizer:
    """Turns texts into passage vectors; keeps what it knows of a word."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.table = np.zeros((1 << 14, 9), dtype=np.float32)

    def _word(self, w: str) -> int:
        i = len(self.known)
        if i == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        lower = sum(c.islower() for c in w)
        upper = sum(c.isupper() for c in w)
        digit = sum(c.isdigit() for c in w)
        alpha = sum(c.isalpha() for c in w)
        hw = zlib.crc32(w.lower().encode("utf-8", "surrogatepass"))
        hs = zlib.crc32(("shape " + shape(w)).encode("utf-8", "surrogatepass"))
        self.table[i] = (len(w), lower, upper, digit, alpha, hw % HASHED, 1 - 2 * (hw >> 16 & 1),
                         hs % HASHED, 1 - 2 * (hs >> 16 & 1))
        self.known[w] = i
        return i

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(passage vectors, first passage of each text)."""
        if len(self.known) >= _CACHE:
            self.known.clear()
        known, word = self.known, self._word
        ids, sizes = [], []
        for t in texts:
            ws = (t or "").split()
            ids += [known[w] if w in known else word(w) for w in ws]
            sizes.append(len(ws))
        n_words = np.array(sizes, dtype=np.int64)
        n_passages = np.maximum(1, -(-n_words // PASSAGE))
        firsts = np.cumsum(n_passages) - n_passages
        total = int(n_passages.sum())
        word_at = np.arange(int(n_words.sum())) - np.repeat(np.cumsum(n_words) - n_words, n_words)
        passage = np.repeat(firsts, n_words) + word_at // PASSAGE
        ids = np.array(ids, dtype=np.int64)
        info = self.table[ids]
        x = np.zeros((total, WIDTH), dtype=np.float32)

        def per(values):
            return np.bincount(passage, weights=values, minlength=total)

        n = per(np.ones(len(ids)))
        chars, lower, upper, digit, alpha = (per(info[:, k]) for k in range(5))
        some, letters = np.maximum(n, 1), np.maximum(chars, 1)
        pairs = np.sort(passage * np.int64(1 << 32) + ids)
        distinct = np.bincount(pairs[np.diff(pairs, prepend=-1) != 0] >> 32, minlength=total)
        repeated = np.zeros(total)
        if len(ids) > 1:
            same = (ids[1:] == ids[:-1]) & (passage[1:] == passage[:-1])
            repeated = np.bincount(passage[1:][same], minlength=total)
        measures = [n / PASSAGE, chars / some / 10, alpha / letters, lower / letters, upper / letters, digit / letters,
                    (chars - alpha - digit) / letters, distinct / some, repeated / some, n == 0]
        for k, m in enumerate(measures):
            x[:, k] = m
        for k in (5, 7):
            cell = passage * HASHED + info[:, k].astype(np.int64)
            hashed = np.bincount(cell, weights=info[:, k + 1], minlength=total * HASHED).reshape(total, HASHED)
            x[:, MEASURES:] += hashed / some[:, None]
        return x, firsts


@dataclass
class MilModel:
    params: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    constant: float | None = None

    def score(self, x: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(firsts), self.constant)
        return forward(self.params, (x - self.mean) / self.scale, firsts)["y"]


def sigmoid(z):
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def forward(p: dict, x: np.ndarray, firsts: np.ndarray) -> dict:
    """All intermediate values; ``y`` are the documents' scores."""
    sizes = np.diff(np.append(firsts, len(x)))
    doc = np.repeat(np.arange(len(firsts)), sizes)
    h = np.tanh(x @ p["E"] + p["e"])
    v, u = np.tanh(h @ p["V"] + p["v"]), sigmoid(h @ p["U"] + p["u"])
    a = (v * u) @ p["w"]
    a = np.exp(a - np.maximum.reduceat(a, firsts)[doc])
    a /= np.add.reduceat(a, firsts)[doc]
    z = np.add.reduceat(a[:, None] * h, firsts, axis=0)
    return {"doc": doc, "h": h, "v": v, "u": u, "a": a, "z": z, "y": sigmoid(z @ p["c"] + p["b"])}


def gradients(p: dict, x: np.ndarray, firsts: np.ndarray, y: np.ndarray) -> dict:
    """Of the mean log loss, by every parameter."""
    f = forward(p, x, firsts)
    doc, h, v, u, a = f["doc"], f["h"], f["v"], f["u"], f["a"]
    d_out = (f["y"] - y) / len(y)
    g = {"c": f["z"].T @ d_out, "b": np.array(d_out.sum())}
    d_z = d_out[:, None] * p["c"]
    d_a = (d_z[doc] * h).sum(axis=1)
    d_s = a * (d_a - np.add.reduceat(a * d_a, firsts)[doc])      # through the softmax
    d_h = a[:, None] * d_z[doc]
    g["w"] = (v * u).T @ d_s
    d_v, d_u = np.outer(d_s, p["w"]) * u * (1 - v * v), np.outer(d_s, p["w"]) * v * u * (1 - u)
    g["V"], g["v"], g["U"], g["u"] = h.T @ d_v, d_v.sum(axis=0), h.T @ d_u, d_u.sum(axis=0)
    d_h += d_v @ p["V"].T + d_u @ p["U"].T
    d_e = d_h * (1 - h * h)
    g["E"], g["e"] = x.T @ d_e, d_e.sum(axis=0)
    return g


def train(bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> MilModel:
    """Fit to documents given as passage matrices and 0/1 labels."""
    y = np.asarray(labels, dtype=np.float64)
    empty = np.zeros(WIDTH), np.ones(WIDTH)
    if len(y) == 0 or y.min() == y.max():
        return MilModel({}, *empty, constant=float((y.sum() + 1) / (len(y) + 2)))
    every = np.concatenate(bags).astype(np.float64)
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    bags = [(b - mean) / scale for b in bags]
    rng = np.random.default_rng(seed)
    size = {"E": (WIDTH, HIDDEN), "e": HIDDEN, "V": (HIDDEN, GATE), "v": GATE, "U": (HIDDEN, GATE), "u": GATE,
            "w": GATE, "c": HIDDEN, "b": ()}
    p = {k: rng.normal(size=s) * (0.0 if k in ("e", "v", "u", "b") else 1 / np.sqrt(s[0] if isinstance(s, tuple) else s))
         for k, s in size.items()}
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    rounds = max(EPOCHS, -(-600 * BATCH // len(y)))       # small samples get more passes
    for epoch in range(rounds):
        rate = RATE * (1 - epoch / rounds)
        order = rng.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            own = order[lo:lo + BATCH]
            sizes = np.array([len(bags[i]) for i in own])
            g = gradients(p, np.concatenate([bags[i] for i in own]), np.cumsum(sizes) - sizes, y[own])
            step += 1
            for k in p:
                grad = g[k] + DECAY * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * grad
                m2[k] = 0.999 * m2[k] + 0.001 * grad * grad
                p[k] = p[k] - rate * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)
    return MilModel(p, mean, scale)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int = MAX_TRAIN_ROWS
                  ) -> list[tuple[bytes, int]]:
    """(passage matrix, label) of at most ``limit`` labelled rows."""
    labelled = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("_key"), F.col(label).cast("int").alias("_label"))
    # At most ``limit`` rows of two numbers: the bound that makes the broadcast safe.
    sample = F.broadcast(labelled.orderBy(F.xxhash64("_key"), "_key", "_label").limit(limit))
    rows = docs.join(sample, docs["doc_id"] == sample["_key"]).select("text", "_label")

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        make = Featurizer()
        bags = [make([t])[0].tobytes() for t in b.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(bags, pa.binary()), b.column("_label")], names=["bag", "label"])

    found = map_arrow(rows, batch, "bag binary, label int").orderBy(F.xxhash64("bag"), "bag", "label").limit(limit)
    return [(bytes(r["bag"]), int(r["label"])) for r in found.collect()]


def in_training(labels: DataFrame) -> DataFrame:
    """Labels outside the held-out fold: crc32 of the id's text modulo 5 is not 0."""
    return labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = MAX_TRAIN_ROWS) -> MilModel:
    rows = training_rows(docs, labels, label, limit)
    bags = [np.frombuffer(b, dtype=np.float32).reshape(-1, WIDTH) for b, _ in rows]
    return train(bags, np.array([y for _, y in rows], dtype=np.int64))


def score(docs: DataFrame, model: MilModel) -> DataFrame:
    """``doc_id, score`` per row."""
    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        make, texts = featurizer(), b.column("text").to_pylist()
        scores = [model.score(*make(texts[i:i + _TEXTS])) for i in range(0, len(texts), _TEXTS)]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(scores), pa.float64())],
                                          names=["doc_id", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), batch, f"doc_id {id_type}, score double")


_FEATURIZER: list[Featurizer] = []


def featurizer() -> Featurizer:
    """This worker's featurizer (kept between tasks)."""
    if not _FEATURIZER:
        _FEATURIZER.append(Featurizer())
    return _FEATURIZER[0]


def quality_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    model = fit(docs, in_training(labels))
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return score(docs, model).select(
        "doc_id", F.coalesce(F.pmod(crc, F.lit(5)) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
