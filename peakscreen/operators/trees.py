"""Histogram trees.

Features are binned once; a tree grows level by level from sums of gradients and hessians per node, feature and bin. :func:`grow` takes
one matrix of rows. :func:`grow_parts` takes rows in parts of which other tasks may hold more: amounts are whole numbers, so sums
do not depend on their order, and only one of two siblings is counted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np

BINS = 32


def bin_edges(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Upper edges of each feature's quantile bins."""
    at = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(col, at, method="inverted_cdf")) for col in x.T]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, col, "left") for e, col in zip(edges, x.T)], axis=1).astype(np.int64)


@dataclass(frozen=True)
class Growth:
    """Limits and penalties of one tree."""
    max_depth: int = 6
    min_child_weight: float = 0.0
    min_split: float = 2
    gamma: float = 0.0
    reg_lambda: float = 0.0
    reg_alpha: float = 0.0
    features: int | None = None            # drawn anew for every node


@dataclass
class Tree:
    feature: np.ndarray                    # -1 at a leaf
    cut: np.ndarray                        # rows with a bin up to it go left
    left: np.ndarray
    value: np.ndarray

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        while True:
            f = self.feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return at
            node = at[inner]
            at[inner] = self.left[node] + (bins[inner, f[inner]] > self.cut[node])

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.leaf_of(bins)]


def _shrunk(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0) if alpha else g


def _score(how: Growth, gs: np.ndarray, hs: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        s = _shrunk(gs, how.reg_alpha) ** 2 / (hs + how.reg_lambda)
    return np.where(hs + how.reg_lambda > 0, s, 0.0)


def _weight(how: Growth, gs: np.ndarray, hs: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        w = -_shrunk(gs, how.reg_alpha) / (hs + how.reg_lambda)
    return np.where(hs + how.reg_lambda > 0, w, 0.0)


def _splits(how: Growth, sums: Sequence[np.ndarray], hist: Sequence[np.ndarray], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(feature and bin of each node's best cut as one number, nodes that gain by it) from sums of gradients, hessians and, unless
    its limits follow from the hessians' own, counts: per node, and per node, feature and bin."""
    here, p, _ = hist[0].shape
    left = [np.cumsum(x, axis=2)[:, :, :-1] for x in hist]
    right = [s[:, None, None] - x for s, x in zip(sums, left)]
    gain = (_score(how, *left[:2]) + _score(how, *right[:2]) - _score(how, *sums[:2])[:, None, None]) / 2 - how.gamma
    ok = (left[1] >= how.min_child_weight) & (right[1] >= how.min_child_weight)
    if len(hist) > 2:
        ok &= (left[2] > 0) & (right[2] > 0) & (sums[2] >= how.min_split)[:, None, None]
    if how.features is not None and how.features < p:
        drawn = np.argsort(rng.random((here, p)), axis=1)[:, :how.features]
        allowed = np.zeros((here, p), bool)
        np.put_along_axis(allowed, drawn, True, 1)
        ok &= allowed[:, :, None]
    gain = np.where(ok, gain, -np.inf).reshape(here, -1)
    if not gain.shape[1]:
        return np.zeros(here, np.int64), np.zeros(0, np.int64)
    best = gain.argmax(axis=1)
    return best, np.flatnonzero(np.take_along_axis(gain, best[:, None], 1)[:, 0] > 1e-12)


def grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray, n: np.ndarray, how: Growth, rng: np.random.Generator) -> Tree:
    """Tree that lowers the second-order loss with gradients ``g`` and hessians ``h``; ``n`` counts each row."""
    p, width = bins.shape[1], int(bins.max(initial=0)) + 1
    feature, cut, left, value = [-1], [0], [0], [0.0]
    rows = np.flatnonzero(n > 0)
    node, start = np.zeros(len(rows), np.int64), 0

    for depth in range(how.max_depth + 1):
        here = len(feature) - start                        # nodes of this level
        sums = [np.bincount(node - start, weights=a[rows], minlength=here) for a in (g, h, n)]
        value[start:] = _weight(how, sums[0], sums[1]).tolist()
        if depth == how.max_depth:
            break
        code = ((node - start)[:, None] * p + np.arange(p)) * width + bins[rows]
        hist = [np.bincount(code.reshape(-1), weights=np.repeat(a[rows], p), minlength=here * p * width).reshape(here, p, width) for a in (g, h, n)]
        best, splits = _splits(how, sums, hist, rng)
        if not len(splits):
            break
        end = len(feature)
        for i, s in enumerate(splits.tolist()):
            feature[start + s], cut[start + s], left[start + s] = int(best[s]) // (width - 1), int(best[s]) % (width - 1), end + 2 * i
        feature += [-1] * (2 * len(splits))
        cut += [0] * (2 * len(splits))
        left += [0] * (2 * len(splits))
        value += [0.0] * (2 * len(splits))
        f = np.array(feature)[node]
        on = f >= 0
        rows, node, f = rows[on], node[on], f[on]
        node = np.array(left)[node] + (bins[rows, f] > np.array(cut)[node])
        start = end
    return Tree(np.array(feature), np.array(cut), np.array(left), np.array(value))


def forest_probabilities(bins: np.ndarray, y: np.ndarray, other: np.ndarray, trees: int, min_split: int, min_leaf: float,
                         features: int, seed: int, max_depth: int = 30) -> np.ndarray:
    """Mean leaf share of class 1 over bootstrap trees; classes are balanced within each bootstrap.

    ``min_leaf`` is the share of the rows that a leaf has to hold.
    """
    rng = np.random.default_rng(seed)
    out = np.zeros(len(other))
    for _ in range(trees):
        n = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)).astype(float)
        ones = n[y == 1].sum()
        balance = np.where(y == 1, n.sum() / (2 * max(ones, 1)), n.sum() / (2 * max(n.sum() - ones, 1)))
        how = Growth(max_depth=max_depth, min_split=max(min_split, 2), features=features, min_child_weight=min_leaf * (n * balance).sum())
        tree = grow(bins, -n * balance * y, n * balance, n, how, rng)
        out += tree.predict(other)
    return out / trees


def boosted_margins(bins: np.ndarray, y: np.ndarray, other: np.ndarray, rounds: int, eta: float, how: Growth, seed: int,
                    subsample: float = 1.0, columns: float = 1.0, pos_weight: float = 1.0,
                    start: tuple[int, np.ndarray, np.ndarray] | None = None,
                    keep: list | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(round, margins of the training rows, margins of the other rows) of logistic boosting, round by round.

    Each round draws from a generator of its own, so boosting goes on from ``start`` as if it had never stopped.
    ``keep`` collects the columns and the tree of each round.
    """
    first, own, margins = start or (0, np.zeros(len(y)), np.zeros(len(other)))
    weight = np.where(y == 1, pos_weight, 1.0)
    n_cols = max(1, round(columns * bins.shape[1]))
    for r in range(first + 1, first + rounds + 1):
        rng = np.random.default_rng((seed, r))
        p = 1 / (1 + np.exp(-own))
        n = weight * (rng.random(len(y)) < subsample)
        cols = np.sort(rng.permutation(bins.shape[1])[:n_cols])
        tree = grow(bins[:, cols], n * (p - y), n * p * (1 - p), n, how, rng)
        own = own + eta * tree.predict(bins[:, cols])
        margins = margins + eta * tree.predict(other[:, cols])
        if keep is not None:
            keep.append((cols, tree))
        yield r, own, margins


# ---------------------------------------------------------------------------
# Rows in parts
# ---------------------------------------------------------------------------


def grow_parts(parts: Sequence[tuple[np.ndarray, Sequence[np.ndarray]]], p: int, width: int, how: Growth, rng: np.random.Generator,
               kinds: int, derive: Callable, summed: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> Tree:
    """As :func:`grow`, from ``parts`` of the rows: bins (a line per feature) and ``kinds`` whole-numbered amounts of each row.

    ``derive`` makes gradients, hessians and perhaps counts from summed amounts, ``summed`` adds the sums of the tasks that hold the other parts.
    """
    feature, cut, left, value, start = [-1], [0], [0], [0.0], 0
    held = [(bins, amounts, np.zeros(bins.shape[1], np.int64)) for bins, amounts in parts]     # node: within its level

    def counted(slots: int, slot_of: np.ndarray) -> np.ndarray:
        out = np.zeros((kinds, slots, p, width))
        for bins, amounts, node in held:
            slot = slot_of[node]
            if (slot < 0).any():
                on = np.flatnonzero(slot >= 0)
                slot, bins, amounts = slot[on], bins[:, on], [a[on] for a in amounts]
            slot = slot * width
            for j in range(p):
                code = slot + bins[j]
                for i, a in enumerate(amounts):
                    out[i, :, j] += np.bincount(code, weights=a, minlength=slots * width).reshape(slots, width)
        return summed(out)

    hist = counted(1, np.zeros(1, np.int64))
    raw = hist[:, :, 0].sum(axis=2)
    for depth in range(how.max_depth + 1):
        sums = derive(raw)
        value[start:] = _weight(how, sums[0], sums[1]).tolist()
        if depth == how.max_depth:
            break
        best, splits = _splits(how, sums, derive(hist), rng)
        if not len(splits):
            break
        end, n = len(feature), len(splits)
        f, c = best[splits] // (width - 1), best[splits] % (width - 1)
        for i, s in enumerate(splits.tolist()):
            feature[start + s], cut[start + s], left[start + s] = int(f[i]), int(c[i]), end + 2 * i
        feature += [-1] * (2 * n)
        cut += [0] * (2 * n)
        left += [0] * (2 * n)
        value += [0.0] * (2 * n)
        low = np.cumsum(hist[:, splits, f], axis=2)[:, np.arange(n), c]
        both = np.stack([low, raw[:, splits] - low], axis=2)
        raw = both.reshape(kinds, 2 * n)
        start = end
        if depth + 1 == how.max_depth:
            continue
        at = np.full(hist.shape[1], -1)
        at[splits] = np.arange(n)
        moved = []
        for bins, amounts, node in held:
            node = at[node]
            if (node < 0).any():
                on = np.flatnonzero(node >= 0)
                node, bins, amounts = node[on], bins[:, on], [a[on] for a in amounts]
            moved.append((bins, amounts, 2 * node + (bins[f[node], np.arange(len(node))] > c[node])))
        held = moved
        # The lighter sibling is counted, the other is the rest of its parent.
        light = derive(both)[1].argmin(axis=1)
        slot_of = np.full(2 * n, -1)
        slot_of[2 * np.arange(n) + light] = np.arange(n)
        own = counted(n, slot_of)
        rest = hist[:, splits] - own
        hist = np.empty((kinds, 2 * n, p, width))
        hist[:, 2 * np.arange(n) + light], hist[:, 2 * np.arange(n) + 1 - light] = own, rest
    return Tree(np.array(feature), np.array(cut), np.array(left), np.array(value))


def predict_lines(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """Values of rows whose bins have a line per feature."""
    inner = tree.feature >= 0
    f, cut = np.where(inner, tree.feature, 0), np.where(inner, tree.cut, np.iinfo(np.int64).max)
    left = np.where(inner, tree.left, np.arange(len(inner)))
    at, rows = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
    while inner[at].any():
        at = left[at] + (bins[f[at], rows] > cut[at])
    return tree.value[at]


def boosted_parts(blocks: Sequence, total: int, p: int, width: int, rounds: int, eta: float, how: Growth, seed: int, subsample: float = 1.0,
                  columns: float = 1.0, pos_weight: float = 1.0, others: Sequence[np.ndarray] = (),
                  summed: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> tuple[list[tuple[np.ndarray, Tree]], list[np.ndarray]]:
    """(columns and tree of each round, margins of ``others``) of the boosting of :func:`boosted_margins`, with its draws, on ``total`` rows
    of which ``blocks`` (``bins``, ``y``, ``start``) are this task's.

    Gradients and hessians are rounded to multiples of a power of two so small that all rows' sums are exact.
    """
    scale = 2.0 ** min(40, 51 - int(np.ceil(np.log2(max(pos_weight, 1.0) * total + 2))))
    own, margins = [np.zeros(len(b.y)) for b in blocks], [np.zeros(x.shape[1]) for x in others]
    weights = [np.where(b.y == 1, pos_weight, 1.0) for b in blocks]
    n_cols = max(1, round(columns * p))
    # A count per node is needed only where the limits on hessians (a quarter of the count at most) do not imply those on counts.
    counts = not (how.min_child_weight > 0 and 8 * how.min_child_weight >= how.min_split)
    kept = []
    for r in range(1, rounds + 1):
        rng = np.random.default_rng((seed, r))
        bits = rng.bit_generator
        begun = bits.state
        bits.advance(total)
        cols = np.sort(rng.permutation(p)[:n_cols])
        parts = []
        for b, m, w in zip(blocks, own, weights):
            bits.state = begun
            bits.advance(b.start)
            on = np.flatnonzero((rng.random(len(b.y)) < subsample) & (w > 0))
            prob, n = 1 / (1 + np.exp(-m[on])), w[on]
            amounts = [np.rint(n * (prob - b.y[on]) * scale), np.rint(n * prob * (1 - prob) * scale)]
            parts.append((b.bins[cols][:, on], [*amounts, n * 2.0 ** 20] if counts else amounts))
        tree = grow_parts(parts, n_cols, width, how, rng, 2 + counts, lambda x: (x[0] / scale, x[1] / scale, *(x[2:] / 2.0 ** 20)), summed)
        for some, data in ((own, [b.bins for b in blocks]), (margins, others)):
            for i, x in enumerate(data):
                some[i] = some[i] + eta * predict_lines(tree, x[cols])
        kept.append((cols, tree))
    return kept, margins


def forest_parts(blocks: Sequence, total: int, p: int, width: int, others: Sequence[np.ndarray], trees: int, min_split: int, min_leaf: float,
                 features: int, seed: int, max_depth: int = 30) -> list[np.ndarray]:
    """Probabilities of :func:`forest_probabilities`, with its draws, from ``blocks`` that hold all ``total`` rows in their order."""
    rng = np.random.default_rng(seed)
    out = [np.zeros(x.shape[1]) for x in others]
    for _ in range(trees):
        n = np.zeros(total, np.int32)
        for lo in range(0, total, 1 << 20):
            np.add.at(n, rng.integers(0, total, min(1 << 20, total - lo)), 1)
        parts, ones = [], 0
        for b in blocks:
            c = n[b.start:b.start + len(b.y)]
            on = np.flatnonzero(c)
            c, hit = c[on].astype(float), b.y[on] == 1
            ones += int(c[hit].sum())
            parts.append((b.bins[:, on], [np.where(hit, 0.0, c), np.where(hit, c, 0.0)]))
        w1, w0 = total / (2 * max(ones, 1)), total / (2 * max(total - ones, 1))
        how = Growth(max_depth=max_depth, min_split=max(min_split, 2), features=features, min_child_weight=min_leaf * (w1 * ones + w0 * (total - ones)))
        tree = grow_parts(parts, p, width, how, rng, 2, lambda x: (-w1 * x[1], w0 * x[0] + w1 * x[1], x[0] + x[1]))
        for i, x in enumerate(others):
            out[i] = out[i] + predict_lines(tree, x)
    return [x / trees for x in out]
