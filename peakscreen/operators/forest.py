"""Random forest over all rows of a table, grown and scored by shuffles (L3).

1. Features are cut into ``BINS`` bins (candidate cuts from ``EDGE_ROWS`` rows in hash order, as Spark's forest samples them).
   Rows equal in id, bins and label become one that counts its copies; a tree draws a Poisson count for each from seeded hashes.
2. Nodes of more than ``SUBTREE_ROWS`` rows are split level by level: every task adds up the class counts per node, drawn
   feature and bin, a shuffle adds up the tasks, and one line per node reaches the driver.
3. The rows of every smaller node go, by a shuffle, to the task that grows the node to the end. The subtrees are a table.
4. To score, distinct bins meet the subtrees they fall into by a shuffle; shares are summed as integers.

Gini impurity, depth ``MAX_DEPTH``, a new draw of sqrt(features) at every node, leaves of one row, siblings that predict
the same merged: Spark's rules. The result does not depend on partitions. A null feature falls into the last bin.
"""

from __future__ import annotations

import base64
import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakscreen.operators import trees as tr
from peakscreen.session import drop_tables, ship_package, stage_table

TREES, MAX_DEPTH, BINS = 100, 30, 32
#: Rows from which the candidate cuts are taken, and rows of a node that one task grows to its end.
EDGE_ROWS, SUBTREE_ROWS = 10_000, 1 << 16
#: Nodes that a pass splits at most, nodes that travel together, and rows that a task gathers.
LEVEL_NODES, BLOCK, GATHER = 1 << 15, 64, 1 << 16
#: A share of 1 in the integer sums of the scores.
_ONE = 1 << 40
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_SUBTREES = "tree int, node int, leaf boolean, value bigint, gains array<double>, payload binary"


def _edges(x: np.ndarray) -> list[np.ndarray]:
    at, out = np.linspace(0, 1, BINS + 1)[1:-1], []
    for col in x.T:
        col = col[~np.isnan(col)]
        some = np.unique(col)
        out.append(some[:-1] if len(some) <= BINS else np.unique(np.quantile(col, at, method="inverted_cdf")))
    return out


@lru_cache(maxsize=4096)
def _poisson(mean: int) -> tuple[int, np.ndarray]:
    """(smallest count, distribution function) of the counts within ten deviations of the mean."""
    lo, hi = max(0, int(mean - 10 * math.sqrt(mean) - 10)), int(mean + 10 * math.sqrt(mean) + 20)
    log = np.cumsum(np.log(mean / np.maximum(np.arange(lo, hi + 1), 1)))
    p = np.exp(log - log.max())
    return lo, np.cumsum(p / p.sum())[:-1]


def _drawn_counts(key: np.ndarray, copies: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree's bootstrap holds each row."""
    h = (key ^ np.uint64(seed * 1_000_003 + tree)) * _ODD[0]
    h = (h ^ (h >> np.uint64(31))) * _ODD[1]
    h = (h ^ (h >> np.uint64(29))) * _ODD[2]
    u = ((h ^ (h >> np.uint64(32))) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
    out = np.zeros(len(key), np.int64)
    for c in np.unique(copies).tolist():
        at = np.flatnonzero(copies == c)
        lo, below = _poisson(c)
        out[at] = lo + np.searchsorted(below, u[at], "right")
    return out


def _packed(x: np.ndarray) -> pa.Array:
    """Rows of bytes as binary values."""
    n, p = x.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(p)),
                                                  pa.py_buffer(np.ascontiguousarray(x))])


def _unpacked(column: pa.Array, p: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), p)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= GATHER:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _best_cuts(code: np.ndarray, n0: np.ndarray, n1: np.ndarray, k: int, weights: tuple[float, float]):
    """Per node its best cut from class counts by ascending ``(node * k + draw) * BINS + bin``.

    Gives the code of the last bin on the left, the gain (negative: nothing to cut), the counts on the left and in the node.
    """
    def within(first):
        """Running sums from each first, and the sums up to the next."""
        size = np.diff(np.append(first, len(code)))
        runs = []
        for n in (n0, n1):
            c = np.cumsum(n)
            before = c[first] - n[first]
            runs.append((c - np.repeat(before, size), np.repeat(c[first + size - 1] - before, size)))
        return size, runs

    draw = code // BINS
    first = np.flatnonzero(np.append(True, draw[1:] != draw[:-1]))
    size, ((l0, t0), (l1, t1)) = within(first)

    def purity(a, b):
        a, b = weights[0] * a, weights[1] * b
        return (a * a + b * b) / np.maximum(a + b, 1e-300)

    whole = purity(t0, t1)
    gain = purity(l0, l1) + purity(t0 - l0, t1 - l1) - whole
    gain[gain <= 1e-12 * whole] = -1.0
    gain[first + size - 1] = -1.0
    node = code // (k * BINS)
    start = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    top = np.repeat(np.maximum.reduceat(gain, start), np.diff(np.append(start, len(code))))
    hit = np.flatnonzero(gain == top)
    best = hit[np.append(True, node[hit][1:] != node[hit][:-1])]
    return code[best], gain[best], (l0[best], l1[best]), (t0[best], t1[best])


def _draws(rng: np.random.Generator, nodes: int, p: int, k: int) -> np.ndarray:
    return np.argsort(rng.random((nodes, p)), axis=1)[:, :k]


def _share(n0, n1, weights) -> np.ndarray:
    a, b = weights[0] * np.asarray(n0, float), weights[1] * np.asarray(n1, float)
    return b / np.maximum(a + b, 1e-300)


def _prune(feature: np.ndarray, left: np.ndarray, value: np.ndarray, levels: Sequence[int]) -> None:
    """Merge leaves that are siblings and predict the same, from the deepest level up."""
    bounds = [*levels, len(feature)]
    for lo, hi in reversed(list(zip(bounds[:-1], bounds[1:]))):
        inner = lo + np.flatnonzero(feature[lo:hi] >= 0)
        a, b = left[inner], left[inner] + 1
        same = (feature[a] < 0) & (feature[b] < 0) & ((value[a] > 0.5) == (value[b] > 0.5))
        feature[inner[same]] = -1


def grow(x: np.ndarray, n0: np.ndarray, n1: np.ndarray, depth: int, k: int, weights: tuple[float, float],
         rng: np.random.Generator) -> tuple[tr.Tree, np.ndarray]:
    """(tree, gain per feature) of binned rows with their counts in either class."""
    p = x.shape[1]
    feature, cut, left, gains, value, levels = ([np.array([-1])], [np.array([0])], [np.array([0])], [np.zeros(1)], [], [0])
    rows, node, nodes, made = np.arange(len(x)), np.zeros(len(x), np.int64), 1, 1
    for level in range(depth + 1):
        s0 = np.bincount(node, weights=n0[rows], minlength=nodes)
        s1 = np.bincount(node, weights=n1[rows], minlength=nodes)
        value.append(_share(s0, s1, weights))
        mixed = (s0 > 0) & (s1 > 0)
        if level == depth or not mixed.any():
            break
        some = np.flatnonzero(mixed)
        slot = np.full(nodes, -1)
        slot[some] = np.arange(len(some))
        on = mixed[node]
        rows, at = rows[on], slot[node[on]]
        drawn = _draws(rng, len(some), p, k)
        code = ((at[:, None] * k + np.arange(k)) * BINS + x[rows[:, None], drawn[at]]).reshape(-1)
        c0, c1 = (np.bincount(code, weights=np.repeat(n[rows], k), minlength=len(some) * k * BINS) for n in (n0, n1))
        full = np.flatnonzero(c0 + c1)
        best, gain, _, _ = _best_cuts(full, c0[full], c1[full], k, weights)
        split = np.flatnonzero(gain > 0)
        if not len(split):
            break
        chosen = some[split]
        feature[-1][chosen] = drawn[split, best[split] // BINS % k]
        cut[-1][chosen] = best[split] % BINS
        left[-1][chosen] = made + 2 * np.arange(len(split))
        gains[-1][chosen] = gain[split]
        here = np.full(len(some), -1)
        here[split] = np.arange(len(split))
        child = here[at]
        keep = child >= 0
        rows, child, at = rows[keep], child[keep], at[keep]
        node = 2 * child + (x[rows, feature[-1][some[at]]] > cut[-1][some[at]])
        levels.append(made)
        nodes = 2 * len(split)
        made += nodes
        feature.append(np.full(nodes, -1)), cut.append(np.zeros(nodes, np.int64)), left.append(np.zeros(nodes, np.int64))
        gains.append(np.zeros(nodes))
    feature, cut, left, gains, value = (np.concatenate(a) for a in (feature, cut, left, gains, value))
    _prune(feature, left, value, levels)
    # Only what is still reached stays, numbered anew in the same order.
    reached = np.zeros(len(feature), bool)
    reached[0] = True
    for lo, hi in zip(levels, [*levels[1:], len(feature)]):
        inner = lo + np.flatnonzero(reached[lo:hi] & (feature[lo:hi] >= 0))
        reached[left[inner]] = reached[left[inner] + 1] = True
    number = np.cumsum(reached) - 1
    feature, cut, left, gains, value = feature[reached], cut[reached], number[left[reached]], gains[reached], value[reached]
    inner = feature >= 0
    return tr.Tree(feature, cut, left, value), np.bincount(feature[inner], weights=gains[inner], minlength=p)


@dataclass
class Top:
    """The upper part of one tree. ``value`` is NaN where a subtree goes on."""
    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    counts: list[tuple[float, float]] = field(default_factory=lambda: [(0.0, 0.0)])
    gain: list[float] = field(default_factory=lambda: [0.0])
    value: list[float] = field(default_factory=lambda: [math.nan])

    def tree(self) -> tr.Tree:
        return tr.Tree(np.array(self.feature), np.array(self.cut), np.array(self.left), np.array(self.value))

    def split(self, node: int, feature: int, cut: int, gain: float, left: tuple, whole: tuple) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.gain[node], self.left[node] = feature, cut, gain, len(self.feature)
        for counts in (left, (whole[0] - left[0], whole[1] - left[1])):
            for column, x in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.depth, self.depth[node] + 1),
                              (self.counts, counts), (self.gain, 0.0), (self.value, math.nan)):
                column.append(x)
        return self.left[node], self.left[node] + 1


@dataclass
class Forest:
    """A fitted forest: edges, upper trees, gain per tree and feature, and the table of subtrees."""
    features: list[str]
    edges: list[np.ndarray]
    tops: list[tr.Tree | None]                 # none: a tree without rows, which does not vote
    gains: np.ndarray
    subtrees: DataFrame

    def score(self, df: DataFrame, out: str = "probas") -> DataFrame:
        """Append the probability of class 1."""
        spark = df.sparkSession
        ship_package(spark)
        p, tops = len(self.features), [(i, t) for i, t in enumerate(self.tops) if t is not None]
        shared = spark.sparkContext.broadcast(tops)              # nodes of more than SUBTREE_ROWS rows and their children
        rows = _with_bins(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), _vector(self.features)), self.edges)

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in _gathered(batches):
                x = _unpacked(t.column("bins").combine_chunks(), p)
                known, settled = np.zeros(len(x), np.int64), np.zeros(len(x), bool)
                for i, top in shared.value:
                    leaf = top.leaf_of(x)
                    value = top.value[leaf]
                    done = ~np.isnan(value)
                    settled |= done
                    known[done] += np.rint(value[done] * _ONE).astype(np.int64)
                    by, first, nodes = _parted(leaf, np.flatnonzero(~done))
                    yield _blobs([i] * len(nodes), nodes, [x[part].tobytes() for part in np.split(by, first[1:])] if len(nodes) else [])
                some = np.flatnonzero(settled)
                if len(some):
                    both = np.concatenate([x[some], known[some].view(np.uint8).reshape(len(some), 8)], axis=1)
                    yield _blobs([-1], [int(known[some].sum() & 0xFFFF)], [both.tobytes()])

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n, sub = [], 0, None

            def done():
                both = [np.concatenate(a) for a in zip(*held)]
                return pa.RecordBatch.from_arrays([_packed(both[0]), pa.array(both[1])], names=["bins", "share"])

            for b in batches:
                for tree, kind, payload in zip(b.column("tree").to_pylist(), b.column("kind").to_pylist(), b.column("payload").to_pylist()):
                    if kind == 0:
                        sub = pickle.loads(payload)
                    elif tree < 0:
                        both = np.frombuffer(payload, np.uint8).reshape(-1, p + 8)
                        held.append((both[:, :p], np.ascontiguousarray(both[:, p:]).view(np.int64)[:, 0]))
                    else:
                        x = np.frombuffer(payload, np.uint8).reshape(-1, p)
                        held.append((x, np.rint(sub.predict(x) * _ONE).astype(np.int64)))
                    n += len(held[-1][1]) if kind else 0
                    if n >= GATHER:
                        yield done()
                        held, n = [], 0
            if held:
                yield done()

        asked = rows.select("bins").distinct().mapInArrow(route, "tree int, node int, kind int, payload binary")
        met = asked.union(self.subtrees.select("tree", "node", F.lit(0), "payload")) \
            .repartition("tree", "node").sortWithinPartitions("tree", "node", "kind")
        shares = met.mapInArrow(visit, "bins binary, share bigint").groupBy("bins").agg((F.sum("share") / F.lit(float(_ONE * len(tops)))).alias("p"))
        return rows.join(shares, "bins").select("row.*", F.col("p").alias(out))

    def importances(self) -> list[tuple[str, float]]:
        """Mean share of a tree's gain, as Spark states it."""
        whole = self.gains.sum(axis=1, keepdims=True)
        w = (self.gains / np.where(whole > 0, whole, 1.0)).sum(axis=0)
        return list(zip(self.features, (w / (w.sum() or 1.0)).tolist()))

    def save(self, path: str) -> None:
        self.subtrees.write.mode("overwrite").parquet(f"{path}/subtrees")
        about = base64.b64encode(pickle.dumps((self.features, self.edges, self.tops, self.gains))).decode()
        self.subtrees.sparkSession.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/upper")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        about = pickle.loads(base64.b64decode(spark.read.text(f"{path}/upper").first()[0]))
        return cls(*about, spark.read.schema(_SUBTREES).parquet(f"{path}/subtrees"))


def _vector(features: Sequence[str]):
    return F.array(*[F.col(f"`{c}`").cast("double") for c in features]).alias("x")


def _with_bins(df: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """``df`` with its column ``x`` replaced by ``bins``, a byte per feature."""
    others = [c for c in df.columns if c != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in others], _packed(tr.binned(x, edges).astype(np.uint8))], names=[*others, "bins"])

    return df.mapInArrow(run, T.StructType([*[df.schema[c] for c in others], T.StructField("bins", T.BinaryType())]))


def _parted(leaf: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(``some`` ordered by leaf, where each leaf begins, the leaves)."""
    by = some[np.argsort(leaf[some], kind="stable")]
    of = leaf[by]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(by) else np.zeros(0, np.int64)
    return by, first, of[first].tolist()


def _blobs(tree, node, payload) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(node, pa.int32()), pa.array([1] * len(node), pa.int32()),
                                       pa.array(payload, pa.binary())], names=["tree", "node", "kind", "payload"])


def _parts(t: pa.Table, p: int):
    return (_unpacked(t.column("bins").combine_chunks(), p), t.column("y").to_numpy().astype(np.int64),
            t.column("key").to_numpy().view(np.uint64), t.column("copies").to_numpy())


def _split_level(rows: DataFrame, tops: list[tr.Tree], active: list[tuple[int, int]], p: int, k: int, weights, seed: int) -> dict:
    """Best cut of each active (tree, node): (feature, cut, gain, counts on the left, counts in the node)."""
    active = sorted(active)
    drawn = np.concatenate([_draws(np.random.default_rng((seed, t, n)), 1, p, k) for t, n in active])
    slots = [np.full(len(t.feature), -1) for t in tops]
    for s, (t, n) in enumerate(active):
        slots[t][n] = s
    spans = {}
    for s, (t, _) in enumerate(active):
        spans[t] = (spans.get(t, (s,))[0], s + 1)
    shared = rows.sparkSession.sparkContext.broadcast((tops, slots, drawn, spans))
    cells = k * BINS * 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper, slot_of, draws, of_tree = shared.value
        sums = None
        for table in _gathered(batches):
            x, y, key, copies = _parts(table, p)
            if sums is None:
                sums = np.zeros(len(draws) * cells, np.int64)
            for t, (lo, hi) in of_tree.items():
                n = _drawn_counts(key, copies, t, seed)
                at = slot_of[t][upper[t].leaf_of(x)]
                on = np.flatnonzero((n > 0) & (at >= 0))
                at = at[on]
                code = (((at - lo)[:, None] * k + np.arange(k)) * BINS + x[on[:, None], draws[at]]) * 2 + y[on][:, None]
                sums[lo * cells:hi * cells] += np.bincount(code.reshape(-1), weights=np.repeat(n[on], k), minlength=(hi - lo) * cells).astype(np.int64)
        if sums is not None:
            for i in range(0, len(draws), BLOCK):
                own = sums[i * cells:(i + BLOCK) * cells]
                if own.any():
                    yield pa.RecordBatch.from_arrays([pa.array([i // BLOCK], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["block", "counts"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None

        def done():
            if now is None:
                return
            c = sums.reshape(-1, 2)
            full = np.flatnonzero(c.sum(axis=1))
            code, gain, left, whole = _best_cuts(full, c[full, 0], c[full, 1], k, weights)
            yield pa.RecordBatch.from_arrays([pa.array(code + now * BLOCK * k * BINS), pa.array(gain), *[pa.array(a.astype(float)) for a in (*left, *whole)]],
                                             names=["code", "gain", "l0", "l1", "t0", "t1"])

        for b in batches:
            for block, counts in zip(b.column("block").to_pylist(), b.column("counts").to_pylist()):
                if block != now:
                    yield from done()
                    now, sums = block, np.frombuffer(counts, np.int64).copy()
                else:
                    sums += np.frombuffer(counts, np.int64)
        yield from done()

    found = rows.mapInArrow(count, "block int, counts binary").repartition("block").sortWithinPartitions("block") \
        .mapInArrow(best, "code bigint, gain double, l0 double, l1 double, t0 double, t1 double").collect()
    out = {}
    for r in found:
        slot, draw, cut = r["code"] // (k * BINS), r["code"] // BINS % k, r["code"] % BINS
        out[active[slot]] = (int(drawn[slot, draw]), int(cut), r["gain"], (r["l0"], r["l1"]), (r["t0"], r["t1"]))
    shared.unpersist()
    return out


def _grow_rest(rows: DataFrame, tops: list[tr.Tree], depths: list[list[int]], p: int, k: int, weights, seed: int, max_depth: int) -> DataFrame:
    """The table of subtrees below the open nodes."""
    shared = rows.sparkSession.sparkContext.broadcast((tops, depths))

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper, _ = shared.value
        for table in _gathered(batches):
            x, y, key, copies = _parts(table, p)
            for t, top in enumerate(upper):
                n = _drawn_counts(key, copies, t, seed)
                leaf = top.leaf_of(x)
                by, first, nodes = _parted(leaf, np.flatnonzero((n > 0) & np.isnan(top.value[leaf])))
                whole = np.concatenate([x[by], (n[by] * 2 + y[by]).view(np.uint8).reshape(len(by), 8)], axis=1)
                yield _blobs([t] * len(nodes), nodes, [part.tobytes() for part in np.split(whole, first[1:])] if len(nodes) else [])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done():
            if now is None:
                return
            # Growing only adds up whole counts: neither the shuffle's order nor the batches matter.
            whole = np.frombuffer(b"".join(held), np.uint8).reshape(-1, p + 8)
            count = np.ascontiguousarray(whole[:, p:]).view(np.int64)[:, 0]
            x = np.ascontiguousarray(whole[:, :p])
            n0, n1 = (np.where(count & 1 == c, count >> 1, 0) for c in (0, 1))
            tree, gains = grow(x, n0, n1, max_depth - shared.value[1][now[0]][now[1]], k, weights, np.random.default_rng((seed, *now, 1)))
            small = tr.Tree(tree.feature.astype(np.int16), tree.cut.astype(np.int16), tree.left.astype(np.int32), tree.value)
            yield pa.RecordBatch.from_arrays(
                [pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([len(tree.feature) == 1]),
                 pa.array([int(np.rint(tree.value[0] * _ONE))], pa.int64()), pa.array([gains.tolist()], pa.list_(pa.float64())),
                 pa.array([pickle.dumps(small)], pa.binary())], names=["tree", "node", "leaf", "value", "gains", "payload"])

        for b in batches:
            for t, n, payload in zip(b.column("tree").to_pylist(), b.column("node").to_pylist(), b.column("payload").to_pylist()):
                if (t, n) != now:
                    yield from done()
                    now, held = (t, n), []
                held.append(payload)
        yield from done()

    bags = rows.mapInArrow(bag, "tree int, node int, kind int, payload binary")
    return stage_table(bags.repartition("tree", "node").sortWithinPartitions("tree", "node").mapInArrow(finish, _SUBTREES), "forest")[0]


def fit_forest(train: DataFrame, features: Sequence[str], label: str = "reported", id_col: str = "row_id", weighted: bool = True,
               pos_weight: float = 1.0, trees: int = TREES, max_depth: int = MAX_DEPTH, seed: int = 42,
               subtree_rows: int = SUBTREE_ROWS) -> Forest:
    """Forest on all labelled rows of ``train``; classes are balanced unless ``weighted`` is false."""
    feats, spark = list(features), train.sparkSession
    ship_package(spark)
    p = len(feats)
    k = math.ceil(math.sqrt(p))
    labelled = train.where(F.col(f"`{label}`").isNotNull())
    x = _vector(feats)
    some = labelled.select(x).orderBy(F.xxhash64("x")).limit(EDGE_ROWS).collect()
    if not some:
        raise ValueError("no labelled rows to fit on")
    edges = _edges(np.array([r["x"] for r in some], dtype=float))
    one = F.col(f"`{id_col}`") if id_col in train.columns else F.lit(None).cast("long")
    binned = _with_bins(labelled.select(one.alias("id"), (F.col(f"`{label}`") == 1).cast("int").alias("y"), x), edges)
    rows, path = stage_table(binned.groupBy("id", "bins", "y").agg(F.count(F.lit(1)).alias("copies"))
                             .select("bins", "y", "copies", F.xxhash64("id", "bins", "y").alias("key")), "forest-rows")
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.sum("copies").alias("n")).collect()}
    total = sum(counts.values())
    weights = (1.0, 1.0)
    if weighted:
        weights = tuple(total / (len(counts) * counts[c]) * w if c in counts else 1.0 for c, w in ((0, 1.0), (1, pos_weight)))

    tops = [Top() for _ in range(trees)]
    waiting = [(t, 0) for t in range(trees)] if total > subtree_rows else []
    while waiting:
        now, waiting = waiting[:LEVEL_NODES], waiting[LEVEL_NODES:]
        for (t, n), (feature, cut, gain, left, whole) in sorted(_split_level(rows, [x.tree() for x in tops], now, p, k, weights, seed).items()):
            top = tops[t]
            top.counts[n] = whole
            if gain <= 0:
                top.value[n] = float(_share(*whole, weights))
                continue
            for child in top.split(n, feature, cut, gain, left, whole):
                a, b = top.counts[child]
                if min(a, b) == 0 or top.depth[child] == max_depth:
                    top.value[child] = float(_share(a, b, weights))
                elif a + b > subtree_rows:
                    waiting.append((t, child))
    subtrees = _grow_rest(rows, [x.tree() for x in tops], [x.depth for x in tops], p, k, weights, seed, max_depth)
    drop_tables(spark, path)
    return _joined(tops, subtrees, feats, edges, weights)


def _joined(tops: list[Top], subtrees: DataFrame, features: list[str], edges: list[np.ndarray], weights) -> Forest:
    """Merge sibling leaves across the border of upper trees and subtrees, and sum the gains of what stays."""
    below = {(r["tree"], r["node"]): r for r in subtrees.select("tree", "node", "leaf", "value", "gains").collect()}   # a line per subtree
    gains, out = np.zeros((len(tops), len(features))), []
    for t, top in enumerate(tops):
        leaf = {n: v for n, v in enumerate(top.value) if top.feature[n] < 0 and not math.isnan(v)}
        leaf |= {n: r["value"] / _ONE for (i, n), r in below.items() if i == t and r["leaf"]}
        for n in reversed(range(len(top.feature))):
            a = top.left[n]
            if top.feature[n] >= 0 and a in leaf and a + 1 in leaf and (leaf[a] > 0.5) == (leaf[a + 1] > 0.5):
                top.feature[n], top.value[n] = -1, float(_share(*top.counts[n], weights))
                leaf[n] = top.value[n]
        stack = [0]
        while stack:
            n = stack.pop()
            if top.feature[n] >= 0:
                gains[t, top.feature[n]] += top.gain[n]
                stack += [top.left[n], top.left[n] + 1]
            elif math.isnan(top.value[n]) and (t, n) in below:
                gains[t] += below[t, n]["gains"]
        out.append(top.tree() if len(top.feature) > 1 or not math.isnan(top.value[0]) or (t, 0) in below else None)
    return Forest(features, edges, out, gains, subtrees)
