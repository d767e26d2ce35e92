"""Shallot search against plain k-means in Python integers."""

import hashlib

import numpy as np
import pytest

from peakscreen.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k, rounds, seed, dim, scale=1024):
    """Every vector against every centroid, in Python integers."""
    ok = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows
          if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    vecs = [[int(np.floor(scale * x)) for x in v] for _, v in ok]
    name = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "")
    cent = [vecs[j] for j in sorted(range(len(ok)), key=lambda j: (name(ok[j][0]), ok[j][1].tolist()))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def near():
        return [min((far(v, c), n) for n, c in enumerate(cent))[::-1] for v in vecs]
    for _ in range(rounds):
        at = near()
        for n in range(len(cent)):
            own = [v for v, (c, _) in zip(vecs, at) if c == n]
            if own:
                cent[n] = [sum(col) // len(own) for col in zip(*own)]
    return sorted(((i, *a) for (i, _), a in zip(ok, near())), key=str), cent


def run(spark, rows, **params):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    out, cent = centroids.cluster(df.select("vec_id", df.embedding.alias("vec")), **params)
    return sorted(((r.vec_id, r.cluster, r.distance) for r in out.collect()), key=str), cent.tolist()


@pytest.mark.parametrize("seed,k,dim,n,grid", [(3, 5, 4, 300, False), (7, 8, 6, 400, True), (1, 1, 3, 40, False),
                                               (2, 30, 2, 200, True)])
def test_equals_plain_rounds(spark, seed, k, dim, n, grid):
    rng = np.random.default_rng(seed)
    vecs = (rng.integers(-3, 4, (n, dim)) / 4 if grid else rng.normal(size=(n, dim)))   # a grid has many ties
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)]
    assert run(spark, rows, clusters=k, seed=seed, dim=dim, rounds=6) == plain(rows, k, 6, seed, dim)


def test_odd_rows(spark):
    rows = [(1, [0.1, 0.2]), (1, [0.1, 0.2]), (None, [5.0, 5.0]), (2, None), (3, [1.0]), (4, [1.0, float("nan")]),
            (5, [1.0, float("inf")]), (6, [None, 1.0]), (7, []), (8, [-0.3, 0.001]), (8, [4.0, 5.5]), (9, [0.0, 0.0])]
    params = {"clusters": 3, "seed": 3, "dim": 2}
    assert run(spark, rows, rounds=10, **params) == plain(rows, 3, 10, 3, 2)
    few, cent = run(spark, rows[:2], rounds=2, **params)
    assert len(cent) == 2 and [r[1] for r in few] == [0, 0]        # equal vectors: the smaller number


def test_table_of_empty_input_and_clashing_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert centroids.cluster_table(empty).collect() == []
    rows = [(i, [float(i % 7)] * 64, i) for i in range(50)]
    clash = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster int").selectExpr(
        "*", "cluster AS distance", "vec_id AS near", "vec_id AS sums", "vec_id AS vec")
    out = centroids.cluster_table(clash).collect()
    assert len(out) == 50 and {r.inertia for r in out} == {sum(r.distance for r in out)}


def test_components_beyond_the_bound_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30] * 64, 0)], SCHEMA)
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster_table(df).collect()


def test_bounds_save_distances():
    """Settled vectors compute few distances, and the ball leaves centroids out."""
    rng = np.random.default_rng(5)
    middles = rng.integers(-5000, 5000, (40, 8))
    vec = (middles[rng.integers(0, 40, 4000)] + rng.integers(-60, 60, (4000, 8))).astype(np.int32)
    search = centroids.Search.of(middles.astype(np.int64), None)
    at = centroids.Bounds.unknown(len(vec), 40)
    first = centroids.assign(vec, at, search)
    assert first < len(vec) * 40 and centroids.assign(vec, at, search) == 0
    moved = centroids.Search.of(middles + rng.integers(-30, 30, middles.shape), search.centroids)
    at.follow(moved.move)
    assert centroids.assign(vec, at, moved) < len(vec)
