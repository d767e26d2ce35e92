"""Product-quantised search against brute force: links, groups, recall at the threshold."""

import numpy as np

from peakscreen.llm import embedding_pq as pq

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, cosine=pq.COSINE):
    """n_links and component by all pairs; rows as (vec_id, vector or None)."""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    n = len(rows)
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                near[i, j] = near[j, i] = a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= cosine
    label = np.arange(n)
    while True:
        new = np.array([label[near[i] | (np.arange(n) == i)].min() for i in range(n)])
        if (new == label).all():
            break
        label = new
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if label[j] == label[i] and rows[j][0] is not None]
        comp = min(ids) if ids else None
        out.append((rows[i][0], int(near[i].sum()), comp, rows[i][0] == comp))
    return sorted(out, key=str)


def run(spark, rows, **params):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(4)
    return sorted((tuple(r) for r in pq.near_duplicates(df, **params).collect()), key=str)


def _around(rng, x, cosine):
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    return cosine * x + np.sqrt(1 - cosine ** 2) * away


def test_groups_copies_and_odd_rows(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 10))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    vecs = [*base, *_around(rng, base[:20], 0.95), *_around(rng, base[:10], 0.91), *(7 * base[:5]), *base[:3], *([base[0]] * 30)]
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)]
    rows += [(900, None), (901, [0.0] * 10), (902, [float("nan")] * 10), (903, [None] + [1.0] * 9), (904, []), (905, base[0][:5].tolist()),
             (None, base[1].tolist()), (3, base[3].tolist()), (906, (1e200 * base[2]).tolist()), (907, (1e-200 * base[2]).tolist()),
             (908, [None] + [1.0] * 9), (None, (-base[5]).tolist()), (909, [0.0] * 10)]
    assert run(spark, rows) == brute(rows)


def test_tiles_lose_nothing(spark):
    """One crowded group over many tiles of members and of queries."""
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(1, 8))
    middle /= np.linalg.norm(middle)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([_around(rng, np.repeat(middle, 120, 0), 0.96), rng.normal(size=(60, 8))]))]
    got, want = run(spark, rows, tile=16), brute(rows)
    assert got == run(spark, rows) and [r[2:] for r in got] == [r[2:] for r in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want)


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold among strangers: at least nine in ten, and no pair below it."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(3000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    vecs = np.concatenate([base, _around(rng, base[:400], 0.9005), _around(rng, base[400:600], 0.8995)])
    got = {r[0]: r for r in run(spark, [(i, v.tolist()) for i, v in enumerate(vecs)])}
    caught = sum(got[3000 + i][2] == i and got[i][1] == 1 for i in range(400))
    assert caught >= 0.99 * 400
    assert all(got[3400 + i][1] == 0 for i in range(200))


def test_empty_and_unusable_tables_and_clashing_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pq.dedup_table(empty).collect() == []
    assert run(spark, [(1, None), (2, [0.0])]) == [(1, 0, 1, True), (2, 0, 2, True)]
    df = spark.createDataFrame([(1, [1.0, 0.0], 5), (2, [1.0, 0.0], 6)], "vec_id long, embedding array<double>, n int") \
        .selectExpr("*", "n AS key", "n AS links", "n AS component", "n AS kept")
    assert sorted(tuple(r) for r in pq.dedup_table(df).collect()) == [(1, 1, 1, True), (2, 1, 1, False)]
