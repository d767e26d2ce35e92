"""Exact k-means on integer vectors by Shallot search.

Vectors are floored to integers once and packed into blocks of at most ``BLOCK``; a block is one
row of a table in the shared folder: ids, vectors, and per vector its centroid, its second-nearest
centroid, an upper bound on the distance to the first and a lower bound on that to all others.
Each round reads that table, writes the next one and removes the one before:

1. A vector whose upper bound lies below its lower bound, or below half the distance from its
   centroid to the nearest other one, keeps its centroid and costs nothing.
2. Otherwise the upper bound is made exact; if that does not settle it, the distance to the remembered
   second centroid is computed and the search starts from the closer of the two.
3. Other centroids are visited in order of their distance from the starting one, as long as they lie in a
   ball around it whose radius is the vector's distance to the start plus that to the second nearest so
   far: the ball shrinks with every nearer centroid found.
4. Whatever survives the bounds is compared by squared distance in 64-bit integers; equal
   distances go to the smaller number. Bounds carry a margin for rounding, so they never decide a tie.

Sums of a round are exact; a block's sums are added up by an ordinary aggregate, and the driver holds
the centroids alone. When no centroid moves, later rounds would repeat the last one and are left out.

Defined cases: rows whose vector is null, of another length, or holds a null or non-finite component are left out;
rows with equal ids or vectors stay separate rows; a null id counts as the largest when seeds are chosen, and of
equal hashes the smaller vector comes first; with fewer vectors than clusters each vector starts one; an
empty table gives an empty table. A component beyond +-2^27 after scaling raises an error: squared
distances would not fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakscreen.llm.common import discard, staged_at
from peakscreen.session import ship_package

DIM, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, 3
LIMIT = 1 << 27
BLOCK = 4096
#: Relative margin of the floating-point bounds; their rounding errors are near 1e-15.
MARGIN = 1e-9

_BLOCKS = "ids array<bigint>, vec binary, near binary, second binary, upper binary, lower binary, " \
          "sums array<bigint>, counts array<bigint>"
_FINAL = "vec_id bigint, cluster int, distance bigint"


@dataclass
class Search:
    """Centroids of a round: their distances from each other, neighbours in order, last moves."""
    centroids: np.ndarray                  # (k, dim) int64
    between: np.ndarray                    # (k, k) float64
    order: np.ndarray                      # (k, k - 1): the others by distance
    half: np.ndarray                       # half the distance to the nearest other one, less a margin
    move: np.ndarray                       # how far each moved in the last update, with a margin

    @classmethod
    def of(cls, centroids: np.ndarray, before: np.ndarray | None) -> Search:
        k = len(centroids)
        between = np.sqrt(np.stack([_squared(centroids, np.broadcast_to(c, centroids.shape)) for c in centroids]).astype(float))
        apart = between + np.diag(np.full(k, np.inf))
        order = np.argsort(apart, axis=1, kind="stable")[:, :k - 1]
        half = apart.min(axis=1) / 2 * (1 - MARGIN)
        move = np.zeros(k) if before is None else np.sqrt(_squared(centroids, before).astype(float)) * (1 + MARGIN)
        return cls(centroids, between, order, half, move)


@dataclass
class Bounds:
    """What each vector of a block remembers."""
    near: np.ndarray
    second: np.ndarray
    upper: np.ndarray
    lower: np.ndarray

    @classmethod
    def unknown(cls, n: int, k: int) -> Bounds:
        return cls(np.zeros(n, np.int32), np.full(n, min(1, k - 1), np.int32), np.full(n, np.inf), np.zeros(n))

    @classmethod
    def unpack(cls, row: dict) -> Bounds:
        return cls(np.frombuffer(row["near"], np.int32).copy(), np.frombuffer(row["second"], np.int32).copy(),
                   np.frombuffer(row["upper"], np.float64).copy(), np.frombuffer(row["lower"], np.float64).copy())

    def follow(self, move: np.ndarray) -> None:
        """Widen the bounds by the centroids' moves."""
        if len(move) > 1:
            first = int(np.argmax(move))
            rest = np.delete(move, first).max()
            self.upper += move[self.near]
            self.upper *= 1 + MARGIN
            self.lower -= np.where(self.near == first, rest, move[first])


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a.astype(np.int64) - b
    return np.einsum("ij,ij->i", d, d)


def _integers(vec: np.ndarray, scale: int) -> np.ndarray:
    scaled = np.floor(vec * float(scale))
    if scaled.size and np.abs(scaled).max() > LIMIT:
        raise ValueError(f"a component beyond +-{LIMIT} after scaling: squared distances would not fit 64 bits")
    return scaled.astype(np.int64)


def assign(vec: np.ndarray, at: Bounds, search: Search) -> int:
    """Move every vector of a block to its nearest centroid; the number of distances computed."""
    c, k = search.centroids, len(search.centroids)
    if k == 1:
        at.near[:] = 0
        return 0

    def open_(rows):
        return ~((at.upper[rows] < at.lower[rows]) | (at.upper[rows] < search.half[at.near[rows]]))

    todo = np.flatnonzero(open_(slice(None)))
    first = _squared(vec[todo], c[at.near[todo]])
    at.upper[todo] = np.sqrt(first.astype(float)) * (1 + MARGIN)
    computed = len(todo)
    left = open_(todo)
    todo, first = todo[left], first[left]
    if not len(todo):
        return computed

    near, second, mine = at.near[todo], at.second[todo], vec[todo]
    other = _squared(mine, c[second])
    computed += len(todo)
    swap = (other < first) | ((other == first) & (second < near))
    start, best = np.where(swap, second, near), np.where(swap, other, first)
    runner, behind = np.where(swap, near, second), np.where(swap, first, other)
    known, nearest = runner.copy(), start.copy()
    reach = np.sqrt(best.astype(float))                    # from the start, wherever the nearest is found
    inside = np.arange(len(todo))
    for step in range(k - 1):
        new = search.order[start[inside], step]
        ball = (reach[inside] + np.sqrt(behind[inside].astype(float))) * (1 + MARGIN)
        within = search.between[start[inside], new] * (1 - MARGIN) <= ball
        inside, new = inside[within], new[within]
        if not len(inside):
            break
        fresh = new != known[inside]
        rows, new = inside[fresh], new[fresh]
        d = _squared(mine[rows], c[new])
        computed += len(rows)
        wins = (d < best[rows]) | ((d == best[rows]) & (new < nearest[rows]))
        w = rows[wins]
        behind[w], runner[w] = best[w], nearest[w]
        best[w], nearest[w] = d[wins], new[wins]
        places = ~wins & ((d < behind[rows]) | ((d == behind[rows]) & (new < runner[rows])))
        p = rows[places]
        behind[p], runner[p] = d[places], new[places]
    at.near[todo], at.second[todo] = nearest, runner
    at.upper[todo] = np.sqrt(best.astype(float)) * (1 + MARGIN)
    at.lower[todo] = np.sqrt(behind.astype(float)) * (1 - MARGIN)
    return computed


def _totals(vec: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the vectors and their number per centroid."""
    sums, counts = np.zeros((k, vec.shape[1]), np.int64), np.bincount(near, minlength=k)
    by = np.argsort(near, kind="stable")
    used = np.flatnonzero(counts)
    sums[used] = np.add.reduceat(vec[by], (np.cumsum(counts) - counts)[used], axis=0, dtype=np.int64)
    return sums, counts


def _block(ids: pa.Array, vec: np.ndarray, at: Bounds, search: Search) -> pa.RecordBatch:
    assign(vec, at, search)
    sums, counts = _totals(vec, at.near, len(search.centroids))
    whole = lambda a: pa.array([a.tobytes()], pa.binary())
    as_list = lambda a, of: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a if of is None else pa.array(a, of))
    return pa.RecordBatch.from_arrays(
        [as_list(ids, None), whole(vec), whole(at.near), whole(at.second), whole(at.upper), whole(at.lower),
         as_list(sums.reshape(-1), pa.int64()), as_list(counts, pa.int64())],
        names=["ids", "vec", "near", "second", "upper", "lower", "sums", "counts"])


def _first_round(batches: Iterator[pa.RecordBatch], dim: int, scale: int, search: Search) -> Iterator[pa.RecordBatch]:
    """Pack ``vec_id, vec`` rows into blocks and assign them."""
    for b in batches:
        for lo in range(0, b.num_rows, BLOCK):
            part = b.slice(lo, BLOCK)
            vec = _integers(part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), scale).astype(np.int32)
            yield _block(part.column("vec_id"), vec, Bounds.unknown(len(vec), len(search.centroids)), search)


def _rows(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, np.ndarray, Bounds]]:
    for b in batches:
        for i in range(b.num_rows):
            row = {n: b.column(n)[i].as_py() for n in ("vec", "near", "second", "upper", "lower")}
            yield b.column("ids")[i].values, np.frombuffer(row["vec"], np.int32).reshape(-1, dim), Bounds.unpack(row)


def _next_round(batches: Iterator[pa.RecordBatch], dim: int, search: Search) -> Iterator[pa.RecordBatch]:
    for ids, vec, at in _rows(batches, dim):
        at.follow(search.move)
        yield _block(ids, vec, at, search)


def _last_round(batches: Iterator[pa.RecordBatch], dim: int, search: Search) -> Iterator[pa.RecordBatch]:
    for ids, vec, at in _rows(batches, dim):
        at.follow(search.move)
        assign(vec, at, search)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(at.near, pa.int32()), pa.array(_squared(vec, search.centroids[at.near]), pa.int64())],
            names=["vec_id", "cluster", "distance"])


def usable(rows: DataFrame, dim: int = DIM) -> DataFrame:
    """The rows whose ``vec`` (array of double) has ``dim`` finite components."""
    return rows.where((F.size("vec") == dim) & F.forall(
        "vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))


def seeds(rows: DataFrame, clusters: int, seed: int, scale: int) -> np.ndarray:
    """Vectors with the smallest sha256 of ``seed:vec_id``, in that order."""
    named = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("name"), "vec")
    first = named.orderBy(F.col("name").asc_nulls_last(), "vec").limit(clusters).collect()
    return _integers(np.array([r["vec"] for r in first], dtype=float), scale)


def _updated(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floor of the mean of each centroid's vectors; empty ones stay. One row per component reaches the driver."""
    k, dim = centroids.shape
    both = F.concat("sums", "counts")
    total = blocks.select(F.posexplode(both).alias("at", "x")).groupBy("at").agg(
        F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    sums = {r["at"]: int(r["x"]) for r in total}
    return np.array([[sums[i * dim + j] // n if (n := sums[k * dim + i]) else int(centroids[i, j]) for j in range(dim)]
                     for i in range(k)], dtype=np.int64)


def cluster(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM,
            scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(``vec_id, cluster, distance`` of the usable rows of ``rows(vec_id, vec)``, final centroids)."""
    spark = rows.sparkSession
    ship_package(spark)
    kept = usable(rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("vec").cast("array<double>").alias("vec")), dim)
    centroids = seeds(kept, clusters, seed, scale)
    if not len(centroids):
        return spark.createDataFrame([], _FINAL), centroids
    search = Search.of(centroids, None)
    blocks, path = staged_at(kept.mapInArrow(lambda it: _first_round(it, dim, scale, search), _BLOCKS), "centroid-blocks")
    for turn in range(rounds):
        moved = _updated(blocks, centroids)
        search = Search.of(moved, centroids)
        still, centroids = bool((moved == centroids).all()), moved
        if turn == rounds - 1 or still:
            break
        after, next_path = staged_at(blocks.mapInArrow(lambda it, s=search: _next_round(it, dim, s), _BLOCKS), "centroid-blocks")
        discard(spark, path)
        blocks, path = after, next_path
    out, _ = staged_at(blocks.mapInArrow(lambda it: _last_round(it, dim, search), _FINAL), "centroid-result")
    discard(spark, path)
    return out, centroids


def cluster_table(embeddings: DataFrame, **params) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` per usable vector."""
    spark = embeddings.sparkSession
    placed, centroids = cluster(embeddings.select("vec_id", F.col("embedding").alias("vec")), **params)
    per = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}      # one row per cluster
    named = spark.createDataFrame(
        [(i, n, sum(per.values()), hashlib.sha256(",".join(map(str, centroids[i].tolist())).encode()).hexdigest())
         for i, n in per.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return placed.join(F.broadcast(named), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _cluster_sql() -> str:
    """Plain rounds over one row per component; every vector meets every centroid."""
    def round_(i: int) -> str:
        return f"""
d{i} AS MATERIALIZED (
  SELECT v.rid, c.cl, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{i} c ON v.j = c.j GROUP BY v.rid, c.cl),
a{i} AS MATERIALIZED (
  SELECT rid, cl, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, cl) = 1)"""

    def update(i: int) -> str:
        return f"""
c{i + 1} AS MATERIALIZED (
  SELECT c.cl, c.j, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
    SELECT a.cl, v.j, (sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*) AS x
    FROM a{i} a JOIN v ON a.rid = v.rid GROUP BY a.cl, v.j) m ON c.cl = m.cl AND c.j = m.j)"""

    steps = ",".join(",".join((round_(i), update(i))) for i in range(ROUNDS))
    return f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS vec FROM embeddings
  WHERE len(embedding) = {DIM} AND list_count(embedding) = {DIM}
    AND len(list_filter(embedding, lambda x: isfinite(x))) = {DIM}),
v AS MATERIALIZED (
  SELECT rid, j, CAST(floor({SCALE} * vec[j]) AS HUGEINT) AS x FROM e, range(1, {DIM + 1}) r(j)),
s AS (SELECT rid, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS cl FROM e
      QUALIFY row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) <= {CLUSTERS}),
c0 AS MATERIALIZED (SELECT s.cl, v.j, v.x FROM s JOIN v ON s.rid = v.rid),
{steps},
{round_(ROUNDS)},
names AS (SELECT cl, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS h FROM c{ROUNDS} GROUP BY cl)
SELECT e.vec_id, CAST(a.cl AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
       CAST(sum(a.d) OVER (PARTITION BY a.cl) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, n.h AS centroid_sha256
FROM a{ROUNDS} a JOIN e ON a.rid = e.rid JOIN names n ON a.cl = n.cl
"""


CLUSTER_SQL = _cluster_sql()
