"""Embedding near-duplicates by product quantisation and exact cosine rerank.

1. Rows are packed: the vector's bytes, its validity and a 128-bit key of its value. Equal vectors
   collapse to one, with their number, so a vector that a third of all rows share is one from here on.
2. An index is fitted on at most ``SAMPLE`` vectors chosen by key (a bound of bytes holds too): coarse
   centroids of unit vectors, and a small codebook per subspace for the residuals.
3. Every vector is put in its nearest list with its residual code and the exact error of that code, and
   asks the lists nearest to it. The number of probes is measured, not guessed: neighbours at exactly
   the threshold are drawn around sample vectors in random directions, and the smallest number that
   brings ``RECALL`` of these pairs together (from either side) is taken.
4. Queries meet the list's members. The asymmetric distance is a sum of table lookups; the true distance is
   at least that sum's root less the code's error, so a member is dropped only if it cannot be a link: this filter
   loses nothing. Survivors are compared by cosine in double precision.
   A pair that could be met twice is counted where the smaller key asks, so no pair is ever written:
   a unit of work returns, per vector, its number of links and the smallest key of its group in the unit.
   Lists beyond ``TILE`` members or queries are cut into tiles, and each pair of tiles is a unit.
5. Connected components over those few edges. Names begin with the smallest vec_id of equal vectors and sort by
   it, so a group's least name gives its component_id and nothing is gathered by group.

Lists are missed only by the probes, so recall is that of the probes; the tests measure it against brute force.

Defined cases: a null or zero vector, or one with a null or non-finite component, links with nothing, not
even with its copies; vectors of different lengths do not link; rows with equal ids are separate rows; a null id
names a group only if it has no other, and such a row is kept if its group has no id; an empty table
gives an empty table. Vectors may be of any magnitude.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakscreen.llm.common import discard, map_arrow, staged_at
from peakscreen.llm.components import connected_components

COSINE = 0.9
#: Share of pairs at the threshold that the probes have to bring together.
RECALL = 0.995
#: Vectors that the index is fitted on, and their bytes.
SAMPLE, SAMPLE_BYTES = 1 << 15, 32 << 20
MAX_LISTS = 2048
#: Probes at least: a small sample says little about the depth.
LEAST_PROBES = 8
#: Dimensions of a subspace and entries of its codebook.
SUBSPACE, ENTRIES = 4, 16
TILE = 1024
#: Pairs held at a time while a unit is searched.
_PAIRS = 1 << 16
#: Slack of single-precision distances.
_SLACK = 1e-4


def _scaled(vec: np.ndarray) -> np.ndarray:
    """Rows by a power of two so that squares neither overflow nor vanish; cosines stay the same."""
    top = np.abs(vec).max(axis=1, initial=0.0)
    return np.ldexp(vec, -np.frexp(top)[1][:, None])


def _units(vec: np.ndarray) -> np.ndarray:
    return vec / np.sqrt(np.einsum("ij,ij->i", vec, vec))[:, None]


def packed(embeddings: DataFrame) -> DataFrame:
    """``vec_id, key, size, vec``: the vector in double precision; key and vec are null unless it can link."""
    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        col = b.column("vec")
        offsets = col.offsets.to_numpy()
        flat = col.values.to_numpy(zero_copy_only=False).astype(np.float64)      # nulls become NaN
        sizes = np.diff(offsets)
        keys: list[bytes | None] = [None] * b.num_rows
        vecs: list[bytes | None] = [None] * b.num_rows
        there = ~col.is_null().to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(there & (sizes > 0)).tolist():
            v = flat[offsets[i]:offsets[i + 1]]
            if np.isfinite(v).all() and v.any():
                vecs[i] = (_scaled(v[None])[0] + 0.0).tobytes()
                keys[i] = xxhash.xxh3_128_digest((v + 0.0).tobytes())
        return pa.RecordBatch.from_arrays(
            [b.column("vec_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(vecs, pa.binary())],
            names=["vec_id", "key", "size", "vec"])

    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    return map_arrow(rows, batch, "vec_id bigint, key binary, size int, vec binary")


@dataclass
class Index:
    """Coarse centroids, residual codebooks and the number of probes: all bounded by parameters."""
    dim: int
    lists: np.ndarray            # (n, dim) float32
    books: np.ndarray            # (subspaces, entries, SUBSPACE) float32
    probes: int
    reach: float                 # the largest distance of unit vectors that are linked

    def nearest_lists(self, unit: np.ndarray) -> np.ndarray:
        """The ``probes`` nearest lists of each vector, nearest first."""
        gap = (self.lists ** 2).sum(axis=1) - 2 * unit @ self.lists.T
        if self.probes < len(self.lists):
            some = np.argpartition(gap, self.probes - 1, axis=1)[:, :self.probes]
        else:
            some = np.broadcast_to(np.arange(len(self.lists)), gap.shape)
        return np.take_along_axis(some, np.argsort(np.take_along_axis(gap, some, 1), axis=1, kind="stable"), 1).astype(np.int32)

    def _split(self, x: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(x), self.books.shape[0] * SUBSPACE), np.float32)
        wide[:, :x.shape[1]] = x
        return wide.reshape(len(x), -1, SUBSPACE)

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals and the distance of each residual from its code."""
        tables = self.tables(residual)
        codes = tables.argmin(axis=2)
        return codes.astype(np.uint8), np.sqrt(np.take_along_axis(tables, codes[:, :, None], 2).sum(axis=(1, 2)))

    def tables(self, residual: np.ndarray) -> np.ndarray:
        """Squared distance of every part of a residual from every entry of its codebook."""
        parts = self._split(residual)
        cross = np.einsum("nms,mks->nmk", parts, self.books)
        return np.maximum((parts ** 2).sum(axis=2)[:, :, None] + (self.books ** 2).sum(axis=2)[None] - 2 * cross, 0)


def _centres(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        near = ((c ** 2).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        by = np.argsort(near, kind="stable")
        used = np.flatnonzero(n)
        c[used] = np.add.reduceat(x[by], (np.cumsum(n) - n)[used], axis=0) / n[used, None]
    return c


def fit_index(sample: np.ndarray, n_rows: int, cosine: float = COSINE, recall: float = RECALL) -> Index:
    """Lists, codebooks and probes from a sample of unit vectors (in a fixed order)."""
    rng = np.random.default_rng(1)
    dim = sample.shape[1]
    sample = sample.astype(np.float32)
    lists = _centres(sample, max(1, min(MAX_LISTS, int(4 * n_rows ** 0.5))), 6, rng)
    index = Index(dim, lists, np.zeros((-(-dim // SUBSPACE), 1, SUBSPACE), np.float32), 1, (2 - 2 * cosine) ** 0.5)
    residual = sample - lists[index.nearest_lists(sample)[:, 0]]
    parts = index._split(residual)
    entries = min(ENTRIES, len(sample))
    index.books = np.stack([_centres(parts[:, m], entries, 8, rng) for m in range(parts.shape[1])])

    # Pairs exactly at the threshold: how deep does either side have to look for the other's list?
    x = sample[:4096]
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    norm = np.sqrt((away ** 2).sum(axis=1, keepdims=True))
    y = (cosine * x + (1 - cosine ** 2) ** 0.5 * away / np.where(norm > 0, norm, 1)).astype(np.float32)
    gap = lambda v: (lists ** 2).sum(axis=1) - 2 * v @ lists.T
    gx, gy = gap(x), gap(y)
    own_x, own_y = gx.argmin(axis=1)[:, None], gy.argmin(axis=1)[:, None]
    depth = np.minimum((gx < np.take_along_axis(gx, own_y, 1)).sum(axis=1), (gy < np.take_along_axis(gy, own_x, 1)).sum(axis=1))
    deep = int(np.sort(depth)[min(len(depth) - 1, int(np.ceil(recall * len(depth))))]) + 1
    index.probes = min(len(lists), max(LEAST_PROBES, deep))
    return index


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float64).reshape(-1, dim)


def _indexed(distinct: DataFrame, index: Index) -> DataFrame:
    """Append ``list, code, error, probes`` to the vectors."""
    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        unit = _units(_matrix(b.column("vec"), index.dim)).astype(np.float32)
        lists = np.concatenate([index.nearest_lists(unit[lo:lo + 1024]) for lo in range(0, len(unit), 1024)])
        codes, error = index.encode(unit - index.lists[lists[:, 0]])
        width = lists.shape[1]
        probes = pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1, dtype=np.int32) * width), pa.array(lists.reshape(-1)))
        return pa.RecordBatch.from_arrays(
            [b.column("key"), b.column("n"), b.column("vec"), pa.array(lists[:, 0]),
             pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error.astype(np.float64)), probes],
            names=["key", "n", "vec", "list", "code", "error", "probes"])

    return map_arrow(distinct.select("key", "n", "vec"), batch,
                     "key binary, n bigint, vec binary, list int, code binary, error double, probes array<int>")


class _Groups:
    """Groups of a unit's vectors, joined block by block."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.up[a], self.up[b]
            apart = a != b
            if not apart.any():
                return
            a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(self.up, b, a)
            while not np.array_equal(up := self.up[self.up], self.up):
                self.up = up


def _search(members: dict, queries: dict, index: Index, which: int, cosine: float) -> pa.RecordBatch | None:
    """Links between the queries and members of one unit: ``key, links, root`` per linked vector."""
    unit_q, unit_m = _units(queries["vec"]), _units(members["vec"])
    norm_q, norm_m = (np.sqrt(np.einsum("ij,ij->i", v, v)) for v in (queries["vec"], members["vec"]))
    both, place = np.unique(np.array([*queries["key"], *members["key"]], dtype="S25"), return_inverse=True)
    at_q, at_m = place[:len(unit_q)], place[len(unit_q):]
    names: dict[int, bytes] = dict(zip(place.tolist(), [*queries["key"], *members["key"]]))
    links, groups = np.zeros(len(both), np.int64), _Groups(len(both))
    limit = (index.reach + members["error"] + _SLACK) ** 2
    subspaces = np.arange(index.books.shape[0])
    found = False
    rows = max(1, _PAIRS // max(1, len(unit_m)))
    asked = [set(p) for p in members["probes"]]
    for lo in range(0, len(unit_q), rows):
        part = slice(lo, lo + rows)
        tables = index.tables((unit_q[part] - index.lists[which]).astype(np.float32))
        gap = np.zeros((len(tables), len(unit_m)), np.float32)
        for m in subspaces:
            gap += tables[:, m][:, members["code"][:, m]]
        q, r = np.nonzero(gap <= limit)
        q = q + lo
        # Where both sides ask, the smaller key counts the pair.
        own = queries["list"][q]
        twice = np.fromiter((a in asked[b] for a, b in zip(own.tolist(), r.tolist())), bool, len(q))
        mine = (at_q[q] != at_m[r]) & (~twice | (at_q[q] < at_m[r]))
        q, r = q[mine], r[mine]
        close = np.einsum("ij,ij->i", queries["vec"][q], members["vec"][r]) / (norm_q[q] * norm_m[r]) >= cosine
        q, r = q[close], r[close]
        if len(q):
            found = True
            np.add.at(links, at_q[q], members["n"][r])
            np.add.at(links, at_m[r], queries["n"][q])
            groups.join(at_q[q], at_m[r])
    if not found:
        return None
    some = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays(
        [pa.array([names[i] for i in some.tolist()], pa.binary()), pa.array(links[some]),
         pa.array([names[i] for i in groups.up[some].tolist()], pa.binary())], names=["key", "links", "root"])


def _units_of(batches: Iterator[pa.RecordBatch], index: Index, cosine: float) -> Iterator[pa.RecordBatch]:
    """Search every run of equal ``list, a, b`` in sorted batches: members (tile a) and queries (tile b)."""
    held: list[tuple] = []
    now = None

    def side(rows):
        key, n, vec, own, code, error, probes = zip(*rows)
        return {"key": key, "n": np.array(n), "vec": np.frombuffer(b"".join(vec)).reshape(-1, index.dim), "list": np.array(own),
                "code": np.frombuffer(b"".join(code), np.uint8).reshape(len(rows), -1), "error": np.array(error, np.float32),
                "probes": probes}

    def close():
        members, queries = ([r[1:] for r in held if r[0] == asks] for asks in (False, True))
        if members and queries:
            out = _search(side(members), side(queries), index, now[0], cosine)
            if out is not None:
                yield out

    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("at", "a", "b", "asks", "key", "n", "vec", "list", "code", "error", "probes")]
        for row in zip(*cols):
            if row[:3] != now:
                yield from close()
                held, now = [], row[:3]
            held.append(row[3:])
    yield from close()


def _links(indexed: DataFrame, index: Index, cosine: float, tile: int) -> DataFrame:
    """``key, links, root`` per unit of work and linked vector."""
    body = ["key", "n", "vec", "list", "code", "error", "probes"]
    # At most ``MAX_LISTS`` rows.
    asked = indexed.select(F.explode("probes").alias("at")).groupBy("at").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("b_tiles"))
    held = indexed.groupBy(F.col("list").alias("at")).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("a_tiles"))
    sizes = F.broadcast(held.join(asked, "at"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    members = indexed.select(F.col("list").alias("at"), F.lit(False).alias("asks"), *body).join(sizes, "at") \
        .withColumn("a", own("a_tiles")).withColumn("b", spread("b_tiles"))
    queries = indexed.select(F.explode("probes").alias("at"), F.lit(True).alias("asks"), *body).join(sizes, "at") \
        .withColumn("b", own("b_tiles")).withColumn("a", spread("a_tiles"))
    cols = ["at", "a", "b", "asks", *body]
    units = members.select(*cols).union(queries.select(*cols)).repartition("at", "a", "b").sortWithinPartitions("at", "a", "b")
    return units.mapInArrow(lambda it: _units_of(it, index, cosine), "key binary, links bigint, root binary")


_SIGN = -(1 << 63)


def _name(low: str, key: str) -> Column:
    """Bytes that sort by smallest vec_id (null last), then key: the least name of a group holds its component_id."""
    digits = F.lpad(F.hex(F.coalesce(F.col(low), F.lit(-1)).bitwiseXOR(F.lit(_SIGN))), 16, "0")
    return F.concat(F.unhex(F.concat(F.when(F.col(low).isNull(), "01").otherwise("00"), digits)), F.col(key))


def _named_id(name: Column) -> Column:
    low = F.conv(F.hex(F.substring(name, 2, 8)), 16, -10).cast("bigint").bitwiseXOR(F.lit(_SIGN))
    return F.when(F.hex(F.substring(name, 1, 1)) == "00", low)


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``embeddings(vec_id, embedding)``."""
    spark = embeddings.sparkSession
    rows, _ = staged_at(packed(embeddings), "vectors")
    counted = rows.where("key IS NOT NULL").groupBy("key").agg(
        F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("vec").alias("vec"))
    distinct, distinct_path = staged_at(counted.select(F.col("key").alias("value"), _name("low", "key").alias("key"), "n", "size", "vec"),
                                        "vectors-distinct")
    found = None
    paths = [distinct_path]
    # One index for each length that occurs; a table of embeddings has one or a few.
    for size, count in sorted((r["size"], r["count"]) for r in distinct.groupBy("size").count().collect()):
        own = distinct.where(F.col("size") == size)
        bound = max(256, min(SAMPLE, SAMPLE_BYTES // (8 * size)))
        share = F.pmod(F.xxhash64("value"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, bound / count))
        chosen = own.where(share).select("value", "vec").limit(2 * bound).collect()
        chosen = sorted(chosen, key=lambda r: bytes(r["value"])) or own.select("vec").limit(1).collect()
        sample = _units(np.frombuffer(b"".join(bytes(r["vec"]) for r in chosen)).reshape(-1, size))
        index = fit_index(sample, count, cosine, recall)
        indexed, path = staged_at(_indexed(own, index), "vectors-indexed")
        part, part_path = staged_at(_links(indexed, index, cosine, tile), "vector-links")
        discard(spark, path)
        paths.append(part_path)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    groups = connected_components(found.select(F.col("key").alias("u"), F.col("root").alias("v")))
    linked = found.groupBy("key").agg(F.sum("links").alias("links"))
    placed = distinct.join(linked, "key", "left").join(groups.withColumnRenamed("node", "key"), "key", "left")
    by_key, _ = staged_at(placed.select(
        F.col("value").alias("key"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        _named_id(F.coalesce("component", "key")).alias("component_id")), "vector-groups")
    discard(spark, *paths)
    out = rows.select("vec_id", "key").join(by_key, "key", "left")
    group = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), group.alias("component_id"),
                      F.col("vec_id").eqNullSafe(group).alias("kept"))


def dedup_table(embeddings: DataFrame) -> DataFrame:
    return near_duplicates(embeddings.select("vec_id", "embedding"))


NEAR_SQL = f"""
WITH RECURSIVE e AS MATERIALIZED (
  SELECT vec_id, embedding::DOUBLE[] AS v,
         embedding IS NOT NULL AND list_count(embedding) = len(embedding)
           AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
u AS MATERIALIZED (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm, len(v) AS size FROM e WHERE ok),
p AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.size = b.size
      WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= {COSINE}),
reach AS (SELECT x, y FROM p UNION SELECT r.x, p.y FROM reach r JOIN p ON r.y = p.x),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n FROM p GROUP BY x)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(low.y, e.vec_id)) AS component_id,
       e.vec_id <= coalesce(low.y, e.vec_id) AS kept
FROM e LEFT JOIN n ON e.vec_id = n.x LEFT JOIN low ON e.vec_id = low.x
"""
