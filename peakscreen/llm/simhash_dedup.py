"""SimHash near-duplicate groups by bit-sliced comparison.

1. Every text gets a 64-bit fingerprint of its word shingles.
2. Equal fingerprints collapse (partial aggregation, so a huge group of copies is one row).
3. Fingerprints within the radius agree on at least ``blocks - radius`` of
   ``blocks`` bit blocks: each distinct fingerprint is dealt out once per choice
   of blocks, and the fingerprints of one key are compared bit-sliced
   (:mod:`peakscreen.llm.bitslice`), which emits star edges, never all pairs.
   A key with more than ``tile`` fingerprints is cut into tiles; each pair of
   tiles is one unit of work, so no task holds the whole key and no link is lost.
4. Connected components over fingerprints; a component is named by its smallest doc_id.

Defined cases: null, empty and wordless texts have fingerprint zero and link like
any other; fewer words than a shingle make one shingle of the whole sequence; rows
with equal ids or texts are separate rows with the same result; null ids never
name a component unless it has no other; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakscreen.llm import bitslice
from peakscreen.llm.common import LOWER_BYTES, boxed, map_arrow, staged, unboxed
from peakscreen.llm.components import connected_components
from peakscreen.session import ship_package

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Bit blocks of the pigeonhole choice. More blocks make longer keys (64 * (blocks - radius) /
#: blocks bits) and more copies; results are the same for any value above the radius.
BLOCKS = 6
TILE = 1 << 14
#: Shingle hashes counted at a time.
_CHUNK = 1 << 16


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    if not words:
        return 0
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(joined)]
    if len(words) > shingle:
        starts, ends = starts[:len(words) - shingle + 1], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(starts), _CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in
                           zip(starts[lo:lo + _CHUNK], ends[lo:lo + _CHUNK])], dtype=np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(counts * 2 > len(starts), bitorder="little")
    return int(majority.view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, text_hash, fp`` per row."""
    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = [simhash(t.as_py(), shingle) for t in b.column("text")]
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("text_hash"), pa.array(fps, pa.int64())],
            names=["doc_id", "text_hash", "fp"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, batch, f"doc_id {id_type}, text_hash bigint, fp bigint")


def _masks(radius: int, blocks: int) -> list[int]:
    """Signed 64-bit masks of every choice of ``blocks - radius`` bit blocks."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    out = []
    for chosen in combinations(range(blocks), blocks - radius):
        m = sum(((1 << cuts[i + 1]) - (1 << cuts[i])) for i in chosen)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def _link_sorted(batches: Iterator[pa.RecordBatch], radius: int, tile: int, key: list[str],
                 whole: bool = False) -> Iterator[pa.RecordBatch]:
    """Star edges of the runs of equal keys in batches sorted by key.

    Output rows ``u, v, key, tile``: edges have tile -1; the members of a run of ``tile`` rows
    or more, which is cut into tiles of exactly ``tile`` and a rest, pass through with their tile
    number. With ``whole``, a run longer than ``tile`` is an error.
    """
    small: list[np.ndarray] = []     # runs of 2 to 64, end to end
    small_sizes: list[np.ndarray] = []
    held: list[np.ndarray] = []      # of the open run, below one tile
    open_key, tile_no = None, 0

    def rows(u, v, k=None, t=-1):
        n = len(u)
        return pa.RecordBatch.from_arrays(
            [pa.array(u.view(np.int64)), pa.array(v.view(np.int64)),
             pa.array(np.full(n, k[0] if k else 0, dtype=np.int64)), pa.array(np.full(n, t, dtype=np.int32))],
            names=["u", "v", "key", "tile"])

    def edges(fps, a, b):
        return rows(fps[a], fps[b])

    def flush():
        fps, sizes = np.concatenate(small), np.concatenate(small_sizes)
        starts = np.cumsum(sizes) - sizes
        small.clear(), small_sizes.clear()
        return edges(fps, *bitslice.link_small(fps, starts, radius))

    def close(last: bool):
        """Handle the open run's rest; ``last`` says whether the run ends here."""
        nonlocal tile_no
        fps = np.concatenate(held) if held else np.zeros(0, dtype=np.uint64)
        held.clear()
        if len(fps) > 64 or tile_no or not last:
            if len(fps) > 1:
                yield edges(fps, *bitslice.link_large(fps, radius))
            if (tile_no or not last) and len(fps):
                yield rows(fps, fps, open_key, tile_no)
                tile_no += 1
        elif len(fps) > 1:
            small.append(fps)
            small_sizes.append(np.array([len(fps)]))

    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy() for k in key]
        fps = b.column("fp").to_numpy().view(np.uint64)
        change = np.zeros(len(fps), dtype=bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        firsts = np.flatnonzero(change)
        sizes = np.diff(np.append(firsts, len(fps)))
        # Runs inside the batch are whole: those of up to 64 are set aside together, single rows dropped.
        inner = np.ones(len(firsts), dtype=bool)
        inner[[0, -1]] = False
        together = inner & (sizes > 1) & (sizes <= 64)
        if together.any():
            small.append(fps[np.repeat(together, sizes)])
            small_sizes.append(sizes[together])
        for r in np.flatnonzero(~inner | (sizes > 64)).tolist():
            lo, hi = int(firsts[r]), int(firsts[r] + sizes[r])
            k = tuple(int(c[lo]) for c in cols)
            if k != open_key:
                if open_key is not None:
                    yield from close(True)
                open_key, tile_no = k, 0
            while lo < hi:
                # However the batches fall, no tile exceeds ``tile``.
                room = tile - sum(map(len, held))
                if whole and hi - lo > room:
                    raise ValueError(f"a run of more than {tile} fingerprints has to stay whole")
                held.append(fps[lo:min(hi, lo + room)])
                lo += room
                if not whole and lo <= hi:
                    yield from close(False)
        if sum(map(len, small)) >= 1 << 16:
            yield flush()
    if open_key is not None:
        yield from close(True)
    if small:
        yield flush()


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """Edges ``u, v`` that connect distinct fingerprints (column ``fp``) as all links within
    ``radius`` bits do."""
    if not 0 < radius < blocks:
        raise ValueError("0 < radius < blocks is needed")
    ship_package(fps.sparkSession)
    # One long names choice and bits: it sorts by itself (rows of a key need no order among
    # themselves), and keys that share a number only put strangers into one run.
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(_masks(radius, blocks))])
    dealt = fps.select("fp", F.explode(keys).alias("key")).repartition("key").sortWithinPartitions("key")
    out = "u bigint, v bigint, key bigint, tile int"
    found = staged(dealt.mapInArrow(
        lambda it: _link_sorted(it, radius, tile, ["key"]), out), "simhash-links")
    near = found.where("tile < 0").select("u", "v")

    # Keys beyond one tile: every pair of tiles meets once, apart from the other pairs.
    cut = found.where("tile >= 0").select("key", "tile", F.col("u").alias("fp"))
    n_tiles = cut.groupBy("key").agg((F.max("tile") + 1).alias("tiles"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    paired = (cut.join(n_tiles, "key").where("tiles > 1")
              .select("key", "tile", "fp", other).where("other != tile")
              .select("key", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "fp")
              .repartition("key", "a", "b")
              .sortWithinPartitions("key", "a", "b"))
    pair_key = ["key", "a", "b"]
    met = paired.mapInArrow(lambda it: _link_sorted(it, radius, 2 * tile, pair_key, whole=True), out)
    return near.union(met.select("u", "v"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
                    blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """``doc_id, text_hash, fp, component_id, component`` per row of ``docs``.

    ``component`` is a fingerprint naming the group, ``component_id`` its smallest doc_id.
    """
    rows = staged(fingerprints(docs, shingle), "simhash")
    nodes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    comp = connected_components(links(nodes.select("fp"), radius, blocks, tile))
    placed = nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("component"))
    named = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    by_fp = staged(placed.select("fp", "component").join(named, "component"), "simhash-components")
    return rows.join(by_fp, "fp")


def dedup_table(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """One row of each near-duplicate group, same columns: the row with the smallest doc_id
    (nulls last; rows with equal ids: the smallest text hash; equal texts too: any one)."""
    groups = near_duplicates(docs, **params)
    best = groups.groupBy("component").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("k"))
    keep = staged(best.select(F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_th")),
                  "simhash-kept")
    marked = boxed(docs, id=F.col("doc_id"), text_hash=F.xxhash64("text"))
    kept = marked.join(keep, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_th")), "left_semi")
    return unboxed(kept.dropDuplicates(["id", "text_hash"]))
