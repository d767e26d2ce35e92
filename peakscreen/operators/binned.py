"""Binned rows in blocks: what a boosted fit and the trials of a search learn from, whatever the size of the table.

1. Bin edges are exact order statistics of all rows: counts per feature and value, added up along the values.
2. Rows sorted by id travel as blocks, one binary value each: a byte per feature, label and fold. Blocks of a table are
   numbered by where they begin in the order of ids, so a row's draws are the same in every partitioning.

Where a search has folds, each fold's training rows have edges of their own. A block holds the bins between all their edges
together, from which a fold's bins are looked up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakscreen.operators import trees as tr
from peakscreen.operators.prefix import running_total
from peakscreen.session import drop_tables, stage_table

#: Rows of a block, about, and rows whose values are counted at a time.
BLOCK_ROWS, COUNT_ROWS = 1 << 14, 1 << 16


def vector(features: Sequence[str]) -> Column:
    """The features as an array; a null feature counts as 0."""
    return F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in features])


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _matrix(t: pa.Table) -> np.ndarray:
    return t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)


def edges_without(rows: DataFrame, p: int, folds: Sequence[int], bins: int = tr.BINS) -> tuple[list[list[np.ndarray]], list[int]]:
    """Per fold the edges of each feature's quantile bins, and the number of rows, over all rows of the other folds.

    ``rows(x array<double>, fold int)``; for all rows name a fold that no row has.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _gathered(batches, COUNT_ROWS):
            x, fold = _matrix(t), t.column("fold").to_numpy()
            for k in np.unique(fold):
                own = x[fold == k]
                for f in range(p):
                    v, n = np.unique(own[:, f], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), f, np.int32)), pa.array(np.full(len(v), k, np.int32)), pa.array(v),
                                                      pa.array(n.astype(np.int64))], names=["f", "fold", "v", "n"])

    named = [f"n{i}" for i in range(len(folds))]
    counts, path = stage_table(rows.mapInArrow(count, "f int, fold int, v double, n bigint").groupBy("f", "v").agg(
        *[F.sum(F.when(F.col("fold") != k, F.col("n")).otherwise(0)).alias(c) for c, k in zip(named, folds)]), "values")
    whole = counts.where("f = 0").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in named]).first()
    # The places that numpy's inverted distribution function takes.
    at = [np.linspace(0, 1, bins + 1)[1:-1] * n - 1 for n in whole]
    at = [np.unique(np.maximum(np.floor(a) + (a > np.floor(a)), 0).astype(np.int64)).tolist() if n else [] for a, n in zip(at, whole)]
    upto = running_total(counts, named, ["v"], partition_by=["f"], out=[f"{c}_upto" for c in named])

    def within(c: str, places: list[int]) -> Column:
        return F.exists(F.lit(places).cast("array<bigint>"), lambda i: (i >= F.col(f"{c}_upto") - F.col(c)) & (i < F.col(f"{c}_upto")))

    holds = [within(c, places) for c, places in zip(named, at)]
    found = upto.select("f", "v", F.array(*holds).alias("holds")).where(F.exists("holds", lambda h: h)).collect()   # bins x features x folds at most
    edges = [[np.unique([r["v"] for r in found if r["f"] == f and r["holds"][i]]) for f in range(p)] for i in range(len(folds))]
    drop_tables(rows.sparkSession, path)
    return edges, [int(n) for n in whole]


def united(edges: Sequence[Sequence[np.ndarray]]) -> list[np.ndarray]:
    """Per feature the edges of all folds together."""
    return [np.unique(np.concatenate(one)) for one in zip(*edges)]


def lookup(edges: np.ndarray, among: np.ndarray) -> np.ndarray:
    """The bin between ``edges`` for each bin between the edges ``among`` that contain them."""
    return np.append(0, np.searchsorted(edges, among, "right")).astype(np.uint8)


@dataclass
class Block:
    """Rows that follow each other in the order of ids."""
    bins: np.ndarray                       # a line per feature
    y: np.ndarray
    fold: np.ndarray
    start: int = 0                         # rows before


def stage_blocks(rows: DataFrame, edges: list[np.ndarray], name: str) -> tuple[DataFrame, str, dict[tuple[int, int], int]]:
    """``rows(id, x array<double>, y double, fold int)`` as a staged table of blocks ``part, seq, rows, payload``, its path, and
    how many rows come before each block; null ids are last."""
    kind = np.uint8 if max(map(len, edges), default=0) < 256 else np.uint16

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for seq, t in enumerate(_gathered(batches, BLOCK_ROWS)):
            payload = b"".join([t.column("y").to_numpy().astype(np.float64).tobytes(), t.column("fold").to_numpy().astype(np.int16).tobytes(),
                                np.ascontiguousarray(tr.binned(_matrix(t), edges).T.astype(kind)).tobytes()])
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([t.num_rows], pa.int32()),
                                              pa.array([payload], pa.binary())], names=["part", "seq", "rows", "payload"])

    order = [F.asc_nulls_last("id"), F.asc("y"), F.asc("_h")]
    sorted_ = rows.select("id", "x", "y", "fold", F.xxhash64("x").alias("_h")).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks, path = stage_table(sorted_.select("x", "y", "fold").mapInArrow(pack, "part int, seq int, rows int, payload binary"), name)
    starts, before = {}, 0
    for r in blocks.select("part", "seq", "rows").orderBy("part", "seq").collect():     # a line per block
        starts[r["part"], r["seq"]] = before
        before += r["rows"]
    return blocks, path, starts


def read_blocks(batches: Iterator[pa.RecordBatch], p: int, starts: dict[tuple[int, int], int]) -> Iterator[Block]:
    for b in batches:
        for part, seq, n, payload in zip(*(b.column(c).to_pylist() for c in ("part", "seq", "rows", "payload"))):
            kind = np.uint8 if len(payload) == n * (10 + p) else np.uint16
            yield Block(np.frombuffer(payload, kind, n * p, 10 * n).reshape(p, n), np.frombuffer(payload, np.float64, n),
                        np.frombuffer(payload, np.int16, n, 8 * n), starts[part, seq])

