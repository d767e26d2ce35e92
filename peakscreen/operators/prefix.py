"""Distributed running totals (the plan shape behind W1, W2 and A7).

A running sum over a global order written as a plain window either collapses
into one partition (no ``partitionBy``) or puts a whole hot group into one task.
Here rows fall into blocks by the full order key (group, order columns, tie-breaker), so a hot group or a
hot timestamp is cut like any other key range:

1. the bounds of the blocks come from the ``SAMPLE`` keys of each block with the smallest hash, sorted: a
   sketch that depends on the data alone, fetched once by a scalar subquery;
2. a row's block is an expression of its key (a binary search in the bounds), so every scan, retry or
   recomputation finds the same block;
3. totals per (block, group) give the offset a block inherits from earlier blocks. Only the first group of
   each block can inherit anything, so at most one offset per block is kept, and broadcast;
4. a window per (block, group) adds the offset to the local running sum: the only shuffle of the rows.

Integer inputs give exact results; for doubles the block totals are added in a
different association than a sequential scan would use.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLK, BOUNDS = "_blk", "_bounds"
#: Sampled keys for each block, and blocks at most (so the sketch stays small).
SAMPLE, MAX_BLOCKS = 32, 1024


def descending(col: Column | str) -> list[Column]:
    """Ascending columns that sort as a numeric column does in descending order, nulls last."""
    c = F.col(col) if isinstance(col, str) else col
    x = c.cast("double")
    return [c.isNull(), ~F.coalesce(F.isnan(x), F.lit(False)), -c]


def key_block(df: DataFrame, keys: list[Column], n_blocks: int) -> tuple[Column, DataFrame | None]:
    """Number of the row's block: how many of the ``BOUNDS`` lie at or below its key; the one row that holds them."""
    key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    n = max(1, min(n_blocks, MAX_BLOCKS))
    if n == 1:
        return F.lit(0), None
    sample = df.select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(SAMPLE * n)
    bounds = sample.agg(F.sort_array(F.collect_list("k")).alias("s")).select(F.transform(
        F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.try_element_at("s", F.greatest(F.ceil(i * F.size("s") / n).cast("int"), F.lit(1)))).alias("b"))
    steps = F.array(*[F.lit(1 << i) for i in range((n - 1).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(
        (at + s <= n - 1) & (F.get(BOUNDS, at + s - 1) <= key), at + s).otherwise(at)), bounds


def running_total(df: DataFrame, values: Sequence[str], order: Sequence[Column | str],
                  partition_by: Sequence[str] = (), out: Sequence[str] | None = None,
                  n_blocks: int | None = None) -> DataFrame:
    """Append inclusive running sums of ``values`` in ascending ``order`` within ``partition_by``.

    ``order`` must make rows unique within a group (add a row id as the last
    key); for other directions pass columns such as :func:`descending`. Null values count as 0.
    ``df`` is scanned for the bounds, for the totals and for the result, so it has to be
    deterministic; persist it if it is costly. Everything stays in the JVM: every column keeps its exact type and value.
    """
    values = list(values)
    out = list(out or [f"{v}_cum" for v in values])
    parts = list(partition_by)
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    if n_blocks is None:
        n_blocks = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block, bounds = key_block(df, [F.col(p) for p in parts] + order_cols, n_blocks)
    placed = df if bounds is None else df.withColumn(BOUNDS, bounds.scalar())
    placed = placed.withColumn(_BLK, block).drop(BOUNDS)

    totals = placed.groupBy(_BLK, *parts).agg(
        *[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in values])
    w = (Window.partitionBy(*parts) if parts else Window.partitionBy()).orderBy(_BLK) \
        .rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select(
        F.col(_BLK).alias("_oblk"), *[F.col(p).alias(f"_okey{i}") for i, p in enumerate(parts)],
        F.count(F.lit(1)).over(w).alias("_earlier"),
        *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"_off_{v}") for v in values],
    ).where(F.col("_earlier") > 0).drop("_earlier")

    inside = Window.partitionBy(_BLK, *parts).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("*", *[F.sum(F.coalesce(F.col(v), F.lit(0))).over(inside).alias(f"_sum_{v}") for v in values])
    match = F.col(_BLK) == F.col("_oblk")
    for i, p in enumerate(parts):
        match = match & F.col(p).eqNullSafe(F.col(f"_okey{i}"))
    # At most one inheriting group per block: MAX_BLOCKS rows.
    joined = local.join(F.broadcast(offs), match, "left")
    return joined.select(*df.columns, *[(F.coalesce(F.col(f"_off_{v}"), F.lit(0)) + F.col(f"_sum_{v}")).alias(o)
                                        for v, o in zip(values, out)])
