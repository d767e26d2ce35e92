"""Reproducible class rebalancing and splitting (M1-M6).

Random draws of a single-machine library cannot be reproduced on a cluster, so
the contract is: exact sizes per class, determinism under a seed and
independence from partitioning. Rows are ordered by ``md5(id | seed)``.

Picking the first ``n`` rows of a class in that order is one comparison per row ("hash cut"): a
histogram of the first hex digits per class (at most 65,536 buckets each) tells which bucket holds the
cut; its rows are counted by the next digits until few are left, and the hash of the n-th row is the cut.
The output then filters its input once and ranks nothing.

Rows that share an id share their place in the order and fall on the same side of every cut. A
null label is a class of its own (the last one); a null id is the empty one; empty tables come back empty.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakscreen.operators.knn import TILE, knn_within
from peakscreen.operators.prefix import running_total

_H = "_h"
#: Classes at most: their sizes are collected and their cuts broadcast.
MAX_CLASSES = 10_000
#: Rows of a cut bucket that are ordered to find the cut, and digits by which a larger one is narrowed.
CUT_ROWS, DIGITS = 100_000, 4
#: Above and below every hash.
_ALL, _NONE = "g", ""


def hash_order(id_col: str, seed: int) -> Column:
    """md5 of ``id|seed``: the row's position in the seeded order."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f"|{seed}")))


def hash_draw(index: Column, salt: str, modulus: Column | int) -> Column:
    """Deterministic draw in [0, modulus) from an index: first 15 hex digits (60 bits) of md5 mod m."""
    h = F.conv(F.substring(F.md5(F.concat(index.cast("string"), F.lit(f"|{salt}"))), 1, 15), 16, 10)
    m = modulus if isinstance(modulus, Column) else F.lit(modulus)
    return F.pmod(h.cast("long"), m.cast("long"))


def _class_order(c) -> tuple:
    return c is None, 0 if c is None else c


def _per_class(rows: DataFrame) -> list:
    """Rows of a table with one row per class, whose number is checked."""
    found = rows.limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    return found


def class_counts(df: DataFrame, cls: str) -> dict:
    """Rows per class."""
    return {r[0]: int(r[1]) for r in _per_class(df.groupBy(cls).count())}


def _narrow(hashed: DataFrame, hist: DataFrame, need: dict, cls: str, digits: int) -> dict:
    """Per class that has a cut: (prefix of ``digits`` hex digits that holds it, rows before, rows inside)."""
    spark = hashed.sparkSession
    w = Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    wanted = spark.createDataFrame([(c, n) for c, n in need.items()], hashed.select(F.col("c")).schema.add("need", "long"))
    cut = (hist.withColumn("upto", F.sum("n").over(w)).alias("h").join(F.broadcast(wanted.alias("w")), F.expr("h.c <=> w.c"))
           .where("upto >= need").groupBy("h.c").agg(F.min_by(F.struct("p", "upto", "n"), "p").alias("x")))
    return {r[0]: (r["x"]["p"], r["x"]["upto"] - r["x"]["n"], r["x"]["n"]) for r in _per_class(cut)}


def hash_cuts(df: DataFrame, cls: str, id_col: str, seed: int, need) -> dict:
    """Per class, the hash up to which its first ``need(class sizes)[class]`` rows reach."""
    spark = df.sparkSession
    hashed = df.select(F.col(f"`{cls}`").alias("c"), hash_order(id_col, seed).alias("h"))
    hist = hashed.groupBy("c", F.substring("h", 1, DIGITS).alias("p")).agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        counts = {r[0]: int(r[1]) for r in _per_class(hist.groupBy("c").agg(F.sum("n")))}
        wanted = need(counts)
        cuts = {c: _ALL if wanted.get(c, 0) >= n else _NONE for c, n in counts.items()}
        left = {c: int(wanted[c]) for c, n in counts.items() if 0 < wanted.get(c, 0) < n}
        at = _narrow(hashed, hist, left, cls, DIGITS) if left else {}
    finally:
        hist.unpersist()
    digits = DIGITS
    while left:
        left = {c: left[c] - before for c, (_, before, _) in at.items()}
        table = spark.createDataFrame([(c, p, left[c]) for c, (p, _, _) in at.items()],
                                      hashed.select("c").schema.add("prefix", "string").add("need", "long"))
        inside = hashed.alias("r").join(F.broadcast(table.alias("t")), F.expr("r.c <=> t.c AND startswith(r.h, t.prefix)")) \
            .select("r.c", "r.h", "t.need")
        if max(n for _, _, n in at.values()) <= CUT_ROWS or digits >= 32:
            # Equal hashes count together, so a repeated id is one row here.
            each = inside.groupBy("c", "need", "h").agg(F.count(F.lit(1)).alias("n"))
            w = Window.partitionBy("c").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
            found = each.withColumn("upto", F.sum("n").over(w)).where("upto >= need").groupBy("c").agg(F.min("h").alias("h"))
            return cuts | {r["c"]: r["h"] for r in _per_class(found)}
        digits += DIGITS
        hist = inside.groupBy("c", F.substring("h", 1, digits).alias("p")).agg(F.count(F.lit(1)).alias("n"))
        at = _narrow(hashed, hist, left, cls, digits)
    return cuts


def _mark(df: DataFrame, cls: str, id_col: str, seed: int, need, flag: str) -> DataFrame:
    """Append ``flag``: whether the row lies within its class's cut."""
    cuts = hash_cuts(df, cls, id_col, seed, need)
    table = df.sparkSession.createDataFrame(list(cuts.items()), df.select(F.col(f"`{cls}`").alias("_cut_class")).schema.add("_cut", "string"))
    joined = df.join(F.broadcast(table), F.col(f"`{cls}`").eqNullSafe(F.col("_cut_class")), "left")     # MAX_CLASSES rows at most
    return joined.withColumn(flag, F.coalesce(hash_order(id_col, seed) <= F.col("_cut"), F.lit(False))).drop("_cut_class", "_cut")


def mark_first_n(df: DataFrame, cls: str, id_col: str, need: dict, seed: int, flag: str = "_selected") -> DataFrame:
    """Flag the first ``need[c]`` rows of each class ``c`` in seeded hash order.

    Classes absent from ``need`` get no rows; a need above the class size takes the whole class.
    """
    return _mark(df, cls, id_col, seed, lambda _: need, flag)


def allocate(counts: dict, n_total: int) -> dict:
    """Spread ``n_total`` over classes proportionally; leftovers by largest remainder (ties: class order)."""
    n = sum(counts.values())
    if n == 0:
        return {k: 0 for k in counts}
    base = {k: (n_total * v) // n for k, v in counts.items()}
    rem = {k: (n_total * v) % n for k, v in counts.items()}
    left = n_total - sum(base.values())
    for k in sorted(counts, key=lambda k: (-rem[k], _class_order(k)))[:left]:
        base[k] += 1
    return base


def _share(test_size: float):
    return lambda counts: allocate(counts, math.ceil(test_size * sum(counts.values())))


def _split(df: DataFrame, cls: str, id_col: str, test_size: float, seed: int, out: str) -> DataFrame:
    marked = _mark(df, cls, id_col, seed, _share(test_size), "_selected")
    return marked.withColumn(out, F.when(F.col("_selected"), "test").otherwise("train")).drop("_selected")


def stratified_split(df: DataFrame, label: str, id_col: str, test_size: float = 0.33,
                     seed: int = 42, out: str = "split") -> DataFrame:
    """Stratified train/test split (M1): ``ceil(test_size * N)`` test rows spread over classes."""
    return _split(df, label, id_col, test_size, seed, out)


def random_split(df: DataFrame, id_col: str, test_size: float = 0.33, seed: int = 42,
                 out: str = "split") -> DataFrame:
    """Unstratified split (M2): the first ``ceil(test_size * N)`` rows in hash order are test."""
    return _split(df.withColumn("_one", F.lit(1)), "_one", id_col, test_size, seed, out).drop("_one")


def under_sample(df: DataFrame, label: str, id_col: str, seed: int = 42) -> DataFrame:
    """Every class down to the minority size, without replacement (M3)."""
    smallest = lambda counts: dict.fromkeys(counts, min(counts.values(), default=0))
    return _mark(df, label, id_col, seed, smallest, "_selected").where(F.col("_selected")).drop("_selected")


def class_rank(df: DataFrame, label: str, id_col: str, seed: int = 42, out: str = "_rank",
               n_blocks: int | None = None) -> DataFrame:
    """1-based position of each row within its class in seeded hash order (distributed)."""
    staged = df.withColumn(_H, hash_order(id_col, seed)).withColumn("_one", F.lit(1))
    r = running_total(staged, ["_one"], [_H, id_col], partition_by=[label], out=[out],
                      n_blocks=n_blocks)
    return r.drop(_H, "_one")


def stratified_folds(df: DataFrame, label: str, id_col: str, k: int = 5, seed: int = 42,
                     out: str = "fold") -> DataFrame:
    """Stratified k folds (M6): fold = (rank in class - 1) mod k; sizes differ by at most 1."""
    r = class_rank(df, label, id_col, seed)
    return r.withColumn(out, F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank")


def _subset_of_rank(counts: dict, label: str, fractions: Sequence[float]) -> Column:
    """Smallest fraction index whose per-class prefix holds the row's ``_rank``."""
    idx = None
    for i, f in enumerate(sorted(fractions)):
        lim = None
        for c, n in counts.items():
            cond = F.col(label).eqNullSafe(F.lit(c)) & (F.col("_rank") <= F.lit(math.ceil(f * n)))
            lim = cond if lim is None else lim | cond
        lim = F.lit(False) if lim is None else lim
        idx = F.when(lim, F.lit(i)) if idx is None else idx.when(lim, F.lit(i))
    return idx.cast("int")


def nested_subsets(df: DataFrame, label: str, id_col: str, fractions: Sequence[float],
                   seed: int = 42, out: str = "subset") -> DataFrame:
    """Smallest fraction index whose per-class prefix contains the row (M6 learning-curve sizes)."""
    counts = class_counts(df, label)
    return class_rank(df, label, id_col, seed).withColumn(out, _subset_of_rank(counts, label, fractions)).drop("_rank")


def folds_with_subsets(df: DataFrame, label: str, id_col: str, k: int, fractions: Sequence[float], seed: int = 42,
                       fold: str = "fold", subset: str = "subset") -> DataFrame:
    """:func:`stratified_folds` and :func:`nested_subsets` of the same seed from one ranking."""
    counts = class_counts(df, label)
    r = class_rank(df, label, id_col, seed)
    return r.withColumn(fold, F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")) \
        .withColumn(subset, _subset_of_rank(counts, label, fractions)).drop("_rank")


def over_sample(df: DataFrame, label: str, id_col: str, seed: int = 42,
                copy_col: str = "copy_no") -> DataFrame:
    """Keep every row and add draws with replacement until each class has the majority size (M4).

    Draw ``j`` of class ``c`` picks the row of rank ``md5(j|c|seed) mod N_c + 1``.
    Original rows have ``copy_no = -1``; drawn rows carry their draw number.
    """
    spark = df.sparkSession
    counts = class_counts(df, label)
    n_max = max(counts.values(), default=0)
    ranked = class_rank(df, label, id_col, seed)
    draws = None
    for c, n in counts.items():
        extra = n_max - n
        if extra <= 0 or n == 0:
            continue
        d = spark.range(0, extra).select(
            F.lit(c).cast(df.schema[label].dataType).alias("_draw_class"),
            F.col("id").alias(copy_col),
            (hash_draw(F.col("id"), f"{c}|{seed}", n) + 1).alias("_draw_rank"))
        draws = d if draws is None else draws.unionByName(d)
    base = ranked.drop("_rank").withColumn(copy_col, F.lit(-1).cast("long"))
    if draws is None:
        return base
    picked = draws.join(ranked, F.col("_draw_class").eqNullSafe(F.col(label)) & (F.col("_draw_rank") == F.col("_rank")))
    return base.unionByName(picked.select(*base.columns))


def smote(df: DataFrame, label: str, id_col: str, vec: str, k: int = 5, seed: int = 42,
          tile: int = TILE) -> DataFrame:
    """Synthetic minority rows until the classes balance (M5).

    Each synthetic row is ``base + lam * (neighbour - base)`` with the base
    drawn from the minority class, the neighbour among its k nearest minority
    neighbours and ``lam`` in [0, 1), all from seeded hashes of the draw number.
    ``vec`` is an array<double> column. Neighbours are exact (:mod:`peakscreen.operators.knn`).
    A null label is a class of its own; an empty table comes back empty.
    Output: id, label, vec, ``synthetic`` flag; synthetic ids are negative.
    """
    spark = df.sparkSession
    counts = class_counts(df, label)
    minority = min(counts, key=lambda c: (counts[c], _class_order(c)), default=None)
    n_min, n_max = counts.get(minority, 0), max(counts.values(), default=0)
    if 0 < n_min < k + 1:
        raise ValueError(f"SMOTE needs more than {k} minority rows, got {n_min}")
    base_rows = df.select(F.col(id_col).cast("long").alias(id_col), label,
                          F.col(vec).cast("array<double>").alias(vec), F.lit(False).alias("synthetic"))
    n_synth = n_max - n_min
    if n_synth == 0:
        return base_rows
    mino = base_rows.where(F.col(label).eqNullSafe(F.lit(minority))).select(id_col, vec)
    nbrs = knn_within(mino, id_col, vec, k, tile)
    ranked = class_rank(mino.withColumn("_c", F.lit(1)), "_c", id_col, seed).drop("_c")
    draws = spark.range(0, n_synth).select(
        F.col("id").alias("_j"),
        (hash_draw(F.col("id"), f"base|{seed}", n_min) + 1).alias("_rank"),
        hash_draw(F.col("id"), f"nb|{seed}", k).cast("int").alias("nb_rank"),
        (hash_draw(F.col("id"), f"lam|{seed}", 1 << 30) / F.lit(float(1 << 30))).alias("_lam"))
    b = draws.join(ranked.select(F.col(id_col).alias("_base"), F.col(vec).alias("_bv"), "_rank"), "_rank")
    b = b.join(nbrs.select(F.col(id_col).alias("_base"), "nb_rank", "nb_id"), ["_base", "nb_rank"])
    b = b.join(mino.select(F.col(id_col).alias("nb_id"), F.col(vec).alias("_nv")), "nb_id")
    synth = b.select(
        (-(F.col("_j") + 1)).alias(id_col), F.lit(minority).cast(df.schema[label].dataType).alias(label),
        F.zip_with("_bv", "_nv", lambda a, n: a + F.col("_lam") * (n - a)).alias(vec),
        F.lit(True).alias("synthetic"))
    return base_rows.unionByName(synth)
