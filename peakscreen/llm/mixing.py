"""Mix sources to target weights.

Sizes (words) are summed per source. Every source has a weight; the targets
share the total by weight, but none exceeds ``max_repeat`` times its source's
size: what is cut off is shared again by weight among the rest. With a source's
rate = target / size, a document is taken floor(rate) times plus once more with
probability rate - floor(rate), drawn from a hash of its id.

Defined cases: a null source is a source of its own, ordered last; a null or
empty text has size 0; a source whose documents are all empty has target 0 and
rate 0 (its documents are not repeated); rows with the same id share their draw; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakscreen.llm.common import boxed, staged, unboxed, unit_draw, word_count

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = "mix-1"


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``source, source_size, target, rate`` from rows with ``source`` and ``size``.

    The cut sources are those with ``cap <= level * weight`` for the final level;
    in order of cap / weight they are a prefix, and a source belongs to it iff
    the caps up to it plus the rest at its ratio fit into the total. The two
    windows here run over one row per source (weights are given per source).
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")).cast("long")
    base = sums.select("source", "source_size", weight.alias("weight")).withColumn(
        "cap", F.lit(max_repeat) * F.col("source_size"))
    scale = 1
    for w in weights:
        scale *= w
    # cap / weight as a whole number: no rounding decides who is cut off.
    ratio = F.col("cap") * (F.lit(scale) / F.col("weight")).cast("long")
    up_to = (Window.partitionBy(F.lit(0)).orderBy("_ratio", F.col("source").asc_nulls_last())
             .rowsBetween(Window.unboundedPreceding, 0))
    everything = Window.partitionBy(F.lit(0))
    x = (base.withColumn("_ratio", ratio)
         .withColumn("_caps", F.sum("cap").over(up_to))
         .withColumn("_light", F.sum("weight").over(up_to))
         .withColumn("_total", F.sum("source_size").over(everything))
         .withColumn("_weights", F.sum("weight").over(everything))
         .withColumn("_cut", F.col("_caps").cast("double") + F.col("_ratio").cast("double")
                     * (F.col("_weights") - F.col("_light")) / F.lit(float(scale))
                     <= F.col("_total").cast("double")))
    left = F.sum(F.when(~F.col("_cut"), F.col("weight")).otherwise(F.lit(0))).over(everything)
    spent = F.sum(F.when(F.col("_cut"), F.col("cap")).otherwise(F.lit(0))).over(everything)
    x = x.withColumn("_left", left).withColumn("_spent", spent)
    target = F.when(F.col("_cut"), F.col("cap").cast("double")).otherwise(
        (F.col("_total") - F.col("_spent")).cast("double") / F.col("_left").cast("double")
        * F.col("weight").cast("double"))
    rate = F.when(F.col("source_size") == 0, F.lit(0.0)).when(
        F.col("_cut"), F.lit(float(max_repeat))).otherwise(
        F.least(target / F.col("source_size").cast("double"), F.lit(float(max_repeat))))
    return x.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def copies(sized: DataFrame, rates: DataFrame, key: str = "doc_id", seed: str = SEED) -> DataFrame:
    """Append the source's ``source_size, target`` and the document's ``copies``.

    ``rates`` has one row per source and was written to the shared folder, so
    the planner knows its size and broadcasts it only below its own threshold.
    """
    r = rates.withColumnRenamed("source", "_source")
    joined = sized.join(r, sized["source"].eqNullSafe(r["_source"])).drop("_source")
    draw = unit_draw(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    whole = F.floor(F.col("rate"))
    return joined.withColumn("copies", (whole + F.when(
        draw < F.col("rate") - whole, F.lit(1)).otherwise(F.lit(0))).cast("long")).drop("rate")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def mix_table(docs: DataFrame) -> DataFrame:
    """Per document its size, its source's size and target, and the words the mix takes."""
    rows = staged(sized(docs), "mix-sizes")
    rates = staged(targets(rows).coalesce(1), "mix-rates")
    return copies(rows, rates).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, same columns."""
    rates = staged(targets(staged(sized(docs), "mix-sizes")).coalesce(1), "mix-rates")
    taken = copies(boxed(docs, doc_id=F.col("doc_id"), source=F.col("source")), rates)
    return unboxed(taken.where(F.col("copies") > 0).withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))))


MIX_SQL = r"""
WITH s AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0
              ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT source, source_size, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM g),
r AS (SELECT *, 3 * source_size AS cap, 3 * source_size * (10 // weight) AS ratio FROM w),
c AS (SELECT *, sum(cap) OVER o AS caps, sum(weight) OVER o AS light,
        sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
      FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, caps::DOUBLE + ratio::DOUBLE * (weights - light) / 10.0 <= total::DOUBLE AS cut FROM c),
f AS (SELECT *, sum(CASE WHEN cut THEN 0 ELSE weight END) OVER () AS rest,
        sum(CASE WHEN cut THEN cap ELSE 0 END) OVER () AS spent FROM k),
t AS (SELECT source, source_size, cut, CASE WHEN cut THEN cap::DOUBLE
        ELSE (total - spent)::DOUBLE / rest::DOUBLE * weight::DOUBLE END AS target FROM f),
q AS (SELECT *, CASE WHEN source_size = 0 THEN 0.0::DOUBLE WHEN cut THEN 3.0::DOUBLE
        ELSE least(target / source_size::DOUBLE, 3.0::DOUBLE) END AS rate FROM t),
d AS (SELECT s.doc_id, s.size, q.source_size, q.target, q.rate,
        (('0x' || substr(md5('mix-1|' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5)
          / 4503599627370496.0::DOUBLE AS draw
      FROM s JOIN q ON s.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d
"""
