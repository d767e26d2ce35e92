"""Labelling by reported results and error lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakscreen.functions.cleaning import fill_zero
from peakscreen.functions.decisions import error_flags, label_from_result


def merge_reports(peaks: DataFrame, reports: DataFrame,
                  left_keys: Sequence[str] = ("sample_name", "analyte"),
                  right_keys: Sequence[str] = ("SampleCode2", "ComponentName2"),
                  result: str = "Numeric Result", label: str = "reported",
                  null_safe: bool = True, dedupe: bool = False, fill: bool = True) -> DataFrame:
    """Left-join peaks with reported results and derive the 0/1 label.

    * Every peak row survives; duplicate report keys multiply rows (as a plain
      left join does) unless ``dedupe=True``, which keeps the largest result
      per key, aggregated before the join so the report side shrinks first.
    * ``null_safe`` matches null keys with null keys.
    * ``fill`` zero-fills numeric nulls afterwards, as the labelled table does.
    * The planner's size estimate and runtime statistics choose between a
      broadcast and a shuffle of both sides, whose skewed keys AQE splits.
    """
    r = reports.select(*[F.col(f"`{k}`") for k in right_keys], F.col(f"`{result}`").alias("_result"))
    if dedupe:
        r = r.groupBy(*[F.col(f"`{k}`") for k in right_keys]).agg(F.max("_result").alias("_result"))
    r = r.toDF(*[f"_rk{i}" for i in range(len(right_keys))], "_result")
    cond = None
    for i, k in enumerate(left_keys):
        lk, rk = F.col(f"`{k}`"), F.col(f"_rk{i}")
        c = lk.eqNullSafe(rk) if null_safe else (lk == rk)
        cond = c if cond is None else cond & c
    out = peaks.join(r, cond, "left")
    out = out.withColumn(label, label_from_result("_result")).drop(
        "_result", *[f"_rk{i}" for i in range(len(right_keys))])
    return fill_zero(out) if fill else out


def label_counts(df: DataFrame, group_cols: Sequence[str] = (), label: str = "reported") -> DataFrame:
    """Rows and positives, optionally per group (A1)."""
    aggs = [F.count(F.col(label)).cast("long").alias("n_rows"),
            F.sum(F.col(label)).cast("long").alias("n_reported")]
    if group_cols:
        return df.groupBy(*group_cols).agg(*aggs)
    return df.agg(*aggs)


def merge_on_row_id(left: DataFrame, right: DataFrame, key: str = "row_id") -> DataFrame:
    """Left join on the stable row id."""
    return left.join(right, on=key, how="left")


def rows_in(info: DataFrame, ids: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows of ``info`` whose id appears in ``ids`` (J3): a semi join, never a collected list."""
    return info.join(ids.select(key), on=key, how="left_semi")


def incorrect_classifications(scored: DataFrame, info: DataFrame, threshold: float,
                              score: str = "probas", label: str = "reported",
                              key: str = "row_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """False-positive list, false-negative list and full flagged table.

    ``scored`` carries (row_id, label, score); ``info`` carries the sample and
    analyte names keyed by row id. The flagged table is computed once; both
    lists are semi joins against it.
    """
    flags = error_flags(score, label, threshold)
    flagged = scored.select("*", *[v.alias(k) for k, v in flags.items()])
    full = merge_on_row_id(flagged, info, key)
    fp_ids = flagged.where(F.col("fp") == 1)
    fn_ids = flagged.where(F.col("fn") == 1)
    return rows_in(info, fp_ids, key), rows_in(info, fn_ids, key), full
