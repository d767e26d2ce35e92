"""Batch scoring decisions, control audits, review lists, running profit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakscreen import schema as S
from peakscreen.functions import decisions as fd
from peakscreen.operators.prefix import running_total


def add_decisions(df: DataFrame, score: str = "probs", rt: str = S.RT,
                  sample_type: str = S.SAMPLE_TYPE, threshold: float = 0.4,
                  rules: Mapping[str, int] = S.EXPECTED_BY_TYPE,
                  unknown: str = S.UNKNOWN_TYPE) -> DataFrame:
    """predict, expected, false_pos, false_neg, sample_pred in one projection."""
    predict = fd.decision(score, rt, threshold)
    expected = fd.expected_outcome(sample_type, rules)
    return df.select(
        "*",
        predict.alias("predict"),
        expected.alias("expected"),
    ).select(
        "*",
        fd.false_pos("predict", "expected").alias("false_pos"),
        fd.false_neg("predict", "expected").alias("false_neg"),
        fd.sample_flag(sample_type, "predict", unknown).alias("sample_pred"),
    )


def control_lists(decided: DataFrame, cols: Sequence[str] = (S.SAMPLE_NAME, S.PEAK_NAME, S.PEAK_AREA)
                  ) -> tuple[DataFrame, DataFrame]:
    """(failed controls, dirty blanks): false negatives and false positives (P10)."""
    sel = [F.col(f"`{c}`") for c in cols]
    return (decided.where(F.col("false_neg") == 1).select(*sel),
            decided.where(F.col("false_pos") == 1).select(*sel))


def review_list(decided: DataFrame, cols: Sequence[str] = (S.SAMPLE_NAME, S.PEAK_NAME)) -> DataFrame:
    """Unknown samples predicted positive: the chemist's review list."""
    return decided.where(F.col("sample_pred") == 1).select(*[F.col(f"`{c}`") for c in cols])


def control_status(decided: DataFrame, group_cols: Sequence[str] = ("source_file",)) -> DataFrame:
    """Failed controls and dirty blanks per batch, with pass flags."""
    return decided.groupBy(*group_cols).agg(
        F.sum("false_neg").cast("long").alias("failed_controls"),
        F.sum("false_pos").cast("long").alias("dirty_blanks"),
    ).select("*",
             (F.col("failed_controls") == 0).alias("controls_pass"),
             (F.col("dirty_blanks") == 0).alias("blanks_pass"))


def add_profit(decided: DataFrame, area: str = S.PEAK_AREA, gain_cents: int = 50,
               miss_cents: int = 10000) -> DataFrame:
    """false_neg_adj and integer-cent row profit."""
    return decided.withColumn("false_neg_adj", fd.false_neg_adjusted("false_neg", area)) \
                  .withColumn("profit_cents",
                              fd.row_profit_cents("sample_pred", "false_neg_adj", gain_cents, miss_cents))


def cumulative_profit(profited: DataFrame, ts: str = "acquired_at", row_id: str = "row_id",
                      n_blocks: int | None = None) -> DataFrame:
    """Running profit over acquisition time, ties broken by row id."""
    return running_total(profited, ["profit_cents"], [ts, row_id], out=["profit_total_cents"],
                         n_blocks=n_blocks)


def cumulative_misses(flagged: DataFrame, group: str = "analyte", score: str = "probas",
                      row_id: str = "row_id", fn: str = "fn", n_blocks: int | None = None) -> DataFrame:
    """Running count of false negatives per group by ascending score."""
    return running_total(flagged, [fn], [score, row_id], partition_by=[group], out=["fn_count"],
                         n_blocks=n_blocks)
