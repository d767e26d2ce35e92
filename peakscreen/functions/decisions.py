"""Labels, decisions and per-row flags as Catalyst expressions.

Three inequality conventions coexist and are kept apart on purpose:
batch decisions use ``score > t`` (F11); metric evaluation uses
``score >= t`` (A3-A6); error flags use ``not (score < t)`` (F18), which differs
from ``>=`` only for NaN scores.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from peakscreen import schema as S


def _col(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def label_from_result(result: str | Column) -> Column:
    """1 unless the reported result is 0 or missing (F10). A matched 0 is 0."""
    r = _col(result)
    return F.when(F.coalesce(r, F.lit(0.0)) == 0, F.lit(0)).otherwise(F.lit(1)).cast("int")


def decision(score: str | Column, rt: str | Column, threshold: float = 0.4) -> Column:
    """Batch decision (F11): no retention time -> 0, else strict ``score > t``."""
    return (F.when(_col(rt) == 0, F.lit(0))
            .when(_col(score) > F.lit(threshold), F.lit(1))
            .otherwise(F.lit(0))).cast("int")


def expected_outcome(sample_type: str | Column,
                     rules: Mapping[str, int] = S.EXPECTED_BY_TYPE) -> Column:
    """Expected outcome by sample type (F12); types outside the map are null."""
    st = _col(sample_type)
    out = None
    for k, v in rules.items():
        out = (F.when(st == F.lit(k), F.lit(v)) if out is None
               else out.when(st == F.lit(k), F.lit(v)))
    return out.cast("int")


def false_pos(predict: str | Column, expected: str | Column) -> Column:
    """Predicted 1 where 0 was expected (F13); null expectation -> 0."""
    return F.when((_col(predict) == 1) & (_col(expected) == 0), 1).otherwise(0).cast("int")


def false_neg(predict: str | Column, expected: str | Column) -> Column:
    """Predicted 0 where 1 was expected (F13); null expectation -> 0."""
    return F.when((_col(predict) == 0) & (_col(expected) == 1), 1).otherwise(0).cast("int")


def sample_flag(sample_type: str | Column, predict: str | Column,
                unknown: str = S.UNKNOWN_TYPE) -> Column:
    """Unknown sample predicted positive: needs a chemist's look."""
    return F.when((_col(sample_type) == unknown) & (_col(predict) == 1), 1).otherwise(0).cast("int")


def parse_acquisition(c: str | Column, fmt: str = S.ACQUISITION_FORMAT) -> Column:
    """Acquisition text to a wall-clock timestamp (F15); unparseable text -> null.

    The result is ``timestamp_ntz``, so ordering does not depend on the session
    time zone (a local time that does not exist in that zone, inside a
    daylight-saving gap, is the one value that moves).
    """
    return F.try_to_timestamp(_col(c), F.lit(fmt)).cast("timestamp_ntz")


def false_neg_adjusted(fn: str | Column, area: str | Column) -> Column:
    """False negative that did show a peak (F16)."""
    return F.when((_col(fn) == 1) & (_col(area) > 0), 1).otherwise(0).cast("int")


def row_profit_cents(sample_pred: str | Column, fn_adj: str | Column,
                     gain_cents: int = 50, miss_cents: int = 10000) -> Column:
    """Row profit in integer cents (F17): 0.50 per flagged sample, -100 per miss."""
    return (_col(sample_pred).cast("long") * gain_cents
            - _col(fn_adj).cast("long") * miss_cents)


def error_flags(score: str | Column, label: str | Column, threshold: float) -> dict[str, Column]:
    """``preds``, ``fp``, ``fn``, ``correct`` (F18); ``preds`` is 0 only if score < t."""
    preds = F.when(_col(score) < F.lit(threshold), 0).otherwise(1).cast("int")
    y = _col(label)
    fp = F.when((preds == 1) & (y == 0), 1).otherwise(0).cast("int")
    fn = F.when((preds == 0) & (y == 1), 1).otherwise(0).cast("int")
    correct = F.when((fp == 0) & (fn == 0), 1).otherwise(0).cast("int")
    return {"preds": preds, "fp": fp, "fn": fn, "correct": correct}


def f1_from_counts(tp: str | Column, fp: str | Column, fn: str | Column) -> Column:
    """F1 = 2tp / (2tp + fp + fn), 0 when the denominator is 0 (A4)."""
    num = 2.0 * _col(tp)
    den = num + _col(fp) + _col(fn)
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def precision_from_counts(tp: str | Column, fp: str | Column) -> Column:
    den = _col(tp) + _col(fp)
    return F.when(den == 0, F.lit(0.0)).otherwise(_col(tp) / den)


def recall_from_counts(tp: str | Column, fn: str | Column) -> Column:
    den = _col(tp) + _col(fn)
    return F.when(den == 0, F.lit(0.0)).otherwise(_col(tp) / den)


def round_half_even(c: str | Column) -> Column:
    """Round to the nearest integer, ties to even (0.5 -> 0), as numpy does."""
    return F.bround(_col(c), 0)
