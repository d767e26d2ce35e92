"""Data-quality expectation suite (Q1): every check in one aggregate pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakscreen import schema as S


@dataclass(frozen=True)
class Expectation:
    """A named row-level check; ``ok`` is true for an expected row.

    ``mostly`` is the minimum share of expected rows for the check to pass
    (1.0 = every row). ``column`` names the value shown in samples of failures.
    """
    name: str
    column: str
    ok: Column
    mostly: float = 1.0


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def not_null(column: str) -> Expectation:
    return Expectation(f"{column} not null", column, _c(column).isNotNull())


def in_set(column: str, values: Sequence, mostly: float = 1.0, name: str | None = None) -> Expectation:
    """Value in the set; nulls are not counted as failures (they are not checked)."""
    return Expectation(name or f"{column} in set", column,
                       F.coalesce(_c(column).isin(list(values)), F.lit(True)), mostly)


def matches(column: str, pattern: str, full_match: bool = False) -> Expectation:
    """Regex match anywhere in the value, or of the whole value with ``full_match``."""
    pat = pattern if not full_match else f"^(?:{pattern})$"
    return Expectation(f"{column} matches {pattern}", column,
                       F.coalesce(_c(column).rlike(pat), F.lit(True)))


def between(column: str, lo: float, hi: float) -> Expectation:
    return Expectation(f"{column} between {lo} and {hi}", column,
                       F.coalesce(_c(column).between(lo, hi), F.lit(True)))


def share_at_least(column: str, value, share: float) -> Expectation:
    """At least ``share`` of the rows equal ``value`` (e.g. >= 1 % positives)."""
    return Expectation(f"{column} = {value} for at least {share:.0%}", column,
                       F.coalesce(_c(column) == F.lit(value), F.lit(False)), share)


def default_suite(sample: str = "sample_name", label: str = "reported", rt: str = S.RT,
                  analyte: str = "analyte", vocabulary: Sequence[str] = S.ANALYTES,
                  pattern: str = r"[0-9]{8}\-[0-9]{2}", rt_range: tuple = (0, 14),
                  full_match: bool = False) -> list[Expectation]:
    """The six lab checks on a labelled peak table."""
    return [not_null(sample), in_set(label, [0, 1]), share_at_least(label, 1, 0.01),
            matches(sample, pattern, full_match), between(rt, *rt_range),
            in_set(analyte, vocabulary)]


def run_suite(df: DataFrame, suite: Sequence[Expectation]) -> DataFrame:
    """(expectation, unexpected, total, pct, passed) per check, from one aggregate."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.count_if(~e.ok).alias(f"_u{i}") for i, e in enumerate(suite)]
    row = df.agg(*aggs)
    rows = []
    for i, e in enumerate(suite):
        u, n = F.col(f"_u{i}"), F.col("_n")
        pct = F.when(n == 0, F.lit(0.0)).otherwise(u * 100.0 / n)
        passed = F.when(n == 0, F.lit(True)).otherwise((n - u) >= F.lit(e.mostly) * n)
        rows.append(F.struct(F.lit(e.name).alias("expectation"), u.cast("long").alias("unexpected"),
                             n.cast("long").alias("total"), pct.alias("pct"),
                             passed.alias("passed")))
    return row.select(F.inline(F.array(*rows)))


def failure_samples(df: DataFrame, e: Expectation, n: int = 20) -> DataFrame:
    """Up to ``n`` example values that fail a check (a report sample, not a result)."""
    return df.where(~e.ok).select(_c(e.column)).limit(n)
