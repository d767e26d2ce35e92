"""Row filters and name normalisation on peak tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakscreen import schema as S
from peakscreen.functions import cleaning as fc


def _col(c: str) -> Column:
    return F.col(f"`{c}`")


def project(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Keep the named columns, failing loudly on a missing one."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    return df.select(*[_col(c) for c in list(keep) + list(columns)])


def reduce_peaks(df: DataFrame, rrt: str = S.RRT, rt: str = S.RT,
                 type_col: str = S.SAMPLE_TYPE, keep_type: str = S.UNKNOWN_TYPE) -> DataFrame:
    """Keep integrated peaks of unknown samples.

    ``RRT != 0 and RT != 0`` with pandas semantics: a missing value is *not*
    equal to 0, so it is kept; ``NOT (x <=> 0)`` says exactly that.
    """
    return df.where(~_col(rrt).eqNullSafe(0) & ~_col(rt).eqNullSafe(0)
                    & (_col(type_col) == F.lit(keep_type)))


def clean_sample_names(df: DataFrame, src: str = S.SAMPLE_NAME, out: str = "sample_name",
                       pattern: str = S.SAMPLE_CODE_PATTERN) -> DataFrame:
    """Add the sample code and drop rows without one (F1)."""
    return df.withColumn(out, fc.sample_code(src, pattern)).where(F.col(out).isNotNull())


def clean_analyte_names(df: DataFrame, src: str = S.PEAK_NAME, out: str = "analyte",
                        remove: Sequence[str] = S.ANALYTE_REMOVE,
                        merge: Mapping[str, str] = S.ANALYTE_MERGE,
                        suffix_len: int = S.REPLICATE_SUFFIX_LEN) -> DataFrame:
    """Analyte name = peak name minus replicate suffix, literals, synonyms."""
    name = fc.merge_synonyms(fc.remove_literals(fc.strip_last_chars(src, suffix_len), remove), merge)
    return df.withColumn(out, name)


def correct_spelling(df: DataFrame, col: str, incorrect: str, correct: str) -> DataFrame:
    """Substring spelling fix."""
    return df.withColumn(col, fc.replace_substring(col, incorrect, correct))


def report_key_columns(code: str = "SampleCode", component: str = "ComponentName",
                       result: str = "Numeric Result",
                       fixes: Sequence[tuple[str, str]] = S.REPORT_SPELLING,
                       suffix: str = S.REPORT_SUFFIX) -> dict[str, Column]:
    """Report join-key expressions (F5, F6): code minus its last character, and
    the component name with spelling fixes applied *before* the suffix strip
    (the fixes include the suffix)."""
    comp = _col(component)
    for bad, good in fixes:
        comp = F.replace(comp, F.lit(bad), F.lit(good))
    return {"Numeric Result": _col(result),
            "SampleCode2": fc.strip_last_chars(code, 1),
            "ComponentName2": F.replace(comp, F.lit(suffix), F.lit(""))}


def prepare_reports(reports: DataFrame, code: str = "SampleCode", component: str = "ComponentName",
                    result: str = "Numeric Result",
                    fixes: Sequence[tuple[str, str]] = S.REPORT_SPELLING,
                    suffix: str = S.REPORT_SUFFIX) -> DataFrame:
    """Reported-results table reduced to (Numeric Result, SampleCode2, ComponentName2)."""
    cols = report_key_columns(code, component, result, fixes, suffix)
    return reports.select(*[c.alias(n) for n, c in cols.items()])
