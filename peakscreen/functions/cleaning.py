"""Name cleaning and numeric coercion as Catalyst expressions.

All functions return ``Column`` objects, so they compose inside one projection
and stay in whole-stage code generation; no Python UDF is involved.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakscreen import schema as S


def _col(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def sample_code(c: str | Column, pattern: str = S.SAMPLE_CODE_PATTERN) -> Column:
    """Leftmost match of ``pattern`` or null (F1).

    ``regexp_substr`` returns null when nothing matches, unlike
    ``regexp_extract`` which returns the empty string.
    """
    return F.regexp_substr(_col(c), F.lit(pattern))


def strip_last_chars(c: str | Column, n: int = 1) -> Column:
    """Drop the last ``n`` characters; strings of length <= n become ''."""
    col = _col(c)
    return F.substring(col, F.lit(1), F.greatest(F.length(col) - n, F.lit(0)))


def drop_suffix(c: str | Column, n: int = S.REPLICATE_SUFFIX_LEN) -> Column:
    """Replicate suffix removal: the last two characters go (F2)."""
    return strip_last_chars(c, n)


def replace_substring(c: str | Column, search: str, repl: str) -> Column:
    """Literal (not regex) substring replacement (F5 spelling fix)."""
    return F.replace(_col(c), F.lit(search), F.lit(repl))


def remove_literals(c: str | Column, literals: Iterable[str] = S.ANALYTE_REMOVE) -> Column:
    """Remove each literal in list order (F3); order matters."""
    return reduce(lambda acc, lit_: F.replace(acc, F.lit(lit_), F.lit("")), literals, _col(c))


def merge_synonyms(c: str | Column, mapping: Mapping[str, str] = S.ANALYTE_MERGE) -> Column:
    """Replace each synonym substring by its canonical name."""
    return reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])),
                  mapping.items(), _col(c))


def null_tokens(c: str | Column, tokens: Iterable[str] = S.NA_TOKENS) -> Column:
    """Missing-value tokens of the text reader become null."""
    col = _col(c)
    return F.when(col.isin(list(tokens)), F.lit(None).cast("string")).otherwise(col)


def coerce_double(c: str | Column, pattern: str = S.NUMERIC_PATTERN) -> Column:
    """Text to double; anything that is not a plain number becomes null (F8).

    ANSI mode makes ``cast`` raise on bad text, and ``try_cast`` alone accepts
    forms such as ``1d``; the pattern guard pins the accepted language.
    """
    t = F.trim(_col(c).cast("string"))
    return F.when(t.rlike(pattern), t.try_cast("double"))


def fill_zero(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Zero-fill nulls (and NaN) of numeric columns."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    cols = [c for c in (columns or df.columns) if c in numeric]
    return df.na.fill(0, subset=cols) if cols else df
