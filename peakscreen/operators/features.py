"""Feature derivation and feature-set selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakscreen import schema as S
from peakscreen.functions.cleaning import coerce_double

FEATURE_SETS = (None, "limited", "no_analyte", "limited_no_analyte")


def _col(c: str) -> Column:
    return F.col(f"`{c}`")


def add_rt_diff(df: DataFrame, rt: str = S.RT, expected: str = S.EXPECTED_RT,
                out: str = "rt_diff", drop_inputs: bool = True) -> DataFrame:
    """|RT - expected RT| (F7); null if either side is null."""
    df = df.withColumn(out, F.abs(_col(rt) - _col(expected)))
    return df.drop(rt, expected) if drop_inputs else df


def coerce_dirty(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Typed copies of the dirty text columns (F8); the originals stay."""
    mapping = mapping or {S.AREA_RATIO: "area_ratio", S.HEIGHT_RATIO: "height_ratio",
                          S.BASELINE_SLOPE: "baseline"}
    return df.select("*", *[coerce_double(src).alias(dst) for src, dst in mapping.items()])


def one_hot(df: DataFrame, col: str = "analyte", vocabulary: Sequence[str] = S.ANALYTES,
            prefix: str | None = None, drop_input: bool = True) -> DataFrame:
    """One 0/1 column per vocabulary value, none dropped.

    The vocabulary is fixed, so a batch with new names gets no new columns and
    a null or unseen name is all zeros.
    """
    prefix = f"{col}_" if prefix is None else prefix
    c = _col(col)
    df = df.select("*", *[F.when(c == F.lit(v), 1).otherwise(0).cast("int").alias(f"{prefix}{v}")
                          for v in vocabulary])
    return df.drop(col) if drop_input else df


def single_analyte(df: DataFrame, analyte: str, col: str = "analyte") -> DataFrame:
    """Rows of one analyte plus its constant dummy column."""
    return df.where(_col(col) == F.lit(analyte)).withColumn(
        f"{col}_{analyte}", F.lit(1)).drop(col)


def numeric_only(df: DataFrame) -> DataFrame:
    """Keep numeric and boolean columns (P3), in schema order."""
    keep = [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    return df.select(*[_col(c) for c in keep])


def drop_cols(df: DataFrame, cols: Sequence[str] | None) -> DataFrame:
    """Drop the listed columns; unknown names raise (P4). ``None`` is a no-op."""
    if cols is None:
        return df
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    return df.drop(*cols)


def drop_prefixed(df: DataFrame, prefix: str = "analyte_") -> DataFrame:
    """Drop the one-hot columns (P5); case-sensitive prefix match."""
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def filter_cols(df: DataFrame, filter_type: str | None = None,
                limited: Sequence[str] = S.LIMITED_DROP) -> DataFrame:
    """Feature-set switch (P6): None, limited, no_analyte, limited_no_analyte."""
    if filter_type is None:
        return df
    if filter_type == "limited":
        return drop_cols(df, list(limited))
    if filter_type == "no_analyte":
        return drop_prefixed(df)
    if filter_type == "limited_no_analyte":
        return drop_prefixed(drop_cols(df, list(limited)))
    raise ValueError(f"unknown filter_type {filter_type!r}")


def feature_columns(df: DataFrame, label: str = "reported",
                    exclude: Sequence[str] = ("row_id",)) -> list[str]:
    """All numeric columns except the label and id columns, in schema order."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.NumericType, T.BooleanType))
            and f.name != label and f.name not in exclude]


def assemble(df: DataFrame, label: str = "reported", features: Sequence[str] | None = None,
             out: str = "features") -> DataFrame:
    """Feature vector + double ``label`` column (P7), without mutating the input."""
    from pyspark.ml.feature import VectorAssembler
    feats = list(features or feature_columns(df, label))
    va = VectorAssembler(inputCols=feats, outputCol=out, handleInvalid="keep")
    return va.transform(df).withColumn("label", _col(label).cast("double"))


def build_features(labelled: DataFrame, vocabulary: Sequence[str] = S.ANALYTES,
                   drop: Sequence[str] = ("line_no",)) -> DataFrame:
    """Feature table from a labelled peak table (C2 core).

    one-hot -> rt_diff -> coerce dirty columns -> numeric-only -> zero fill.
    ``row_id`` stays as the key; file positions (``line_no``) are not features.
    """
    df = one_hot(labelled.drop(*[c for c in drop if c in labelled.columns]), "analyte", vocabulary)
    df = add_rt_diff(df)
    df = coerce_dirty(df)
    df = numeric_only(df)
    return df.na.fill(0)
