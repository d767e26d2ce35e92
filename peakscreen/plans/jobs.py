"""User-level jobs: labelled table, feature table, batch evaluation, batch profit.

Each job is one lazy plan from the export directory to its result; only the
sinks (Parquet writes) and small summaries trigger execution.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakscreen import schema as S
from peakscreen.functions.decisions import parse_acquisition
from peakscreen.operators import batch_qc as qc
from peakscreen.operators import cleaning as oc
from peakscreen.operators import features as fe
from peakscreen.operators import labeling as lb
from peakscreen.operators import modeling as md
from peakscreen.operators import sampling as sm
from peakscreen.sources import instrument as ins
from peakscreen.sources import tables


def labelled_table(spark: SparkSession, export_dir: str, reports: DataFrame | str,
                   columns: Sequence[str] = S.PEAK_COLUMNS,
                   remove: Sequence[str] = S.ANALYTE_REMOVE,
                   merge: Mapping[str, str] = S.ANALYTE_MERGE,
                   dedupe: bool = False) -> tuple[DataFrame, DataFrame]:
    """Exports -> integrated unknown peaks -> clean names -> report join -> label.

    Returns (labelled table with ``row_id``, rejected files).
    """
    parsed = ins.read_instrument_dir(spark, export_dir, columns)
    peaks = ins.with_row_id(parsed.rows)
    peaks = oc.reduce_peaks(peaks)
    peaks = oc.clean_sample_names(peaks)
    peaks = oc.clean_analyte_names(peaks, remove=remove, merge=merge)
    rep = tables.read_reports(spark, reports) if isinstance(reports, str) else reports
    rep = oc.prepare_reports(rep)
    return lb.merge_reports(peaks, rep, dedupe=dedupe), parsed.rejected


def sample_info(labelled: DataFrame) -> DataFrame:
    """Side table keyed by ``row_id``: sample and analyte names."""
    return labelled.select("row_id", F.col(f"`{S.SAMPLE_NAME}`"), "sample_name", "analyte")


def feature_table_job(spark: SparkSession, export_dir: str, reports: DataFrame | str,
                      out_path: str | None = None, info_path: str | None = None,
                      vocabulary: Sequence[str] = S.ANALYTES) -> dict:
    """Labelled table -> one-hot -> rt_diff -> coerced ratios -> numeric only -> zero fill.

    Writes the feature table (and the sample-info side table) when paths are
    given; returns row and positive counts (A1) and the feature table.
    """
    labelled, rejected = labelled_table(spark, export_dir, reports)
    feats = fe.build_features(labelled, vocabulary=vocabulary)
    counts = lb.label_counts(labelled).first()
    if out_path:
        tables.write_table(feats, out_path)
    if info_path:
        tables.write_table(sample_info(labelled), info_path)
    return {"features": feats, "n_rows": int(counts["n_rows"] or 0),
            "n_reported": int(counts["n_reported"] or 0), "rejected": rejected}


def batch_features(rows: DataFrame, vocabulary: Sequence[str] = S.ANALYTES) -> DataFrame:
    """Scoring features of a raw batch: every row kept (controls and empty peaks included)."""
    df = oc.clean_analyte_names(rows)
    df = fe.one_hot(df, "analyte", vocabulary, drop_input=False)
    df = fe.add_rt_diff(df, drop_inputs=False)
    df = fe.coerce_dirty(df)
    return df


#: A fitted model, or any function that appends the probability ``probs`` to a batch's features.
Scorer = md.FittedModel | Callable[[DataFrame], DataFrame]


def score_batch(rows: DataFrame, model: Scorer, threshold: float = 0.4) -> DataFrame:
    """C4: features -> probability -> decision, expectation, control errors, review flag."""
    feats = batch_features(rows)
    if isinstance(model, md.FittedModel):
        scored = md.score(model, feats.na.fill(0, subset=model.features), out="probs")
    else:
        scored = model(feats)
    return qc.add_decisions(scored, score="probs", threshold=threshold)


def evaluate_batch(spark: SparkSession, path: str, model: Scorer,
                   threshold: float = 0.4, upload: bool = False) -> dict:
    """C4: one uploaded batch -> failed controls, dirty blanks, review list, status."""
    parsed = ins.read_upload(spark, path) if upload else ins.read_instrument_dir(spark, path)
    decided = score_batch(parsed.rows, model, threshold)
    failed, dirty = qc.control_lists(decided)
    return {"failed_controls": failed, "dirty_blanks": dirty, "review": qc.review_list(decided),
            "status": qc.control_status(decided), "rejected": parsed.rejected}


def batch_profit_job(spark: SparkSession, export_dir: str, model: Scorer,
                     threshold: float = 0.4) -> DataFrame:
    """Every batch in a directory scored; running profit over acquisition time."""
    cols = list(S.PEAK_COLUMNS) + [S.ACQUISITION_DATE]
    parsed = ins.read_instrument_dir(spark, export_dir, cols)
    rows = ins.with_row_id(parsed.rows)
    decided = score_batch(rows, model, threshold)
    decided = decided.withColumn("acquired_at", parse_acquisition(S.ACQUISITION_DATE))
    prof = qc.add_profit(decided)
    return qc.cumulative_profit(prof.select("row_id", "acquired_at", F.col(f"`{S.SAMPLE_NAME}`"),
                                            F.col(f"`{S.PEAK_NAME}`"), "profit_cents"))


@dataclass(frozen=True)
class FeatureData:
    """A feature table plus the study's feature-set switches and samplers."""
    path: str
    analytes: str = "All"
    limited_drop: tuple = field(default_factory=lambda: tuple(S.LIMITED_DROP))
    label: str = "reported"
    id_col: str = "row_id"

    def table(self, spark: SparkSession, filter_type: str | None = None) -> DataFrame:
        return fe.filter_cols(tables.read_table(spark, self.path), filter_type, list(self.limited_drop))

    def split(self, spark: SparkSession, test_size: float = 0.33, filter_type: str | None = None,
              seed: int = 42) -> tuple[DataFrame, DataFrame]:
        s = sm.stratified_split(self.table(spark, filter_type), self.label, self.id_col, test_size, seed)
        return (s.where(F.col("split") == "train").drop("split"),
                s.where(F.col("split") == "test").drop("split"))

    def under(self, df: DataFrame, seed: int = 42) -> DataFrame:
        return sm.under_sample(df, self.label, self.id_col, seed)

    def over(self, df: DataFrame, seed: int = 42) -> DataFrame:
        return sm.over_sample(df, self.label, self.id_col, seed)

    def smote(self, df: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
        """Balanced by synthetic rows over all numeric features; their ids are negative."""
        names = fe.feature_columns(df, self.label, (self.id_col,))
        vec = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in names]).alias("vec")
        out = sm.smote(df.select(self.id_col, self.label, vec), self.label, self.id_col, "vec", k, seed)
        return out.select(self.id_col, self.label, *[F.col("vec")[i].alias(c) for i, c in enumerate(names)])
