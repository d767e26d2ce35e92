"""Registered queries of projections, vectors, weights, summaries and table files, each with SQL."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakscreen import schema as S
from peakscreen.functions.names import display_name
from peakscreen.operators import cleaning as oc
from peakscreen.operators import evaluation as ev
from peakscreen.operators import features as fe
from peakscreen.operators import labeling as lb
from peakscreen.operators import modeling as md
from peakscreen.plans.catalog import r6, register
from peakscreen.plans.views import EVENTS_BATCH_SQL, events_batch, load
from peakscreen.session import ensure_checkpoint_dir
from peakscreen.sources import tables as st

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _labelled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem").withColumn(
        "reported", F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    return oc.project(li, MEASURES, keep=["l_orderkey", "l_linenumber", "reported"])


@register("feature_vectors", """
SELECT l_orderkey, l_linenumber, CAST(4 AS INTEGER) AS n_features,
       round(CAST(l_quantity AS DOUBLE) + 2 * CAST(l_extendedprice AS DOUBLE) + 3 * CAST(l_discount AS DOUBLE)
             + 4 * CAST(l_tax AS DOUBLE), 4) AS checksum,
       CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS DOUBLE) AS label
FROM lineitem
""")
def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projected measures assembled into a vector with a double label."""
    vec = vector_to_array("features")
    weighted = F.aggregate(F.transform(vec, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return fe.assemble(_labelled_lines(spark, sf_dir), "reported", MEASURES).select(
        "l_orderkey", "l_linenumber", F.size(vec).alias("n_features"),
        F.round(weighted, 4).alias("checksum"), "label")


@register("class_weights", """
WITH f AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS reported FROM lineitem),
c AS (SELECT reported, count(*) AS n FROM f GROUP BY reported),
t AS (SELECT sum(n) AS n_all, count(*) AS k FROM c)
SELECT f.l_orderkey, f.l_linenumber, f.reported,
       round(CAST(t.n_all AS DOUBLE) / CAST(t.k * c.n AS DOUBLE) * CASE WHEN f.reported = 1 THEN 2.0 ELSE 1.0 END, 6) AS weight
FROM f JOIN c ON f.reported = c.reported CROSS JOIN t
""")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """balanced class weights, positives twice as heavy."""
    rows = _labelled_lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "reported")
    out = md.balanced_weights(rows, "reported", "weight", pos_weight=2.0)
    return out.withColumn("weight", r6("weight"))


@register("fold_scores", """
WITH s AS (SELECT CAST(l_quantity AS INTEGER) AS train_size, l_linenumber AS fold,
                  avg(CAST(l_discount AS DOUBLE)) AS train_f1, avg(CAST(l_tax AS DOUBLE)) AS test_f1
           FROM lineitem GROUP BY 1, 2)
SELECT train_size, round(avg(train_f1), 6) AS train_f1_mean, round(stddev_pop(train_f1), 6) AS train_f1_std,
       round(avg(test_f1), 6) AS test_f1_mean, round(stddev_pop(test_f1), 6) AS test_f1_std
FROM s GROUP BY train_size
""")
def fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and population deviation over folds per training size."""
    scores = load(spark, sf_dir, "lineitem").groupBy(
        F.col("l_quantity").cast("int").alias("train_size"), F.col("l_linenumber").alias("fold")).agg(
        F.avg(F.col("l_discount").cast("double")).alias("train_f1"),
        F.avg(F.col("l_tax").cast("double")).alias("test_f1"))
    out = ev.fold_summary(scores)
    return out.select("train_size", *[r6(c).alias(c) for c in out.columns if c != "train_size"])


@register("flagged_rows", f"""
WITH {EVENTS_BATCH_SQL.strip()},
fl AS (SELECT row_id, reported, sample_name, event_type,
              CAST(CASE WHEN probs < 0.55 THEN 0 ELSE 1 END AS INTEGER) AS preds FROM events_batch)
SELECT row_id, reported, sample_name, event_type, preds,
       CAST(CASE WHEN preds = 1 AND reported = 0 THEN 1 ELSE 0 END AS INTEGER) AS fp,
       CAST(CASE WHEN preds = 0 AND reported = 1 THEN 1 ELSE 0 END AS INTEGER) AS fn
FROM fl
""")
def flagged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scored row with its flags, joined with its sample information."""
    b = events_batch(spark, sf_dir)
    _, _, full = lb.incorrect_classifications(
        b.select("row_id", "reported", F.col("probs").alias("probas")),
        b.select("row_id", "sample_name", "event_type"), 0.55)
    return full.select("row_id", "reported", "sample_name", "event_type", "preds", "fp", "fn")


def _display_sql() -> str:
    keys = [*S.DISPLAY_NAMES, "not in the map"]
    values = [*S.DISPLAY_NAMES.values(), "not in the map"]
    listed = ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(zip(keys, values)))
    return f"""
SELECT e.event_id, m.k AS feature, m.v AS display_name
FROM events e JOIN (VALUES {listed}) AS m(i, k, v) ON e.event_id % {len(keys)} = m.i
"""


@register("display_names", _display_sql())
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """short names of features, the key itself where the map has none."""
    keys = [*S.DISPLAY_NAMES, "not in the map"]
    at = (F.pmod("event_id", F.lit(len(keys))) + 1).cast("int")
    rows = load(spark, sf_dir, "events").select(
        "event_id", F.element_at(F.array(*[F.lit(k) for k in keys]), at).alias("feature"))
    return rows.select("event_id", "feature", display_name("feature").alias("display_name"))


@register("report_files", """
SELECT CAST(o_orderkey AS VARCHAR) AS sample_code, o_orderpriority AS component,
       CAST(o_totalprice AS DOUBLE) AS result, fmt
FROM orders CROSS JOIN (VALUES ('csv'), ('parquet')) AS f(fmt)
""")
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as report tables and read back, once as CSV and once as Parquet."""
    reports = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("SampleCode"), F.col("o_orderpriority").alias("ComponentName"),
        F.col("o_totalprice").cast("double").alias("Numeric Result"))
    folder = _folder(spark, "reports")
    reports.write.csv(f"{folder}/csv", header=True)
    reports.write.parquet(f"{folder}/reports.parquet")
    read = [st.read_reports(spark, f"{folder}/csv").withColumn("fmt", F.lit("csv")),
            st.read_reports(spark, f"{folder}/reports.parquet").withColumn("fmt", F.lit("parquet"))]
    return read[0].unionByName(read[1]).select(
        F.col("SampleCode").alias("sample_code"), F.col("ComponentName").alias("component"),
        F.col("Numeric Result").alias("result"), "fmt")


@register("feature_store", """
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INTEGER) AS reported,
       round(CAST(l_quantity AS DOUBLE), 6) AS l_quantity, round(CAST(l_extendedprice AS DOUBLE), 6) AS l_extendedprice,
       round(CAST(l_discount AS DOUBLE), 6) AS l_discount, round(CAST(l_tax AS DOUBLE), 6) AS l_tax
FROM lineitem
""")
def feature_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature table written by label and read back."""
    path = _folder(spark, "features")
    st.write_table(_labelled_lines(spark, sf_dir), path, partition_by=["reported"])
    back = st.read_table(spark, path)
    return back.select("l_orderkey", "l_linenumber", F.col("reported").cast("int").alias("reported"),
                       *[r6(F.col(c).cast("double")).alias(c) for c in MEASURES])
