"""Role mappings that present the driver's tables as peak / report / score tables.

The operators are generic (column names are parameters); these views only say
which table column plays which role, once for Spark and once as SQL text for
the DuckDB oracle, so both sides compute from the same definitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakscreen.functions.cleaning import coerce_double

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------------------
# Fixed values of the event -> batch mapping (shared by Spark and SQL sides).
# ---------------------------------------------------------------------------
EVENT_SAMPLE_TYPE = {"click": "Quality Control", "purchase": "Standard", "signup": "Blank",
                     "view": "Unknown"}
EVENT_OTHER_TYPE = "Double Blank"
SCORE_OFFSET = 20.0
ACQ_FORMAT_SQL = "%-m/%-d/%Y %-I:%M:%S %p"


def events_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a scored batch of peaks.

    row_id = event_id; sample type from the event type; peak area = user id;
    retention time = props.k (text coerced to a number); score =
    value / (value + 20); label = value > k; acquisition text from ts.
    """
    ev = load(spark, sf_dir, "events")
    st = None
    for k, v in EVENT_SAMPLE_TYPE.items():
        st = F.when(F.col("event_type") == k, v) if st is None else st.when(F.col("event_type") == k, v)
    st = st.otherwise(EVENT_OTHER_TYPE)
    rt = coerce_double(F.get_json_object("props", "$.k"))
    return ev.select(
        F.col("event_id").alias("row_id"),
        F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("sample_name"),
        st.alias("sample_type"),
        F.col("event_type").alias("peak_name"),
        F.col("user_id").cast("double").alias("area"),
        rt.alias("rt"),
        (F.col("value") / (F.col("value") + F.lit(SCORE_OFFSET))).alias("probs"),
        F.when(F.col("value") > rt, 1).otherwise(0).alias("reported"),
        F.date_format("ts", "M/d/yyyy h:mm:ss a").alias("acquired"),
        F.col("ts"),
        F.col("event_type"),
    )


EVENTS_BATCH_SQL = f"""
events_batch AS (
  SELECT event_id AS row_id,
         'S' || CAST(user_id AS VARCHAR) AS sample_name,
         CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_SAMPLE_TYPE.items())}
              ELSE '{EVENT_OTHER_TYPE}' END AS sample_type,
         event_type AS peak_name,
         CAST(user_id AS DOUBLE) AS area,
         TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS rt,
         value / (value + {SCORE_OFFSET}) AS probs,
         CASE WHEN value > TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) THEN 1 ELSE 0 END AS reported,
         strftime(ts, '{ACQ_FORMAT_SQL}') AS acquired,
         ts,
         event_type
  FROM events
)"""


def lineitem_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem as a scored table: score = extended price / 100000, label = return flag R."""
    li = load(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     (F.col("l_extendedprice") / F.lit(100000.0)).alias("probas"),
                     F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("reported"))


LINEITEM_SCORES_SQL = """
lineitem_scores AS (
  SELECT l_orderkey, l_linenumber, l_extendedprice / 100000.0 AS probas,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS reported
  FROM lineitem
)"""
