"""Registered query over real export files derived from the driver's events table.

The events are written as instrument exports (preamble, blank line, header,
tab-separated lines; one file per day and user bucket), then read back through
the directory reader, the peak filter and the name cleaning -- the same chain
the lab runs on its instrument files -- and checked against SQL computed
straight from the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakscreen import schema as S
from peakscreen.operators import cleaning as oc
from peakscreen.plans.catalog import register
from peakscreen.plans.views import EVENT_OTHER_TYPE, EVENT_SAMPLE_TYPE
from peakscreen.session import ensure_checkpoint_dir
from peakscreen.sources import instrument as ins
from peakscreen.streaming.batches import ROUNDTRIP_COLUMNS, write_event_exports

_TYPES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_SAMPLE_TYPE.items())
_REMOVE = "".join("replace(" for _ in S.ANALYTE_REMOVE)
_REMOVE_ARGS = "".join(f", '{x}', '')" for x in S.ANALYTE_REMOVE)
_MERGE = "".join("replace(" for _ in S.ANALYTE_MERGE)
_MERGE_ARGS = "".join(f", '{k}', '{v}')" for k, v in S.ANALYTE_MERGE.items())


ROUNDTRIP_SQL = f"""
WITH ev AS (
  SELECT 'S' || CAST(user_id AS VARCHAR) AS sample_name_raw,
         CASE event_type {_TYPES} ELSE '{EVENT_OTHER_TYPE}' END AS sample_type,
         event_type || '-1' AS peak_name,
         CAST(user_id AS DOUBLE) AS area,
         TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS rt,
         value AS score
  FROM events),
kept AS (
  SELECT * FROM ev
  WHERE score IS DISTINCT FROM 0 AND rt IS DISTINCT FROM 0 AND sample_type = 'Unknown'),
named AS (
  SELECT NULLIF(regexp_extract(sample_name_raw, 'S[0-9]{{2}}'), '') AS sample_name,
         {_MERGE}{_REMOVE}substr(peak_name, 1, greatest(length(peak_name) - 2, 0)){_REMOVE_ARGS}{_MERGE_ARGS}
           AS analyte,
         area, rt, score
  FROM kept)
SELECT sample_name, analyte, area, rt, score FROM named WHERE sample_name IS NOT NULL
"""


@register("export_roundtrip", ROUNDTRIP_SQL)
def export_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1-S6 + P2 + F1-F4 on written export files (whole events table)."""
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/exports-{uuid.uuid4().hex}"
    write_event_exports(spark, sf_dir, base)
    return _named_peaks(ins.read_instrument_dir(spark, base, ROUNDTRIP_COLUMNS, numeric_columns=S.NUMERIC_COLUMNS + ["Score"]))


@register("export_split", ROUNDTRIP_SQL)
def export_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files read by byte offset, so that one file may be many tasks."""
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/exports-{uuid.uuid4().hex}"
    write_event_exports(spark, sf_dir, base)
    return _named_peaks(ins.parse_split_files(spark, base, ROUNDTRIP_COLUMNS, numeric_columns=S.NUMERIC_COLUMNS + ["Score"]))


def _named_peaks(parsed: ins.ParsedFiles) -> DataFrame:
    kept = oc.reduce_peaks(parsed.rows, rrt="Score", rt=S.RT, type_col=S.SAMPLE_TYPE, keep_type=S.UNKNOWN_TYPE)
    named = oc.clean_analyte_names(oc.clean_sample_names(kept, pattern="S[0-9]{2}"))
    return named.select("sample_name", "analyte", F.col(f"`{S.PEAK_AREA}`").alias("area"),
                        F.col(f"`{S.RT}`").alias("rt"), F.col("Score").alias("score"))


@register("upload_roundtrip", f"""
SELECT CASE event_type {_TYPES} ELSE '{EVENT_OTHER_TYPE}' END AS sample_type,
       CAST(count(*) AS BIGINT) AS n_rows,
       sum(CAST(user_id AS DOUBLE)) AS area_sum
FROM events GROUP BY 1
""")
def upload_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upload reader (header must start its line, numbers strict) on written exports."""
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/uploads-{uuid.uuid4().hex}"
    write_event_exports(spark, sf_dir, base)
    parsed = ins.read_upload(spark, base, ROUNDTRIP_COLUMNS)
    return parsed.rows.groupBy(F.col(f"`{S.SAMPLE_TYPE}`").alias("sample_type")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col(f"`{S.PEAK_AREA}`")).alias("area_sum"))
