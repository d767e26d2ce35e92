"""Registered user-level jobs (C1-C5, S10) on export files and reports written from the events table.

Events play the lab: the day and user give the sample, the user the compound, the event type the sample type, the
properties the retention time. The files are read back through the jobs of ``plans.jobs``; SQL states the results
straight from the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakscreen import schema as S
from peakscreen.operators import modeling as md
from peakscreen.plans import jobs
from peakscreen.plans.catalog import r6, register
from peakscreen.plans.catalog_ml import feature_names, lineitem_features
from peakscreen.plans.views import EVENT_OTHER_TYPE, EVENT_SAMPLE_TYPE, load
from peakscreen.session import ensure_checkpoint_dir
from peakscreen.sources import tables as st
from peakscreen.streaming.batches import ROWS_PER_FILE, write_exports

# Peak names of the written exports by user, and the compounds they clean to.
PEAKS = ["Imazalil-1", "Spinosyn A-1", "cis-Permethrin-2", "Abamectin-B1a-1", "Spiromesifen-2"]
COMPOUNDS = ["Imazalil", "Spinosad", "Permethrin", "Abamectin", "Spiromesifen"]
COLUMNS = [*S.PEAK_COLUMNS, S.ACQUISITION_DATE]


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their sample code, compound number and export cells."""
    ev = load(spark, sf_dir, "events")
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in EVENT_SAMPLE_TYPE.items() for x in kv])[F.col("event_type")], F.lit(EVENT_OTHER_TYPE))
    user, which = F.col("user_id"), (F.col("user_id") % len(PEAKS)).cast("int")
    code = F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("-"), F.lpad((user % 100).cast("string"), 2, "0"))
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit("N/A"))
    value = F.col("value").cast("string")
    cells = {S.SAMPLE_NAME: F.concat(code, F.lit("A")), S.SAMPLE_TYPE: kind, S.PEAK_NAME: F.element_at(F.array(*map(F.lit, PEAKS)), which + 1),
             S.PEAK_AREA: user.cast("string"), S.PEAK_HEIGHT: value, S.RT: k, S.EXPECTED_RT: F.lit("50"), S.RRT: value,
             S.AREA_RATIO: F.when(F.col("event_id") % 6 == 0, "#DIV/0!").otherwise(value), S.HEIGHT_RATIO: value, S.BASELINE_SLOPE: k,
             S.ACQUISITION_DATE: F.date_format("ts", S.ACQUISITION_FORMAT)}
    return ev.select("event_id", "user_id", "ts", code.alias("code"), which.alias("which"),
                     F.concat_ws("\t", *[cells.get(c, F.lit("1.5")) for c in COLUMNS]).alias("value"))


def _write_lab(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """(directory of exports, report file)."""
    lab = _lab(spark, sf_dir)
    exports, reports = _folder(spark, "lab-exports"), _folder(spark, "lab-reports") + ".parquet"
    write_exports(lab.select(F.date_format("ts", "yyyyMMdd").alias("day"), F.floor(F.col("event_id") / ROWS_PER_FILE).cast("int").alias("bucket"),
                             F.col("event_id").alias("_ord"), "value"), COLUMNS, exports)
    found = lab.where(F.col("user_id") % 4 != 3).groupBy(
        F.concat("code", F.lit("X")).alias("SampleCode"),
        F.concat(F.element_at(F.array(*map(F.lit, COMPOUNDS)), F.col("which") + 1), F.lit(S.REPORT_SUFFIX)).alias("ComponentName")).agg(
        F.max(F.when(F.col("user_id") % 3 == 0, 0.0).otherwise(1.5)).alias("Numeric Result"))
    found.write.parquet(reports)
    return exports, reports


def _score(features: DataFrame) -> DataFrame:
    """A model that SQL can state: height / (height + 20)."""
    h = F.coalesce(F.col(f"`{S.PEAK_HEIGHT}`"), F.lit(0.0))
    return features.withColumn("probs", h / (h + F.lit(20.0)))


_KINDS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_SAMPLE_TYPE.items())
_PICK = lambda names: "list_extract([" + ", ".join(f"'{n}'" for n in names) + f"], CAST(user_id % {len(names)} AS INTEGER) + 1)"
LAB_SQL = f"""
lab AS (SELECT event_id, user_id, ts, strftime(ts, '%Y%m%d') || '-' || lpad(CAST(user_id % 100 AS VARCHAR), 2, '0') AS code,
               CASE event_type {_KINDS} ELSE '{EVENT_OTHER_TYPE}' END AS kind, {_PICK(PEAKS)} AS peak, {_PICK(COMPOUNDS)} AS compound,
               CAST(user_id AS DOUBLE) AS area, value, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
reports AS (SELECT code, compound, max(CASE WHEN user_id % 3 = 0 THEN 0.0 ELSE 1.5 END) AS result FROM lab WHERE user_id % 4 <> 3
            GROUP BY code, compound),
labelled AS (SELECT l.*, CASE WHEN coalesce(r.result, 0) = 0 THEN 0 ELSE 1 END AS reported
             FROM lab l LEFT JOIN reports r ON l.code = r.code AND l.compound = r.compound
             WHERE value IS DISTINCT FROM 0 AND k IS DISTINCT FROM 0 AND kind = 'Unknown')"""


@register("job_labelled_table", f"""WITH {LAB_SQL}
SELECT code AS sample_name, compound AS analyte, area, value AS height, k AS rt, reported FROM labelled
""")
def job_labelled_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written exports and reports -> labelled peaks."""
    exports, reports = _write_lab(spark, sf_dir)
    labelled, _ = jobs.labelled_table(spark, exports, reports)
    return labelled.select("sample_name", "analyte", F.col(f"`{S.PEAK_AREA}`").alias("area"), F.col(f"`{S.PEAK_HEIGHT}`").alias("height"),
                           F.col(f"`{S.RT}`").alias("rt"), "reported")


@register("job_feature_table", f"""WITH {LAB_SQL}
SELECT area, value AS height, round(coalesce(abs(k - 50), 0), 6) AS rt_diff, CASE WHEN event_id % 6 = 0 THEN 0 ELSE value END AS area_ratio,
       value AS height_ratio, coalesce(k, 0) AS baseline, reported,
       {", ".join(f"CAST(compound = '{a}' AS INTEGER) AS analyte_{a}" for a in S.ANALYTES)} FROM labelled
""")
def job_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table as written and read again."""
    exports, reports = _write_lab(spark, sf_dir)
    path = _folder(spark, "lab-features")
    jobs.feature_table_job(spark, exports, reports, path, path + "-info")
    t = st.read_table(spark, path)
    return t.select(F.col(f"`{S.PEAK_AREA}`").alias("area"), F.col(f"`{S.PEAK_HEIGHT}`").alias("height"), r6("rt_diff").alias("rt_diff"),
                    "area_ratio", "height_ratio", "baseline", "reported", *[f"analyte_{a}" for a in S.ANALYTES])


@register("job_feature_data", f"""WITH {LAB_SQL},
c AS (SELECT count(*) AS n, sum(reported) AS p FROM labelled),
s AS (SELECT n, p, least(p, n - p) AS lo, greatest(p, n - p) AS hi FROM c),
f(filter_type, n_features) AS (VALUES ('all', 29), ('limited', 18), ('no_analyte', 16), ('limited_no_analyte', 5))
SELECT filter_type, CAST(n_features AS INTEGER) AS n_features, n AS n_rows, CAST(p AS BIGINT) AS n_reported,
       CAST(2 * lo AS BIGINT) AS n_under, CAST(2 * hi AS BIGINT) AS n_over, CAST(2 * hi AS BIGINT) AS n_smote,
       CAST(ceil(CAST(0.33 AS DOUBLE) * n) AS BIGINT) AS n_test FROM f, s
""")
def job_feature_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature sets, split and the three ways to balance the classes of the written feature table."""
    exports, reports = _write_lab(spark, sf_dir)
    path = _folder(spark, "lab-features")
    jobs.feature_table_job(spark, exports, reports, path)
    data = jobs.FeatureData(path)
    whole = data.table(spark)
    rows = whole.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("reported").cast("long").alias("n_reported"))
    for name, made in (("n_under", data.under(whole)), ("n_over", data.over(whole)), ("n_smote", data.smote(whole)), ("n_test", data.split(spark)[1])):
        rows = rows.withColumn(name, F.lit(made.count()))
    sets = spark.createDataFrame([(t or "all", len([c for c in data.table(spark, t).columns if c not in ("row_id", "reported")]))
                                  for t in (None, "limited", "no_analyte", "limited_no_analyte")], "filter_type string, n_features int")
    return sets.join(F.broadcast(rows), how="inner")


DECIDED_SQL = f"""{LAB_SQL},
decided AS (SELECT *, CASE WHEN k = 0 THEN 0 WHEN value / (value + 20.0) > 0.4 THEN 1 ELSE 0 END AS predict,
                   CASE WHEN kind IN ('Quality Control', 'Standard') THEN 1 WHEN kind IN ('Blank', 'Solvent') THEN 0 END AS expected FROM lab)"""


@register("job_batch_profit", f"""WITH {DECIDED_SQL},
p AS (SELECT code || 'A' AS sample, peak, date_trunc('second', ts) AS acquired_at,
             (CASE WHEN kind = 'Unknown' AND predict = 1 THEN 50 ELSE 0 END)
             - (CASE WHEN expected = 1 AND predict = 0 AND area > 0 THEN 10000 ELSE 0 END) AS profit_cents FROM decided),
d AS (SELECT acquired_at, sum(profit_cents) AS day_cents, count(*) AS n FROM p GROUP BY acquired_at)
SELECT acquired_at, CAST(n AS BIGINT) AS n, CAST(sum(day_cents) OVER (ORDER BY acquired_at) AS BIGINT) AS profit_total_cents FROM d
""")
def job_batch_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every written batch scored; the running profit at the end of each second (rows of a second tie by row id)."""
    exports, _ = _write_lab(spark, sf_dir)
    running = jobs.batch_profit_job(spark, exports, _score)
    return running.groupBy("acquired_at").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("profit_total_cents", F.col("row_id")).cast("long").alias("profit_total_cents"))


@register("job_batch_evaluation", f"""WITH {DECIDED_SQL}
SELECT 'failed_controls' AS list, code || 'A' AS sample, peak FROM decided WHERE expected = 1 AND predict = 0
UNION ALL SELECT 'dirty_blanks', code || 'A', peak FROM decided WHERE expected = 0 AND predict = 1
UNION ALL SELECT 'review', code || 'A', peak FROM decided WHERE kind = 'Unknown' AND predict = 1
""")
def job_batch_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: the three lists of the written batches."""
    exports, _ = _write_lab(spark, sf_dir)
    lists = jobs.evaluate_batch(spark, exports, _score)
    out = None
    for name in ("failed_controls", "dirty_blanks", "review"):
        part = lists[name].select(F.lit(name).alias("list"), F.col(f"`{S.SAMPLE_NAME}`").alias("sample"), F.col(f"`{S.PEAK_NAME}`").alias("peak"))
        out = part if out is None else out.unionByName(part)
    return out


@register("model_roundtrip", """
SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_different, 12 AS n_features, CAST(0.25 AS DOUBLE) AS threshold
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
""")
def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model saved and loaded scores every row as before and keeps its features and threshold."""
    feats = lineitem_features(spark, sf_dir)
    fitted = md.fit_model(feats, feature_names(feats), "logistic", maxIter=10)
    fitted.threshold = 0.25
    path = _folder(spark, "model")
    st.save_fitted(spark, fitted, path)
    again = st.load_fitted(spark, path)
    both = md.score(again, md.score(fitted, feats, "before"), "after")
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("n_different")).select(
        "n_rows", "n_different", F.lit(len(again.features)).alias("n_features"), F.lit(float(again.threshold)).alias("threshold"))
