"""Registered queries on the driver's tables, each with an equivalent SQL oracle.

Every query reads whole tables (or data Spark derives from them) and calls the
library operators; the SQL next to it states the same result in plain ANSI SQL
for DuckDB. Counts are BIGINT and doubles are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakscreen.functions import cleaning as fc
from peakscreen.functions import decisions as fd
from peakscreen.operators import batch_qc as qc
from peakscreen.operators import cleaning as oc
from peakscreen.operators import evaluation as ev
from peakscreen.operators import features as fe
from peakscreen.operators import labeling as lb
from peakscreen.plans.views import EVENTS_BATCH_SQL, events_batch, load
from peakscreen.sources.instrument import header_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn
    return deco


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---------------------------------------------------------------------------
# Stage 1: read, clean, label
# ---------------------------------------------------------------------------

@register("label_rate", """
SELECT d.lang,
       CAST(count(*) AS BIGINT) AS n_rows,
       CAST(sum(CASE WHEN coalesce(l.quality, 0) = 0 THEN 0 ELSE 1 END) AS BIGINT) AS n_reported
FROM documents d LEFT JOIN labels l ON d.doc_id IS NOT DISTINCT FROM l.doc_id
GROUP BY d.lang
""")
def label_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents left-joined with quality reports, positives per language."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang")
    reports = load(spark, sf_dir, "labels").select("doc_id", "quality")
    labelled = lb.merge_reports(docs, reports, ["doc_id"], ["doc_id"], result="quality")
    return lb.label_counts(labelled, ["lang"])


@register("label_two_key", """
SELECT o.o_orderkey, o.o_orderstatus,
       CAST(count(*) AS BIGINT) AS n_rows,
       CAST(sum(CASE WHEN coalesce(l.l_discount, 0) = 0 THEN 0 ELSE 1 END) AS BIGINT) AS n_reported
FROM orders o LEFT JOIN lineitem l
  ON o.o_orderkey IS NOT DISTINCT FROM l.l_orderkey
 AND o.o_orderstatus IS NOT DISTINCT FROM l.l_linestatus
GROUP BY o.o_orderkey, o.o_orderstatus
""")
def label_two_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 fan-out on a two-column key; a matched result of 0 (zero discount) labels 0."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus", "l_discount")
    labelled = lb.merge_reports(orders, li, ["o_orderkey", "o_orderstatus"],
                                ["l_orderkey", "l_linestatus"], result="l_discount")
    return lb.label_counts(labelled, ["o_orderkey", "o_orderstatus"])


@register("label_dedupe", """
SELECT o.o_orderstatus,
       CAST(count(*) AS BIGINT) AS n_rows,
       CAST(sum(CASE WHEN coalesce(r.res, 0) = 0 THEN 0 ELSE 1 END) AS BIGINT) AS n_reported
FROM orders o LEFT JOIN (
  SELECT l_orderkey, l_linestatus, max(l_discount) AS res FROM lineitem GROUP BY 1, 2
) r ON o.o_orderkey IS NOT DISTINCT FROM r.l_orderkey
   AND o.o_orderstatus IS NOT DISTINCT FROM r.l_linestatus
GROUP BY o.o_orderstatus
""")
def label_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 with ``dedupe=True``: one (largest) result per report key, so no fan-out."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus", "l_discount")
    labelled = lb.merge_reports(orders, li, ["o_orderkey", "o_orderstatus"],
                                ["l_orderkey", "l_linestatus"], result="l_discount", dedupe=True)
    return lb.label_counts(labelled, ["o_orderstatus"])


@register("header_line", """
SELECT doc_id,
       CAST(h - 1 AS INTEGER) AS header_line,
       CAST(CASE WHEN h = 0 THEN 0 ELSE
            len(list_filter(lines[h + 1:], lambda x: trim(x) <> '')) END AS INTEGER) AS n_data_lines
FROM (
  SELECT doc_id, lines,
         coalesce(list_position(list_transform(lines, lambda x: contains(x, 'icense')), true), 0) AS h
  FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS lines FROM documents)
)
""")
def header_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First line holding the phrase (0-based, -1 if none) and data lines after it."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.split("text", r"\r?\n").alias("lines"))
    h = header_index(F.col("lines"), "icense")
    after = F.slice("lines", h + 1, F.greatest(F.size("lines") - h, F.lit(1)))
    n_data = F.when(h == 0, F.lit(0)).otherwise(
        F.size(F.filter(after, lambda x: F.trim(x) != "")))
    return docs.select("doc_id", (h - 1).cast("int").alias("header_line"),
                       n_data.cast("int").alias("n_data_lines"))


@register("peak_filter", """
SELECT l_orderkey, l_linenumber, rrt, rt, sample_type
FROM (SELECT l_orderkey, l_linenumber, NULLIF(l_discount, 0.05) AS rrt, NULLIF(l_tax, 0.08) AS rt,
             l_returnflag AS sample_type FROM lineitem)
WHERE rrt IS DISTINCT FROM 0 AND rt IS DISTINCT FROM 0 AND sample_type = 'R'
""")
def peak_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep integrated peaks of one sample type; null RRT/RT rows are kept."""
    li = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.nullif("l_discount", F.lit(0.05)).alias("rrt"),
        F.nullif("l_tax", F.lit(0.08)).alias("rt"),
        F.col("l_returnflag").alias("sample_type"))
    return oc.reduce_peaks(li, rrt="rrt", rt="rt", type_col="sample_type", keep_type="R")


@register("sample_code", r"""
SELECT page_id, code
FROM (SELECT page_id, NULLIF(regexp_extract(url, '\d{2,3}'), '') AS code FROM pages)
WHERE code IS NOT NULL
""")
def sample_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """leftmost code match in a name; rows without one are dropped."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    return oc.clean_sample_names(pages, src="url", out="code", pattern=r"\d{2,3}").drop("url")


# Fixed values for the part-name cleaning roles.
PART_REMOVE = ["small ", "large ", "hot "]
PART_MERGE = {"gizmo": "widget", "anvi": "plate"}


@register("clean_names", """
SELECT p_partkey,
       replace(replace(replace(replace(replace(
         substr(p_name, 1, greatest(length(p_name) - 2, 0)),
         'small ', ''), 'large ', ''), 'hot ', ''), 'gizmo', 'widget'), 'anvi', 'plate') AS analyte,
       replace(p_brand, 'Brand#1', 'Brand#10') AS brand_fixed
FROM part
""")
def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicate suffix, literal removal, synonym merge, spelling fix."""
    part = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    out = oc.clean_analyte_names(part, src="p_name", out="analyte", remove=PART_REMOVE,
                                 merge=PART_MERGE)
    out = oc.correct_spelling(out, "p_brand", "Brand#1", "Brand#10")
    return out.select("p_partkey", "analyte", F.col("p_brand").alias("brand_fixed"))


@register("report_keys", """
SELECT o.o_orderkey,
       substr(c.c_name, 1, greatest(length(c.c_name) - 1, 0)) AS sample_code2,
       replace(replace(o.o_orderpriority, '2-HIGH', '2-HIGHEST'), '-URGENT', '') AS component_name2,
       o.o_totalprice AS numeric_result
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
""")
def report_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """report join keys; the spelling fix runs before the suffix strip."""
    orders = load(spark, sf_dir, "orders")
    cust = load(spark, sf_dir, "customer").select("c_custkey", "c_name")
    rep = orders.join(cust, orders.o_custkey == cust.c_custkey)
    keys = oc.report_key_columns("c_name", "o_orderpriority", "o_totalprice",
                                 fixes=[("2-HIGH", "2-HIGHEST")], suffix="-URGENT")
    return rep.select("o_orderkey", keys["SampleCode2"].alias("sample_code2"),
                      keys["ComponentName2"].alias("component_name2"),
                      keys["Numeric Result"].alias("numeric_result"))


@register("dirty_numeric", """
SELECT event_id,
       coalesce(CASE WHEN regexp_full_match(trim(txt), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')
                     THEN TRY_CAST(trim(txt) AS DOUBLE) END, 0) AS k_num,
       CASE WHEN regexp_full_match(trim(txt), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')
            THEN 1 ELSE 0 END AS parsed
FROM (SELECT event_id,
             CASE event_type WHEN 'error' THEN json_extract_string(props, '$.k') || 'd'
                             WHEN 'signup' THEN '#DIV/0!'
                             WHEN 'view' THEN ' ' || json_extract_string(props, '$.k') || 'e+000 '
                             ELSE json_extract_string(props, '$.k') END AS txt
      FROM events)
""")
def dirty_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guarded text-to-number coercion, then zero fill."""
    evs = load(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    txt = (F.when(F.col("event_type") == "error", F.concat(k, F.lit("d")))
           .when(F.col("event_type") == "signup", F.lit("#DIV/0!"))
           .when(F.col("event_type") == "view", F.concat(F.lit(" "), k, F.lit("e+000 ")))
           .otherwise(k))
    num = fc.coerce_double(txt)
    out = evs.select("event_id", num.alias("k_num"),
                     F.when(num.isNotNull(), 1).otherwise(0).alias("parsed"))
    return fc.fill_zero(out, ["k_num"])


@register("rt_diff", """
SELECT l.l_orderkey, l.l_linenumber,
       round(abs(l.l_extendedprice - l.l_quantity * p.p_retailprice), 6) AS rt_diff
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
""")
def rt_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """absolute difference of measured and expected value."""
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                                "l_extendedprice", "l_quantity")
    part = load(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    j = li.join(part, li.l_partkey == part.p_partkey).select(
        "l_orderkey", "l_linenumber", "l_extendedprice",
        (F.col("l_quantity") * F.col("p_retailprice")).alias("expected"))
    out = fe.add_rt_diff(j, rt="l_extendedprice", expected="expected")
    return out.select("l_orderkey", "l_linenumber", r6("rt_diff").alias("rt_diff"))


EVENT_VOCAB = ["click", "purchase", "signup", "view"]


@register("one_hot", """
SELECT event_id,
       CAST(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS INTEGER) AS event_type_click,
       CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS INTEGER) AS event_type_purchase,
       CAST(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS INTEGER) AS event_type_signup,
       CAST(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS INTEGER) AS event_type_view
FROM events
""")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fixed vocabulary one-hot; an unseen value ('error') is all zeros."""
    evs = load(spark, sf_dir, "events").select("event_id", "event_type")
    return fe.one_hot(evs, "event_type", EVENT_VOCAB)


FEATURE_SET_SQL = """
SELECT '{ft}' AS filter_type, event_id,
       CAST({n} AS INTEGER) AS n_features,
       round({expr}, 6) AS feature_sum
FROM base"""


def _feature_sets_sql() -> str:
    onehot = " + ".join(f"CASE WHEN event_type = '{v}' THEN 1 ELSE 0 END" for v in EVENT_VOCAB)
    cont_all = "CAST(user_id AS DOUBLE) + value + k"
    cont_lim = "value + k"
    parts = [
        FEATURE_SET_SQL.format(ft="all", n=3 + len(EVENT_VOCAB), expr=f"{cont_all} + {onehot}"),
        FEATURE_SET_SQL.format(ft="limited", n=2 + len(EVENT_VOCAB), expr=f"{cont_lim} + {onehot}"),
        FEATURE_SET_SQL.format(ft="no_analyte", n=3, expr=cont_all),
        FEATURE_SET_SQL.format(ft="limited_no_analyte", n=2, expr=cont_lim),
    ]
    return ("WITH base AS (SELECT event_id, user_id, value, event_type, "
            "coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS k FROM events)"
            + "\nUNION ALL".join(parts))


@register("feature_sets", _feature_sets_sql())
def feature_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature table, the four feature-set filters and their assembled
    vectors, in long form -- all four from one scan of the table."""
    from pyspark.ml.feature import VectorAssembler
    evs = load(spark, sf_dir, "events").select(
        "event_id", "user_id", "value", "event_type",
        fc.coerce_double(F.get_json_object("props", "$.k")).alias("k"), "props")
    table = fe.numeric_only(fe.one_hot(evs, "event_type", EVENT_VOCAB, prefix="analyte_")).na.fill(0)
    sets = [("all", None), ("limited", "limited"), ("no_analyte", "no_analyte"),
            ("limited_no_analyte", "limited_no_analyte")]
    vec = table
    structs = []
    for i, (name, ft) in enumerate(sets):
        feats = fe.feature_columns(fe.filter_cols(table, ft, limited=["user_id"]),
                                   label="reported", exclude=("event_id",))
        vec = VectorAssembler(inputCols=feats, outputCol=f"_v{i}").transform(vec)
        total = F.aggregate(_vector_values(f"_v{i}"), F.lit(0.0), lambda a, x: a + x)
        structs.append(F.struct(F.lit(name).alias("filter_type"), F.col("event_id"),
                                F.lit(len(feats)).cast("int").alias("n_features"),
                                r6(total).alias("feature_sum")))
    return vec.select(F.inline(F.array(*structs)))


def _vector_values(col: str) -> Column:
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(F.col(col))


# ---------------------------------------------------------------------------
# Stage 2: batch decisions, control audits, running totals, quality
# ---------------------------------------------------------------------------

BATCH_DECISIONS_SQL = """
WITH {eb},
dec AS (
  SELECT *,
         CAST(CASE WHEN rt = 0 THEN 0 WHEN probs > 0.4 THEN 1 ELSE 0 END AS INTEGER) AS predict,
         CAST(CASE sample_type WHEN 'Quality Control' THEN 1 WHEN 'Standard' THEN 1
              WHEN 'Blank' THEN 0 WHEN 'Solvent' THEN 0 END AS INTEGER) AS expected
  FROM events_batch
),
flags AS (
  SELECT *,
         CAST(CASE WHEN predict = 1 AND expected = 0 THEN 1 ELSE 0 END AS INTEGER) AS false_pos,
         CAST(CASE WHEN predict = 0 AND expected = 1 THEN 1 ELSE 0 END AS INTEGER) AS false_neg,
         CAST(CASE WHEN sample_type = 'Unknown' AND predict = 1 THEN 1 ELSE 0 END AS INTEGER) AS sample_pred
  FROM dec
)
""".replace("{eb}", EVENTS_BATCH_SQL.strip())


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.add_decisions(events_batch(spark, sf_dir), score="probs", rt="rt",
                            sample_type="sample_type", threshold=0.4)


@register("batch_decisions", BATCH_DECISIONS_SQL + """
SELECT row_id, predict, expected, false_pos, false_neg, sample_pred FROM flags
""")
def batch_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision, expected outcome, control errors, review flag per row."""
    return _decided(spark, sf_dir).select("row_id", "predict", "expected", "false_pos",
                                          "false_neg", "sample_pred")


@register("control_failures", BATCH_DECISIONS_SQL + """
SELECT CAST(ts AS DATE) AS day,
       CAST(sum(false_neg) AS BIGINT) AS failed_controls,
       CAST(sum(false_pos) AS BIGINT) AS dirty_blanks,
       sum(false_neg) = 0 AS controls_pass,
       sum(false_pos) = 0 AS blanks_pass
FROM flags GROUP BY CAST(ts AS DATE)
""")
def control_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed controls and dirty blanks per batch (here: per day)."""
    d = _decided(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return qc.control_status(d, ["day"])


@register("control_lists", BATCH_DECISIONS_SQL + """
SELECT 'failed_control' AS list, sample_name, peak_name, area FROM flags WHERE false_neg = 1
UNION ALL
SELECT 'dirty_blank' AS list, sample_name, peak_name, area FROM flags WHERE false_pos = 1
""")
def control_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: the two lists shown after a batch: failed controls and dirty blanks."""
    d = _decided(spark, sf_dir)
    fn_df, fp_df = qc.control_lists(d, ["sample_name", "peak_name", "area"])
    return fn_df.select(F.lit("failed_control").alias("list"), "*").unionByName(
        fp_df.select(F.lit("dirty_blank").alias("list"), "*"))


@register("review_list", BATCH_DECISIONS_SQL + """
SELECT sample_name, peak_name FROM flags WHERE sample_pred = 1
""")
def review_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown samples predicted positive."""
    return qc.review_list(_decided(spark, sf_dir), ["sample_name", "peak_name"])


@register("cumulative_profit", BATCH_DECISIONS_SQL + """
, prof AS (
  SELECT row_id, strptime(acquired, '%-m/%-d/%Y %-I:%M:%S %p') AS acquired_at,
         CAST(sample_pred AS BIGINT) * 50
           - CAST(CASE WHEN false_neg = 1 AND area > 0 THEN 1 ELSE 0 END AS BIGINT) * 10000 AS profit_cents
  FROM flags
)
SELECT row_id, profit_cents,
       CAST(sum(profit_cents) OVER (ORDER BY acquired_at, row_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS profit_total_cents
FROM prof
""")
def cumulative_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running profit over acquisition time (second resolution, ties by id)."""
    d = _decided(spark, sf_dir).withColumn("acquired_at", fd.parse_acquisition("acquired"))
    p = qc.add_profit(d, area="area")
    out = qc.cumulative_profit(p.select("row_id", "acquired_at", "profit_cents"))
    return out.select("row_id", "profit_cents", "profit_total_cents")


@register("cumulative_misses", f"""
WITH {EVENTS_BATCH_SQL.strip()},
fl AS (
  SELECT row_id, event_type, probs,
         CAST(CASE WHEN (CASE WHEN probs < 0.4 THEN 0 ELSE 1 END) = 0 AND reported = 1 THEN 1 ELSE 0 END
              AS INTEGER) AS fn
  FROM events_batch
)
SELECT row_id, event_type, fn,
       CAST(sum(fn) OVER (PARTITION BY event_type ORDER BY probs, row_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS fn_count
FROM fl
""")
def cumulative_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running count of misses per group by ascending score."""
    b = events_batch(spark, sf_dir)
    flags = fd.error_flags("probs", "reported", 0.4)
    fl = b.select("row_id", "event_type", "probs", flags["fn"].alias("fn"))
    out = qc.cumulative_misses(fl, group="event_type", score="probs", row_id="row_id")
    return out.select("row_id", "event_type", "fn", "fn_count")


@register("error_lists", f"""
WITH {EVENTS_BATCH_SQL.strip()},
fl AS (
  SELECT row_id, reported,
         CASE WHEN probs < 0.55 THEN 0 ELSE 1 END AS preds
  FROM events_batch
),
info AS (SELECT row_id, sample_name, event_type FROM events_batch)
SELECT 'fp' AS list, i.row_id, i.sample_name, i.event_type FROM info i
 WHERE i.row_id IN (SELECT row_id FROM fl WHERE preds = 1 AND reported = 0)
UNION ALL
SELECT 'fn' AS list, i.row_id, i.sample_name, i.event_type FROM info i
 WHERE i.row_id IN (SELECT row_id FROM fl WHERE preds = 0 AND reported = 1)
""")
def error_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False-positive and false-negative lists by semi join on the row id."""
    b = events_batch(spark, sf_dir)
    scored = b.select("row_id", "reported", F.col("probs").alias("probas"))
    info = b.select("row_id", "sample_name", "event_type")
    fp, fn, _full = lb.incorrect_classifications(scored, info, 0.55)
    return fp.select(F.lit("fp").alias("list"), "*").unionByName(
        fn.select(F.lit("fn").alias("list"), "*"))


@register("class_pivot", """
SELECT d.lang,
       CAST(CASE WHEN count_if(coalesce(l.quality, 0) = 0) > 0
                 THEN count(CASE WHEN coalesce(l.quality, 0) = 0 THEN d.source END) END AS BIGINT) AS n_0,
       CAST(CASE WHEN count_if(coalesce(l.quality, 0) <> 0) > 0
                 THEN count(CASE WHEN coalesce(l.quality, 0) <> 0 THEN d.source END) END AS BIGINT) AS n_1,
       CAST(CASE WHEN count_if(coalesce(l.quality, 0) = 0) > 0
                 THEN count(CASE WHEN coalesce(l.quality, 0) = 0 THEN d.source END) END
          + CASE WHEN count_if(coalesce(l.quality, 0) <> 0) > 0
                 THEN count(CASE WHEN coalesce(l.quality, 0) <> 0 THEN d.source END) END AS BIGINT) AS total
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
GROUP BY d.lang
""")
def class_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: per-group counts by class, total, sorted by total descending."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    reports = load(spark, sf_dir, "labels").select("doc_id", "quality")
    labelled = lb.merge_reports(docs, reports, ["doc_id"], ["doc_id"], result="quality")
    return ev.class_pivot(labelled, group="lang", cls="reported", count_col="source")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every registered query (imports the ML and streaming catalogues too)."""
    _load_extensions()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    _load_extensions()
    return dict(SQL)


def _load_extensions() -> None:
    from peakscreen.plans import catalog_certificates, catalog_eval, catalog_files, catalog_jobs, catalog_ml, catalog_tables  # noqa: F401
