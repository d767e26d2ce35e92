"""Registered evaluation, linear-algebra, sampling and quality queries (stage 3-4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakscreen.operators import evaluation as ev
from peakscreen.operators import linalg as la
from peakscreen.operators import quality as qa
from peakscreen.operators import sampling as sm
from peakscreen.plans.catalog import r6, register
from peakscreen.plans.views import (EVENTS_BATCH_SQL, LINEITEM_SCORES_SQL, events_batch, load,
                                    lineitem_scores)

EB = EVENTS_BATCH_SQL.strip()
LS = LINEITEM_SCORES_SQL.strip()


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_batch(spark, sf_dir).select("row_id", "event_type", "reported",
                                              F.col("probs").alias("probas"))


def _cm_sql(t: float) -> str:
    return f"""
SELECT CAST({t} AS DOUBLE) AS threshold, tp, fp, fn, tn,
       round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 6) AS precision,
       round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 6) AS recall,
       round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1
FROM (SELECT CAST(count_if(probs >= {t} AND reported = 1) AS BIGINT) AS tp,
             CAST(count_if(probs >= {t} AND reported <> 1) AS BIGINT) AS fp,
             CAST(count_if(NOT (probs >= {t}) AND reported = 1) AS BIGINT) AS fn,
             CAST(count_if(NOT (probs >= {t}) AND reported <> 1) AS BIGINT) AS tn
      FROM events_batch)"""


@register("confusion", f"WITH {EB}\n" + "\nUNION ALL".join(_cm_sql(t) for t in (0.4, 0.55)))
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3/A4: confusion counts and precision/recall/F1 at two thresholds (score >= t)."""
    cm = ev.confusion_at(_scored(spark, sf_dir), [0.4, 0.55], "probas", "reported")
    return cm.select("threshold", "tp", "fp", "fn", "tn", r6("precision").alias("precision"),
                     r6("recall").alias("recall"), r6("f1").alias("f1"))


@register("confusion_bars", f"""WITH {EB},
cm AS (SELECT CAST(count_if(probs >= 0.55 AND reported = 1) AS BIGINT) AS tp,
              CAST(count_if(probs >= 0.55 AND reported <> 1) AS BIGINT) AS fp,
              CAST(count_if(NOT (probs >= 0.55) AND reported = 1) AS BIGINT) AS fn,
              CAST(count_if(NOT (probs >= 0.55) AND reported <> 1) AS BIGINT) AS tn FROM events_batch)
SELECT 'should be reported' AS bar, tp AS correct, fp AS incorrect FROM cm
UNION ALL SELECT 'should not be reported', tn, fn FROM cm
""")
def confusion_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion-plot bars (per predicted class, as the chart stacks them)."""
    return ev.confusion_bars(ev.confusion_counts(_scored(spark, sf_dir), "probas", "reported", 0.55))


SWEEP_SQL = f"""WITH {EB},
grid AS (SELECT CAST(i AS INTEGER) AS i,
                CASE WHEN i = 50 THEN 1.0 ELSE CAST(i AS DOUBLE) * CAST(0.02 AS DOUBLE) END AS threshold
         FROM range(0, 51) t(i)),
c AS (SELECT g.i, g.threshold,
             CAST(count_if(b.probs >= g.threshold AND b.reported = 1) AS BIGINT) AS tp,
             CAST(count_if(b.probs >= g.threshold AND b.reported <> 1) AS BIGINT) AS fp,
             CAST(count_if(NOT (b.probs >= g.threshold) AND b.reported = 1) AS BIGINT) AS fn,
             CAST(count_if(NOT (b.probs >= g.threshold) AND b.reported <> 1) AS BIGINT) AS tn
      FROM grid g CROSS JOIN events_batch b GROUP BY g.i, g.threshold),
s AS (SELECT i, threshold, tp, fp, fn, tn,
             CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1 FROM c)
"""


@register("threshold_sweep", SWEEP_SQL + """
SELECT i, round(threshold, 6) AS threshold, tp, fp, fn, tn, round(f1, 6) AS f1 FROM s
""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: confusion counts and F1 on the 51-point grid, one pass over the rows."""
    sw = ev.threshold_sweep(_scored(spark, sf_dir), "probas", "reported", 51)
    return sw.select("i", r6("threshold").alias("threshold"), "tp", "fp", "fn", "tn",
                     r6("f1").alias("f1"))


@register("best_threshold", SWEEP_SQL + """
SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM s
ORDER BY f1 DESC, threshold ASC LIMIT 1
""")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: the lowest threshold reaching the best F1 (a top-1 report)."""
    sw = ev.threshold_sweep(_scored(spark, sf_dir), "probas", "reported", 51)
    return ev.best_threshold(sw).select(r6("threshold").alias("threshold"), r6("f1").alias("f1"))


@register("class_report", f"""WITH {EB},
cm AS (SELECT CAST(count_if(probs >= 0.5 AND reported = 1) AS DOUBLE) AS tp,
              CAST(count_if(probs >= 0.5 AND reported <> 1) AS DOUBLE) AS fp,
              CAST(count_if(NOT (probs >= 0.5) AND reported = 1) AS DOUBLE) AS fn,
              CAST(count_if(NOT (probs >= 0.5) AND reported <> 1) AS DOUBLE) AS tn FROM events_batch),
m AS (SELECT *,
        CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p1,
        CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS r1,
        CASE WHEN tn + fn = 0 THEN 0.0 ELSE tn / (tn + fn) END AS p0,
        CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END AS r0,
        CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1,
        CASE WHEN 2 * tn + fn + fp = 0 THEN 0.0 ELSE 2 * tn / (2 * tn + fn + fp) END AS f0,
        tp + fn AS s1, tn + fp AS s0, tp + fp + fn + tn AS n FROM cm)
SELECT '0' AS class, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1_score,
       round(s0, 6) AS support FROM m
UNION ALL SELECT '1', round(p1, 6), round(r1, 6), round(f1, 6), round(s1, 6) FROM m
UNION ALL SELECT 'accuracy', round((tp + tn) / n, 6), round((tp + tn) / n, 6), round((tp + tn) / n, 6),
                 round((tp + tn) / n, 6) FROM m
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6),
                 round(n, 6) FROM m
UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / n, 6), round((r0 * s0 + r1 * s1) / n, 6),
                 round((f0 * s0 + f1 * s1) / n, 6), round(n, 6) FROM m
""")
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-class precision/recall/F1/support, accuracy, macro and weighted averages."""
    rep = ev.class_report(_scored(spark, sf_dir), "probas", "reported", 0.5)
    return rep.select("class", *[r6(c).alias(c) for c in ("precision", "recall", "f1_score", "support")])


ROC_SQL = f"""WITH {LS},
pts AS (SELECT probas AS threshold, CAST(count_if(reported = 1) AS BIGINT) AS pos,
               CAST(count_if(reported <> 1) AS BIGINT) AS neg
        FROM lineitem_scores WHERE probas IS NOT NULL GROUP BY probas),
tot AS (SELECT CAST(sum(pos) AS DOUBLE) AS p, CAST(sum(neg) AS DOUBLE) AS n FROM pts),
roc AS (SELECT threshold,
               CAST(sum(neg) OVER w AS BIGINT) AS fps, CAST(sum(pos) OVER w AS BIGINT) AS tps
        FROM pts WINDOW w AS (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
rates AS (SELECT threshold, fps, tps, fps / n AS fpr, tps / p AS tpr, p, n FROM roc, tot)
"""


@register("roc_points", ROC_SQL + """
SELECT threshold, fps, tps, fpr, tpr FROM rates
""")
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROC point per distinct score (about one per row here), distributed running totals."""
    roc = ev.roc_points(lineitem_scores(spark, sf_dir), "probas", "reported")
    # Exact counts and IEEE divisions: both engines produce the same doubles, no rounding needed.
    return roc.select("threshold", "fps", "tps", "fpr", "tpr")


def _profit_sql(mode: str, scale: str) -> str:
    return f"""
SELECT '{mode}' AS mode, threshold, fpr2 AS fpr_adj, tpr,
       fpr2 * 0.0 + tpr * 0.0 + (1.0 - tpr) * -1.0 + tnr2 * 0.5 AS profit
FROM (SELECT threshold, tpr,
             (fpr * {scale}) / (((1.0 - fpr) * {scale} + 27445.0) + fpr * {scale}) AS fpr2,
             ((1.0 - fpr) * {scale} + 27445.0) / (((1.0 - fpr) * {scale} + 27445.0) + fpr * {scale}) AS tnr2
      FROM (SELECT 1.0 AS threshold, 0.0 AS fpr, 0.0 AS tpr, (SELECT p FROM tot) AS p, (SELECT n FROM tot) AS n
            UNION ALL SELECT threshold, fpr, tpr, p, n FROM rates))"""


@register("best_profit", ROC_SQL + "\nSELECT threshold, round(profit, 6) AS profit FROM (" + _profit_sql("corrected", "n")
          + ") ORDER BY profit DESC, threshold DESC LIMIT 1")
def best_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best point of the profit curve, by bounds on blocks of scores instead of the curve."""
    best = ev.best_profit(lineitem_scores(spark, sf_dir), "probas", "reported")
    return best.select("threshold", r6("profit").alias("profit"))


@register("profit_curve", ROC_SQL + _profit_sql("corrected", "n") + "\nUNION ALL" + _profit_sql("parity", "p"))
def profit_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profit per sample along the ROC curve, corrected and historical formulas stacked."""
    scored = lineitem_scores(spark, sf_dir)
    tot = scored.agg(F.count_if(F.col("reported") == 1).alias("p"),
                     F.count_if(F.col("reported") != 1).alias("n")).first()
    roc = ev.roc_points(scored, "probas", "reported").cache()   # shared by both curves
    curves = [(mode, ev.profit_curve(roc, int(tot["p"]), int(tot["n"]), parity=(mode == "parity")))
              for mode in ("corrected", "parity")]
    st = ev.stack_curves(curves, "mode")
    return st.select("mode", "threshold", "fpr_adj", "tpr", "profit")


@register("score_histogram", f"""WITH {EB},
st AS (SELECT event_type, reported,
              CASE WHEN min(probs) = max(probs) THEN min(probs) - 0.5 ELSE min(probs) END AS lo,
              CASE WHEN min(probs) = max(probs) THEN max(probs) + 0.5 ELSE max(probs) END AS hi
       FROM events_batch WHERE probs IS NOT NULL GROUP BY event_type, reported),
b0 AS (SELECT b.event_type, b.reported, b.probs AS x, st.lo, st.hi,
              CAST(floor((b.probs - st.lo) * (CAST(10 AS DOUBLE) / (st.hi - st.lo))) AS INTEGER) AS b
       FROM events_batch b JOIN st ON b.event_type = st.event_type AND b.reported = st.reported
       WHERE b.probs IS NOT NULL),
b1 AS (SELECT *, CASE WHEN b >= 10 THEN 9 ELSE b END AS c1 FROM b0),
b2 AS (SELECT *, CASE WHEN x < (CASE WHEN c1 = 10 THEN hi ELSE CAST(c1 AS DOUBLE) * ((hi - lo) / CAST(10 AS DOUBLE)) + lo END)
                      THEN c1 - 1 ELSE c1 END AS c2 FROM b1),
b3 AS (SELECT *, CASE WHEN x >= (CASE WHEN c2 + 1 = 10 THEN hi ELSE CAST(c2 + 1 AS DOUBLE) * ((hi - lo) / CAST(10 AS DOUBLE)) + lo END)
                       AND c2 <> 9 THEN c2 + 1 ELSE c2 END AS bin FROM b2)
SELECT event_type, reported, bin, CAST(count(*) AS BIGINT) AS n,
       round(min(CASE WHEN bin = 10 THEN hi ELSE CAST(bin AS DOUBLE) * ((hi - lo) / CAST(10 AS DOUBLE)) + lo END), 6) AS bin_lo,
       round(min(CASE WHEN bin + 1 = 10 THEN hi ELSE CAST(bin + 1 AS DOUBLE) * ((hi - lo) / CAST(10 AS DOUBLE)) + lo END), 6) AS bin_hi
FROM b3 GROUP BY event_type, reported, bin
""")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10-bin score histograms per (group, true class)."""
    h = ev.score_histogram(_scored(spark, sf_dir), "probas", "event_type", "reported", 10)
    return h.select("event_type", "reported", "bin", F.col("n").cast("long").alias("n"),
                    r6("bin_lo").alias("bin_lo"), r6("bin_hi").alias("bin_hi"))


CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("corr_matrix", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM lineitem"
    for a in CORR_COLS for b in CORR_COLS))
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: Pearson correlation of every column pair, long form, one aggregate pass."""
    li = load(spark, sf_dir, "lineitem")
    return la.correlation_long(li, CORR_COLS).select("col_a", "col_b", r6("corr").alias("corr"))


VIF_COLS = ["l_quantity", "l_extendedprice", "l_tax"]


@register("vif", """
WITH g AS (
  SELECT sum(l_quantity * l_quantity) AS aa, sum(l_extendedprice * l_extendedprice) AS bb,
         sum(l_tax * l_tax) AS cc, sum(l_quantity * l_extendedprice) AS ab,
         sum(l_quantity * l_tax) AS ac, sum(l_extendedprice * l_tax) AS bc
  FROM lineitem),
d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM g)
SELECT 'l_quantity' AS feature, round(aa * (bb * cc - bc * bc) / det, 6) AS vif FROM d
UNION ALL SELECT 'l_extendedprice', round(bb * (aa * cc - ac * ac) / det, 6) FROM d
UNION ALL SELECT 'l_tax', round(cc * (aa * bb - ab * ab) / det, 6) FROM d
""")
def vif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance inflation factors from one Gram-matrix aggregate."""
    li = load(spark, sf_dir, "lineitem")
    return la.vif(li, VIF_COLS).select("feature", r6("vif").alias("vif"))


@register("minmax_rescale", """
SELECT l_orderkey, l_linenumber,
       round((l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()), 6)
         AS l_quantity_scaled,
       round((l_extendedprice - min(l_extendedprice) OVER ())
             / (max(l_extendedprice) OVER () - min(l_extendedprice) OVER ()), 6) AS l_extendedprice_scaled
FROM lineitem
""")
def minmax_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Min-max rescale of two components."""
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                                "l_extendedprice")
    out = ev.minmax_rescale(li, ["l_quantity", "l_extendedprice"])
    return out.select("l_orderkey", "l_linenumber", r6("l_quantity_scaled").alias("l_quantity_scaled"),
                      r6("l_extendedprice_scaled").alias("l_extendedprice_scaled"))


@register("standardize", """
SELECT l_orderkey, l_linenumber,
       round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS z_quantity,
       round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), 6)
         AS z_extendedprice
FROM lineitem
""")
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: z-scores with the population standard deviation."""
    from peakscreen.operators.modeling import standardize as z
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                                "l_extendedprice")
    out = z(li, ["l_quantity", "l_extendedprice"], prefix="z_")
    return out.select("l_orderkey", "l_linenumber", r6("z_l_quantity").alias("z_quantity"),
                      r6("z_l_extendedprice").alias("z_extendedprice"))


RANK_SQL = """
c AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality),
r AS (SELECT doc_id, quality,
             row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id) AS rk
      FROM labels)"""


@register("stratified_split", f"""WITH {RANK_SQL},
t AS (SELECT sum(n) AS total, CAST(ceil(CAST(0.33 AS DOUBLE) * sum(n)) AS BIGINT) AS n_test FROM c),
a AS (SELECT quality, (n_test * n) // total AS base, (n_test * n) % total AS rem, n_test FROM c, t),
l AS (SELECT max(n_test) - sum(base) AS leftover FROM a),
alloc AS (SELECT quality,
                 base + CASE WHEN row_number() OVER (ORDER BY rem DESC, quality) <= leftover THEN 1 ELSE 0 END
                   AS need FROM a, l)
SELECT r.doc_id, r.quality, CASE WHEN r.rk <= alloc.need THEN 'test' ELSE 'train' END AS split
FROM r JOIN alloc ON r.quality = alloc.quality
""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: stratified 33 % test split in seeded hash order."""
    lab = load(spark, sf_dir, "labels").select("doc_id", "quality")
    return sm.stratified_split(lab, "quality", "doc_id", 0.33, 42)


@register("under_sample", f"""WITH {RANK_SQL}
SELECT doc_id, quality FROM r WHERE rk <= (SELECT min(n) FROM c)
""")
def under_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: every class reduced to the minority size."""
    lab = load(spark, sf_dir, "labels").select("doc_id", "quality")
    return sm.under_sample(lab, "quality", "doc_id", 42)


@register("folds", f"""WITH {RANK_SQL}
SELECT doc_id, quality, CAST((rk - 1) % 5 AS INTEGER) AS fold FROM r
""")
def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: stratified 5 folds from per-class hash rank."""
    lab = load(spark, sf_dir, "labels").select("doc_id", "quality")
    return sm.stratified_folds(lab, "quality", "doc_id", 5, 42)


@register("over_sample", f"""WITH {RANK_SQL},
mx AS (SELECT max(n) AS nmax FROM c),
d0 AS (SELECT quality, n, unnest(range(0, nmax - n)) AS j FROM c, mx WHERE nmax > n),
d AS (SELECT quality, j AS copy_no,
             CAST(('0x' || substr(md5(CAST(j AS VARCHAR) || '|' || CAST(quality AS VARCHAR) || '|42'), 1, 15))
                  AS BIGINT) % n + 1 AS rk FROM d0)
SELECT doc_id, quality, CAST(-1 AS BIGINT) AS copy_no FROM labels
UNION ALL
SELECT r.doc_id, r.quality, d.copy_no FROM d JOIN r ON d.quality = r.quality AND d.rk = r.rk
""")
def over_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: draws with replacement up to the majority size, deterministic under the seed."""
    lab = load(spark, sf_dir, "labels").select("doc_id", "quality")
    return sm.over_sample(lab, "quality", "doc_id", 42)


@register("expectations", f"""WITH {EB},
a AS (SELECT CAST(count(*) AS BIGINT) AS n,
             CAST(count_if(sample_name IS NULL) AS BIGINT) AS u0,
             CAST(count_if(reported IS NOT NULL AND reported NOT IN (0, 1)) AS BIGINT) AS u1,
             CAST(count_if(reported IS NULL OR reported <> 1) AS BIGINT) AS u2,
             CAST(count_if(sample_name IS NOT NULL AND NOT regexp_matches(sample_name, 'S[0-9]{{2}}')) AS BIGINT) AS u3,
             CAST(count_if(rt IS NOT NULL AND NOT (rt BETWEEN 0 AND 90)) AS BIGINT) AS u4,
             CAST(count_if(event_type IS NOT NULL AND event_type NOT IN ('click', 'purchase', 'signup', 'view'))
                  AS BIGINT) AS u5
      FROM events_batch)
SELECT 'sample_name not null' AS expectation, u0 AS unexpected, n AS total,
       round(CASE WHEN n = 0 THEN 0.0 ELSE CAST(u0 AS DOUBLE) * 100.0 / n END, 6) AS pct, n - u0 >= n AS passed FROM a
UNION ALL SELECT 'reported in set', u1, n, round(CAST(u1 AS DOUBLE) * 100.0 / n, 6), n - u1 >= n FROM a
UNION ALL SELECT 'reported = 1 for at least 1%', u2, n, round(CAST(u2 AS DOUBLE) * 100.0 / n, 6),
                 n - u2 >= 0.01 * n FROM a
UNION ALL SELECT 'sample_name matches S[0-9]{{2}}', u3, n, round(CAST(u3 AS DOUBLE) * 100.0 / n, 6), n - u3 >= n FROM a
UNION ALL SELECT 'rt between 0 and 90', u4, n, round(CAST(u4 AS DOUBLE) * 100.0 / n, 6), n - u4 >= n FROM a
UNION ALL SELECT 'event_type in set', u5, n, round(CAST(u5 AS DOUBLE) * 100.0 / n, 6), n - u5 >= n FROM a
""")
def expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1: six data-quality checks in one aggregate pass."""
    b = events_batch(spark, sf_dir)
    suite = [qa.not_null("sample_name"), qa.in_set("reported", [0, 1]),
             qa.share_at_least("reported", 1, 0.01), qa.matches("sample_name", "S[0-9]{2}"),
             qa.between("rt", 0, 90), qa.in_set("event_type", ["click", "purchase", "signup", "view"])]
    res = qa.run_suite(b, suite)
    return res.select("expectation", "unexpected", "total", r6("pct").alias("pct"), "passed")


@register("union_batches", """
SELECT event_id, ts, value FROM events WHERE ts < TIMESTAMP '2024-01-16 00:00:00'
UNION ALL BY NAME
SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-16 00:00:00'
""")
def union_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches with different column sets concatenated by name, gaps as null."""
    from peakscreen.sources.instrument import union_batches as ub
    evs = load(spark, sf_dir, "events")
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    first = evs.where(F.col("ts") < cut).select("event_id", "ts", "value")
    second = evs.where(F.col("ts") >= cut).select("event_id", "ts", "event_type")
    return ub([first, second])



@register("random_split", """
WITH r AS (SELECT doc_id, quality,
                  row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id) AS rk
           FROM labels),
t AS (SELECT CAST(ceil(CAST(0.33 AS DOUBLE) * count(*)) AS BIGINT) AS n_test FROM labels)
SELECT doc_id, quality, CASE WHEN rk <= n_test THEN 'test' ELSE 'train' END AS split FROM r, t
""")
def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: unstratified 33 % split, the first rows in seeded hash order are test."""
    lab = load(spark, sf_dir, "labels").select("doc_id", "quality")
    return sm.random_split(lab, "doc_id", 0.33, 42)


LEARNING_FRACTIONS = (0.4, 0.7, 1.0)


@register("learning_subsets", f"""WITH {RANK_SQL}
SELECT r.doc_id, r.quality,
       CAST(CASE WHEN r.rk <= ceil(CAST(0.4 AS DOUBLE) * c.n) THEN 0
                 WHEN r.rk <= ceil(CAST(0.7 AS DOUBLE) * c.n) THEN 1
                 WHEN r.rk <= ceil(CAST(1.0 AS DOUBLE) * c.n) THEN 2 END AS INTEGER) AS subset
FROM r JOIN c ON r.quality = c.quality
""")
def learning_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: nested per-class training subsets (40 %, 70 %, 100 %) of the learning curve."""
    lab = load(spark, sf_dir, "labels").select("doc_id", "quality")
    return sm.nested_subsets(lab, "quality", "doc_id", LEARNING_FRACTIONS, 42)


@register("single_analyte", """
SELECT event_id, value, 1 AS event_type_view FROM events WHERE event_type = 'view'
""")
def single_analyte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one analyte (here one event type) with its constant dummy column."""
    from peakscreen.operators.features import single_analyte as sa
    evs = load(spark, sf_dir, "events").select("event_id", "value", "event_type")
    return sa(evs, "view", col="event_type")


@register("rounded_f1_loss", f"""WITH {EB},
p AS (SELECT reported, round_even(probs, 0) >= 1 AS pred FROM events_batch),
c AS (SELECT CAST(count_if(pred AND reported = 1) AS DOUBLE) AS tp,
             CAST(count_if(pred AND reported <> 1) AS DOUBLE) AS fp,
             CAST(count_if(NOT pred AND reported = 1) AS DOUBLE) AS fn FROM p)
SELECT round(1.0 - CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS loss
FROM c
""")
def rounded_f1_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 - F1 of scores rounded half to even (a score of exactly 0.5 counts as 0)."""
    loss = ev.rounded_f1_loss(_scored(spark, sf_dir), "probas", "reported")
    return spark.createDataFrame([(round(loss, 6),)], "loss double")
