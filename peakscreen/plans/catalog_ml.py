"""Registered model, search and resampling queries (rows-only checks: no SQL oracle).

The modelling table is lineitem joined with part: numeric measurements plus a
one-hot part type, label = return flag 'R'. Splits and resampling are the
hash-ordered operators, so every query is deterministic.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakscreen.operators import evaluation as ev
from peakscreen.operators import features as fe
from peakscreen.operators import linalg as la
from peakscreen.operators import modeling as md
from peakscreen.operators import sampling as sm
from peakscreen.operators import search as sr
from peakscreen.plans.catalog import r6, register
from peakscreen.plans.views import load
from peakscreen.session import ensure_checkpoint_dir

# The part-type vocabulary used as the one-hot "analyte" column.
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
CONTINUOUS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size", "p_retailprice"]

def lineitem_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature table: row_id, 6 continuous features, 6 one-hot part types, label ``reported``."""
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                                "l_quantity", "l_extendedprice", "l_discount",
                                                "l_tax", "l_returnflag")
    part = load(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice",
                                              F.col("p_type").alias("analyte"))
    j = li.join(part, li.l_partkey == part.p_partkey)
    base = j.select((F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("row_id"),
                    *[F.col(c).cast("double").alias(c) for c in CONTINUOUS], "analyte",
                    F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("reported"))
    return fe.one_hot(base, "analyte", PART_TYPES).na.fill(0)


def feature_names(df: DataFrame) -> list[str]:
    return fe.feature_columns(df, "reported", ("row_id",))


def _splits(spark: SparkSession, sf_dir: str):
    feats = lineitem_features(spark, sf_dir)
    split = sm.stratified_split(feats, "reported", "row_id", 0.33, 42).cache()
    train = split.where(F.col("split") == "train").drop("split")
    test = split.where(F.col("split") == "test").drop("split")
    return feats, train, test


def _scores_query(kind: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        feats, train, test = _splits(spark, sf_dir)
        train_us = sm.under_sample(train, "reported", "row_id", 42)
        fm = md.fit_model(train_us, feature_names(feats), kind)
        s = md.score(fm, test)
        return s.select("row_id", "reported", r6("probas").alias("probas"),
                        F.when(F.col("probas") >= 0.5, 1).otherwise(0).alias("prediction"))
    q.__doc__ = f"L2-L5/L10/F21: {kind} on the under-sampled train split, scored on the test split."
    return q


for _kind, _name in [("logistic", "logistic_scores"), ("forest", "forest_scores"),
                     ("boosting", "gbt_scores"), ("mlp", "mlp_scores"), ("network", "network_scores")]:
    register(_name)(_scores_query(_kind))


@register("lasso_path")
def lasso_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lasso coefficients for 50 penalties from one Gram aggregate."""
    feats = lineitem_features(spark, sf_dir)
    return la.lasso_path(feats, feature_names(feats), "reported")


@register("pca_scree")
def pca_scree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explained variance (percent) of 4 components of the embeddings."""
    emb = _embedding_table(spark, sf_dir)
    cols = [c for c in emb.columns if c.startswith("e")]
    ratios, _ = md.pca_summary(emb, cols, 4)
    return spark.createDataFrame([(i + 1, r) for i, r in enumerate(ratios)],
                                 "component int, explained_pct double")


@register("pca_points")
def pca_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2-D projection of the embeddings, min-max rescaled."""
    emb = _embedding_table(spark, sf_dir)
    cols = [c for c in emb.columns if c.startswith("e")]
    _, pts = md.pca_summary(emb, cols, 2)
    return ev.minmax_rescale(pts, ["pc1", "pc2"])


def _embedding_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = load(spark, sf_dir, "embeddings")
    dim = len(emb.select("embedding").first()[0])
    return emb.select(F.col("vec_id").alias("row_id"), "label",
                      *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(dim)])


SMOTE_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN label = 0 THEN 1 ELSE 0 END AS reported,
                  CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
c AS (SELECT reported, count(*) AS n FROM e GROUP BY reported),
mc AS (SELECT reported AS cls, n AS n_min FROM c ORDER BY n, reported LIMIT 1),
mx AS (SELECT max(n) AS n_max FROM c),
m AS (SELECT e.vec_id, e.vec FROM e JOIN mc ON e.reported = mc.cls),
ranked AS (SELECT vec_id, vec,
                  row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR) || '|42'), vec_id) AS rk FROM m),
nb AS (SELECT a.vec_id, b.vec_id AS nb_id,
              row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.vec, b.vec), b.vec_id) - 1
                AS nb_rank
       FROM m a JOIN m b ON a.vec_id <> b.vec_id),
draws AS (
  SELECT j,
         CAST(('0x' || substr(md5(CAST(j AS VARCHAR) || '|base|42'), 1, 15)) AS BIGINT) % n_min + 1 AS rk,
         CAST(('0x' || substr(md5(CAST(j AS VARCHAR) || '|nb|42'), 1, 15)) AS BIGINT) % 5 AS nb_rank,
         CAST(CAST(('0x' || substr(md5(CAST(j AS VARCHAR) || '|lam|42'), 1, 15)) AS BIGINT) % 1073741824
              AS DOUBLE) / 1073741824.0 AS lam
  FROM (SELECT unnest(range(0, n_max - n_min)) AS j, n_min FROM mc, mx)),
syn AS (
  SELECT -(d.j + 1) AS vec_id, (SELECT cls FROM mc) AS reported,
         list_transform(range(1, len(r.vec) + 1), lambda i: r.vec[i] + d.lam * (m2.vec[i] - r.vec[i])) AS vec
  FROM draws d JOIN ranked r ON d.rk = r.rk
       JOIN nb ON nb.vec_id = r.vec_id AND nb.nb_rank = d.nb_rank
       JOIN m m2 ON m2.vec_id = nb.nb_id)
SELECT vec_id, reported, false AS synthetic,
       round(list_sum(list_transform(vec, lambda x: x * x)), 6) AS sq_norm FROM e
UNION ALL
SELECT vec_id, reported, true AS synthetic,
       round(list_sum(list_transform(vec, lambda x: x * x)), 6) AS sq_norm FROM syn
"""


@register("smote", SMOTE_SQL)
def smote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: synthetic rows for label 0 against the rest of the embeddings (exact 5-NN)."""
    emb = load(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(F.col("label") == 0, 1).otherwise(0).alias("reported"),
        F.col("embedding").cast("array<double>").alias("vec"))
    out = sm.smote(emb, "reported", "vec_id", "vec", k=5, seed=42)
    return out.select("vec_id", "reported", "synthetic",
                      r6(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("sq_norm"))


def _compared(spark: SparkSession, sf_dir: str):
    feats, train, test = _splits(spark, sf_dir)
    inner = sm.stratified_split(train, "reported", "row_id", 0.25, 7).cache()
    fit_part = sm.under_sample(inner.where(F.col("split") == "train").drop("split"),
                               "reported", "row_id", 42)
    valid = inner.where(F.col("split") == "test").drop("split")
    table, fitted = md.compare_models(["logistic", "forest", "boosting"], fit_part, valid, test, feature_names(feats))
    return table, fitted, test


@register("model_comparison")
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three model families; threshold picked on a validation split, F1 and AUC on test, and the class report."""
    table, fitted, test = _compared(spark, sf_dir)
    report = md.comparison_reports(fitted, test)
    rows = report.groupBy("model").agg(*[
        F.max(F.when(F.col("class") == c, F.col(m))).alias(f"{m}_{c}") for c in ("0", "1") for m in ("precision", "recall", "f1_score", "support")])
    return table.join(rows, "model")


@register("profit_by_model")
def profit_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profit curves of logistic regression and boosting on the same test rows."""
    feats, train, test = _splits(spark, sf_dir)
    rows = sm.under_sample(train, "reported", "row_id", 42)
    fitted = [md.fit_model(rows, feature_names(feats), kind) for kind in ("logistic", "boosting")]
    return md.profit_by_model(fitted, test).select("model", "threshold", r6("fpr_adj").alias("fpr_adj"), "tpr", r6("profit").alias("profit"))


@register("profit_by_sampling")
def profit_by_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profit curves of one model trained on under-, over-, SMOTE- and un-sampled data."""
    feats, train, test = _splits(spark, sf_dir)
    names = feature_names(feats)
    with_vec = train.select("row_id", "reported", F.array(*[F.col(c) for c in names]).alias("vec"))
    smoted = sm.smote(with_vec, "reported", "row_id", "vec", k=5, seed=42).select(
        "row_id", "reported", *[F.col("vec")[i].alias(c) for i, c in enumerate(names)])
    methods = {"under": sm.under_sample(train, "reported", "row_id", 42),
               "over": sm.over_sample(train, "reported", "row_id", 42).drop("copy_no"),
               "smote": smoted,
               "none": train}
    curves = md.profit_by_sampling(methods, test, names, kind="logistic")
    return curves.select("sampling", "threshold", r6("fpr_adj").alias("fpr_adj"), "tpr",
                         r6("profit").alias("profit"))


@register("random_search")
def random_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 draws x 5 folds of three model families, one row per trial, from the trial table."""
    feats, train, _ = _splits(spark, sf_dir)
    train_us = sm.under_sample(train, "reported", "row_id", 42)
    path = f"{ensure_checkpoint_dir(spark)}/trials-{uuid.uuid4().hex}"
    trials = sr.best_trials(sr.search(train_us, feature_names(feats), path))
    return trials.select("family", "trial", "params", "mean_f1", "std_f1", "best")


@register("network_search")
def network_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 draws x 5 folds of the network's space, one row per trial, from the trial table."""
    feats, train, _ = _splits(spark, sf_dir)
    train_us = sm.under_sample(train, "reported", "row_id", 42)
    path = f"{ensure_checkpoint_dir(spark)}/trials-{uuid.uuid4().hex}"
    trials = sr.best_trials(sr.search(train_us, feature_names(feats), path, families=("network",)))
    return trials.select("family", "trial", "params", "mean_f1", "std_f1", "best")


@register("gbt_early_stop")
def gbt_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean PR-AUC of every boosting round over 3 folds, up to 50 rounds without a gain (at most 5,000)."""
    feats, train, _ = _splits(spark, sf_dir)
    return sr.rounds_by_patience(sm.under_sample(train, "reported", "row_id", 42), feature_names(feats))


PR_AUC_SQL = """
WITH s AS (SELECT l_linestatus AS grp, CAST(l_quantity AS DOUBLE) / 50 AS score,
                  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem),
d AS (SELECT grp, score, sum(y) AS p, count(*) AS n FROM s GROUP BY grp, score),
c AS (SELECT grp, p, sum(p) OVER w AS tp, sum(n) OVER w AS k FROM d
      WINDOW w AS (PARTITION BY grp ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT grp, round(sum(p * CAST(tp AS DOUBLE) / k) / sum(p), 6) AS pr_auc FROM c GROUP BY grp
"""


@register("pr_auc", PR_AUC_SQL)
def pr_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the precision-recall curve per group of scored rows."""
    scored = load(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("grp"), (F.col("l_quantity").cast("double") / 50).alias("score"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"))
    return sr.pr_auc(scored, ["grp"], "score", "y").select("grp", r6("pr_auc").alias("pr_auc"))


@register("learning_curve")
def learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train and validation F1 at 20 sizes from 40 to 100 percent over 10 stratified folds of the
    under-sampled table; all 200 fits share their passes."""
    feats = lineitem_features(spark, sf_dir)
    fractions = [0.4 + 0.6 * i / 19 for i in range(20)]
    scores = sr.logistic_learning_curve(sm.under_sample(feats, "reported", "row_id", 42), feature_names(feats), fractions, 10)
    return ev.fold_summary(scores, "fraction", ("train_f1", "test_f1"))


@register("feature_ranking")
def feature_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic coefficients ranked by magnitude with display names."""
    feats, train, _ = _splits(spark, sf_dir)
    fm = md.fit_model(sm.under_sample(train, "reported", "row_id", 42), feature_names(feats), "logistic")
    names, weights = zip(*md.coefficients(fm))
    return ev.feature_ranking(spark, names, weights, top=10)


def _stream_sql() -> str:
    from peakscreen.plans.views import EVENT_OTHER_TYPE, EVENT_SAMPLE_TYPE
    from peakscreen.streaming.batches import ROWS_PER_FILE
    types = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_SAMPLE_TYPE.items())
    return f"""
WITH f AS (
  SELECT strftime(ts, '%Y%m%d') AS day, CAST(event_id // {ROWS_PER_FILE} AS INTEGER) AS bucket,
         CASE event_type {types} ELSE '{EVENT_OTHER_TYPE}' END AS sample_type,
         TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS rt,
         value / (value + 20.0) AS probs
  FROM events),
d AS (
  SELECT day, bucket,
         CASE WHEN rt = 0 THEN 0 WHEN probs > 0.4 THEN 1 ELSE 0 END AS predict,
         CASE sample_type WHEN 'Quality Control' THEN 1 WHEN 'Standard' THEN 1
              WHEN 'Blank' THEN 0 WHEN 'Solvent' THEN 0 END AS expected
  FROM f)
SELECT day, bucket,
       CAST(sum(CASE WHEN predict = 0 AND expected = 1 THEN 1 ELSE 0 END) AS BIGINT) AS failed_controls,
       CAST(sum(CASE WHEN predict = 1 AND expected = 0 THEN 1 ELSE 0 END) AS BIGINT) AS dirty_blanks,
       sum(CASE WHEN predict = 0 AND expected = 1 THEN 1 ELSE 0 END) = 0 AS controls_pass,
       sum(CASE WHEN predict = 1 AND expected = 0 THEN 1 ELSE 0 END) = 0 AS blanks_pass
FROM d GROUP BY day, bucket
"""


def _ranking_sql() -> str:
    feats = CONTINUOUS + [f"analyte_{t}" for t in PART_TYPES]
    onehot = ", ".join(f"CASE WHEN p.p_type = '{t}' THEN 1 ELSE 0 END AS analyte_{t}" for t in PART_TYPES)
    w = "\n  UNION ALL ".join(f"SELECT '{f}' AS feature, corr({f}, reported) AS weight FROM f" for f in feats)
    return f"""
WITH f AS (
  SELECT CAST(l.l_quantity AS DOUBLE) AS l_quantity, CAST(l.l_extendedprice AS DOUBLE) AS l_extendedprice,
         CAST(l.l_discount AS DOUBLE) AS l_discount, CAST(l.l_tax AS DOUBLE) AS l_tax,
         CAST(p.p_size AS DOUBLE) AS p_size, CAST(p.p_retailprice AS DOUBLE) AS p_retailprice,
         {onehot},
         CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END AS reported
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
w AS (
  {w}),
r AS (SELECT feature, weight, row_number() OVER (ORDER BY abs(weight) DESC, feature) AS rank FROM w)
SELECT CAST(rank AS INTEGER) AS rank, feature, feature AS display_name, round(weight, 6) AS weight,
       round(CASE WHEN contains(feature, 'analyte_') THEN 0.0 ELSE weight END, 6) AS no_analyte_weight,
       round(greatest(weight, 0.0), 6) AS positive_weight, weight < 0 AS negative
FROM r WHERE rank BETWEEN 1 AND 10
"""


@register("correlation_ranking", _ranking_sql())
def correlation_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features ranked by |correlation with the label| (one aggregate), top 10."""
    feats = lineitem_features(spark, sf_dir)
    names = feature_names(feats)
    row = feats.agg(*[F.corr(F.col(n).cast("double"), F.col("reported").cast("double")).alias(n)
                      for n in names]).first()
    ranked = ev.feature_ranking(spark, names, [row[n] for n in names], top=10)
    return ranked.select("rank", "feature", "display_name", r6("weight").alias("weight"),
                         r6("no_analyte_weight").alias("no_analyte_weight"),
                         r6("positive_weight").alias("positive_weight"), "negative")


@register("stream_batches", _stream_sql())
def stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as export files, scored by a file stream batch by batch."""
    from peakscreen.streaming.batches import stream_events_roundtrip
    return stream_events_roundtrip(spark, sf_dir)
