"""Registered optimality checks of the fitted models, each with the SQL of what must hold at the optimum."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakscreen.operators import certificates as ce
from peakscreen.operators import linalg as la
from peakscreen.operators import modeling as md
from peakscreen.operators import search as sr
from peakscreen.plans.catalog import r6, register
from peakscreen.plans.catalog_ml import CONTINUOUS, PART_TYPES, _embedding_table, feature_names, lineitem_features

FEATURES = CONTINUOUS + [f"analyte_{t}" for t in PART_TYPES]

_FEATURE_SQL = f"""
f AS (SELECT l.l_orderkey * 16 + l.l_linenumber AS row_id,
             {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in CONTINUOUS)},
             {", ".join(f"CASE WHEN p.p_type = '{t}' THEN 1.0 ELSE 0.0 END AS analyte_{t}" for t in PART_TYPES)},
             CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END AS reported
      FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""


def _logistic_sql() -> str:
    moments = "\n  UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg(reported * (CAST({c} AS DOUBLE) - m) / s) AS fitted "
        f"FROM f, (SELECT avg({c}) AS m, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s FROM f)" for c in FEATURES)
    return f"""
WITH {_FEATURE_SQL},
w AS (SELECT count(*) / (2.0 * sum(reported)) AS heavy FROM f)
SELECT feature, round(heavy * fitted, 5) + 0.0 AS fitted FROM w, (
  SELECT '(intercept)' AS feature, avg(reported) AS fitted FROM f
  UNION ALL {moments})
"""


@register("logistic_certificate", _logistic_sql())
def logistic_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: moments that the fitted probabilities reproduce; SQL has them from the labels.

    The fit is the search's, on all rows, classes balanced, without penalty.
    """
    rows = lineitem_features(spark, sf_dir)
    names = feature_names(rows)
    x = F.array(*[F.col(c).cast("double") for c in names])
    # Every row is in fold 1; the fit that leaves out fold 0 learns from all of them.
    data = rows.select(x.alias("x"), F.col("reported").cast("double").alias("y"), F.lit(1).alias("fold"), F.lit(0).alias("level"))
    batch = sr.fit_logistic_batch(data, len(names), 2, [(0.0, 0.0)], tol=1e-13)
    coef, mean, scale = batch.coef[0, 0], batch.means[0], batch.scales[0]
    margin = sum(((F.col(c).cast("double") - float(m)) / float(s) * float(w) for c, m, s, w in zip(names, mean, scale, coef)), F.lit(float(coef[-1])))
    light, heavy = (float(w) for w in batch.weights[0, 0])
    scored = rows.withColumn("probas", 1 / (1 + F.exp(-margin))).withColumn("weight", F.when(F.col("reported") == 1, heavy).otherwise(light))
    found = ce.logistic_moments(scored, names, weight="weight")
    return found.select("feature", (F.round("fitted", 5) + F.lit(0.0)).alias("fitted"))


def _lasso_sql() -> str:
    names = ", ".join(f"('{c}')" for c in FEATURES)
    limit = ", ".join(f"abs(coalesce(covar_pop({c}, reported) / nullif(stddev_pop({c}), 0), 0))" for c in FEATURES)
    return f"""
WITH {_FEATURE_SQL},
top AS (SELECT greatest({limit}) AS strongest FROM f),
k AS (SELECT CAST(i AS INTEGER) AS alpha_idx, 10 ** (-6 + 5 * i / 49.0) AS alpha FROM range(0, 50) r(i))
SELECT alpha_idx, feature, CAST(0 AS DOUBLE) AS excess, CAST(0 AS DOUBLE) AS slack, alpha >= strongest AS null_model
FROM k, top, (VALUES {names}) v(feature)
"""


@register("lasso_certificate", _lasso_sql())
def lasso_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residual correlations of the whole path against their penalties, from the rows (not the Gram matrix)."""
    feats = lineitem_features(spark, sf_dir)
    names = feature_names(feats)
    found = ce.lasso_conditions(feats, names, "reported", la.lasso_path(feats, names, "reported"))
    return found.select("alpha_idx", "feature", r6("excess").alias("excess"), r6("slack").alias("slack"), "null_model")


PCA_SQL = """
WITH e AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(0, len(embedding))) AS j FROM embeddings),
m AS (SELECT j, avg(x) AS m, stddev_pop(x) AS s FROM e GROUP BY j),
z AS MATERIALIZED (SELECT vec_id, e.j, CASE WHEN s = 0 THEN 0 ELSE (x - m) / s END AS z FROM e JOIN m ON e.j = m.j),
c AS MATERIALIZED (SELECT a.j AS i, b.j AS j, avg(a.z * b.z) AS c FROM z a JOIN z b ON a.vec_id = b.vec_id GROUP BY a.j, b.j),
c2 AS (SELECT a.i, b.j, sum(a.c * b.c) AS c FROM c a JOIN c b ON a.j = b.i GROUP BY a.i, b.j)
SELECT 'trace of power 1' AS item, round(sum(c), 4) AS value FROM c WHERE i = j
UNION ALL SELECT 'trace of power 2', round(sum(c * c), 4) FROM c
UNION ALL SELECT 'trace of power 3', round(sum(c2.c * c.c), 4) FROM c2 JOIN c ON c2.i = c.j AND c2.j = c.i
UNION ALL SELECT 'residual of component ' || k, 0.0 FROM range(1, 5) r(k)
UNION ALL SELECT 'departure from orthonormal', 0.0
"""


@register("pca_certificate", PCA_SQL)
def pca_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of powers from all eigenvalues, residuals and orthogonality of the leading components."""
    emb = _embedding_table(spark, sf_dir)
    cols = [c for c in emb.columns if c.startswith("e")]
    model = md.fit_pca(emb, cols, len(cols)).stages[-1]
    values = model.explainedVariance.toArray() * len(cols)          # the trace of a correlation matrix
    vectors = model.pc.toArray()
    four = ce.component_residuals(emb, cols, vectors[:, :4], values[:4])
    apart = float(np.abs(vectors.T @ vectors - np.eye(len(cols))).max())
    rows = [*((f"trace of power {k}", x) for k, x in zip((1, 2, 3), ce.spectral_moments(values, (1, 2, 3)))),
            *((f"residual of component {i + 1}", x) for i, x in enumerate(four)), ("departure from orthonormal", apart)]
    out = spark.createDataFrame([(n, float(x)) for n, x in rows], "item string, value double")
    return out.select("item", F.round("value", 4).alias("value"))
