"""Model operators on pyspark.ml."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.feature import PCA, ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from peakscreen.operators import boosting as bo
from peakscreen.operators import evaluation as ev
from peakscreen.operators import forest as fo
from peakscreen.operators import network as nn
from peakscreen.operators import sampling as sm


def standardize(df: DataFrame, cols: Sequence[str], prefix: str = "z_",
                population: bool = True) -> DataFrame:
    """Z-scores with the population (or sample) standard deviation (L1, table form).

    The means and deviations come from one aggregate row.
    """
    sd = F.stddev_pop if population else F.stddev_samp
    st = df.agg(*[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(cols)],
                *[sd(f"`{c}`").alias(f"s{i}") for i, c in enumerate(cols)]).first()
    out = []
    for i, c in enumerate(cols):
        m, s = st[f"m{i}"], st[f"s{i}"]
        expr = (F.lit(None).cast("double") if not s else (F.col(f"`{c}`") - F.lit(m)) / F.lit(s))
        out.append(expr.alias(f"{prefix}{c}"))
    return df.select("*", *out)


# ---------------------------------------------------------------------------
# Estimators, pipelines and scoring
# ---------------------------------------------------------------------------


def balanced_weights(df: DataFrame, label: str = "reported", out: str = "weight",
                     pos_weight: float = 1.0) -> DataFrame:
    """``balanced`` class weights N / (k * n_class), times ``pos_weight`` for class 1."""
    counts = sm.class_counts(df, label)
    n, k = sum(counts.values()), len(counts)
    w = None
    for c, nc in counts.items():
        val = n / (k * nc) * (pos_weight if c == 1 else 1.0)
        w = F.when(F.col(label) == F.lit(c), F.lit(val)) if w is None else w.when(
            F.col(label) == F.lit(c), F.lit(val))
    return df.withColumn(out, w.otherwise(F.lit(1.0)) if w is not None else F.lit(1.0))


def population_scaler(n_rows: int, n_features: int, input_col: str = "features",
                      output_col: str = "scaled") -> list:
    """Standardise with the population deviation (L1).

    Spark's scaler divides by the sample deviation; multiplying by
    sqrt(n / (n - 1)) turns that into the population form.
    """
    factor = math.sqrt(n_rows / (n_rows - 1)) if n_rows > 1 else 1.0
    return [StandardScaler(inputCol=input_col, outputCol="_std", withMean=True, withStd=True),
            ElementwiseProduct(scalingVec=Vectors.dense([factor] * n_features),
                               inputCol="_std", outputCol=output_col)]


#: Weight of positives in boosting, and the deepest tree that Spark grows.
BOOST_POS_WEIGHT, MAX_DEPTH = 2.0, 30


def make_estimator(kind: str, n_features: int, features_col: str = "scaled",
                   weight_col: str | None = "weight", seed: int = 42, **params):
    """The four model families of the study (L2-L5) with the lab's settings as defaults.

    Rounds and depth decide the time of a fit; callers with less time pass their own.
    """
    common = {"featuresCol": features_col, "labelCol": "label"}
    if kind == "logistic":
        est = LogisticRegression(regParam=0.0, standardization=False, maxIter=100, **common)
    elif kind == "forest":
        est = RandomForestClassifier(numTrees=100, featureSubsetStrategy="sqrt",
                                     maxDepth=MAX_DEPTH, cacheNodeIds=True, seed=seed, **common)
    elif kind == "gbt":
        est = GBTClassifier(maxIter=551, maxDepth=4, stepSize=0.125, subsamplingRate=0.7,
                            featureSubsetStrategy="0.5", minWeightFractionPerNode=0.0,
                            seed=seed, **common)
    elif kind == "mlp":
        return MultilayerPerceptronClassifier(layers=[n_features, 12, 8, 2], maxIter=100, seed=seed,
                                              **common).setParams(**params)
    else:
        raise ValueError(f"unknown model kind {kind!r}")
    if weight_col and kind != "mlp":
        est = est.setWeightCol(weight_col)
    return est.setParams(**params) if params else est


@dataclass
class FittedModel:
    """A fitted pipeline, its feature names and the threshold chosen for it."""
    name: str
    model: PipelineModel | bo.BoostedTrees | fo.Forest | nn.Network
    features: list[str]
    threshold: float = 0.5
    extras: dict = field(default_factory=dict)


def fit_model(train: DataFrame, features: Sequence[str], kind: str, label: str = "reported",
              name: str | None = None, weighted: bool = True, pos_weight: float | None = None,
              **params) -> FittedModel:
    """assemble -> population scaler -> estimator, fitted on ``train`` (L1-L5); ``boosting`` is the study's
    own (:mod:`peakscreen.operators.boosting`), ``gbt`` Spark's; ``forest`` is grown by :mod:`peakscreen.operators.forest`
    by the rules of Spark's, which makes no headway at this depth; ``network`` is the study's network
    (:mod:`peakscreen.operators.network`), ``mlp`` Spark's.

    Boosting weighs positives ``pos_weight`` times (2 unless given); the other
    families balance the classes (F21).
    """
    feats = list(features)
    if kind == "boosting":
        return FittedModel(name or kind, bo.fit_boosted(train, feats, label, **params), feats)
    if kind == "forest":
        return FittedModel(name or kind, fo.fit_forest(train, feats, label, weighted=weighted, pos_weight=1.0 if pos_weight is None else pos_weight,
                                                       **params), feats)
    if kind == "network":
        return FittedModel(name or kind, nn.fit_network(train, feats, label, **params), feats)
    data = train.withColumn("label", F.col(label).cast("double"))
    if weighted and kind == "gbt":
        heavy = BOOST_POS_WEIGHT if pos_weight is None else pos_weight
        data = data.withColumn("weight", F.when(F.col("label") == 1.0, F.lit(heavy)).otherwise(F.lit(1.0)))
    elif weighted and kind != "mlp":
        data = balanced_weights(data, label, "weight", 1.0 if pos_weight is None else pos_weight)
    # Iterative fits scan their input once per iteration: materialise it once
    # (memory, spilling to disk) instead of re-running the upstream lineage.
    data = data.select(*[F.col(f"`{c}`") for c in feats], "label",
                       *(["weight"] if weighted and kind != "mlp" else []),
                       *[c for c in ("is_val",) if c in data.columns]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = data.count()
        stages = [VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep")]
        stages += population_scaler(n, len(feats))
        stages.append(make_estimator(kind, len(feats), weight_col="weight" if weighted else None,
                                     **params))
        model = Pipeline(stages=stages).fit(data)
    finally:
        data.unpersist()
    return FittedModel(name or kind, model, feats)


def score(fm: FittedModel, df: DataFrame, out: str = "probas") -> DataFrame:
    """Probability of class 1 for every row (L10); input columns are kept."""
    if isinstance(fm.model, (bo.BoostedTrees, fo.Forest, nn.Network)):
        return fm.model.score(df, out)
    scored = fm.model.transform(df)
    keep = [c for c in df.columns]
    return scored.select(*[F.col(f"`{c}`") for c in keep],
                         vector_to_array(F.col("probability"))[1].alias(out))


def coefficients(fm: FittedModel) -> list[tuple[str, float]]:
    """Weight per feature (L11): coefficients or feature importances."""
    if isinstance(fm.model, (bo.BoostedTrees, fo.Forest)):
        return fm.model.importances()
    if isinstance(fm.model, nn.Network):
        raise TypeError("model exposes no per-feature weights")
    est = fm.model.stages[-1]
    if hasattr(est, "coefficients"):
        w = est.coefficients.toArray()
    elif hasattr(est, "featureImportances"):
        w = est.featureImportances.toArray()
    else:
        raise TypeError("model exposes no per-feature weights")
    return list(zip(fm.features, [float(x) for x in w]))


def choose_threshold(scored: DataFrame, label: str = "reported", score_col: str = "probas") -> float:
    """Best F1 threshold on the 51-point grid, lowest on ties (A5)."""
    best = ev.best_threshold(ev.threshold_sweep(scored, score_col, label)).first()
    return float(best["threshold"])


def _parallel(fn, items, parallelism: int):
    """Run independent Spark jobs from a few driver threads (as CrossValidator does)."""
    from concurrent.futures import ThreadPoolExecutor
    items = list(items)
    if parallelism <= 1 or len(items) <= 1:
        return [fn(x) for x in items]
    with ThreadPoolExecutor(max_workers=min(parallelism, len(items))) as pool:
        return list(pool.map(fn, items))


def compare_models(kinds: Sequence[str], train: DataFrame, valid: DataFrame, test: DataFrame,
                   features: Sequence[str], label: str = "reported",
                   parity: bool = False, parallelism: int = 1,
                   params: dict[str, dict] | None = None) -> tuple[DataFrame, list[FittedModel]]:
    """Fit each model (with ``params`` of its kind), pick its threshold and report test F1.

    The threshold is chosen on ``valid``; ``parity=True`` chooses it on the test
    set, as the historical comparison did, and rounds F1 to two digits.
    """
    spark = train.sparkSession

    def one(kind):
        fm = fit_model(train, features, kind, label, **(params or {}).get(kind, {}))
        pick_on = test if parity else valid
        fm.threshold = choose_threshold(score(fm, pick_on), label)
        s = score(fm, test).cache()
        r = ev.score_at(s, "probas", label, fm.threshold).first()
        f1 = round(r["f1"], 2) if parity else r["f1"]
        row = (kind, fm.threshold, float(f1), int(r["tp"]), int(r["fp"]), int(r["fn"]),
               int(r["tn"]), float(ev.roc_auc(s, "probas", label)))
        s.unpersist()
        return row, fm

    results = _parallel(one, kinds, parallelism)
    rows = [r for r, _ in results]
    fitted = [fm for _, fm in results]
    df = spark.createDataFrame(rows, "model string, threshold double, f1 double, tp long, fp long, "
                                     "fn long, tn long, auc double")
    return df, fitted


def comparison_reports(fitted: Sequence[FittedModel], test: DataFrame, label: str = "reported") -> DataFrame:
    """Class report of every model at its threshold (A15), with a ``model`` column."""
    return ev.stack_curves([(fm.name, ev.class_report(score(fm, test), "probas", label, fm.threshold)) for fm in fitted], "model")


def comparison_curves(fitted: Sequence[FittedModel], test: DataFrame, label: str = "reported") -> DataFrame:
    """ROC points of every model (A15), with a ``model`` column."""
    return ev.stack_curves([(fm.name, ev.roc_points(score(fm, test), "probas", label)) for fm in fitted], "model")


def profit_by_model(fitted: Sequence[FittedModel], test: DataFrame, label: str = "reported", cost=(0.0, 0.0, -1.0, 0.5),
                    extra_negatives: int = 27445) -> DataFrame:
    """Profit curves of differently fitted models on the same rows."""
    tot = test.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n")).first()
    return ev.stack_curves([(fm.name, ev.profit_curve(ev.roc_points(score(fm, test), "probas", label), int(tot["p"]), int(tot["n"]), cost,
                                                      extra_negatives)) for fm in fitted], "model")


def profit_by_sampling(methods: dict[str, DataFrame], test: DataFrame, features: Sequence[str],
                       kind: str = "gbt", label: str = "reported",
                       cost=(0.0, 0.0, -1.0, 0.5), extra_negatives: int = 27445,
                       parallelism: int = 1) -> DataFrame:
    """Profit curves of one model family trained on differently rebalanced data."""
    tot = test.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n")).first()

    def one(item):
        name, train = item
        fm = fit_model(train, features, kind, label)
        roc = ev.roc_points(score(fm, test), "probas", label)
        return name, ev.profit_curve(roc, int(tot["p"]), int(tot["n"]), cost, extra_negatives)

    curves = _parallel(one, methods.items(), parallelism)
    return ev.stack_curves(curves, "sampling")


def random_search(train: DataFrame, features: Sequence[str], kind: str, space: dict,
                  n_iter: int = 100, seed: int = 32, k: int = 5, label: str = "reported",
                  parallelism: int = 4) -> tuple[dict, float]:
    """Randomised hyper-parameter search with stratified k-fold F1.

    Parameter maps are drawn on the driver (a seeded generator over the given
    lists or (low, high) ranges); each candidate is cross-validated by Spark's
    ``CrossValidator`` with a fold column, ``parallelism`` fits at a time.
    """
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator
    rng = np.random.RandomState(seed)
    data = sm.stratified_folds(train, label, "row_id", k, seed).withColumn(
        "label", F.col(label).cast("double"))
    data = balanced_weights(data, label)
    n = data.count()
    est = make_estimator(kind, len(features))
    maps = []
    for _ in range(n_iter):
        m = {}
        for pname, choices in space.items():
            param = est.getParam(pname)
            if isinstance(choices, tuple):
                lo, hi = choices
                v = rng.uniform(lo, hi) if isinstance(lo, float) else int(rng.randint(lo, hi))
            else:
                v = choices[rng.randint(len(choices))]
            m[param] = v.item() if hasattr(v, "item") else v
        maps.append(m)
    # Each fold fits its own scaler on its own training rows.
    stages = population_scaler(n * (k - 1) // k, len(features))
    pre = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(data).select(
        "features", "label", "weight", "fold").persist(StorageLevel.MEMORY_AND_DISK)
    evaluator = MulticlassClassificationEvaluator(metricName="fMeasureByLabel", metricLabel=1.0)
    cv = CrossValidator(estimator=Pipeline(stages=[*stages, est]), estimatorParamMaps=maps, evaluator=evaluator,
                        foldCol="fold", parallelism=parallelism)
    cvm = cv.fit(pre)
    pre.unpersist()
    best = int(np.argmax(cvm.avgMetrics))
    return {p.name: v for p, v in maps[best].items()}, float(cvm.avgMetrics[best])


def learning_curve(df: DataFrame, features: Sequence[str], kind: str = "logistic",
                   fractions: Sequence[float] = (0.4, 0.7, 1.0), k: int = 3,
                   label: str = "reported", seed: int = 42) -> DataFrame:
    """Train/validation F1 by training-set size over stratified folds."""
    spark = df.sparkSession
    folded = sm.stratified_folds(df, label, "row_id", k, seed)
    sub = sm.nested_subsets(folded, label, "row_id", fractions, seed).cache()
    rows = []
    for i, f in enumerate(sorted(fractions)):
        for fold in range(k):
            train = sub.where((F.col("fold") != fold) & (F.col("subset") <= i))
            valid = sub.where(F.col("fold") == fold)
            fm = fit_model(train, features, kind, label)
            tr = ev.score_at(score(fm, train), "probas", label, 0.5).first()["f1"]
            te = ev.score_at(score(fm, valid), "probas", label, 0.5).first()["f1"]
            rows.append((float(f), fold, int(train.count()), float(tr), float(te)))
    sub.unpersist()
    scores = spark.createDataFrame(rows, "fraction double, fold int, train_size long, "
                                         "train_f1 double, test_f1 double")
    return ev.fold_summary(scores, "fraction", ("train_f1", "test_f1"))


def early_stopped_gbt(train: DataFrame, features: Sequence[str], label: str = "reported",
                      valid_fraction: float = 0.2, tol: float = 0.01, max_iter: int = 5000,
                      seed: int = 42) -> FittedModel:
    """Boosting rounds chosen by validation loss (L9): Spark stops when the
    validation error stops improving by more than ``tol``."""
    marked = sm.stratified_split(train, label, "row_id", valid_fraction, seed, out="_split") \
        .withColumn("is_val", F.col("_split") == "test").drop("_split")
    fm = fit_model(marked, features, "gbt", label, validationIndicatorCol="is_val",
                   validationTol=tol, maxIter=max_iter)
    fm.extras["rounds"] = fm.model.stages[-1].getNumTrees
    return fm


def fit_pca(df: DataFrame, features: Sequence[str], k: int) -> PipelineModel:
    """assemble -> population scaler -> PCA; Spark's PCA does not centre, the scaler does."""
    n = df.count()
    stages = [VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")]
    stages += population_scaler(n, len(features))
    stages.append(PCA(k=k, inputCol="scaled", outputCol="pca"))
    return Pipeline(stages=stages).fit(df)


def pca_summary(df: DataFrame, features: Sequence[str], k: int = 4,
                id_col: str = "row_id") -> tuple[list[float], DataFrame]:
    """Explained variance (percent) of k components and the 2-D projection."""
    model = fit_pca(df, features, k)
    ratios = [float(x) * 100.0 for x in model.stages[-1].explainedVariance.toArray()]
    pts = model.transform(df).select(id_col, vector_to_array("pca").alias("_p"))
    pts = pts.select(id_col, F.col("_p")[0].alias("pc1"), F.col("_p")[1].alias("pc2"))
    return ratios, pts
