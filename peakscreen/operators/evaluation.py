"""Model evaluation from a scored table.

Every operator reads a DataFrame with a score column and a 0/1 label column, so
it works for any model and is checked against SQL. Each sweep is one pass over
the data: rows are bucketed, the buckets (bounded in number) are aggregated
with map-side partial aggregation, and cumulative sums run over the small
bucket table or, for ROC points, through the distributed running total.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakscreen import schema as S
from peakscreen.functions.decisions import (f1_from_counts, precision_from_counts,
                                            recall_from_counts)
from peakscreen.functions.names import display_name
from pyspark.storagelevel import StorageLevel

from peakscreen.operators.prefix import BOUNDS, descending, key_block, running_total


def _col(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


# -- A2 ---------------------------------------------------------------------

def class_pivot(df: DataFrame, group: str = "analyte", cls: str = "reported",
                count_col: str = S.SAMPLE_NAME, classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Non-null ``count_col`` per (group, class), one column per class, plus total (A2).

    A class with no rows in a group is null (not 0), so the total is null too
    and sorts last.
    """
    c = _col(cls)
    aggs = [F.when(F.count_if(c == F.lit(k)) > 0,
                   F.count(F.when(c == F.lit(k), _col(count_col)))).cast("long").alias(f"n_{k}")
            for k in classes]
    out = df.groupBy(_col(group).alias(group)).agg(*aggs)
    total = None
    for k in classes:
        total = F.col(f"n_{k}") if total is None else total + F.col(f"n_{k}")
    return out.withColumn("total", total).orderBy(F.col("total").desc_nulls_last(), F.col(group))


# -- A3, A4, A17 ------------------------------------------------------------

def confusion_counts(df: DataFrame, score: str = "probas", label: str = "reported",
                     threshold: float = 0.5) -> DataFrame:
    """One row (tp, fp, fn, tn) with ``score >= threshold`` as positive (A3)."""
    pred = F.coalesce(_col(score) >= F.lit(threshold), F.lit(False))
    y = _col(label) == 1
    return df.agg(
        F.count_if(pred & y).alias("tp"),
        F.count_if(pred & ~y).alias("fp"),
        F.count_if(~pred & y).alias("fn"),
        F.count_if(~pred & ~y).alias("tn"),
    )


def confusion_at(df: DataFrame, thresholds: Sequence[float], score: str = "probas",
                 label: str = "reported") -> DataFrame:
    """Confusion counts, precision, recall and F1 at several thresholds from one scan.

    One aggregate computes four conditional counts per threshold; ``inline``
    turns the single result row into one row per threshold.
    """
    y = _col(label) == 1
    aggs = []
    for i, t in enumerate(thresholds):
        pred = F.coalesce(_col(score) >= F.lit(float(t)), F.lit(False))
        aggs += [F.count_if(pred & y).alias(f"tp{i}"), F.count_if(pred & ~y).alias(f"fp{i}"),
                 F.count_if(~pred & y).alias(f"fn{i}"), F.count_if(~pred & ~y).alias(f"tn{i}")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"),
                     F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn"),
                     F.col(f"tn{i}").alias("tn")) for i, t in enumerate(thresholds)]
    out = wide.select(F.inline(F.array(*rows)))
    return out.select("*", precision_from_counts("tp", "fp").alias("precision"),
                      recall_from_counts("tp", "fn").alias("recall"),
                      f1_from_counts("tp", "fp", "fn").alias("f1"))


def score_at(df: DataFrame, score: str = "probas", label: str = "reported",
             threshold: float = 0.5) -> DataFrame:
    """Confusion counts plus precision, recall and F1 at one threshold (A4)."""
    cm = confusion_counts(df, score, label, threshold)
    return cm.select("*",
                     precision_from_counts("tp", "fp").alias("precision"),
                     recall_from_counts("tp", "fn").alias("recall"),
                     f1_from_counts("tp", "fp", "fn").alias("f1"))


def rounded_f1_loss(df: DataFrame, score: str = "probas", label: str = "reported") -> float:
    """1 - F1 of predictions rounded half-to-even (0.5 -> 0), the tuning loss of the network."""
    from peakscreen.functions.decisions import round_half_even
    pred = round_half_even(score) >= 1
    y = _col(label) == 1
    r = df.agg(F.count_if(pred & y).alias("tp"), F.count_if(pred & ~y).alias("fp"),
               F.count_if(~pred & y).alias("fn")).select(f1_from_counts("tp", "fp", "fn")).first()
    return 1.0 - float(r[0])


def confusion_bars(cm: DataFrame) -> DataFrame:
    """Bar-chart data of the confusion plot (A17): per predicted class, correct and incorrect."""
    return cm.select(F.inline(F.array(
        F.struct(F.lit("should be reported").alias("bar"), F.col("tp").alias("correct"),
                 F.col("fp").alias("incorrect")),
        F.struct(F.lit("should not be reported").alias("bar"), F.col("tn").alias("correct"),
                 F.col("fn").alias("incorrect")),
    )))


# -- A5 ---------------------------------------------------------------------

def grid_threshold(i: Column, n_points: int = 51) -> Column:
    """Threshold ``i`` of an evenly spaced 0..1 grid: ``i * step``, last point exactly 1."""
    step = 1.0 / (n_points - 1)
    return F.when(i == n_points - 1, F.lit(1.0)).otherwise(i.cast("double") * F.lit(step))


def grid_bucket(score: Column, n_points: int = 51) -> Column:
    """Largest grid index ``i`` with ``score >= threshold_i``; -1 when none (or null score)."""
    last = n_points - 1
    b = F.least(F.greatest(F.floor(score * F.lit(float(last))), F.lit(-1)), F.lit(last)).cast("int")
    b = F.when((b >= 0) & (score < grid_threshold(b, n_points)), b - 1).otherwise(b)
    b = F.when((b < last) & (score >= grid_threshold(b + 1, n_points)), b + 1).otherwise(b)
    return F.coalesce(b, F.lit(-1))


def threshold_sweep(df: DataFrame, score: str = "probas", label: str = "reported",
                    n_points: int = 51) -> DataFrame:
    """Confusion counts and F1 on every grid threshold in one pass (A5).

    Each row lands in the bucket of the largest threshold it clears; a reverse
    cumulative sum over the <= n_points+1 buckets gives the counts at every
    threshold.
    """
    spark = df.sparkSession
    y = _col(label) == 1
    counts = df.select(grid_bucket(_col(score), n_points).alias("i"), y.alias("_y")).groupBy("i").agg(
        F.count_if(F.col("_y")).alias("pos"), F.count_if(~F.col("_y")).alias("neg"))
    grid = spark.range(0, n_points).select(F.col("id").cast("int").alias("i"),
                                           F.lit(0).cast("long").alias("pos"),
                                           F.lit(0).cast("long").alias("neg"))
    allb = counts.unionByName(grid).groupBy("i").agg(F.sum("pos").alias("pos"),
                                                     F.sum("neg").alias("neg"))
    # The bucket table has at most n_points + 1 rows, so a single ordered window is bounded.
    w = Window.orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    tot = Window.partitionBy()
    out = allb.select(
        "i",
        F.sum("pos").over(w).alias("tp"),
        F.sum("neg").over(w).alias("fp"),
        F.sum("pos").over(tot).alias("_p"),
        F.sum("neg").over(tot).alias("_n"),
    ).where(F.col("i") >= 0)
    out = out.select(
        "i", grid_threshold(F.col("i"), n_points).alias("threshold"),
        F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"),
        (F.col("_p") - F.col("tp")).cast("long").alias("fn"),
        (F.col("_n") - F.col("fp")).cast("long").alias("tn"))
    return out.withColumn("f1", f1_from_counts("tp", "fp", "fn"))


def best_threshold(sweep: DataFrame, metric: str = "f1") -> DataFrame:
    """The first (lowest) threshold with the maximum metric (A5)."""
    return sweep.orderBy(F.col(metric).desc(), F.col("threshold").asc()).limit(1)


# -- A6 ---------------------------------------------------------------------

def class_report(df: DataFrame, score: str = "probas", label: str = "reported",
                 threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted averages.

    As in the transposed classification report, the accuracy row repeats the
    accuracy in all four columns.
    """
    cm = confusion_counts(df, score, label, threshold)
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    p1, r1 = precision_from_counts("tp", "fp"), recall_from_counts("tp", "fn")
    p0, r0 = precision_from_counts("tn", "fn"), recall_from_counts("tn", "fp")
    f1_1, f1_0 = f1_from_counts("tp", "fp", "fn"), f1_from_counts("tn", "fn", "fp")
    s1, s0 = (F.col("tp") + F.col("fn")).cast("double"), (F.col("tn") + F.col("fp")).cast("double")
    acc = F.when(n == 0, F.lit(0.0)).otherwise((F.col("tp") + F.col("tn")) / n)
    nd = n.cast("double")

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1_score"), s.alias("support"))

    def wavg(a, b):
        return F.when(nd == 0, F.lit(0.0)).otherwise((a * s0 + b * s1) / nd)

    return cm.select(F.inline(F.array(
        row("0", p0, r0, f1_0, s0),
        row("1", p1, r1, f1_1, s1),
        row("accuracy", acc, acc, acc, acc),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f1_0 + f1_1) / 2, nd),
        row("weighted avg", wavg(p0, p1), wavg(r0, r1), wavg(f1_0, f1_1), nd),
    )))


# -- A7, A8, A16 --------------------------------------------------------------

def _score_counts(df: DataFrame, score: str, label: str) -> DataFrame:
    y = F.coalesce(_col(label) == 1, F.lit(False))
    return df.where(_col(score).isNotNull()).groupBy(_col(score).alias("threshold")).agg(
        F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))


def roc_points(df: DataFrame, score: str = "probas", label: str = "reported",
               n_blocks: int | None = None, keep_counts: bool = False,
               drop_intermediate: bool = False) -> DataFrame:
    """(threshold, fps, tps, fpr, tpr) for every distinct score, descending.

    Rows with a null score are ignored, a null label counts as negative. All points are kept (no collinear-point
    dropping); the curve's (0, 0) start is added by :func:`profit_curve`. The points are persisted
    while they are summed up: totals, bounds and running sums read them, not the input.
    """
    pts = _score_counts(df, score, label).persist(StorageLevel.MEMORY_AND_DISK)
    totals = pts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    p, n = int(totals["p"] or 0), int(totals["n"] or 0)
    cum = running_total(pts, ["pos", "neg"], descending("threshold"), out=["tps", "fps"], n_blocks=n_blocks)
    extra = ["pos", "neg"] if keep_counts else []
    if drop_intermediate:
        cum = _drop_collinear(cum)
    return cum.select(
        "threshold",
        F.col("fps").cast("long").alias("fps"), F.col("tps").cast("long").alias("tps"),
        (F.col("fps") / F.lit(float(n)) if n else F.lit(None).cast("double")).alias("fpr"),
        (F.col("tps") / F.lit(float(p)) if p else F.lit(None).cast("double")).alias("tpr"),
        *extra)


def _drop_collinear(cum: DataFrame) -> DataFrame:
    """Keep only ROC corners: first and last points and those where the second
    difference of fps or tps is non-zero. Neighbours are found by equi-joins on
    the point's rank (from a distributed running count), not an ordered window.
    """
    ranked = running_total(cum.withColumn("_one", F.lit(1)), ["_one"], descending("threshold"),
                           out=["_r"]).drop("_one")
    nb = ranked.select(F.col("_r"), F.col("fps").alias("_f"), F.col("tps").alias("_t"))
    prev = nb.select((F.col("_r") + 1).alias("_r"), F.col("_f").alias("_fp"), F.col("_t").alias("_tp"))
    nxt = nb.select((F.col("_r") - 1).alias("_r"), F.col("_f").alias("_fn"), F.col("_t").alias("_tn"))
    j = ranked.join(prev, "_r", "left").join(nxt, "_r", "left")
    corner = (F.col("_fp").isNull() | F.col("_fn").isNull()
              | ((F.col("_fn") - 2 * F.col("fps") + F.col("_fp")) != 0)
              | ((F.col("_tn") - 2 * F.col("tps") + F.col("_tp")) != 0))
    return j.where(corner).drop("_r", "_fp", "_tp", "_fn", "_tn")


def roc_auc(df: DataFrame, score: str = "probas", label: str = "reported") -> float:
    """Area under the ROC curve by trapezoids, in one aggregate over the ROC points.

    Each point knows its own increments (pos, neg), so the segment from the
    previous point is neg/N * (2*tps - pos) / (2P): no ordering window is needed.
    """
    pts = _score_counts(df, score, label).persist(StorageLevel.MEMORY_AND_DISK)
    cum = running_total(pts, ["pos"], descending("threshold"), out=["tps"])
    r = cum.agg(F.sum(F.col("neg") * (2 * F.col("tps") - F.col("pos"))).alias("s"),
                F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    pts.unpersist()
    if not r["p"] or not r["n"]:
        return float("nan")
    return float(r["s"]) / (2.0 * r["p"] * r["n"])


def profit_curve(roc: DataFrame, positives: int, negatives: int,
                 cost: tuple[float, float, float, float] = (0.0, 0.0, -1.0, 0.5),
                 extra_negatives: int = 27445, parity: bool = False) -> DataFrame:
    """Expected profit per sample at each ROC threshold.

    ``cost`` is (fp, tp, fn, tn). ``extra_negatives`` un-integrated peaks are
    added to the negatives. The rates are re-weighted with the negative count;
    ``parity=True`` reproduces the historical formula that scales both negative
    rates by the *positive* count. The curve starts at threshold 1 with no
    predicted positives.
    """
    spark = roc.sparkSession
    start = spark.createDataFrame([(1.0, 0, 0, 0.0, 0.0)],
                                  "threshold double, fps long, tps long, fpr double, tpr double")
    pts = start.unionByName(roc.select("threshold", "fps", "tps", "fpr", "tpr"))
    scale = float(positives if parity else negatives)
    fpc_, tpc_, fnc_, tnc_ = cost
    fp_n = F.col("fpr") * F.lit(scale)
    tn_n = (F.lit(1.0) - F.col("fpr")) * F.lit(scale) + F.lit(float(extra_negatives))
    nc = tn_n + fp_n
    fpr2, tnr2 = fp_n / nc, tn_n / nc
    fnr = F.lit(1.0) - F.col("tpr")
    profit = (fpr2 * F.lit(fpc_) + F.col("tpr") * F.lit(tpc_) + fnr * F.lit(fnc_)
              + tnr2 * F.lit(tnc_))
    return pts.select("threshold", fpr2.alias("fpr_adj"), F.col("tpr"), profit.alias("profit"))


def best_profit(df: DataFrame, score: str = "probas", label: str = "reported",
                cost: tuple[float, float, float, float] = (0.0, 0.0, -1.0, 0.5), extra_negatives: int = 27445,
                n_blocks: int = 256) -> DataFrame:
    """``threshold, profit`` of the best point of :func:`profit_curve` without the curve.

    Profit is linear in the numbers of true and false positives. Counts per block of scores give the curve at the
    blocks' edges, and a bound inside each block: its best corner. Only blocks whose bound reaches the
    best edge are counted score by score, so no table grows with the number of distinct scores unless the
    curve is flat. Ties go to the highest threshold; rows without a score are ignored.
    """
    spark = df.sparkSession
    y = F.coalesce(_col(label) == 1, F.lit(False))
    scored = df.where(_col(score).isNotNull()).select(_col(score).alias("threshold"), y.alias("_y"))
    block, bounds = key_block(scored, [F.col("threshold")], n_blocks)
    placed = scored if bounds is None else scored.withColumn(BOUNDS, bounds.scalar())
    placed = placed.withColumn("_b", block)
    parts = placed.groupBy("_b").agg(F.count_if("_y").alias("pos"), F.count_if(~F.col("_y")).alias("neg")).orderBy(F.desc("_b")).collect()
    p, n = sum(r["pos"] for r in parts), sum(r["neg"] for r in parts)
    fpc, tpc, fnc, tnc = cost
    nc = n + extra_negatives

    def profit(tps, fps):
        return ((fps * (fpc - tnc) + nc * tnc) / nc if nc else 0.0) + ((tps * (tpc - fnc) + p * fnc) / p if p else 0.0)

    edges, tps, fps = [(profit(0, 0), 1.0, None)], 0, 0
    bound = []
    for r in parts:
        more_t, more_f = tps + r["pos"], fps + r["neg"]
        bound.append((max(profit(t, f) for t in (tps, more_t) for f in (fps, more_f)), r["_b"], tps, fps))
        tps, fps = more_t, more_f
        edges.append((profit(tps, fps), None, r["_b"]))
    best = max(e[0] for e in edges)
    slack = 1e-12 * max(1.0, abs(best))
    wanted = [(b, t, f) for top, b, t, f in bound if top >= best - slack]
    table = spark.createDataFrame(wanted, "_b int, _t long, _f long")                # n_blocks rows at most
    inside = placed.join(F.broadcast(table), "_b").groupBy("_b", "_t", "_f", "threshold").agg(
        F.count_if("_y").alias("pos"), F.count_if(~F.col("_y")).alias("neg"))
    down = Window.partitionBy("_b").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    points = inside.select("threshold", (F.col("_t") + F.sum("pos").over(down)).alias("tps"), (F.col("_f") + F.sum("neg").over(down)).alias("fps"))
    start = spark.createDataFrame([(1.0, 0, 0)], "threshold double, tps long, fps long")
    gain = (F.col("fps") * F.lit(float(fpc - tnc)) + F.lit(float(nc * tnc))) / F.lit(float(nc or 1))
    hits = (F.col("tps") * F.lit(float(tpc - fnc)) + F.lit(float(p * fnc))) / F.lit(float(p or 1))
    return start.unionByName(points.withColumn("threshold", F.col("threshold").cast("double"))).select(
        "threshold", (gain + hits).alias("profit")).orderBy(F.desc("profit"), F.desc("threshold")).limit(1)


def stack_curves(curves: Sequence[tuple[str, DataFrame]], series_col: str = "series") -> DataFrame:
    """Union several curves with a series label."""
    out = None
    for name, c in curves:
        c = c.select(F.lit(name).alias(series_col), "*")
        out = c if out is None else out.unionByName(c)
    return out


# -- A9 ---------------------------------------------------------------------

def score_histogram(df: DataFrame, score: str = "probas", group: str = "analyte",
                    cls: str = "reported", bins: int = 10) -> DataFrame:
    """Equal-width histogram of scores per (group, class).

    Edges span each group's min..max; the last bin is closed; a constant group
    is centred on a range of width 1 around its value, as numpy does.
    """
    s = _col(score)
    base = df.where(s.isNotNull()).select(_col(group).alias(group), _col(cls).alias(cls),
                                          s.alias("_x"))
    stats = base.groupBy(group, cls).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    stats = stats.select(F.col(group).alias("_g"), F.col(cls).alias("_c"),
                         F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
                         F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"))
    # A null group or class is a group of its own.
    j = base.join(stats, F.col(group).eqNullSafe(F.col("_g")) & F.col(cls).eqNullSafe(F.col("_c")))
    lo, hi = F.col("_lo"), F.col("_hi")
    step = (hi - lo) / F.lit(float(bins))

    def edge(i):
        return F.when(i == bins, hi).otherwise(i.cast("double") * step + lo)

    b = F.floor((F.col("_x") - lo) * (F.lit(float(bins)) / (hi - lo))).cast("int")
    b = F.when(b >= bins, F.lit(bins - 1)).otherwise(b)
    b = F.when(F.col("_x") < edge(b), b - 1).otherwise(b)
    b = F.when((F.col("_x") >= edge(b + 1)) & (b != bins - 1), b + 1).otherwise(b)
    h = j.select(group, cls, b.alias("bin"), lo.alias("_lo"), hi.alias("_hi"))
    return h.groupBy(group, cls, "bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.first(edge(F.col("bin")), ignorenulls=True).alias("bin_lo"),
        F.first(edge(F.col("bin") + 1), ignorenulls=True).alias("bin_hi"))


# -- A12, A13 -----------------------------------------------------------------

def minmax_rescale(df: DataFrame, cols: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """Min-max scale each column to [0, 1] (A12); a constant column gives null.

    The min and max come from one aggregate row (two numbers per column).
    """
    st = df.agg(*[F.min(_col(c)).alias(f"mn{i}") for i, c in enumerate(cols)],
                *[F.max(_col(c)).alias(f"mx{i}") for i, c in enumerate(cols)]).first()
    out = []
    for i, c in enumerate(cols):
        mn, mx = st[f"mn{i}"], st[f"mx{i}"]
        if mn is None or mx is None or mx == mn:
            out.append(F.lit(None).cast("double").alias(f"{c}{suffix}"))
        else:
            out.append(((_col(c) - F.lit(mn)) / F.lit(mx - mn)).alias(f"{c}{suffix}"))
    return df.select("*", *out)


def fold_summary(scores: DataFrame, size: str = "train_size", cols: Sequence[str] = ("train_f1", "test_f1")
                 ) -> DataFrame:
    """Mean and population standard deviation over folds per training size."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return scores.groupBy(size).agg(*aggs)


# -- O2, O3 -----------------------------------------------------------------

def feature_ranking(spark: SparkSession, names: Sequence[str], weights: Sequence[float],
                    top: int = 10, parity: bool = False) -> DataFrame:
    """Features ranked by |weight| with display names and plot helpers (O2, O3).

    ``rank`` 1 is the strongest feature. ``top`` keeps ranks 1..top;
    ``parity=True`` keeps ranks 2..top+1, the historical slice that skipped the
    strongest feature. ``no_analyte_weight`` zeroes one-hot features.
    """
    df = spark.createDataFrame([(n, float(w)) for n, w in zip(names, weights)],
                               "feature string, weight double")
    w = Window.orderBy(F.abs(F.col("weight")).desc(), F.col("feature"))
    ranked = df.select(
        "feature", display_name("feature").alias("display_name"), "weight",
        F.when(F.col("feature").contains("analyte_"), F.lit(0.0)).otherwise(F.col("weight"))
        .alias("no_analyte_weight"),
        F.greatest(F.col("weight"), F.lit(0.0)).alias("positive_weight"),
        (F.col("weight") < 0).alias("negative"),
        F.row_number().over(w).alias("rank"))
    lo, hi = (2, top + 1) if parity else (1, top)
    return ranked.where(F.col("rank").between(lo, hi))
