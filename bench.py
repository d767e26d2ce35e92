"""Time the headline queries at one scale factor; print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is materialised with a no-op write (``format("noop")``) so the full
plan runs without collecting rows to the driver.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from peakscreen import get_spark  # noqa: E402
from peakscreen.plans import catalog  # noqa: E402

HEADLINE = [
    "label_rate", "label_two_key", "label_dedupe", "header_line", "peak_filter", "sample_code",
    "clean_names", "dirty_numeric", "rt_diff", "feature_sets", "batch_decisions",
    "control_failures", "cumulative_profit", "cumulative_misses", "error_lists", "class_pivot",
    "threshold_sweep", "class_report", "roc_points", "profit_curve", "score_histogram",
    "corr_matrix", "vif", "standardize", "stratified_split", "under_sample", "folds",
    "over_sample", "expectations", "union_batches", "export_roundtrip", "lasso_path", "smote",
    "random_split", "learning_subsets", "single_analyte", "rounded_f1_loss", "upload_roundtrip",
    "correlation_ranking",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(f"local[{cpus}]", max(8, cpus), extra={"spark.driver.memory": "16g"})
    qs = catalog.all_queries()
    # Warm-up: JVM class loading, code generation and the Python worker pool used
    # by Arrow batches; none of it is part of any query's time.
    qs["label_rate"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.range(0, 1000, numPartitions=cpus).mapInPandas(lambda it: it, "id long") \
        .write.format("noop").mode("overwrite").save()
    from peakscreen.operators.prefix import running_total
    running_total(spark.range(0, 1000).withColumn("v", F.lit(1)), ["v"], ["id"]) \
        .write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"# {name}: {times[name]} s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else None}))
    spark.stop()


if __name__ == "__main__":
    main()
