"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from asofkit.queries import load_all
from asofkit.session import local_session

HEADLINE = [
    "pit_features", "distinct_items_120d", "nearest_match", "outcome_audit", "coerced_lines", "rule_battery", "column_profile", "numeric_profile", "stratified_prevalence",
    "drift_report", "timing_diagnostic", "auroc_average_precision", "threshold_table", "grouped_calibration", "capacity_table", "fold_capacity_curve", "calibration_slope_intercept",
    "bootstrap_replicates", "paired_bootstrap_difference", "temporal_split", "balanced_grouped_folds", "lasso_cv_coefficients",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus=cpus, shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_all()
    spark.read.parquet(f"{folder}/nation.parquet").count()  # session start is not part of a query
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        queries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "headline query seconds, sum", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
