"""Time the headline queries and print one JSON line: the median of up to three passes."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "eval_metrics", "eval_by_class", "iav_detrended", "gap_fill", "trend", "msc",
    "quality_filter", "qa_report", "feature_set", "map_mean", "map_msc", "map_anomalies",
    "map_trend", "map_err_rel", "rel_sem_by_class", "histogram_rel_sem", "apply_mask",
    "nearest_snap", "merge_grids", "resample_monthly_filled", "area_sample", "loc_r2",
    "product_ranksum", "group_kfold", "group_bootstrap", "friedman", "wilcoxon_paired",
    "quantiles", "box_stats", "bias_by_quartile", "confusion_matrix", "best_per_group",
    "ensemble_scan", "cv_predictions", "score_grid",
]


MOST_SECONDS = 480


def main() -> None:
    from panelgrid.plans.catalog import QUERIES
    from panelgrid.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    # one small run starts the JVM's compiled paths
    QUERIES["r2"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    # the median of up to three passes; a further one only if there is time for it
    runs, began = {name: [] for name in HEADLINE}, time.perf_counter()
    for done in range(3):
        if done and (time.perf_counter() - began) * (done + 1) / done > MOST_SECONDS:
            break
        for name in HEADLINE:
            t = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs[name].append(time.perf_counter() - t)
    times = {name: round(median(t), 3) for name, t in runs.items()}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
