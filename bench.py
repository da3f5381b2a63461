"""Headline queries at one scale; prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

from foldwise.plans.catalog import QUERIES
from foldwise.session import local_session

HEADLINE = [
    "archive_alignment",
    "digit_extraction",
    "row_stats",
    "frequency_encoding",
    "pair_lift",
    "group_profile",
    "group_stat_matrix",
    "external_target_mean",
    "ordered_target_encoding",
    "multi_smoothing_encoding",
    "kfold_target_stats",
    "quantile_bins",
    "pctrank_against_reference",
    "kde_log_ratio",
    "range_window_rate_crossfit",
    "percent_rank",
    "entity_lags",
    "knn_label_mean",
    "stratified_kfold",
    "exact_auc",
    "delong_test",
    "bootstrap_auc_difference",
    "rank_mean_blend",
    "nnls_combiner",
    "hill_climb_rmse_weights",
    "sealed_pair_scores",
    "oof_prediction",
    "stacking",
    "logit_mean_blend",
    "cross_fitted_blend",
    "encoding_scoreboard",
    "tag_rollup",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, 8, "foldwise-bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["percent_rank"](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up: compiles what all share
    seconds = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
