"""Headline queries on local cores; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default all) choose
data and cores. Every query is run to the end into the no-op sink once, after
the flagship query has run once as warm-up.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "flagship_experiment", "b7_sentinel_impute", "b24_feature_crosses", "b25_row_fingerprint", "c1_attach_assets",
    "d2_ordinal_strict", "d8_infer_categorical", "d13_ngram_vocabulary", "e1_standard_scaler", "e5_robust_scaler",
    "e6_quantile_uniform", "e8_yeo_johnson", "e14_svd_append", "e24_fitted_steps", "f1_exact_split",
    "f3_stratified_split", "f5_kfold", "g5_mean_of_probabilities", "g7_hashed_words", "h3_quantiles",
    "i1_nearest_by_cosine", "i6_energy_distance", "i7_knn_vote", "i12_balanced_assign", "j1_regression_errors",
    "j3_correlations", "j9_precision_recall_f1", "j14_roc_auc", "j15_roc_auc_multiclass", "j23_grouped_scores",
    "k4_smoothed_meter", "k5_early_stop",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    names = sys.argv[1:] or HEADLINE
    from tabwright import catalog
    from tabwright.session import get_session
    spark = get_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus),
                        spark__ui__enabled="false", spark__driver__memory="16g",
                        spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = catalog.load()
    queries["flagship_experiment"](spark, sf).collect()
    seconds = {}
    for name in names:
        start = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_wall_clock", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
