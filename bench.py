"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (sum of per-query medians), "unit",
"queries": {name: median seconds}, "sf", "calibration_sec", ...}.  Each query is
built and fully executed into Spark's noop sink; a warm-up query runs first and
is not counted.  The calibration is a fixed job that reads no table: its time
tells how fast the machine was, and is not in the sum.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ligandspark.plans.catalog import QUERIES  # noqa: E402
from ligandspark.plans.scan import RANGE_CONF  # noqa: E402
from ligandspark.session import get_session  # noqa: E402

HEADLINE = [
    "centroid_cv_report",
    "binary_report7", "binary_report9", "auc_by_group", "roc_points", "fold_mean",
    "multitask_masked", "regression_masked", "bce_weighted",
    "stratified_folds_seeded", "class_weights", "standardize_train_fit",
    "feature_blocks_join", "star_lookup",
    "smiles_tokens", "smiles_encode", "atom_positions", "protein_prepare", "embed_hashed",
    "early_stop", "running_best", "best_epoch",
    "variant_consensus", "batch_diversity", "tta_ensemble", "adaptive_pool",
    "knn_vote", "subset_cost", "cosine_pairs",
    "wavelet_values", "wavelet_stack", "streaming_meter",
]


SPLIT_SCANS = ["auc_by_group", "early_stop", "stratified_folds_seeded"]
RANGE_ROWS = "500"
CALIBRATION_ROWS = 400_000_000


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    names = only or HEADLINE
    spark = get_session(f"local[{cpus}]", int(cpus))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None

    def run(name: str, range_rows: str | None = None) -> float:
        # build (eager small fits included) + execute the whole plan; the noop
        # sink runs every stage without pulling result rows into Python
        spark.catalog.clearCache()      # nothing of an earlier run is reused
        if range_rows:
            spark.conf.set(RANGE_CONF, range_rows)
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - t0
        spark.conf.unset(RANGE_CONF)
        return took

    def calibrate() -> float:
        t0 = time.perf_counter()
        spark.range(0, CALIBRATION_ROWS, 1, int(cpus)).selectExpr("sum(xxhash64(id) % 1000) AS s").collect()
        return time.perf_counter() - t0

    run("binary_report7")  # JVM / codegen warm-up
    calibrate()
    calibration = [calibrate() for _ in range(3)]
    res, rows = {}, {}
    for name in names:
        times = [run(name) for _ in range(repeat)]
        res[name] = round(statistics.median(times), 3)
    if not only:
        # ordered scans with groups cut into many ranges, as large inputs get
        for name in SPLIT_SCANS:
            res[f"{name}_split"] = round(statistics.median(run(name, RANGE_ROWS) for _ in range(repeat)), 3)
    out = {
        "metric": "sum_of_query_medians",
        "value": round(sum(res.values()), 3),
        "unit": "sec",
        "queries": res,
        "sf": sf,
        "cpus": int(cpus),
        "repeat": repeat,
        "calibration_sec": round(statistics.median(calibration), 3),
        "spark": spark.version,
        "action": "noop write (full execution, no driver collect)",
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
