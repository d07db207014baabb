"""Run the ordered-scan queries with one range per group and with small
ranges (as large inputs get) and require identical results.

    python scripts/bucket_selfcheck.py [sf_dir] [rows per range]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ligandspark.plans.catalog import QUERIES  # noqa: E402
from ligandspark.plans.scan import RANGE_CONF  # noqa: E402
from ligandspark.session import get_session  # noqa: E402

NAMES = ["auc_by_group", "roc_points", "binary_report9", "stratified_folds_seeded", "stratified_folds",
         "early_stop", "running_best", "best_epoch", "multitask_masked", "centroid_cv_report"]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    rows = sys.argv[2] if len(sys.argv) > 2 else "500"
    spark = get_session("local[8]", 8)
    ok = True
    for n in NAMES:
        spark.conf.unset(RANGE_CONF)
        a = sorted(map(tuple, QUERIES[n](spark, sf).collect()))
        spark.conf.set(RANGE_CONF, rows)
        b = sorted(map(tuple, QUERIES[n](spark, sf).collect()))
        ok &= a == b
        print(f"{'OK  ' if a == b else 'DIFF'} {n}: {len(a)} rows")
    spark.conf.unset(RANGE_CONF)
    print("all identical" if ok else "differences found")


if __name__ == "__main__":
    main()
