import os
import tempfile

import numpy as np
import pytest

from ligandspark.operators import metrics as M
from ligandspark.streaming.accumulate import PREDICTION_SCHEMA, accumulated_metrics, start_accumulator


def test_stream_accumulation_equals_batch(spark):
    root = tempfile.mkdtemp(prefix="ls-stream-")
    src, sink, ck = (os.path.join(root, x) for x in ("src", "sink", "ck"))
    rng = np.random.RandomState(2)
    allrows = []
    for b in range(3):
        rows = [("r0", "t" + str(i % 2), float(np.round(rng.randn(), 1)), float(rng.rand() < 0.4),
                 float(rng.rand() < 0.9)) for i in range(200)]
        allrows += rows
        spark.createDataFrame(rows, PREDICTION_SCHEMA).coalesce(1).write.parquet(os.path.join(src, f"b{b}"))
    q = start_accumulator(spark, os.path.join(src, "*"), sink, ck)
    q.awaitTermination(120)
    got = {r["task"]: r for r in accumulated_metrics(spark, sink).collect()}
    full = M.masked(spark.createDataFrame(allrows, PREDICTION_SCHEMA))
    full = full.withColumn("p", M.sigmoid(full["logit"])).withColumn("yy", full["y"].cast("int"))
    want = {r["task"]: r for r in M.ranking_metrics(full, ["task"], "p", "yy").collect()}
    for t in want:
        assert got[t]["roc_auc"] == pytest.approx(want[t]["roc_auc"], abs=1e-12)
        assert got[t]["average_precision"] == pytest.approx(want[t]["average_precision"], abs=1e-12)
