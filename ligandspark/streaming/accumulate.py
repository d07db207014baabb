"""Prediction accumulation (A28) fed by a Structured Streaming source; the batch
form is :mod:`ligandspark.operators.accumulate`.

Scored batches (``run, task, logit, y, mask``) arrive as parquet files in a
folder.  Each micro-batch is reduced to counts per ``(run, task, score)`` -
the sufficient statistics of every exact ranking metric - and written to
``<sink>/batch_id=<n>`` with overwrite, so a retried micro-batch replaces its
own output (exactly-once with the checkpointed source offsets).  Metrics over
everything seen so far are one aggregation of the count table; nothing is
kept in driver memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ligandspark.operators.accumulate import KEYS, batch_counts, merged_counts
from ligandspark.operators.metrics import curve_from_counts, metrics_from_curve

PREDICTION_SCHEMA = "run string, task string, logit double, y double, mask double"
def start_accumulator(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                      schema: str = PREDICTION_SCHEMA, available_now: bool = True,
                      max_files_per_trigger: int | None = None):
    """Start the stream; with ``available_now`` it processes what is there and stops."""

    def per_batch(df: DataFrame, batch_id: int) -> None:
        batch_counts(df).write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/batch_id={batch_id}")

    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    w = (r.parquet(source_dir).writeStream
         .foreachBatch(per_batch).option("checkpointLocation", checkpoint_dir))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def accumulated_metrics(spark: SparkSession, sink_dir: str) -> DataFrame:
    """roc_auc / average_precision / pr_auc_trapezoid per (run, task) over all
    accumulated batches."""
    counts = merged_counts(spark.read.parquet(sink_dir))
    return metrics_from_curve(curve_from_counts(counts, KEYS), KEYS)
