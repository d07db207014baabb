"""Metric-history operators (W3, W4, W5, T1) over ``(run, epoch, score)`` tables.

The early-stopping rule is a running state in the reference (best score,
counter).  Here it is a scan: the best score before each epoch (running max,
strictly preceding) gives the improvement flag; the last improving epoch is a
running max of improving epochs; the stop is the first epoch whose distance to
it reaches the patience.  Both running maxima use the bucketed prefix scan,
so a run with a third of all rows is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligandspark.plans.scan import RANGE, assign_ranges, prefix_scan, scan_ranges


def number_epochs(df: DataFrame, run: str, order_key: str, tiebreak: str, epoch: str = "epoch") -> DataFrame:
    """1-based epoch per run in ``(order_key, tiebreak)`` order."""
    return prefix_scan(df, [run], order_key, tiebreak=[tiebreak], row_number=epoch)


def running_best(df: DataFrame, run: str, epoch: str, score: str, mode: str = "higher") -> DataFrame:
    """Best score so far per run (max for ``higher``, min for ``lower``)."""
    if mode == "higher":
        r = prefix_scan(_no_nan(df, score), [run], epoch, maxes=["_score"]).drop("_score")
        return r.withColumnRenamed("runmax__score", "running_best")
    r = prefix_scan(_no_nan(df, score), [run], epoch, mins=["_score"]).drop("_score")
    return r.withColumnRenamed("runmin__score", "running_best")


def _no_nan(df: DataFrame, score: str) -> DataFrame:
    """A NaN score is no score: it is never the best (NaN sorts above all numbers)."""
    return df.withColumn("_score", _number(score))


def _number(score: str):
    return F.nanvl(F.col(score).cast("double"), F.lit(None))


def best_epoch(df: DataFrame, run: str, epoch: str, score: str, mode: str = "higher") -> DataFrame:
    """Epoch with the best score per run, earliest on ties."""
    s = _number(score) if mode == "higher" else -_number(score)
    g = df.groupBy(run).agg(F.max_by(F.col(epoch), F.when(s.isNotNull(), F.struct(s, -F.col(epoch)))).alias("best_epoch"),
                            (F.max(s) if mode == "higher" else -F.max(s)).alias("best_score"))
    return g


def early_stop(df: DataFrame, run: str, epoch: str, score: str, patience: int,
               mode: str = "higher") -> DataFrame:
    """Per run ``n_epochs``, ``stop_epoch`` (first epoch at which the
    counter of non-improving epochs reaches ``patience``; NULL if never),
    ``best_epoch`` (last strict improvement up to the stop) and
    ``best_score``.  The first score is always an improvement; a NULL or NaN
    score never is."""
    s = _number(score) if mode == "higher" else -_number(score)
    ranged = assign_ranges(df.withColumn("_s", s), [run], epoch)        # both scans use the same ranges
    d = scan_ranges(ranged, maxes=["_s"], inclusive=False).withColumnRenamed("runmax__s", "_prev")
    better = F.col("_s").isNotNull() & (F.col("_prev").isNull() | (F.col("_s") > F.col("_prev")))
    d = d.withColumn("_imp_epoch", F.when(better, F.col(epoch)))
    d = scan_ranges(ranged.derive(d), maxes=["_imp_epoch"]).withColumnRenamed("runmax__imp_epoch", "_last").drop(RANGE)
    d = d.withColumn("_best", F.greatest(F.col("_prev"), F.col("_s")))
    stopped = (F.col(epoch) - F.coalesce(F.col("_last"), F.lit(0))) >= patience
    g = d.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_epochs"),
        F.min(F.when(stopped, F.col(epoch))).alias("stop_epoch"),
        F.min_by(F.struct(F.col("_last"), F.col("_best")), F.when(stopped, F.col(epoch))).alias("_at_stop"),
        F.max("_imp_epoch").alias("_last_all"),
        F.max("_s").alias("_max_all"),
    )
    sign = 1.0 if mode == "higher" else -1.0
    return g.select(
        run, "n_epochs", "stop_epoch",
        F.when(F.col("stop_epoch").isNotNull(), F.col("_at_stop._last")).otherwise(F.col("_last_all")).alias("best_epoch"),
        (F.lit(sign) * F.when(F.col("stop_epoch").isNotNull(), F.col("_at_stop._best"))
         .otherwise(F.col("_max_all"))).alias("best_score"),
    )
