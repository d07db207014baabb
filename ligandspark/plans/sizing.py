"""Bounded collects and the spread of narrow scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def collect_small(df: DataFrame, max_rows: int = 1_000_000) -> list:
    """Collect a table that is small by construction (parameters, per-dimension
    statistics, class lists).  Raises instead of pulling unbounded data."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"expected at most {max_rows} rows, got more; not collecting")
    return rows


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread CPU-heavy per-row work over the cluster.

    A scan of a few large row groups yields fewer partitions than cores; then
    a round-robin repartition is worth its shuffle.  A scan that already has
    enough partitions (the normal case on a large cluster) is left alone, so
    no shuffle is added at scale.  Uses only the plan's partition count; no
    job runs."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df
