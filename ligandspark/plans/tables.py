"""Roles of the test tables (see FIXTURES.md) as DataFrames.

Every role reads the given parquet tables (column pruning and filter pushdown
reach the scan) and derives keys with built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ligandspark.session import read_table

# Fixed role parameters of the test tables.
EVENT_POSITIVE_TYPE = "purchase"   # events: label = 1 for this event_type
EVENT_LOGIT_CENTER = 100.0         # events: logit = (value - center) / scale
EVENT_LOGIT_SCALE = 25.0
N_EVAL_FOLDS = 5                   # events / documents: fold = id mod 5


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, features array<double>, label (0-9), y = label < 5,
    split (vec_id mod 5 = 0 -> test), sample_id = vec_id div 5,
    variant = vec_id mod 5."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id",
        F.transform("embedding", lambda x: x.cast("double")).alias("features"),
        "label",
        (F.col("label") < 5).cast("int").alias("y"),
        F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train").alias("split"),
        (F.col("vec_id") / 5).cast("long").alias("sample_id"),
        (F.col("vec_id") % 5).cast("int").alias("variant"),
    )


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as scored rows: y, logit, p, fold (user_id mod 5)."""
    ev = read_table(spark, sf_dir, "events")
    logit = (F.col("value") - F.lit(EVENT_LOGIT_CENTER)) / F.lit(EVENT_LOGIT_SCALE)
    return ev.select(
        "event_id", "user_id", "ts", "value",
        (F.col("event_type") == EVENT_POSITIVE_TYPE).cast("int").alias("y"),
        logit.alias("logit"),
        (F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))).alias("p"),
        (F.col("user_id") % N_EVAL_FOLDS).cast("int").alias("fold"),
    )
