"""Stratified folds and class weights.

Fold assignment follows the stratified K-fold rule: the label-sorted rows
(classes in order of first appearance) are dealt round-robin to the folds,
which fixes how many rows of each class every fold gets; each class then fills
the folds in order with its rows taken in ``row order`` (unshuffled) or in a
seeded hash order (shuffled).  The shuffled order is ``md5(seed-row_id)``, so
the assignment depends only on (seed, row id), not on partitioning, and is
reproducible in any SQL engine.

The rank of a row inside its class is computed with the bucketed prefix scan,
so a class holding half of the rows is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ligandspark.plans.scan import prefix_scan


def seeded_order_key(row_id: Column, seed: int) -> Column:
    """60-bit integer from ``md5('<seed>-<row_id>')`` (first 15 hex digits)."""
    h = F.md5(F.concat(F.lit(f"{seed}-"), row_id.cast("string")))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def _quota_table(df: DataFrame, label: str, first_key: str, n_folds: int) -> DataFrame:
    """(label, fold, lo, hi): class ``label`` rows ranked [lo, hi) go to ``fold``.

    One row per class and fold; the window over the class table has no
    partition key, which is fine for a table with one row per class."""
    cls = df.groupBy(label).agg(F.count(F.lit(1)).alias("cnt"), F.min(first_key).alias("_first"))
    w = Window.orderBy("_first", label).rowsBetween(Window.unboundedPreceding, -1)
    cls = cls.withColumn("st", F.coalesce(F.sum("cnt").over(w), F.lit(0)))
    n = F.lit(n_folds)
    q = cls.select(label, "st", "cnt", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("fold"))
    quota = F.floor((F.col("st") + F.col("cnt") - 1 - F.col("fold")) / n) - F.floor(
        (F.col("st") - 1 - F.col("fold")) / n)
    q = q.withColumn("quota", quota.cast("long"))
    wf = Window.partitionBy(label).orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
    q = q.withColumn("hi", F.sum("quota").over(wf))
    return q.select(label, F.col("fold").cast("int").alias("fold"), (F.col("hi") - F.col("quota")).alias("lo"), "hi")


def stratified_folds(
    df: DataFrame,
    label: str,
    row_id: str,
    n_folds: int = 5,
    shuffle: bool = False,
    seed: int = 47,
) -> DataFrame:
    """Add ``fold`` (0-based): every row in exactly one fold, class shares kept.

    ``shuffle=False`` is the unshuffled stratified split used for 3-fold
    cross-validation scoring (W2); ``shuffle=True`` the seeded 5-fold split of
    the training driver (W1).  A NULL label is a class of its own."""
    if shuffle:
        keyed = df.withColumn("_ord", seeded_order_key(F.col(row_id), seed))
    else:
        keyed = df.withColumn("_ord", F.col(row_id).cast("long"))
    # one row per class: the last rank of each fold, so the fold is the number of folds that end before a row
    ends = (_quota_table(keyed, label, row_id, n_folds).groupBy(label)
            .agg(F.array_sort(F.collect_list("hi")).alias("_ends")))
    ranked = prefix_scan(keyed, [label], "_ord", tiebreak=[row_id], row_number="_rn")
    ends = ends.withColumnRenamed(label, "_class")
    joined = ranked.join(ends, F.col(label).eqNullSafe(F.col("_class")))
    fold = F.size(F.filter("_ends", lambda e: e < F.col("_rn")))
    return joined.withColumn("fold", fold.cast("int")).drop("_ord", "_rn", "_ends", "_class")


def class_weight_by_fold(df: DataFrame, fold: str, label: str) -> DataFrame:
    """A2: ``n_neg / n_pos`` over each fold's training rows (all other folds)."""
    per = df.groupBy(fold).agg(
        F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))
    w = Window.partitionBy()  # one row per fold: tiny table
    tot = per.select(
        fold,
        (F.sum("_p").over(w) - F.col("_p")).alias("n_pos"),
        (F.sum("_n").over(w) - F.col("_n")).alias("n_neg"),
    )
    return tot.withColumn(
        "pos_weight",
        F.when(F.col("n_pos") > 0, F.col("n_neg").cast("double") / F.col("n_pos")),
    )


def task_pos_weight(long_df: DataFrame, task: str = "task", y: str = "y") -> DataFrame:
    """A3: per task ``n(y=0) / (n(y=1) + 1e-8)``; labels other than 0/1 and the
    mask are ignored, like the reference."""
    g = long_df.groupBy(task).agg(
        F.count_if(F.col(y) == 1).alias("n_pos"), F.count_if(F.col(y) == 0).alias("n_neg"))
    return g.withColumn("pos_weight", F.col("n_neg") / (F.col("n_pos") + F.lit(1e-8)))
