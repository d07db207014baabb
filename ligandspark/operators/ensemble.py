"""Prediction ensembles and consensus scores.

Groups (copies or variants of a sample, rows of a batch) are small by intent, but
none of these jobs relies on it: means are partial aggregations, variants meet
their canonical vector in a join, and the pair cosines of a large batch are
computed tile by tile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ligandspark.functions.vectors import cosine
from ligandspark.operators.metrics import sigmoid
from ligandspark.session import materialize


TILE = 4_096    # rows of a batch whose pair cosines are one block; more make tiles


def positional_sample(position: Column, n_samples: int) -> Column:
    """Sample of a row when ``aug_times`` copies are laid out as consecutive
    blocks of ``n_samples`` rows: ``position mod n_samples``."""
    return (position % F.lit(n_samples)).cast("long")


def tta_ensemble(df: DataFrame, sample: str, logit: str = "logit", y: str = "y",
                 mask: str | None = "mask") -> DataFrame:
    """Per sample the mean of logits, labels and masks over its copies,
    then the sigmoid of the mean logit."""
    aggs = [F.avg(logit).alias("logit"), F.avg(F.col(y).cast("double")).alias("mean_y")]
    if mask:
        aggs.append(F.avg(F.col(mask).cast("double")).alias("mean_mask"))
    g = df.groupBy(sample).agg(*aggs, F.count(F.lit(1)).alias("n_copies"))
    return g.withColumn("p", sigmoid(F.col("logit")))


def variant_ensemble(df: DataFrame, sample: str, variant: str, logit: str = "logit",
                     y: str = "y", canonical: int = 0) -> DataFrame:
    """Mean of the variant-head logits per sample, then the sigmoid; the
    label is the canonical variant's."""
    g = df.groupBy(sample).agg(
        F.avg(logit).alias("logit"),
        F.max(F.when(F.col(variant) == canonical, F.col(y))).alias("y"),
        F.count(F.lit(1)).alias("n_variants"),
    )
    return g.withColumn("p", sigmoid(F.col("logit")))


def variant_cosines(df: DataFrame, sample: str, variant: str, features: str = "features",
                    canonical: int = 0) -> DataFrame:
    """Per sample, cosine of the canonical vector with every other variant.

    A join on the sample: one canonical row per sample (of several the first
    by value) meets any number of variants, none is collected.  A sample without
    its canonical vector gives no row."""
    own = F.col(variant) == canonical
    first = df.where(own).groupBy(sample).agg(F.min(features).alias("_c")).where("_c is not null")
    others = df.where(~own).select(sample, variant, F.col(features).alias("_v"))
    return others.join(first, sample).select(sample, variant, cosine(F.col("_c"), F.col("_v")).alias("cos"))


def variant_consensus(df: DataFrame, sample: str, variant: str, features: str = "features",
                      canonical: int = 0) -> DataFrame:
    """``consensus = (n - sum cos) / (2n)`` over the n non-canonical
    variants ((4 - sum)/8 for four), and ``cos_similarity = 1 - 2 consensus``,
    the mean cosine."""
    cs = variant_cosines(df, sample, variant, features, canonical)
    g = cs.groupBy(sample).agg(F.sum("cos").alias("_s"), F.count(F.lit(1)).alias("_n"))
    cons = (F.col("_n") - F.col("_s")) / (F.lit(2.0) * F.col("_n"))
    return g.select(sample, cons.alias("consensus"), (F.lit(1.0) - 2 * cons).alias("cos_similarity"))


def batch_diversity(df: DataFrame, batch: str, features: str = "features", tile: int = TILE) -> DataFrame:
    """Mean over all B x B cells of ``|cos| - identity`` per batch, i.e.
    ``2 * sum_{a<b} |cos(a, b)| / B^2``.

    The rows of a batch are dealt to tiles of about ``tile`` rows, and each pair
    of tiles is one numpy block (a matrix product in ``applyInPandas``); the
    blocks' sums are added.  A batch up to ``tile`` rows is one block; of larger
    ones there are fewer than rows / ``tile``, so their sizes are broadcast.  No
    pair rows are emitted."""
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T

    rows = df.select(F.col(batch).alias("_batch"), F.col(features).alias("_f"))
    large = rows.groupBy("_batch").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > tile)
    pairs = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))
    if large.isEmpty():
        tiled = rows.withColumns({"_t": F.lit(0), "_pair": F.explode(pairs)})
    else:
        # the row's number deals it to a tile, so it must not change: a written table
        rows = materialize(rows, "batches").withColumn("_at", F.monotonically_increasing_id())
        sizes = F.broadcast(large.select(F.col("_batch").alias("_key"), F.ceil(F.col("_n") / tile).cast("int").alias("_k")))
        rows = rows.join(sizes, F.col("_batch").eqNullSafe(F.col("_key")), "left").withColumn(
            "_k", F.coalesce("_k", F.lit(1)))
        rows = rows.withColumn("_t", F.pmod(F.xxhash64("_at"), F.col("_k")).cast("int"))
        tiled = rows.withColumn("_pair", F.explode(F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda o: F.struct(
            F.least(o, F.col("_t")).alias("a"), F.greatest(o, F.col("_t")).alias("b")))))
    tiled = tiled.select("_batch", "_f", "_t", F.col("_pair.a").alias("_a"), F.col("_pair.b").alias("_b"))
    key_type = df.schema[batch].dataType
    schema = T.StructType([T.StructField("_batch", key_type), T.StructField("_rows", T.LongType()),
                           T.StructField("_sum", T.DoubleType())])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, t = int(pdf["_a"].iloc[0]), int(pdf["_b"].iloc[0]), pdf["_t"].to_numpy()
        X = np.stack(pdf["_f"].to_numpy()).astype(np.float64)
        X = X / np.sqrt((X * X).sum(axis=1))[:, None]
        if a == b:
            total, n = 2.0 * np.triu(np.abs(X @ X.T), k=1).sum(), len(X)
        else:
            total, n = 2.0 * np.abs(X[t == a] @ X[t == b].T).sum(), 0
        return pd.DataFrame({"_batch": [pdf["_batch"].iloc[0]], "_rows": [n], "_sum": [total]})

    sums = tiled.groupBy("_batch", "_a", "_b").applyInPandas(one, schema).groupBy("_batch").agg(
        F.sum("_rows").alias("batch_rows"), F.sum("_sum").alias("_s"))
    return sums.select(F.col("_batch").alias(batch), "batch_rows",
                       (F.col("_s") / (F.col("batch_rows") * F.col("batch_rows"))).alias("diversity"))
