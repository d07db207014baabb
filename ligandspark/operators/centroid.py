"""Per-fold standardization and nearest-class-centroid scoring.

For every fold ``f`` the scaler and the two class centroids are fitted on the
rows of the *other* folds.  All of it comes from one vector aggregation per
``(fold, y)`` (count, sum and L2 norm per dimension): the statistics of "all folds but f"
are totals minus fold f, so no fold is materialized twice.  The statistics
are folds x classes x dims numbers (bounded by parameters and the feature
width), brought to the driver and put back as literal arrays; scoring is a
narrow JVM map over the feature arrays.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ligandspark.operators.metrics import sigmoid
from ligandspark.plans.sizing import collect_small


def _lit_array(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def _by_fold(fold: Column, arrays: dict[int, np.ndarray]) -> Column:
    m = F.create_map(*[c for f, a in sorted(arrays.items()) for c in (F.lit(f), _lit_array(a))])
    return F.element_at(m, fold)


def _merge(parts: list[tuple[float, np.ndarray, np.ndarray]], d: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, mean and sum of squared deviations of the union of disjoint parts;
    the mean of no rows is NaN."""
    n = sum(p[0] for p in parts)
    if not n:
        return 0.0, np.full(d, np.nan), np.zeros(d)
    pivot = max(parts, key=lambda p: p[0])[1]
    mean = pivot + sum(p[0] * (p[1] - pivot) for p in parts if p[0]) / n
    m2 = sum(p[2] + p[0] * (p[1] - mean) ** 2 for p in parts if p[0])
    return n, mean, m2


def fold_centroid_scores(df: DataFrame, fold: str = "fold", y: str = "y",
                         features: str = "features") -> DataFrame:
    """Adds ``logit`` = d(z, c_neg)^2 - d(z, c_pos)^2 and ``p`` = sigmoid(logit),
    where z is the row standardized with the statistics of its training folds
    and c_* the class centroids of those training rows (standardized)."""
    # one vector aggregate per (fold, class): count, mean and variance of every
    # dimension (merged moments, so a large mean costs no digits), without
    # exploding the feature arrays into n x d rows.  Features must be NaN-free here (the train-fit standardizer,
    # which must skip NaN per element, keeps the exploded form).
    summ = Summarizer.metrics("count", "mean", "variance")
    stats = (df.select(fold, y, array_to_vector(F.col(features)).alias("_v"))
             .groupBy(fold, y).agg(summ.summary(F.col("_v")).alias("_s")))
    rows = collect_small(stats.select(fold, y, F.col("_s.count").alias("n"),
                                      vector_to_array(F.col("_s.mean")).alias("mean"),
                                      vector_to_array(F.col("_s.variance")).alias("var")))
    folds = sorted({r[fold] for r in rows})
    d = len(rows[0]["mean"])
    # n, mean and sum of squared deviations of each (fold, class); the variance is the sample's
    parts = {(r[fold], r[y]): (float(r["n"]), np.asarray(r["mean"]), np.asarray(r["var"]) * max(r["n"] - 1, 0))
             for r in rows}
    mu, sd, cpos, cneg = {}, {}, {}, {}
    for f in folds:
        own = {c: _merge([v for (g, cc), v in parts.items() if g != f and cc == c], d) for c in (0, 1)}
        n, m, m2 = _merge(list(own.values()), d)
        s = np.sqrt(m2 / n) if n else np.ones(d)
        s[s == 0] = 1.0
        mu[f], sd[f] = m, s
        cpos[f] = (own[1][1] - m) / s
        cneg[f] = (own[0][1] - m) / s
    fc = F.col(fold)
    mu_c, sd_c, cp_c, cn_c = (_by_fold(fc, a) for a in (mu, sd, cpos, cneg))
    z = F.transform(F.col(features), lambda x, i: (x - F.element_at(mu_c, i + 1)) / F.element_at(sd_c, i + 1))

    def sqdist(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s_, t: s_ + t)

    out = df.withColumn("_z", z)
    out = out.withColumn("logit", sqdist(F.col("_z"), cn_c) - sqdist(F.col("_z"), cp_c)).drop("_z")
    return out.withColumn("p", sigmoid(F.col("logit")))
