"""Train-fit standardization and keyed feature assembly.

Feature vectors are ``array<double>`` columns keyed by an explicit row id; the
wide ``prefix_1..prefix_n`` form exists only at the CSV boundary
(:mod:`ligandspark.functions.vectors`).

Standardization is an estimator: :func:`fit_standardizer` is one scan that
merges partial moments of whole vectors (:mod:`ligandspark.operators.partials`;
nothing is exploded, NaN is left out component by component), returns ``d``
means and population standard deviations to the driver (bounded by the feature
width, not by the data) and :meth:`Standardizer.transform` is a narrow map with
literal arrays, no join.
Not ``pyspark.ml.feature.StandardScaler``: that one uses the sample std and
maps constant columns to 0; here constant columns keep scale 1.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ligandspark.operators.partials import vector_moments


@dataclass
class Standardizer:
    means: list[float]
    scales: list[float]

    def transform(self, df: DataFrame, features: str = "features", out: str | None = None) -> DataFrame:
        out = out or features
        mu, sd = (F.lit([float(x) for x in v]).cast("array<double>") for v in (self.means, self.scales))
        z = F.transform(
            F.col(features),
            lambda x, i: (x.cast("double") - F.element_at(mu, i + 1)) / F.element_at(sd, i + 1),
        )
        return df.withColumn(out, z)


def fit_standardizer(df: DataFrame, features: str = "features", where: Column | None = None) -> Standardizer:
    """Mean and population std per dimension over the rows selected by
    ``where`` (the training split); zero or undefined spread -> scale 1."""
    found = vector_moments(df if where is None else df.where(where), features)
    if not found:
        return Standardizer([], [])
    m = found[None]
    return Standardizer([float(x) for x in m.mean], [float(x) if x > 0 else 1.0 for x in m.std])


def standardize_train_fit(df: DataFrame, features: str = "features", split: str = "split",
                          train_value: str = "train") -> DataFrame:
    """A1: fit on ``split == train``, apply to every split."""
    return fit_standardizer(df, features, F.col(split) == train_value).transform(df, features)


def concat_blocks(
    left: DataFrame, right: DataFrame, keys: Sequence[str],
    left_features: str = "features", right_features: str = "features",
    out: str = "features",
) -> DataFrame:
    """Per key ``left ++ right``; keys present in one block only are dropped
    (see :func:`unmatched_keys`).  An equi-join on the row key: both sides are
    shuffled on the key once; no positional zip."""
    l = left.withColumnRenamed(left_features, "_lf")
    r = right.select(*keys, F.col(right_features).alias("_rf"))
    return l.join(r, list(keys), "inner").withColumn(out, F.concat("_lf", "_rf")).drop("_lf", "_rf")


def unmatched_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Report of keys found in one feature block only: ``side`` is
    ``left_only`` or ``right_only`` (anti joins both ways)."""
    lk, rk = left.select(*keys), right.select(*keys)
    return lk.join(rk, list(keys), "left_anti").withColumn("side", F.lit("left_only")).unionByName(
        rk.join(lk, list(keys), "left_anti").withColumn("side", F.lit("right_only")))


def star_lookup(
    fact: DataFrame, drugs: DataFrame, targets: DataFrame,
    drug_key: str = "drug_id", target_key: str = "target_id",
    drug_features: str = "drug_features", target_features: str = "target_features",
) -> DataFrame:
    """Per interaction row its drug vector and target vector by id.

    Dimension tables grow with the data, so no broadcast is forced: the
    planner broadcasts a side under ``autoBroadcastJoinThreshold`` from its
    statistics and AQE converts at run time from measured sizes; otherwise a
    sort-merge join on the id (AQE splits a skewed id)."""
    return fact.join(drugs, drug_key, "inner").join(targets, target_key, "inner")
