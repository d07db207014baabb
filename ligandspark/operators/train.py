"""Class-weighted classifiers, cross-validation and independent test
(M1, M2, M4, B3).

Re-aimed: the reference trains a single-GPU network; here the classifier is a
logistic regression with positives weighted ``n_neg / n_pos`` of the training
rows, fitted on the cluster.  All folds' models are fitted together: a row
belongs to the training data of every fold but its own, so one scan sums the
loss and the gradient of all ``k`` models (a matrix product per Arrow batch,
partial sums merged over the tasks), and the driver takes one L-BFGS step for
each model.  ``k`` models cost one scan per step, not ``k``.

The penalty is on the weights of standardized features, as in ``pyspark.ml``
(scale of each feature from its training rows); with ``per_fold=True`` rows are
standardized with the mean and population deviation of the fold's training rows
(A1 within M1).  The statistics are merged moments of the folds that a model
trains on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ligandspark.operators.metrics import sigmoid
from ligandspark.operators.partials import Moments, matrix, union, vector_moments, vector_sum
from ligandspark.plans.sizing import collect_small

REG = 0.01
MEMORY = 10         # pairs that an L-BFGS step looks back on
TOLERANCE = 1e-9    # relative change of the loss at which a model is done
ALL = -1            # the fold of a model that trains on all rows


@dataclass
class LinearModel:
    """Weights on the raw features, and the intercept."""
    coefficients: np.ndarray
    intercept: float


class Descent:
    """Minimizes one function by L-BFGS, whose values are given from outside:
    ``ask`` is the point to evaluate next, ``tell`` takes its value and gradient."""

    def __init__(self, start: np.ndarray, steps: int) -> None:
        self.x, self.ask, self.steps = start, start, steps
        self.loss, self.gradient, self.direction, self.length = np.inf, None, None, 1.0
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.done = False

    def tell(self, loss: float, gradient: np.ndarray) -> None:
        if self.gradient is not None:
            slope = self.gradient @ self.direction
            if not loss <= self.loss + 1e-4 * self.length * slope:
                self.length /= 2
                if self.length < 1e-10:
                    self.done = True
                self.ask = self.x + self.length * self.direction
                return
            s, y = self.ask - self.x, gradient - self.gradient
            if s @ y > 1e-12 * (y @ y):
                self.pairs = [*self.pairs[-(MEMORY - 1):], (s, y)]
            self.steps -= 1
            if self.steps <= 0 or abs(self.loss - loss) <= TOLERANCE * max(abs(loss), 1e-12):
                self.done = True
        self.x, self.loss, self.gradient = self.ask, loss, gradient
        if np.abs(gradient).max(initial=0.0) < 1e-10:
            self.done = True
        self.direction, self.length = -self._scaled(gradient), 1.0
        self.ask = self.x + self.direction

    def _scaled(self, g: np.ndarray) -> np.ndarray:
        q, kept = g.copy(), []
        for s, y in reversed(self.pairs):
            a = (s @ q) / (s @ y)
            kept.append(a)
            q -= a * y
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, np.linalg.norm(g))
        for (s, y), a in zip(self.pairs, reversed(kept), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        return q


def fold_sums(df: DataFrame, features: str, label: str, fold: str, folds: np.ndarray, points: np.ndarray,
              pos_weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss and gradient of all folds' models in one scan.

    ``points`` has a row ``(weights on the raw features, intercept)`` for each of
    ``folds``; the model of fold f is summed over the rows of the other folds
    (``ALL``: over all rows).  Returns the weighted sums of the log loss and of
    its gradient, not divided by the number of rows.  NaN features count as 0."""
    k, d = len(folds), points.shape[1] - 1
    held = df.sparkSession.sparkContext.broadcast((folds, points, pos_weight))     # folds x width numbers

    def of(columns: list[pa.Array]) -> np.ndarray:
        own, w, pw = held.value
        x = np.nan_to_num(matrix(columns[0], d), nan=0.0)
        y = columns[1].to_numpy(zero_copy_only=False).astype(np.float64)[:, None]
        f = columns[2].to_numpy(zero_copy_only=False)[:, None]
        z = x @ w[:, :d].T + w[:, d]
        share = np.where(f != own[None, :], np.where(y == 1, pw[None, :], 1.0), 0.0)
        loss = (share * (np.logaddexp(0.0, z) - y * z)).sum(axis=0)
        r = share * (1.0 / (1.0 + np.exp(-np.clip(z, -700, 700))) - y)
        return np.concatenate([loss, np.column_stack([r.T @ x, r.sum(axis=0)]).ravel()])

    rows = df.where(F.col(label).isNotNull()).select(
        F.col(features).alias("_x"), F.col(label).cast("double").alias("_y"), F.col(fold).cast("long").alias("_f"))
    total = vector_sum(rows, ["_x", "_y", "_f"], of)
    if total is None:
        return np.zeros(k), np.zeros((k, d + 1))
    return total[:k], total[k:].reshape(k, d + 1)


def fit_folds(df: DataFrame, features: str, label: str, fold: str, pos_weight: dict[int, float],
              reg: float = REG, max_iter: int = 100, per_fold: bool = False) -> dict[int, LinearModel]:
    """M4 for all folds together: ``{fold: model}``, each fitted on the rows of the
    other folds (key ``ALL``: on all rows) with positives weighted by
    ``pos_weight[fold]``."""
    folds = np.array(sorted(pos_weight), np.int64)
    pw = np.array([pos_weight[int(f)] for f in folds], np.float64)
    rows = df.where(F.col(label).isNotNull()).select(
        F.col(features).alias("_x"), F.col(label).cast("int").alias("_y"), F.col(fold).cast("long").alias("_f"))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # moments and counts per (fold, class); those of a training set are the union of its parts
        counts = {(r["_f"], r["_y"]): r["n"] for r in collect_small(
            rows.groupBy("_f", "_y").agg(F.count(F.lit(1)).alias("n")))}
        parts = vector_moments(rows.withColumn("_k", F.col("_f") * 2 + F.col("_y")), "_x", "_k")
        n, start, scale, centre = [], [], [], []
        for f, w in zip(folds, pw, strict=True):
            pos, neg = (sum(c for (g, y), c in counts.items() if g != f and y == v) for v in (1, 0))
            n.append(max(1.0, w * pos + neg))
            total = union([parts[k] for k in sorted(parts) if k // 2 != f] or [Moments.of(np.zeros((0, 0)))])
            if per_fold:
                std, mean = total.std, total.mean
            else:
                std, mean = _weighted_std([parts[k] for k in sorted(parts) if k // 2 != f],
                                          [w if k % 2 else 1.0 for k in sorted(parts) if k // 2 != f]), 0.0 * total.mean
            scale.append(np.where(std > 0, std, 1.0 if per_fold else 0.0))
            centre.append(mean)
            start.append(np.log(max(w * pos, 1e-12) / max(neg, 1e-12)) if pos and neg else 0.0)
        scale, centre, n = np.array(scale), np.array(centre), np.array(n)
        inverse = np.where(scale > 0, 1.0 / np.where(scale > 0, scale, 1.0), 0.0)   # a constant feature has no weight
        d = scale.shape[1]

        def raw(points: np.ndarray, at: list[int]) -> np.ndarray:
            """Points in standardized space, of the models ``at``, as weights on the raw features."""
            w = points[:, :d] * inverse[at]
            return np.column_stack([w, points[:, d] - (w * centre[at]).sum(axis=1)])

        models = [Descent(np.append(np.zeros(d), b), max_iter) for b in start]
        while not all(m.done for m in models):
            points = np.array([m.ask if not m.done else m.x for m in models])
            live = [i for i, m in enumerate(models) if not m.done]
            loss, gradient = fold_sums(rows, "_x", "_y", "_f", folds[live], raw(points[live], live), pw[live])
            for j, i in enumerate(live):
                p = points[i]
                g = (gradient[j, :d] - gradient[j, d] * centre[i]) * inverse[i] / n[i] + reg * p[:d]
                models[i].tell(loss[j] / n[i] + reg * (p[:d] @ p[:d]) / 2, np.append(g, gradient[j, d] / n[i]))
        final = raw(np.array([m.x for m in models]), list(range(len(models))))
    finally:
        rows.unpersist()
    return {int(f): LinearModel(w[:d], float(w[d])) for f, w in zip(folds, final, strict=True)}


def _weighted_std(parts: list[Moments], weights: list[float]) -> np.ndarray:
    """Unbiased standard deviation when every row of a part counts ``weight`` times."""
    n = sum(w * p.n for p, w in zip(parts, weights, strict=True))
    # around one part's mean, so that a constant feature has a deviation of exactly 0
    pivot = max(parts, key=lambda p: p.n.sum()).mean
    mean = pivot + sum(w * p.n * (p.mean - pivot) for p, w in zip(parts, weights, strict=True)) / np.maximum(n, 1e-300)
    m2 = sum(w * (p.m2 + p.n * (p.mean - mean) ** 2) for p, w in zip(parts, weights, strict=True))
    free = n - sum(w * w * p.n for p, w in zip(parts, weights, strict=True)) / np.maximum(n, 1e-300)
    return np.sqrt(np.maximum(m2 / np.where(free > 0, free, np.inf), 0.0))


def fit_weighted(df: DataFrame, features: str, label: str, pos_weight: float,
                 reg: float = REG, max_iter: int = 100) -> LinearModel:
    """M4: logistic regression on all rows, positives weighted by ``pos_weight``."""
    one = df.withColumn("_fold", F.lit(ALL - 1))
    return fit_folds(one, features, label, "_fold", {ALL: pos_weight}, reg, max_iter)[ALL]


def margin(features: str, weights: str, intercept: str):
    return F.aggregate(F.zip_with(features, weights, lambda x, w: x * w), F.col(intercept), lambda s, t: s + t)


def score(df: DataFrame, model: LinearModel, features: str) -> DataFrame:
    """``logit`` (margin) and ``p`` (sigmoid) for every row."""
    out = df.withColumns({"_w": F.lit([float(x) for x in model.coefficients]).cast("array<double>"),
                          "_b": F.lit(float(model.intercept))})
    out = out.withColumn("logit", margin(features, "_w", "_b")).drop("_w", "_b")
    return out.withColumn("p", sigmoid(F.col("logit")))


def training_weights(df: DataFrame, fold: str, label: str) -> dict[int, float]:
    """``n_neg / n_pos`` of each fold's training rows (A2); 1 where there is no positive."""
    n = {(r[fold], r["_y"]): r["n"] for r in collect_small(
        df.where(F.col(label).isNotNull()).groupBy(fold, F.col(label).cast("int").alias("_y")).agg(
            F.count(F.lit(1)).alias("n")))}
    out = {}
    for f in sorted({f for f, _ in n}):
        pos, neg = (sum(c for (g, y), c in n.items() if g != f and y == v) for v in (1, 0))
        out[int(f)] = neg / pos if pos else 1.0
    return out


def score_held_out(df: DataFrame, models: DataFrame, features: str, fold: str) -> DataFrame:
    """Every row with ``logit`` and ``p`` of the model of its own fold, which has
    not seen it: one scan, and a broadcast table of one row per fold."""
    m = models.select(F.col("fold").cast("long").alias("_mf"), F.col("weights").alias("_w"), F.col("intercept").alias("_b"))
    j = df.join(F.broadcast(m), F.col(fold).cast("long") == F.col("_mf"))
    return j.withColumn("logit", margin(features, "_w", "_b")).withColumn("p", sigmoid(F.col("logit"))).drop(
        "_mf", "_w", "_b")


def cross_validate(df: DataFrame, features: str, label: str, fold: str, per_fold: bool = False,
                   save_to: str | None = None, reg: float = REG, max_iter: int = 100):
    """M1: per fold, train on the other folds (class weight from them) and score
    the held-out fold.  Returns (predictions, {fold: model}, {fold: pos_weight}).

    ``per_fold`` standardizes with the training folds' statistics; ``save_to``
    writes the fold models (:func:`save_models`), to be loaded for M2."""
    weights = training_weights(df, fold, label)
    models = fit_folds(df, features, label, fold, weights, reg, max_iter, per_fold)
    table = model_table(df.sparkSession, models)
    if save_to:
        save_models(table, save_to)
    return score_held_out(df, table, features, fold), models, weights


def model_table(spark: SparkSession, models: dict[int, LinearModel]) -> DataFrame:
    """One row per fold model: ``fold, weights, intercept`` (weights on the raw features)."""
    rows = [(int(f), [float(x) for x in m.coefficients], float(m.intercept)) for f, m in sorted(models.items())]
    return spark.createDataFrame(rows, "fold int, weights array<double>, intercept double")


def save_models(table: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Fold models as a small table, to be scored later by :func:`independent_test`."""
    table.coalesce(1).write.mode(mode).parquet(path)


def load_models(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("fold int, weights array<double>, intercept double").parquet(path)


def independent_test(test: DataFrame, models: DataFrame, features: str, fold_col: str = "fold") -> DataFrame:
    """M2: every fold model of :func:`model_table` scores the whole test split;
    no averaging.  One pass over the split: each row is repeated for the folds'
    numbers and meets that fold's weights in a broadcast table (one row per
    fold, a parameter)."""
    folds = [r["fold"] for r in collect_small(models.select("fold").orderBy("fold"), 1000)]
    m = models.select(F.col("fold").cast("int").alias(fold_col), F.col("weights").alias("_w"),
                      F.col("intercept").alias("_b"))
    out = test.withColumn(fold_col, F.explode(F.lit(folds).cast("array<int>"))).join(F.broadcast(m), fold_col)
    out = out.withColumn("logit", margin(features, "_w", "_b")).drop("_w", "_b")
    return out.withColumn("p", sigmoid(F.col("logit")))
