"""A wavelet classifier trained on the cluster (M7).

One wavelet layer with one output, batch normalization, and a logistic loss with
weighted positives::

    u = sum_i w_i * psi((x_i - t_i) / s_i)
    logit = gain * (u - mean(u)) / sqrt(var(u) + eps) + bias

Weights, scales, translations, gain and bias are all trained.  Mean and variance
are those of the whole training table, so the gradient passes through them as
well: one scan sums the moments of ``u``, a second one the gradient's parts.
Both are vectors of a few times the feature width, merged over the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligandspark.functions.wavelets import WAVELETS, wavelet_np, wavelet_slope_np
from ligandspark.operators.metrics import sigmoid
from ligandspark.operators.partials import Moments, matrix, vector_moments, vector_sum
from ligandspark.operators.wavelet_layer import BN_EPS, WaveletLayer, apply_layer

LEAST_SCALE = 0.05      # scales stay above it


@dataclass
class WaveletClassifier:
    weights: np.ndarray         # (in,)
    scale: np.ndarray
    translation: np.ndarray
    gain: float = 1.0
    bias: float = 0.0
    wavelet: str = "dog"
    mean: float = 0.0           # of u over the training rows
    var: float = 1.0
    history: list[float] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.wavelet not in WAVELETS:
            raise ValueError(f"no wavelet is named {self.wavelet!r}; there are {', '.join(WAVELETS)}")

    @classmethod
    def init(cls, width: int, wavelet: str = "dog", seed: int = 7) -> WaveletClassifier:
        layer = WaveletLayer.init(width, 1, wavelet, seed)
        return cls(layer.weights[0], layer.scale[0], layer.translation[0], wavelet=wavelet)

    @property
    def layer(self) -> WaveletLayer:
        return WaveletLayer(self.weights[None], self.scale[None], self.translation[None], self.wavelet)

    def vector(self) -> np.ndarray:
        return np.concatenate([self.weights, self.scale, self.translation, [self.gain, self.bias]])

    def at(self, v: np.ndarray) -> WaveletClassifier:
        d = len(self.weights)
        return replace(self, weights=v[:d], scale=v[d:2 * d], translation=v[2 * d:3 * d], gain=float(v[-2]),
                       bias=float(v[-1]))

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``u`` of each row, and its derivatives by weights, scales and translations."""
        n = x.shape[1]
        z = (x - self.translation) / self.scale
        psi, slope = wavelet_np(self.wavelet, z, None, n), wavelet_slope_np(self.wavelet, z, None, n)
        inner = -self.weights * slope / self.scale
        return psi @ self.weights, np.hstack([psi, inner * z, inner])


def loss_and_gradient(df: DataFrame, features: str, label: str, model: WaveletClassifier, pos_weight: float,
                      eps: float = BN_EPS) -> tuple[float, np.ndarray, Moments]:
    """Mean weighted log loss over the rows, its gradient by :meth:`WaveletClassifier.vector`,
    and the moments of ``u``.  Two scans."""
    d = len(model.weights)
    held = df.sparkSession.sparkContext.broadcast(model)
    rows = df.where(F.col(label).isNotNull()).select(
        F.col(features).alias("_x"), F.col(label).cast("double").alias("_y"))
    u = apply_layer(rows.withColumn("_i", F.lit(0)), "_i", "_x", model.layer, "_u")
    found = vector_moments(u, "_u")
    if not found:
        return 0.0, np.zeros(3 * d + 2), Moments(*np.zeros((3, 1)))
    m = found[None]
    n, mean, dev = float(m.n[0]), float(m.mean[0]), float(np.sqrt(m.std[0] ** 2 + eps))
    gain, bias = model.gain, model.bias

    def of(columns: list[pa.Array]) -> np.ndarray:
        u, du = held.value.parts(matrix(columns[0], d))
        y = columns[1].to_numpy(zero_copy_only=False)
        h = (u - mean) / dev
        z = gain * h + bias
        w = np.where(y == 1, pos_weight, 1.0)
        r = w * (1.0 / (1.0 + np.exp(-np.clip(z, -700, 700))) - y)
        return np.concatenate([[(w * (np.logaddexp(0.0, z) - y * z)).sum(), r.sum(), (r * h).sum()],
                               r @ du, du.sum(axis=0), h @ du])

    s = vector_sum(rows, ["_x", "_y"], of)
    loss, r, rh = s[:3]
    by_r, plain, by_h = s[3:].reshape(3, 3 * d)
    # u moves the mean and the variance of all rows
    inner = gain / dev * (by_r - r / n * plain - rh / n * by_h)
    return loss / n, np.concatenate([inner, [rh, r]]) / n, m


def fit(df: DataFrame, features: str, label: str, model: WaveletClassifier, pos_weight: float,
        steps: int = 30, rate: float = 0.05) -> WaveletClassifier:
    """``steps`` full-batch steps (Adam) from ``model`` on; ``history`` has the loss
    before each step."""
    rows = df.select(F.col(features).alias("_x"), F.col(label).cast("double").alias("_y")).persist(
        StorageLevel.MEMORY_AND_DISK)
    v = model.vector()
    first, second, history, d = np.zeros_like(v), np.zeros_like(v), [], len(model.weights)
    try:
        for t in range(1, steps + 1):
            loss, g, _ = loss_and_gradient(rows, "_x", "_y", model.at(v), pos_weight)
            history.append(loss)
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            v = v - rate * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
            v[d:2 * d] = np.maximum(v[d:2 * d], LEAST_SCALE)
        loss, _, m = loss_and_gradient(rows, "_x", "_y", model.at(v), pos_weight)
    finally:
        rows.unpersist()
    return replace(model.at(v), mean=float(m.mean[0]), var=float(m.std[0] ** 2), history=[*history, loss])


def score(df: DataFrame, features: str, model: WaveletClassifier, eps: float = BN_EPS) -> DataFrame:
    """``df`` with ``logit`` and ``p``, normalized with the training rows' statistics."""
    held, d = df.sparkSession.sparkContext.broadcast(model), len(model.weights)
    dev = float(np.sqrt(model.var + eps))

    @F.pandas_udf("double")
    def logit(x):
        import pandas as pd

        m = held.value
        u = m.layer.pre_activation_np(np.stack(x.to_numpy()).astype(np.float64))[:, 0] if len(x) else np.zeros(0)
        return pd.Series(m.gain * (u - m.mean) / dev + m.bias)

    if df.schema[features].dataType.simpleString() != "array<double>":
        raise ValueError(f"{features} must be array<double> of width {d}")
    return df.withColumn("logit", logit(features)).withColumn("p", sigmoid(F.col("logit")))
