"""Wavelet layers for batch scoring (M5, M6).

``out_j = BN_j( sum_i w_ji * psi((x_i - t_ji) / s_ji) )``; the base linear
branch of the reference is computed there but not added, so it is not here.

The layer's parameters (out x in numbers) are a broadcast variable, one copy per
executor.  Each Arrow batch is a numpy block, worked through in chunks of rows
and blocks of output columns, so a task needs a few ``BLOCK_BYTES`` whatever
the layer's size; an explode-and-join plan would create rows x in x out rows.
Where all outputs share scale and translation of an input (as at the start of
training), the basis is expanded once per row and the sums are one matrix
product.  Batch normalization uses either the statistics of the scored table
(training-mode semantics: merged moments, ``out`` means and population
variances) or supplied running statistics (evaluation mode).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ligandspark.functions.wavelets import WAVELETS, wavelet_np
from ligandspark.operators.partials import matrix, vector_moments
from ligandspark.session import materialize

BN_EPS = 1e-5
BLOCK_BYTES = 32 << 20    # of one temporary block; a few are alive at once


@dataclass
class WaveletLayer:
    weights: np.ndarray       # (out, in)
    scale: np.ndarray         # (out, in)
    translation: np.ndarray   # (out, in)
    wavelet: str = "mexican_hat"

    def __post_init__(self):
        if self.wavelet not in WAVELETS:
            raise ValueError(f"no wavelet is named {self.wavelet!r}; there are {', '.join(WAVELETS)}")

    @property
    def shape(self) -> tuple[int, int]:
        return self.weights.shape

    @staticmethod
    def init(in_features: int, out_features: int, wavelet: str = "mexican_hat", seed: int = 7) -> WaveletLayer:
        """Weights uniform in +-1/sqrt(in); scale 1, translation 0."""
        b = 1.0 / np.sqrt(in_features)
        w = np.random.RandomState(seed).uniform(-b, b, (out_features, in_features))
        return WaveletLayer(w, np.ones_like(w), np.zeros_like(w), wavelet)

    @property
    def shared(self) -> bool:
        """Whether all outputs have the same scale and translation of each input."""
        return bool((self.scale == self.scale[:1]).all() and (self.translation == self.translation[:1]).all())

    def pre_activation_np(self, X: np.ndarray, block_bytes: int = BLOCK_BYTES) -> np.ndarray:
        """Wavelet sums of a block of rows.  A temporary block holds about
        ``block_bytes``: some rows by all inputs if scale and translation are
        shared, else some rows by some outputs by all inputs."""
        n_out, n_in = self.weights.shape
        out = np.empty((X.shape[0], n_out))
        fits = max(1, block_bytes // (8 * n_in))
        rows, cols = (fits, n_out) if self.shared else (max(1, fits // n_out), min(n_out, fits))
        for a in range(0, X.shape[0], rows):
            x = X[a:a + rows]
            if self.shared:
                psi = wavelet_np(self.wavelet, (x - self.translation[0]) / self.scale[0], None, n_in)
                out[a:a + rows] = psi @ self.weights.T
                continue
            for c in range(0, n_out, cols):
                o = slice(c, c + cols)
                psi = wavelet_np(self.wavelet, (x[:, None, :] - self.translation[o]) / self.scale[o], None, n_in)
                out[a:a + rows, o] = np.einsum("roi,oi->ro", psi, self.weights[o])
        return out


def apply_layer(df: DataFrame, id_col: str, features: str, layer: WaveletLayer, out: str = "features") -> DataFrame:
    """Wavelet sums per row (before normalization) as ``out`` array<double>."""
    held = df.sparkSession.sparkContext.broadcast(layer)
    n_in = layer.shape[1]

    def run(batches):
        for b in batches:
            Y = held.value.pre_activation_np(matrix(b.column(1), n_in))
            flat = pa.array(Y.ravel(), pa.float64())
            ends = pa.array(np.arange(0, Y.size + 1, max(1, Y.shape[1]), dtype=np.int32)[:len(Y) + 1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, flat)], [id_col, out])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType),
                           T.StructField(out, T.ArrayType(T.DoubleType()))])
    return df.select(id_col, features).mapInArrow(run, schema)


def batch_norm(df: DataFrame, col: str, mean: list[float] | None = None, var: list[float] | None = None,
               eps: float = BN_EPS) -> DataFrame:
    """Normalize each component of ``col``: with the table's mean / population
    variance when none are supplied, else with the supplied (running) ones."""
    if mean is None or var is None:
        found = vector_moments(df, col)
        if not found:
            return df
        mean, var = found[None].mean, found[None].std ** 2
    m = F.lit([float(x) for x in mean]).cast("array<double>")
    d = F.lit([float(np.sqrt(v + eps)) for v in var]).cast("array<double>")
    return df.withColumn(col, F.transform(col, lambda v, j: (v - F.element_at(m, j + 1)) / F.element_at(d, j + 1)))


def score_layers(df: DataFrame, id_col: str, features: str, layers: list[WaveletLayer]) -> DataFrame:
    """M6: layers applied in order, each followed by batch normalization.  The
    sums of each layer are written, so that a layer runs once although its
    statistics and its output both need them."""
    cur = df.select(id_col, features)
    for layer in layers:
        sums = materialize(apply_layer(cur, id_col, features, layer, features), "wavelet-sums")
        cur = batch_norm(sums, features)
    return cur
