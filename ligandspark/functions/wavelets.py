"""Mother wavelets as Column expressions.

``shannon`` is not a plain scalar function: its Hamming window runs over the
input-feature index, so it needs the position ``n`` and the width ``N``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ligandspark.functions.vectors import hamming

WAVELETS = ("mexican_hat", "morlet", "dog", "meyer", "shannon")

# Fixed values of the wavelet definitions.
MEXICAN_HAT_C = 2.0 / (math.sqrt(3.0) * math.pi ** 0.25)
MORLET_OMEGA0 = 5.0


def _g(x: Column) -> Column:
    return F.exp(F.lit(-0.5) * x * x)


def mexican_hat(x: Column) -> Column:
    """``c (x^2 - 1) exp(-x^2/2)``, c = 2 / (sqrt(3) pi^(1/4))."""
    return F.lit(MEXICAN_HAT_C) * (x * x - 1) * _g(x)


def morlet(x: Column) -> Column:
    """``cos(5x) exp(-x^2/2)``."""
    return F.cos(F.lit(MORLET_OMEGA0) * x) * _g(x)


def dog(x: Column) -> Column:
    """derivative of Gaussian ``-x exp(-x^2/2)``."""
    return -x * _g(x)


def _nu(t: Column) -> Column:
    return t * t * t * t * (F.lit(35.0) - 84 * t + 70 * t * t - 20 * t * t * t)


def meyer(x: Column) -> Column:
    """``sin(pi v) aux(v)``, v = |x|; aux = 1 for v <= 1/2, 0 for v >= 1,
    else ``cos(pi/2 nu(2v - 1))``."""
    v = F.abs(x)
    aux = (F.when(v <= 0.5, F.lit(1.0)).when(v >= 1.0, F.lit(0.0))
           .otherwise(F.cos(F.lit(math.pi / 2) * _nu(2 * v - 1))))
    return F.sin(F.lit(math.pi) * v) * aux


def shannon(x: Column, n: Column, N: Column) -> Column:
    """F16: ``sin(x)/x`` (1 at 0) times the symmetric Hamming window value of
    feature index ``n`` among ``N``."""
    sinc = F.when(x == 0, F.lit(1.0)).otherwise(F.sin(x) / x)
    return sinc * hamming(n, N)


def wavelet(name: str, x: Column, n: Column | None = None, N: Column | None = None) -> Column:
    """Dispatch by name; unknown names fail before any job starts."""
    if name == "mexican_hat":
        return mexican_hat(x)
    if name == "morlet":
        return morlet(x)
    if name == "dog":
        return dog(x)
    if name == "meyer":
        return meyer(x)
    if name == "shannon":
        if n is None or N is None:
            raise ValueError("shannon needs the feature index and width")
        return shannon(x, n, N)
    raise ValueError(f"no wavelet is named {name!r}; there are {', '.join(WAVELETS)}")


def wavelet_np(name: str, z, n=None, N=None):
    """The same wavelets on numpy arrays (used inside Arrow batches)."""
    import numpy as np
    if name == "mexican_hat":
        return MEXICAN_HAT_C * (z * z - 1) * np.exp(-0.5 * z * z)
    if name == "morlet":
        return np.cos(MORLET_OMEGA0 * z) * np.exp(-0.5 * z * z)
    if name == "dog":
        return -z * np.exp(-0.5 * z * z)
    if name == "meyer":
        v = np.abs(z)
        t = 2 * v - 1
        nu = t ** 4 * (35 - 84 * t + 70 * t ** 2 - 20 * t ** 3)
        aux = np.where(v <= 0.5, 1.0, np.where(v >= 1.0, 0.0, np.cos(np.pi / 2 * nu)))
        return np.sin(np.pi * v) * aux
    if name == "shannon":
        with np.errstate(invalid="ignore", divide="ignore"):
            sinc = np.where(z == 0, 1.0, np.sin(z) / np.where(z == 0, 1.0, z))
        w = np.ones(N) if N == 1 else 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(N) / (N - 1))
        return sinc * w
    raise ValueError(f"no wavelet is named {name!r}; there are {', '.join(WAVELETS)}")


def wavelet_slope_np(name: str, z, n=None, N=None):
    """Derivative of :func:`wavelet_np` by ``z`` (for ``meyer`` at 0, where it has
    a corner, the one-sided derivative's mean 0)."""
    import numpy as np
    g = np.exp(-0.5 * z * z)
    if name == "mexican_hat":
        return MEXICAN_HAT_C * z * (3.0 - z * z) * g
    if name == "morlet":
        return -(MORLET_OMEGA0 * np.sin(MORLET_OMEGA0 * z) + z * np.cos(MORLET_OMEGA0 * z)) * g
    if name == "dog":
        return (z * z - 1.0) * g
    if name == "meyer":
        v = np.abs(z)
        t = 2 * v - 1
        nu = t ** 4 * (35 - 84 * t + 70 * t ** 2 - 20 * t ** 3)
        slope = 140 * t ** 3 * (1 - t) ** 3
        inside = (v > 0.5) & (v < 1.0)
        aux = np.where(v <= 0.5, 1.0, np.where(v >= 1.0, 0.0, np.cos(np.pi / 2 * nu)))
        down = np.where(inside, -np.sin(np.pi / 2 * nu) * np.pi / 2 * slope * 2, 0.0)
        return np.sign(z) * (np.pi * np.cos(np.pi * v) * aux + np.sin(np.pi * v) * down)
    if name == "shannon":
        with np.errstate(invalid="ignore", divide="ignore"):
            s = np.where(z == 0, 0.0, (z * np.cos(z) - np.sin(z)) / np.where(z == 0, 1.0, z * z))
        w = np.ones(N) if N == 1 else 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(N) / (N - 1))
        return s * w
    raise ValueError(f"no wavelet is named {name!r}; there are {', '.join(WAVELETS)}")
