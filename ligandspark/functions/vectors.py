"""Vector column functions over ``array<double>``.

Features are arrays, not hundreds of columns; wide numbered columns exist only
at the CSV boundary (``to_wide`` / ``from_wide``), each built in a single
``select`` (never a ``withColumn`` loop).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numbered(prefix: str, n: int) -> list[str]:
    """``prefix1 .. prefixn`` in numeric order (1-based)."""
    return [f"{prefix}{i}" for i in range(1, n + 1)]


def from_wide(cols: Sequence[str]) -> Column:
    """Numbered columns -> one array<double>, in the given order."""
    return F.array(*[F.col(c).cast("double") for c in cols])


def to_wide(df: DataFrame, features: str, prefix: str, n: int, keep: Sequence[str] | None = None) -> DataFrame:
    """Array -> ``prefix1..prefixn`` columns appended to ``keep`` columns."""
    keep = [c for c in df.columns if c != features] if keep is None else list(keep)
    return df.select(*keep, *[F.element_at(features, i).alias(f"{prefix}{i}") for i in range(1, n + 1)])


def subset(features: Column, positions: Sequence[float], threshold: float = 0.5) -> Column:
    """Keep dimension i when ``positions[i] > threshold``; the index list is
    a literal, so the same subset applies to every split."""
    idx = selected_indexes(positions, threshold)
    return F.array(*[F.element_at(features, i + 1) for i in idx])


def selected_indexes(positions: Sequence[float], threshold: float = 0.5) -> list[int]:
    """0-based indexes with ``position > threshold`` (S6 content)."""
    return [i for i, p in enumerate(positions) if p > threshold]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, t: s + t)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """``a.b / (|a||b|)`` in double."""
    return dot(a, b) / (norm(a) * norm(b))


def adaptive_avg_pool(features: Column, n_bins: int) -> Column:
    """bin i = mean of ``x[floor(i*L/n) : ceil((i+1)*L/n)]`` (L = length)."""
    L = F.size(features)

    def one(i):
        lo = F.floor(i * L / n_bins).cast("int")
        hi = F.ceil((i + 1) * L / n_bins).cast("int")
        part = F.slice(features, lo + 1, hi - lo)
        return F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / (hi - lo)

    return F.transform(F.sequence(F.lit(0), F.lit(n_bins - 1)), one)


def clip(x: Column, lb: float, ub: float) -> Column:
    """into [lb, ub]."""
    return F.greatest(F.least(x, F.lit(float(ub))), F.lit(float(lb)))


def hamming(n: Column, N: Column) -> Column:
    """Symmetric Hamming window value at index n of N (1 when N = 1)."""
    return F.when(N == 1, F.lit(1.0)).otherwise(
        F.lit(0.54) - F.lit(0.46) * F.cos(F.lit(2 * math.pi) * n / (N - 1)))
