"""Sums and moments of vectors over the cluster, without exploding them.

Each task reduces its rows to one small row per key with numpy; on a large
cluster these partial rows are merged in two levels (first in as many groups as
there are shuffle partitions), so neither one task nor the driver meets a row
per task.  What comes
back to the driver is one row per key, of a size given by the vector width.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLAT = 64       # shuffle partitions up to which partial rows are merged at once


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column as float64; null components and null lists are NaN."""
    n = len(column)
    sizes = pa.compute.list_value_length(column)
    d = width if width is not None else (pa.compute.max(sizes).as_py() or 0)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    if len(flat) == n * d and column.null_count == 0:
        return flat.reshape(n, d)
    out = np.full((n, d), np.nan)
    for i, v in enumerate(column):
        if v.is_valid and len(v) == d:
            out[i] = v.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    return out


def merged(parts: DataFrame, merge: Callable[[list[np.ndarray]], np.ndarray]) -> DataFrame:
    """One row per ``key`` of ``parts(key, part, values array<double>)``."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("part", kind="stable")
        return pd.DataFrame({"key": [g["key"].iloc[0]], "part": [int(g["part"].iloc[0])],
                             "values": [merge([np.asarray(v, np.float64) for v in g["values"]])]})

    groups = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if groups > FLAT:
        some = F.pmod(F.col("part"), F.lit(groups)).alias("some")
        parts = parts.groupBy("key", some).applyInPandas(lambda g: one(g), parts.schema)
    return parts.groupBy("key").applyInPandas(lambda g: one(g), parts.schema)


def added(parts: list[np.ndarray]) -> np.ndarray:
    return np.sum(parts, axis=0)


@dataclass
class Moments:
    """Per component the number of values, their mean and sum of squared deviations."""
    n: np.ndarray
    mean: np.ndarray
    m2: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        """NaN is no value."""
        there = ~np.isnan(x)
        n = there.sum(axis=0).astype(np.float64)
        mean = np.where(there, x, 0.0).sum(axis=0) / np.maximum(n, 1)
        dev = np.where(there, x - mean, 0.0)
        # the mean of rounded sums is off by a rounding: one correction makes it exact to the last digits
        mean = mean + dev.sum(axis=0) / np.maximum(n, 1)
        dev = np.where(there, x - mean, 0.0)
        return cls(n, mean, (dev * dev).sum(axis=0))

    @classmethod
    def flat(cls, v: np.ndarray) -> Moments:
        return cls(*v.reshape(3, -1))

    def values(self) -> np.ndarray:
        return np.concatenate([self.n, self.mean, self.m2])

    def __add__(self, other: Moments) -> Moments:
        """Of the union of disjoint parts: no difference of large sums."""
        n = self.n + other.n
        step = other.mean - self.mean
        share = np.where(n > 0, other.n / np.maximum(n, 1), 0.0)
        return Moments(n, self.mean + step * share, self.m2 + other.m2 + step * step * self.n * share)

    @property
    def std(self) -> np.ndarray:
        """Population standard deviation; 0 without values."""
        return np.sqrt(self.m2 / np.maximum(self.n, 1))


def union(parts: list[Moments]) -> Moments:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def vector_moments(df: DataFrame, features: str, by: str | None = None) -> dict[object, Moments]:
    """Moments of every component of ``features`` per value of ``by`` (an integer
    column with few values), or under the key None: one scan, one row of
    ``3 * width`` numbers per task and key to merge."""
    rows = df.select(F.col(by).cast("long").alias("key") if by else F.lit(0).cast("long").alias("key"),
                     F.col(features).alias("f"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int | None, Moments] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1))
            keys = b.column(0).to_pandas()
            for k, at in keys.groupby(keys, dropna=False).indices.items():
                k, m = None if pd.isna(k) else int(k), Moments.of(x[at])
                held[k] = held[k] + m if k in held else m
        yield pa.RecordBatch.from_pydict(
            {"key": list(held), "part": [TaskContext.get().partitionId()] * len(held),
             "values": [m.values() for m in held.values()]},
            pa.schema([("key", pa.int64()), ("part", pa.int64()), ("values", pa.list_(pa.float64()))]))

    parts = rows.mapInArrow(run, "key long, part long, values array<double>")
    merge = lambda vs: union([Moments.flat(v) for v in vs]).values()
    out = merged(parts, merge).toArrow().to_pydict()
    found = {k: Moments.flat(np.asarray(v)) for k, v in zip(out["key"], out["values"], strict=True)}
    return found if by else {None: found[0]} if found else {}


def vector_sum(df: DataFrame, columns: list[str], of: Callable[[list[pa.Array]], np.ndarray]) -> np.ndarray | None:
    """The sum over the batches of ``columns`` of the vectors that ``of`` makes of
    a batch; None without rows.  One scan."""
    rows = df.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                v = of(b.columns)
                total = v if total is None else total + v
        n = int(total is not None)
        yield pa.RecordBatch.from_pydict(
            {"key": [0] * n, "part": [TaskContext.get().partitionId()] * n, "values": [total] * n},
            pa.schema([("key", pa.int64()), ("part", pa.int64()), ("values", pa.list_(pa.float64()))]))

    parts = rows.mapInArrow(run, "key long, part long, values array<double>")
    got = merged(parts, added).collect()
    return np.asarray(got[0]["values"]) if got else None
