"""Uniform shuffle into shards of exact size with a hypergeometric communication matrix.

A uniform random permutation of all rows, cut into shards, sends from partition
``p`` to each block of slots a number of rows that follows the multivariate
hypergeometric law.  So the numbers are drawn first; every partition then
permutes its rows locally and deals them out by its numbers, the rows are
exchanged once, and every block permutes what it has got.

The matrix is never built whole.  Partitions are the leaves of a binary tree, and
blocks those of a tree with ``FAN`` children a node.  One draw, seeded with the
places of both nodes, splits the rows of a partition node and a block node's
children between the halves of the partition node.  A task follows the path to
its own partition, and of the block tree only what its rows go to: with r rows in
a partition, P partitions and B blocks that are at most ``r * log(B) * log(P)``
small draws, so all tasks together do work in proportion to the rows, but for
the logarithms.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ligandspark.llm.common import written

SHARDS = 8
SEED = 42
BLOCK_ROWS = 5_000      # slots permuted by one task
MIN_BLOCKS = 6          # blocks of a shard
FAN = 8                 # children of a node of the block tree
EXACT_LIMIT = 10 ** 9   # numpy draws below it


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Good items among ``sample`` drawn from ``good + bad`` without replacement."""
    if good + bad < EXACT_LIMIT:
        return int(rng.hypergeometric(good, bad, sample)) if sample else 0
    low, high = max(0, sample - bad), min(good, sample)
    if low == high:
        return low
    # rejection from a Cauchy-like envelope around the mode, with exact weights
    n = good + bad
    mean = sample * (good / n)
    sd = math.sqrt(max(1.0, mean * (bad / n) * ((n - sample) / max(1, n - 1))))
    mode = min(high, max(low, (sample + 1) * (good + 1) // (n + 2)))

    def weight(k: int) -> float:
        return -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(sample - k + 1)
                 + math.lgamma(bad - sample + k + 1))

    top = weight(mode)
    while True:
        x = sd * math.tan(math.pi * (rng.random() - 0.5))
        k = mode + round(x)
        if low <= k <= high:
            # weight(k) / weight(mode) <= 2 / (1 + (x / sd)^2) for this law
            if rng.random() * 4.0 / (1.0 + ((k - mode) / sd) ** 2) <= math.exp(weight(k) - top):
                return int(k)


def split(rng: np.random.Generator, counts: np.ndarray, take: int) -> np.ndarray:
    """How many of each block's rows lie in the first ``take`` of ``sum(counts)``."""
    if int(counts.sum()) < EXACT_LIMIT:
        return rng.multivariate_hypergeometric(counts, take, method="marginals")
    out, left = np.zeros_like(counts), int(counts.sum())
    for i, c in enumerate(counts.tolist()):
        left -= c
        out[i] = hypergeometric(rng, c, left, take)
        take -= int(out[i])
    return out


def first_slot(block: np.ndarray, rows: int, shards: int, blocks: int) -> np.ndarray:
    """Rows before a block, of ``blocks`` in each shard; all shards, and all blocks
    of a shard, are of near equal size."""
    s, j = np.asarray(block, np.int64) // blocks, np.asarray(block, np.int64) % blocks
    size = rows // shards + (s < rows % shards)
    return s * (rows // shards) + np.minimum(s, rows % shards) + j * (size // blocks) + np.minimum(j, size % blocks)


def matrix_row(partition: int, starts: np.ndarray, rows: int, shards: int, blocks: int,
               seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks that ``partition`` sends rows to, and how many; ``starts`` are the
    partitions' first row numbers and the total."""
    path, (lo, hi) = [], (0, len(starts) - 1)       # nodes from the root to the partition
    totals = [int(starts[hi] - starts[lo])]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        path.append((lo, hi, partition < mid))
        lo, hi = (lo, mid) if partition < mid else (mid, hi)
        totals.append(int(starts[hi] - starts[lo]))
    found: list[tuple[int, int]] = []

    def visit(a: int, b: int, totals: list[int]) -> None:
        """``totals``: rows that each node of the path sends to the blocks a .. b - 1."""
        if b - a == 1:
            found.append((a, totals[-1]))
            return
        cuts = a + np.arange(min(FAN, b - a) + 1) * (b - a) // min(FAN, b - a)
        counts = [np.diff(first_slot(cuts, rows, shards, blocks))]
        for d, (lo, hi, left) in enumerate(path):
            take = totals[d + 1] if left else totals[d] - totals[d + 1]
            taken = split(np.random.default_rng([seed, lo, hi, a, b]), counts[d], take)
            counts.append(taken if left else counts[d] - taken)
        for j in np.flatnonzero(counts[-1]).tolist():
            visit(int(cuts[j]), int(cuts[j + 1]), [int(c[j]) for c in counts])

    if totals[-1]:
        visit(0, shards * blocks, totals)
    to, n = zip(*found, strict=True) if found else ((), ())
    return np.array(to, np.int64), np.array(n, np.int64)


def shuffle_to_shards(df: DataFrame, shards: int = SHARDS, seed: int = SEED, stable: bool = False) -> DataFrame:
    """All rows and columns of ``df`` with ``shard`` (0 .. shards - 1) and
    ``slot`` (gapless from 0 within the shard); shard sizes differ by one at
    most.  The numbers of rows that go from each partition to each block follow
    the law of a uniform permutation, the rows are dealt by seeded permutations,
    and the order within a block is that of a seeded 64-bit hash.

    The partitions are read twice and must be the same each time.  That holds
    for a table that is read from files and at most projected
    (``stable=True``); anything else is written to the shared folder first.
    Columns named ``shard`` or ``slot`` are replaced.  Nulls, empty texts and
    repeated rows are rows like any other; no rows give no rows."""
    df = df.drop("shard", "slot")
    if not stable:
        df = written(df, "shuffle")
    spark = df.sparkSession
    own = F.spark_partition_id()
    found = {r[0]: r[1] for r in df.select(own.alias("p")).groupBy("p").agg(F.count(F.lit(1))).collect()}
    parts = max(found, default=0) + 1                       # one number per partition
    starts = np.concatenate(([0], np.cumsum([found.get(p, 0) for p in range(parts)]))).astype(np.int64)
    rows = int(starts[-1])
    blocks = max(MIN_BLOCKS, -(-rows // (shards * BLOCK_ROWS)))
    held = spark.sparkContext.broadcast(starts)             # a number per partition
    ready: dict[int, np.ndarray] = {}

    @F.pandas_udf("long")
    def deal(part, number):
        import pandas as pd

        if not len(part):
            return pd.Series([], dtype="int64")
        p = int(part.iloc[0])
        if p not in ready:
            to = np.repeat(*matrix_row(p, held.value, rows, shards, blocks, seed))
            np.random.default_rng([seed, p]).shuffle(to)    # the local permutation
            ready.clear()
            ready[p] = to
        return pd.Series(ready[p][number.to_numpy()])

    at = F.monotonically_increasing_id()                    # partition and number within it
    numbered = df.withColumn("_llm_at", at).withColumn("_llm_part", own)
    dealt = numbered.withColumn(
        "_llm_block", deal("_llm_part", F.col("_llm_at").bitwiseAND(F.lit((1 << 33) - 1))))
    order = Window.partitionBy("_llm_block").orderBy(F.xxhash64(F.lit(seed), F.col("_llm_at")), "_llm_at")
    shard = F.expr(f"_llm_block div {blocks}").cast("int")
    j = F.col("_llm_block") % blocks
    size = F.lit(rows // shards) + F.when(F.col("shard") < rows % shards, 1).otherwise(0)
    start = j * F.expr(f"_llm_size div {blocks}") + F.least(j, F.col("_llm_size") % blocks)
    return (dealt.withColumn("_llm_n", F.row_number().over(order) - 1)
            .withColumn("shard", shard).withColumn("_llm_size", size)
            .withColumn("slot", (start + F.col("_llm_n")).cast("long"))
            .drop("_llm_at", "_llm_part", "_llm_block", "_llm_n", "_llm_size"))
