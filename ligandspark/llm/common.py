"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ligandspark.session import ensure_checkpoint_dir

# A key holding more than total / HOT_SHARE rows counts as hot; so there are
# fewer than HOT_SHARE hot keys whatever the input.
HOT_SHARE = 1000

_scratch: dict[int, str] = {}
_passing: list[list[str]] = []        # paths of the tables that go, one list for each open `passing`


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _scratch_base(spark: SparkSession) -> str:
    """One folder per Spark context in the shared checkpoint folder; it is
    removed when the driver's Python ends."""
    sc = spark.sparkContext
    key = id(sc)
    if key not in _scratch:
        base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex[:12]}"
        _scratch[key] = base

        atexit.register(_remove, sc, base)
    return _scratch[key]


def _remove(sc, folder: str) -> None:
    if sc._jsc is None:
        return
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables written within are deleted at the end, but for those to ``keep``:
    what outlives the block must not read them."""
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            _remove(spark.sparkContext, path)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage
    ends there, so a lost executor costs one read, not a recomputation."""
    spark = df.sparkSession
    path = f"{_scratch_base(spark)}/{name}-{uuid.uuid4().hex[:10]}"
    if _passing and not keep:
        _passing[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a narrow table into ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def lookup(rows: DataFrame, key: str, small: DataFrame, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``small`` (one row per ``key``, any number of rows)
    although a few keys may hold most of ``rows``.

    Keys with more than 1 / HOT_SHARE of the rows are found by one count; there
    are fewer than HOT_SHARE of them, so that part of ``small`` is broadcast.
    All other rows take the usual shuffle join.  ``rows`` is read twice, so it
    should be a written or checkpointed table."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_llm_n"))
    counts = cut(counts)
    total = counts.agg(F.sum("_llm_n")).first()[0] or 0
    limit = max(1, total // HOT_SHARE)
    hot = [r[0] for r in counts.where(F.col("_llm_n") > limit).select(key).limit(HOT_SHARE + 1).collect()]
    if not hot:
        return rows.join(small, key, how)
    schema = small.select(key).schema
    marks = rows.sparkSession.createDataFrame([(h,) for h in hot if h is not None], schema)
    is_hot = rows.join(F.broadcast(marks), key, "left_semi")
    rest = rows.join(F.broadcast(marks), key, "left_anti")
    hot_small = small.join(F.broadcast(marks), key, "left_semi")
    return is_hot.join(F.broadcast(hot_small), key, how).unionByName(rest.join(small, key, how))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, all other characters untouched."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def trimmed(run: Callable) -> Callable:
    """A function for ``mapInArrow`` that hands freed memory back to the system
    when its task ends: Python workers live on, and the next stage's workers
    and heap need the room."""

    def call(batches):
        try:
            yield from run(batches)
        finally:
            import pyarrow

            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)     # glibc only
            if trim is not None:
                trim(0)

    return call


def byte_batches(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Cut positions so that each slice holds at most ``limit`` bytes (or one item)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
