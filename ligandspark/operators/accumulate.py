"""Prediction accumulation over batches (A28), as plain batch jobs.

The state of a meter is a table of counts per ``(run, task, score)``, the
sufficient statistics of every exact ranking metric; two states merge by adding
the counts of equal keys, in any order and any split of the rows into batches.
Under one folder it is kept as

* ``batches/batch_id=<id>``: the counts of one batch.  A batch that is added
  again replaces its own folder, so a retry changes nothing.
* ``base/<generation>/counts`` and ``base/<generation>/merged``: the counts of
  all batches up to a compaction and the ids of these batches, which are skipped
  if they are added once more.  A generation counts when its ``merged`` table is
  complete; it is written after the counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ligandspark.operators.metrics import curve_from_counts, masked, metrics_from_curve, sigmoid

KEYS = ["run", "task"]
COUNTS = "run string, task string, _score double, pos long, neg long"


def batch_counts(batch: DataFrame) -> DataFrame:
    """Masked rows ``(run, task, logit, y, mask)`` -> counts of positives and
    negatives per distinct probability; rows without a 0/1 label do not count."""
    m = masked(batch).where(F.col("y").isin(0.0, 1.0))
    return m.groupBy(*KEYS, sigmoid(F.col("logit")).alias("_score")).agg(
        F.count_if(F.col("y") == 1.0).cast("long").alias("pos"),
        F.count_if(F.col("y") == 0.0).cast("long").alias("neg"))


def merged_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy(*KEYS, "_score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


class MeterState:
    """The accumulated counts under ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _there(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def _names(self, path: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._path(path))) if self._there(path) else []

    def add(self, batch_id: int, batch: DataFrame) -> None:
        """Count the rows of a batch in; the same id again changes nothing but
        its own counts, and nothing at all once it was compacted."""
        if int(batch_id) not in self._merged_ids():
            batch_counts(batch).write.mode("overwrite").parquet(f"{self.path}/batches/batch_id={int(batch_id)}")

    def _generation(self) -> str | None:
        done = [g for g in self._names(f"{self.path}/base") if self._there(f"{self.path}/base/{g}/merged/_SUCCESS")]
        return f"{self.path}/base/{done[-1]}" if done else None

    def _merged_ids(self) -> set[int]:
        base = self._generation()
        if base is None:
            return set()
        return {r[0] for r in self.spark.read.schema("batch_id long").parquet(f"{base}/merged").collect()}

    def _batch_ids(self) -> list[int]:
        return [int(n.split("=")[1]) for n in self._names(f"{self.path}/batches")
                if self._there(f"{self.path}/batches/{n}/_SUCCESS")]

    def counts(self) -> DataFrame:
        """All counts, one row per ``(run, task, _score)``."""
        base, merged = self._generation(), self._merged_ids()
        paths = [f"{self.path}/batches/batch_id={i}" for i in self._batch_ids() if i not in merged]
        paths += [f"{base}/counts"] if base else []
        if not paths:
            return self.spark.createDataFrame([], COUNTS)
        return merged_counts(self.spark.read.schema(COUNTS).parquet(*paths))

    def compact(self) -> None:
        """Merge all batches into a new generation; older files are removed."""
        ids, old = sorted({*self._batch_ids(), *self._merged_ids()}), self._names(f"{self.path}/base")
        number = max([int(g.split("-")[0]) for g in old], default=-1) + 1
        new = f"{self.path}/base/{number:09d}-{uuid.uuid4().hex[:8]}"
        self.counts().write.parquet(f"{new}/counts")
        self.spark.createDataFrame([(i,) for i in ids], "batch_id long").coalesce(1).write.parquet(f"{new}/merged")
        for g in old:
            self._fs.delete(self._path(f"{self.path}/base/{g}"), True)
        for i in self._batch_ids():
            if i in ids:
                self._fs.delete(self._path(f"{self.path}/batches/batch_id={i}"), True)

    def metrics(self) -> DataFrame:
        """roc_auc, average_precision and pr_auc_trapezoid per (run, task) over everything added."""
        return metrics_from_curve(curve_from_counts(self.counts(), KEYS), KEYS)
