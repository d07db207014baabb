"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off.

    On a cluster the master, checkpoint folder and memory come from the
    submit configuration; the defaults here only apply to local runs.
    """
    builder = SparkSession.builder.appName("ligandspark")
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so that functions
    of it run wherever the driver was started from."""
    sc = spark.sparkContext
    if getattr(sc, "_ligandspark_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="ligandspark-")), "ligandspark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("ligandspark", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._ligandspark_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; it is used as is. Only when it is
    unset (local tests) a folder under /tmp is taken.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = os.path.join("/tmp", "ligandspark-ckpt-" + uuid.uuid4().hex[:8])
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


_scratch: dict[int, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a written table, in a folder of this Spark context
    within the shared checkpoint folder; it is removed when the driver's Python ends."""
    sc = spark.sparkContext
    if id(sc) not in _scratch:
        base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex[:12]}"
        _scratch[id(sc)] = base

        def remove() -> None:
            if sc._jsc is not None:
                path = sc._jvm.org.apache.hadoop.fs.Path(base)
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

        atexit.register(remove)
    return f"{_scratch[id(sc)]}/{name}-{uuid.uuid4().hex[:10]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: it is computed once,
    and a lost executor costs a read.  Nothing stays in executor memory."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
