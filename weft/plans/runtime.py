"""Lineage cuts and worker set-up that hold on a cluster as in local mode."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Seconds that Spark's cleaner gets after each collection of ``reclaim``.
RECLAIM_S = 0.2
#: (setting, its default, what is set instead) for batches that go to Python.
BATCHES = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"))

#: Rows that ``dealt`` gives a task.
TASK_ROWS = 1_000_000
#: Rows up to which a stored table is sent to every executor, so that what it is joined with isn't shuffled.
BROADCAST_ROWS = 100_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a temporary one only where none is named, in local mode.

    On a cluster executors don't share a temporary folder, so that a session without a named one is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="weft-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored reliably, so that a lost executor doesn't replay what made it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of so many rows by its keys, in as many tasks as these need.

    What follows groups by the keys without another shuffle, and without a table of groups in the tasks
    that read, which keys that hardly repeat fill and don't shrink by.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)


def light(df: DataFrame, n: int) -> DataFrame:
    """A stored table of ``n`` rows, to be broadcast if it is small; a larger one is joined by shuffle."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


@contextmanager
def as_planned(spark: SparkSession) -> Iterator[None]:
    """What is cut inside keeps the partitions of its plan, which joins on their keys know, as adaptive execution doesn't change them."""
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it is."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` as a table in the shared checkpoint folder, which is there for as long as the ``with`` lasts.

    Unlike a checkpoint it is compressed and gives single columns; what comes of it has to be computed inside.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    # Dictionaries don't help hashes, which such tables mostly hold.
    df.write.option("parquet.enable.dictionary", "false").parquet(path)
    try:
        yield spark.read.parquet(path)
    finally:
        remove(spark, path)


def reclaim(spark: SparkSession) -> None:
    """Have files of finished shuffles removed now, which Spark does once the driver happens to collect its garbage.

    Several times: after a first collection the last shuffles were still there, and after a second, on a warm driver, gone.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(RECLAIM_S)


def shrink(spark: SparkSession) -> None:
    """Have executors collect garbage and give back the heap they don't need, beside which Python workers have to fit.

    A heap stays as large as it has ever been until the whole of it is collected, which an executor with
    room left has no reason for. One short task for each core, which all executors get.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't have its folder on their path.

    Also, batches of rows for Python are held to BATCHES, unless the session has limits of its own: a
    batch of texts is in memory several times, as Arrow, as strings and as results.
    """
    for setting, default, smaller in BATCHES:
        if spark.conf.get(setting, None) == default:
            spark.conf.set(setting, smaller)
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT in paths or os.path.realpath(os.getcwd()) == os.path.realpath(ROOT):
        return
    sc = spark.sparkContext
    if getattr(sc, "_weft_shipped", False):
        return
    package = os.path.join(ROOT, "weft")
    archive = os.path.join(tempfile.mkdtemp(prefix="weft-"), "weft.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, ROOT))
    sc.addPyFile(archive)
    sc._weft_shipped = True
