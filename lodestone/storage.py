"""The folder that driver and executors share, and lineage cuts into it."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where a local session names none (tests) a temporary folder is made and
    set as the checkpoint folder; it is removed when Python exits. On a cluster
    that would be a folder of the driver alone, so there the name must be given.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


#: Spark's setting by which a query's shuffle files go when it ends, not when the driver's garbage is collected.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Plans made in here lose their shuffle files when the query that runs them ends; each must be run once."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


_heap_left = 0  # bytes that the driver's JVM held after the last collection in here


def rest(spark: SparkSession) -> None:
    """Have the driver's JVM collect its garbage if its heap has grown beyond half of what it may take.

    Plans, task and stage records of finished queries are garbage, a tenth of the
    heap stays in use; but the JVM takes its whole heap before it looks, and keeps
    it. A full collection gives back what isn't needed.
    """
    global _heap_left
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > max(heap.maxMemory() // 2, _heap_left):
        gc.collect()  # objects of the JVM that Python holds no more
        spark._jvm.java.lang.System.gc()
        _heap_left = heap.totalMemory()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, its lineage cut by a checkpoint in the shared folder.

    The shuffle files that it took go as soon as the checkpoint is written: later
    reads, those after a lost executor included, need the checkpoint only.
    """
    shared_dir(df.sparkSession)
    with tidied(df.sparkSession):
        done = df.select("*").checkpoint(eager=True)  # a plan made in here
    rest(df.sparkSession)
    return done


def release(*frames: DataFrame) -> None:
    """Remove the files of frames that ``cut`` returned and that nothing reads any more, frames made of them included."""
    for df in frames:
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            drop(df.sparkSession, file.get())


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/lodestone/{name}-{uuid.uuid4().hex[:12]}"


def drop(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of a cut table that a join may broadcast.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` cut, and marked for broadcasting if a count finds it small; else it is joined by a shuffle."""
    done = cut(df)
    return F.broadcast(done) if done.count() <= most else done
