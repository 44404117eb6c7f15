"""Cutting lineage through the folder that every executor shares.

Iterative plans grow with each round, so each round is written to the checkpoint
folder.  The folder is the one named in ``spark.checkpoint.dir``; only a local session
that names none (a test) gets a temporary one.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of this session, as a path or URI."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not current.isDefined():
            sc.setCheckpointDir(named)
        return named
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    local = tempfile.mkdtemp(prefix="graphloom-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    sc.setCheckpointDir(local)
    return local


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and reread from the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Whether an execution deletes the files of its shuffles as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """DataFrames made and run inside leave no shuffle files; their results must be kept elsewhere.

    Spark's cleaner alone deletes them when the driver collects its garbage and no event that
    waits for a listener refers to the execution, which may be never.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def store(df: DataFrame) -> DataFrame:
    """``df`` of plain columns computed once and reread from compressed columns in the shared folder.

    A checkpoint takes 8 bytes a column and 12 a row; this is for large tables.  The order of
    rows is not kept.  The files go when the session's file system is closed.
    """
    spark = df.sparkSession
    uri = f"{shared_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    with passing(spark):
        df.write.parquet(uri)
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(uri)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table of ``store`` that nothing reads any more."""
    for uri in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        remove(df.sparkSession, uri)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner see which shuffles and checkpoints nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def remove(spark: SparkSession, uri: str) -> None:
    """Deletes a folder below the shared one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
