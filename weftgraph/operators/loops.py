"""Cutting lineage in loops, and what Python workers need."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def on_workers(spark: SparkSession) -> None:
    """Python workers find this package; on a cluster it comes by --py-files or an image."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode one of our own where it is unset."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="weftgraph-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once, in the folder that driver and executors share; so lost executors cost no earlier round."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df, written as a table in that folder and read again. For what a loop computes from itself round by round: a
    checkpoint keeps what the optimizer knows of its columns, and that would grow with the rounds."""
    spark, at = df.sparkSession, f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


@contextmanager
def for_now(df: DataFrame) -> Iterator[DataFrame]:
    """df as a table in that folder, which goes when the block ends. What is computed from it must be by then: cut or stored."""
    spark, at = df.sparkSession, f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(at)
    try:
        yield spark.read.schema(df.schema).parquet(at)
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files: each query's go when it ends, not when the driver's memory is next
    collected. For steps that write many tables one after another, whose files would lie on disk all at once."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def empty(df: DataFrame) -> bool:
    return not df.limit(1).count()
