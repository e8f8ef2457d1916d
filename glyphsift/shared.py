"""The folder for intermediate data that all of a cluster's machines see, and frames cut off from their lineage."""

from __future__ import annotations

import contextlib
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting by which frames that are made while it is on leave no shuffle files when their action has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Where it is unset, a temporary folder is made if driver and tasks are one
    process, as in tests; anywhere else that is an error, since no other machine would see it."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="glyphsift-"))
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder with all in it, wherever it lies."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def for_one_action(spark: SparkSession) -> Iterator[None]:
    """Frames that are made within are for one action each: at its end the shuffle files go, which else stay until the driver
    happens to collect its garbage. Frames that were made before keep theirs, also those that such a frame is made of."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before else spark.conf.unset(CLEANUP)


def checkpointed(df: DataFrame) -> DataFrame:
    folder(df.sparkSession)
    with for_one_action(df.sparkSession):
        return df.select("*").checkpoint()


def discard(*frames: DataFrame) -> None:
    """Deletes the files of frames that checkpointed() returned and that nothing will read any more."""
    for df in frames:
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            remove(df.sparkSession, file.get())


def fresh(df: DataFrame) -> DataFrame:
    """df with columns of its own, for a join or cogroup with what it shares an origin with."""
    return df.select(*(F.col(f"`{c}`").alias(c) for c in df.columns))
