"""The folder that the driver and the executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where that is unset, a session whose tasks run in the driver's own process
    gets a temporary folder; on a cluster executors could not see one, so there
    it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not (sc.master or "").startswith("local") or (sc.master or "").startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="tesserapy-checkpoint-")
    sc.setCheckpointDir(made)
    return made


def checkpoint(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and cut their lineage."""
    sc = df.sparkSession.sparkContext
    where = shared_dir(df.sparkSession)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return df.checkpoint()


def discard(spark: SparkSession, path: str) -> None:
    """Delete what was written under a path, in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
