"""Cutting lineage and scratch space, both in the folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session. Where none is set, a single-process session gets a temporary one and a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not named:
        current = sc._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="tabloom-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and ends the plan of an iterative job."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; release() deletes what was written there."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete all scratch tables of this driver, once no result that reads them is needed; returns their number."""
    conf, gone = spark._jsc.hadoopConfiguration(), 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += path.getFileSystem(conf).delete(path, True)
    return gone
