"""Cutting a plan's lineage through the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark's own switch: a query's shuffle files go as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; unset: a local folder, if all run on this machine."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or "file://" + tempfile.mkdtemp(prefix="kinweave-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder as compressed columns, a fraction of what a checkpoint's rows take.

    The files go when the driver ends. What df's plan has shuffled goes at once: nothing reads it again, and it is many times as much.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinweave-kept-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    jvm = spark.sparkContext._jvm
    atexit.register(_drop, jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(jvm, conf, path: str) -> None:
    try:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
    except Exception:  # the session has ended, and its folder is the caller's
        pass
