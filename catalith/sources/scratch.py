"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

MOST_TASKS = 50_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """This application's folder in ``spark.checkpoint.dir``; where that is unset, in the warehouse of a local session, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names the folder that driver and executors share; it is unset")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/intermediate"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def shared(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete all that the application wrote there; for the end of a session, since results may still read it before."""
    delete(spark, folder(spark))


def tasks_for(table: DataFrame, each: int = 4 << 20) -> int:
    """Tasks for a shuffle of a table that is read from files: one for each ``each`` bytes of it, MOST_TASKS at most, and the session's number at least."""
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size < 1 << 62  # tables not of files have no size, which shows as the largest number
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // each), MOST_TASKS) if known else 0)


def tasks_of(spark: SparkSession, rows: int, each: int = 500_000) -> int:
    """As ``tasks_for``, of a number of rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-rows // each), MOST_TASKS))


def written(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Write a table that is read several times once, and read it back. With ``free`` the write's shuffle files are deleted at its end, not when the driver drops their names."""
    path, conf = shared(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    if free:
        conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete an output, wherever it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
