"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


MOST_TASKS = 50_000  # beyond, tasks grow instead: a driver that tracks more is slower than tasks of some GB that spill


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, one in the warehouse of a local session (tests), and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names the folder that driver and executors share; it is unset")
    return base or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/intermediate"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    It cuts the lineage, fixes values that depend on a partition's number, and gives
    both sides of a later join a plain exchange that adaptive execution may split.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again, and let Spark drop the shuffle files of ended jobs."""
    for t in tables:
        jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
    if tables:
        gc.collect()  # Spark's cleaner drops shuffles once the driver has collected the plans that hold them
        tables[0].sparkSession._jvm.System.gc()


def n_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(table: DataFrame) -> int:
    """Tasks for a shuffle of a table that is read from files: one for each 16 MB of it, MOST_TASKS at most, and the session's number at least."""
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size < 1 << 62  # tables not of files have no size, which shows as the largest number
    return max(n_tasks(table.sparkSession), min(size >> 24, MOST_TASKS) if known else 0)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges (a, b), both long: rows (node, component).

    The component is the smallest node of it. Every round hooks each node onto its
    smallest neighbour, jumps once, and contracts the graph; only edges between
    different components stay, so that the rounds are few and each is smaller than
    the one before. Nothing but the number of edges left reaches the driver.
    """
    e = written(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    out = None
    while not e.isEmpty():
        old = [e, *[out] * (out is not None)]
        up = (
            e.select(F.col("b").alias("node"), F.col("a").alias("to"))
            .unionAll(e.select(F.col("a").alias("node"), F.col("a").alias("to")))
            .groupBy("node").agg(F.min("to").alias("to"))
        )
        up = written(up, "hooks")
        jump = up.select(F.col("node").alias("to"), F.col("to").alias("top"))
        parent = written(up.join(jump, "to").select("node", F.col("top").alias("to")), "parents")
        if out is None:
            out = parent.select("node", F.col("to").alias("component"))
        else:
            near = parent.select(F.col("node").alias("component"), "to")
            out = out.join(near, "component", "left").select(
                "node", F.coalesce("to", "component").alias("component"))
        out = written(out, "labels")
        pa = parent.select(F.col("node").alias("a"), F.col("to").alias("a2"))
        pb = parent.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        e = written(
            e.join(pa, "a").join(pb, "b").where("a2 <> b2")
            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
        tidy(*old, up, parent)
    if out is None:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    return out
