"""Cutting the lineage of iterative plans through a table in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a folder below the warehouse serves a driver that is its own only
    executor (tests); on a cluster that would be no shared place, so it is an error there.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


def new_folder(spark: SparkSession, kind: str) -> str:
    """A name below the shared folder that is deleted when the session ends, if not before."""
    name = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return name


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete files or folders of the shared folder."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def reliable(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder and read again.

    The result outlives any executor, keeps nothing of the plan before it, knows its size
    (so that joins can tell what is small) and reads only the columns that are asked for.
    The table goes with ``release`` or with the session.
    """
    spark = df.sparkSession
    name = new_folder(spark, "table")
    df.write.option("compression", "none").parquet(name)  # short-lived, mostly hashes: no codec buffers outside the heap
    out = spark.read.schema(df.schema).parquet(name)
    out._kept_at = name
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete tables of ``reliable`` that nothing reads any more."""
    for df in tables:
        if df is not None:
            remove(df.sparkSession, df._kept_at)
