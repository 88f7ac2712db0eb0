"""Folders for intermediate tables, under ``spark.checkpoint.dir`` (shared by all executors), by application."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local session takes its warehouse folder. On a cluster that
    folder's default lies on each machine by itself, so there the setting is required."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path, below the application's own."""
    return f"{root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The table written as Parquet and read back, which cuts its lineage. ``clear`` deletes all that was saved."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> bool:
    """Deletes the application's intermediate tables, once their results have been written elsewhere; gives whether there were any."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root(spark)}/{spark.sparkContext.applicationId}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)
