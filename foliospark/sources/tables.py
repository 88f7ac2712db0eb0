"""Copies between databases by JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_table(spark: SparkSession, url: str, table: str, by: str | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table, read by ``parts`` tasks that each take a range of the whole number ``by``; without it, by one."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if by is None:
        return reader.load()
    ends = reader.load().agg(F.min(by).alias("least"), F.max(by).alias("most")).first()
    if ends["least"] is None:
        return reader.load()
    bounds = {"partitionColumn": by, "lowerBound": ends["least"], "upperBound": ends["most"] + 1, "numPartitions": parts}
    return reader.options(**bounds).load()


def copy_absent(
    spark: SparkSession, source: str, target: str, table: str, key: list[str], by: str | None = None, parts: int = 8, **options: str
) -> None:
    """Appends the source's rows whose key the target's table lacks; of several with one key, one.

    Only the target's keys are read. A copy that failed midway may run again: what is there stays.
    """
    have = read_table(spark, target, table, by, parts, **options).select(*key)
    new = read_table(spark, source, table, by, parts, **options).dropDuplicates(key).join(have.hint("merge"), key, "left_anti")
    new.write.format("jdbc").options(url=target, dbtable=table, **options).mode("append").save()
