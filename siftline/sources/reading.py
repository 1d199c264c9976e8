"""Reading tables; apart from the other sources, as Python workers load it with the operators that use it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(rows: DataFrame) -> DataFrame:
    """A scan's rows over all cores, where its files have fewer pieces than there are cores: work on each row then takes all of them. Larger tables stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))
