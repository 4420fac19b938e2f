"""Parquet tables, spread over the cores when there are fewer splits than cores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """Redistribute a scan that would leave cores idle; leave any larger one alone.

    Text and HTML work is bound by CPU, so a table in one or two files gains from a
    small shuffle.  A table with at least as many splits as cores is returned as it is,
    which is every table of a size that matters.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spread(spark.read.parquet(path))
