"""Access to the parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the folder, as Spark reads it; the folder may lie in any store Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, each: int = 8) -> int:
    """A number of partitions to shuffle rows as they are read into: some `each` for every task that reads, so what one task holds stays the same however large the tables."""
    return each * max(1, rows.rdd.getNumPartitions())
