"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table `name` under `root` (a file or a folder of files)."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """df with enough partitions for CPU-heavy stages.

    Scans of large inputs already have many splits and are left alone; only inputs of a few splits (one small file)
    are dealt out anew, which moves at most a few splits of data.
    """
    spark = df.sparkSession
    want = spark.sparkContext.defaultParallelism * per_core
    have = df.rdd.getNumPartitions()
    return df.repartition(want) if have < want // per_core else df
