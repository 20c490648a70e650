"""Reading the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def in_parallel(df: DataFrame, scan: DataFrame | None = None) -> DataFrame:
    """The same rows in at least as many partitions as there are cores, for Python work on few large files.

    Tables of many files are left as they are scanned, without a shuffle. Where
    ``df`` would have to be run to be counted, ``scan`` is counted in its place.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if (scan or df).rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame) -> DataFrame:
    """The same rows dealt evenly over the cores, for Python work that costs far more than its bytes tell.

    Adaptive coalescing goes by bytes and would leave short texts to one task.
    """
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def latest_delivery(df: DataFrame, key: str, arrived: str = "ingested_at") -> DataFrame:
    """One row for each key: its latest delivery, and of equal ones the first in content.

    Null keys are kept together as one key. A hot key costs one sort of its
    deliveries; rows are compared by a hash, never collected.
    """
    content = F.xxhash64(*[F.to_json(F.col(c)) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in df.dtypes])
    w = W.partitionBy(key).orderBy(F.col(arrived).desc_nulls_last(), content)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
