"""Streams: an extension beside the batch operators.

Late rows are dropped behind a watermark, so state stays bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType, per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def windowed_counts(events: DataFrame, time: str, kind: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    window = F.window(time, width)
    counted = events.withWatermark(time, late).groupBy(window, kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return counted.select(F.col("window.start").alias("window_start"), kind, "n", "total")


def first_deliveries(events: DataFrame, time: str, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Each key's first delivery; repeats within the watermark are dropped."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
