"""Files by name: pairing those of one folder, and small tables kept as YAML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def listed(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``path, folder, name, length`` of the files below a path whose names match; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.withColumn("folder", F.regexp_extract("path", "^(.*)/[^/]*$", 1)).withColumn("name", F.regexp_extract("path", "([^/]*)$", 1))


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each left file with the first right file, by name, of its folder."""
    first = right.withColumn("k", F.row_number().over(W.partitionBy("folder").orderBy("name"))).where("k = 1").select("folder", F.col("path").alias("right_path"))
    return left.select("folder", F.col("path").alias("left_path")).join(first, "folder", "left")


def yaml_table(spark: SparkSession, path: str, entry: str, schema: str) -> DataFrame | None:
    """A list kept in a small YAML file as a table; None where YAML cannot be read here, an empty table where the list is missing."""
    try:
        import yaml
    except ImportError:
        return None
    try:
        with open(path, encoding="utf-8") as f:
            rows = (yaml.safe_load(f) or {}).get(entry) or []
    except (OSError, yaml.YAMLError, AttributeError):
        rows = []
    names = spark.createDataFrame([], schema).columns
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows if isinstance(r, dict)], schema)
