"""How well readings match the truth, by case, by field and overall in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(verdicts: DataFrame, case: str, field: str, verdict: str = "verdict") -> DataFrame:
    """Correct, partial and total counts of each case, each field and all; null marks what is summed over."""
    counts = [F.count_if(F.col(verdict) == v).alias(v) for v in ("correct", "partial")]
    sets = [[F.col(case)], [F.col(field)], []]
    out = verdicts.groupingSets(sets, case, field).agg(*counts, F.count("*").alias("total"))
    return out.withColumn("share", F.round(F.col("correct") / F.col("total"), 6))
