"""Merging repeated readings of one record by majority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def confidence(winning: Column, votes: Column, samples: Column) -> Column:
    """One sample gives medium; of several, all votes equal high, more than half medium, else low."""
    return F.when(samples == 1, "medium").when((votes > 0) & (winning == votes), "high").when(winning * 2 > votes, "medium").otherwise("low")


def majority(readings: DataFrame, group: list[str], value: str, sample: str, normal: Column | None = None) -> DataFrame:
    """The value most samples agree on, by its normal form; ties go to the form first seen.

    Blank and null values do not vote; where all are blank the winner is '' with
    low confidence. The value given is the first sample's spelling of the winning form.
    """
    form = normal if normal is not None else F.lower(F.trim(value))
    votes = readings.withColumn("__form", F.when(F.col(value).rlike(r"(?U)\S"), form))
    forms = votes.groupBy(*group, "__form").agg(F.count("*").alias("n_winning"), F.min(F.struct(F.col(sample).alias("s"), F.col(value).alias("v"))).alias("__first"))
    w, voted = W.partitionBy(*group), F.col("__form").isNotNull()
    counted = forms.withColumn("n_samples", F.sum("n_winning").over(w)).withColumn("n_votes", F.coalesce(F.sum(F.when(voted, F.col("n_winning"))).over(w), F.lit(0).cast("bigint")))
    first = counted.withColumn("__k", F.row_number().over(w.orderBy(F.desc(voted.cast("int")), F.desc("n_winning"), "__first.s", "__form"))).where("__k = 1")
    won = first.withColumn("n_winning", F.when(voted, F.col("n_winning")).otherwise(F.lit(0).cast("bigint")))
    return won.select(*group, F.when(voted, F.col("__first.v")).otherwise("").alias("winner"), "n_winning", "n_votes", confidence(F.col("n_winning"), F.col("n_votes"), F.col("n_samples")).alias("confidence"))


def close_clusters(values: Column, tolerance: float = 0.01) -> Column:
    """A sorted array of numbers cut into clusters: each takes what is within a tolerance of its smallest value.

    The tolerance is relative to the larger of the two; clusters do not chain.
    """
    empty = F.array().cast("array<array<double>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        anchor = last[0]
        base = F.greatest(F.abs(anchor), F.abs(x), F.lit(1e-9))
        joins = (F.size(acc) > 0) & (F.abs(x - anchor) / base <= tolerance)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, F.array(x))))
        return F.when(joins, grown).otherwise(F.concat(acc, F.array(F.array(x))))

    return F.aggregate(F.array_sort(values), empty, lambda acc, x: F.when(F.size(acc) == 0, F.array(F.array(x))).otherwise(step(acc, x)))


def numeric_majority(readings: DataFrame, group: list[str], value: str, tolerance: float = 0.01) -> DataFrame:
    """The smallest value of the largest cluster of close readings; of equal clusters the lower. Readings of a record are few."""
    lists = readings.where(F.col(value).isNotNull()).groupBy(*group).agg(F.collect_list(F.col(value).cast("double")).alias("__v"))
    clustered = lists.withColumn("__c", close_clusters(F.col("__v"), tolerance))
    ranked = F.array_min(F.transform("__c", lambda c: F.struct((-F.size(c)).alias("n"), c[0].alias("v"))))
    out = clustered.withColumn("__b", ranked).withColumn("n_votes", F.size("__v")).withColumn("n_winning", -F.col("__b.n"))
    return out.select(*group, F.col("__b.v").alias("winner"), "n_winning", "n_votes", confidence(F.col("n_winning"), F.col("n_votes"), F.col("n_votes")).alias("confidence"))


def merged_document(votes: DataFrame, record: str, path: str = "path") -> DataFrame:
    """Winners of all paths of a record as two maps, path to value and path to confidence."""
    pair = F.collect_list(F.struct(F.col(path), F.col("winner"), F.col("confidence")))
    return votes.groupBy(record).agg(F.array_sort(pair).alias("__p")).select(
        record,
        F.map_from_entries(F.transform("__p", lambda x: F.struct(x[path], x["winner"]))).alias("values"),
        F.map_from_entries(F.transform("__p", lambda x: F.struct(x[path], x["confidence"]))).alias("confidences"),
    )


def merged_confidence(old: Column, new: Column) -> Column:
    """Two path-to-confidence maps: the old one holds unless the new one is low."""
    both = F.map_zip_with(old, new, lambda _, a, b: F.when(b == "low", b).otherwise(F.coalesce(a, b)))
    return F.coalesce(both, old, new)
