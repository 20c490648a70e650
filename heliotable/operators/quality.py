"""Checks of records as data: findings are rows, fixes are values, never callbacks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """A named rule: ``wrong`` holds where the record breaks it; ``fix`` is the value it should have, if known."""

    field: str
    code: str
    severity: str
    wrong: Column
    fix: Column | None = None


def findings(records: DataFrame, key: str, checks: list[Check]) -> DataFrame:
    """``key, field, code, severity, new_value`` for every broken rule of every record, in one pass.

    A rule whose condition is null, for want of values, is not broken.
    """
    each = [
        F.when(c.wrong, F.struct(F.lit(c.field).alias("field"), F.lit(c.code).alias("code"), F.lit(c.severity).alias("severity"), (c.fix.cast("string") if c.fix is not None else F.lit(None).cast("string")).alias("new_value")))
        for c in checks
    ]
    return records.select(key, F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("f")).select(key, "f.*")


def required(field: str, column: Column) -> Check:
    return Check(field, "missing", "error", column.isNull() | (F.trim(column.cast("string")).isin("", "0", "0.0")))


def in_range(field: str, column: Column, least: float, most: float) -> Check:
    return Check(field, "out_of_range", "warning", (column < least) | (column > most))


def consistent_product(field: str, product: Column, a: Column, b: Column, scale: float, relative: float) -> Check:
    """A stated product off the product of its factors by more than a share; the fix is the computed one."""
    should = F.round(a * b / scale, 2)
    return Check(field, "inconsistent", "warning", (a > 0) & (b > 0) & (F.abs(product - should) > relative * should), should)


def applied(records: DataFrame, key: str, answers: DataFrame) -> DataFrame:
    """``key, field, old, new`` answers laid over a long table ``key, field, value``; changed values get high confidence."""
    own = answers.select(key, "field", F.col("value").alias("__new"))
    both = records.join(own, [key, "field"], "left")
    changed = F.col("__new").isNotNull() & ~F.col("__new").eqNullSafe(F.col("value"))
    return both.withColumn("old_value", F.col("value")).withColumn("changed", changed).withColumn("value", F.coalesce("__new", "value")).drop("__new")


def top_confirmations(items: DataFrame, key: str, path: str, priority: str, order: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """What to ask first: each path once, by priority, the first ``limit`` of a record, and the rest."""
    once = items.withColumn("__k", F.row_number().over(W.partitionBy(key, path).orderBy(priority, order))).where("__k = 1").drop("__k")
    ranked = once.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(priority, order, path)))
    return ranked.where(F.col("rank") <= limit), ranked.where(F.col("rank") > limit)


def confidence_counts(records: DataFrame, key: str, confidences: str, important: list[str]) -> DataFrame:
    """How many fields are of low and medium confidence, and which important ones are low."""
    low = F.map_keys(F.map_filter(confidences, lambda _, v: v == "low"))
    medium = F.map_keys(F.map_filter(confidences, lambda _, v: v == "medium"))
    return records.select(key, F.size(low).alias("n_low"), F.size(medium).alias("n_medium"), F.array_sort(F.array_intersect(low, F.array(*map(F.lit, important)))).alias("low_important"))
