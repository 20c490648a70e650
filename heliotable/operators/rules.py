"""Rule tables: upserts that keep identity, and applying rules to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, key: list[str], order: str, kept: list[str]) -> DataFrame:
    """Old rows and new ones by key: the last new one holds, but columns in ``kept`` stay the old row's.

    Written without MERGE, so it runs on any file table: union, one window.
    """
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = W.partitionBy(*key).orderBy("__new", order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    out = both
    for c in kept:
        out = out.withColumn(f"__{c}", F.first(c).over(whole))
    last = W.partitionBy(*key).orderBy(F.desc("__new"), F.desc(order))
    out = out.withColumn("__k", F.row_number().over(last)).where("__k = 1")
    for c in kept:
        out = out.withColumn(c, F.col(f"__{c}")).drop(f"__{c}")
    return out.drop("__new", "__k")


def removed(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key), key, "left_anti")


def flagged(rows: DataFrame, key: str, value, column: str, flag: bool) -> DataFrame:
    return rows.withColumn(column, F.when(F.col(key) == value, F.lit(flag)).otherwise(F.col(column)))


def applied_if_unique(rows: DataFrame, rules: DataFrame, on: list[str], rule_id: str, target: str, value: str) -> DataFrame:
    """A rule sets a value where it meets exactly one row; rules that meet several are passed over."""
    met = rows.join(rules.select(*on, rule_id, F.col(value).alias("__value")), on)
    single = met.withColumn("__n", F.count("*").over(W.partitionBy(rule_id))).where("__n = 1")
    keyed = single.select(*[c for c in rows.columns], rule_id, "__value")
    chosen = keyed.groupBy(*on).agg(F.min_by("__value", rule_id).alias("__value"), F.min(rule_id).alias("applied_rule"))
    return rows.join(chosen, on, "left").withColumn(target, F.coalesce("__value", target)).drop("__value")


def appended_if_absent(rows: DataFrame, new: DataFrame, group: str, key: str, number: str, order: str) -> DataFrame:
    """New rows whose key is not there yet, numbered on from the greatest number of their group."""
    fresh = new.join(rows.select(group, key), [group, key], "left_anti").dropDuplicates([group, key])
    top = rows.groupBy(group).agg(F.max(number).alias("__top"))
    rn = F.row_number().over(W.partitionBy(group).orderBy(order))
    return fresh.join(top, group, "left").withColumn(number, (F.coalesce("__top", F.lit(0)) + rn).cast("bigint")).drop("__top")


def summary(rules: DataFrame, kinds: list[str], kind: str = "kind", enabled: str = "enabled") -> DataFrame:
    """Counts of enabled rules by kind; a missing flag counts as enabled, an unknown kind in the total only."""
    on = F.coalesce(F.col(enabled), F.lit(True))
    return rules.where(on).agg(F.count("*").alias("total"), *[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


def defaults_only(column: Column, default: float, learned: Column, eps: float = 1e-6) -> Column:
    """A learned value where the column still is at its default."""
    return F.when((F.abs(column - default) < eps) & learned.isNotNull(), learned).otherwise(column)


def by_scope(rows: DataFrame, rules: DataFrame, scope: str, rule_order: str, value: str) -> DataFrame:
    """The last rule of a row's own scope or of ``*`` (all scopes), as ``applied``."""
    last = rules.groupBy(scope).agg(F.max(F.struct(rule_order, value)).alias("__last"))
    own = last.select(scope, F.col("__last").alias("__own"))
    for_all = last.where(F.col(scope) == "*").select(F.col(scope).alias("__star"), F.col("__last").alias("__all"))  # one row
    both = rows.join(own, scope, "left").withColumn("__star", F.lit("*")).join(F.broadcast(for_all), "__star", "left")
    return both.withColumn("applied", F.greatest("__own", "__all")[value]).drop("__own", "__all", "__star")
