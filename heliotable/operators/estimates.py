"""Estimates: hierarchical rollups, discounts, taxes, checks and reshaping.

Money is whole and of type bigint; amounts are truncated, never rounded, unless
an operator says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def truncated(c: Column) -> Column:
    return c.cast("bigint")


def discount_down_to(subtotal: Column, step: int) -> Column:
    """The discount, 0 or below, that takes a subtotal down to a multiple of a step; a step of 0 gives none."""
    if step <= 0:
        return F.lit(0).cast("bigint")
    return ((F.floor(subtotal / step) * step) - subtotal).cast("bigint")


def tax_of(total: Column, percent: int = 10, mode: str = "floor") -> Column:
    """Tax by floor, half-even round, or ceil, in exact decimals."""
    exact = total.cast("decimal(20,0)") * F.lit(percent).cast("decimal(4,0)") / F.lit(100).cast("decimal(4,0)")
    f = {"floor": F.floor, "round": F.bround, "ceil": F.ceil}[mode]
    return f(exact).cast("bigint")


def category_totals(lines: DataFrame, estimate: str, category: str, amount: Column) -> DataFrame:
    return lines.groupBy(estimate, category).agg(F.sum(truncated(amount)).alias("subtotal"), F.count("*").alias("n_lines"))


def estimate_totals(categories: DataFrame, estimate: str, step: int = 10_000, percent: int = 10, mode: str = "floor") -> DataFrame:
    """Subtotal, discount, tax and gross of each estimate from its category totals."""
    sums = categories.groupBy(estimate).agg(F.sum("subtotal").alias("subtotal"))
    priced = sums.withColumn("discount", discount_down_to(F.col("subtotal"), step)).withColumn("before_tax", F.col("subtotal") + F.col("discount"))
    return priced.withColumn("tax", tax_of(F.col("before_tax"), percent, mode)).withColumn("gross", F.col("before_tax") + F.col("tax"))


def totals_mismatch(lines: DataFrame, headers: DataFrame, estimate: str, amount: str, subtotal: str, tolerance: int = 1) -> DataFrame:
    """Headers whose subtotal is off the sum of their lines by more than a tolerance.

    Headers without a subtotal, or whose lines have no amount, are not judged.
    """
    sums = lines.where(F.col(amount).isNotNull()).groupBy(estimate).agg(F.sum(amount).alias("line_sum"))
    both = headers.where(F.col(subtotal).isNotNull()).join(sums, estimate)
    return both.withColumn("off_by", F.col("line_sum") - F.col(subtotal)).where(F.abs("off_by") > tolerance)


def flatten(estimates: DataFrame, estimate: str, categories: str = "categories", items: str = "items") -> DataFrame:
    """Lines of nested estimates with the places of category and item, from 0; empty categories give none."""
    outer = estimates.select(estimate, F.posexplode(categories).alias("category_pos", "category"))
    return outer.select(estimate, "category_pos", F.col("category"), F.posexplode(f"category.{items}").alias("item_pos", "item"))


def nest(lines: DataFrame, estimate: str, category: str, position: str, columns: list[str]) -> DataFrame:
    """Lines gathered into ordered items by category; an estimate's size bounds each list."""
    item = F.struct(F.col(position), *columns)
    return lines.groupBy(estimate, category).agg(F.array_sort(F.collect_list(item)).alias("items"))


def renumbered(lines: DataFrame, group: list[str], order: list[str], name: str = "no") -> DataFrame:
    return lines.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order)))


def moved_lines(lines: DataFrame, keys: DataFrame, on: list[str], to_category: str, group: str, order: list[str]) -> DataFrame:
    """Lines named by keys moved to another category, all renumbered within their categories."""
    hit = keys.select(*on).distinct().withColumn("__hit", F.lit(True))
    moved = lines.join(hit, on, "left").withColumn("category", F.when(F.col("__hit"), F.lit(to_category)).otherwise(F.col("category"))).drop("__hit")
    return renumbered(moved, [group, "category"], order)


def converted_price(amount: Column, quantity: Column) -> Column:
    """Whole unit price, half-even, of an amount whose quantity is stated in another unit; null for quantities of 0 or below."""
    return F.when(quantity > 0, F.bround(amount / quantity, 0).cast("bigint"))


def back_solved_discount(total: Column, subtotal: Column) -> Column:
    return (total - subtotal).cast("bigint")


def completed_price(price: Column, amount: Column, quantity: Column) -> Column:
    """The unit price, or where it is missing the one that amount and quantity make."""
    return F.coalesce(price, converted_price(amount, quantity))


def ordered_texts(rows: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """The texts of a group in order; blanks and nulls are left out."""
    item = F.when(F.trim(text) != "", F.struct(order, text))
    return rows.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x[text]).alias("texts"))
