"""Queries on estimates. An order stands for an estimate, a return flag for a category."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliotable.functions import expressions
from heliotable.operators import estimates
from heliotable.plans.tables import table
from heliotable.queries.registry import query

_ESTIMATE_LINES = "(select distinct on (line_key) * from estimate_line)"


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem")


def estimate_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Estimate lines, each key once: deliveries of a key have one content."""
    return table(spark, folder, "estimate_line").dropDuplicates(["line_key"])


@query("""
with c as (select l_orderkey, l_returnflag, sum(trunc(l_extendedprice)::bigint)::bigint as subtotal from lineitem group by all),
e as (select l_orderkey, sum(subtotal)::bigint as subtotal from c group by all),
d as (select *, (floor(subtotal / 10000) * 10000 - subtotal)::bigint as discount from e)
select l_orderkey, subtotal, discount, subtotal + discount as before_tax, ((subtotal + discount) * 10 // 100)::bigint as tax,
  (subtotal + discount + (subtotal + discount) * 10 // 100)::bigint as gross from d""")
def estimate_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Category totals, then estimates with discount, tax and gross."""
    categories = estimates.category_totals(_lines(spark, folder), "l_orderkey", "l_returnflag", F.col("l_extendedprice"))
    return estimates.estimate_totals(categories, "l_orderkey")


@query("""
select o_orderkey, trunc(o_totalprice)::bigint as total, (trunc(o_totalprice)::bigint * 8 // 100)::bigint as tax_floor,
  round_even(trunc(o_totalprice)::bigint * 8 / 100, 0)::bigint as tax_round, ceil(trunc(o_totalprice)::bigint * 8 / 100)::bigint as tax_ceil from orders""")
def estimate_tax_modes(spark: SparkSession, folder: str) -> DataFrame:
    total = estimates.truncated(F.col("o_totalprice"))
    return table(spark, folder, "orders").select("o_orderkey", total.alias("total"), *[estimates.tax_of(total, 8, m).alias(f"tax_{m}") for m in ("floor", "round", "ceil")])


@query("""
select l_returnflag, l_linestatus, sum(trunc(l_extendedprice)::bigint)::bigint as amount, count(*)::bigint as n_lines
from lineitem group by rollup (l_returnflag, l_linestatus)""")
def rollup_levels(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).rollup("l_returnflag", "l_linestatus").agg(F.sum(estimates.truncated(F.col("l_extendedprice"))).alias("amount"), F.count("*").alias("n_lines"))


@query("""
select l_orderkey, sum(trunc(l_extendedprice)::bigint) filter (l_returnflag = 'A')::bigint as amount_a,
  sum(trunc(l_extendedprice)::bigint) filter (l_returnflag = 'N')::bigint as amount_n, sum(trunc(l_extendedprice)::bigint) filter (l_returnflag = 'R')::bigint as amount_r
from lineitem group by all""")
def category_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """Labels spread into columns by conditional sums: one pass, whatever the number of labels."""
    amount = estimates.truncated(F.col("l_extendedprice"))
    return _lines(spark, folder).groupBy("l_orderkey").agg(*[F.sum(F.when(F.col("l_returnflag") == f, amount)).alias(f"amount_{f.lower()}") for f in "ANR"])


@query("""
with s as (select l_orderkey as o_orderkey, sum(trunc(l_extendedprice)::bigint)::bigint as line_sum from lineitem group by all)
select o_orderkey, trunc(o_totalprice)::bigint as subtotal, line_sum, (line_sum - trunc(o_totalprice)::bigint)::bigint as off_by
from orders join s using (o_orderkey) where abs(line_sum - trunc(o_totalprice)::bigint) > 1""")
def consistency_check(spark: SparkSession, folder: str) -> DataFrame:
    headers = table(spark, folder, "orders").select("o_orderkey", estimates.truncated(F.col("o_totalprice")).alias("subtotal"))
    lines = _lines(spark, folder).select(F.col("l_orderkey").alias("o_orderkey"), estimates.truncated(F.col("l_extendedprice")).alias("amount"))
    return estimates.totals_mismatch(lines, headers, "o_orderkey", "amount", "subtotal")


@query(f"""
select estimate_id, category, (row_number() over (partition by estimate_id, category order by pos, line_key) - 1)::int as item_pos, line_key, amount from {_ESTIMATE_LINES}""")
def estimate_nesting(spark: SparkSession, folder: str) -> DataFrame:
    """Lines gathered into the nested form and taken apart again."""
    nested = estimates.nest(estimate_lines(spark, folder), "estimate_id", "category", "pos", ["line_key", "amount"])
    whole = nested.groupBy("estimate_id").agg(F.collect_list(F.struct("category", "items")).alias("categories"))
    flat = estimates.flatten(whole, "estimate_id")
    return flat.select("estimate_id", F.col("category.category").alias("category"), "item_pos", "item.line_key", "item.amount")


@query(f"""
select estimate_id, line_key, category, row_number() over (partition by estimate_id, category order by pos, line_key)::int as no from {_ESTIMATE_LINES}""")
def renumber(spark: SparkSession, folder: str) -> DataFrame:
    return estimates.renumbered(estimate_lines(spark, folder), ["estimate_id", "category"], ["pos", "line_key"]).select("estimate_id", "line_key", "category", "no")


@query(f"""
with m as (select estimate_id, line_key, pos, case when is_manual_input then 'moved' else category end as category from {_ESTIMATE_LINES})
select estimate_id, line_key, category, row_number() over (partition by estimate_id, category order by pos, line_key)::int as no from m""")
def lines_moved(spark: SparkSession, folder: str) -> DataFrame:
    lines = estimate_lines(spark, folder)
    return estimates.moved_lines(lines, lines.where("is_manual_input"), ["line_key"], "moved", "estimate_id", ["pos", "line_key"]).select("estimate_id", "line_key", "category", "no")


@query(f"""
select line_key, case when quantity_value > 0 then round_even(amount / quantity_value, 0)::bigint end as unit_price from {_ESTIMATE_LINES}""")
def unit_price_conversion(spark: SparkSession, folder: str) -> DataFrame:
    return estimate_lines(spark, folder).select("line_key", estimates.converted_price(F.col("amount"), F.col("quantity_value")).alias("unit_price"))


@query("""
select p_partkey, (p_size >= 10 and p_type <> 'PROMO') or p_brand = 'Brand#4' as both_or, not (p_size > 20 and p_type = 'SMALL') as not_reaches,
  true as unreadable, false as unknown_field, false as unlike_kinds from part""")
def expr_condition(spark: SparkSession, folder: str) -> DataFrame:
    """Condition texts compiled into columns; NOT reaches to the end of its text."""
    part = table(spark, folder, "part")
    fields = expressions.fields_of(part.schema)
    texts = {"both_or": "(p_size >= 10 AND p_type != 'PROMO') OR p_brand == 'Brand#4'", "not_reaches": "NOT p_size > 20 AND p_type == 'SMALL'", "unreadable": "", "unknown_field": "p_missing > 3", "unlike_kinds": "p_type > 3"}
    return part.select("p_partkey", *[expressions.condition(t, fields).alias(n) for n, t in texts.items()])


@query("""
select p_partkey, (greatest(floor(p_size / 3.0), 2.0) * 1.5 + (p_size - 7 * floor(p_size / 7.0)))::double as a,
  (round_even(p_retailprice / 4.0, 0) - abs(-p_size))::double as b, case when p_size = 10 then null else 100.0 / (p_size - 10) end::double as c,
  (least(p_size ** 2, 500.0) + ceil(p_retailprice))::double as d from part""")
def expr_formula(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    names = {"size": F.col("p_size"), "price": F.col("p_retailprice")}
    texts = {"a": "max(size // 3, 2) * 1.5 + size % 7", "b": "round(price / 4) - abs(-size)", "c": "100 / (size - 10)", "d": "min(size ** 2, 500) + ceil(price)"}
    return part.select("p_partkey", *[expressions.formula(t, names).alias(n) for n, t in texts.items()])


@query("""
select p_partkey, case when p_size = 25 then p_size::varchar when p_size % 2 = 0 then (p_size // 2)::varchar else printf('%.2f', p_size / 2.0) end as by_formula, p_size::varchar as by_field, '7 sets' as by_text,
  case when p_size = 25 then p_size::double else p_size / 2.0 end as formula_value, p_size::double as field_value, 0.0::double as text_value from part""")
def expr_quantity(spark: SparkSession, folder: str) -> DataFrame:
    """A quantity from its formula, else its field, else its fixed text."""
    part = table(spark, folder, "part")
    fields, names = expressions.fields_of(part.schema), {"size": F.nullif(F.col("p_size"), F.lit(25))}
    a, x = expressions.quantity("size / 2", "p_size", "1", names, fields)
    b, y = expressions.quantity("", "p_size", "1", names, fields)
    c, z = expressions.quantity("", "p_none", "7 sets", names, fields)
    return part.select("p_partkey", a.alias("by_formula"), b.alias("by_field"), c.alias("by_text"), x.alias("formula_value"), y.alias("field_value"), z.alias("text_value"))
