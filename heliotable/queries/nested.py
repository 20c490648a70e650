"""Queries on nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heliotable.operators import nested_records
from heliotable.plans.tables import table
from heliotable.queries.registry import query


_CHILDREN = """
with recursive texts as (select distinct on (id) id, ltrim(payload, chr(65279)) as t from estimate_history where payload <> ''),
steps as (
  select id, t::json as j, 0 as k from texts where json_valid(t)
  union all
  select id, case when json_type(j) = 'VARCHAR' then (j ->> '$')::json else coalesce(j -> '$.estimate', j -> '$.payload', j -> '$.parsed') end, k + 1 from steps
  where (json_type(j) = 'VARCHAR' and json_valid(j ->> '$'))
    or (json_type(j) = 'OBJECT' and not json_exists(j, '$.summary') and not json_exists(j, '$.items') and not json_exists(j, '$.cover')
      and coalesce(json_type(j, '$.estimate'), json_type(j, '$.payload'), json_type(j, '$.parsed')) in ('OBJECT', 'VARCHAR'))),
roots as (select id, j from steps where json_type(j) = 'OBJECT' and (json_exists(j, '$.summary') or json_exists(j, '$.items') or json_exists(j, '$.cover'))),
lists as (
  select id, j -> '$.summary.categories' as v, 'category' as kind from roots union all select id, j -> '$.items', 'parsed_item' from roots),
entries as (
  select id, kind, unnest(case json_type(v) when 'ARRAY' then (v -> '$[*]') when 'OBJECT' then [v] else [] end) as e,
    unnest(case json_type(v) when 'ARRAY' then range(json_array_length(v)::bigint) when 'OBJECT' then [0] else [] end) as pos from lists),
items as (
  select id, pos as category_pos, unnest(case json_type(e, '$.items') when 'ARRAY' then (e -> '$.items[*]') when 'OBJECT' then [e -> '$.items'] else [] end) as i,
    unnest(case json_type(e, '$.items') when 'ARRAY' then range(json_array_length(e, '$.items')::bigint) when 'OBJECT' then [0] else [] end) as item_pos
  from entries where kind = 'category' and json_type(e) = 'OBJECT')
select id as history_id, kind as child_kind, (case kind when 'category' then pos else -1 end)::bigint as category_pos, (case kind when 'category' then -1 else pos end)::bigint as item_pos from entries where json_type(e) = 'OBJECT'
union all select id, 'category_item', category_pos::bigint, item_pos::bigint from items where json_type(i) = 'OBJECT'"""


@query(_CHILDREN)
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested_records.estimate_children(table(spark, folder, "estimate_history")).select("history_id", "child_kind", "category_pos", "item_pos")


@query()
def p6_objects(spark: SparkSession, folder: str) -> DataFrame:
    return nested_records.distinct_objects(nested_records.places(table(spark, folder, "estimate_history"), "id", "payload"))


@query()
def p6_links(spark: SparkSession, folder: str) -> DataFrame:
    return nested_records.links(nested_records.places(table(spark, folder, "estimate_history"), "id", "payload"))
