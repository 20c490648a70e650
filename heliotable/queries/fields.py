"""Queries on fields: reading typed values, voting, checks and accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliotable.functions import parsing, similarity, text
from heliotable.operators import corrections, evaluation, quality, voting
from heliotable.plans.tables import table
from heliotable.queries.estimates import estimate_lines
from heliotable.queries.registry import SQL, query
from heliotable.sources import json_store

_LINES = "(select distinct on (line_key) * from estimate_line)"
_SURVEYS = "(select distinct on (survey_id) * from survey)"
_HALF = "translate({0}, '０１２３４５６７８９．，－：／　', '0123456789.,-:/ ')"


def surveys(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "survey").dropDuplicates(["survey_id"])


@query("select c_custkey, regexp_replace(lower(c_name || ' ' || c_mktsegment), '[^\\p{L}\\p{N}]', '', 'g') as key from customer")
def desc_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", text.description_key(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("key"))


@query(f"""
select line_key, try_cast(nullif(regexp_extract(trim(quantity), '^(-?[0-9]+(?:\\.[0-9]+)?)', 1), '') as double) as quantity_value, trim(regexp_replace(trim(quantity), '^-?[0-9]+(\\.[0-9]+)?', '')) as quantity_unit from {_LINES}""")
def quantity_split(spark: SparkSession, folder: str) -> DataFrame:
    return estimate_lines(spark, folder).select("line_key", parsing.quantity_value(F.col("quantity")).alias("quantity_value"), parsing.quantity_unit(F.col("quantity")).alias("quantity_unit"))


@query(f"""
with t as (select line_key, {_HALF.format("quantity")} as t from {_LINES}), h as (select *, regexp_extract_all(t, '([0-9]+)\\s*枚', 1) as hits from t)
select line_key, coalesce(try_cast(coalesce(nullif(regexp_extract(t, '合計\\s*([0-9]+)\\s*枚', 1), ''), case when len(hits) = 1 then hits[1] when len(hits) = 0 and regexp_matches(trim(t), '^[0-9]+$') then trim(t) end) as bigint), 0)::bigint as n from h""")
def count_with_unit(spark: SparkSession, folder: str) -> DataFrame:
    return estimate_lines(spark, folder).select("line_key", parsing.count_of(F.col("quantity"), "枚").alias("n"))


@query(f"""
with r as (select survey_id, list_filter(list_transform(list_filter(regexp_extract_all(equipment.module_model, '([0-9]+)(?:[^0-9vV]|$)', 1), lambda x: length(x) >= 3), lambda x: right(x, 4)::int), lambda x: x between 300 and 750) as fit from {_SURVEYS})
select survey_id, fit[len(fit)] as watts from r""")
def wattage_from_text(spark: SparkSession, folder: str) -> DataFrame:
    return surveys(spark, folder).select("survey_id", parsing.wattage(F.col("equipment.module_model")).alias("watts"))


@query("select p_partkey, strftime((date '1899-12-30' + (p_size * 900 + 1000)::int)::date, '%Y-%m-%d') as day from part")
def excel_serial_date(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", parsing.serial_date(F.col("p_size") * 900 + 1000).cast("string").alias("day"))


@query(f"""
with t as (select line_key, lower({_HALF.format("trim(remarks)")}) as t from {_LINES}),
n as (select line_key, try_cast(nullif(regexp_extract(t, '([0-9]+(?:\\.[0-9]+)?)', 1), '') as double) as n, regexp_extract(t, '[0-9]\\s*(mm|cm|m)', 1) as u from t)
select line_key, coalesce(case when u = 'mm' then n when u = 'cm' then n * 10 when u = 'm' then n * 1000 else n end, 0.0) as mm from n""")
def unit_to_mm(spark: SparkSession, folder: str) -> DataFrame:
    return estimate_lines(spark, folder).select("line_key", parsing.length_mm(F.col("remarks")).alias("mm"))


@query(f"""
select survey_id, (case when x > 0 and x < 10 then x * 1000 when x >= 10 and x < 100 then x * 10 else coalesce(x, 0.0) end)::double as mm from (select survey_id, high_voltage.separation_ns_mm as x from {_SURVEYS})""")
def separation_mm(spark: SparkSession, folder: str) -> DataFrame:
    """Separations stated as bare numbers: metres, centimetres or millimetres by their size."""
    return surveys(spark, folder).select("survey_id", parsing.bare_length_mm(F.col("high_voltage.separation_ns_mm")).alias("mm"))


@query(f"""
with d as (select survey_id, regexp_replace({_HALF.format("project.postal_code")}, '[^0-9]', '', 'g') as d from {_SURVEYS})
select survey_id, case when length(d) = 7 then substr(d, 1, 3) || '-' || substr(d, 4, 4) else '' end as postal_code from d""")
def postal_format(spark: SparkSession, folder: str) -> DataFrame:
    return surveys(spark, folder).select("survey_id", parsing.postal_code(F.col("project.postal_code")).alias("postal_code"))


@query(f"""
with t as (select survey_id, project.survey_date as c, upper({_HALF.format("trim(project.survey_date)")}) as t from {_SURVEYS}),
e as (select *, regexp_extract(t, '^(R|H|S|令和|平成|昭和)\\s*([0-9]{{1,2}})\\s*[年/.\\-]\\s*([0-9]{{1,2}})\\s*[月/.\\-]\\s*([0-9]{{1,2}})', ['era', 'y', 'm', 'd']) as e,
  regexp_extract(t, '([0-9]{{4}})\\s*[年/.\\-]\\s*([0-9]{{1,2}})\\s*[月/.\\-]\\s*([0-9]{{1,2}})', ['y', 'm', 'd']) as p from t)
select survey_id, case when e.era <> '' then (case e.era when 'R' then 2018 when '令和' then 2018 when 'H' then 1988 when '平成' then 1988 else 1925 end + try_cast(e.y as int))::varchar || '/' || lpad(e.m, 2, '0') || '/' || lpad(e.d, 2, '0')
 when p.y <> '' then p.y || '/' || lpad(p.m, 2, '0') || '/' || lpad(p.d, 2, '0')
 when regexp_full_match(t, '[0-9]{{4,6}}') then strftime((date '1899-12-30' + try_cast(t as int))::date, '%Y/%m/%d') else c end as day from e""")
def date_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return surveys(spark, folder).select("survey_id", parsing.date_text(F.col("project.survey_date")).alias("day"))


@query("select event_id, json_extract_string(props, '$.k')::bigint as k, 'k' as path, true as is_present from events")
def json_field(spark: SparkSession, folder: str) -> DataFrame:
    """A JSON value by path, and whether the path is there at all."""
    docs = table(spark, folder, "events").select("event_id", F.try_parse_json("props").alias("doc"))
    found = json_store.read_by_path(docs, "doc", "k", "bigint").withColumnRenamed("value", "k")
    return json_store.leaf_paths(found, ["event_id", "k", "is_present"], "doc").select("event_id", "k", "path", "is_present")


@query("""
with v as (select user_id, lower(trim(event_type)) as form, count(*) as n, min(event_id) as first_id, min_by(event_type, event_id) as winner from events where trim(event_type) <> '' group by all),
r as (select *, sum(n) over (partition by user_id)::bigint as n_votes from v qualify row_number() over (partition by user_id order by n desc, first_id) = 1)
select user_id, winner, n::bigint as n_winning, n_votes, case when n = n_votes then case when n_votes = 1 then 'medium' else 'high' end when n * 2 > n_votes then 'medium' else 'low' end as confidence from r""")
def majority_vote(spark: SparkSession, folder: str) -> DataFrame:
    return voting.majority(table(spark, folder, "events"), ["user_id"], "event_type", "event_id")


@query()
def vote_numeric_tolerance(spark: SparkSession, folder: str) -> DataFrame:
    """The readings of a survey that lie within a hundredth; clusters do not chain, which no window says."""
    readings = surveys(spark, folder).where("trim(equipment.module_model) <> ''").select(F.upper(F.trim("equipment.module_model")).alias("model"), F.col("equipment.module_output_w").alias("watts"))
    return voting.numeric_majority(readings, ["model"], "watts")


@query("""
with v as (select user_id, event_type, case when round(value) = 0 then case when value = 0 then 'correct' else 'wrong' end
 when abs(value - round(value)) / abs(round(value)) <= 0.02 then 'correct' when abs(value - round(value)) / abs(round(value)) <= 0.05 then 'partial' else 'wrong' end as verdict from events where value is not null)
select user_id, event_type, (count(*) filter (verdict = 'correct'))::bigint as correct, (count(*) filter (verdict = 'partial'))::bigint as partial, count(*)::bigint as total,
 round((count(*) filter (verdict = 'correct')) / count(*), 6) as share from v group by grouping sets ((user_id), (event_type), ())""")
def field_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    judged = table(spark, folder, "events").where("value is not null").withColumn("verdict", similarity.tolerance_verdict(F.col("value"), F.round("value")))
    return evaluation.accuracy(judged, "user_id", "event_type")


@query(f"""
with s as (select survey_id, equipment.module_model as model, equipment.module_output_w as w, equipment.planned_panels as n, equipment.pv_capacity_kw as kw from {_SURVEYS})
select survey_id, 'module_model' as field, 'missing' as code, 'error' as severity, null::varchar as new_value from s where model is null or trim(model) in ('', '0', '0.0')
union all select survey_id, 'module_output_w', 'out_of_range', 'warning', null from s where w < 200 or w > 800
union all select survey_id, 'planned_panels', 'out_of_range', 'warning', null from s where n < 1 or n > 2000
union all select survey_id, 'pv_capacity_kw', 'inconsistent', 'warning', null from s where w > 0 and n > 0 and abs(kw - round(w * n / 1000.0, 2)) > 0.05 * round(w * n / 1000.0, 2)""")
def validation_findings(spark: SparkSession, folder: str) -> DataFrame:
    e = lambda n: F.col(f"equipment.{n}")
    checks = [
        quality.required("module_model", e("module_model")),
        quality.in_range("module_output_w", e("module_output_w"), 200, 800),
        quality.in_range("planned_panels", e("planned_panels"), 1, 2000),
        quality.consistent_product("pv_capacity_kw", e("pv_capacity_kw"), e("module_output_w"), e("planned_panels"), 1000.0, 0.05),
    ]
    return quality.findings(surveys(spark, folder), "survey_id", checks).withColumn("new_value", F.lit(None).cast("string"))


@query(f"""
select survey_id, round(equipment.module_output_w * equipment.planned_panels / 1000.0, 2) as new_value from {_SURVEYS}
where equipment.module_output_w > 0 and equipment.planned_panels > 0
 and abs(equipment.pv_capacity_kw - round(equipment.module_output_w * equipment.planned_panels / 1000.0, 2)) > 0.05 * round(equipment.module_output_w * equipment.planned_panels / 1000.0, 2)""")
def capacity_fixes(spark: SparkSession, folder: str) -> DataFrame:
    check = quality.consistent_product("kw", F.col("equipment.pv_capacity_kw"), F.col("equipment.module_output_w"), F.col("equipment.planned_panels"), 1000.0, 0.05)
    return quality.findings(surveys(spark, folder), "survey_id", [check]).select("survey_id", F.col("new_value").cast("double").alias("new_value"))


@query("""
with o as (select * from events qualify row_number() over (partition by user_id, event_type order by floor(value / 10), event_id) = 1)
select user_id, event_type, row_number() over (partition by user_id order by floor(value / 10), event_id)::int as rank from o qualify row_number() over (partition by user_id order by floor(value / 10), event_id) <= 3""")
def top_confirmations(spark: SparkSession, folder: str) -> DataFrame:
    """What to ask first: each path once, the first three of a record."""
    items = table(spark, folder, "events").withColumn("priority", F.floor(F.col("value") / 10))
    first, _ = quality.top_confirmations(items, "user_id", "event_type", "priority", "event_id", 3)
    return first.select("user_id", "event_type", "rank")


@query(f"""
select survey_id, len(list_filter(map_values(field_confidences), lambda v: v = 'low'))::int as n_low, len(list_filter(map_values(field_confidences), lambda v: v = 'medium'))::int as n_medium from {_SURVEYS} where field_confidences is not null""")
def confidence_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = surveys(spark, folder).where("field_confidences is not null")
    return quality.confidence_counts(rows, "survey_id", "field_confidences", ["equipment.module_model"]).select("survey_id", "n_low", "n_medium")


@query("""
with h as (select distinct on (id) id, saved_at, estimate_id, total_with_tax from estimate_history)
select id, strftime(saved_at, '%Y-%m-%d %H:%M:%S') as saved_at, estimate_id, total_with_tax from h order by h.saved_at desc nulls last, id desc limit 100""")
def history_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest hundred stored estimates; the limit is the report."""
    rows = table(spark, folder, "estimate_history").dropDuplicates(["id"]).select("id", "saved_at", "estimate_id", "total_with_tax")
    return json_store.newest(rows, ["saved_at", "id"], 100).withColumn("saved_at", F.date_format("saved_at", "yyyy-MM-dd HH:mm:ss"))


@query("""
with h as (select estimate_id, max(saved_at) as saved_at from estimate_history where estimate_id is not null group by all) select estimate_id, strftime(saved_at, '%Y-%m-%d %H:%M:%S') as saved_at from h""")
def store_merge(spark: SparkSession, folder: str) -> DataFrame:
    """A keyed store after the later half of the history is laid over the earlier one."""
    rows = table(spark, folder, "estimate_history").where("estimate_id is not null").select("estimate_id", "saved_at")
    early = F.month("saved_at") <= 6
    return json_store.merged(rows.where(early), rows.where(~early), "estimate_id", "saved_at").withColumn("saved_at", F.date_format("saved_at", "yyyy-MM-dd HH:mm:ss"))


# ---- typed texts with their values, which no table holds in all forms ----------------------------------------------


def _typed(spark: SparkSession, texts: list[str | None]) -> DataFrame:
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, typed string")


def _told(rows: list[tuple], columns: str) -> str:
    def literal(v) -> str:
        return "null" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return "select * from (values " + ", ".join("(" + ", ".join(map(literal, (i, *r))) + ")" for i, r in enumerate(rows)) + f") as t(id, typed, {columns})"


_NESTED = ['{"a":{"b":{"c":{"d":{"e":1}}}}}', '{"a":[1,{"b":2}],"c":{},"d":null,"x":{"y":"z"}}', "{}", "[1]", None, "broken"]
_LEAVES = [(0, "a.b.c.d.e", "1"), (1, "a", '[1,{"b":2}]'), (1, "c", "{}"), (1, "d", None), (1, "x.y", "z")]


@query("select * from (values " + ", ".join(f"({i}, '{p}', " + ("null" if v is None else f"'{v}'") + ")" for i, p, v in _LEAVES) + ") as t(id, path, value)")
def json_leaves(spark: SparkSession, folder: str) -> DataFrame:
    """Every leaf of documents of any depth; a null is a leaf, an array is one, an empty object too."""
    docs = _typed(spark, _NESTED).select("id", F.try_parse_json("typed").alias("doc"))
    return json_store.leaf_paths(docs, "id", "doc")


@query("""
select * from (values (0, null, true), (1, null, true), (2, null, false), (3, 5, true), (4, null, false)) as t(id, value, is_present)""")
def json_missing_or_null(spark: SparkSession, folder: str) -> DataFrame:
    """A path that is missing told from one that holds a null or a value of another kind."""
    docs = _typed(spark, ['{"a":{"b":null}}', '{"a":{"b":"x"}}', '{"a":{}}', '{"a":{"b":5}}', '{"c":1}']).select("id", F.try_parse_json("typed").alias("doc"))
    return json_store.read_by_path(docs, "doc", "a.b", "int").select("id", "value", "is_present")


_QUANTITIES = [("1,200枚", 1200.0, "枚"), ("２８８枚", 288.0, "枚"), ("+5 式", 5.0, "式"), ("-3.5m", -3.5, "m"), ("１，２００．５　㎡", 1200.5, "㎡"), ("一式", None, "一式"), ("30m", 30.0, "m"), ("", None, ""), (None, None, None), ("12", 12.0, "")]


@query("select id, typed, quantity_value::double as quantity_value, quantity_unit from (" + _told(_QUANTITIES, "quantity_value, quantity_unit") + ")")
def typed_quantities(spark: SparkSession, folder: str) -> DataFrame:
    rows = _typed(spark, [r[0] for r in _QUANTITIES])
    return rows.select("id", "typed", parsing.quantity_value(F.col("typed")).alias("quantity_value"), parsing.quantity_unit(F.col("typed")).alias("quantity_unit"))


_COUNTS = [("8枚", 8), ("東4枚・西4枚（計8枚）", 8), ("東4枚・西4枚(合計 8 枚)", 8), ("東4枚・西4枚", 0), ("24", 24), ("計１２枚", 12), ("1,200枚", 200), ("不明", 0), ("", 0), (None, 0)]


@query("select id, typed, n::bigint as n from (" + _told(_COUNTS, "n") + ")")
def typed_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _typed(spark, [r[0] for r in _COUNTS]).select("id", "typed", parsing.count_of(F.col("typed"), "枚").alias("n"))


_LENGTHS = [("1,200mm", 1200.0), ("8.85m", 8850.0), ("35cm", 350.0), ("8850", 8850.0), ("１２００mm", 1200.0), ("12,345,678", 12345678.0), ("なし", 0.0), ("", 0.0), (None, 0.0)]


@query("select id, typed, mm::double as mm from (" + _told(_LENGTHS, "mm") + ")")
def typed_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return _typed(spark, [r[0] for r in _LENGTHS]).select("id", "typed", parsing.length_mm(F.col("typed")).alias("mm"))


_PRICES = [("90,000", 90000, ""), ("-5,000", -5000, ""), ("９０，０００", 90000, ""), ("別途問合せ", None, "別途問合せ"), ("", None, ""), (None, None, ""), ("1200円", None, "1200円"), ("0", 0, "")]


@query("select id, typed, price::bigint as price, note from (" + _told(_PRICES, "price, note") + ")")
def typed_prices(spark: SparkSession, folder: str) -> DataFrame:
    return _typed(spark, [r[0] for r in _PRICES]).select("id", "typed", parsing.price(F.col("typed")).alias("price"), parsing.price_note(F.col("typed")).alias("note"))


# The categories of estimates, and other spellings of one of them.
CATEGORIES = ("支給品", "材料費", "施工費", "その他・諸経費等", "付帯工事", "特記事項", "共通仮設工事", "太陽光発電システム機器", "電材", "設置工事")
CATEGORY_ALIASES = dict.fromkeys(("その他諸経費等", "その他・諸経費", "その他諸経費", "諸経費", "諸経費等"), "その他・諸経費等") | {c: c for c in CATEGORIES}
_CATEGORIES = [("1. 支給品", "支給品"), ("４．その他・諸経費等", "その他・諸経費等"), ("その他 諸経費等", "その他・諸経費等"), ("諸経費", "その他・諸経費等"), ("２．太陽光発電システム機器", "太陽光発電システム機器"), ("見知らぬ", ""), ("", ""), (None, ""), ("設置 工事", "設置工事")]


@query("select id, typed, category from (" + _told(_CATEGORIES, "category") + ")")
def typed_categories(spark: SparkSession, folder: str) -> DataFrame:
    return _typed(spark, [r[0] for r in _CATEGORIES]).select("id", "typed", parsing.category_name(F.col("typed"), CATEGORY_ALIASES).alias("category"))


_SHORT_DATES = [("12/18", "2025/12/18"), ("1.5", "2025/01/05"), ("2-29", "2025/02/29"), ("13/40", "13/40"), ("R7.12.18", "2025/12/18"), ("令和7年12月18日", "2025/12/18"), ("2025-1-8", "2025/01/08"), ("未定", "未定"), ("", ""), (None, None)]


@query("select id, typed, day from (" + _told(_SHORT_DATES, "day") + ")")
def typed_short_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Months and days in a year that is given: the reference year is data, never the clock."""
    return _typed(spark, [r[0] for r in _SHORT_DATES]).select("id", "typed", parsing.short_date_text(F.col("typed"), F.lit(2025)).alias("day"))


_DATES = SQL["date_normalize"]
_POSTAL = "regexp_replace(" + _HALF.format("{0}") + ", '[^0-9]', '', 'g')"


def _seven(digits: str) -> str:
    return f"case when length({digits}) = 7 then substr({digits}, 1, 3) || '-' || substr({digits}, 4, 4) end"


@query(f"""
with s as (select * from {_SURVEYS}), days as ({_DATES}),
p as (select survey_id, project.postal_code as old, {_POSTAL.format("project.postal_code")} as d, {_POSTAL.format("regexp_extract(" + _HALF.format("project.address") + ", '〒?\\s*([0-9]{3}-?[0-9]{4})(?:[^0-9]|$)', 1)")} as a from s),
w as (select survey_id, equipment.module_output_w as old, list_min(list_transform({corrections.TYPICAL_WATTS}, lambda t: {{'d': abs(equipment.module_output_w - t), 'v': t}})) as best from s where equipment.module_output_w > 0),
k as (select survey_id, equipment.pv_capacity_kw as old, round(equipment.module_output_w * equipment.planned_panels / 1000.0, 2) as kw from s),
c as (select survey_id, 'postal_code' as field, old as old_value, coalesce({_seven("d")}, {_seven("a")}) as new_value, 'high' as confidence from p
 union all select survey_id, 'survey_date', project.survey_date, day, 'high' from s join days using (survey_id) where trim(project.survey_date) <> ''
 union all select survey_id, 'module_output_w', old::varchar, (case when best.d <= 10 then best.v::double else old end)::varchar, 'medium' from w
 union all select survey_id, 'pv_capacity_kw', old::varchar, kw::varchar, case when coalesce(old, 0) <= 0 then 'medium' else 'low' end from k where kw > 0 and (coalesce(old, 0) <= 0 or abs(old - kw) > 0.05 * kw))
select * from c where new_value is not null and old_value is distinct from new_value""")
def survey_corrections(spark: SparkSession, folder: str) -> DataFrame:
    """Fields whose corrected value differs from the stored one."""
    return corrections.corrections(surveys(spark, folder))
