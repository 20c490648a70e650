"""Queries on differences between two versions, and on rules learned from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliotable.operators import edits, line_diff, rules
from heliotable.plans.joins import spread
from heliotable.plans.tables import table
from heliotable.queries.estimates import estimate_lines
from heliotable.queries.registry import query

_PARSED = "(select distinct on (line_id) * from parsed_line where category is not null)"
_LINES = "(select distinct on (line_key) * from estimate_line)"


def _parsed(spark: SparkSession, folder: str, source: str) -> DataFrame:
    return table(spark, folder, "parsed_line").where("category is not null").dropDuplicates(["line_id"]).where(F.col("source") == source)


@query(f"""
with l as (select line_id, category, description, remarks, row_number() over (partition by category, description, remarks order by line_id) as rn from {_PARSED} where source = 'ai'),
r as (select line_id, category, description, remarks, row_number() over (partition by category, description, remarks order by line_id) as rn from {_PARSED} where source = 'official'),
one as (select l.line_id as left_line_id, r.line_id as right_line_id, 1 as pass from l join r on l.category = r.category and l.description is not distinct from r.description and l.remarks is not distinct from r.remarks and l.rn = r.rn),
l2 as (select line_id, category, description, row_number() over (partition by category, description order by line_id) as rn from l where line_id not in (select left_line_id from one)),
r2 as (select line_id, category, description, row_number() over (partition by category, description order by line_id) as rn from r where line_id not in (select right_line_id from one))
select left_line_id, right_line_id, pass::int as pass from one union all
select l2.line_id, r2.line_id, 2::int from l2 join r2 on l2.category = r2.category and l2.description is not distinct from r2.description and l2.rn = r2.rn""")
def exact_pairing(spark: SparkSession, folder: str) -> DataFrame:
    """Two passes of ever looser keys, each zipping the k-th row with the k-th, over all estimates at once as its SQL
    says. All eight passes within an estimate are in fuzzy_pairing and p1_items."""
    pairs, _, _ = line_diff.exact_passes(_parsed(spark, folder, "ai"), _parsed(spark, folder, "official"), "line_id", "category", [["description", "remarks"], ["description"]], "line_id")
    return pairs


@query()
def fuzzy_pairing(spark: SparkSession, folder: str) -> DataFrame:
    """Lines typed by hand paired with computed ones of the same estimate, in all eight passes: exact and by matching
    ratio, within a category and where one is blank."""
    lines = line_diff.items_alone(estimate_lines(spark, folder), "description")
    return line_diff.item_pairs(lines.where("is_manual_input"), lines.where("not is_manual_input"), "estimate_id", "line_key")


@query("""
with a as (select l_orderkey, l_suppkey, count(*) as n from lineitem where l_returnflag = 'A' group by all), b as (select l_orderkey, l_suppkey, count(*) as n from lineitem where l_returnflag = 'R' group by all)
select l_orderkey, l_suppkey, case when b.n is null then 'removed' else 'added' end as change, coalesce(a.n, b.n)::bigint as n_rows from a full outer join b using (l_orderkey, l_suppkey) where a.n is null or b.n is null""")
def residue_added_removed(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    return line_diff.added_and_removed(lines.where("l_returnflag = 'A'"), lines.where("l_returnflag = 'R'"), ["l_orderkey", "l_suppkey"])


@query(f"""
with l as (select *, row_number() over (partition by category, description, remarks order by line_id) as rn from {_PARSED} where source = 'ai'),
r as (select *, row_number() over (partition by category, description, remarks order by line_id) as rn from {_PARSED} where source = 'official'),
p as (select l.line_id as left_line_id, r.line_id as right_line_id, l.quantity_unit as lu, r.quantity_unit as ru, l.unit_price as lp, r.unit_price as rp from l join r on l.category = r.category and l.description is not distinct from r.description and l.remarks is not distinct from r.remarks and l.rn = r.rn)
select left_line_id, right_line_id, 'quantity_unit' as field, lu as old_value, ru as new_value from p where lu is distinct from ru
union all select left_line_id, right_line_id, 'unit_price', lp::varchar, rp::varchar from p where lp is distinct from rp""")
def line_changes(spark: SparkSession, folder: str) -> DataFrame:
    pairs = line_diff.zip_pairs(_parsed(spark, folder, "ai"), _parsed(spark, folder, "official"), ["category", "description", "remarks"], "line_id", ["line_id", "quantity_unit", "unit_price"])
    return line_diff.changes(pairs, ["quantity_unit", "unit_price"]).select("left_line_id", "right_line_id", "field", "old_value", "new_value")


@query()
def line_diff_of_projects(spark: SparkSession, folder: str) -> DataFrame:
    """What the official estimate of a project changed in the machine-made one, where both state one project's name.

    Estimates of one name are paired in order of their ids; lines are compared within a pair alone.
    """
    docs = table(spark, folder, "parsed_doc").where("trim(project_name) <> ''").select("doc_id", "source", F.trim("project_name").alias("project")).dropDuplicates(["doc_id"])
    paired = line_diff.zip_pairs(docs.where("source = 'ai'"), docs.where("source = 'official'"), ["project"], "doc_id", ["doc_id"]).select("left_doc_id", "right_doc_id")
    lines = table(spark, folder, "parsed_line").where("line_id is not null").dropDuplicates(["line_id"])
    left = lines.join(spread(paired.select(F.col("left_doc_id").alias("doc_id"))), "doc_id").withColumn("estimate", F.col("doc_id"))
    right = lines.join(spread(paired.select(F.col("right_doc_id").alias("doc_id"), F.col("left_doc_id").alias("estimate"))), "doc_id")
    return line_diff.estimate_diff(left, right, "estimate", "line_id")


@query(f"select line_key, count(*) over (partition by estimate_id, category, description)::bigint as n_same from {_LINES}")
def dup_key_guard(spark: SparkSession, folder: str) -> DataFrame:
    return line_diff.multiplicity(estimate_lines(spark, folder), ["estimate_id", "category", "description"]).select("line_key", "n_same")


@query("""
select event_id, case when row_number() over w = 1 then 'taken' when value is not distinct from first_value(value) over w then 'repeated' else 'conflict' end as verdict
from events window w as (partition by user_id, event_type order by ts, event_id)""")
def first_proposal_wins(spark: SparkSession, folder: str) -> DataFrame:
    return line_diff.first_proposals(table(spark, folder, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value").select("event_id", "verdict")


@query("""
with s as (select distinct on (survey_id) survey_id, string_split(project.project_name, ' ') as a, string_split(project.address, ' ') as b from survey),
l as (select survey_id, unnest(a) as left_value, unnest(range(len(a))) as pos from s), r as (select survey_id, unnest(b) as right_value, unnest(range(len(b))) as pos from s)
select survey_id, pos::int as pos, left_value, right_value from l full outer join r using (survey_id, pos)""")
def positional_outer(spark: SparkSession, folder: str) -> DataFrame:
    """Two lists side by side by place."""
    s = table(spark, folder, "survey").dropDuplicates(["survey_id"])
    left = s.select("survey_id", F.split("project.project_name", " ").alias("words"))
    right = s.select("survey_id", F.split("project.address", " ").alias("words"))
    return line_diff.positional(left, right, "survey_id", "words")


@query("""
with b as (select user_id, event_type, event_id, value, (value >= 20)::int as new from events),
r as (select user_id, event_type, value, first_value(event_id) over (partition by user_id, event_type order by new, event_id rows between unbounded preceding and unbounded following) as event_id,
 row_number() over (partition by user_id, event_type order by new desc, event_id desc) as k from b)
select user_id, event_type, event_id, value from r where k = 1""")
def rule_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """New values by key; the row first stored keeps its identity."""
    events = table(spark, folder, "events").select("user_id", "event_type", "event_id", "value", F.col("event_id").alias("seq"))
    return rules.upserted(events.where("value < 20"), events.where("value >= 20"), ["user_id", "event_type"], "seq", ["event_id"]).drop("seq")


@query("""
with u as (select p_name, p_brand, min(p_partkey) as rule_id, max(p_size)::double as v from part where p_size >= 40 group by all),
m as (select p.p_name, p.p_brand, u.rule_id, u.v, count(*) over (partition by u.rule_id) as n from part p join u on p.p_name = u.p_name and p.p_brand = u.p_brand),
c as (select p_name, p_brand, min_by(v, rule_id) as v, min(rule_id) as r from m where n = 1 group by all)
select p_partkey, coalesce(c.v, p_retailprice) as p_retailprice, c.r as applied_rule from part left join c using (p_name, p_brand)""")
def rule_apply_unique(spark: SparkSession, folder: str) -> DataFrame:
    """A rule applies only where it meets exactly one row."""
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    learned = part.where("p_size >= 40").groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("rule_id"), F.max("p_size").cast("double").alias("new_price"))
    rows = part.drop("p_size")
    return rules.applied_if_unique(rows, learned, ["p_name", "p_brand"], "rule_id", "p_retailprice", "new_price").select("p_partkey", "p_retailprice", "applied_rule")


@query("""
with t as (select list_name, max(no) as top from rule_item group by all), n as (select distinct 'wiring_items' as list_name, description from estimate_line where description <> ''),
f as (select * from n where not exists (select 1 from rule_item r where r.list_name = n.list_name and r.description = n.description))
select list_name, description, (coalesce(top, 0) + row_number() over (partition by list_name order by description))::bigint as no from f left join t using (list_name)""")
def rule_antijoin_add(spark: SparkSession, folder: str) -> DataFrame:
    """Items not on a list yet, numbered on from its greatest number."""
    new = table(spark, folder, "estimate_line").where("description <> ''").select(F.lit("wiring_items").alias("list_name"), "description").distinct()
    return rules.appended_if_absent(table(spark, folder, "rule_item"), new, "list_name", "description", "no", "description").select("list_name", "description", "no")


@query("select count(*)::bigint as total, (count(*) filter (list_name = 'install_items'))::bigint as install_items, (count(*) filter (list_name = 'wiring_items'))::bigint as wiring_items from rule_item")
def rules_summary(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "rule_item").withColumn("enabled", F.lit(None).cast("boolean"))
    return rules.summary(items, ["install_items", "wiring_items"], "list_name")


@query("""
with r as (select p_type as scope, count(*)::bigint as seq, max(p_retailprice) as v from part where p_type <> 'PROMO' group by all union all select '*', 5::bigint, 1.5::double),
a as (select seq, v from r where scope = '*')
select p_partkey, case when r.seq is null or (a.seq, a.v) > (r.seq, r.v) then a.v else r.v end as applied from part left join r on r.scope = p_type, a""")
def rules_by_scope(spark: SparkSession, folder: str) -> DataFrame:
    """The last rule of a row's own kind or of all kinds."""
    part = table(spark, folder, "part")
    own = part.where("p_type <> 'PROMO'").groupBy(F.col("p_type").alias("scope")).agg(F.count("*").alias("seq"), F.max("p_retailprice").alias("v"))
    every = part.sparkSession.range(1).select(F.lit("*").alias("scope"), F.lit(5).cast("bigint").alias("seq"), F.lit(1.5).alias("v"))
    return rules.by_scope(part.select("p_partkey", F.col("p_type").alias("scope")), own.unionByName(every), "scope", "seq", "v").select("p_partkey", "applied")


@query()
def edit_commands(spark: SparkSession, folder: str) -> DataFrame:
    """Each estimate's own lines read as commands: prices of hand-typed lines are set anew, nameless ones removed."""
    lines = estimate_lines(spark, folder)
    own = lines.select("estimate_id", "pos", "category", "description", F.col("quantity_value").alias("quantity"), "unit_price", "amount")
    commands = lines.where("is_manual_input").select("estimate_id", F.col("pos").alias("seq"), F.when(F.col("unit_price") > 0, "set_price").otherwise("remove").alias("action"), F.col("description").alias("target"), "category", F.col("unit_price").cast("double").alias("number"))
    return edits.replayed(own, commands)


@query("""
with l as (select distinct on (line_key) * from estimate_line)
select estimate_id, sum(coalesce(amount, 0))::bigint as subtotal, -1000::bigint as discount, (sum(coalesce(amount, 0)) - 1000)::bigint as total_before_tax, floor((sum(coalesce(amount, 0)) - 1000) / 10)::bigint as tax,
 (sum(coalesce(amount, 0)) - 1000 + floor((sum(coalesce(amount, 0)) - 1000) / 10))::bigint as total_with_tax from l group by all""")
def edit_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of every estimate after a discount is set and an unknown command is passed over."""
    lines = estimate_lines(spark, folder)
    heads = lines.select("estimate_id").distinct().select("estimate_id", *[F.lit(None).cast("string").alias(c) for c in edits.HEADS[1:4]], F.lit(0).cast("bigint").alias("discount"))
    orders = F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit("set_discount").alias("action")), F.struct(F.lit(2).alias("seq"), F.lit("unknown").alias("action")))).alias("o")
    blank = [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in edits.COMMANDS.split(", ")[3:] if x.split()[0] != "new_value"]
    commands = heads.select("estimate_id", orders).select("estimate_id", "o.seq", "o.action", F.lit("-1000").alias("new_value"), *blank)
    totals, _, _ = edits.edited(heads, lines, commands)
    return totals.select("estimate_id", "subtotal", "discount", "total_before_tax", "tax", "total_with_tax")
