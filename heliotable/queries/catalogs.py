"""Queries on catalogs. Parts stand for products, events in order of time for rows of a file, a user for the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliotable.operators import catalog
from heliotable.plans.tables import table
from heliotable.queries.registry import query


def _part(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


@query("""
select event_id, user_id, last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as filled from events""")
def master_forward_fill(spark: SparkSession, folder: str) -> DataFrame:
    rows = _events(spark, folder).withColumn("head", F.when(F.col("event_type") == "purchase", F.col("value")))
    return catalog.forward_filled(rows, "head", ["ts", "event_id"], ["user_id"], "filled").select("event_id", "user_id", "filled")


@query("""
with f as (select *, min(case when value > 40 then event_id end) over (partition by user_id) as first_id from events),
m as (select event_id, user_id, case when event_id = first_id then 'boundary' when event_type = 'signup' then event_type end as mark from f)
select event_id, user_id, last_value(mark ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as category from m""")
def master_boundary_inject(spark: SparkSession, folder: str) -> DataFrame:
    rows = _events(spark, folder).withColumn("mark", F.when(F.col("event_type") == "signup", F.col("event_type")))
    return catalog.with_boundary(rows, "mark", F.col("value") > 40, F.lit("boundary"), "event_id", ["user_id"]).select("event_id", "user_id", F.col("mark_filled").alias("category"))


@query("""
with l as (select *, last_value(case when event_type = 'signup' then event_id end ignore nulls) over w as code, last_value(case when event_type = 'signup' then floor(value / 20) end ignore nulls) over w as maker
  from events window w as (partition by user_id order by ts, event_id rows unbounded preceding))
select event_id, case when event_type <> 'signup' and maker = floor(value / 20) then code end as parent_code from l""")
def parent_link(spark: SparkSession, folder: str) -> DataFrame:
    rows = _events(spark, folder).withColumn("maker", F.floor(F.col("value") / 20))
    return catalog.parent_link(rows, F.col("event_type") == "signup", "event_id", "maker", ["ts", "event_id"], ["user_id"]).select("event_id", "parent_code")


@query("""
select p_partkey, p_name, row_number() over (partition by p_name order by p_size desc, p_partkey desc) = 1 as is_canonical, count(*) over (partition by p_name)::bigint as n_rows, count(*) over (partition by p_name) > 1 as is_duplicate from part""")
def master_canonical(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.canonical_rows(_part(spark, folder).select("p_partkey", "p_name", "p_size"), "p_name", ["p_size", "p_partkey"]).drop("p_size")


@query("""
select p_partkey, case when count(*) over (partition by p_brand, p_name) > 1 then p_brand || '-' || p_name || '#' || row_number() over (partition by p_brand, p_name order by p_partkey) else p_brand || '-' || p_name end as unique_id from part""")
def master_unique_id(spark: SparkSession, folder: str) -> DataFrame:
    rows = _part(spark, folder).select("p_partkey", F.concat_ws("-", "p_brand", "p_name").alias("base"))
    return catalog.unique_ids(rows, "base", ["p_partkey"]).select("p_partkey", "unique_id")


@query("select p_brand, min(p_partkey) as first_pos from part where p_brand <> '' group by all")
def first_seen_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.first_seen(_part(spark, folder), "p_brand", "p_partkey")


@query("""
select p_type, count(*)::bigint as n, count(distinct p_brand)::bigint as n_makers, (count(*) filter (p_retailprice > 1000))::bigint as n_priced, (count(*) - count(distinct p_name))::bigint as n_repeats from part group by all""")
def master_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _part(spark, folder).groupBy("p_type").agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("n_makers"), F.count_if(F.col("p_retailprice") > 1000).alias("n_priced"), (F.count("*") - F.count_distinct("p_name")).alias("n_repeats"))


@query("""
select p_partkey, p_name, p_brand from part where contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'bolt') and contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand#1') and p_size >= 5 order by p_partkey limit 300""")
def catalog_search(spark: SparkSession, folder: str) -> DataFrame:
    """The first 300 products that hold every word."""
    return catalog.search(_part(spark, folder), ["p_name", "p_brand", "p_type"], "Bolt  brand#1", ["p_partkey"], 300, F.col("p_size") >= 5).select("p_partkey", "p_name", "p_brand")


@query("""
select p_partkey, p_retailprice as base_price, case when p_size > 40 then p_retailprice + 50 else p_retailprice end as p_retailprice, p_size > 40 as is_overridden from part""")
def price_override(spark: SparkSession, folder: str) -> DataFrame:
    part = _part(spark, folder).select("p_partkey", "p_size", "p_retailprice")
    overrides = part.where("p_size > 40").select("p_partkey", (F.col("p_retailprice") + 50).alias("p_retailprice"))
    return catalog.overridden(part, overrides, "p_partkey", "p_retailprice").drop("p_size")


@query("""
with r as (select p_partkey as request_id, case when p_size <= 10 then p_partkey::varchar else '' end as code, case when p_size <= 30 then p_brand else '' end as maker, p_name as model from part),
p as (select p_partkey as product_id, p_partkey::varchar as code, p_brand as maker, p_name as model, p_type = 'PROMO' as is_canonical, p_size as page from part),
h as (select request_id, product_id, 1 as step, is_canonical, page from r join p on r.code = p.code where r.code <> ''
 union all select request_id, product_id, 2, is_canonical, page from r join p on lower(r.model) = lower(p.model) and lower(r.maker) = lower(p.maker) where r.maker <> ''
 union all select request_id, product_id, 3, is_canonical, page from r join p on lower(r.model) = lower(p.model) where r.maker = '')
select request_id, product_id, step::int as step from h qualify row_number() over (partition by request_id order by step, is_canonical desc, page, product_id) = 1""")
def price_resolve(spark: SparkSession, folder: str) -> DataFrame:
    part = _part(spark, folder)
    requests = part.select(F.col("p_partkey").alias("request_id"), F.when(F.col("p_size") <= 10, F.col("p_partkey").cast("string")).otherwise("").alias("code"), F.when(F.col("p_size") <= 30, F.col("p_brand")).otherwise("").alias("maker"), F.col("p_name").alias("model"))
    products = part.select(F.col("p_partkey").alias("product_id"), F.col("p_partkey").cast("string").alias("code"), F.col("p_brand").alias("maker"), F.col("p_name").alias("model"), (F.col("p_type") == "PROMO").alias("is_canonical"), F.col("p_size").alias("page"))
    return catalog.resolved_products(requests, products)


_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[\\s\\-_/]+'), lambda t: t <> ''))"


@query(f"""
with q as (select distinct equipment.module_model as query from survey where equipment.module_model <> ''), c as (select id as candidate_id, model from registry_product),
b as (select query, candidate_id, lower(trim(query)) as q, lower(trim(model)) as m, {_TOKENS.format("query")} as tq, {_TOKENS.format("model")} as tm from q, c),
s as (select *, len(list_intersect(tq, tm)) as shared, len(list_distinct(list_concat(tq, tm))) as together from b)
select query, candidate_id, round(case when q = m then 10.0 when contains(m, q) then 6.0 + length(q) / length(m) when contains(q, m) then 4.0 + length(m) / length(q) else 1.0 + 3.0 * shared / together end, 6)::double as score from s where shared > 0""")
def model_score(spark: SparkSession, folder: str) -> DataFrame:
    """Typed models scored against the products they share a token with, as its SQL says; all of them are in registry_match."""
    requests = table(spark, folder, "survey").select(F.col("equipment.module_model").alias("query")).where("query <> ''").distinct().withColumn("request_id", F.col("query"))
    candidates = table(spark, folder, "registry_product").select(F.col("id").alias("candidate_id"), "model")
    return catalog.scored_models(requests, candidates).select("query", "candidate_id", F.round("score", 6).alias("score"))


_MODEL_KEY = "trim(regexp_replace(translate(lower(trim({0})), '０１２３４５６７８９‐－ー―−　', '0123456789----- '), '\\s+', ' ', 'g'))"


@query(f"""
with q as (select distinct equipment.module_model as query from survey where equipment.module_model <> ''),
n as (select id as candidate_id, model as name from registry_product union select id, unnest(model_aliases) from registry_product),
k as (select query, candidate_id, {_MODEL_KEY.format("query")} as q, {_MODEL_KEY.format("name")} as m from q, n),
b as (select *, {_TOKENS.format("q")} as tq, {_TOKENS.format("m")} as tm from k where q <> '' and m <> ''),
s as (select *, len(list_intersect(tq, tm)) as shared, len(list_distinct(list_concat(tq, tm))) as together from b),
r as (select query, candidate_id, case when q = m then 10.0 when contains(m, q) then 6.0 + length(q) / length(m) when contains(q, m) then 4.0 + length(m) / length(q) when shared > 0 then 1.0 + 3.0 * shared / together else 0.0 end as score from s)
select query, candidate_id, round(max(score), 6)::double as score from r group by all having max(score) > 0""")
def registry_match(spark: SparkSession, folder: str) -> DataFrame:
    """Typed models with every product that one of its names, aliases among them, brings a score, and the best of these."""
    requests = table(spark, folder, "survey").select(F.col("equipment.module_model").alias("query")).where("query <> ''").distinct().withColumn("request_id", F.col("query"))
    products = table(spark, folder, "registry_product").select(F.col("id").alias("candidate_id"), "model", "model_aliases")
    return catalog.registry_matches(requests, products).select(F.col("request_id").alias("query"), "candidate_id", F.round("score", 6).alias("score"))


@query(f"""
with r as (select distinct equipment.module_maker as maker, equipment.module_model as model from survey), p as (select distinct on (id) * from registry_product),
n as (select id, model as name from p union select id, unnest(model_aliases) from p),
k as (select maker, model, id, {_MODEL_KEY.format("model")} as q, {_MODEL_KEY.format("name")} as m from (select maker, model from r where trim(model) <> '') r, n),
b as (select *, {_TOKENS.format("q")} as tq, {_TOKENS.format("m")} as tm from k where q <> '' and m <> ''),
t as (select *, len(list_intersect(tq, tm)) as shared, len(list_distinct(list_concat(tq, tm))) as together from b),
s as (select maker, model, id, max(case when q = m then 10.0 when contains(m, q) then 6.0 + length(q) / length(m) when contains(q, m) then 4.0 + length(m) / length(q) when shared > 0 then 1.0 + 3.0 * shared / together else 0.0 end) as score from t group by all),
h as (select r.maker, r.model, p.id, lower(trim(r.maker)) as a, lower(trim(p.maker)) as z from r, p where trim(r.maker) <> '' and trim(p.maker) <> ''),
w as (select maker, model, id, case when a = z then 5.0 else 2.5 end as score from h where contains(a, z) or contains(z, a)),
g as (select maker, model, id, sum(score) as score from (select * from s where score > 0 union all select * from w) group by all)
select maker, model, id as candidate_id, round(score, 6)::double as score from g qualify row_number() over (partition by maker, model order by round(score, 9) desc, id) = 1""")
def registry_pick(spark: SparkSession, folder: str) -> DataFrame:
    """The one product that typed makers and models speak for most."""
    typed = table(spark, folder, "survey").select(F.col("equipment.module_maker").alias("maker"), F.col("equipment.module_model").alias("query")).distinct()
    requests = typed.withColumn("request_id", F.struct("maker", "query"))
    products = table(spark, folder, "registry_product").select(F.col("id").alias("candidate_id"), "maker", "model", "model_aliases").dropDuplicates(["candidate_id"])
    picks = catalog.registry_picks(requests, products.withColumn("place", F.col("candidate_id")), "place")
    return picks.select("request_id.maker", F.col("request_id.query").alias("model"), "candidate_id", F.round("score", 6).alias("score"))


@query("""
select p_partkey, case when list_min(list_transform([200, 300, 400, 550, 660], lambda t: abs(p_size * 15 - t))) <= 10
 then list_min(list_transform([200, 300, 400, 550, 660], lambda t: {'d': abs(p_size * 15 - t), 'v': t})).v::double else (p_size * 15)::double end as watts from part""")
def nearest_snap(spark: SparkSession, folder: str) -> DataFrame:
    watts = (F.col("p_size") * 15).cast("double")
    return _part(spark, folder).select("p_partkey", catalog.nearest_of(watts, [200, 300, 400, 550, 660], 10).alias("watts"))


@query("""
with l as (select p_partkey, p_type, p_retailprice from part), r as (select p_partkey as other, p_type, p_retailprice as other_price from part where p_size > 45)
select p_partkey, other, round(abs(p_retailprice - other_price), 6) as distance from l join r using (p_type) where abs(p_retailprice - other_price) <= 5.0
qualify row_number() over (partition by p_partkey order by abs(p_retailprice - other_price), other) = 1""")
def nearest_asof(spark: SparkSession, folder: str) -> DataFrame:
    part = _part(spark, folder)
    right = part.where("p_size > 45").select(F.col("p_partkey").alias("other"), "p_type", F.col("p_retailprice").alias("other_price"))
    met = catalog.nearest_within(part.select("p_partkey", "p_type", "p_retailprice"), right, "p_type", "p_retailprice", "other_price", 5.0, "p_partkey", "other")
    return met.select("p_partkey", "other", F.round("distance", 6).alias("distance"))


@query("select p_partkey, case when p_size <= 10 then 'small' when p_size <= 25 then 'middle' when p_size <= 40 then 'large' else 'beyond' end as band from part")
def band_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return _part(spark, folder).select("p_partkey", catalog.band(F.col("p_size"), [(10, "small"), (25, "middle"), (40, "large")], "beyond").alias("band"))


@query("""
with p as (select distinct prefix, meaning from (select regexp_extract(model, '^[A-Z]+') as prefix, min(maker) over (partition by regexp_extract(model, '^[A-Z]+')) as meaning from registry_product
 union all select regexp_extract(model, '^[A-Z]+-[0-9]+'), min(maker) over (partition by regexp_extract(model, '^[A-Z]+-[0-9]+')) from registry_product) where prefix <> ''),
s as (select distinct on (survey_id) survey_id, equipment.module_model as model from survey)
select survey_id, prefix, meaning from s join p on starts_with(model, prefix) where model <> '' qualify row_number() over (partition by survey_id order by length(prefix) desc, meaning) = 1""")
def prefix_longest(spark: SparkSession, folder: str) -> DataFrame:
    """The maker that the longest known beginning of a typed model stands for."""
    products = table(spark, folder, "registry_product")
    prefixes = None
    for pattern in ("^[A-Z]+", "^[A-Z]+-[0-9]+"):
        own = products.select(F.regexp_extract("model", pattern, 0).alias("prefix"), "maker").where("prefix <> ''").groupBy("prefix").agg(F.min("maker").alias("meaning"))
        prefixes = own if prefixes is None else prefixes.unionByName(own).distinct()
    rows = table(spark, folder, "survey").dropDuplicates(["survey_id"]).select("survey_id", F.col("equipment.module_model").alias("model"))
    return catalog.longest_prefix(rows, "model", "survey_id", prefixes)


@query("""
with a as (select lower(n_name) as alias, r_name as usual from nation join region on n_regionkey = r_regionkey)
select s_suppkey, coalesce(a.usual, trim(n.n_name)) as usual_name from supplier join nation n on s_nationkey = n_nationkey left join a on a.alias = lower(n.n_name)""")
def alias_normalize(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    aliases = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.upper("n_name").alias("alias"), F.col("r_name").alias("usual"))
    rows = table(spark, folder, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat(F.lit(" "), "n_name", F.lit(".")).alias("typed"))
    return catalog.by_alias(rows, "typed", aliases).select("s_suppkey", "usual_name")
