"""Product catalogs: building from page rows, search, and resolving what was typed to a product.

Everything is an equi-join, a window or a projection; nothing compares each
typed value with every product. Partial matches meet through their tokens.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heliotable.functions.similarity import model_score, tokens
from heliotable.functions.text import registry_model_key
from heliotable.plans.joins import spread


def forward_filled(rows: DataFrame, column: str, order: list[str], group: list[str], name: str | None = None) -> DataFrame:
    """The last value at or before each row of a group that is not null.

    Give the file, or another bounded unit, as the group: a window without one
    would put all rows into one task.
    """
    w = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(name or f"{column}_filled", F.last(column, ignorenulls=True).over(w))


def with_boundary(rows: DataFrame, column: str, at: Column, value: Column, order: str, group: list[str]) -> DataFrame:
    """The first row of each group where ``at`` holds starts a new value; then the column is filled forward."""
    w = W.partitionBy(*group)
    marked = rows.withColumn("__first", F.min(F.when(at, F.col(order))).over(w))
    marked = marked.withColumn(column, F.when(F.col(order) == F.col("__first"), value).otherwise(F.col(column))).drop("__first")
    return forward_filled(marked, column, [order], group)


def parent_link(rows: DataFrame, is_parent: Column, code: str, maker: str, order: list[str], group: list[str]) -> DataFrame:
    """The last parent's code above each row, only if it is of the same maker; parents have none."""
    w = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(is_parent, F.struct(F.col(code).alias("code"), F.col(maker).alias("maker"))), ignorenulls=True).over(w)
    linked = rows.withColumn("__last", last)
    return linked.withColumn("parent_code", F.when(~is_parent & (F.col("__last.maker") == F.col(maker)), F.col("__last.code"))).drop("__last")


def canonical_rows(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of rows with one key the last in order is canonical; with flags for repeats and the key's count."""
    by_key = W.partitionBy(key)
    last = by_key.orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("is_canonical", F.row_number().over(last) == 1).withColumn("n_rows", F.count("*").over(by_key)).withColumn("is_duplicate", F.col("n_rows") > 1)


def unique_ids(rows: DataFrame, base: str, order: list[str], name: str = "unique_id") -> DataFrame:
    """``base``, or ``base#k`` counted in order where it repeats."""
    by = W.partitionBy(base)
    k = F.row_number().over(by.orderBy(*order))
    return rows.withColumn(name, F.when(F.count("*").over(by) > 1, F.concat_ws("#", F.col(base), k.cast("string"))).otherwise(F.col(base)))


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct values with the place at which each was first seen, null and '' left out."""
    return rows.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.min(order).alias("first_pos"))


def keyword_filter(haystack: list[str], query: str) -> Column:
    """Every word of a query is within the joined columns, in any case; an empty query fits all."""
    text = F.lower(F.concat_ws(" ", *haystack))
    return F.forall(F.filter(F.split(F.lit(query.lower()), r"\s+"), lambda t: t != ""), lambda t: F.contains(text, t))


def search(products: DataFrame, haystack: list[str], query: str, order: list, limit: int, where: Column | None = None) -> DataFrame:
    """The first products in order that fit all words; a limit of 0 or below gives none."""
    fit = products.where(keyword_filter(haystack, query))
    if where is not None:
        fit = fit.where(where)
    return fit.orderBy(*order).limit(max(limit, 0))


def overridden(products: DataFrame, overrides: DataFrame, key: str, price: str) -> DataFrame:
    """Prices replaced where an override exists; the base price is kept and the replacement flagged."""
    own = overrides.select(key, F.col(price).alias("__price"))
    both = products.join(own, key, "left")
    return both.withColumn("base_price", F.col(price)).withColumn("is_overridden", F.col("__price").isNotNull()).withColumn(price, F.coalesce("__price", price)).drop("__price")


def best_by_priority(candidates: DataFrame, request: str, priority: str, ties: list) -> DataFrame:
    """Of several kinds of hits for a request the one of least priority number."""
    return candidates.withColumn("__k", F.row_number().over(W.partitionBy(request).orderBy(priority, *ties))).where("__k = 1").drop("__k")


def resolved_products(requests: DataFrame, products: DataFrame) -> DataFrame:
    """``request_id, product_id, step`` for requests with ``code, maker, model`` against products with
    ``product_id, code, maker, model, is_canonical, page``.

    Step 1 the code, 2 the model of the same maker, 3 the model if the request
    names no maker. No step crosses makers. Canonical rows first, then the lower page.

    What a step gives depends on its key alone, so the first product of each
    key is taken before requests are joined: one row for a request and step.
    """
    order = [F.when(F.col("is_canonical"), 0).when(~F.col("is_canonical"), 1).otherwise(2).alias("canonical"), F.col("page").isNull().alias("no_page"), "page", F.col("product_id").isNull().alias("no_id"), "product_id"]
    p = products.select(F.lower(F.trim("code")).alias("p_code"), F.lower(F.trim("maker")).alias("p_maker"), F.lower(F.trim("model")).alias("p_model"), F.struct(*order).alias("hit"))
    r = requests.select("request_id", F.lower(F.trim("code")).alias("code"), F.lower(F.trim("maker")).alias("maker"), F.lower(F.trim("model")).alias("model"))
    least = F.min("hit").alias("hit")
    of_code, of_both = p.where("p_code <> ''").groupBy("p_code").agg(least), p.where("p_model <> ''").groupBy("p_model", "p_maker").agg(least)
    of_model = of_both.groupBy("p_model").agg(least)
    kept = ["request_id", "step", "hit"]
    by_code = r.where("code <> ''").join(of_code, F.col("code") == F.col("p_code")).withColumn("step", F.lit(1)).select(*kept)
    by_both = r.where("model <> '' and maker <> ''").join(of_both, (F.col("model") == F.col("p_model")) & (F.col("maker") == F.col("p_maker"))).withColumn("step", F.lit(2)).select(*kept)
    by_model = r.where("model <> '' and coalesce(maker, '') = ''").join(of_model, F.col("model") == F.col("p_model")).withColumn("step", F.lit(3)).select(*kept)
    hits = by_code.unionByName(by_both).unionByName(by_model)
    return best_by_priority(hits, "request_id", "step", ["hit"]).select("request_id", "hit.product_id", "step")


def scored_models(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """Scores above 0 of ``request_id, query`` against ``candidate_id, model``, for pairs sharing a token.

    Tokens are the blocking key: a model that only contains the query, or lies within it, is not met here but in
    ``registry_matches``, which knows other names of a product too.
    """
    r = requests.select("request_id", "query", F.explode(tokens(F.col("query"))).alias("token"))
    c = candidates.select("candidate_id", "model", F.explode(tokens(F.col("model"))).alias("token"))
    met = r.join(c, "token").select("request_id", "query", "candidate_id", "model").distinct()
    return met.withColumn("score", model_score(F.col("query"), F.col("model"))).where("score > 0")


def registry_matches(requests: DataFrame, products: DataFrame, most: int = 50_000) -> DataFrame:
    """Best scores above 0 of ``request_id, query`` against ``candidate_id, model, model_aliases``, of all a product's names.

    Names that share a token meet by it. Those that contain the query or lie
    within it meet each distinct query: the registry is fixed, of at most
    ``most`` names (else an error), so this grows with the queries alone.
    """
    names = products.select("candidate_id", F.explode(F.concat(F.array("model"), F.coalesce("model_aliases", F.array().cast("array<string>")))).alias("name"))
    names = names.select("candidate_id", registry_model_key(F.col("name")).alias("name")).where("name <> ''").distinct()
    if names.limit(most + 1).count() > most:
        raise ValueError(f"the registry has over {most} names")
    typed = requests.select("request_id", registry_model_key(F.col("query")).alias("key")).where("key <> ''")
    cores = requests.sparkSession.sparkContext.defaultParallelism
    keys, known = typed.select("key").distinct().repartition(cores), F.broadcast(names.select("name").distinct())
    within = keys.join(known, F.contains("name", "key") | F.contains("key", "name"))
    shared = keys.withColumn("token", F.explode(tokens(F.col("key")))).join(F.broadcast(names.select("name", F.explode(tokens(F.col("name"))).alias("token"))), "token").select("key", "name")
    met = within.unionByName(shared).distinct().withColumn("score", model_score(F.col("key"), F.col("name")))
    best = met.join(F.broadcast(names), "name").groupBy("key", "candidate_id").agg(F.max("score").alias("score"))
    return typed.join(spread(best), "key").select("request_id", "candidate_id", "score")


def registry_picks(requests: DataFrame, products: DataFrame, order: str, most: int = 50_000) -> DataFrame:
    """``request_id, candidate_id, score``: for each request with ``maker, query`` the one product of greatest score.

    The maker gives 5 if equal and 2.5 if one name holds the other, the model
    its ``registry_matches`` score, or 0 for a blank one; of equal scores the
    first product in ``order``. A request to which nothing speaks has no row.
    """
    plain = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    models = registry_matches(requests.where("trim(query) <> ''"), products, most)
    makers = products.select("candidate_id", plain("maker").alias("known")).where("known <> ''").distinct()
    typed = requests.select("request_id", plain("maker").alias("typed")).where("typed <> ''")
    # a list of checked size meets each distinct spelling once
    alike = typed.select("typed").distinct().join(F.broadcast(makers.select("known").distinct()), F.contains("typed", "known") | F.contains("known", "typed"))
    alike = alike.withColumn("score", F.when(F.col("typed") == F.col("known"), 5.0).otherwise(2.5)).join(F.broadcast(makers), "known").select("typed", "candidate_id", "score")
    of_maker = typed.join(spread(alike), "typed").select("request_id", "candidate_id", "score")
    summed = models.unionByName(of_maker).groupBy("request_id", "candidate_id").agg(F.round(F.sum("score"), 9).alias("score"))
    ranked = summed.join(F.broadcast(products.select("candidate_id", F.col(order).alias("__order"))), "candidate_id")
    best = ranked.groupBy("request_id").agg(F.min(F.struct(-F.col("score"), F.col("__order"), F.col("candidate_id").alias("candidate_id"), F.col("score").alias("score"))).alias("b"))
    return best.select("request_id", "b.candidate_id", "b.score")


def nearest_within(left: DataFrame, right: DataFrame, block: str, value: str, target: str, tolerance: float, key: str, tie: str) -> DataFrame:
    """For each left row the right row of its block whose value is nearest, at most a tolerance away; ties by ``tie``.

    Distinct values meet, not rows: the first right row by ``tie`` stands for
    all of its value. The blocks are cut into cells two tolerances wide; there
    each left value meets those next below and above it of its own and the two
    neighbouring cells, found by sorting. So the work grows with the rows,
    however many share a block, a cell or a value.
    """
    cell = lambda c: F.rint(F.col(c) / (2 * tolerance))
    others = [c for c in right.columns if c not in (block, target, tie)]
    first = F.min(F.struct(F.col(tie).isNull().alias("last"), tie, *others)).alias("first")
    known = right.where(F.col(block).isNotNull() & (F.abs(target) < float("inf"))).groupBy(block, target).agg(first)
    known = known.withColumn("__cell", F.explode(F.array_distinct(F.array(cell(target) - 1, cell(target), cell(target) + 1))))
    by = W.partitionBy(block, "__cell")
    # values so close that their distances may round to the same stay together
    upward = by.orderBy(target).rowsBetween(W.unboundedPreceding, 0)
    known = known.withColumn("__gap", F.col(target) - F.lag(target).over(by.orderBy(target))).withColumn("__run", F.count_if(F.col("__gap") > math.ulp(tolerance)).over(upward))
    runs = known.groupBy(block, "__cell", "__run").agg(F.min(target).alias("__low"), F.max(target).alias("__high"), F.collect_list(F.struct(target, "first")).alias("__at")).drop("__run")
    values = left.select(block, value).distinct().withColumns({"__cell": cell(value), "__low": F.col(value), "__high": F.col(value)})
    all_values = runs.unionByName(values, allowMissingColumns=True)
    # a frame of what follows would be evaluated anew for each row, so the second order is reversed
    below = by.orderBy("__low", F.col("__at").isNull()).rowsBetween(W.unboundedPreceding, 0)
    above = by.orderBy(F.desc("__high"), F.col("__at").isNull()).rowsBetween(W.unboundedPreceding, 0)
    beside = all_values.withColumn("__below", F.last("__at", ignorenulls=True).over(below)).withColumn("__above", F.last("__at", ignorenulls=True).over(above)).where("__at is null")
    options = F.transform(F.flatten(F.array_compact(F.array("__below", "__above"))), lambda r: F.struct(F.abs(F.col(value) - r[target]).alias("distance"), r["first"].alias("first"), r[target].alias(target)))
    nearest = beside.select(block, value, F.array_min(options).alias("__r")).where(F.col("__r.distance") <= tolerance)
    nearest = nearest.select(block, value, *[F.col(f"__r.first.{c}") for c in (tie, *others)], f"__r.{target}", "__r.distance")
    w = W.partitionBy(key).orderBy("distance", F.col(tie).asc_nulls_last())
    return left.join(spread(nearest), [block, value]).withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def band(value: Column, bounds: list[tuple[float, str]], beyond: str) -> Column:
    """The name of the first upper bound that a value does not exceed."""
    out = None
    for top, name in bounds:
        out = F.when(value <= top, name) if out is None else out.when(value <= top, name)
    return F.lit(beyond) if out is None else out.otherwise(F.lit(beyond))


def longest_prefix(rows: DataFrame, text: str, key: str, prefixes: DataFrame) -> DataFrame:
    """Each row's longest prefix in ``prefix, meaning``. Rows are joined by their own leading parts, not by trying all."""
    lead = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text))), lambda n: F.substr(F.col(text), F.lit(1), n))
    met = rows.where(F.length(text) > 0).select(key, F.explode(lead).alias("prefix")).join(prefixes, "prefix")
    best = met.withColumn("__k", F.row_number().over(W.partitionBy(key).orderBy(F.desc(F.length("prefix")), "meaning"))).where("__k = 1")
    return best.select(key, "prefix", "meaning")


def by_alias(rows: DataFrame, text: str, aliases: DataFrame, name: str = "usual_name") -> DataFrame:
    """The usual name of a text by ``alias, usual``: as it stands, then without punctuation, else the trimmed text."""
    bare = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    exact = aliases.select(F.lower(F.trim("alias")).alias("__a"), F.col("usual").alias("__u")).dropDuplicates(["__a"])
    loose = aliases.select(bare(F.col("alias")).alias("__b"), F.col("usual").alias("__v")).groupBy("__b").agg(F.min("__v").alias("__v"))
    out = rows.withColumn("__x", F.lower(F.trim(text))).join(exact, F.col("__x") == F.col("__a"), "left")
    out = out.withColumn("__y", bare(F.col(text))).join(loose, F.col("__y") == F.col("__b"), "left")
    return out.withColumn(name, F.coalesce("__u", "__v", F.trim(text))).drop("__x", "__a", "__u", "__y", "__b", "__v")


def nearest_of(value: Column, typical: list[int], within: float) -> Column:
    """The typical value nearest to a value, the lower of two, if it is within a distance; else the value."""
    options = F.array(*[F.struct(F.abs(value - t).alias("d"), F.lit(t).alias("v")) for t in typical])
    best = F.array_min(options)
    return F.when(best["d"] <= within, best["v"].cast("double")).otherwise(value)
