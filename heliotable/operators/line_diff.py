"""What people changed: pairing two versions of lines and naming the differences."""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heliotable.functions.text import description_key
from heliotable.plans.durable import cut
from heliotable.plans.joins import spread

# Lines that sum others up or discount them are never compared.
_NO_ITEMS = "値引|小計|合計|消費税|総計"


def zip_pairs(left: DataFrame, right: DataFrame, keys: list[str], order: str, kept: list[str]) -> DataFrame:
    """The k-th left row of a key with the k-th right row of it, as ``left_*, right_*``.

    For an equality key this is what matching greedily in order gives, but as
    one equi-join. Null keys equal each other.
    """
    def numbered(df: DataFrame, side: str) -> DataFrame:
        w = W.partitionBy(*keys).orderBy(order)
        n = df.withColumn("__rn", F.row_number().over(w))
        return n.select(*[F.col(k).alias(f"{side}_{k}") for k in keys], F.col("__rn").alias(f"{side}_rn"), *[F.col(c).alias(f"{side}_{c}") for c in kept if c not in keys])

    a, b = numbered(left, "left"), numbered(right, "right")
    on = F.col("left_rn") == F.col("right_rn")
    for k in keys:
        on = on & F.col(f"left_{k}").eqNullSafe(F.col(f"right_{k}"))
    return a.join(b, on).drop("left_rn", "right_rn")


def residue(rows: DataFrame, pairs: DataFrame, key: str, side: str) -> DataFrame:
    """Rows that no pair holds."""
    return rows.join(pairs.select(F.col(f"{side}_{key}").alias(key)), key, "left_anti")


def exact_passes(left: DataFrame, right: DataFrame, id: str, group: str, passes: list[list[str]], order: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Passes of ever looser keys, each over what the ones before left: (pairs with their pass, left rest, right rest)."""
    found = None
    for k, keys in enumerate(passes, 1):
        hits = zip_pairs(left, right, [group, *keys], order, [id]).select(F.col(f"left_{id}"), F.col(f"right_{id}"), F.lit(k).alias("pass"))
        found = hits if found is None else found.unionByName(hits)
        left, right = residue(left, hits, id, "left"), residue(right, hits, id, "right")
    return found, left, right


def fuzzy_pairs(left: DataFrame, right: DataFrame, group: list[str], id: str, text: str, least: float = 0.6) -> DataFrame:
    """Of what exact passes left, pairs within a group by matching ratio, the surest first, each row once.

    The order of a greedy choice is global within an estimate, so each group,
    one estimate's category, is one pandas call; such groups are small.
    """
    def pair(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:  # a group on one side only
            return none
        a, b = a.sort_values("pos"), b.sort_values("pos")
        scored = []
        for i, x in enumerate(a[text].fillna("")):
            for j, y in enumerate(b[text].fillna("")):
                matcher = SequenceMatcher(None, x, y)
                if x and y and matcher.real_quick_ratio() >= least and matcher.quick_ratio() >= least and (r := matcher.ratio()) >= least:
                    scored.append((-r, i, j))
        rows, used_a, used_b = [], set(), set()
        for r, i, j in sorted(scored):
            if i not in used_a and j not in used_b:
                used_a.add(i)
                used_b.add(j)
                rows.append((a[id].iloc[i], b[id].iloc[j], -r))
        return pd.DataFrame(rows, columns=["left_id", "right_id", "score"]) if rows else none

    kind = dict(left.dtypes)[id]
    none = pd.DataFrame({"left_id": pd.Series([], dtype=object), "right_id": pd.Series([], dtype=object), "score": pd.Series([], dtype=float)})
    # named anew, so that two parts of one table are told apart
    columns = [F.col(c).alias(c) for c in dict.fromkeys([*group, id, text, "pos"])]
    return left.select(*columns).groupBy(*group).cogroup(right.select(*columns).groupBy(*group)).applyInPandas(pair, f"left_id {kind}, right_id {kind}, score double")


def items_alone(lines: DataFrame, text: str) -> DataFrame:
    """Lines that state an item: without those of no letter or digit, sums and discounts."""
    return lines.where(description_key(F.col(text)) != "").where(~F.col(text).rlike(_NO_ITEMS))


def _plain(text: str | None) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", text or "").lower() if c.isalnum())


def matched_items(a: list[tuple], b: list[tuple], least: float = 0.6) -> list[tuple[int, int, float, int]]:
    """``(i, j, score, pass)`` of two lists of ``category, description, remarks, unit price``, each item once.

    Passes 1 to 4 within a category: description and remarks, description and
    price, description, then by matching ratio, the surest first. Passes 5 to 8
    the same where either category is blank. Descriptions and remarks are
    compared by their letters and digits; two missing prices are equal.
    """
    texts_a, texts_b = [_plain(x[1]) for x in a], [_plain(x[1]) for x in b]
    signs_a, signs_b = [_plain(x[2]) for x in a], [_plain(x[2]) for x in b]
    of_a, of_b = [x[0] or "" for x in a], [x[0] or "" for x in b]
    left_a, left_b, found = dict.fromkeys(range(len(a))), dict.fromkeys(range(len(b))), []

    def take(i: int, j: int, score: float, number: int) -> None:
        found.append((i, j, score, number))
        del left_a[i], left_b[j]

    for first, meet in ((1, lambda i, j: of_a[i] == of_b[j]), (5, lambda i, j: not of_a[i] or not of_b[j])):
        exact = (
            (lambda i: (texts_a[i], signs_a[i]), lambda j: (texts_b[j], signs_b[j])),
            (lambda i: (texts_a[i], a[i][3]), lambda j: (texts_b[j], b[j][3])),
            (lambda i: texts_a[i], lambda j: texts_b[j]),
        )
        for k, (key_a, key_b) in enumerate(exact):
            at = defaultdict(list)
            for j in left_b:
                at[key_b(j)].append(j)
            for i in list(left_a):
                j = next((j for j in at.get(key_a(i), ()) if j in left_b and meet(i, j)), None)
                if j is not None:
                    take(i, j, 1.0, first + k)
        scored = []
        for j in left_b:
            matcher = SequenceMatcher(None, "", texts_b[j])
            for i in left_a:
                if meet(i, j):
                    matcher.set_seq1(texts_a[i])
                    if matcher.real_quick_ratio() >= least and matcher.quick_ratio() >= least and (r := matcher.ratio()) >= least:
                        scored.append((-r, i, j))
        for r, i, j in sorted(scored):
            if i in left_a and j in left_b:
                take(i, j, -r, first + 3)
    return found


def item_pairs(left: DataFrame, right: DataFrame, estimate: str, id: str) -> DataFrame:
    """``left_id, right_id, score, pass`` of ``matched_items`` in each estimate, whose lines stand by ``pos``.

    A blank category meets every other, which is no equality, and ratios are
    ordered within the estimate; so each estimate is one pandas call.
    """
    columns = ["category", "description", "remarks", "unit_price"]

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:  # an estimate on one side only
            return none
        a, b = a.sort_values(["pos", id]), b.sort_values(["pos", id])
        sides = [list(zip(*[[None if v is None or v != v else v for v in x[c].tolist()] for c in columns])) for x in (a, b)]
        ids_a, ids_b = a[id].tolist(), b[id].tolist()
        rows = [(ids_a[i], ids_b[j], score, number) for i, j, score, number in matched_items(*sides)]
        return pd.DataFrame(rows, columns=list(none.columns)) if rows else none

    kind = dict(left.dtypes)[id]
    none = pd.DataFrame({"left_id": pd.Series([], dtype=object), "right_id": pd.Series([], dtype=object), "score": pd.Series([], dtype=float), "pass": pd.Series([], dtype=int)})
    # named anew, so that two parts of one table are told apart
    left, right = (df.select(*[F.col(c).alias(c) for c in (estimate, id, "pos", *columns)]) for df in (left, right))
    return left.groupBy(estimate).cogroup(right.groupBy(estimate)).applyInPandas(pair, f"left_id {kind}, right_id {kind}, score double, pass int")


# Categories whose list of items stays as it is, and the one of remarks; the price of supplied goods and of equipment is never learned.
FIXED_LISTS = ("支給品", "材料費", "共通仮設工事", "太陽光発電システム機器", "電材", "設置工事")
REMARKS_ONLY, SUPPLIED, EQUIPMENT = "特記事項", "支給品", "太陽光発電システム機器"
OPEN_LISTS = ("施工費", "その他・諸経費等", "付帯工事")


def estimate_diff(left: DataFrame, right: DataFrame, estimate: str, id: str) -> DataFrame:
    """What people changed in estimates: one row for each price or quantity changed, item added and item removed.

    ``left`` are the computed lines and ``right`` the corrected ones, each with
    ``estimate, id, pos, category, description, remarks, quantity_value,
    quantity_unit, unit_price, amount``; lines are paired by ``item_pairs``.
    Columns: ``estimate, diff_type, left_id, right_id, score, category,
    description, old_value, new_value, learnable, rule_kind, match_description,
    match_remarks``. A price in another unit is converted by the amount. A
    difference is learnable where a rule could hold for it alone: not where the
    item stands several times, the list is fixed, or the price is unknown; of
    equal rules proposed in an estimate the first holds. Values are texts; rows
    without a rule have null ``rule_kind``. Nulls are missing values.
    """
    texts = ["category", "description", "remarks"]
    numbers = ["quantity_value", "quantity_unit", "unit_price", "amount"]

    def keyed(df: DataFrame) -> DataFrame:
        own = df.select(estimate, F.col(id).alias("id"), "pos", *[F.coalesce(c, F.lit("")).alias(c) for c in texts], *numbers)
        return own.withColumn("d", description_key(F.col("description"))).withColumn("r", description_key(F.col("remarks")))

    a, b = items_alone(keyed(left), "description"), items_alone(keyed(right), "description")
    a, b = cut(a), cut(b)
    pairs = cut(item_pairs(a, b, estimate, "id"))

    def counts(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        return df.groupBy(estimate, *keys).agg(F.count("*").alias(name))

    def side(df: DataFrame, prefix: str, other: DataFrame) -> DataFrame:
        out = df.join(spread(counts(df, ["category", "d"], "n_d")), [estimate, "category", "d"]).join(spread(counts(df, ["category", "d", "r"], "n_r")), [estimate, "category", "d", "r"])
        out = out.join(spread(counts(other, ["category", "d"], "n_other")), [estimate, "category", "d"], "left")
        return out.select(estimate, *[F.col(c).alias(f"{prefix}_{c}") for c in ("id", "pos", *texts, *numbers, "d", "r", "n_d", "n_r", "n_other")])

    x, y = side(a, "a", b), side(b, "b", a)
    c = F.col
    both = pairs.join(spread(x), c("left_id") == c("a_id")).join(spread(y.drop(estimate)), c("right_id") == c("b_id"))
    both = both.withColumn("category", F.coalesce(F.nullif("b_category", F.lit("")), "a_category"))
    unit_a, unit_b = (F.trim(F.coalesce(f"{p}_quantity_unit", F.lit(""))) for p in "ab")
    other_unit = (unit_a != "") & (unit_b != "") & (unit_a != unit_b)
    converted = F.when((c("b_amount") > 0) & (c("a_quantity_value") > 0), F.bround(c("b_amount") / c("a_quantity_value"), 0).cast("bigint"))
    price = F.when(other_unit, converted).otherwise(c("b_unit_price"))
    changed = (c("category") != SUPPLIED) & (c("a_unit_price") != F.coalesce(price, F.when(other_unit, c("b_unit_price"))))
    # several lines of one name: only a pair whose remarks agree and that is alone with them can be told apart
    alone = ((c("a_n_d") == 1) & (c("b_n_d") == 1)) | ((c("a_r") == c("b_r")) & (c("a_n_r") == 1) & (c("b_n_r") == 1))
    may = alone & price.isNotNull() & (c("category") != EQUIPMENT)
    common = [estimate, "left_id", "right_id", "score", "category", c("a_description").alias("description"), c("a_d").alias("match_description"), c("a_r").alias("match_remarks"), F.struct(F.lit(0), c("pass"), c("a_pos"), c("left_id").cast("string")).alias("at")]
    prices = both.where(changed).select(*common, F.lit("price_changed").alias("diff_type"), c("a_unit_price").cast("string").alias("old_value"), F.coalesce(price, c("b_unit_price")).cast("string").alias("new_value"), F.when(may, "unit_price_override").alias("rule_kind"))
    quantities = both.where(F.abs(c("a_quantity_value") - c("b_quantity_value")) > 1e-6).select(*common, F.lit("quantity_changed").alias("diff_type"), c("a_quantity_value").cast("string").alias("old_value"), c("b_quantity_value").cast("string").alias("new_value"), F.lit(None).cast("string").alias("rule_kind"))

    def alone_rows(df: DataFrame, prefix: str, own: str, n: int, diff_type: str, value: Column, rule: Column) -> DataFrame:
        ids = [c(f"{prefix}_id").alias(k) if k == own else F.lit(None).cast(dict(df.dtypes)[f"{prefix}_id"]).alias(k) for k in ("left_id", "right_id")]
        old, new = (value, F.lit(None).cast("string")) if own == "left_id" else (F.lit(None).cast("string"), value)
        at = F.struct(F.lit(n), F.lit(0).alias("pass"), c(f"{prefix}_pos"), c(f"{prefix}_id").cast("string"))
        rest = df.join(spread(pairs.select(c(own).alias(f"{prefix}_id"))), f"{prefix}_id", "left_anti")
        return rest.select(estimate, *ids, F.lit(None).cast("double").alias("score"), c(f"{prefix}_category").alias("category"), c(f"{prefix}_description").alias("description"), c(f"{prefix}_d").alias("match_description"), c(f"{prefix}_r").alias("match_remarks"), at.alias("at"), F.lit(diff_type).alias("diff_type"), old.alias("old_value"), new.alias("new_value"), rule.alias("rule_kind"))

    given = F.coalesce(c("b_unit_price"), F.when(c("b_amount") != 0, F.when(c("b_quantity_value") > 0, F.bround(c("b_amount") / c("b_quantity_value"), 0).cast("bigint")).otherwise(c("b_amount"))))
    added = alone_rows(y, "b", "right_id", 1, "item_added", given.cast("string"), F.when(c("b_category").isin(*OPEN_LISTS) & given.isNotNull(), "item_add"))
    some = (F.coalesce(c("a_amount"), F.lit(0)) != 0) | (F.coalesce(c("a_unit_price"), F.lit(0)) != 0)
    gone = ~c("a_category").isin(*FIXED_LISTS, REMARKS_ONLY) & some & (c("a_n_d") == 1) & (F.coalesce(c("a_n_other"), F.lit(0)) <= 1)
    removed = alone_rows(x, "a", "left_id", 2, "item_removed", c("a_unit_price").cast("string"), F.when(gone, "item_suppress"))
    names = ["at", estimate, "diff_type", "left_id", "right_id", "score", "category", "description", "old_value", "new_value", "rule_kind", "match_description", "match_remarks"]
    flat = lambda df: df.withColumn("at", F.struct(*[c("at")[k].alias(f"k{i}") for i, k in enumerate(df.schema["at"].dataType.names)])).select(*names)
    every = flat(prices).unionByName(flat(quantities)).unionByName(flat(added)).unionByName(flat(removed))
    first = W.partitionBy(estimate, "rule_kind", "category", "match_description", "match_remarks").orderBy("at")
    return every.withColumn("learnable", c("rule_kind").isNotNull() & (F.row_number().over(first) == 1)).select(*names[1:10], "learnable", *names[10:])


def changes(pairs: DataFrame, compared: list[str]) -> DataFrame:
    """One row for each compared column that differs within a pair; two nulls are equal."""
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"left_{c}").cast("string").alias("old_value"), F.col(f"right_{c}").cast("string").alias("new_value")) for c in compared])
    return pairs.withColumn("__d", F.explode(F.filter(each, lambda d: ~d["old_value"].eqNullSafe(d["new_value"])))).select(*pairs.columns, "__d.*")


def added_and_removed(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, counted: 'removed' where only left has them, 'added' where only right has."""
    a = left.groupBy(*keys).agg(F.count("*").alias("left_n"))
    b = right.groupBy(*keys).agg(F.count("*").alias("right_n"))
    both = a.join(b, keys, "full_outer")
    one = F.when(F.col("right_n").isNull(), "removed").when(F.col("left_n").isNull(), "added")
    return both.withColumn("change", one).where("change is not null").select(*keys, "change", F.coalesce("left_n", "right_n").alias("n_rows"))


def multiplicity(rows: DataFrame, keys: list[str], name: str = "n_same") -> DataFrame:
    return rows.withColumn(name, F.count("*").over(W.partitionBy(*keys)))


def first_proposals(proposals: DataFrame, key: list[str], order: list[str], payload: str) -> DataFrame:
    """The first proposal of a key is taken; later ones are 'repeated' if equal, else in 'conflict'."""
    w = W.partitionBy(*key).orderBy(*order)
    first = F.first(F.col(payload)).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rn = F.row_number().over(w)
    return proposals.withColumn("verdict", F.when(rn == 1, "taken").when(F.col(payload).eqNullSafe(first), "repeated").otherwise("conflict"))


def positional(left: DataFrame, right: DataFrame, group: str, array: str) -> DataFrame:
    """Elements of two arrays side by side by place; the shorter side is null."""
    a = left.select(group, F.posexplode(array).alias("pos", "left_value"))
    b = right.select(group, F.posexplode(array).alias("pos", "right_value"))
    return a.join(b, [group, "pos"], "full_outer")


def differs(a: Column, b: Column, eps: float = 1e-6) -> Column:
    return ~(F.abs(a - b) < eps)
