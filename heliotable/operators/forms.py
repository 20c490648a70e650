"""Filled-in forms: values beside labels in sheets, merging of readings into records, and keyword classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heliotable.functions.text import after_label

UNCONFIRMED = "未確認"


def values_beside_labels(cells: DataFrame, labels: list[str], key: str = "file", reach: int = 4) -> DataFrame:
    """``key, label, value``: for each label the rest of its cell, else the next cell of its row that is not blank.

    ``cells`` are ``key, row, col, value``. At most ``reach`` cells to the right
    count; the first place of a label in reading order holds; labels without a
    value have no row.
    """
    c = F.col
    row = W.partitionBy(key, "row").orderBy("col")
    # gaps between written cells are real columns: distance is by column, not by rank
    ahead = [F.struct(F.lead("col", k).over(row).alias("col"), F.lead("value", k).over(row).alias("value")) for k in range(1, reach + 1)]
    near = cells.where(F.trim("value") != "").withColumn("ahead", F.array(*ahead))
    near = near.withColumn("ahead", F.filter("ahead", lambda x: x["col"].isNotNull() & (x["col"] - c("col") <= reach)))
    each = F.array(*[F.struct(F.lit(x).alias("label"), after_label(c("value"), x).alias("rest")) for x in labels])
    hits = near.withColumn("hit", F.explode(F.filter(each, lambda h: F.startswith(F.trim(c("value")), h["label"]))))
    own = F.when(c("hit.rest") != "", c("hit.rest")).otherwise(F.when(F.size("ahead") > 0, c("ahead")[0]["value"]))
    found = hits.select(key, "row", "col", c("hit.label").alias("label"), F.trim(own).alias("value")).where("value <> ''")
    first = W.partitionBy(key, "label").orderBy("row", "col")
    return found.withColumn("k", F.row_number().over(first)).where("k = 1").select(key, "label", "value")


def filled_in(base: Column, extra: Column, never: list[str] | None = None, blank: str = UNCONFIRMED) -> Column:
    """Two maps of texts: the second's values go only where the first's are unconfirmed, and never to some keys."""
    kept = F.map_filter(extra, lambda k, v: v.isNotNull() & (F.trim(v) != "") & (v != blank) & ~k.isin(never or [""]))
    merged = F.map_zip_with(base, kept, lambda _, a, b: F.when(a.isNull() | (a == blank), F.coalesce(b, a)).otherwise(a))
    return F.map_filter(merged, lambda k, v: F.map_contains_key(base, k))


def unconfirmed(values: Column, blank: str = UNCONFIRMED) -> Column:
    return F.array_sort(F.map_keys(F.map_filter(values, lambda _, v: v.isNull() | (v == blank))))


def keyword_class(text: Column, keywords: list[tuple[str, str]], other: str) -> Column:
    """The class of the first keyword that a text holds."""
    out = F.lit(other)
    for word, name in reversed(keywords):
        out = F.when(F.contains(text, F.lit(word)), F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit(other))


def supplied(text: Column, components: list[str], negations: list[str]) -> Column:
    """Whether a free text says that a component is supplied: by segments, and a negation in one of them holds."""
    segments = F.filter(F.split(text, "[、。,/／\n]"), lambda s: F.trim(s) != "")
    about = F.filter(segments, lambda s: s.rlike("|".join(components)))
    denied = F.exists(about, lambda s: s.rlike("|".join(negations)))
    return F.coalesce((F.size(about) > 0) & ~denied, F.lit(False))


def single_or(values: DataFrame, group: str, value: str, otherwise: str) -> DataFrame:
    """A group's only distinct value, or another text where it has several; nulls do not count."""
    agg = values.groupBy(group).agg(F.min(value).alias("__a"), F.max(value).alias("__b"))
    return agg.select(group, F.when(F.col("__a") == F.col("__b"), F.col("__a")).otherwise(F.lit(otherwise)).alias("common"))


def linked_fields(warnings: DataFrame, key: str, text: str, fields: list[tuple[str, str]]) -> DataFrame:
    """The first field, in order, whose label a warning holds; null where none does."""
    out = F.lit(None).cast("string")
    for path, label in reversed(fields):
        out = F.when(F.contains(F.col(text), F.lit(label)), F.lit(path)).otherwise(out)
    return warnings.withColumn("field", out)


def paired_by_name_then_order(left: DataFrame, right: DataFrame, group: str, name: str, order: str, id: str) -> DataFrame:
    """The k-th of a name with the k-th of it; what is left is paired in order; what is over is dropped."""
    from heliotable.operators.line_diff import residue, zip_pairs

    named = zip_pairs(left, right, [group, name], order, [id]).select(f"left_{id}", f"right_{id}")
    rest = zip_pairs(residue(left, named, id, "left"), residue(right, named, id, "right"), [group], order, [id]).select(f"left_{id}", f"right_{id}")
    return named.unionByName(rest)


def with_value(values: Column, path: str, value: Column) -> Column:
    """A path-to-value map with one path set."""
    return F.map_concat(F.map_filter(values, lambda k, _: k != path), F.create_map(F.lit(path), value))
