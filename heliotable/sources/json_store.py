"""Documents kept as JSON: products, rules, histories and keyed values.

Folders of JSON files are read permissively: a file that cannot be read gives
no row. Writes are Spark appends and whole-table replacements, which the output
committer makes atomic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from heliotable.plans.durable import cut


def documents(spark: SparkSession, path: str) -> DataFrame:
    """``file, doc``: each JSON file under a path as a variant; damaged files are left out."""
    read = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.try_parse_json(F.regexp_replace("value", "^﻿", "")).alias("doc"))
    return read.where("doc is not null")


def listed(docs: DataFrame, field: str, schema: StructType | str) -> DataFrame:
    """The entries of documents that are a bare list or hold one in a field, with their file and place."""
    text = F.to_json("doc")
    kind = schema if isinstance(schema, str) else schema.simpleString()
    bare = F.from_json(text, f"array<{kind}>")
    held = F.from_json(text, f"struct<`{field}`:array<{kind}>>")[field]
    entries = F.when(text.startswith("["), bare).otherwise(held)
    return docs.select("file", F.posexplode(entries).alias("pos", "entry")).where("entry is not null").select("file", "pos", "entry.*")


def newest(rows: DataFrame, by: list[str], limit: int) -> DataFrame:
    """The newest rows first, at most a limit; 0 or below gives none."""
    return rows.orderBy(*[F.desc_nulls_last(c) for c in by]).limit(max(limit, 0))


def point(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.where(F.col(key) == value)


def merged(old: DataFrame, new: DataFrame, key: str, updated: str) -> DataFrame:
    """A keyed store after an upsert: for each key the value updated last, new over old where equal."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = W.partitionBy(key).orderBy(F.desc_nulls_last(updated), F.desc("__new"))
    return both.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__new", "__k")


def read_by_path(docs: DataFrame, column: str, path: str, kind: str = "string") -> DataFrame:
    """A value at a dotted path, with a flag that tells a missing path from a null."""
    json_path = "$." + path
    parent, _, leaf = path.rpartition(".")
    holder = F.try_variant_get(F.col(column), f"$.{parent}" if parent else "$", "variant")
    keys = F.json_object_keys(F.to_json(holder))
    return docs.withColumn("value", F.try_variant_get(F.col(column), json_path, kind)).withColumn("is_present", F.coalesce(F.array_contains(keys, leaf), F.lit(False)))


def leaf_paths(docs: DataFrame, key: str | list[str], column: str) -> DataFrame:
    """``key, path, value`` of all leaves of JSON objects, however deep; lists and empty objects are leaves.

    One round for each level of the deepest document, until no object is left.
    """
    keys = [key] if isinstance(key, str) else key
    level = docs.select(*keys, F.lit("").alias("path"), F.to_json(column).alias("value"))
    leaves = None
    while True:
        pairs = F.from_json("value", "map<string,string>")
        inner = level.select(*keys, "path", F.explode(F.map_entries(pairs)).alias("e")).select(*keys, F.concat(F.when(F.col("path") == "", "").otherwise(F.concat("path", F.lit("."))), "e.key").alias("path"), F.col("e.value").alias("value"))
        is_object = F.coalesce(F.col("value").startswith("{") & (F.size(F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))) > 0), F.lit(False))
        marked = cut(inner.withColumn("is_object", is_object))
        done = marked.where("not is_object").drop("is_object")
        leaves = done if leaves is None else leaves.unionByName(done)
        level = marked.where("is_object").drop("is_object")
        if level.isEmpty():
            return leaves
