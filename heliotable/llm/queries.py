"""The queries of this subpackage, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliotable.llm import addresses, bin_packing, canonical_mapping, company_names, entity_matching, reading_level, tokenize_corpus, visual_text
from heliotable.functions import parsing
from heliotable.operators import line_diff
from heliotable.plans.joins import spread
from heliotable.plans.tables import table

# The categories an estimate can have, as typed without signs and as usual; any other is as good as none.
CATEGORIES = {c: c for c in ("支給品", "材料費", "施工費", "その他諸経費等", "付帯工事", "特記事項", "共通仮設工事", "太陽光発電システム機器", "電材", "設置工事")} | dict.fromkeys(("その他諸経費", "諸経費", "諸経費等"), "その他諸経費等")


def visual_records(spark: SparkSession, folder: str) -> DataFrame:
    survey = table(spark, folder, "survey")
    lines = table(spark, folder, "estimate_line")
    def typed(name: str, column: str) -> Column:
        return F.struct(F.lit(name).alias("field_name"), F.col("survey_id").alias("record_id"), F.col(column).alias("value"))

    one = survey.select(F.explode(F.array(typed("module_model", "equipment.module_model"), typed("project_name", "project.project_name"))).alias("r")).select("r.*")
    return one.unionByName(lines.select(F.lit("description").alias("field_name"), F.col("line_key").alias("record_id"), F.col("description").alias("value")))


def work_item_paths(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    return canonical_mapping.work_paths(canonical_mapping.reference_rows(table(spark, folder, "rule_item"), ["rule_item_id", "description"]))


def p1_scored(spark: SparkSession, folder: str) -> DataFrame:
    """Matched lines with their marginal match probability."""
    return entity_matching.match_lines(table(spark, folder, "parsed_doc"), table(spark, folder, "parsed_line"), work_item_paths(spark, folder))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_scored(spark, folder).select("line_a", "line_b")


def p1_items(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the two estimates of a project paired in eight passes by category, description, remarks and price."""
    documents, lines = table(spark, folder, "parsed_doc"), table(spark, folder, "parsed_line")
    matched = entity_matching.matched_documents(documents, lines, work_item_paths(spark, folder)).select("ai_doc", "official_doc")
    named = parsing.category_name(F.col("category"), CATEGORIES)
    items = line_diff.items_alone(lines.where("line_id is not null").dropDuplicates(["line_id"]), "description").withColumn("category", F.when(named.isin(*CATEGORIES.values()), named).otherwise(""))
    left = items.where("source = 'ai'").withColumnRenamed("doc_id", "ai_doc").join(spread(matched.select("ai_doc")), "ai_doc")
    right = items.where("source = 'official'").withColumnRenamed("doc_id", "official_doc").join(spread(matched), "official_doc")
    return line_diff.item_pairs(left, right, "ai_doc", "line_id")


def p2_mapped(spark: SparkSession, folder: str) -> DataFrame:
    """Every typed value with its entry and the edits between them."""
    modules = canonical_mapping.reference_rows(table(spark, folder, "registry_product").where("product_type = 'module'"), ["id", "model", "model_aliases"])
    works = canonical_mapping.map_records(table(spark, folder, "parsed_line").select(F.col("line_id").cast("string").alias("record_id"), F.col("description").alias("value")), work_item_paths(spark, folder))
    models = canonical_mapping.map_records(table(spark, folder, "survey").select(F.col("survey_id").alias("record_id"), F.col("equipment.module_model").alias("value")), canonical_mapping.module_paths(modules), models=True)
    return works.withColumn("field_name", F.lit("description")).unionByName(models.withColumn("field_name", F.lit("module_model")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_mapped(spark, folder).select("field_name", "record_id", "canonical_id")


def p3_places(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every survey whose address states one."""
    columns = [F.col("survey_id").alias("record_id"), F.col("project.address").alias("address"), F.col("project.postal_code").alias("postal_code")]
    records = table(spark, folder, "survey").select(*columns).unionByName(table(spark, folder, "residential_survey").select(*columns))
    return addresses.places_of(records)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return addresses.same_place_pairs(p3_places(spark, folder))


def p4_companies(spark: SparkSession, folder: str) -> DataFrame:
    """Every spelling of a maker with the company it means."""
    survey, home = table(spark, folder, "survey"), table(spark, folder, "residential_survey")
    beside = F.struct(F.col("equipment.pcs_maker").alias("name"), F.col("equipment.pcs_model").alias("model")), F.struct(F.col("battery.battery_maker").alias("name"), F.col("battery.battery_model").alias("model"))
    names = survey.select(F.col("equipment.module_maker").alias("name"), F.col("equipment.module_model").alias("model")).unionByName(home.select(F.explode(F.array(*beside)).alias("x")).select("x.*"))
    return company_names.company_of(names, table(spark, folder, "registry_product"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return company_names.same_company_pairs(p4_companies(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return visual_text.inconsistent_records(visual_records(spark, folder)).select("field_name", "record_id")


def p5_forms(spark: SparkSession, folder: str) -> DataFrame:
    return visual_text.visual_forms(visual_records(spark, folder).select("value"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenize_corpus.encode_corpus(table(spark, folder, "documents"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return bin_packing.containers(bin_packing.pack_documents(table(spark, folder, "documents")))


def p8_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every container's texts themselves, longer ones cut into pieces."""
    return bin_packing.packed_texts(table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return reading_level.reading_levels(table(spark, folder, "documents"), table(spark, folder, "level_sample"))


def p9_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return reading_level.coverage(table(spark, folder, "documents"))


def p9_profile(spark: SparkSession, folder: str) -> DataFrame:
    return reading_level.profile(table(spark, folder, "documents"), p9_found(spark, folder), ["source"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [p1_found, p1_scored, p1_items, p2_found, p2_mapped, p3_found, p3_places, p4_found, p4_companies, p5_found, p5_forms, p7_ids, p8_containers, p8_texts, p9_found, p9_coverage, p9_profile]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {}
