"""Survey records corrected field by field, with what changed and how sure it is, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliotable.functions import parsing
from heliotable.operators.catalog import nearest_of

# Usual wattages of modules.
TYPICAL_WATTS = [400, 410, 430, 440, 450, 460, 480, 500, 540, 550, 580, 600, 620, 660, 670, 680, 700, 720]


def corrections(surveys: DataFrame, key: str = "survey_id") -> DataFrame:
    """``key, field, old_value, new_value, confidence`` for every field whose corrected value differs.

    Postal codes and dates get their usual form; a missing postal code is taken
    from the address; wattages within 10 W of a usual one are set to it; a
    capacity that is missing, or over 5 % off panels times watts, is computed.
    Values that cannot be read are left out, as are blanks without a source.
    """
    p, e = F.col("project"), F.col("equipment")
    postal = F.coalesce(F.nullif(parsing.postal_code(p["postal_code"]), F.lit("")), F.nullif(parsing.postal_in_address(p["address"]), F.lit("")))
    watts = nearest_of(e["module_output_w"], TYPICAL_WATTS, 10)
    kw = F.round(e["module_output_w"] * e["planned_panels"] / 1000.0, 2)
    given = F.coalesce(e["pv_capacity_kw"], F.lit(0.0))
    off = (kw > 0) & (given > 0) & (F.abs(given - kw) > 0.05 * kw)

    def change(field: str, old: Column, new: Column, confidence: str, when: Column) -> Column:
        row = F.struct(F.lit(field).alias("field"), old.cast("string").alias("old_value"), new.cast("string").alias("new_value"), F.lit(confidence).alias("confidence"))
        return F.when(when & new.isNotNull() & ~old.eqNullSafe(new), row)

    always = F.lit(True)
    found = [
        change("postal_code", p["postal_code"], postal, "high", always),
        change("survey_date", p["survey_date"], parsing.date_text(p["survey_date"]), "high", F.trim(p["survey_date"]) != ""),
        change("module_output_w", e["module_output_w"], watts, "medium", e["module_output_w"] > 0),
        change("pv_capacity_kw", e["pv_capacity_kw"], kw, "medium", (kw > 0) & (given <= 0)),
        change("pv_capacity_kw", e["pv_capacity_kw"], kw, "low", off),
    ]
    return surveys.select(key, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("c")).select(key, "c.*")
