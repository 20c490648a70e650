"""Estimates as CSV files: reading both layouts into lines and totals, and writing them.

A file is one estimate. Rows are read with their place in the file; a section
title applies to the rows below it, so windows run within one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heliotable.functions.parsing import quantity_unit, quantity_value, whole_number
from heliotable.functions.text import half_width

# Labels of totals rows and the header field each stands for.
TOTALS = {"小計": "subtotal", "値引": "discount", "値引き": "discount", "税抜合計": "total_before_tax", "消費税": "tax", "税込合計": "total_with_tax", "合計": "total_with_tax"}
# Titles of the sections of the detailed layout.
SECTIONS = {"基本情報": "info", "明細": "lines", "合計": "totals", "算出根拠": "reasons"}
SECTION_MARK = "==="
COLUMNS = ("category", "no", "description", "remarks", "quantity", "unit_price", "amount")


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """``file, pos, cells``: every record of CSV files under a path, in file order; BOM and CR are dropped.

    Each file is one record of the source, so quoted line breaks stay whole.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "^﻿|\r", "").alias("text"))
    # a line break within quotes is kept: the text is cut where an even number of quotes came before
    pieces = whole.select("file", F.posexplode(F.split("text", '\n(?=(?:[^"]*"[^"]*")*[^"]*$)')).alias("pos", "line")).where("line <> ''")
    cells = F.split("line", ',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    return pieces.select("file", "pos", F.transform(cells, lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), '^"|"$', ""), '""', '"')).alias("cells"))


def _label(c: Column, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for text, name in names.items():
        out = F.when(c == text, F.lit(name)).otherwise(out)
    return out


def sections(rows: DataFrame) -> DataFrame:
    """Rows with their section: named by the last ``=== title`` above; in files without any, all rows are lines."""
    first = F.col("cells")[0]
    title = F.trim(F.regexp_replace(first, "=", ""))
    named = F.when(first.startswith(SECTION_MARK), F.coalesce(_label(title, SECTIONS), F.lit("other")))
    w = W.partitionBy("file").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumn("__title", named).withColumn("section", F.last("__title", ignorenulls=True).over(w))
    detailed = F.max(F.col("__title").isNotNull()).over(W.partitionBy("file"))
    out = out.withColumn("section", F.when(detailed, F.coalesce("section", F.lit("other"))).otherwise(F.lit("lines")))
    return out.where("__title is null").drop("__title")


def lines(rows: DataFrame) -> DataFrame:
    """``file, pos, category, no, description, ...`` of the line rows; blank descriptions, heads and totals are left out."""
    cell = lambda k: F.trim(F.coalesce(F.try_element_at("cells", F.lit(k + 1)), F.lit("")))
    own = sections(rows).where("section = 'lines'")
    fields = {name: cell(k) for k, name in enumerate(COLUMNS)}
    out = own.select("file", "pos", *[c.alias(n) for n, c in fields.items()])
    is_total = _label(F.col("category"), TOTALS).isNotNull() | _label(F.col("description"), TOTALS).isNotNull()
    is_head = F.col("description").isin("description", "名称", "品名", "項目")
    out = out.where("description <> ''").where(~is_total & ~is_head)
    none = lambda c: F.when(F.trim(c).isin("", "-"), None).otherwise(whole_number(c))
    return out.select(
        "file", "pos", "category", half_width(F.col("no")).try_cast("int").alias("no"), "description", "remarks",
        quantity_value(half_width(F.col("quantity"))).alias("quantity_value"), quantity_unit(half_width(F.col("quantity"))).alias("quantity_unit"),
        none(F.col("unit_price")).alias("unit_price"), none(F.col("amount")).alias("amount"),
    )


def totals(rows: DataFrame) -> DataFrame:
    """One row for each file with its totals by label; a discount is never above 0."""
    own = sections(rows).where("section in ('lines', 'totals')")
    filled = F.filter("cells", lambda c: F.trim(c) != "")
    label = _label(F.trim(filled[0]), TOTALS)
    value = whole_number(F.element_at(filled, -1))
    names = list(dict.fromkeys(TOTALS.values()))
    found = own.where(F.size(filled) >= 2).select("file", label.alias("label"), value.alias("value")).where("label is not null")
    found = found.withColumn("value", F.when(F.col("label") == "discount", -F.abs("value")).otherwise(F.col("value")))
    return found.groupBy("file").agg(*[F.max(F.when(F.col("label") == n, F.col("value"))).alias(n) for n in names])


def _cell(c: Column) -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\n]'), F.concat(F.lit('"'), F.regexp_replace(text, '"', '""'), F.lit('"'))).otherwise(text)


def written(estimate_lines: DataFrame, headers: DataFrame, estimate: str) -> DataFrame:
    """``estimate, text``: each estimate as one CSV text with BOM, CRLF, a head row, its lines and its totals rows."""
    row = F.concat_ws(",", *[_cell(F.col(c)) for c in COLUMNS])
    body = estimate_lines.select(estimate, "pos", row.alias("row")).groupBy(estimate).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "row"))), lambda x: x["row"]), "\r\n").alias("body"))
    names = {v: k for k, v in reversed(TOTALS.items())}
    tail = F.concat_ws("\r\n", *[F.concat(F.lit(f"{names[n]},,,,,,"), F.coalesce(F.col(n).cast("string"), F.lit(""))) for n in ("subtotal", "discount", "total_before_tax", "tax", "total_with_tax")])
    text = F.concat(F.lit("﻿"), F.lit(",".join(COLUMNS)), F.lit("\r\n"), F.coalesce("body", F.lit("")), F.lit("\r\n"), tail, F.lit("\r\n"))
    return headers.join(body, estimate, "left").select(estimate, text.alias("text"))


def written_detailed(estimate_lines: DataFrame, headers: DataFrame, estimate: str, info: list[str]) -> DataFrame:
    """``estimate, text``: the layout in sections: basic facts, lines, totals."""
    titles = {v: k for k, v in SECTIONS.items()}
    title = lambda n: F.lit(f"{SECTION_MARK} {titles[n]} {SECTION_MARK}")
    facts = F.concat_ws("\r\n", *[F.concat(F.lit(f"{c},"), _cell(F.col(c))) for c in info])
    simple = written(estimate_lines, headers, estimate).withColumn("rows", F.split(F.regexp_replace("text", "^﻿", ""), "\r\n"))
    body = F.array_join(F.slice("rows", 1, F.size("rows") - 6), "\r\n")
    tail = F.array_join(F.slice("rows", F.size("rows") - 5, 5), "\r\n")
    text = F.concat(F.lit("﻿"), title("info"), F.lit("\r\n"), facts, F.lit("\r\n"), title("lines"), F.lit("\r\n"), body, F.lit("\r\n"), title("totals"), F.lit("\r\n"), tail, F.lit("\r\n"))
    return headers.select(estimate, *[c for c in info if c != estimate]).join(simple, estimate).select(estimate, text.alias("text"))
