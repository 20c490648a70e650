"""Normal forms of typed text, each for its own use; they are not interchangeable.

All take and give columns. Null stays null unless said otherwise.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Dash-like signs that model numbers are typed with, the long-vowel mark among them.
DASHES = "‐－ー―−"
# Full-width digits and punctuation.
FULL, HALF = "０１２３４５６７８９．，－：／　", "0123456789.,-:/ "
HONORIFICS = ("御中", "様", "殿", "さん")


@pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Compatibility composition; the one normal form for which there is no built-in."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v), na_action="ignore")


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def description_key(c: Column, ascii_only: bool = False) -> Column:
    """Letters and digits alone, in lower case; the long-vowel mark is a letter."""
    return F.regexp_replace(F.lower(c if ascii_only else nfkc(c)), r"[^\p{L}\p{N}]", "")


def catalog_model_key(c: Column) -> Column:
    return collapsed(F.translate(F.lower(F.trim(nfkc(c))), DASHES + "　", "-" * len(DASHES) + " "))


def registry_model_key(c: Column) -> Column:
    """Only digits, dashes and spaces are folded, without compatibility composition."""
    return collapsed(F.translate(F.lower(F.trim(c)), "０１２３４５６７８９" + DASHES + "　", "0123456789" + "-" * len(DASHES) + " "))


def comparison_key(c: Column) -> Column:
    return collapsed(F.lower(nfkc(c)))


def page_text(c: Column) -> Column:
    return collapsed(F.translate(nfkc(c), "⼯⼒⼩⽇", "工力小日"))


def half_width(c: Column) -> Column:
    return F.translate(c, FULL, HALF)


def without_honorific(c: Column) -> Column:
    return F.regexp_replace(collapsed(c), rf"[\s　]*({'|'.join(HONORIFICS)})$", "")


def model_without_watts(c: Column) -> Column:
    """A model whose wattage was typed behind it: the last word of two to four digits and W goes."""
    return F.regexp_replace(collapsed(c), r"(?i)[\s　(（]+\d{2,4}\s*w[)）]?$", "")


def maker_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[\s　・･]", ""))


def file_safe(c: Column, fallback: str = "untitled", length: int = 40) -> Column:
    name = F.substring(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r'[\\/:*?"<>|\s]+', "_"), 1, length)
    return F.when(name == "", F.lit(fallback)).otherwise(name)


def without_lines(c: Column, mark: str) -> Column:
    """A many-lined remark without the lines that hold a mark."""
    return F.array_join(F.filter(F.split(c, "\n"), lambda line: ~F.contains(line, F.lit(mark))), "\n")


def after_label(c: Column, label: str) -> Column:
    """What stands behind a label and its separator; the whole where the label is missing."""
    t = F.trim(c)
    rest = F.substring(t, len(label) + 1, 1_000_000)
    return F.when(F.startswith(t, F.lit(label)), F.regexp_replace(rest, r"^[\s:：　]+", "")).otherwise(t)


def filled_template(template: Column, values: dict[str, Column]) -> Column:
    """A text with ``{name}`` replaced by values; a null value leaves nothing."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def contain_each_other(a: Column, b: Column) -> Column:
    """Whether one of two names, without white space, holds the other; false for blanks and nulls."""
    x, y = (F.regexp_replace(c, r"(?U)\s", "") for c in (a, b))
    return F.coalesce((x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x)), F.lit(False))
