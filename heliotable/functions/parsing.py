"""Values out of typed text. All built-in expressions; what cannot be read gives the stated default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heliotable.functions.text import half_width

# First year of an era less one.
ERAS = {"R": 2018, "令和": 2018, "H": 1988, "平成": 1988, "S": 1925, "昭和": 1925}


def number_or_null(c: Column) -> Column:
    """Digits, points and minus signs of a text as a number; null where they make none."""
    return F.nullif(F.regexp_replace(half_width(c), "[^0-9.\\-]", ""), F.lit("")).try_cast("double")


def number(c: Column) -> Column:
    """Digits, points and minus signs of a text as a number; 0 where they make none."""
    return F.coalesce(number_or_null(c), F.lit(0.0))


def whole_number(c: Column) -> Column:
    """Digits and minus signs only, so a point is passed over: '1.5' gives 15. 0 where there are none."""
    return F.coalesce(F.nullif(F.regexp_replace(half_width(c), "[^0-9\\-]", ""), F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint"))


_PRICE = "^-?[0-9,]*[0-9][0-9,]*$"


def price(c: Column) -> Column:
    """Whole price of a cell, of any width of digits, with a sign and commas; null for blanks and notes."""
    t = half_width(F.trim(c))
    return F.when(t.rlike(_PRICE), F.regexp_replace(t, ",", "").try_cast("bigint"))


def price_note(c: Column) -> Column:
    """The text of a price cell that holds no price; '' otherwise and for null."""
    t = F.coalesce(F.trim(c), F.lit(""))
    return F.when(half_width(t).rlike(_PRICE), F.lit("")).otherwise(t)


# A sign, digits of any width with thousands commas, and decimals.
_LEADING = r"^[\s　]*([-+]?[0-9０-９][0-9０-９,，]*(?:[.．][0-9０-９]+)?)[\s　]*"


def quantity_value(c: Column) -> Column:
    """The number with which a quantity begins; null where it begins with none."""
    n = F.regexp_replace(half_width(F.regexp_extract(c, _LEADING, 1)), "[,+]", "")
    return F.nullif(n, F.lit("")).try_cast("double")


def quantity_unit(c: Column) -> Column:
    """What follows the leading number; the whole text where there is none."""
    return F.trim(F.regexp_replace(F.trim(c), _LEADING, ""))


def count_of(c: Column, unit: str) -> Column:
    """A count in a text: a stated total first, else the only number with the unit, else a bare number; 0 if in doubt.

    Numbers are plain runs of digits: of '1,200枚' the last run, 200, is the one with the unit.
    """
    t = half_width(c)
    total = F.regexp_extract(t, rf"(?:合計|計)\s*([0-9]+)\s*{unit}", 1)
    hits = F.regexp_extract_all(t, F.lit(rf"([0-9]+)\s*{unit}"), F.lit(1))
    bare = F.when(F.trim(t).rlike("^[0-9]+$"), F.trim(t))
    found = F.coalesce(F.nullif(total, F.lit("")), F.when(F.size(hits) == 1, hits[0]), F.when(F.size(hits) == 0, bare))
    return F.coalesce(found.try_cast("bigint"), F.lit(0).cast("bigint"))


def length_mm(c: Column) -> Column:
    """A length of a text in mm: units m, cm, mm; a bare number as it stands; thousands commas are passed over; 0 where there is none."""
    t = F.regexp_replace(F.lower(half_width(F.trim(c))), r"(?<=[0-9]),(?=[0-9]{3}(?![0-9]))", "")
    n = F.nullif(F.regexp_extract(t, r"([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).try_cast("double")
    unit = F.regexp_extract(t, r"[0-9]\s*(mm|cm|m)", 1)
    return F.coalesce(F.when(unit == "cm", n * 10).when(unit == "m", n * 1000).otherwise(n), F.lit(0.0))


def bare_length_mm(c: Column, metres: float = 10, centimetres: float = 100) -> Column:
    """A length stored as a number in mm: under 10 it is metres, from 10 to under 100 centimetres; null gives 0."""
    return F.coalesce(F.when((c > 0) & (c < metres), c * 1000).when((c >= metres) & (c < centimetres), c * 10).otherwise(c), F.lit(0.0))


def yes(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("true", "1", "yes", "有", "あり", "有り", "要", "○", "可"), F.lit(False))


def wattage(c: Column, least: int = 300, most: int = 750) -> Column:
    """The last run of three or four digits between bounds, not before another digit or V; null if none."""
    runs = F.transform(F.regexp_extract_all(c, F.lit(r"([0-9]{3,4})(?![0-9vV])"), F.lit(1)), lambda x: x.cast("int"))
    fit = F.filter(runs, lambda x: (x >= least) & (x <= most))
    return F.when(F.size(fit) > 0, F.element_at(fit, -1))


def serial_date(c: Column) -> Column:
    """The date of a spreadsheet's day number."""
    return F.date_add(F.lit("1899-12-30").cast("date"), c.cast("int"))


def date_text(c: Column) -> Column:
    """yyyy/mm/dd of dates with era, kanji or separators, and of spreadsheet day numbers; the text itself if unread."""
    t = F.upper(half_width(F.trim(c)))
    pattern = r"([0-9]{4})\s*[年/.\-]\s*([0-9]{1,2})\s*[月/.\-]\s*([0-9]{1,2})"
    era_pattern = r"^(R|H|S|令和|平成|昭和)\s*([0-9]{1,2})\s*[年/.\-]\s*([0-9]{1,2})\s*[月/.\-]\s*([0-9]{1,2})"
    era = F.regexp_extract(t, era_pattern, 1)
    first = F.lit(None).cast("int")
    for name, year in ERAS.items():
        first = F.when(era == name, F.lit(year)).otherwise(first)
    two = lambda pat, k: F.lpad(F.regexp_extract(t, pat, k), 2, "0")
    of_era = F.concat_ws("/", (first + F.regexp_extract(t, era_pattern, 2).try_cast("int")).cast("string"), two(era_pattern, 3), two(era_pattern, 4))
    plain = F.concat_ws("/", F.regexp_extract(t, pattern, 1), two(pattern, 2), two(pattern, 3))
    serial = F.date_format(serial_date(t.try_cast("int")), "yyyy/MM/dd")
    return F.when(era != "", of_era).when(t.rlike(pattern), plain).when(t.rlike("^[0-9]{4,6}$"), serial).otherwise(c)


def postal_code(c: Column) -> Column:
    """NNN-NNNN of seven digits; '' otherwise."""
    d = F.regexp_replace(half_width(c), "[^0-9]", "")
    return F.when(F.length(d) == 7, F.concat_ws("-", F.substring(d, 1, 3), F.substring(d, 4, 4))).otherwise(F.lit(""))


def postal_in_address(c: Column) -> Column:
    return postal_code(F.regexp_extract(half_width(c), r"〒?\s*([0-9]{3}-?[0-9]{4})(?![0-9])", 1))


def address_without_postal(c: Column) -> Column:
    return F.trim(F.regexp_replace(half_width(c), r"〒?\s*[0-9]{3}-?[0-9]{4}(?![0-9])\s*", ""))


def string_pairs(c: Column) -> Column:
    """(series, parallel) of each branch of a text such as 12直×5並＋10直×2並; both above 0."""
    t = half_width(c)
    series = F.regexp_extract_all(t, F.lit(r"([0-9]+)\s*直"), F.lit(1))
    parallel = F.regexp_extract_all(t, F.lit(r"直\s*[x×*]?\s*([0-9]+)\s*並"), F.lit(1))
    both = F.zip_with(series, parallel, lambda a, b: F.struct(a.cast("int").alias("series"), b.cast("int").alias("parallel")))
    return F.filter(both, lambda x: (x["series"] > 0) & (x["parallel"] > 0))


def category_name(c: Column, aliases: dict[str, str]) -> Column:
    """The usual name of a category typed with numbering, dots or spaces; '' for one that is not known, and for null."""
    bare = lambda x: F.regexp_replace(x, r"[\s　・･]", "")
    plain = bare(F.regexp_replace(c, r"^[\s　■◆●□(（]*[0-9０-９]*[)）.．、]*[\s　]*", ""))
    out = F.lit("")
    for name, usual in reversed({**{u: u for u in aliases.values()}, **aliases}.items()):
        out = F.when(plain == bare(F.lit(name)), F.lit(usual)).otherwise(out)
    return out


def short_date_text(c: Column, year: Column) -> Column:
    """yyyy/mm/dd of a date with an era or a year, or of a month and day in a given year; the text itself if unread."""
    t = half_width(F.trim(c))
    whole = date_text(c)
    month, day = (F.regexp_extract(t, r"^([0-9]{1,2})\s*[./-]\s*([0-9]{1,2})$", k).try_cast("int") for k in (1, 2))
    stated = month.between(1, 12) & day.between(1, 31)
    return F.when(F.coalesce(stated, F.lit(False)), F.format_string("%d/%02d/%02d", year.cast("int"), month, day)).otherwise(whole)


def tokyo_time(c: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(c, "Asia/Tokyo"), "yyyy-MM-dd HH:mm")


def yen(c: Column) -> Column:
    return F.format_string("¥%,d", c.cast("bigint"))


def date_or_null(c: Column) -> Column:
    """A date written with dashes, slashes or kanji; null for anything else, as for days that do not exist."""
    t = half_width(F.trim(c))
    return F.coalesce(*[F.try_to_date(t, f) for f in ("yyyy-M-d", "yyyy/M/d", "yyyy年M月d日")])


def with_defaults(text: Column, schema: str, defaults: dict) -> Column:
    """A struct of a JSON text; missing and null fields get defaults, unknown ones are passed over."""
    parsed = F.from_json(text, schema)
    return F.struct(*[F.coalesce(parsed[name], F.lit(value)).alias(name) for name, value in defaults.items()])
