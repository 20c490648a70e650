"""Addresses that denote the same numbered lot, however written (problem 3).

Method: a self-built gazetteer. Localities and their streets are learned from
the addresses that state them in full; street spellings are clustered within a
locality and every street gets an identifier. Then every address is resolved by
a beam of hypotheses (where the locality ends and the street begins, or which
locality the postal code means), each looked up in the gazetteer by equi-joins,
the cheapest kept; records join on street, block and number.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heliotable.llm import readings
from heliotable.llm.visual_text import NOT_BLANK, consistent_form
from heliotable.plans.durable import cut
from heliotable.plans.joins import sized, spread
from heliotable.plans.tables import dealt

# Old and variant forms of kanji in place names.
OLD_FORMS = str.maketrans("縣國澤瀨龜靏鷺櫻濱濵榮稻臺廣嶋條邊邉齋藏萬德眞關龍瀧嶽檜", "県国沢瀬亀鶴鷺桜浜浜栄稲台広島条辺辺斎蔵万徳真関竜滝岳桧")
# Kanji taken for one another by eye, the commoner in place names second.
TAKEN_FOR = ("厚補由僑抑沙彬皐掬露荻付右雪未曰困", "原浦田橋柳砂杉泉菊霧萩竹石雲末日因")
# Readings of the signs that end a locality's name.
LOCALITY_SUFFIX = {"市": ("shi",), "町": ("cho", "machi"), "村": ("mura", "son"), "区": ("ku",)}
#: What a locality costs more that one address alone states: more than any short form, less than an unlisted street.
RARE = 4
_DIGITS = {c: i for i, c in enumerate("〇一二三四五六七八九")}
_TRIPLE = re.compile(r"(\d+)\s*(?:丁目|の|-)\s*(\d+)\s*(?:番地の?|番|の|-)\s*(\d+)")
_KANJI_NUMBER = re.compile("[一二三四五六七八九十百〇]+(?=丁目|番|号)")
_POSTAL = re.compile(r"〒?\s*(\d{3})[-ー ]?(\d{4})(?!\d)")
_LATIN = re.compile(r"^(\d+)-(\d+)-(\d+)\s+([A-Za-z' ]+?)\s*,\s*([A-Za-z']+)-([a-z]+)\b", re.I)
_FULL = re.compile(r"^(.{1,3}?[県都府道])(.{1,6}?[市町村区])(.+)$")

PARSED = "address string, postal_code string, postal string, head string, prefecture string, locality string, town string, latin_locality string, latin_town string, chome int, block int, number int"


def _number(kanji: str) -> str:
    total, now = 0, 0
    for c in kanji:
        if c in "十百":
            total, now = total + (now or 1) * (10 if c == "十" else 100), 0
        else:
            now = now * 10 + _DIGITS[c]
    return str(total + now)


def tidy(address: str | None) -> str:
    t = unicodedata.normalize("NFKC", consistent_form(address) or "").translate(OLD_FORMS).strip()
    return _KANJI_NUMBER.sub(lambda m: _number(m[0]), t)


def _small(digits: str) -> int | None:
    return int(digits) if len(digits) <= 9 else None


def parse(address: str | None, postal_code: str | None) -> tuple | None:
    """The parts of PARSED after the two inputs; None where no lot is stated (blank, null, or without three numbers)."""
    t = tidy(address)
    if not t:
        return None
    own = re.sub(r"\D", "", unicodedata.normalize("NFKC", postal_code or ""))
    t = re.sub(r"^\([^)]*\)\s*", "", t)
    m = _POSTAL.match(t)
    if m:
        own = own if len(own) == 7 else m[1] + m[2]
        t = re.sub(r"^\([^)]*\)\s*", "", t[m.end() :].strip())
    postal = own if len(own) >= 3 else ""
    m = _LATIN.match(t)
    if m:
        numbers = tuple(map(_small, m.groups()[:3]))
        return (postal, "", "", "", "", f"{m[5]}-{m[6]}".lower(), re.sub("[' ]", "", m[4]).lower(), *numbers)
    m = _TRIPLE.search(t)
    if not m:
        return None
    head = re.sub(r"[\s,、]+", "", t[: m.start()])
    head = re.sub("[ケがガｹカ](?=[丘谷])", "ヶ", head)
    full = _FULL.match(head)
    prefecture, locality, town = full.groups() if full else ("", "", "")
    return (postal, head, prefecture, locality, street_name(town), "", "", *map(_small, m.groups()))


def street_name(town: str) -> str:
    return re.sub("^(?:大字|字)", "", town)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in PARSED.split(", ")]
    for pdf in batches:
        rows = []
        for a, p in zip(pdf["address"], pdf["postal_code"]):
            parts = parse(a, p)
            if parts and None not in parts[-3:]:
                rows.append((a, p, *parts))
        yield pd.DataFrame(rows, columns=names)


def _streets_aloud(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(i, k, begin, readings.pattern(name)) for i, k, name in zip(pdf["locality_id"], pdf["street_id"], pdf["name"]) if readings.readable(name) for begin in readings.beginnings(name)]
        yield pd.DataFrame(rows, columns=["locality_id", "street_id", "begin", "pattern"])


def _localities_aloud(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for i, name in zip(pdf["locality_id"], pdf["locality"]):
            suffixes = LOCALITY_SUFFIX.get(name[-1], ())
            if suffixes and readings.readable(name[:-1]):
                pattern = readings.pattern(name[:-1]).removesuffix("$") + "-(?:" + "|".join(suffixes) + ")$"
                rows += [(i, begin, pattern) for begin in readings.beginnings(name[:-1])]
        yield pd.DataFrame(rows, columns=["locality_id", "begin", "pattern"])


def _locality_forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for i, pref, name in zip(pdf["locality_id"], pdf["prefecture"], pdf["locality"]):
            for p, p_cost in ((pref, 0), (pref[:-1], 0), ("", 0)):
                rows += [(i, p + name, p_cost), (i, p + name[:-1], 1)]
        yield pd.DataFrame(rows, columns=["locality_id", "form", "cost"])


def _begun(column: str) -> Column:
    """Every beginning of a text."""
    return F.transform(F.sequence(F.lit(1), F.length(column)), lambda k: F.substring(F.col(column), F.lit(1), k))


def latin_streets(parsed: DataFrame, known: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``id, street_id, cost, n`` of addresses in Latin letters.

    A locality and a street that can be read so are met by the reading of their
    first signs and told by a pattern of the whole, so names have no length and
    readings no number. Names that the readings do not know are learned: the
    street on which the other addresses of the same full postal code lie, if
    nearly all do, is what Latin addresses of that code call so, at a cost.
    """
    latin = parsed.where("latin_town <> ''").select("id", "postal", "latin_locality", "latin_town")
    names = gazetteer.where("name = spelling").select("locality_id", "street_id", "name", "n")
    towns = known.select("locality_id", "locality").mapInPandas(_localities_aloud, "locality_id string, begin string, pattern string")
    placed = latin.withColumn("begin", F.explode(_begun("latin_locality"))).join(spread(towns), "begin").where("latin_locality rlike pattern").select("id", "latin_town", "locality_id").distinct()
    aloud = names.mapInPandas(_streets_aloud, "locality_id string, street_id string, begin string, pattern string")
    read = placed.withColumn("begin", F.explode(_begun("latin_town"))).join(spread(aloud), ["locality_id", "begin"]).where("latin_town rlike pattern")
    read = read.select("id", "locality_id", "street_id").distinct().join(spread(known.select("locality_id", "rare")), "locality_id").select("id", "street_id", F.col("rare").alias("cost"))

    stated = parsed.where("length(postal) = 7 and town <> ''").select("postal", F.concat("prefecture", "locality").alias("locality_id"), F.col("town").alias("spelling"))
    of_code = stated.join(spread(gazetteer.select("locality_id", "spelling", "street_id")), ["locality_id", "spelling"]).groupBy("postal", "street_id").agg(F.count("*").alias("k"))
    sure = of_code.groupBy("postal").agg(F.sum("k").alias("all"), F.max(F.struct("k", "street_id")).alias("top")).where("top.k >= 3 and top.k >= 0.8 * all").select("postal", F.col("top.street_id").alias("street_id"))
    called = latin.where("length(postal) = 7").join(spread(sure), "postal").groupBy("latin_locality", "latin_town", "street_id").agg(F.count("*").alias("k"))
    called = called.groupBy("latin_locality", "latin_town").agg(F.max(F.struct("k", "street_id")).alias("top")).select("latin_locality", "latin_town", F.col("top.street_id").alias("street_id"))
    learned = latin.join(spread(called), ["latin_locality", "latin_town"]).select("id", "street_id", F.lit(2 * RARE).alias("cost"))
    return read.unionByName(learned).join(spread(names.select("street_id", "n")), "street_id").select("id", "street_id", "cost", "n")


def shape(column: str | Column) -> Column:
    return F.translate(column, *TAKEN_FOR)


def localities(parsed: DataFrame) -> DataFrame:
    """``locality_id, prefecture, locality, n, rare, postal3``: the localities that addresses state in full.

    One address is enough, lest its own copies and short forms find nothing; but
    it may be misread, so ``rare`` is what a hypothesis of its locality costs more.
    """
    full = parsed.where("locality <> '' and town <> ''")
    known = full.groupBy("prefecture", "locality").agg(F.count("*").alias("n")).withColumn("rare", F.when(F.col("n") == 1, RARE).otherwise(0)).withColumn("locality_id", F.concat("prefecture", "locality"))
    area = full.where("length(postal) = 7").groupBy(F.concat("prefecture", "locality").alias("locality_id"), F.substring("postal", 1, 3).alias("postal3")).agg(F.count("*").alias("k"))
    best = area.withColumn("r", F.row_number().over(W.partitionBy("locality_id").orderBy(F.desc("k"), "postal3"))).where("r = 1").select("locality_id", "postal3")
    return known.join(spread(best), "locality_id", "left")


def streets(parsed: DataFrame, known: DataFrame, n_known: int) -> DataFrame:
    """``locality_id, spelling, street_id, n``: street spellings clustered within their locality.

    A spelling joins a commoner one (three times as many rows) that looks the
    same sign by sign, or that has the same full postal code and differs in one
    sign. Other spellings are streets of their own.
    """
    full = parsed.where("locality <> '' and town <> ''").withColumn("locality_id", F.concat("prefecture", "locality")).join(sized(known.select("locality_id"), n_known), "locality_id", "left_semi")
    counted = full.groupBy("locality_id", F.col("town").alias("spelling")).agg(F.count("*").alias("n"))
    codes = full.where("length(postal) = 7").groupBy("locality_id", F.col("town").alias("spelling"), "postal").agg(F.count("*").alias("k"))
    code = codes.withColumn("r", F.row_number().over(W.partitionBy("locality_id", "spelling").orderBy(F.desc("k"), "postal"))).where("r = 1").select("locality_id", "spelling", "postal")
    counted = counted.join(spread(code), ["locality_id", "spelling"], "left").withColumn("shape", shape("spelling"))
    by_shape = W.partitionBy("locality_id", "shape").orderBy(F.desc("n"), "spelling")
    one = counted.withColumn("head", F.first("spelling").over(by_shape)).withColumn("head_n", F.first("n").over(by_shape))
    one = one.withColumn("head", F.when(F.col("head_n") >= 3 * F.col("n"), F.col("head")).otherwise(F.col("spelling")))
    heads = one.where("head = spelling").select("locality_id", "postal", F.col("spelling").alias("other"), F.col("n").alias("other_n"))
    near = one.where("head = spelling and postal is not null").join(spread(heads), ["locality_id", "postal"]).where("other_n >= 3 * n and other <> spelling").where(F.levenshtein("spelling", "other", 1) == 1)
    near = near.withColumn("r", F.row_number().over(W.partitionBy("locality_id", "spelling").orderBy(F.desc("other_n"), "other"))).where("r = 1").select("locality_id", F.col("spelling").alias("head"), "other")
    joined = one.join(spread(near), ["locality_id", "head"], "left").withColumn("head", F.coalesce("other", "head"))
    return joined.select("locality_id", "spelling", F.concat_ws("/", "locality_id", "head").alias("street_id"), F.col("head").alias("name"), "n")


def resolve(addresses: DataFrame) -> DataFrame:
    """``address, postal_code, street_id, chome, block, number`` of each distinct pair that states a lot that can be placed.

    Blank and null addresses, those without a lot number, and those with neither
    locality nor a known postal code have no row.
    """
    pairs = addresses.where(F.col("address").rlike(NOT_BLANK)).select("address", "postal_code").distinct()
    parsed = cut(dealt(pairs).mapInPandas(_parse, PARSED).withColumn("id", F.md5(F.to_json(F.struct("address", "postal_code")))))
    known = cut(localities(parsed))
    n_known = known.count()
    gazetteer = cut(streets(parsed, known, n_known))
    forms = known.mapInPandas(_locality_forms, "locality_id string, form string, cost int").groupBy("locality_id", "form").agg(F.min("cost").alias("cost")).join(sized(known.select("locality_id", "postal3", "rare"), n_known), "locality_id")
    form_rows = n_known * 6
    longest = forms.agg(F.max(F.length("form"))).first()[0] or 0

    japanese = parsed.where("head <> ''")
    ends = F.sequence(F.lit(1), F.least(F.length("head") - 1, F.lit(max(1, longest))))
    split = japanese.where("length(head) > 1").select("id", "postal", "head", F.explode(ends).alias("k"))
    split = split.select("id", "postal", F.expr("substring(head, 1, k)").alias("form"), F.regexp_replace(F.expr("substring(head, k + 1)"), "^(大字|字)", "").alias("town"))
    stated = split.join(sized(forms, form_rows, 500_000), "form").select("id", "postal", "postal3", "locality_id", "town", "cost", "rare")
    # of the rare localities of a postal code, which misreadings make many, the first alone is meant by the code, the others by it and their street
    first = F.row_number().over(W.partitionBy("postal3").orderBy(F.desc("n"), "locality_id"))
    area = known.where("postal3 is not null").withColumn("r", first).where("r = 1 or rare = 0").select("locality_id", "postal3", "rare")
    meant = japanese.select("id", "postal", F.substring("postal", 1, 3).alias("postal3"), F.regexp_replace("head", "^(大字|字)", "").alias("town"))
    by_code = meant.join(sized(area, n_known), "postal3").select("id", "postal", "postal3", "locality_id", "town", F.lit(3).alias("cost"), "rare")
    rare_streets = gazetteer.join(sized(known.where("rare > 0").select("locality_id", "postal3", "rare"), n_known), "locality_id").select("locality_id", "postal3", "rare", shape("spelling").alias("as_shape")).distinct()
    by_street = meant.withColumn("as_shape", shape("town")).join(spread(rare_streets), ["postal3", "as_shape"]).select("id", "postal", "postal3", "locality_id", "town", F.lit(3).alias("cost"), "rare")
    beam = stated.unionByName(by_code).unionByName(by_street).withColumn("cost", F.col("cost") * 2 + F.col("rare") + F.when(F.substring("postal", 1, 3) == F.col("postal3"), 0).otherwise(1)).select("id", "locality_id", "town", "cost").distinct()

    spelled = gazetteer.select("locality_id", F.col("spelling").alias("town"), "street_id", "n")
    placed = beam.join(spread(spelled), ["locality_id", "town"], "left")
    # an unlisted spelling: the street of its shape, where the locality is stated
    shaped = gazetteer.where("name = spelling").select("locality_id", F.col("spelling").alias("as_shape"), F.col("street_id").alias("shape_id"))
    # (a found one looks for what is nowhere, by its own id, so that these spread over the tasks)
    placed = placed.withColumn("as_shape", F.when(F.col("street_id").isNull(), shape("town")).otherwise(F.concat(F.lit("#"), F.col("id")))).join(spread(shaped), ["locality_id", "as_shape"], "left")
    own = F.concat_ws("/", "locality_id", shape("town"))
    placed = placed.select("id", F.coalesce("street_id", "shape_id", own).alias("street_id"), (F.col("cost") + F.when(F.col("street_id").isNotNull(), 0).when(F.col("shape_id").isNotNull(), 1).otherwise(20)).alias("cost"), F.coalesce("n", F.lit(0)).alias("n"))

    latin = latin_streets(parsed, known, gazetteer)
    best = W.partitionBy("id").orderBy("cost", F.desc("n"), "street_id")
    chosen = placed.unionByName(latin).withColumn("r", F.row_number().over(best)).where("r = 1").select("id", "street_id")
    return parsed.join(spread(chosen), "id").select("address", "postal_code", "street_id", "chome", "block", "number")


def places_of(records: DataFrame) -> DataFrame:
    """``record_id, street_id, chome, block, number`` for records with ``record_id, address, postal_code``, each id once."""
    rows = records.where(F.col("record_id").isNotNull() & F.col("address").rlike(NOT_BLANK)).select("record_id", "address", "postal_code").dropDuplicates(["record_id"])
    resolved = resolve(rows)
    same = (rows["address"] == resolved["address"]) & rows["postal_code"].eqNullSafe(resolved["postal_code"])
    return rows.join(spread(resolved), same).select("record_id", "street_id", "chome", "block", "number")


def same_place_pairs(places: DataFrame) -> DataFrame:
    """``survey_a, survey_b`` of all pairs of records of a place, the smaller first."""
    keys = ["street_id", "chome", "block", "number"]
    a = places.select(*keys, F.col("record_id").alias("survey_a"))
    b = places.select(*keys, F.col("record_id").alias("survey_b"))
    return a.join(spread(b), keys).where("survey_a < survey_b").select("survey_a", "survey_b")
