import math

import pytest
from pyspark.sql import functions as F

from heliotable.functions import expressions, parsing, similarity, text


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("make", "typed", "want"),
    [
        (text.description_key, "ＰＶモジュール　（据付）", "pvモジュール据付"),
        (text.description_key, "架台・レール 取付", "架台レール取付"),
        (text.description_key, "", ""),
        (text.description_key, None, None),
        (text.catalog_model_key, " ＳＵＮ２０００ー４．９５ＫＴＬ ", "sun2000-4.95ktl"),
        (text.registry_model_key, "LR5－７２", "lr5-72"),
        (text.registry_model_key, "ＬＲ５", "ｌｒ5"),
        (text.comparison_key, "Ａ社  ビル", "a社 ビル"),
        (text.half_width, "１，２３４－５", "1,234-5"),
        (text.without_honorific, "ミナモ商事　御中", "ミナモ商事"),
        (text.model_without_watts, "ABC-400 415W", "ABC-400"),
        (text.maker_key, "A・B　C", "abc"),
        (text.file_safe, "a/b:c", "a_b_c"),
        (text.file_safe, "", "untitled"),
        (lambda c: text.without_lines(c, "支給"), "a\n支給品\nb", "a\nb"),
        (lambda c: text.after_label(c, "住所"), "住所：東町", "東町"),
    ],
)
def test_text(spark, make, typed, want):
    assert one(spark, typed, make) == want


@pytest.mark.parametrize(
    ("make", "typed", "want"),
    [
        (parsing.number, "１２．５kW", 12.5),
        (parsing.number, "none", 0.0),
        (parsing.whole_number, "1.5", 15),
        (parsing.whole_number, None, 0),
        (parsing.price, "90,000", 90000),
        (parsing.price, "要問合せ", None),
        (parsing.price_note, "要問合せ", "要問合せ"),
        (parsing.quantity_value, "288枚", 288.0),
        (parsing.quantity_unit, "288枚", "枚"),
        (parsing.quantity_value, "一式", None),
        (parsing.quantity_unit, "一式", "一式"),
        (lambda c: parsing.count_of(c, "枚"), "東4枚・西4枚（合計8枚）", 8),
        (lambda c: parsing.count_of(c, "枚"), "東4枚・西4枚", 0),
        (lambda c: parsing.count_of(c, "枚"), "8", 8),
        (lambda c: parsing.count_of(c, "枚"), "未確認", 0),
        (parsing.length_mm, "3m", 3000.0),
        (parsing.length_mm, "25", 25.0),
        (parsing.length_mm, "1500", 1500.0),
        (parsing.length_mm, "12cm", 120.0),
        (parsing.date_text, "R7.12.18", "2025/12/18"),
        (parsing.date_text, "2025年9月29日", "2025/09/29"),
        (parsing.date_text, "46294", "2026/09/29"),
        (parsing.date_text, "未定", "未定"),
        (parsing.postal_code, "1000005", "100-0005"),
        (parsing.postal_code, "12", ""),
        (parsing.postal_in_address, "〒530-0001 大阪", "530-0001"),
        (parsing.address_without_postal, "〒530-0001 大阪", "大阪"),
        (parsing.wattage, "LR5-72HPH-550M", 550),
        (parsing.wattage, "1500V", None),
        (parsing.yes, "あり", True),
        (parsing.yes, None, False),
        (parsing.yen, "1234567", "¥1,234,567"),
    ],
)
def test_parsing(spark, make, typed, want):
    assert one(spark, typed, make) == want


def test_bare_lengths(spark):
    df = spark.createDataFrame([(3.0,), (25.0,), (100.0,), (0.0,), (-2.0,), (None,)], "v double")
    assert [r.r for r in df.select(parsing.bare_length_mm(F.col("v")).alias("r")).collect()] == [3000.0, 250.0, 100.0, 0.0, -2.0, 0.0]


def test_string_pairs(spark):
    got = one(spark, "12直×5並＋10直×2並", parsing.string_pairs)
    assert [tuple(x) for x in got] == [(12, 5), (10, 2)]


CONDITIONS = [
    ("", True),
    ("kw > 100", True),
    ("kw > 100 AND flag == false", False),
    ("kw > 1000 OR flag", True),
    ("NOT flag", False),
    ("NOT flag AND kw > 1000", True),
    ("(kw > 1000 OR flag) AND name == 'a'", True),
    ("missing", False),
    ("missing == none", True),
    ("nothing == none", True),
    ("nothing > 3", False),
    ("name > 3", False),
    ("flag == 1", True),
    ("kw >= 190.08", True),
    ("name != 'b'", True),
    ("kw > 1000 or name == \"a\"", True),
]


@pytest.mark.parametrize(("text_", "want"), CONDITIONS)
def test_conditions(spark, text_, want):
    df = spark.createDataFrame([(190.08, True, "a", None)], "kw double, flag boolean, name string, nothing double")
    fields = expressions.fields_of(df.schema)
    assert df.select(expressions.condition(text_, fields).alias("r")).first()["r"] is want


@pytest.mark.parametrize("formula", ["1 + 2 * x", "-7 % 3", "-7 // 2", "round(2.5)", "int(-2.7)", "max(x, 3) ** 2", "min(x, 1, 2)", "ceil(x / 4)", "abs(-x)", "floor(-x / 4)", "float(x)"])
def test_formulas_are_pythons(spark, formula):
    df = spark.createDataFrame([(10.0,)], "x double")
    want = eval(formula, {"ceil": math.ceil, "floor": math.floor}, {"x": 10.0})  # noqa: S307
    assert df.select(expressions.formula(formula, {"x": F.col("x")}).alias("r")).first()["r"] == pytest.approx(float(want))


def test_formula_limits(spark):
    df = spark.createDataFrame([(0.0,)], "x double")
    assert df.select(expressions.formula("1 / x", {"x": F.col("x")}).alias("r")).first()["r"] is None
    for bad in ("__import__('os')", "y", "x if x else 1", "'a'", "x.real", ""):
        with pytest.raises(ValueError):
            expressions.formula(bad, {"x": F.col("x")})


def test_similarity(spark):
    df = spark.createDataFrame([("sun2000-4.95ktl-jpl1", "sun2000-50ktl"), ("ab", "ab"), ("ab", "xaby"), ("xaby", "ab"), ("", "a"), (None, "a")], "a string, b string")
    got = [r.s for r in df.select(similarity.model_score(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == pytest.approx([1.75, 10.0, 6.5, 4.5, 0.0, 0.0])
    ratio = spark.createDataFrame([("パワコン取付工事", "パワーコン取付工事"), (None, "a")], "a string, b string").select(similarity.matching_ratio("a", "b").alias("r")).collect()
    assert ratio[0].r == pytest.approx(0.941, abs=1e-3) and ratio[1].r is None


def test_tolerance(spark):
    df = spark.createDataFrame([(101.0, 100.0), (104.0, 100.0), (110.0, 100.0), (0.0, 0.0), (0.1, 0.0), (None, 1.0)], "v double, t double")
    got = [r.s for r in df.select(similarity.tolerance_verdict(F.col("v"), F.col("t")).alias("s")).collect()]
    assert got == ["correct", "partial", "wrong", "correct", "wrong", "wrong"]
