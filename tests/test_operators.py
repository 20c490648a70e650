import itertools
import json
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from heliotable.operators import catalog, edits, estimates, evaluation, layout, line_diff, nested_records, quality, rules, voting
from heliotable.plans.tables import latest_delivery
from heliotable.sources import estimate_csv, json_store


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


FACE = "id int, room_w double, room_d double, piece_w double, piece_d double, gap_col double, gap_row double, walkway double, walkway_every int, margin_x double, margin_y double"


@pytest.mark.parametrize(("walkway", "every", "cols", "pieces"), [(0.0, 2, 9, 27), (800.0, 2, 7, 21), (800.0, 3, 8, 24)])
def test_grid(spark, walkway, every, cols, pieces):
    face = spark.createDataFrame([(1, 11000.0, 7000.0, 1134.0, 1762.0, 10.0, 25.0, walkway, every, 500.0, 500.0)], FACE)
    counted = layout.grid_counts(face)
    assert counted.select("rows", "cols", "pieces").first() == (3, cols, pieces)
    placed = layout.grid_positions(counted, ["id"])
    assert placed.count() == pieces
    xs = [r.x for r in placed.where("row = 0").orderBy("col").collect()]
    gaps = [round(b - a - 1134.0, 6) for a, b in itertools.pairwise(xs)]
    assert gaps == [walkway if walkway and (k + 1) % every == 0 else 10.0 for k in range(cols - 1)]


def test_fit_edges(spark):
    df = spark.createDataFrame([(0.0, 10.0), (10.0, 0.0), (10.0, 10.0), (9.9, 10.0)], "room double, size double")
    assert [r.n for r in df.select(layout.fit_count(F.col("room"), F.col("size"), F.lit(5.0)).alias("n")).collect()] == [0, 0, 1, 0]


def test_walkways_by_counting(spark):
    cases = [(float(room), float(size), float(gap), float(walk), every) for room in (0, 900, 3000, 12345) for size in (100, 333) for gap in (0, 10) for walk in (50, 800) for every in (1, 2, 5)]
    df = spark.createDataFrame(cases, "room double, size double, gap double, walk double, every int")
    got = df.select("*", layout.fit_with_walkways(*[F.col(c) for c in ("room", "size", "gap", "walk", "every")]).alias("n")).collect()
    for r in got:
        n = 0
        while (n + 1) * r["size"] + (n - n // r.every) * r.gap + (n // r.every) * r.walk <= r.room:
            n += 1
        assert r.n == n, r


def test_polygon(spark):
    square = F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (10, 0), (10, 10), (0, 10))])
    df = spark.createDataFrame([(5.0, 5.0), (15.0, 5.0), (-1.0, 5.0)], "x double, y double")
    assert [r.i for r in df.select(layout.in_polygon(F.col("x"), F.col("y"), square).alias("i")).collect()] == [True, False, False]
    line = F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))
    assert df.select(layout.in_polygon(F.col("x"), F.col("y"), line).alias("i")).first().i is False
    assert df.limit(1).select(layout.rectangle_in_polygon(F.lit(1.0), F.lit(1.0), F.lit(9.0), F.lit(9.0), square).alias("i")).first().i is True


def test_voting(spark):
    data = [("name", 1, "Ａ社"), ("name", 2, "a社"), ("name", 3, "A社"), ("post", 1, "x"), ("post", 2, "y"), ("post", 3, "y"), ("split", 1, "a"), ("split", 2, "b"), ("split", 3, "c"), ("one", 1, "z"), ("one", 2, " "), ("none", 1, ""), ("none", 2, None), ("single", 1, "q")]
    df = spark.createDataFrame(data, "path string, sample int, value string")
    from heliotable.functions.text import comparison_key

    got = rows(voting.majority(df, ["path"], "value", "sample", comparison_key(F.col("value"))), "path", "winner", "confidence")
    assert got == [("name", "Ａ社", "high"), ("none", "", "low"), ("one", "z", "high"), ("post", "y", "medium"), ("single", "q", "medium"), ("split", "a", "low")]
    numbers = spark.createDataFrame([("w", 660.0), ("w", 661.0), ("w", 600.0), ("e", 1.0), ("e", None)], "path string, value double")
    assert rows(voting.numeric_majority(numbers, ["path"], "value"), "path", "winner", "confidence") == [("e", 1.0, "medium"), ("w", 660.0, "medium")]
    merged = voting.merged_document(voting.majority(df.withColumn("r", F.lit(1)), ["r", "path"], "value", "sample"), "r").first()
    assert merged["values"]["post"] == "y" and merged.confidences["split"] == "low"


def test_fuzzy_pairs_by_hand(spark):
    left = [("g", "l1", "パワコン取付工事", 0), ("g", "l2", "足場", 1), ("h", "l3", "只今", 0)]
    right = [("g", "r1", "パワーコン取付工事", 0), ("g", "r2", "足場組立", 1), ("i", "r3", "只今", 0)]
    schema = "g string, id string, t string, pos int"
    got = rows(line_diff.fuzzy_pairs(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["g"], "id", "t"), "left_id", "right_id", "score")
    assert got == [("l1", "r1", SequenceMatcher(None, left[0][2], right[0][2]).ratio()), ("l2", "r2", SequenceMatcher(None, "足場", "足場組立").ratio())]


def test_item_pairs_in_eight_passes(spark):
    schema = "e string, id string, pos int, category string, description string, remarks string, unit_price long"
    left = [
        ("E", "l1", 0, "c", "ＰＶケーブル(間)", "北", 10), ("E", "l2", 1, "c", "pvケーブル間", "南", 20), ("E", "l3", 2, "c", "架台", "x", None), ("E", "l4", 3, "c", "足場組立", "", 1),
        ("E", "l5", 4, "d", "接地線", "東", 5), ("E", "l6", 5, "", "看板", "", 7), ("E", "l7", 6, "d", "看板", "", 8), ("E", "l8", 7, "d", "残土", "", 3), ("E", "l9", 8, None, "パワコン取付", "", 3), ("F", "m1", 0, "c", "柵", "", 1),
    ]
    right = [
        ("E", "r1", 0, "c", "PVケーブル間", "西", 20), ("E", "r2", 1, "c", "PVケーブル間", "北", 99), ("E", "r3", 2, "c", "架台", "y", None), ("E", "r4", 3, "c", "足場組", "", 1), ("E", "r5", 4, "", "接地線", "東", 6),
        ("E", "r6", 5, "d", "看板", "別", 7), ("E", "r7", 6, "d", "看板", "", 9), ("E", "r8", 7, "", "残土", "z", 4), ("E", "r9", 8, "d", "パワーコン取付", "", 3), ("G", "n1", 0, "c", "柵", "", 1),
    ]
    got = rows(line_diff.item_pairs(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "e", "id"), "left_id", "right_id", "pass")
    assert got == [("l1", "r2", 1), ("l2", "r1", 2), ("l3", "r3", 2), ("l4", "r4", 4), ("l5", "r5", 5), ("l6", "r6", 6), ("l7", "r7", 1), ("l8", "r8", 7), ("l9", "r9", 8)]
    sums = spark.createDataFrame([("小計",), ("・、",), (None,), ("架台",)], "t string")
    assert rows(line_diff.items_alone(sums, "t")) == [("架台",)]


def test_zip_and_residue(spark):
    schema = "g string, k string, id int, v int"
    left = spark.createDataFrame([("a", "x", 1, 5), ("a", "x", 2, 6), ("a", None, 3, 7), ("b", "z", 4, 8)], schema)
    right = spark.createDataFrame([("a", "x", 11, 5), ("a", None, 13, 9)], schema)
    pairs = line_diff.zip_pairs(left, right, ["g", "k"], "id", ["id", "v"])
    assert rows(pairs, "left_id", "right_id") == [(1, 11), (3, 13)]
    assert rows(line_diff.residue(left, pairs, "id", "left"), "id") == [(2,), (4,)]
    assert rows(line_diff.changes(pairs, ["v"]), "left_id", "old_value", "new_value") == [(3, "7", "9")]


def test_upsert_keeps_identity(spark):
    schema = "key string, id string, value int, seq int"
    old = spark.createDataFrame([("a", "A1", 1, 1), ("b", "B1", 2, 2)], schema)
    new = spark.createDataFrame([("a", "A2", 7, 3), ("a", "A3", 8, 4), ("c", "C1", 9, 5)], schema)
    assert rows(rules.upserted(old, new, ["key"], "seq", ["id"]), "key", "id", "value") == [("a", "A1", 8), ("b", "B1", 2), ("c", "C1", 9)]
    empty = spark.createDataFrame([], schema)
    assert rules.upserted(empty, empty, ["key"], "seq", ["id"]).count() == 0


def test_edits(spark):
    lines = spark.createDataFrame([("e", 0, "c", "架台", 2.0, 100, 200), ("e", 1, "c", "架台レール", 1.0, 50, 50), ("f", 0, "c", "x", 1.0, 1, 1)], edits.LINES)
    commands = spark.createDataFrame([("e", 1, "set_price", "架台", None, 120.0), ("e", 2, "remove", "レール", None, None), ("e", 3, "add", "保険", "d", 3.0), ("e", 4, "dance", "架台", None, 1.0), ("g", 1, "add", "new", "c", 1.0)], "estimate_id string, seq int, action string, target string, category string, number double")
    got = rows(edits.replayed(lines, commands), "estimate_id", "description", "amount")
    assert got == [("e", "保険", 0), ("e", "架台", 240), ("f", "x", 1), ("g", "new", 0)]


def test_csv_round_trip(spark, tmp_path):
    lines = spark.createDataFrame([("E1", 0, "設置", 1, '架台, "特"', "備考\n二行", "3台", 100, 300), ("E1", 1, "電材", 2, "線", "", "1.5m", None, 20)], "estimate_id string, pos int, category string, no int, description string, remarks string, quantity string, unit_price long, amount long")
    headers = spark.createDataFrame([("E1", 320, -20, 300, 30, 330)], "estimate_id string, subtotal long, discount long, total_before_tax long, tax long, total_with_tax long")
    made = estimate_csv.written(lines, headers, "estimate_id").first().text
    assert made.startswith("﻿category,no") and "\r\n" in made
    (tmp_path / "e.csv").write_bytes(made.encode())
    read = estimate_csv.csv_rows(spark, str(tmp_path))
    got = rows(estimate_csv.lines(read), "category", "no", "description", "remarks", "quantity_value", "quantity_unit", "unit_price", "amount")
    assert got == [("設置", 1, '架台, "特"', "備考\n二行", 3.0, "台", 100, 300), ("電材", 2, "線", "", 1.5, "m", None, 20)]
    assert estimate_csv.totals(read).select("subtotal", "discount", "total_with_tax").first() == (320, -20, 330)


def test_csv_sections(spark, tmp_path):
    (tmp_path / "d.csv").write_text("=== 基本情報 ===\n顧客,A\n=== 明細 ===\n設置,1,架台,,2台,10,20\n=== 合計 ===\n小計,20\n値引,5\n=== 算出根拠 ===\nx,1,y,,1,1,1\n")
    read = estimate_csv.csv_rows(spark, str(tmp_path))
    assert rows(estimate_csv.lines(read), "description", "amount") == [("架台", 20)]
    assert estimate_csv.totals(read).select("subtotal", "discount").first() == (20, -5)


def test_json_store(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"products": [{"id": 1}, {"id": 2}]}')
    (tmp_path / "b.json").write_text('[{"id": 3}]')
    (tmp_path / "c.json").write_text("{damaged")
    docs = json_store.documents(spark, str(tmp_path))
    assert rows(json_store.listed(docs, "products", "struct<id:int>"), "id") == [(1,), (2,), (3,)]
    one = spark.createDataFrame([(1, '{"a": {"b": null, "c": [1]}, "d": {}}')], "k int, t string").select("k", F.parse_json("t").alias("doc"))
    assert rows(json_store.leaf_paths(one, "k", "doc"), "path", "value") == [("a.b", None), ("a.c", "[1]"), ("d", "{}")]
    found = json_store.read_by_path(one, "doc", "a.b").first()
    assert found.value is None and found.is_present
    assert not json_store.read_by_path(one, "doc", "a.x").first().is_present


NESTED = [
    (1, '{"summary": {"categories": [{"items": [{"a": 1}, null, {"a": 1}]}, null, {"items": {"a": 2}}, {}, 5]}}', {("category", 0, -1), ("category_item", 0, 0), ("category_item", 0, 2), ("category", 2, -1), ("category_item", 2, 0), ("category", 3, -1)}),
    (2, '﻿{"estimate": "{\\"items\\": [{\\"tags\\": [{\\"items\\": [{}]}]}]}"}', {("parsed_item", -1, 0)}),
    (3, '"{\\"payload\\": {\\"parsed\\": {\\"items\\": {\\"x\\": 1}}}}"', {("parsed_item", -1, 0)}),
    (4, '{"summary": {"categories": {"items": [{}, {}]}}}', {("category", 0, -1), ("category_item", 0, 0), ("category_item", 0, 1)}),
    (5, '{"items": [{"a": 1}, {"a"', set()),
    (6, "", set()),
    (7, None, set()),
    (8, "[]", set()),
    (9, '{"items": [NaN]}', set()),
    (10, '{"equipment_purchase_snapshot": [{"items": [{}]}], "items": null}', set()),
    (11, "[" * 5000, set()),
    (12, '{"items": [' + '{"x": ' * 60_000 + "1" + "}" * 60_000 + "]}", {("parsed_item", -1, 0)}),
    (13, '{"summary": {"categories": [{"items": [' + "[" * 60_000 + "]" * 60_000 + ', {"a": 1}]}, null, {"items": {}}]}}', {("category", 0, -1), ("category_item", 0, 1), ("category", 2, -1), ("category_item", 2, 0)}),
]


def test_all_edit_actions(spark):
    heads = spark.createDataFrame([("e", "甲社", "工事", "60日", 0), ("f", "乙社", "別", None, -5)], "estimate_id string, client_name string, project_name string, validity_period string, discount long")
    items = spark.createDataFrame(
        [("e", 1, "支給品", 1, "太陽光パネル 540W", "", "288枚", 288.0, "枚", 0, 0), ("e", 2, "材料費", 1, "ケーブルラック", "", "30m", 30.0, "m", 5000, 150000), ("e", 2, "材料費", 2, "電線管", "北棟", "50m", None, "m", 800, 40000), ("e", 3, "施工費", 1, "架台組立工事", None, "1式", 1.0, "式", 500000, 500000), ("f", 1, "支給品", 1, "x", "", "1", 1.0, "", 7, 7)],
        edits.ITEMS,
    )
    none = (None,) * 7
    commands = [
        ("e", 1, "update_unit_price", "支給", "太陽光パネル", "100", *none[:5]), ("e", 2, "update_unit_price", "材料費", "北棟", "1000", *none[:5]), ("e", 3, "delete_item", "材料費", "ケーブルラック", None, *none[:5]), ("e", 4, "set_discount", None, None, "-50000", *none[:5]),
        ("e", 5, "set_client_name", None, None, "丙商事", *none[:5]), ("e", 6, "update_quantity", "施工費", "大きな架台組立工事です", "2", "式", *none[:4]), ("e", 7, "add_item", "材料費", None, None, None, "圧着端子", "100個", 50, None), ("e", 8, "delete_item", "支給品", "ない", None, *none[:5]),
        ("e", 9, "unknown", *none, None), ("e", 10, "update_amount", "諸経費", "x", "5", *none[:5]), ("e", 11, "update_unit_price", "材料費", "電線管", "多い", *none[:5]), ("e", 12, "update_remarks", "材料費", "電線管", "南棟", *none[:5]), ("e", 13, "set_project_name", None, None, "", *none[:5]), ("e", 14, "update_description", "材料費", "電線管", "PF管", *none[:5]),
    ]
    totals, lines, log = edits.edited(heads, items, spark.createDataFrame(commands, edits.COMMANDS))
    assert [r.outcome for r in log.orderBy("seq").collect()] == ["done"] * 7 + ["no line", "unknown", "no category", "no value", "done", "no value", "done"]
    assert rows(lines.where("estimate_id = 'e'"), "category", "no", "description", "remarks", "quantity", "amount") == sorted([("支給品", 1, "太陽光パネル 540W", "", "288枚", 28800), ("材料費", 1, "PF管", "南棟", "50m", 50000), ("材料費", 2, "圧着端子", "", "100個", 5000), ("施工費", 1, "架台組立工事", None, "2式", 1000000)], key=repr)
    assert rows(totals, "estimate_id", "client_name", "project_name", "discount", "subtotal", "total_before_tax", "tax", "total_with_tax") == [("e", "丙商事", "工事", -50000, 1083800, 1033800, 103380, 1137180), ("f", "乙社", "別", -5, 7, 2, 0, 2)]
    assert rows(edits.edited(heads, items, spark.createDataFrame([], edits.COMMANDS))[1], "estimate_id") == [("e",)] * 4 + [("f",)]


def test_estimate_diff(spark):
    schema = "estimate string, id long, pos int, category string, description string, remarks string, quantity_value double, quantity_unit string, unit_price long, amount long"
    ai = [("e", 1, 0, "施工費", "架台据付", "", 2.0, "式", 100, 200), ("e", 2, 1, "支給品", "パネル", "", 1.0, "枚", 0, 0), ("e", 3, 2, "施工費", "配線", "", 10.0, "m", 50, 500), ("e", 4, 3, "施工費", "足場", "", 1.0, "式", 900, 900), ("e", 5, 4, "施工費", "小計", "", 1.0, "式", 1, 1), ("e", 6, 5, "材料費", "端子", "", 1.0, "個", 9, 9), ("e", 7, 6, "施工費", "試験", "", 4.0, "回", 30, 120)]
    official = [("e", 11, 0, "施工費", "架台 据付", None, 2.0, "式", 120, 240), ("e", 12, 1, "支給品", "パネル", "", 3.0, "枚", 7, 21), ("e", 13, 2, "", "配線", "", 1.0, "式", 700, 700), ("e", 14, 3, "施工費", "清掃費", "", 2.0, "式", None, 11), ("e", 15, 4, "特記事項", "保険", "", 1.0, "式", 5, 5), ("e", 16, 5, "施工費", "清掃費", "", 1.0, "式", 6, 6), ("e", 17, 6, "施工費", "試験", "", 4.0, "回", 30, 120)]
    got = rows(line_diff.estimate_diff(spark.createDataFrame(ai, schema), spark.createDataFrame(official, schema), "estimate", "id"), "diff_type", "left_id", "right_id", "old_value", "new_value", "learnable")
    assert got == sorted([
        ("price_changed", 1, 11, "100", "120", True), ("quantity_changed", 2, 12, "1.0", "3.0", False), ("price_changed", 3, 13, "50", "70", True), ("quantity_changed", 3, 13, "10.0", "1.0", False),
        ("item_added", None, 14, None, "6", True), ("item_added", None, 15, None, "5", False), ("item_added", None, 16, None, "6", False), ("item_removed", 4, None, "900", None, True), ("item_removed", 6, None, "9", None, False),
    ], key=repr)
    assert line_diff.estimate_diff(spark.createDataFrame([], schema), spark.createDataFrame(official, schema), "estimate", "id").count() == 7


def test_nested_records(spark):
    data = [(i, t, "x") for i, t, _ in NESTED] + [(1, NESTED[0][1], "again"), (None, NESTED[0][1], "x")]
    df = spark.createDataFrame(data, "id long, payload string, path string")
    got = {}
    for r in nested_records.estimate_children(df).collect():
        got.setdefault(r.history_id, set()).add((r.child_kind, r.category_pos, r.item_pos))
    assert got == {i: want for i, _, want in NESTED if want}
    found = nested_records.places(df.where("id < 12"), "id", "payload")
    objects = nested_records.distinct_objects(found)
    assert objects.count() == found.select("object_id").distinct().count() < found.count()
    linked = nested_records.links(found)
    assert linked.count() == found.count()
    assert linked.where("parent >= 0 and parent_id is null").count() == 0
    assert nested_records.estimate_children(df.limit(0)).count() == 0


def test_deep_parser_reads_what_json_reads():
    for t in ("[]", "{}", '[1,2,{"a":"b\\"c"}]', ' {"a" : [ ] , "b":{}} ', '"x"', "-1.5e3", "true", '[null,false,{"k":[[],{}]}]'):
        assert nested_records._parse_deep(t) == json.loads(t)
    for t in ("", "[1,]", '{"a":1,}', "[1 2]", '{"a"}', "[", "{", "1 2", "[1]]", "nul", "{,}", '{"a":1', "NaN"):
        with pytest.raises(ValueError):
            nested_records._parse_deep(t)


def test_equal_objects_have_one_identity(spark):
    df = spark.createDataFrame([(1, '{"items": [{"b": 1, "a": [{"c": 2}]}, {"a": [{"c": 2}], "b": 1}, {"a": [{"c": 3}], "b": 1}]}')], "id long, payload string")
    ids = [r.object_id for r in nested_records.places(df, "id", "payload").where("path = 'items[]'").orderBy("occurrence").collect()]
    assert ids[0] == ids[1] != ids[2]


def test_catalog_edges(spark):
    p = spark.createDataFrame([(1, "a b", "X"), (2, "", "Y"), (3, None, "Y")], "id int, name string, maker string")
    assert catalog.search(p, ["name", "maker"], "", ["id"], 10).count() == 3
    assert catalog.search(p, ["name", "maker"], "a", ["id"], 0).count() == 0
    assert rows(catalog.first_seen(p, "name", "id"), "name", "first_pos") == [("a b", 1)]
    prefixes = spark.createDataFrame([("LR", "l"), ("LR5", "m")], "prefix string, meaning string")
    typed = spark.createDataFrame([(1, "LR5-72"), (2, "LRX"), (3, "Z"), (4, None), (5, "")], "id int, model string")
    assert rows(catalog.longest_prefix(typed, "model", "id", prefixes), "id", "meaning") == [(1, "m"), (2, "l")]


def most_rows(df):
    """The rows of a frame, and the most that any step of its plan gave."""
    found, most, open_ = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            open_.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            open_.append(node.plan())
        else:
            open_ += [node.children().apply(k) for k in range(node.children().size())]
        if node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
    return found, most


def test_nearest_within_by_brute_force(spark):
    import random

    rng = random.Random(5)
    near_zero = [0.0, -1e-17, 1e-17, 5e-17, -0.2, 0.1 + 0.2, 0.3, 5.0, -5.0, 5.1, 10.0, 1e17, 1e300, float("inf"), float("nan"), None]
    draw = lambda: rng.choice([rng.choice(near_zero), rng.uniform(-30, 30), rng.randrange(-60, 60) / 2, float(rng.randrange(-9, 9) * 5)])
    left = [(k, rng.choice(["a", "b", None]), draw()) for k in range(300)] + [(300, "d", 5.1), (301, "a", 5.1), (301, "a", 7.7)]
    right = [(rng.randrange(40) if k % 9 else None, rng.choice(["a", "b", "c", None]), draw()) for k in range(90)] + [(7, "d", 0.1 + 0.2), (9, "d", 0.3)]
    wanted = {}
    for k, block, v in left:
        for other, its, t in right:
            if block is not None and block == its and v is not None and t is not None and abs(v - t) <= 5.0:
                wanted[k] = min(wanted.get(k, (9.0, True, 0)), (abs(v - t), other is None, other or 0))
    a = spark.createDataFrame(left, "id long, kind string, v double")
    b = spark.createDataFrame(right, "other long, kind string, t double")
    got = {r.id: (r.distance, r.other is None, r.other or 0) for r in catalog.nearest_within(a, b, "kind", "v", "t", 5.0, "id", "other").collect()}
    assert got == wanted
    assert got[300] == (4.8, False, 7)


def test_nearest_within_does_not_pair_rows_of_a_value(spark):
    a = spark.range(3000).select("id", F.lit("x").alias("kind"), (F.lit(7.0) + F.col("id") % 2).alias("v"))
    b = spark.range(3000).select(F.col("id").alias("other"), F.lit("x").alias("kind"), (F.lit(8.0) + F.col("id") % 3 / 100).alias("t"))
    found, most = most_rows(catalog.nearest_within(a, b, "kind", "v", "t", 5.0, "id", "other"))
    assert {(r.other, r.distance) for r in found if r.id % 2} == {(0, 0.0)} and {(r.other, r.distance) for r in found if r.id % 2 == 0} == {(0, 1.0)}
    assert len(found) == 3000 and most <= 3000


def test_resolved_products_by_brute_force(spark):
    import random

    rng = random.Random(6)
    codes, makers, models = ["", " ", None, "c1", "C1 ", "c2"], ["", None, "m", " M", "n"], ["", None, "x", "X ", "y", "z"]
    some = lambda: (rng.choice(codes), rng.choice(makers), rng.choice(models))
    products = [(k, *some(), rng.choice([True, False, None]), rng.choice([1, 2, None])) for k in range(60)]
    requests = [(k % 190, *some()) for k in range(200)]
    plain = lambda t: (t or "").strip().lower()
    wanted = {}
    for request, *asked in requests:
        code, maker, model = map(plain, asked)
        for product, c, m, n, canonical, page in products:
            steps = [code and code == plain(c), model and maker and (model, maker) == (plain(n), plain(m)), model and not maker and model == plain(n)]
            for step, fits in enumerate(steps, 1):
                if fits:
                    hit = (step, {True: 0, False: 1, None: 2}[canonical], page is None, page or 0, product)
                    wanted[request] = min(wanted.get(request, (9,)), hit)
    asked = spark.createDataFrame(requests, "request_id long, code string, maker string, model string")
    known = spark.createDataFrame(products, "product_id long, code string, maker string, model string, is_canonical boolean, page int")
    found = catalog.resolved_products(asked, known).collect()
    assert sorted((r.request_id, r.product_id, r.step) for r in found) == sorted((k, w[-1], w[0]) for k, w in wanted.items())


def test_resolved_products_do_not_pair_rows_of_a_model(spark):
    asked = spark.range(3000).select(F.col("id").alias("request_id"), F.when(F.col("id") < 1000, "K").otherwise("").alias("code"), F.when(F.col("id") < 2000, "m").otherwise("").alias("maker"), F.lit("x").alias("model"))
    known = spark.range(3000).select(F.col("id").alias("product_id"), F.lit("k").alias("code"), F.lit("M").alias("maker"), F.lit("X").alias("model"), (F.col("id") % 7 == 6).alias("is_canonical"), (F.lit(5) - F.col("id") % 5).alias("page"))
    found, most = most_rows(catalog.resolved_products(asked, known))
    assert sorted((r.request_id, r.product_id, r.step) for r in found) == [(k, 34, k // 1000 + 1) for k in range(3000)]
    assert most <= 6000


def test_registry_matches_know_aliases_and_parts(spark):
    products = spark.createDataFrame([("a", "NGE-66H-670", ["NGE66H670"]), ("b", "SUN2000-50KTL", None), ("c", None, ["", None]), ("d", "XX-670", [])], "candidate_id string, model string, model_aliases array<string>")
    typed = spark.createDataFrame([(1, "NGE66H670"), (2, "sun200"), (3, "架台 SUN2000-50KTL 用"), (4, "66-h"), (5, ""), (6, None), (7, "NGE 670")], "request_id int, query string")
    got = {(r.request_id, r.candidate_id): r.score for r in catalog.registry_matches(typed, products).collect()}
    assert got == {(1, "a"): 10.0, (2, "b"): 6 + 6 / 13, (3, "b"): 4 + 13 / 18, (7, "a"): pytest.approx(1 + 3 * 2 / 3), (7, "d"): pytest.approx(1 + 3 / 3)}
    with pytest.raises(ValueError):
        catalog.registry_matches(typed, products, most=2)


def test_rollup_edges(spark):
    df = spark.createDataFrame([(-15000,), (9999,), (0,), (None,)], "s long")
    got = [r.d for r in df.select(estimates.discount_down_to(F.col("s"), 10_000).alias("d")).collect()]
    assert got == [-5000, -9999, 0, None]
    taxes = spark.createDataFrame([(25,), (35,), (-25,)], "t long")
    assert [tuple(r) for r in taxes.select(*[estimates.tax_of(F.col("t"), 10, m) for m in ("floor", "round", "ceil")]).collect()] == [(2, 2, 3), (3, 4, 4), (-3, -2, -2)]


def test_findings_and_answers(spark):
    df = spark.createDataFrame([(1, None, 900.0), (2, "m", 500.0)], "id int, model string, w double")
    got = rows(quality.findings(df, "id", [quality.required("model", F.col("model")), quality.in_range("w", F.col("w"), 200, 800)]), "id", "field", "code")
    assert got == [(1, "model", "missing"), (1, "w", "out_of_range")]
    long = spark.createDataFrame([(1, "a", "x"), (1, "b", "y")], "id int, field string, value string")
    answers = spark.createDataFrame([(1, "a", "z")], "id int, field string, value string")
    assert rows(quality.applied(long, "id", answers), "field", "value", "changed") == [("a", "z", True), ("b", "y", False)]


def test_accuracy_and_delivery(spark):
    v = spark.createDataFrame([("c1", "f1", "correct"), ("c1", "f2", "wrong")], "c string, f string, verdict string")
    assert rows(evaluation.accuracy(v, "c", "f"), "c", "f", "correct", "total") == [("c1", None, 1, 2), (None, "f1", 1, 1), (None, "f2", 0, 1), (None, None, 1, 2)]
    d = spark.createDataFrame([("a", 1, "2024-01-01"), ("a", 2, "2024-02-01"), (None, 3, None)], "k string, v int, ingested_at string")
    assert rows(latest_delivery(d, "k"), "k", "v") == [("a", 2), (None, 3)]


def test_streams(spark, tmp_path, sample_dir):
    from heliotable.streaming import upserts

    source = tmp_path / "in"
    spark.read.parquet(f"{sample_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(str(source))
    schema = spark.read.parquet(str(source)).schema
    counted = upserts.windowed_counts(upserts.file_stream(spark, str(source), schema), "ts", "event_type", "value")
    q = counted.writeStream.outputMode("append").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("counted").count() > 0
    once = upserts.first_deliveries(upserts.file_stream(spark, str(source), schema), "ts", ["user_id"])
    q = once.writeStream.outputMode("append").format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() <= spark.read.parquet(str(source)).count()


def test_json_repair(spark):
    from heliotable.functions.json_repair import repaired, repaired_json

    cases = {
        'Here: ```json\n{"a": 1,}\n```': '{"a":1}',
        "{'a': 'it\\'s \"x\"', 'b': None, /* c */ 'd': [True, False,],} // end": '{"a":"it\'s \\"x\\"","b":null,"d":[true,false]}',
        '{"url": "http://x//y", "n": NaN}': '{"url":"http://x//y","n":null}',
        'text before {"a": {"b": "}"}} text after }': '{"a":{"b":"}"}}',
        "[1, 2, // two\n 3]": "[1,2,3]",
        "nothing": None,
        "": None,
        '{"a": ': None,
    }
    assert {t: repaired(t) for t in cases} == cases
    df = spark.createDataFrame([(t,) for t in [*cases, None]], "t string")
    assert [r.r for r in df.select(repaired_json("t").alias("r")).collect()] == [*cases.values(), None]


def test_forms(spark):
    from heliotable.operators import forms

    cells = spark.createDataFrame([("f", 1, 1, "住所：東町1"), ("f", 2, 1, "担当"), ("f", 2, 4, "山田"), ("f", 3, 1, "備考"), ("f", 3, 9, "遠い"), ("f", 4, 1, "担当"), ("f", 4, 2, "二番目"), ("f", 5, 1, None)], "file string, row int, col int, value string")
    assert rows(forms.values_beside_labels(cells, ["住所", "担当", "備考"]), "label", "value") == [("住所", "東町1"), ("担当", "山田")]
    df = spark.createDataFrame([({"a": "未確認", "b": "x", "c": "未確認"}, {"a": "1", "b": "2", "c": "3", "d": "4"})], "base map<string,string>, extra map<string,string>")
    got = df.select(forms.filled_in(F.col("base"), F.col("extra"), ["c"]).alias("m"), forms.unconfirmed(F.col("base")).alias("u"), forms.with_value(F.col("base"), "b", F.lit("y")).alias("w")).first()
    assert got.m == {"a": "1", "b": "x", "c": "未確認"} and got.u == ["a", "c"] and got.w["b"] == "y"
    text = spark.createDataFrame([("パネル支給、PCSは対象外",), ("モジュール支給",), ("",), (None,)], "t string")
    assert [r.s for r in text.select(forms.supplied(F.col("t"), ["PCS", "モジュール"], ["対象外", "なし"]).alias("s")).collect()] == [False, True, False, False]
    assert [r.s for r in text.select(forms.keyword_class(F.col("t"), [("支給", "supply"), ("PCS", "pcs")], "other").alias("s")).collect()] == ["supply", "supply", "other", "other"]
    schema = "g string, name string, id int"
    left = spark.createDataFrame([("s", "南", 1), ("s", "北", 2), ("s", "東", 3)], schema)
    right = spark.createDataFrame([("s", "北", 12), ("s", "x", 13)], schema)
    assert rows(forms.paired_by_name_then_order(left, right, "g", "name", "id", "id")) == [(1, 13), (2, 12)]
    assert rows(forms.single_or(left.unionByName(right.withColumn("g", F.lit("t")).where("id = 12")), "g", "name", "*")) == [("s", "*"), ("t", "北")]
    linked = forms.linked_fields(spark.createDataFrame([(1, "郵便番号が不正"), (2, "?")], "id int, w string"), "id", "w", [("p.postal", "郵便番号"), ("p.address", "番号")])
    assert rows(linked, "id", "field") == [(1, "p.postal"), (2, None)]


def test_detailed_csv_round_trip(spark, tmp_path):
    lines = spark.createDataFrame([("E1", 0, "設置", 1, "架台", "", "3台", 100, 300), ("E1", 1, "電材", 2, "線", "a,b", "2m", 10, 20)], "estimate_id string, pos int, category string, no int, description string, remarks string, quantity string, unit_price long, amount long")
    headers = spark.createDataFrame([("E1", "客", 320, -20, 300, 30, 330)], "estimate_id string, client string, subtotal long, discount long, total_before_tax long, tax long, total_with_tax long")
    made = estimate_csv.written_detailed(lines, headers, "estimate_id", ["estimate_id", "client"]).first().text
    (tmp_path / "e.csv").write_bytes(made.encode())
    read = estimate_csv.csv_rows(spark, str(tmp_path))
    assert rows(estimate_csv.lines(read), "description", "remarks", "amount") == [("架台", "", 300), ("線", "a,b", 20)]
    assert estimate_csv.totals(read).select("subtotal", "discount", "tax").first() == (320, -20, 30)


def test_small_helpers(spark, tmp_path):
    from heliotable.functions import parsing, text
    from heliotable.operators import corrections
    from heliotable.sources import files

    df = spark.createDataFrame([("a {x} b {y}", 3, None)], "t string, x int, y string")
    assert df.select(text.filled_template(F.col("t"), {"x": F.col("x"), "y": F.col("y")}).alias("r")).first().r == "a 3 b "
    names = spark.createDataFrame([("ミナモ 食品", "ミナモ食品株式会社"), ("", "a"), (None, "a"), ("x", "y")], "a string, b string")
    assert [r.r for r in names.select(text.contain_each_other(F.col("a"), F.col("b")).alias("r")).collect()] == [True, False, False, False]
    dates = spark.createDataFrame([("2024-1-3",), ("2024年12月5日",), ("2024/13/1",), (None,)], "t string")
    assert [str(r.r) for r in dates.select(parsing.date_or_null(F.col("t")).alias("r")).collect()] == ["2024-01-03", "2024-12-05", "None", "None"]
    docs = spark.createDataFrame([('{"a": null, "z": 1}',), ("{bad",), (None,)], "t string")
    assert [tuple(r.r) for r in docs.select(parsing.with_defaults(F.col("t"), "a int, b string", {"a": 7, "b": "x"}).alias("r")).collect()] == [(7, "x")] * 3
    pieces = spark.createDataFrame([("g", 0.0, 0.0, 5.0), ("g", 10.0, 0.0, 5.0), ("g", 0.0, 9.0, 5.0), ("g", 10.0, 9.0, 5.0)], "g string, x double, y double, w double")
    assert rows(layout.adjacent_gaps(pieces, ["g", "y"]), "gap") == [(5.0,), (5.0,)]
    assert [(r.x, r.y) for r in layout.serpentine(pieces, ["g"]).orderBy("ordinal").collect()] == [(0.0, 0.0), (10.0, 0.0), (10.0, 9.0), (0.0, 9.0)]
    assert layout.first_pieces(pieces.withColumn("t", F.lit(3)), ["g"], ["y", "x"], "t").count() == 3
    assert layout.first_pieces(pieces.withColumn("t", F.lit(0)), ["g"], ["y", "x"], "t").count() == 4
    faces = spark.createDataFrame([("s", 0, 8, 465.0), ("s", 0, -1, 465.0), ("t", 4, 9, 465.0)], "s string, placed int, target int, w double")
    assert rows(layout.placed_totals(faces, "s", "placed", "target", "w"), "s", "pieces", "kw") == [("s", 8, 3.72), ("t", 4, 1.86)]
    short = spark.createDataFrame([(5, 100.0)], "m int, size double").select(layout.shortage(F.col("m"), F.col("size"), F.lit(10.0), F.lit(4)).alias("r")).first().r
    assert short == 220.0
    texts = spark.createDataFrame([("e", 2, "b"), ("e", 1, "a"), ("e", 3, " "), ("e", 4, None)], "e string, pos int, t string")
    assert estimates.ordered_texts(texts, "e", "pos", "t").first().texts == ["a", "b"]
    survey = spark.createDataFrame([("s", ("〒100-0005 東町", "", "R7.12.18"), (661.0, 100, 100.0))], "survey_id string, project struct<address:string,postal_code:string,survey_date:string>, equipment struct<module_output_w:double,planned_panels:bigint,pv_capacity_kw:double>")
    assert rows(corrections.corrections(survey), "field", "new_value") == [("module_output_w", "660.0"), ("postal_code", "100-0005"), ("pv_capacity_kw", "66.1"), ("survey_date", "2025/12/18")]
    for name in ("a/x.xlsx", "a/2.pdf", "a/1.pdf", "b/y.xlsx"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    pairs = files.paired(files.listed(spark, str(tmp_path), "*.xlsx"), files.listed(spark, str(tmp_path), "*.pdf"))
    assert sorted((r.left_path[-6:], (r.right_path or "")[-5:]) for r in pairs.collect()) == [("x.xlsx", "1.pdf"), ("y.xlsx", "")]
    table = files.yaml_table(spark, str(tmp_path / "none.yaml"), "items", "a int")
    assert table is None or table.count() == 0
