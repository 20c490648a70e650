"""Ordered edit commands replayed on lines, one estimate at a time.

A later command sees what earlier ones did, so the commands of one estimate are
one ordered fold in pandas; estimates are independent of each other. An
estimate and its commands are small; no other grouping is collected.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliotable.operators.estimates import tax_of
from heliotable.plans.durable import cut
from heliotable.plans.joins import spread

LINES = "estimate_id string, pos bigint, category string, description string, quantity double, unit_price bigint, amount bigint"


def _find(lines: pd.DataFrame, text: str) -> int | None:
    """The first line in order that equals a text, contains it, or is contained in it; in that order of kinds."""
    names = lines["description"].fillna("")
    for hit in (names == text, names.map(lambda n: bool(text) and text in n), names.map(lambda n: bool(n) and n in text)):
        if hit.any():
            return int(hit.to_numpy().argmax())
    return None


def _replay(key: tuple, lines: pd.DataFrame, commands: pd.DataFrame) -> pd.DataFrame:
    if lines.empty:
        lines = pd.DataFrame({c: [] for c in ("estimate_id", "pos", "category", "description", "quantity", "unit_price", "amount")})
    out = lines.sort_values("pos").reset_index(drop=True)
    for c in commands.sort_values("seq").itertuples(index=False):
        if c.action == "add":
            row = {"estimate_id": key[0], "pos": int(out["pos"].max()) + 1 if len(out) else 0, "category": c.category, "description": c.target, "quantity": c.number, "unit_price": 0, "amount": 0}
            out = pd.concat([out, pd.DataFrame([row])], ignore_index=True)
            continue
        at = _find(out, c.target or "") if len(out) else None
        if at is None:
            continue
        if c.action == "remove":
            out = out.drop(index=at).reset_index(drop=True)
        elif c.action == "set_price" and pd.notna(c.number):
            out.loc[at, "unit_price"] = int(c.number)
        elif c.action == "set_quantity" and pd.notna(c.number):
            out.loc[at, "quantity"] = float(c.number)
        else:
            continue
        if c.action != "remove":
            out.loc[at, "amount"] = int(out.loc[at, "quantity"] * out.loc[at, "unit_price"]) if pd.notna(out.loc[at, "quantity"]) and pd.notna(out.loc[at, "unit_price"]) else 0
    out["estimate_id"] = key[0]
    return out[["estimate_id", "pos", "category", "description", "quantity", "unit_price", "amount"]]


def replayed(lines: DataFrame, commands: DataFrame) -> DataFrame:
    """Lines after the commands ``estimate_id, seq, action, target, category, number`` in order of seq.

    Actions: set_price, set_quantity, remove, add; unknown actions and targets
    that no line fits are passed over. Estimates without commands stay as they are.
    """
    names = [x.split()[0] for x in LINES.split(", ")]
    keyed = lines.select(*names)
    touched = commands.select("estimate_id").distinct()
    rest = keyed.join(touched, "estimate_id", "left_anti")
    own = keyed.join(touched, "estimate_id", "left_semi")
    commands = commands.select(*[F.col(c).alias(c) for c in ("estimate_id", "seq", "action", "target", "category", "number")])
    done = own.groupBy("estimate_id").cogroup(commands.groupBy("estimate_id")).applyInPandas(_replay, LINES)
    return rest.unionByName(done)


# ---- all actions, within a category, with the estimate's head and a log --------------------------------------------

HEADS = ("estimate_id", "client_name", "project_name", "validity_period", "discount")
ITEMS = "estimate_id string, category_number int, category string, no int, description string, remarks string, quantity string, quantity_value double, quantity_unit string, unit_price bigint, amount bigint"
COMMANDS = "estimate_id string, seq bigint, action string, category string, item_match string, new_value string, new_unit string, description string, quantity string, unit_price bigint, amount bigint"
_ITEM_NAMES = [x.split()[0] for x in ITEMS.split(", ")]
_EDITED = f"part string, {ITEMS}, client_name string, project_name string, validity_period string, discount bigint, seq bigint, action string, outcome string"
_NUMBER = re.compile(r"[\d.]+")


def _whole(value: str | None) -> int | None:
    try:
        return int(str(value).strip())
    except (TypeError, ValueError):
        return None


def _real(value: str | None) -> float | None:
    try:
        return float(str(value).strip())
    except (TypeError, ValueError):
        return None


def _shown(x: float) -> str:
    return str(int(x)) if x == int(x) else str(x)


class _Estimate:
    """The lines of one estimate by category, in order of category and number."""

    def __init__(self, head: dict, items: list[dict]):
        self.head = head
        self.categories: dict[tuple[int, str], list[dict]] = {}
        for item in sorted(items, key=lambda i: (i["category_number"] or 0, i["no"] or 0)):
            self.categories.setdefault((item["category_number"], item["category"]), []).append(item)

    def category(self, name: str | None) -> list[dict] | None:
        """The category of that name, else the first of which one name begins with the other."""
        name = (name or "").strip()
        if not name:
            return None
        same = [v for (_, n), v in self.categories.items() if n == name]
        alike = [v for (_, n), v in self.categories.items() if n.startswith(name) or name.startswith(n)]
        return (same or alike or [None])[0]

    def item(self, category: str | None, text: str | None) -> dict | None:
        """The first line that equals a text, else holds it, else is held by it, else has it in its remarks."""
        items, text = self.category(category), (text or "").strip()
        if items is None or not text:
            return None
        of = lambda i, k: i[k] or ""
        steps = (lambda i: of(i, "description") == text, lambda i: text in of(i, "description"), lambda i: bool(i["description"]) and i["description"] in text, lambda i: text in of(i, "remarks"))
        return next((i for fits in steps for i in items if fits(i)), None)


def _change_line(e: _Estimate, c: dict) -> str:
    action, value = c["action"], c["new_value"]
    read = {"update_unit_price": _whole, "update_amount": _whole, "update_quantity": _real}.get(action, lambda v: v or "")(value)
    if read is None:
        return "no value"
    item = e.item(c["category"], c["item_match"])
    if item is None:
        return "no category" if e.category(c["category"]) is None else "no line"
    if action == "update_unit_price":
        item["unit_price"] = read
        stated = _NUMBER.search(item["quantity"] or "")
        quantity = item["quantity_value"] or (_real(stated[0]) if stated else None)
        if quantity is not None:
            item["amount"] = int(quantity * read)
    elif action == "update_quantity":
        item["quantity_value"], item["quantity_unit"] = read, c["new_unit"] or item["quantity_unit"]
        item["quantity"] = _shown(read) + (item["quantity_unit"] or "")
        if item["unit_price"]:
            item["amount"] = int(read * item["unit_price"])
    elif action == "update_amount":
        item["amount"] = read
    elif action in ("update_description", "update_remarks"):
        item[action.removeprefix("update_")] = read
    else:
        items = e.category(c["category"])
        del items[next(k for k, i in enumerate(items) if i is item)]
        for no, i in enumerate(items, 1):
            i["no"] = no
    return "done"


def _add_line(e: _Estimate, c: dict) -> str:
    if not c["description"]:
        return "no value"
    items = e.category(c["category"])
    if items is None:
        return "no category"
    key = next(k for k, v in e.categories.items() if v is items)
    quantity = "1式" if c["quantity"] is None else c["quantity"]
    m = re.match(r"\s*([\d.]+)\s*(.*)", quantity)
    number = (_real(m[1]) if m else None) or (0.0 if m and _real(m[1]) == 0 else 1.0)
    unit = (m[2] if m else quantity).strip() or "式"
    price, amount = c["unit_price"] or 0, c["amount"] or 0
    if not amount and price > 0:
        amount = int(number * price)
    # numbered by the count of lines, not by the greatest number
    items.append({"estimate_id": e.head["estimate_id"], "category_number": key[0], "category": key[1], "no": len(items) + 1, "description": c["description"], "remarks": "", "quantity": quantity, "quantity_value": number, "quantity_unit": unit, "unit_price": price, "amount": amount})
    return "done"


def _change_head(e: _Estimate, c: dict) -> str:
    field = c["action"].removeprefix("set_")
    value = _whole(c["new_value"]) if field == "discount" else c["new_value"] or None
    if value is None:
        return "no value"
    e.head[field] = value
    return "done"


#: What each action does; any other is unknown and changes nothing.
ACTIONS = dict.fromkeys(("update_unit_price", "update_quantity", "update_amount", "update_description", "update_remarks", "delete_item"), _change_line) | {"add_item": _add_line} | dict.fromkeys(("set_discount", "set_client_name", "set_project_name", "set_validity_period"), _change_head)


def _edit(key: tuple, both: pd.DataFrame, commands: pd.DataFrame) -> pd.DataFrame:
    plain = lambda df: [{k: None if v is None or v is pd.NA or v != v else v for k, v in r.items()} for r in df.astype(object).to_dict("records")]
    rows = plain(both)
    head = next((r for r in rows if r["part"] == "head"), {"estimate_id": key[0]})
    e = _Estimate({k: head.get(k) for k in HEADS} | {"estimate_id": key[0]}, [{k: r[k] for k in _ITEM_NAMES} for r in rows if r["part"] == "line"])
    log = []
    for c in plain(commands.sort_values("seq")):
        act = ACTIONS.get(c["action"])
        log.append({"part": "log", "estimate_id": key[0], "seq": c["seq"], "action": c["action"], "outcome": act(e, c) if act else "unknown"})
    out = [{"part": "head", **e.head}, *[{"part": "line", **i} for items in e.categories.values() for i in items], *log]
    names = [x.split()[0] for x in _EDITED.split(", ")]
    frame = pd.DataFrame(out).reindex(columns=names).astype(object)
    whole = {"category_number", "no", "unit_price", "amount", "discount", "seq"}
    return frame.assign(**{c: pd.array([None if v is None or v != v else int(v) for v in frame[c]], dtype="Int64") for c in whole}).where(lambda f: f.notna(), None)


def edited(heads: DataFrame, items: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(heads with totals, lines, log) after each estimate's commands in order of ``seq``.

    ``heads`` are ``HEADS``, ``items`` as ``ITEMS``, ``commands`` as
    ``COMMANDS``. Twelve actions: prices, quantities, amounts, descriptions,
    remarks and removals of a line, looked for within its category; added lines;
    discount, client, project and validity; and ``unknown``. The log tells of
    each command ``done``, ``no value``, ``no category``, ``no line`` or
    ``unknown``. Totals are those after the last command. A category whose last
    line is removed is still known to later commands. An estimate and its
    commands are one pandas call; estimates without commands are passed through.
    """
    none = [x for x in _EDITED.split(", ")]

    def whole(df: DataFrame, part: str) -> DataFrame:
        have = set(df.columns)
        return df.select(F.lit(part).alias("part"), *[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in (x.split() for x in none[1:])])

    both = whole(heads.select(*HEADS), "head").unionByName(whole(items.select(*_ITEM_NAMES), "line"))
    touched = commands.select("estimate_id").distinct()
    own, rest = both.join(spread(touched), "estimate_id", "left_semi").select(both.columns), both.join(spread(touched), "estimate_id", "left_anti").select(both.columns)
    orders = commands.select(*[F.col(x.split()[0]).cast(x.split()[1]).alias(x.split()[0]) for x in COMMANDS.split(", ")])
    done = cut(own.groupBy("estimate_id").cogroup(orders.groupBy("estimate_id")).applyInPandas(_edit, _EDITED).unionByName(rest))
    lines = done.where("part = 'line'").select(*_ITEM_NAMES)
    sums = lines.groupBy("estimate_id").agg(F.sum(F.coalesce("amount", F.lit(0))).alias("subtotal"))
    totals = done.where("part = 'head'").select(*HEADS).join(spread(sums), "estimate_id", "left").withColumn("subtotal", F.coalesce("subtotal", F.lit(0).cast("bigint")))
    totals = totals.withColumn("total_before_tax", F.col("subtotal") + F.coalesce("discount", F.lit(0))).withColumn("tax", tax_of(F.col("total_before_tax"))).withColumn("total_with_tax", F.col("total_before_tax") + F.col("tax"))
    return totals, lines, done.where("part = 'log'").select("estimate_id", "seq", "action", "outcome")
