"""Deeply nested semi-structured records as related flat tables (problem 6).

Method: Merkle subtree identities. Every object is written canonically with its
child objects replaced by their identities, bottom-up, and named by the hash of
that text. Identical objects are stored once; every place where one stands is
kept as a link row with its parent, its field and its ordinals.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliotable.plans.durable import cut
from heliotable.plans.joins import spread

#: Fields in which writers wrap the record proper.
WRAPPERS = ("estimate", "payload", "parsed")
#: Fields that mark the record proper, so nothing further is unwrapped.
PROPER = ("summary", "items", "cover")

PLACES = "record_id bigint, occurrence int, parent int, path string, ordinals array<int>, field string, object_id string, body string"
_NAMES = [x.split()[0] for x in PLACES.split(", ")]

_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r'"(?:[^"\\\x00-\x1f]|\\.)*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null', re.S)


def _not_json(name: str):
    raise ValueError(f"{name} is no JSON value")


def _parse_deep(text: str):
    """The value of a JSON text of any depth, with a stack of open containers in place of recursion. ValueError for no JSON."""
    at, root = 0, []
    open_ones: list = [root]  # lists and objects not closed yet; the outermost holds the value
    keys: list[str | None] = [None]
    want = "value"  # or "first" (value or ]), "key", "first key" (key or }), "after"
    while True:
        at = _SPACE.match(text, at).end()
        holder, c = open_ones[-1], text[at : at + 1]
        if want == "after":
            if holder is root:
                break
            closing = "]" if isinstance(holder, list) else "}"
            if c not in (",", closing) or not c:
                raise ValueError("no separator")
            at += 1
            if c == closing:
                open_ones.pop()
                keys.pop()
            else:
                want = "value" if closing == "]" else "key"
            continue
        if (want == "first" and c == "]") or (want == "first key" and c == "}"):
            at, want = at + 1, "after"
            open_ones.pop()
            keys.pop()
            continue
        if want in ("key", "first key"):
            m = _SCALAR.match(text, at) if c == '"' else None
            at = _SPACE.match(text, m.end()).end() if m else at
            if not m or text[at : at + 1] != ":":
                raise ValueError("no key")
            keys[-1], at, want = json.loads(m[0]), at + 1, "value"
            continue
        if c in ("{", "[") and c:
            value: object = {} if c == "{" else []
            at += 1
        else:
            m = _SCALAR.match(text, at)
            if not m:
                raise ValueError("no value")
            value, at = json.loads(m[0]), m.end()
        if isinstance(holder, list):
            holder.append(value)
        else:
            holder[keys[-1]] = value
        want = "after"
        if c in ("{", "[") and c:
            open_ones.append(value)
            keys.append(None)
            want = "first key" if c == "{" else "first"
    if at != len(text):
        raise ValueError("more than one value")
    return root[0]


def parse_complete(text: str | None):
    """The value of a complete JSON text, of any depth, which may begin with a byte order mark; None for any other text."""
    if not text:
        return None
    plain = text.removeprefix("\ufeff")
    try:
        return json.loads(plain, parse_constant=_not_json)
    except RecursionError:
        try:
            return _parse_deep(plain)
        except ValueError:
            return None
    except ValueError:
        return None


def unwrap(value, wrappers: Sequence[str] = WRAPPERS, proper: Sequence[str] = PROPER):
    """The record proper: texts holding JSON are read, wrapping objects are opened, however many. None where there is none.

    Each step looks at a smaller part of the text, so it ends.
    """
    while True:
        if isinstance(value, str):
            value = parse_complete(value)
        elif isinstance(value, dict) and not any(k in value for k in proper):
            inner = [value[w] for w in wrappers if w in value and isinstance(value[w], (dict, str))]
            if not inner:
                return value
            value = inner[0]
        else:
            return value


_canonical = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":"), check_circular=False).encode


def _written(body: dict) -> str:
    """The canonical text of an object whose child objects are replaced; arrays within arrays may be deeper than the encoder goes."""
    try:
        return _canonical(body)
    except RecursionError:
        out: list[str] = []
        todo: list = [body]
        while todo:  # texts stand for themselves as (text,)
            v = todo.pop()
            if isinstance(v, tuple):
                out.append(v[0])
            elif isinstance(v, list):
                todo.append(("]",))
                for i in reversed(range(len(v))):
                    todo.append(v[i])
                    if i:
                        todo.append((",",))
                todo.append(("[",))
            elif isinstance(v, dict):
                todo.append(("}",))
                for i, k in reversed(list(enumerate(sorted(v)))):
                    todo += [v[k], (("," if i else "") + _canonical(k) + ":",)]
                todo.append(("{",))
            else:
                out.append(_canonical(v))
        return "".join(out)


def _since(place: tuple | None, above: tuple | None) -> list[int]:
    """The ordinals of a place, kept as a chain from the innermost outwards, that lie below another place of the chain."""
    own = []
    while place is not above:
        place, i = place
        own.append(i)
    return own[::-1]


def objects_of(value, whole: bool = True) -> list[tuple]:
    """(occurrence, parent, path, ordinals, field, object_id, body) of every object in a value, parents first.

    A lone object where others have an array has no ordinal of its own; a null
    or scalar entry of an array makes no row but counts in the ordinals. The
    objects are walked with a stack, so depth is no bound. Unless ``whole``,
    bodies are null, paths '' and ordinals those below the parent alone; in whole, both grow
    with the depth.
    """
    out: list[list] = []
    made: list = []  # lists and objects that are done, in order of being done: objects by their identity
    # scalars stay where they stand; only lists and objects go over the stack, first to be opened, then to be closed
    todo: list[tuple] = [(False, value, -1, "", None, "")] if isinstance(value, (dict, list)) else []
    while todo:
        done, v, parent, path, place, field = todo.pop()
        is_list = type(v) is list
        inner = [k for k in (range(len(v)) if is_list else sorted(v)) if isinstance(v[k], (dict, list))]
        if not done:
            me = parent
            if not is_list:
                me = len(out)
                out.append([me, parent, path, place, field, None, None])
            todo.append((True, v, me, path, place, field))
            for k in reversed(inner):
                if is_list:
                    todo.append((False, v[k], me, path + "[]" if whole else "", (place, k), field))
                else:
                    todo.append((False, v[k], me, (f"{path}.{k}" if path else k) if whole else "", place, k))
            continue
        body = v.copy()
        for k in reversed(inner):
            body[k] = made.pop()
        if is_list:
            made.append(body)
            continue
        text = _written(body)
        out[parent][5] = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
        if whole:
            out[parent][6] = text.encode("utf-8", "replace").decode()
        made.append({"$object": out[parent][5]})
    return [(*r[:3], _since(r[3], None if whole or r[1] < 0 else out[r[1]][3]), *r[4:]) for r in out]


def _flatten(wrappers: Sequence[str], proper: Sequence[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for record, payload in zip(pdf["record_id"], pdf["payload"]):
                rows += [(record, *r) for r in objects_of(unwrap(payload, wrappers, proper))]
            yield pd.DataFrame(rows, columns=_NAMES)

    return run


def places(records: DataFrame, record_id: str, payload: str, wrappers: Sequence[str] = WRAPPERS, proper: Sequence[str] = PROPER) -> DataFrame:
    """One row for every place of an object in a record's JSON text.

    ``occurrence`` numbers the objects of a record, parents first (0 is the
    record proper, parent -1); ``path`` names the fields with ``[]`` for each
    array; ``ordinals`` are the places in those arrays, from 0. Records
    delivered again are read once; those with null, empty, damaged or scalar
    text have no rows.
    """
    rows = records.select(F.col(record_id).cast("long").alias("record_id"), F.col(payload).alias("payload")).where("record_id is not null and payload <> ''")
    return rows.dropDuplicates(["record_id"]).mapInPandas(_flatten(tuple(wrappers), tuple(proper)), PLACES)


def distinct_objects(found: DataFrame) -> DataFrame:
    """``object_id, body, uses``: each distinct object once. Repeats are combined before the shuffle."""
    return found.groupBy("object_id").agg(F.first("body").alias("body"), F.count("*").alias("uses"))


def links(found: DataFrame) -> DataFrame:
    """Bridge rows: which object stands where in which parent object."""
    child = found.select("record_id", "occurrence", "parent", "field", "ordinals", "path", "object_id")
    parent = found.select("record_id", F.col("occurrence").alias("parent"), F.col("object_id").alias("parent_id"))
    return child.join(spread(parent), ["record_id", "parent"], "left")


# ---- the store of distinct objects and its bridge -----------------------------------------------------------------

_MERKLE = "record_id bigint, parent_id string, field string, ordinals array<int>, object_id string"


def _edges(wrappers: Sequence[str], proper: Sequence[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _MERKLE.split(", ")]
        for pdf in batches:
            rows, seen = [], set()  # of a batch, each edge of a distinct parent once
            for record, payload in zip(pdf["record_id"], pdf["payload"]):
                found = objects_of(unwrap(payload, wrappers, proper), whole=False)
                for _, parent, _, ordinals, field, object_id, _ in found:
                    if parent < 0:
                        rows.append((record, None, None, None, object_id))
                        continue
                    edge = (found[parent][5], field, tuple(ordinals), object_id)
                    if edge not in seen:
                        seen.add(edge)
                        rows.append((None, edge[0], field, ordinals, object_id))
            out = pd.DataFrame([r[1:] for r in rows], columns=names[1:])
            out.insert(0, "record_id", pd.array([r[0] for r in rows], dtype="Int64"))  # never by way of floats
            yield out

    return run


def merkle_store(records: DataFrame, record_id: str, payload: str, wrappers: Sequence[str] = WRAPPERS, proper: Sequence[str] = PROPER) -> tuple[DataFrame, DataFrame]:
    """``record_id, root_id`` and the bridge ``parent_id, field, ordinals, child_id`` of distinct parent objects.

    Objects are told apart by their Merkle identity alone, so an object that a
    million records share has its bridge rows once; ``ordinals`` are the places
    within the parent's field, none for a lone object.
    """
    rows = records.select(F.col(record_id).cast("long").alias("record_id"), F.col(payload).alias("payload")).where("record_id is not null and payload <> ''")
    both = cut(rows.dropDuplicates(["record_id"]).mapInPandas(_edges(tuple(wrappers), tuple(proper)), _MERKLE))
    roots = both.where("record_id is not null").select("record_id", F.col("object_id").alias("root_id"))
    bridge = both.where("record_id is null").select("parent_id", "field", "ordinals", F.col("object_id").alias("child_id")).distinct()
    return roots, bridge


def _place(ordinals: str) -> Column:
    """The place of a child in its field; a lone object has 0."""
    return F.coalesce(F.try_element_at(ordinals, F.lit(-1)), F.lit(0)).cast("long")


def estimate_children(records: DataFrame, record_id: str = "id", payload: str = "payload") -> DataFrame:
    """``history_id, child_kind, category_pos, item_pos, object_id`` of categories, their items and parsed items.

    Children are walked from root to item over the bridge rows of distinct
    objects, and only then given to every record that has the root. A lone
    object where an array is expected has place 0; arrays within arrays are no
    lists of children.
    """
    roots, bridge = merkle_store(records, record_id, payload)
    bridge = bridge.where("size(ordinals) <= 1 and field in ('summary', 'categories', 'items')").select("parent_id", "field", _place("ordinals").alias("pos"), F.size("ordinals").alias("depth"), "child_id")

    def below(parents: DataFrame, field: str, name: str) -> DataFrame:
        own = bridge.where(F.col("field") == field).select(F.col("parent_id").alias("object_id"), F.col("pos").alias(name), F.col("child_id"), "depth")
        return parents.join(spread(own), "object_id")

    tops = roots.select("root_id").distinct().withColumn("object_id", F.col("root_id"))
    none = F.lit(-1).cast("long")
    parsed = below(tops, "items", "item_pos").select("root_id", F.lit("parsed_item").alias("child_kind"), none.alias("category_pos"), "item_pos", F.col("child_id").alias("object_id"))
    summary = below(tops, "summary", "nowhere").where("depth = 0").select("root_id", F.col("child_id").alias("object_id"))
    category = cut(below(summary, "categories", "category_pos").select("root_id", "category_pos", F.col("child_id").alias("object_id")))
    item = below(category, "items", "item_pos").select("root_id", F.lit("category_item").alias("child_kind"), "category_pos", "item_pos", F.col("child_id").alias("object_id"))
    found = category.select("root_id", F.lit("category").alias("child_kind"), "category_pos", none.alias("item_pos"), "object_id").unionByName(item).unionByName(parsed)
    return roots.join(spread(found), "root_id").select(F.col("record_id").alias("history_id"), "child_kind", "category_pos", "item_pos", "object_id")
