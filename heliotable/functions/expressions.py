"""Conditions and formulas of rule tables, compiled once into columns.

Nothing is evaluated by Python at run time: text becomes a column on the
driver, so a rule table of any survey count is one projection.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, NumericType, StringType, StructType


@dataclass(frozen=True)
class Operand:
    """A column with the kind of value it holds: 'number', 'flag', 'text' or 'nothing'."""

    column: Column
    kind: str


def fields_of(schema: StructType, prefix: str = "") -> dict[str, Operand]:
    """The scalar fields of a schema by dotted path."""
    found: dict[str, Operand] = {}
    for f in schema:
        path = f"{prefix}{f.name}"
        if isinstance(f.dataType, StructType):
            found |= fields_of(f.dataType, path + ".")
        elif kind := _kind(f.dataType):
            found[path] = Operand(F.col(path), kind)
    return found


def _kind(t: DataType) -> str:
    return "flag" if isinstance(t, BooleanType) else "number" if isinstance(t, NumericType) else "text" if isinstance(t, StringType) else ""


def _outside(text: str, words: tuple[str, ...]) -> list[str]:
    """The parts of a text between words that stand outside all parentheses."""
    pattern = re.compile("|".join(map(re.escape, words)))
    depth, cuts, at = [0], [], 0
    for ch in text:
        depth.append(depth[-1] + (ch == "(") - (ch == ")"))
    for m in pattern.finditer(text):
        if depth[m.start()] == 0:
            cuts.append((at, m.start()))
            at = m.end()
    parts = [text[a:b] for a, b in [*cuts, (at, len(text))]]
    return parts if len(parts) == 1 else [p for p in parts if p.strip()]


def condition(text: str | None, fields: Mapping[str, Operand]) -> Column:
    """A condition as a column that is never null.

    Known: == != > >= < <=, AND OR NOT (all upper or all lower case, NOT first
    only in upper or lower case and reaching to the end), parentheses, bare
    fields, true false none null, numbers, quoted text. Empty is true, so is a
    text that cannot be read; an unknown field is nothing; values of unlike
    kinds are unequal and in no order.
    """
    try:
        return _condition((text or "").strip(), fields)
    except (ValueError, RecursionError):
        return F.lit(True)


def _condition(text: str, fields: Mapping[str, Operand]) -> Column:
    text = text.strip()
    if not text:
        return F.lit(True)
    if text[:4].upper() == "NOT ":
        return ~_condition(text[4:], fields)
    for words, join in (((" OR ", " or "), lambda a, b: a | b), ((" AND ", " and "), lambda a, b: a & b)):
        parts = _outside(text, words)
        if len(parts) > 1:
            out = _condition(parts[0], fields)
            for p in parts[1:]:
                out = join(out, _condition(p, fields))
            return out
    if text[0] == "(" and text[-1] == ")":
        return _condition(text[1:-1], fields)
    for sign in (">=", "<=", "!=", "==", ">", "<"):
        left, found, right = text.partition(sign)
        if found:
            return _compare(_operand(left, fields), sign, _operand(right, fields))
    x = _operand(text, fields)
    truth = {"flag": x.column, "number": x.column != 0, "text": x.column != ""}.get(x.kind)
    return F.lit(False) if truth is None else F.coalesce(truth, F.lit(False))


def _operand(text: str, fields: Mapping[str, Operand]) -> Operand:
    t = text.strip()
    if t.lower() in ("true", "false"):
        return Operand(F.lit(t.lower() == "true"), "flag")
    if t.lower() in ("", "none", "null"):
        return Operand(F.lit(None).cast("string"), "nothing")
    try:
        return Operand(F.lit(float(t)), "number")
    except ValueError:
        pass
    if len(t) > 1 and t[0] == t[-1] and t[0] in "'\"":
        return Operand(F.lit(t[1:-1]), "text")
    return fields.get(t, Operand(F.lit(None).cast("string"), "nothing"))


def _compare(a: Operand, sign: str, b: Operand) -> Column:
    numeric = {"number", "flag"}
    if {a.kind, b.kind} <= numeric:
        x, y = (o.column.cast("int").cast("double") if o.kind == "flag" else o.column.cast("double") for o in (a, b))
    elif a.kind == b.kind == "text":
        x, y = a.column, b.column
    else:
        both = a.column.isNull() & b.column.isNull()
        return both if sign == "==" else ~both if sign == "!=" else F.lit(False)
    if sign in ("==", "!="):
        same = x.eqNullSafe(y)
        return same if sign == "==" else ~same
    order = {">": x > y, "<": x < y, ">=": x >= y, "<=": x <= y}[sign]
    return F.coalesce(order, F.lit(False))


def _strict(f: Callable[..., Column]) -> Callable[..., Column]:
    """Null where any argument is null."""

    def run(*args: Column) -> Column:
        if len(args) < 2:
            return args[0]
        known = args[0].isNotNull()
        for a in args[1:]:
            known = known & a.isNotNull()
        return F.when(known, f(*args))

    return run


def _truncated(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("double")


# Python's semantics: floor division and its remainder, rounding half to even.
_OPERATORS: dict[type, Callable[[Column, Column], Column]] = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: F.try_divide(a, b),
    ast.FloorDiv: lambda a, b: F.floor(F.try_divide(a, b)).cast("double"),
    ast.Mod: lambda a, b: a - b * F.floor(F.try_divide(a, b)),
    ast.Pow: lambda a, b: F.pow(a, b),
}
_FUNCTIONS: dict[str, Callable[..., Column]] = {
    "max": _strict(F.greatest),
    "min": _strict(F.least),
    "abs": F.abs,
    "round": lambda x, n=None: F.bround(x, 0 if n is None else n).cast("double"),
    "int": _truncated,
    "float": lambda x: x,
    "ceil": lambda x: F.ceil(x).cast("double"),
    "floor": lambda x: F.floor(x).cast("double"),
}


def formula(text: str, variables: Mapping[str, Column]) -> Column:
    """An arithmetic formula as a double column; null where it divides by zero.

    Raises ValueError for anything but numbers, the given variables,
    + - * / // % **, signs, and max min abs round int float ceil floor.
    """
    try:
        tree = ast.parse((text or "").strip(), mode="eval")
    except SyntaxError as e:
        raise ValueError(f"no formula: {text!r}") from e
    return _formula(tree.body, variables)


def _formula(node: ast.AST, variables: Mapping[str, Column]) -> Column:
    match node:
        case ast.Constant(value=bool() | int() | float() as v):
            return F.lit(float(v))
        case ast.Name(id=name) if name in variables:
            return variables[name].cast("double")
        case ast.BinOp(left=a, op=op, right=b) if type(op) in _OPERATORS:
            return _OPERATORS[type(op)](_formula(a, variables), _formula(b, variables))
        case ast.UnaryOp(op=ast.USub(), operand=x):
            return -_formula(x, variables)
        case ast.UnaryOp(op=ast.UAdd(), operand=x):
            return _formula(x, variables)
        case ast.Call(func=ast.Name(id="round"), args=[x, ast.Constant(value=int() as n)], keywords=[]):
            return F.bround(_formula(x, variables), n).cast("double")
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in _FUNCTIONS and args:
            return _FUNCTIONS[name](*[_formula(a, variables) for a in args])
    raise ValueError(f"not allowed in a formula: {ast.dump(node)}")


def quantity(formula_text: str, source: str, fixed: str, variables: Mapping[str, Column], fields: Mapping[str, Operand]) -> tuple[Column, Column]:
    """(text, number) of a quantity: its formula, else its field, else its fixed value, else ('', 0)."""
    try:
        value = formula(formula_text, variables) if formula_text else F.lit(None).cast("double")
    except ValueError:
        value = F.lit(None).cast("double")
    text = F.when(F.abs(value - F.bround(value, 0)) < 1e-9, F.bround(value, 0).cast("bigint").cast("string")).otherwise(F.format_string("%.2f", value))
    text = F.when(value.isNotNull(), text)
    if source in fields:
        own = fields[source]
        text, value = F.coalesce(text, own.column.cast("string")), F.coalesce(value, own.column.cast("string").try_cast("double"))
    return F.coalesce(text, F.lit(fixed or "")), F.coalesce(value, F.lit(fixed or "").try_cast("double"), F.lit(0.0))
