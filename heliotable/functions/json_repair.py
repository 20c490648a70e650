"""JSON out of loosely written text.

One scan over the text keeps apart what stands within strings and outside;
only the latter is mended. Python is needed: the states cannot be told by a
regular expression.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S | re.I)
_WORDS = {"True": "true", "False": "false", "None": "null", "NaN": "null", "undefined": "null"}
_WORD = re.compile(r"[A-Za-z_]\w*")


def _none(word: str):
    raise ValueError(f"{word} is no JSON value")


def outer_value(text: str) -> str:
    """The first balanced object or array of a text, fences aside; the rest from its start if it never closes; '' if none."""
    fenced = _FENCE.search(text)
    body = fenced[1] if fenced else text
    start = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
    if start < 0:
        return ""
    depth, quote, i = 0, "", start
    while i < len(body):
        c = body[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if not depth:
                return body[start : i + 1]
        i += 1
    return body[start:]


def mended(text: str) -> str:
    """The text with comments and trailing commas gone, words of other languages and single quotes made JSON's."""
    out: list[str] = []
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c in "\"'":
            j, inner = i + 1, []
            while j < n and text[j] != c:
                if text[j] == "\\" and j + 1 < n:
                    inner.append(text[j + 1] if text[j + 1] == "'" else text[j : j + 2])
                    j += 2
                else:
                    inner.append('\\"' if text[j] == '"' else "\\n" if text[j] == "\n" else text[j])
                    j += 1
            out.append('"' + "".join(inner) + '"')
            i = j + 1
        elif text.startswith("//", i):
            i = (text.find("\n", i) + 1 or n + 1) - 1
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            i = n if end < 0 else end + 2
        elif c in "}]":
            while out and (out[-1].isspace() or out[-1] == ","):
                out.pop()
            out.append(c)
            i += 1
        elif m := _WORD.match(text, i):
            out.append(_WORDS.get(m[0], m[0]))
            i = m.end()
        else:
            out.append(c)
            i += 1
    return "".join(out)


def repaired(text: str | None) -> str | None:
    """Compact JSON of the value in a text; null where there is none that can be mended."""
    if text is None:
        return None
    body = outer_value(text)
    for attempt in (body, mended(body)):
        try:
            return json.dumps(json.loads(attempt, parse_constant=_none), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            continue
    return None


@pandas_udf(StringType())
def repaired_json(texts: pd.Series) -> pd.Series:
    return texts.map(repaired, na_action="ignore").astype(object)
