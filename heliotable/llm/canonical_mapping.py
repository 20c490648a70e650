"""Typed values mapped to the entries of a reference list (problem 2).

Method: the entries, with alias paths, stand in a trie that is searched with a
Levenshtein automaton (neighbouring letters exchanged count as one edit),
returning every entry within a distance that depends on the length. Of those
the nearest is taken, if it is one; otherwise the value has none.

Only distinct values are searched, so repeats cost nothing, and the trie is
built once for each worker process from the list, whose size is checked.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliotable.llm import work_terms
from heliotable.llm.visual_text import NOT_BLANK, consistent_form
from heliotable.plans.joins import spread
from heliotable.plans.tables import dealt

#: A reference list longer than this is refused: the trie is sent to every worker.
MOST_PATHS = 200_000


def allowed_edits(length: int) -> int:
    """The distance allowed for a text of that length: none below three signs, then one, and one more for every fourteen."""
    return 0 if length < 3 else 1 + length // 14


class Trie:
    """Paths of letters; at the end of each the entries that are written so."""

    def __init__(self, paths: list[tuple[str, str]]):
        self.root: dict = {}
        for path, entry in paths:
            node = self.root
            for ch in path:
                node = node.setdefault(ch, {})
            node.setdefault(0, set()).add(entry)

    def within(self, text: str, most: int) -> dict[str, int]:
        """Every entry within ``most`` edits, with its least distance."""
        found: dict[str, int] = {}
        automaton = LevenshteinAutomaton(text, most)
        stack = [(self.root, automaton.start(), None, "")]
        while stack:
            node, state, above, last = stack.pop()
            for ch, child in node.items():
                if ch == 0:
                    d = automaton.distance(state)
                    if d <= most:
                        for entry in child:
                            found[entry] = min(d, found.get(entry, d))
                    continue
                follow = automaton.step(state, ch, above, last)
                if follow:
                    stack.append((child, follow, state, ch))
        return found


class LevenshteinAutomaton:
    """States are the positions in a text that few enough edits can reach: position -> edits."""

    def __init__(self, text: str, most: int):
        self.text, self.most = text, most

    def start(self) -> dict[int, int]:
        return {k: k for k in range(min(self.most, len(self.text)) + 1)}

    def step(self, state: dict[int, int], ch: str, above: dict[int, int] | None, last: str) -> dict[int, int]:
        text, most, follow = self.text, self.most, {}
        for at, edits in state.items():
            if at < len(text) and text[at] == ch:
                if edits < follow.get(at + 1, most + 1):
                    follow[at + 1] = edits
            elif at < len(text) and edits < most and edits + 1 < follow.get(at + 1, most + 1):
                follow[at + 1] = edits + 1  # another letter
            if edits < most and edits + 1 < follow.get(at, most + 1):
                follow[at] = edits + 1  # a letter left out of the text
        if above:  # two neighbouring letters exchanged
            for at, edits in above.items():
                if edits < most and at + 1 < len(text) and text[at] == ch and text[at + 1] == last and edits + 1 < follow.get(at + 2, most + 1):
                    follow[at + 2] = edits + 1
        for at in sorted(follow):  # letters of the text that the path lacks
            edits = follow[at]
            if edits < most and at < len(text) and edits + 1 < follow.get(at + 1, most + 1):
                follow[at + 1] = edits + 1
        return follow

    def distance(self, state: dict[int, int]) -> int:
        return state.get(len(self.text), self.most + 1)


def entries_within(trie: Trie, text: str, passes: Callable[[str, str, int], bool] = lambda text, entry, edits: True) -> dict[str, int]:
    """Every entry within the distance allowed for the text's length, with its distance."""
    return {e: d for e, d in trie.within(text, allowed_edits(len(text))).items() if passes(text, e, d)}


def nearest(trie: Trie, text: str, passes: Callable[[str, str, int], bool] = lambda text, entry, edits: True) -> tuple[str, int]:
    """The one nearest entry and its distance; ('', -1) where there is none or several are equally near."""
    return nearest_of(entries_within(trie, text, passes))


def nearest_of(found: dict[str, int]) -> tuple[str, int]:
    if not found:
        return "", -1
    least = min(found.values())
    best = [e for e, d in found.items() if d == least]
    return (best[0], least) if len(best) == 1 else ("", -1)


# ---- the two lists of this project -------------------------------------------------------------------------------


def work_paths(items: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Paths of the work items: (spelling, rule_item_id)."""
    return [(s, i) for i, d in items for s in sorted(work_terms.spellings(d))]


_MODEL = re.compile(r"^([A-Z]+)-?(\d+[A-Z])-?(\d+)-?([A-Z0-9]*)$")


def model_key(text: str) -> str:
    return re.sub("[^A-Z0-9]", "", consistent_form(text).upper())


def module_paths(products: list[tuple[str, str, list[str] | None]]) -> list[tuple[str, str]]:
    """Paths of the modules: model and aliases, and the model's parts left out or in another order."""
    paths = set()
    for entry, model, aliases in products:
        for name in [model, *(aliases or [])]:
            paths.add((model_key(name), entry))
        m = _MODEL.match(model.upper())
        if m:
            maker, series, watt, rest = m.groups()
            for tail in {"", rest}:
                paths |= {(maker + series + watt + tail, entry), (series + watt + tail + maker, entry)}
            paths |= {(maker + watt + "W" + series, entry), (series + maker + watt, entry)}
    return sorted(paths)


# Words around a model that are no part of it.
_MODEL_ASIDE = re.compile(r"\(\d+W\)|同等品?|相当品?|※|程度|予定|又は|以上")


def typed_model(text: str | None) -> str:
    """The key of a typed model: without remarks, the maker's name and a repeated wattage. Null gives ''."""
    t = _MODEL_ASIDE.sub(" ", (consistent_form(text) or "").upper())
    words = [w for w in t.split() if not (re.fullmatch("[^0-9]{4,}", w) or re.search("[^ -~]", w) or w in ("X", "×"))]
    if len(words) > 1 and re.fullmatch(r"\d{3}W", words[-1]) and words[-1][:3] in "".join(words[:-1]):
        words = words[:-1]
    return model_key("".join(words))


def only_slips(text: str, signs: dict[str, set[str]]) -> Callable[[str, str, int], bool]:
    """A slip leaves out, doubles or exchanges letters of a model; another figure or letter is another model."""
    own = sorted(text)
    digits = [c for c in own if c.isdigit()]

    def passes(_: str, entry: str, edits: int) -> bool:
        if edits == 0:
            return True
        for path in signs[entry]:
            theirs = sorted(path)
            if digits == [c for c in theirs if c.isdigit()] and abs(len(own) - len(theirs)) <= edits:
                more = sum((Counter(own) - Counter(theirs)).values())
                less = sum((Counter(theirs) - Counter(own)).values())
                doubled = all(c in path for c in Counter(own) - Counter(theirs))
                if not (more and less) and doubled and osa_within(text, path, edits):
                    return True
        return False

    return passes


def osa_within(a: str, b: str, most: int) -> bool:
    return ("" in Trie([(b, "")]).within(a, most)) if abs(len(a) - len(b)) <= most else False


#: Answers that a worker keeps for keys it meets again; beyond them it starts anew.
KEPT_ANSWERS = 100_000
_MAPPED = "value string, canonical_id string, edits int, entries array<struct<canonical_id: string, edits: int>>"


@lru_cache(maxsize=4)
def _built(paths: tuple[tuple[str, str], ...]) -> tuple[Trie, dict[str, set[str]]]:
    """The trie of a list and the paths of each entry; made once in a worker process, whatever the number of tasks."""
    signs: dict[str, set[str]] = {}
    for path, entry in paths:
        signs.setdefault(entry, set()).add(path)
    return Trie(list(paths)), signs


def _search(shared, models: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, signs = _built(shared.value)
        key = typed_model if models else work_terms.plain_words
        known: dict[str, tuple] = {}
        for pdf in batches:
            out = []
            for value in pdf["value"]:
                k = key(value)
                if k not in known:
                    if len(known) >= KEPT_ANSWERS:
                        known.clear()
                    found = entries_within(trie, k, only_slips(k, signs)) if models else entries_within(trie, k)
                    near = sorted(found.items(), key=lambda x: (x[1], x[0]))
                    known[k] = (*nearest_of(found), [{"canonical_id": e, "edits": d} for e, d in near])
                out.append(known[k])
            yield pdf.assign(canonical_id=[x[0] for x in out], edits=[x[1] for x in out], entries=[x[2] for x in out])

    return run


def map_values(values: DataFrame, paths: list[tuple[str, str]], models: bool = False) -> DataFrame:
    """``value, canonical_id, edits, entries`` for each distinct value that is not blank.

    ``entries`` are all within the distance allowed for its length, the nearest
    first; ``canonical_id`` is the one nearest. '' and -1 where there is none, or
    where several are equally near. A list of more than ``MOST_PATHS`` paths is
    refused, never cut.
    """
    if len(paths) > MOST_PATHS:
        raise ValueError(f"{len(paths)} paths; the trie is meant for at most {MOST_PATHS}")
    distinct = values.where(F.col("value").rlike(NOT_BLANK)).select("value").distinct()
    shared = values.sparkSession.sparkContext.broadcast(tuple(paths))  # of checked size
    return dealt(distinct).mapInPandas(_search(shared, models), _MAPPED)


def map_records(records: DataFrame, paths: list[tuple[str, str]], models: bool = False) -> DataFrame:
    """``record_id, value, canonical_id, edits, entries`` for every record with a value that is not blank, each id once.

    Rows delivered again are one record. Null ids are left out. A value that a
    third of all rows share is searched once; its rows are joined by spreading
    over tasks as the engine splits skewed partitions.
    """
    rows = records.where(F.col("record_id").isNotNull() & F.col("value").rlike(NOT_BLANK)).select("record_id", "value").dropDuplicates(["record_id"])
    return rows.join(spread(map_values(rows, paths, models)), "value").select("record_id", "value", "canonical_id", "edits", "entries")


def reference_rows(list_table: DataFrame, columns: list[str], most: int = 50_000) -> list:
    """The rows of a reference list, of checked size, in order of the first column."""
    rows = list_table.select(*columns).dropDuplicates([columns[0]]).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the reference list has over {most} rows")
    return sorted(tuple(r) for r in rows)
