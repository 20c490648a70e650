"""Spellings of company names that mean the same company (problem 4).

Method: every canonical rewriting of each name is generated by rules (legal
form, office, token order, script and reading, trade word, nickname, initials,
and the slips of typing: a sign doubled, left out or exchanged with its
neighbour); the forms are exploded and joined on equality, and a link scores by the rarity of
the forms it rests on, each one over the number of names that can be rewritten
so; of several links of a name the one of rarest forms holds. A sign replaced
by another counts only within the name proper, not the trade: one kana of four
or more, or one vowel of a name known in Latin letters alone.

No makers are listed. How a name is written in other scripts is learned from
the names themselves: kanji by the readings of their signs and kana by the
consonants they share with a name in Latin letters, both also by the code with
which the models beside the names begin.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliotable.llm import readings
from heliotable.llm.visual_text import KANJI_KANA, NOT_BLANK, consistent_form
from heliotable.plans.durable import cut
from heliotable.plans.joins import spread
from heliotable.plans.tables import dealt

# Trade words, Japanese and Latin.
TRADES = {
    "エナジー": "energy", "電機": "electric", "ソーラー": "solar", "パワー": "power", "テクノロジー": "technology", "テクノ": "techno", "精機": "precision",
    "製作所": "works", "化成": "chemical", "蓄電": "storage", "重電": "heavyelectric", "電子": "electronics", "バッテリー": "battery", "ストレージ": "storage", "電工": "densen",
}
# What stands for a name that is not known.
PLACEHOLDERS = {"", "未定", "同上", "不明", "要確認", "なし", "無し", "未確認", "未記入", "その他", "n/a", "na", "?", "??", "-", "--", "ー", "―", "x", "×", "〃", "tbd", "none", "null"}
_OFFICE = r"(?:[東西南北中]日本(?:支社|支店|営業所)?|[一-鿋]{1,4}(?:支社|支店|営業所|出張所)|本社|住設部|特販課|[一-鿋]{1,4}(?:部|課)|代理店経由)"
_LEGAL_JA = re.compile(r"株式会社|有限会社|合同会社|\(株\)|\(有\)|\(同\)|㈱|㈲")
_LEGAL_EN = re.compile(r"[\s,]*\b(?:co\.?\s*,?\s*ltd|corporation|corp|inc|ltd|k\.k|co|llc|gmbh)\b\.?\s*$")
_TAIL = re.compile(r"(?:さん|様|御中|社|製)$")

# Hepburn transcription.
_KANA = {}
for _row, _latin in {
    "アイウエオ": "a i u e o", "カキクケコ": "ka ki ku ke ko", "ガギグゲゴ": "ga gi gu ge go", "サシスセソ": "sa shi su se so", "ザジズゼゾ": "za ji zu ze zo",
    "タチツテト": "ta chi tsu te to", "ダヂヅデド": "da ji zu de do", "ナニヌネノ": "na ni nu ne no", "ハヒフヘホ": "ha hi hu he ho", "バビブベボ": "ba bi bu be bo",
    "パピプペポ": "pa pi pu pe po", "マミムメモ": "ma mi mu me mo", "ヤユヨ": "ya yu yo", "ラリルレロ": "ra ri ru re ro", "ワヲン": "wa o n", "ヴァィゥェォ": "vu a i u e o", "ャュョ": "ya yu yo",
}.items():
    _KANA.update(zip(_row, _latin.split()))
_BY_LATIN = {v: k for k, v in TRADES.items()} | {"heavy electric": "重電", "electricworks": "電工"}


def romaji(kana: str) -> str:
    """Katakana in Latin letters without long vowels; other signs stay."""
    out = ""
    for i, c in enumerate(kana):
        if c in "ャュョァィゥェォ" and out and c in _KANA:
            if c in "ャュョ":
                out = (out[:-1] if out.endswith("i") else out) + (_KANA[c] if out.endswith("i") and not out.endswith(("shi", "chi", "ji")) else _KANA[c][1:])
            else:
                out = out.rstrip("u") + _KANA[c] if out.endswith("u") else out + _KANA[c]
        elif c == "ッ":
            out += (_KANA.get(kana[i + 1], " ")[0] if i + 1 < len(kana) else "").strip()
        elif c != "ー":
            out += _KANA.get(c, c)
    return short(out.replace("fu", "hu"))


def short(latin: str) -> str:
    """Without the second letter of long o and u."""
    return re.sub("uu+", "u", re.sub("o[ou]+", "o", latin))


def kana(text: str) -> str:
    return "".join(chr(ord(c) + 0x60) if "ぁ" <= c <= "ゖ" else KANJI_KANA.get(c, c) if c in "力口夕卜" else c for c in text)


def clean(name: str | None) -> str:
    """Width, case, legal form, office and honorific away; words stay apart by one space. Null and placeholders give ''."""
    t = unicodedata.normalize("NFKC", consistent_form(name) or "").strip()
    if t.lower() in PLACEHOLDERS:
        return ""
    t = _LEGAL_JA.sub(" ", unicodedata.normalize("NFKC", t.replace("㈱", "(株)"))).strip().lower()
    for _ in range(3):
        t = re.sub(rf"[\s(/・,-]*{_OFFICE}\)?$", "", t) if not re.fullmatch(_OFFICE, t) else t
        t = _LEGAL_EN.sub("", t).strip(" ,.()")
        t = _TAIL.sub("", t).strip() if not t.endswith("会社") else t
    t = kana(t)
    return "" if t in PLACEHOLDERS else re.sub(r"[\s・/,_\-‐.()]+", " ", t).strip()


_WORDS = sorted([*TRADES, *_BY_LATIN], key=len, reverse=True)


def parted(text: str) -> tuple[str, str]:
    """(name as written, trade) of a cleaned text; the trade is '' where none is found."""
    t = text.replace(" ", "")
    for w in _WORDS:
        v = w.replace(" ", "")
        if t != v and t.endswith(v):
            return t[: -len(v)], TRADES.get(_BY_LATIN.get(w, w), "")
    if " " in text:
        for w in _WORDS:  # the trade first: Electric, Sorei
            v = w.replace(" ", "")
            if t != v and t.startswith(v):
                return t[len(v) :], TRADES.get(_BY_LATIN.get(w, w), "")
    return t, ""


def rewritten(text: str) -> tuple[str, str]:
    """(name in Latin letters, trade) of a cleaned text; kanji stay."""
    stem, trade = parted(text)
    return (short(stem) if stem.isascii() else romaji(stem)), trade


def slips(text: str) -> set[str]:
    """The text with a sign left out, and with two neighbours exchanged."""
    n = len(text)
    out = {text[:i] + text[i + 1 :] for i in range(n)} if n > 3 else set()
    return out | {text[:i] + text[i + 1] + text[i] + text[i + 2 :] for i in range(n - 1)}


def script_of(text: str) -> str:
    """'latin', 'kana' or 'kanji'."""
    return "latin" if text.isascii() else "kanji" if re.search("[々㐀-䶿一-鿿]", text) else "kana"


def forms(name: str | None) -> list[tuple[str, str, int]]:
    """(stem, trade, kind): kind 0 the name's own form, 1 a slip of it, 2 its nickname, 3 a slip of the nickname, 4 a vowel misheard, 5 the name with one kana open."""
    text = clean(name)
    own = rewritten(text) if text else ("", "")
    if not own[0]:
        return []
    stem, trade = own
    native = text.replace(" ", "")
    out = {own: 0}
    # a slip may stand in the name as typed or, where the trade goes first or apart, in its usual order
    for written in {native, stem + trade}:
        for s in slips(written):
            out.setdefault(rewritten(s), 1)
    for word in TRADES:
        said = native.removesuffix(word)
        if said != native and TRADES[word] == trade and re.fullmatch("[ァ-ヺー]{4,}", said):
            for i in range(len(said)):
                out.setdefault((f"{said[:i]}_{said[i + 1 :]}", trade), 5)
    if text.isascii():
        said = re.findall("[^aeiou]*[aeiou]|n(?![aeiou])", stem)
        if "".join(said) == stem and len(said) > 3:  # the same name slipped in kana
            for i in range(len(said)):
                out.setdefault(("".join(said[:i] + said[i + 1 :]), trade), 1)
                out.setdefault(("".join([*said[:i], *said[i : i + 2][::-1], *said[i + 2 :]]), trade), 1)
        for i, c in enumerate(stem):
            if c in "aiueo":
                for v in "aiueo":
                    out.setdefault((short(stem[:i] + v + stem[i + 1 :]), trade), 4)
    if trade:
        out.setdefault((stem, ""), 2)
        for said in {stem, parted(text)[0]}:
            for s in slips(said):
                out.setdefault(rewritten(s), 3)
    return [(s, t, k) for (s, t), k in out.items() if s or t]


_FORMS = "name string, script string, n long, stem string, trade string, kind int"


def _explode_forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for name, n in zip(pdf["name"], pdf["n"]):
            written = parted(clean(name))[0]
            script = "latin" if written.isascii() else "kanji" if re.search("[々㐀-䶿一-鿿]", written) else "kana"
            rows += [(name, script, n, *f) for f in forms(name)]
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in _FORMS.split(", ")])


def code_of(model: str | Column) -> Column:
    """The letters with which a model begins, in lower case; '' for none."""
    return F.lower(F.regexp_extract(F.trim(model), "^[A-Za-z]+", 0))


# ---- how names are written in other scripts ----------------------------------------------------------------------


def _loose(name: str) -> str:
    """As a pattern of readings, with long vowels that join at a seam left open."""
    each = [[short(r.replace("fu", "hu")) for r in readings.READINGS[c]] for c in name]
    return "^" + "".join("(?:" + "|".join(r if not i or r[0] not in "uo" else r[0] + "?" + r[1:] for r in rs) + ")" for i, rs in enumerate(each)) + "$"


def _read_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(s, t, b, _loose(s)) for s, t in zip(pdf["stem"], pdf["trade"]) if readings.readable(s) for b in {short(x.replace("fu", "hu")) for x in readings.beginnings(s)}]
        yield pd.DataFrame(rows, columns=["native", "trade", "begin", "pattern"])


def _sounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(sound=pdf["stem"].map(readings.consonants))


def learned_writings(own: DataFrame, coded: DataFrame) -> DataFrame:
    """``stem, usual``: stems that another script's stem of the same name stands for.

    ``own`` are the stems as written, ``script, stem, trade, n``; ``coded`` the
    same with the ``code`` of models beside them and the number of ``rows``.
    Three kinds of evidence, the first that there is counts. A stem is mostly
    beside models of one code, and so is, in the same trade, a commoner stem
    with its consonants, or for kanji simply the commonest. The kanji can be
    read so. Kana and Latin letters, each without a partner, share four
    consonants or more. Other slips of names are not learned, they are rewritten.
    """
    stem = ["script", "stem", "trade"]
    whole = coded.groupBy(*stem).agg(F.sum("rows").alias("all_rows"))
    sure = coded.where("trade <> '' and stem <> code").join(spread(whole), stem).where("rows * 2 > all_rows")
    sure = sure.select("script", "stem", "trade", "code", "rows").mapInPandas(_sounds, "script string, stem string, trade string, code string, rows long, sound string")
    top = F.struct((F.col("script") == "latin").alias("latin"), "rows", "stem", "sound")
    anchor = sure.where("script <> 'kanji' and rows >= 2").groupBy("trade", "code").agg(F.max(top).alias("anchor"))
    native = sure.where("script = 'kanji'").groupBy("trade", "code").agg(F.max(F.struct("rows", "stem")).alias("top"))
    of_kanji = native.join(spread(anchor), ["trade", "code"]).where("top.rows >= 3 and anchor.rows >= 3").select(F.col("top.stem").alias("stem"), F.col("anchor.stem").alias("usual"), F.col("top.rows").alias("weight"))
    of_sound = sure.where("script <> 'kanji'").join(spread(anchor), ["trade", "code"]).where("sound = anchor.sound and length(sound) >= 2").select("stem", F.col("anchor.stem").alias("usual"), F.col("rows").alias("weight"))
    by_code = of_kanji.unionByName(of_sound).select("stem", "usual", F.lit(1).alias("step"), "weight")

    native = own.where("script = 'kanji'").select("stem", "trade").distinct()
    spoken = own.where("script <> 'kanji'").groupBy("stem", "trade").agg(F.sum("n").alias("weight"))
    ahead = spoken.withColumn("begin", F.explode(F.transform(F.sequence(F.lit(1), F.length("stem")), lambda k: F.substring(F.col("stem"), F.lit(1), k))))
    met = native.mapInPandas(_read_out, "native string, trade string, begin string, pattern string").join(spread(ahead), ["trade", "begin"]).where("stem rlike pattern")
    by_reading = met.select(F.col("native").alias("stem"), F.col("stem").alias("usual"), F.lit(2).alias("step"), "weight")

    # (a kana name that is also written so in Latin letters has its partner)
    flags = own.where("script <> 'kanji'").groupBy("stem", "trade").agg(F.min("script").alias("one"), F.max("script").alias("other"), F.sum("n").alias("n")).where("one = other").select("stem", "trade", F.col("one").alias("script"), "n")
    heard = flags.mapInPandas(_sounds, "stem string, trade string, script string, n long, sound string").where("length(sound) >= 4")
    pairs = heard.groupBy("trade", "sound").agg(*[F.max(F.when(F.col("script") == s, F.struct("n", "stem"))).alias(s) for s in ("latin", "kana")])
    by_sound = pairs.select(F.col("kana.stem").alias("stem"), F.col("latin.stem").alias("usual"), F.lit(3).alias("step"), F.col("latin.n").alias("weight"))

    every = by_code.unionByName(by_reading).unionByName(by_sound).where("stem is not null and usual is not null and stem <> usual")
    one = every.groupBy("stem").agg(F.min(F.struct("step", -F.col("weight"), "usual"))["usual"].alias("usual"))
    one = cut(one)
    # kanji lead to kana and kana to Latin letters: two steps at most
    on = one.select(F.col("stem").alias("usual"), F.col("usual").alias("further"))
    return cut(one.join(spread(on), "usual", "left").select("stem", F.coalesce("further", "usual").alias("usual")))


def _own_codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for maker, code, n in zip(pdf["maker"], pdf["code"], pdf["n"]):
            text = clean(maker)
            own, written = (rewritten(text), parted(text)[0]) if text else (("", ""), "")
            if own[0]:
                rows.append(("latin" if written.isascii() else "kanji" if re.search("[々㐀-䶿一-鿿]", written) else "kana", *own, short(code), n))
        yield pd.DataFrame(rows, columns=["script", "stem", "trade", "code", "rows"])


def company_of(names: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """``name, company, score`` for each distinct spelling in column ``name`` that is a name.

    A column ``model``, if there is one, holds the model typed beside the name.
    Nulls, blanks and placeholders have no row. Spellings that no rule relates
    to another are companies of their own. A nickname or code that fits several
    companies stays alone. ``score`` is the rarity of the forms by which a
    spelling was linked, 1 for a company's usual one.
    """
    rows = names.where(F.col("name").rlike(NOT_BLANK))
    distinct = rows.groupBy("name").agg(F.count("*").alias("n"))
    exploded = cut(dealt(distinct).mapInPandas(_explode_forms, _FORMS))
    written = exploded.where("kind = 0")
    coded_kind = "script string, stem string, trade string, code string, rows long"
    makers = None if products is None else products.select("maker", code_of("model").alias("code")).where("code <> ''").groupBy("maker", "code").agg(F.count("*").alias("n")).mapInPandas(_own_codes, coded_kind)
    coded = written.sparkSession.createDataFrame([], coded_kind) if makers is None else makers
    if "model" in names.columns:
        beside = rows.select("name", code_of("model").alias("code")).where("code <> ''").groupBy("name", "code").agg(F.count("*").alias("rows"))
        coded = coded.unionByName(written.join(spread(beside), "name").select("script", "stem", "trade", "code", "rows"))
    coded = coded.groupBy("script", "stem", "trade", "code").agg(F.sum("rows").alias("rows"))
    learned = learned_writings(written.groupBy("script", "stem", "trade").agg(F.sum("n").alias("n")), coded)
    usual = F.concat_ws("|", F.coalesce("usual", "stem"), "trade")
    exploded = cut(exploded.join(spread(learned), "stem", "left").select("name", "script", "n", usual.alias("form"), "kind"))

    own = exploded.where("kind = 0").select("name", "script", "n", F.col("form").alias("key"))
    keys = own.groupBy("key").agg(F.count("*").alias("spellings"), F.sum("n").alias("uses"), F.min((F.col("script") == "latin").cast("int")).alias("latin"))
    rank = F.struct("spellings", "uses", "key")
    named = exploded.where("kind <> 0").join(spread(own.select("name", "key")), "name").select("key", "form", "kind").distinct()

    # slips lead to the name of more spellings, by the rarest forms
    ranked = keys.select("key", rank.alias("rank"), F.col("key").endswith("|").alias("bare"))
    # (a vowel is misheard only where the name is known in Latin letters alone)
    slip = named.where("kind = 1").unionByName(named.where("kind = 4").join(spread(keys.where("latin = 1").select("key")), "key", "left_semi")).select("key", "form").distinct()
    met = slip.join(spread(keys.select(F.col("key").alias("form"))), "form").where("key <> form")
    met = met.join(spread(met.groupBy("form").agg((1 / F.count("*")).alias("rarity"))), "form")
    near = met.select("key", F.col("form").alias("other"), "rarity").unionByName(met.select(F.col("form").alias("key"), F.col("key").alias("other"), "rarity"))
    # one kana taken for another: names of one trade that are equal but for one sign; a form has as many as there are kana
    opened = named.where("kind = 5").select("key", "form")
    fits = opened.groupBy("form").agg((1 / F.count("*")).alias("rarity")).where("rarity < 1")
    near = near.unionByName(opened.join(spread(fits), "form").join(spread(opened.select(F.col("key").alias("other"), "form")), "form").where("key <> other").select("key", "other", "rarity"))
    near = near.groupBy("key", "other").agg(F.sum("rarity").alias("rarity"))
    a, b = ranked.select("key", "rank", "bare"), ranked.select(F.col("key").alias("other"), F.col("rank").alias("other_rank"), F.col("bare").alias("other_bare"))
    up = near.join(spread(a), "key").join(spread(b), "other").where("other_rank > rank and not other_bare")
    parent = up.groupBy("key").agg(F.max(F.struct("rarity", "other_rank", "other")).alias("best")).select("key", F.col("best.other").alias("parent"), F.least(F.lit(1.0), "best.rarity").alias("score"))
    tree = cut(keys.join(spread(parent), "key", "left").select("key", F.coalesce("parent", "key").alias("anchor"), F.coalesce("score", F.lit(1.0)).alias("score")))
    while True:  # a slip of a slip of a slip: ranks rise, so the chains end, and each round halves them
        upper = tree.select(F.col("key").alias("anchor"), F.col("anchor").alias("above"), F.col("score").alias("above_score"))
        step = cut(tree.join(spread(upper), "anchor").select("key", F.col("above").alias("anchor"), (F.col("score") * F.when(F.col("anchor") == F.col("key"), 1.0).otherwise(F.col("above_score"))).alias("score"), (F.col("above") != F.col("anchor")).alias("moved")))
        tree = step.drop("moved")
        if not step.where("moved").limit(1).count():
            break

    # nicknames and codes: only where one company can be meant
    bare = tree.where(F.col("anchor").endswith("|") & (F.col("key") == F.col("anchor"))).select("key")
    meant = named.where("kind in (2, 3)").join(spread(tree.where(~F.col("anchor").endswith("|"))), "key").select("form", "anchor", "kind")
    if makers is not None:
        codes = makers.join(spread(learned), "stem", "left").select(F.concat(F.col("code"), F.lit("|")).alias("form"), usual.alias("key")).distinct()
        meant = meant.unionByName(codes.join(spread(tree), "key").select("form", "anchor", F.lit(1).alias("kind")))
    meant = bare.join(spread(meant), bare["key"] == meant["form"]).groupBy("key", "anchor").agg(F.min("kind").alias("kind"))
    least = meant.groupBy("key").agg(F.min("kind").alias("kind"))
    meant = meant.join(spread(least), ["key", "kind"]).groupBy("key").agg(F.count("*").alias("fits"), F.min("anchor").alias("meant")).where("fits = 1").select("key", "meant")
    final = tree.join(spread(meant), "key", "left").select("key", F.coalesce("meant", "anchor").alias("company"), "score")
    return own.join(spread(final), "key").select("name", "company", "score")


def same_company_pairs(company: DataFrame) -> DataFrame:
    """``name_a, name_b`` of all pairs of spellings of a company, the smaller first by code point."""
    a = company.select("company", F.col("name").alias("name_a"))
    b = company.select("company", F.col("name").alias("name_b"))
    return a.join(spread(b), "company").where("name_a < name_b").select("name_a", "name_b")
