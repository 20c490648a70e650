"""Text that looks the same but is made of other characters (problem 5).

Method: confusables skeleton. A value is decomposed, every character is
replaced by the prototype of its look-alike class, and the result is decomposed
again; originals with one skeleton are one visual form. The consistent form of
a skeleton is the context-resolved spelling on which its originals agree.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliotable.plans.durable import cut
from heliotable.plans.joins import spread
from heliotable.plans.tables import dealt

# Look-alikes of Latin letters (Cyrillic and Greek).
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮԚԜаеоорсухіјѕԁһԛԝѵ", "ABESIJKMHOPCTYXYQWaeoopcyxijsdhqwv"))
GREEK_CAPITALS = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"))
GREEK_SMALL = dict(zip("ονικρυα", "ovikpua"))
# Look-alikes of Latin letters in other scripts (Armenian, Cherokee, Coptic, Lisu), single letters among them.
OTHER_SCRIPTS = dict(zip("ՕօՏԼՍհոսցզյա" "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏴ" "ⲀⲂⲎⲒⲔⲘⲚⲞⲟⲢⲣⲤⲥⲦⲨⲬⲌ" "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "OoSLUhnugqjw" "DRTAJEWMHYGZbRWSVSLCPKdB" "ABHIKMNOoPpCcTYXZ" "BPDTGKJCZFMNLSRVHWXYAEIOU"))
# Signs that are no letters of another script but look like Latin letters: numerals, lunate sigma, palochka, click.
LETTER_SIGNS = dict(zip("ⅰⅴⅹⅼⅽⅾⅿⅠⅤⅩⅬⅭⅮⅯϹϲϳͿӀӏǀ", "ivxlcdmIVXLCDMCcjJIll"))
# Signs that look like ASCII punctuation.
PUNCTUATION = dict(zip("∕⁄∶꞉∣∖", "//::|\\"))
# Kanji and kana of one shape.
KANJI_KANA = {"力": "カ", "口": "ロ", "夕": "タ", "卜": "ト", "二": "ニ", "一": "ー", "八": "ハ", "工": "エ", "才": "オ", "三": "ミ", "千": "チ", "匕": "ヒ", "丿": "ノ", "厶": "ム"}
# Hiragana and katakana of one shape.
HIRA_KATA = {"へ": "ヘ", "べ": "ベ", "ぺ": "ペ", "り": "リ"}
# Radicals of the CJK Radicals Supplement without a compatibility mapping.
RADICALS = dict(zip("⺟⺠⻁⻄⻅⻆⻉⻋⻑⻘⻝⻞⻟⻤⻨⻩⻫⻭⻯⻱⻲⻣⻖⻎", "母民虎西見角貝車長青食食食鬼麦黄斉歯竜亀亀骨阝辶"))
#: A pattern that a text which is not blank meets, whatever kind of white space there is.
NOT_BLANK = r"(?U)\S"
DASHES = "‐‑‒–—―−─━﹣－⁃﹘"
# Words in which a kanji next to katakana is itself.
WORDS_AFTER = {"一": "式次期部号枚台本個面階棟重回段箇人日月年番丁般体括", "二": "次期号枚台本個面階棟重回段箇人日月年番丁", "三": "次期号枚台本個面階棟重回段箇人日月年番丁相", "八": "号枚台本個面階棟回段箇人日月年番丁", "千": "円個枚本", "工": "事場程法務房具区作", "夕": "方刻日食", "力": "率量学", "口": "径座", "才": "能", "卜": "", "匕": "", "丿": "", "厶": ""}
WORDS_BEFORE = {"力": "出入電動圧能風水火重張耐引協努馬浮", "口": "出入窓開蛇火人戸河吐", "工": "大施加竣着起木人化土重電商理", "夕": "朝毎", "一": "第同統唯単", "二": "第", "三": "第", "八": "第"}

_KATA = re.compile("[ァ-ヺーヽヾ]")
_HIRA = re.compile("[ぁ-ゖゝゞ]")
_KANJI = re.compile("[々〆㐀-䶿一-鿿豈-﫿]")
_LETTERS = re.compile(r"[A-Za-zÀ-ɏͰ-ϿЀ-ӿԀ-ԯԱ-և\u13A0-\u13F4Ⲁ-ⳬꓐ-ꓷⅠⅤⅩⅬ-Ⅿⅰⅴⅹⅼ-ⅿ]+")


def _invisible(ch: str) -> bool:
    o = ord(ch)
    return unicodedata.category(ch) == "Cf" or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or (unicodedata.category(ch) == "Cc" and ch not in "\t\n\r")


def _plain(ch: str) -> str:
    """A character of its own script: width, radicals and kinds of space only."""
    o = ord(ch)
    if o < 0x80:
        return ch
    if 0xFF01 <= o <= 0xFF5E and o != 0xFF0D:
        return chr(o - 0xFEE0)
    if unicodedata.category(ch) == "Zs":
        return " "
    if 0xFF61 <= o <= 0xFF9F or 0x2F00 <= o <= 0x2FDF or 0xF900 <= o <= 0xFAFF or 0x2F800 <= o <= 0x2FA1F or ch in "µ" or 0x1D400 <= o <= 0x1D7FF or 0xFFE0 <= o <= 0xFFEE:
        return unicodedata.normalize("NFKC", ch)
    return RADICALS.get(ch, PUNCTUATION.get(ch, ch))


@lru_cache(maxsize=4)
def confusables(path: str) -> dict[str, str]:
    """The look-alike table of a file in the public form ``source ; prototype ; class``, code points in hexadecimal."""
    table = {}
    with open(path, encoding="utf-8-sig") as f:
        for line in f:
            parts = [x.strip() for x in line.partition("#")[0].split(";")]
            if len(parts) >= 2 and " " not in parts[0]:
                table[chr(int(parts[0], 16))] = "".join(chr(int(x, 16)) for x in parts[1].split())
    return table


@lru_cache(maxsize=65_536)
def _prototype(ch: str, path: str | None = None) -> str:
    if _invisible(ch):
        return ""
    if path and ch in (table := confusables(path)):
        return "".join(_prototype(c) for c in table[ch])
    ch = _plain(ch)
    ch = OTHER_SCRIPTS.get(ch, LETTER_SIGNS.get(ch, ch))
    if ch in "゛゙ﾞ":
        return "゙"
    if ch in "゜゚ﾟ":
        return "゚"
    ch = CYRILLIC.get(ch, GREEK_CAPITALS.get(ch, GREEK_SMALL.get(ch, ch)))
    if ch in DASHES or ch in "ー一":
        return "-"
    if ch in HIRA_KATA:
        return HIRA_KATA[ch]
    return KANJI_KANA.get(ch, ch)


def skeleton(text: str | None, path: str | None = None) -> str | None:
    """Decompose, replace by prototypes, decompose again. Null gives null, '' gives ''.

    ``path`` names a file of the public look-alike table, which then adds to the
    scripts stated above; an equal text has an equal skeleton either way.
    """
    if text is None:
        return None
    once = unicodedata.normalize("NFD", text)
    return unicodedata.normalize("NFD", "".join(_prototype(c, path) for c in once))


def _latin_words(text: str) -> str:
    def word(m: re.Match) -> str:
        w = m[0]
        greek = sum("Ͱ" <= c <= "Ͽ" for c in w)
        latin = sum(c < "Ͱ" for c in w)
        cyrillic = sum("Ѐ" <= c <= "ԯ" for c in w)
        if greek == len(w) > 1 and any(c not in GREEK_CAPITALS for c in w):
            return w  # a Greek word, or several symbols
        if cyrillic == len(w) > 1 and any(c not in CYRILLIC for c in w):
            return w  # a Cyrillic word
        other = sum(c in OTHER_SCRIPTS or c in LETTER_SIGNS for c in w)
        if other:
            latin_like = any(c.isascii() or c in CYRILLIC or c in GREEK_CAPITALS for c in w)
            signs = {**OTHER_SCRIPTS, **LETTER_SIGNS} if latin_like else OTHER_SCRIPTS if len(w) > 1 and all(c in OTHER_SCRIPTS for c in w) else {}
            w = "".join(signs.get(c, c) for c in w)
        small = GREEK_SMALL if latin or cyrillic else {}
        return "".join(CYRILLIC.get(c, GREEK_CAPITALS.get(c, small.get(c, c))) for c in w)

    return _LETTERS.sub(word, text)


def _by_context(text: str) -> str:
    """Kanji, kana and strokes of one shape, each by its neighbours."""
    out = list(text)
    n = len(out)
    kana = {v: k for k, v in KANJI_KANA.items() if k in "力口夕二一八工"}
    for i, ch in enumerate(out):
        before, after = (out[i - 1] if i else ""), (text[i + 1] if i + 1 < n else "")
        kb, ka = bool(_KATA.match(before)), bool(_KATA.match(after))
        # a look-alike further on is looked through: of two next to each other both may be kana
        if not ka and after in KANJI_KANA and i + 2 < n and _KATA.match(text[i + 2]):
            ka = True
        if ch in DASHES:
            # the sign of a long vowel stands after kana and not before an ASCII word
            if (kb or _HIRA.match(before)) and not (after.isascii() and after.isalnum()):
                out[i] = "ー"
            else:
                out[i] = "-"
        elif ch in KANJI_KANA:
            if kb and ka:
                own = after in WORDS_AFTER.get(ch, "")
            elif kb:
                own = bool(after) and after in WORDS_AFTER.get(ch, "")
                own = own or (ch not in "一卜" and not _KANJI.match(after or "") and ch in "二三八千")
            elif ka:
                own = (bool(before) and before in WORDS_BEFORE.get(ch, "")) or ch == "一"
                own = own or (ch in "二三八千" and before.isdigit())
            else:
                own = True
            if not own:
                out[i] = KANJI_KANA[ch]
        elif ch in kana and not kb and not ka:
            hb, ha = bool(_KANJI.match(before)), bool(_KANJI.match(after))
            k = kana[ch]
            if ch == "ー":
                if _HIRA.match(before):
                    continue
                if before.isascii() and before.isalnum() and after.isascii() and after.isalnum():
                    out[i] = "-"
                elif ha and after in WORDS_AFTER["一"]:
                    out[i] = "一"
            elif (hb and before in WORDS_BEFORE.get(k, "")) or (ha and after in WORDS_AFTER.get(k, "")):
                out[i] = k
        elif ch in HIRA_KATA or ch in HIRA_KATA.values():
            hira = bool(_HIRA.match(before)) + bool(_HIRA.match(after))
            kata = bool(kb and before != "ー") + bool(ka and after != "ー")
            back = {v: k for k, v in HIRA_KATA.items()}
            if ch in HIRA_KATA and kata and not hira:
                out[i] = HIRA_KATA[ch]
            elif ch in back and hira and not kata:
                out[i] = back[ch]
    return "".join(out)


def consistent_form(text: str | None) -> str | None:
    """The text in the consistent form. Null gives null; a text in that form is itself."""
    if text is None or (text.isascii() and text.isprintable()):
        return text
    t = "".join(_plain(c) for c in text if not _invisible(c))
    t = re.sub("(?<=[ぁ-ヺ])[゛]", "゙", t)
    t = re.sub("(?<=[ぁ-ヺ])[゜]", "゚", t)
    t = unicodedata.normalize("NFC", t)
    return unicodedata.normalize("NFC", _by_context(_latin_words(t)))


def fold(text: str | None) -> str:
    """Skeleton-safe key for comparing typed text: consistent form, NFKC, lower case, no space. Null gives ''."""
    return re.sub(r"\s+", "", unicodedata.normalize("NFKC", consistent_form(text) or "").lower())


def _forms(path: str | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(skeleton=[skeleton(v, path) for v in pdf["value"]], form=pdf["value"].map(consistent_form))

    return run


def visual_forms(values: DataFrame, value: str = "value", path: str | None = None) -> DataFrame:
    """``value, n, skeleton, form, is_consistent`` for each distinct value of a column.

    Equal values are counted before anything else, so repeats of one value,
    however many, cost one row, and forms are told once. Within a skeleton the
    form that most rows resolve to holds for all of them (ties: the lesser by
    code point). Null values are left out; '' is consistent.
    """
    distinct = values.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    forms = cut(dealt(distinct).mapInPandas(_forms(path), "value string, n long, skeleton string, form string"))
    votes = forms.groupBy("skeleton", "form").agg(F.sum("n").alias("votes"), F.max(F.col("form") == F.col("value")).alias("seen"))
    # the greatest by votes, and of equal ones the least by code point
    most = votes.groupBy("skeleton").agg(F.max(F.struct("seen", "votes")).alias("top"))
    best = votes.join(spread(most), "skeleton").where("seen = top.seen and votes = top.votes").groupBy("skeleton").agg(F.min("form").alias("agreed"))
    return forms.join(spread(best), "skeleton").select("value", "n", "skeleton", F.col("agreed").alias("form"), (F.col("agreed") == F.col("value")).alias("is_consistent"))


def inconsistent_records(records: DataFrame) -> DataFrame:
    """Of ``field_name, record_id, value`` the records whose value is not in the consistent form, each once, with that form."""
    values = visual_forms(records.select("value"))
    odd = values.where("not is_consistent").select("value", "form")
    return records.where(F.col("record_id").isNotNull()).join(spread(odd), "value").select("field_name", "record_id", "value", "form").dropDuplicates(["field_name", "record_id"])
