"""Words of estimate lines: how the same equipment, material or work is also written.

Fixed values: trade vocabulary. The reference entries themselves come from the
table; this list only says which words mean the same.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from heliotable.llm.visual_text import KANJI_KANA, consistent_form

# Things.
TERMS: dict[str, str] = {
    "太陽電池モジュール": "太陽電池パネル PVモジュール ソーラーパネル PVパネル 太陽光パネル 太陽光モジュール",
    "パワーコンディショナ": "パワーコンディショナー パワコン PCS",
    "直流接続箱": "DC接続箱 ジャンクションボックス",
    "集電盤": "DC集電盤 集電キャビネット",
    "蓄電池ユニット": "蓄電ユニット バッテリーユニット",
    "昇圧変圧器": "昇圧トランス 昇圧用変圧器",
    "計測監視端末": "モニタリング端末 監視端末 データロガー",
    "日射計": "日射センサー 日射量計",
    "外気温計": "外気温センサー 気温計",
    "出力制御装置": "出力制御ユニット 出力コントローラ 出力コントローラー",
    "保護継電器盤": "継電器盤 保護リレー盤",
    "架台レール": "レール架台 縦桟レール",
    "屋根支持金具": "支持金具 ルーフ金具",
    "コンクリート基礎": "コンクリ基礎 CO基礎ブロック コンクリート基礎ブロック",
    "ストリングケーブル": "ストリング線 ストリング配線材 ストリング線材",
    "直流幹線ケーブル": "直流幹線 DC幹線",
    "交流幹線ケーブル": "交流幹線 AC幹線",
    "通信ケーブル": "LANケーブル 信号ケーブル",
    "接地線": "アース線 接地用電線",
    "厚鋼電線管": "厚鋼管 鋼製電線管",
    "可とう電線管": "プリカ管 フレキ管",
    "ケーブルラック": "配線ラック ラック材",
    "端子台": "ターミナルブロック 端子ブロック",
    "防水コネクタ": "防水コネクター MCコネクタ MCコネクター",
    "負荷開閉器": "開閉スイッチ LBS",
    "漏電遮断器": "漏電ブレーカー ELB",
    "避雷素子": "アレスタ SPD アレスター",
    "昇降足場": "階段足場 昇降用足場",
    "養生シート": "シート養生 防炎シート",
    "揚重車両": "クレーン車 レッカー車",
    "仮設電源": "仮設電気 臨時電源",
    "安全柵": "防護柵 安全フェンス",
    "現場事務所": "仮設ハウス 現場小屋",
    "資材小運搬": "小運搬 資材場内運搬",
    "屋根貫通部": "屋根貫通口 ルーフ貫通部",
    "接地極": "接地棒 アース棒",
    "絶縁抵抗測定": "絶縁測定 メガー測定",
    "系統連系試験": "連系試験 系統連系確認試験",
    "竣工図書作成": "竣工図作成 完成図書作成",
    "施工管理": "工程管理費 現場管理 施工管理費 現場管理費",
    "表示銘板": "銘板 標識板",
}
# Works done on things.
WORKS: dict[str, str] = {
    "据付": "据え付け すえつけ 据付け 据付工事",
    "取付": "取付け 取り付け とりつけ 取付工事",
    "結線": "配線接続 つなぎ込み 結線工事",
    "敷設": "布設 引き込み敷設 敷設工事",
    "撤去": "取外し 取り外し 撤去工事",
    "設定": "設定作業 初期設定",
    "設置": "据え置き設置 設置工事",
    "荷揚げ": "荷上げ 荷揚 揚重",
    "試運転調整": "試運転 調整 試運転・調整",
    "試験": "動作試験 試験調整",
    "組立": "組み立て 組立工事",
    "解体": "ばらし 解体作業",
    "張り": "展張 張り工事",
    "手配": "手配費 チャーター",
    "打込": "打ち込み 埋設打込 打込み",
    "防水処理": "止水処理 シーリング",
}

# Marks and words around a description that say nothing about the item.
_MARKS = re.compile(r"^(?:[\s①-⑳❶-❿○◎●◇◆□■・※★☆*＊]+|[(（]追[)）]|[(（]\d+[)）]|\d+[.．、)）])+")
_ASIDE = re.compile(r"(?:\((?:材工|税別|税込|追加|追|別途|材工共|一式)\)|一式|[\s　]他|\s別途)+$")

# Units of a specification and their one spelling.
_SPEC = re.compile(
    r"(?P<kw>\d+(?:\.\d+)?)\s*(?:kw|キロワット)"
    r"|(?P<sq>\d+(?:\.\d+)?)\s*(?:sq|mm2|mm²|㎟|スケ)"
    r"|φ\s*(?P<mm1>\d+)|(?P<mm2>\d+)\s*(?:mm(?!2)|φ|ミリ)|^\((?P<mm3>\d+)\)|(?<=[\s/])\((?P<mm4>\d+)\)"
    r"|(?P<cct>\d+)\s*(?:回路用|回路|cct)"
)


@lru_cache(maxsize=200_000)
def fold(text: str) -> str:
    """One spelling of width, case, kana kind and look-alikes; no spaces or brackets."""
    t = unicodedata.normalize("NFKC", text).lower()
    t = "".join(chr(ord(c) + 0x60) if "ぁ" <= c <= "ゖ" else KANJI_KANA.get(c, c) for c in t)
    return re.sub(r"[\s()\[\]【】・/／,、。_\-:：]+", "", t)


def plain_words(text: str | None) -> str:
    """A typed description without marks, asides and specification, folded for comparison. Null gives ''."""
    t = consistent_form(text) or ""
    t = _MARKS.sub("", t)
    t = unicodedata.normalize("NFKC", t).strip()
    t = _SPEC.sub("", t.lower()).strip()
    for _ in range(3):
        t = _ASIDE.sub("", t).strip()
    return fold(t)


def specification(*texts: str | None) -> tuple[str, ...]:
    """The sizes that texts state, in one spelling and order. Nulls and texts without any give ()."""
    found = set()
    for text in texts:
        t = unicodedata.normalize("NFKC", consistent_form(text) or "").lower()
        for m in _SPEC.finditer(t):
            kind = m.lastgroup.rstrip("1234")
            value = m[m.lastgroup]
            found.add(f"{float(value):g}{kind}")
    return tuple(sorted(found))


def rest_of_remarks(text: str | None) -> str:
    """What remarks say besides sizes: the place. Null gives ''."""
    t = unicodedata.normalize("NFKC", consistent_form(text) or "").lower()
    return fold(_SPEC.sub(" ", t))


def spellings(entry: str) -> set[str]:
    """Every path by which an entry may be written: its words, their other words, and their order."""
    whole = {entry, *TERMS.get(entry, "").split()}
    for work, also in WORKS.items():
        thing = entry.removesuffix(work)
        if thing and thing != entry and (thing in TERMS or not whole - {entry}):
            things = {thing, *TERMS.get(thing, "").split()}
            works = {work, *also.split()}
            works |= {w + "工事" for w in works if not w.endswith(("工事", "作業", "費"))}
            for t in things:
                for w in works:
                    whole |= {t + w, w + t, t + "の" + w}
                    if t.endswith(("シート", "養生")) and work == "張り":
                        whole.add(t + w)
    return {fold(w) for w in whole if w}
