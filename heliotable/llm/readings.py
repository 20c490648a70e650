"""How kanji of proper names are read, and what written names share across scripts."""

from __future__ import annotations

import re

# Common readings, in Hepburn letters, of kanji that stand in names of places, people and firms.
KANJI = {
    "浜": "hama", "桜": "sakura", "岩": "iwa", "星": "hoshi", "朝": "asa", "夕": "yu", "青": "ao", "沢": "sawa zawa", "藤": "fuji", "鶴": "tsuru", "柳": "yanagi yana", "栗": "kuri",
    "凪": "nagi", "羽": "ba ha hane wa", "瀬": "se", "台": "dai", "稲": "ine ina", "間": "ma", "霧": "giri kiri", "栄": "sakae", "越": "goe koe koshi", "渡": "wata watari", "里": "ri sato",
    "森": "mori", "亀": "kame", "砂": "suna", "菊": "kiku", "虹": "niji", "石": "ishi", "泉": "izumi sen", "松": "matsu", "萩": "hagi", "竹": "take", "梅": "ume", "杉": "sugi", "雲": "kumo un",
    "原": "hara wara bara", "橋": "bashi hashi", "野": "no", "浦": "ura", "谷": "ya tani", "丘": "oka", "田": "da ta", "之": "no", "町": "machi cho", "ヶ": "ga", "川": "kawa gawa", "山": "yama",
    "島": "shima jima", "木": "ki gi", "本": "moto", "中": "naka", "東": "higashi", "西": "nishi", "南": "minami", "北": "kita", "上": "kami ue", "下": "shimo shita", "大": "o dai", "小": "ko o",
    "岸": "kishi gishi", "岡": "oka", "坂": "saka zaka", "崎": "saki zaki", "池": "ike", "水": "mizu", "金": "kane", "光": "mitsu hikari", "明": "aki mei", "陽": "yo hi", "日": "hi ni", "月": "tsuki",
    "宮": "miya", "神": "kami", "寺": "tera dera", "村": "mura", "内": "uchi", "井": "i", "戸": "to do", "口": "kuchi guchi", "津": "tsu zu", "港": "minato", "海": "umi", "波": "nami", "浪": "nami",
    "風": "kaze", "雪": "yuki", "春": "haru", "夏": "natsu", "秋": "aki", "冬": "fuyu", "花": "hana", "草": "kusa", "葉": "ha", "根": "ne", "林": "hayashi", "樫": "kashi", "栂": "tsuga", "楠": "kusu",
    "峰": "mine", "嶺": "mine rei", "蒼": "ao so", "暁": "akatsuki gyo", "燿": "yo", "磐": "iwa", "座": "kura za", "梓": "azusa azumi", "澪": "mio", "標": "tsukushi hyo", "渓": "kei", "黎": "rei", "堂": "do",
    "平": "hira", "高": "taka", "長": "naga", "広": "hiro", "新": "shin ni", "古": "furu", "白": "shiro", "黒": "kuro", "赤": "aka", "伊": "i", "佐": "sa", "加": "ka", "安": "yasu", "吉": "yoshi", "清": "kiyo",
    "三": "mi", "千": "chi", "和": "wa kazu", "正": "masa", "近": "chika", "遠": "to", "河": "kawa gawa", "沼": "numa", "湖": "mizuumi", "滝": "taki", "鳥": "tori", "鷹": "taka", "熊": "kuma", "馬": "uma ma",
}
READINGS = {k: tuple(v.split()) for k, v in KANJI.items()}
#: So many signs of a name are read out for a join; the whole is then compared by its pattern.
READ_AHEAD = 3


def readable(name: str) -> bool:
    return bool(name) and all(c in READINGS for c in name)


def beginnings(name: str) -> list[str]:
    """Every reading of the first signs of a name; at most the fourth power of three, since no sign has over four readings."""
    out = [""]
    for c in name[:READ_AHEAD]:
        out = [a + b for a in out for b in READINGS[c]]
    return sorted(set(out))


def pattern(name: str) -> str:
    """A regular expression for every reading of the whole name, however long."""
    return "^" + "".join("(?:" + "|".join(READINGS[c]) + ")" for c in name) + "$"


# Letters and pairs that different spellings of one sound share, in the order in which they are replaced.
_SOUNDS = (("ph", "h"), ("f", "h"), ("qu", "k"), ("ck", "k"), ("x", "ks"), ("c(?=[eiy])", "s"), ("[cq]", "k"), ("l", "r"), ("v", "b"), ("ts|dz|j", "z"), ("sh", "s"), ("th", "s"), ("m(?=[bp])", "n"))


def consonants(latin: str) -> str:
    """The consonants of a name in Latin letters, one sign for those that transcriptions confuse, doubled ones once."""
    t = re.sub(r"(.)\1+", r"\1", latin.lower())
    for old, new in _SOUNDS:
        t = re.sub(old, new, t)
    return re.sub("[^bdghkmnprstz]", "", t)
