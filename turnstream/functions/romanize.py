"""Latin letters for other scripts: a longest-match transducer over rewrite rules by script.

Hangul is taken apart by arithmetic; kana, Cyrillic, Greek and Devanagari have tables. Signs without a rule stay, so Latin
text, digits and scripts that are not here (Han among them) go through as they are.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

# fixed values: the public transcription tables, in each script's order
_INITIAL = "g kk n d tt r m b pp s ss _ j jj ch k t p h".replace("_", "").split(" ")
_MEDIAL = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split()
_FINAL = ["", *"k k k n n n t l k m l l l p l m p p t t ng t t k t p t".split()]

_ROWS = {"": "あいうえお", "k": "かきくけこ", "s": "さしすせそ", "t": "たちつてと", "n": "なにぬねの", "h": "はひふへほ", "m": "まみむめも", "r": "らりるれろ", "g": "がぎぐげご", "z": "ざじずぜぞ", "d": "だぢづでど", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ"}
_ODD = {"し": "shi", "ち": "chi", "つ": "tsu", "ふ": "fu", "じ": "ji", "ぢ": "ji", "づ": "zu", "や": "ya", "ゆ": "yu", "よ": "yo", "わ": "wa", "ゐ": "i", "ゑ": "e", "を": "o", "ん": "n", "ゔ": "vu", "ぁ": "a", "ぃ": "i", "ぅ": "u", "ぇ": "e", "ぉ": "o"}

_CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяёіїєґ", "a b v g d e zh z i y k l m n o p r s t u f kh ts ch sh shch _ y _ e yu ya yo i yi ye g".replace("_", "").split(" "), strict=True))
_GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a v g d e z i th i k l m n x o p r s s t y f ch ps o".split(), strict=True)) | {"ου": "ou", "αι": "ai", "ει": "ei", "οι": "oi", "αυ": "av", "ευ": "ev", "γγ": "ng", "γκ": "gk", "γχ": "nch", "γξ": "nx"}
_GREEK |= dict(zip("άέήίόύώϊϋΐΰ", "a e i i o y o i y i y".split(), strict=True)) | {"ού": "ou", "αί": "ai", "εί": "ei", "οί": "oi", "αύ": "av", "εύ": "ev"}
_CONSONANTS = dict(zip("कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसह", "k kh g gh n ch chh j jh n t th d dh n t th d dh n p ph b bh m y r l v sh sh s h".split(), strict=True))
_VOWELS = dict(zip("अआइईउऊऋएऐओऔ", "a aa i ii u uu ri e ai o au".split(), strict=True))
_SIGNS = dict(zip("ािीुूृेैोौ", "aa i ii u uu ri e ai o au".split(), strict=True))
_VIRAMA = "्"


def _kana() -> dict[str, str]:
    out = {c: row + v for row, signs in _ROWS.items() for c, v in zip(signs, "aiueo", strict=True)} | _ODD
    for c in "きぎにひびぴみりしちじ":
        stem = out[c][:-1]
        for small, v in zip("ゃゅょ", "auo", strict=True):
            out[c + small] = stem + ("" if c in "しちじ" else "y") + v
    out |= {"っ" + c: ("t" if s.startswith("ch") else s[0]) + s for c, s in list(out.items()) if s[0] not in "aiueon"}  # the first consonant twice
    return out | {"".join(chr(ord(x) + 0x60) for x in c): s for c, s in out.items()}  # katakana lies behind hiragana


def _devanagari() -> dict[str, str]:
    out = dict(_VOWELS) | {"ं": "n", "ँ": "n", "ः": "h", "।": ".", _VIRAMA: ""}
    for c, s in _CONSONANTS.items():
        out |= {c: s + "a", c + _VIRAMA: s} | {c + sign: s + v for sign, v in _SIGNS.items()}
    return out | {chr(0x966 + i): str(i) for i in range(10)}


RULES: dict[str, str] = _kana() | _CYRILLIC | _GREEK | _devanagari()
LONGEST = max(map(len, RULES))
_VOWEL_END = "aiueo"


def _one(c: str) -> str | None:
    """A sign without a table: a Hangul syllable by its number."""
    k = ord(c) - 0xAC00
    if 0 <= k < 11172:
        return _INITIAL[k // 588] + _MEDIAL[k % 588 // 28] + _FINAL[k % 28]
    return None


def romanize(text: str) -> str:
    """Each longest run of signs that a rule is for becomes its letters; the capital first letter of a word stays one.

    A long-vowel mark repeats the vowel before it. The text should be in composed form (NFC).
    """
    out: list[str] = []
    i, lowered = 0, "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    while i < len(text):
        for n in range(min(LONGEST, len(text) - i), 0, -1):
            found = RULES.get(lowered[i : i + n])
            if found is None and n == 1:
                found = _one(text[i])
            if found is not None:
                out.append(found.capitalize() if text[i] != lowered[i] else found)
                break
        else:
            n = 1
            last = out[-1][-1:] if out else ""
            out.append(last if text[i] == "ー" and last in _VOWEL_END else text[i])
        i += n
    return "".join(out)


def romanized(text: Column) -> Column:
    """``romanize`` of a column; null stays null, ASCII text is passed on."""

    @pandas_udf("string")
    def convert(values: pd.Series) -> pd.Series:
        return values.map(lambda x: x if x is None or x.isascii() else romanize(x))

    return convert(text)
