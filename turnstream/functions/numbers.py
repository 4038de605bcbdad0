"""Whole numbers in words and back, English and Malay, by one recursive grammar of units, tens and scales."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

LARGEST = 10**15 - 1

# fixed values: the words of the two languages
_ENGLISH = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_SCALES = {"en": ["", "thousand", "million", "billion", "trillion"], "ms": ["", "ribu", "juta", "bilion", "trilion"]}
_MALAY = "kosong satu dua tiga empat lima enam tujuh lapan sembilan".split()
_ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}


def _below_thousand(n: int, language: str) -> list[str]:
    """Words of 1 to 999."""
    hundreds, rest = divmod(n, 100)
    out = []
    if language == "ms":
        one = lambda k, of: ["se" + of] if k == 1 else [_MALAY[k], of]
        out += one(hundreds, "ratus") if hundreds else []
        if 10 < rest < 20:
            return out + one(rest - 10, "belas")
        return out + (one(rest // 10, "puluh") if rest >= 10 else []) + ([_MALAY[rest % 10]] if rest % 10 else [])
    out += [_ENGLISH[hundreds], "hundred"] if hundreds else []
    if rest < 20:
        return out + ([_ENGLISH[rest]] if rest else [])
    return out + [_TENS[rest // 10 - 2]] + ([_ENGLISH[rest % 10]] if rest % 10 else [])


def number_words(n: int, language: str = "en") -> str:
    """A number in words; "minus" or "negatif" before one below zero. Up to LARGEST either way."""
    if language not in _SCALES:
        raise ValueError("language must be en or ms")
    if abs(n) > LARGEST:
        raise ValueError(f"numbers go to {LARGEST}")
    if n < 0:
        return ("minus " if language == "en" else "negatif ") + number_words(-n, language)
    if n == 0:
        return "zero" if language == "en" else _MALAY[0]
    out = []
    for power in range(4, -1, -1):
        part = n // 1000**power % 1000
        if part == 1 and power == 1 and language == "ms":
            out.append("seribu")
        elif part:
            out += _below_thousand(part, language) + ([_SCALES[language][power]] if power else [])
    return " ".join(out)


def ordinal_words(n: int, language: str = "en") -> str:
    """first, twenty third, hundredth; pertama, kedua."""
    if language == "ms":
        return "pertama" if n == 1 else "ke" + number_words(n, language)
    *before, last = number_words(n).split()
    if last not in _ORDINALS:
        last = last[:-1] + "ieth" if last.endswith("y") else last + "th"
    else:
        last = _ORDINALS[last]
    return " ".join([*before, last])


def words_number(text: str, language: str = "en") -> int:
    """The number that words say; ValueError if they say none."""
    words = text.split()
    if words and words[0] in ("minus", "negatif"):
        return -words_number(" ".join(words[1:]), language)
    units = {w: i for i, w in enumerate(_ENGLISH)} | {w: 10 * i + 20 for i, w in enumerate(_TENS)} if language == "en" else {w: i for i, w in enumerate(_MALAY)}
    scales = {w: 1000**i for i, w in enumerate(_SCALES[language]) if w}
    if language == "ms":
        words = [x for w in words for x in (["satu", w[2:]] if w in ("sepuluh", "sebelas", "seratus", "seribu") else [w])]
    total = part = 0
    unit = 0
    if not words:
        raise ValueError("no words")
    for w in words:
        if w in scales:
            total, part, unit = total + (part + unit) * scales[w], 0, 0
        elif w in ("hundred", "ratus"):
            part, unit = part + unit * 100, 0
        elif w == "puluh":
            part, unit = part + unit * 10, 0
        elif w == "belas":
            part, unit = part + unit + 10, 0
        elif w in units:
            unit += units[w]
        else:
            raise ValueError(f"no word of a number: {w}")
    return total + part + unit


_IN_TEXT = re.compile(r"(?<![\w.,])(?:(\d{1,3}(?:,\d{3})+|\d+)(st|nd|rd|th)|(ke-)(\d+)|(-?)(\d{1,3}(?:,\d{3})+|\d+)(\.\d+)?)(?![\w]|[.,]\d)")


def speak(text: str, language: str = "en") -> str:
    """A text with its numbers in words: whole ones, thousands with commas, decimals digit by digit, ordinals (21st, ke-21).

    Numbers that are part of a word, of a date or address, or beyond LARGEST, stay as they are.
    """

    def one(m: re.Match) -> str:
        digits = (m[1] or m[4] or m[6]).replace(",", "")
        if int(digits) > LARGEST or (m[1] and language != "en") or (m[3] and language != "ms"):
            return m[0]
        if m[1] or m[3]:
            return ordinal_words(int(digits), language)
        sign = ("minus " if language == "en" else "negatif ") if m[5] else ""
        point = ""
        if m[7]:
            point = (" point " if language == "en" else " perpuluhan ") + " ".join(number_words(int(d), language) for d in m[7][1:])
        return sign + number_words(int(digits), language) + point

    return _IN_TEXT.sub(one, text)


def spoken(text: Column, language: str = "en") -> Column:
    """``speak`` of a column; null stays null."""
    number_words(0, language)  # tells an unknown language at once

    @pandas_udf("string")
    def convert(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else speak(x, language))

    return convert(text)
