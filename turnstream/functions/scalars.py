"""Small functions of values."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType


def clock(millis: Column) -> Column:
    """Signed H:M:S.mmm of milliseconds; a space in front of what is not negative."""
    a = F.abs(millis)
    part = lambda unit, most: (F.floor(a / unit) % most).cast("int")
    sign = F.when(millis < 0, "-").otherwise(" ")
    return F.format_string("%s%02d:%02d:%02d.%03d", sign, F.floor(a / 3_600_000).cast("int"), part(60_000, 60), part(1000, 60), part(1, 1000))


def clamped_share(value: Column, low: float, high: float) -> Column:
    """Where a value lies between low and high, from 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - F.lit(low)) / F.lit(high - low)))


def int16_wrapped(share: Column) -> Column:
    """share * 32768 without its fraction, as 16 bits: exactly one becomes the lowest value."""
    n = (share * 32768).cast("long") + 32768
    return ((n % 65536 + 65536) % 65536 - 32768).cast("int")


def faded_int16(samples: Column, fade: int) -> Column:
    """Samples clipped to [-1, 1], the last ``fade`` of them fading to zero in a line, as 16 bits."""
    n = F.size(samples)
    weight = lambda i: F.when((n > fade) & (i >= n - fade), (n - 1 - i) / F.lit(max(1, fade - 1))).otherwise(1.0)
    return F.transform(samples, lambda x, i: (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * weight(i) * 32767).cast("int"))


def from_log(x: Column) -> Column:
    return F.pow(F.lit(10.0), F.least(x, F.lit(5.0)))


def codec_tokens(text: Column) -> Column:
    """The numbers of s_N or speech_N in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?:speech|s)_(\d+)"), F.lit(1)), lambda n: n.cast("int"))


def spaced_alpha_num(text: Column) -> Column:
    """Letters and digits that touch are parted; single characters are upper-cased; one space between words."""
    parted = F.regexp_replace(F.regexp_replace(text, r"(?<=\p{L})(?=\d)|(?<=\d)(?=\p{L})", " "), r"\s+", " ")
    words = F.filter(F.split(F.trim(parted), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(F.length(w) == 1, F.upper(w)).otherwise(w)), " ")


@pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Spark has no function for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@pandas_udf(StringType())
def without_accents(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)))


@pandas_udf(DoubleType())
def py_round2(x: pd.Series) -> pd.Series:
    """Two places, the exact binary value rounded half to even: what wire output has."""
    return x.map(lambda v: None if pd.isna(v) else round(v, 2))
