"""Numbers in words, romanisation and loudness: hand-written expectations, round trips and brute force."""

import random

import numpy as np
import pytest

from turnstream.functions import numbers, romanize
from turnstream.operators import loudness


@pytest.mark.parametrize("language", ["en", "ms"])
def test_numbers_round_trip(language):
    rng = random.Random(1)
    some = [*range(2100), *(10**k + d for k in range(3, 13) for d in (-1, 0, 1)), *(rng.randrange(10**12) for _ in range(20_000)), numbers.LARGEST, -7]
    seen = {}
    for n in some:
        words = numbers.number_words(n, language)
        assert numbers.words_number(words, language) == n
        assert seen.setdefault(words, n) == n


def test_number_words():
    assert numbers.number_words(1_012_345) == "one million twelve thousand three hundred forty five"
    assert numbers.number_words(1_100_011, "ms") == "satu juta seratus ribu sebelas"
    assert numbers.number_words(1_019, "ms") == "seribu sembilan belas"
    assert [numbers.ordinal_words(n) for n in (1, 12, 20, 33, 100, 1008)] == ["first", "twelfth", "twentieth", "thirty third", "one hundredth", "one thousand eighth"]
    assert [numbers.ordinal_words(n, "ms") for n in (1, 2, 21)] == ["pertama", "kedua", "kedua puluh satu"]
    assert numbers.speak("I paid 1,250 for 3.05 kg on the 21st, not -4.") == "I paid one thousand two hundred fifty for three point zero five kg on the twenty first, not minus four."
    assert numbers.speak("ke-2 dan 15 buku", "ms") == "kedua dan lima belas buku"
    assert numbers.speak("v2 1.2.3.4 12,34 " + "9" * 20) == "v2 1.2.3.4 12,34 " + "9" * 20
    with pytest.raises(ValueError):
        numbers.number_words(1, "xx")
    with pytest.raises(ValueError):
        numbers.words_number("many")


def test_scripts():
    expected = {
        "한국어": "hangukeo", "서울": "seoul", "안녕하세요": "annyeonghaseyo",
        "ひらがな": "hiragana", "カタカナ": "katakana", "がっこう": "gakkou", "きょう": "kyou", "マッチ": "matchi", "しゃしん": "shashin", "ラーメン": "raamen",
        "Москва": "Moskva", "щука": "shchuka", "Київ": "Kiyiv", "объект": "obekt",
        "Ελλάδα": "Ellada", "ουρανός": "ouranos", "άγγελος": "angelos",
        "नमस्ते": "namaste", "हिन्दी": "hindii", "भारत": "bhaarata", "१२": "12",
        "plain ASCII, 12": "plain ASCII, 12", "漢字": "漢字", "": "",
    }
    assert {k: romanize.romanize(k) for k in expected} == expected


def test_columns(spark):
    df = spark.createDataFrame([("Москва 21",), (None,), ("",), ("abc",)], "t string")
    assert [r[0] for r in df.select(romanize.romanized("t")).collect()] == ["Moskva 21", None, "", "abc"]
    assert [r[0] for r in df.select(numbers.spoken("t")).collect()] == ["Москва twenty one", None, "", "abc"]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_filter_equals_its_recurrence(n):
    x = np.random.default_rng(n).standard_normal(n)
    for b, a in loudness.weighting(16_000):
        y = [0.0, 0.0]
        z = [0.0, 0.0, *x]
        for k in range(n):
            y.append(b[0] * z[k + 2] + b[1] * z[k + 1] + b[2] * z[k] - a[1] * y[k + 1] - a[2] * y[k])
        assert np.allclose(loudness.recursive(x, b, a), y[2:], atol=1e-10)


@pytest.mark.parametrize("rate", [48_000, 44_100, 16_000])
def test_tones_read_right(rate):
    """A full tone of 997 Hz in one channel is -3.01 LUFS; half of it is 6.02 less; silence between does not count."""
    t = np.arange(5 * rate) / rate
    x = np.sin(2 * np.pi * 997 * t)
    assert abs(loudness.integrated(x, rate) + 3.01) < 0.1
    assert abs(loudness.integrated(x / 2, rate) + 9.03) < 0.1
    assert abs(loudness.integrated(np.concatenate([x, np.zeros(5 * rate)]), rate) + 3.01) < 0.3
    assert loudness.integrated(np.zeros(rate), rate) == -np.inf
    assert loudness.integrated(np.zeros(0), rate) == -np.inf


def test_published_coefficients():
    """The recommendation prints the two filters at 48 kHz."""
    (b, a), (_, c) = loudness.weighting(48_000)
    assert np.allclose(b, [1.53512485958697, -2.69169618940638, 1.19839281085285], atol=1e-8)
    assert np.allclose(a[1:], [-1.69065929318241, 0.73248077421585], atol=1e-8)
    assert np.allclose(c[1:], [-1.99004745483398, 0.99007225036621], atol=1e-8)


def test_normalisation_by_each_rows_language(spark):
    """A column of languages gives each row what its language alone gives."""
    from pyspark.sql import functions as F

    from turnstream.functions.normalize import text_normalize

    text = "Café\u00ad שָׁלוֹם ก\u200dข (12) 7 x, y"
    languages = ["eng", "mon", "khk", "heb", "tha", "jav", "jpn", None]
    df = spark.createDataFrame([(i, k, text) for i, k in enumerate(languages)], "i int, language string, t string")
    got = [r[0] for r in df.orderBy("i").select(text_normalize(F.col("t"), F.col("language"))).collect()]
    alone = [df.filter(F.col("i") == i).select(text_normalize(F.col("t"), k or "*")).first()[0] for i, k in enumerate(languages)]
    assert got == alone
    assert len(set(got)) >= 5
