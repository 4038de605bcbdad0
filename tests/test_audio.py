"""WAV decoding and resampling."""

import io
import math
import struct
import wave

import numpy as np
import pytest

from turnstream.sources import audio


def riff(tag: int, channels: int, rate: int, bits: int, data: bytes, extra: bytes = b"", extension: bytes = b"") -> bytes:
    block = channels * bits // 8
    form = struct.pack("<HHIIHH", tag, channels, rate, rate * block, block, bits) + extension
    body = b"WAVE" + extra + b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_encodings():
    x = np.array([0.0, 0.5, -0.5, 0.25, -1.0, 0.125])
    ints = (x * 2**31).astype("<i4")
    coded = {
        (1, 8): ((x * 128) + 128).astype(np.uint8).tobytes(),
        (1, 16): (ints >> 16).astype("<i2").tobytes(),
        (1, 24): b"".join(v.tobytes()[1:] for v in ints),
        (1, 32): ints.tobytes(),
        (3, 32): x.astype("<f4").tobytes(),
        (3, 64): x.astype("<f8").tobytes(),
    }
    for (tag, bits), data in coded.items():
        got, rate = audio.wav_samples(riff(tag, 2, 8000, bits, data))
        assert rate == 8000
        assert np.array_equal(got, x.reshape(-1, 2)), (tag, bits)
    wide = struct.pack("<HHI", 22, 24, 3) + struct.pack("<H", 1) + bytes(14)  # the subformat tells the encoding
    got, _ = audio.wav_samples(riff(0xFFFE, 1, 8000, 24, coded[1, 24], b"LIST" + struct.pack("<I", 3) + b"abc\0", wide))
    assert np.array_equal(got[:, 0], x)


def test_logarithmic_codes():
    """Codes whose samples are known: silence, the smallest and the largest steps."""
    mu, _ = audio.wav_samples(riff(7, 1, 8000, 8, bytes([0xFF, 0x7F, 0x80, 0x00, 0xFE])))
    assert (mu[:, 0] * 32768).tolist() == [0, 0, 32124, -32124, 8]
    a, _ = audio.wav_samples(riff(6, 1, 8000, 8, bytes([0xD5, 0x55, 0xAA, 0x2A, 0xD4])))
    assert (a[:, 0] * 32768).tolist() == [8, -8, 32256, -32256, 24]


def test_damaged_files_are_errors(spark):
    good = riff(1, 1, 16_000, 16, b"\0\1" * 10)
    files = [("good", good), ("short", good[:-3]), ("cut", good[:30]), ("none", None), ("empty", b""), ("odd", riff(1, 1, 16_000, 12, b"abc")), ("blockless", riff(1, 0, 16_000, 16, b"ab"))]
    df = spark.createDataFrame([(n, None if c is None else bytearray(c)) for n, c in files], "path string, content binary")
    out = {r.path: (None if r.samples is None else len(r.samples), r.error) for r in audio.decode_wav(df).collect()}
    assert out["good"] == (10, None)
    assert out["short"] == (8, None)  # whole frames of what is there
    assert all(out[n][0] is None and out[n][1] for n in ("cut", "none", "empty", "odd", "blockless"))
    assert audio.decode_wav(df.filter("false")).count() == 0


def brute(x: np.ndarray, rate: int, to: int, zeros: int) -> np.ndarray:
    """Each output as the sum over all inputs of the windowed sinc, divided by the sum that a constant would have."""
    band, out = audio.ROLL_OFF * min(1, to / rate), []
    for n in range(math.ceil(len(x) * to / rate)):
        place = n * rate / to
        j = np.arange(math.floor(place) - 1000, math.floor(place) + 1001)
        t = (place - j) * band
        tap = np.where(np.abs(t) < zeros, np.sinc(t) * (0.42 + 0.5 * np.cos(np.pi * t / zeros) + 0.08 * np.cos(2 * np.pi * t / zeros)), 0)
        inside = (j >= 0) & (j < len(x))
        out.append((tap[inside] * x[j[inside]]).sum() / tap.sum())
    return np.array(out)


@pytest.mark.parametrize(("rate", "to"), [(44_100, 16_000), (8_000, 16_000), (48_000, 16_000), (22_050, 16_000), (3, 2), (2, 7), (16_000, 16_000)])
@pytest.mark.parametrize("n", [0, 1, 5, 333])
def test_resampler_equals_brute_force(rate, to, n):
    x = np.random.default_rng(n).standard_normal(n)
    got = audio.resample(x, rate, to, zeros=8)
    wanted = x if rate == to else brute(x, rate, to, 8)
    assert got.shape == wanted.shape
    assert np.allclose(got, wanted, atol=1e-12)


def test_tones():
    """What the new rate can't hold is gone; what it can hold keeps its size and place; a constant stays one."""
    t = np.arange(44_100) / 44_100
    inside = slice(2000, 14_000)  # away from the ends
    high = audio.resample(np.sin(2 * np.pi * 12_000 * t), 44_100, 16_000)[inside]
    assert np.abs(high).max() < 1e-3  # linear interpolation would leave an alias at 4 kHz
    low = audio.resample(np.sin(2 * np.pi * 1000 * t), 44_100, 16_000)[inside]
    assert np.abs(low - np.sin(2 * np.pi * 1000 * np.arange(16_000) / 16_000)[inside]).max() < 1e-4
    assert np.allclose(audio.resample(np.ones(44_100), 44_100, 16_000)[inside], 1)


def test_decode_resamples_and_mixes(spark):
    t = np.arange(8000) / 8000
    stereo = np.stack([np.sin(2 * np.pi * 440 * t), np.zeros(8000)], axis=1)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes((stereo * 32767).astype("<i2").tobytes())
    df = spark.createDataFrame([("a", bytearray(out.getvalue()))], "path string, content binary")
    got = np.array(audio.decode_wav(df).first().samples)
    assert len(got) == 16_000
    assert np.abs(got - np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000) / 2)[500:-500].max() < 1e-3
