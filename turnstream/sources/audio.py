"""Audio and message payloads."""

from __future__ import annotations

import base64
import io
import math
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType


def read_audio_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content: one row a file, through Spark's binary reader."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


# --- WAV


def _companded(codes: np.ndarray, law: str) -> np.ndarray:
    """Samples of 8-bit logarithmic codes, in units of 16-bit samples."""
    if law == "mu":
        x = ~codes
        size = (((x & 15).astype(np.int32) << 3) + 132 << ((x >> 4) & 7)) - 132
        return np.where(x & 128, -size, size)
    x = codes ^ 0x55
    step, exponent = (x & 15).astype(np.int32), ((x >> 4) & 7).astype(np.int32)
    size = np.where(exponent == 0, (step << 4) + 8, (step << 4) + 264 << np.maximum(exponent - 1, 0))
    return np.where(x & 128, size, -size)


def wav_samples(content: bytes) -> tuple[np.ndarray, int]:
    """(frames x channels in -1..1, rate) of a RIFF file: PCM of 8, 16, 24, 32 bits, floats of 32 and 64, both logarithmic codes.

    Chunks may come in any order and number; a data chunk that ends early, or has no length yet, gives its whole frames.
    """
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, form, data = 12, None, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt ":
            form = body
        elif name == b"data" and data is None:
            data = body
        at += 8 + size + size % 2
    if form is None or len(form) < 16:
        raise ValueError("no format chunk")
    if data is None:
        raise ValueError("no data chunk")
    tag, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", form)
    if tag == 0xFFFE and len(form) >= 26:
        tag = struct.unpack_from("<H", form, 24)[0]  # of the subformat
    if not channels or not rate or block != channels * bits // 8 or not block:
        raise ValueError("the format chunk is damaged")
    raw = np.frombuffer(data[: len(data) // block * block], dtype=np.uint8)
    if (tag, bits) == (1, 8):
        x = (raw.astype(np.float64) - 128) / 128
    elif tag == 1 and bits in (16, 24, 32):
        wide = np.zeros((len(raw) * 8 // bits, 4), dtype=np.uint8)
        wide[:, 4 - bits // 8 :] = raw.reshape(-1, bits // 8)
        x = wide.view("<i4").ravel() / 2.0**31
    elif tag == 3 and bits in (32, 64):
        x = raw.view(f"<f{bits // 8}").astype(np.float64)
    elif tag in (6, 7) and bits == 8:
        x = _companded(raw, "a" if tag == 6 else "mu") / 32768
    else:
        raise ValueError(f"unknown encoding {tag} of {bits} bits")
    return x.reshape(-1, channels), rate


# --- resampling


ZEROS = 32  # zero crossings of the kernel on either side
ROLL_OFF = 0.95  # of the lower of the two bands


def resample_kernel(rate: int, to: int, zeros: int = ZEROS, roll_off: float = ROLL_OFF) -> tuple[int, int, int, np.ndarray]:
    """(up, down, reach, taps): a windowed sinc for each of the ``up`` phases of an output sample between input samples.

    The band is that of the lower rate, less a margin for the slope, so nothing beyond the new half rate folds back. The
    window is Blackman's; each phase's taps sum to one. Taps of a phase are those of inputs floor(place) - reach + 1 .. + reach.
    """
    if rate < 1 or to < 1:
        raise ValueError("rates must be at least 1")
    up, down = to // math.gcd(rate, to), rate // math.gcd(rate, to)
    band = roll_off * min(1.0, to / rate)
    reach = math.ceil(zeros / band)
    away = np.arange(up)[:, None] / up - np.arange(1 - reach, reach + 1)[None, :]  # of the output from each input
    u = away * band / zeros
    window = np.where(np.abs(u) < 1, 0.42 + 0.5 * np.cos(np.pi * u) + 0.08 * np.cos(2 * np.pi * u), 0.0)
    taps = np.sinc(away * band) * window
    return up, down, reach, taps / taps.sum(axis=1, keepdims=True)


def resample(x: np.ndarray, rate: int, to: int, zeros: int = ZEROS, roll_off: float = ROLL_OFF) -> np.ndarray:
    """Samples at another rate, ceil(n * to / rate) of them; what lies outside the signal is silence.

    Polyphase: outputs of one phase are one product of input windows with that phase's taps, some thousand at a time.
    """
    x = np.asarray(x, dtype=np.float64)
    if rate == to or not len(x):
        return x
    up, down, reach, taps = resample_kernel(rate, to, zeros, roll_off)
    n = -(-len(x) * up // down)
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(x, (reach - 1, reach + down)), 2 * reach)
    out = np.empty(n)
    step = max(1, (1 << 22) // (2 * reach))
    for first in range(min(up, n)):
        at = np.arange(first, n, up)
        phase = int(first * down % up)
        for k in range(0, len(at), step):
            some = at[k : k + step]
            out[some] = windows[some * down // up] @ taps[phase]
    return out


def decode_wav(files: DataFrame, rate: int = 16_000) -> DataFrame:
    """path, samples (mono float at ``rate``), error: WAV files in their encodings; what can't be read has an error.

    Channels are averaged, then the signal is resampled within the band of the lower rate. Null content is an error too.
    """
    schema = pa.schema([("path", pa.string()), ("samples", pa.list_(pa.float32())), ("error", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):  # a file at a time
                samples, error = None, None
                try:
                    frames, own = wav_samples(content.as_py() or b"")
                    samples = resample(frames.mean(axis=1), own, rate).astype(np.float32)
                except (ValueError, struct.error) as e:
                    error = str(e)
                held = pa.ListArray.from_arrays([0, len(samples)], pa.array(samples)) if samples is not None else pa.nulls(1, schema.types[1])
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), held, pa.array([error], pa.string())], schema=schema)

    return files.select("path", "content").mapInArrow(scan, "path string, samples array<float>, error string")


def resampled(samples: Column, rate: int, to: int, zeros: int = ZEROS) -> Column:
    """Arrays of samples at another rate; null stays null."""

    @pandas_udf(ArrayType(DoubleType()))
    def convert(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else resample(x, rate, to, zeros))

    return convert(samples)


@pandas_udf(ArrayType(FloatType()))
def float32_samples(payload: pd.Series) -> pd.Series:
    """Raw little-endian float32; a payload of another length is null, and so told apart as an error."""
    return payload.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))


@pandas_udf(ArrayType(FloatType()))
def int16_samples(payload: pd.Series) -> pd.Series:
    """Raw little-endian int16 over 32768."""
    return payload.map(lambda b: None if b is None or len(b) % 2 else np.frombuffer(b, "<i2").astype(np.float32) / 32768)


@pandas_udf(BinaryType())
def encode_wav(samples: pd.Series) -> pd.Series:
    """16-bit mono WAV at 16 kHz of peak-normalised samples."""

    def one(x) -> bytes | None:
        if x is None:
            return None
        x = np.asarray(x, dtype=np.float64)
        top = np.abs(x).max() if len(x) else 0
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(16_000)
            w.writeframes((np.clip(x / top if top > 0 else x, -1, 1) * 32767).astype("<i2").tobytes())
        return out.getvalue()

    return samples.map(one)


def peak_normalized(samples: Column) -> Column:
    top = F.array_max(F.transform(samples, lambda x: F.abs(x)))
    return F.when(top > 0, F.transform(samples, lambda x: x / top)).otherwise(samples)


def frames_of(recordings: DataFrame, key: str, samples: str, size: int = 512) -> DataFrame:
    """key, frame_no, samples, whole: frames of ``size`` samples; the last may be shorter."""
    n = F.size(samples)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    # frames are cut before they become rows, so no row holds the whole recording beside its frame
    cut = F.transform(starts, lambda k: F.struct(k.alias("frame_no"), F.slice(samples, k * size + 1, F.lit(size)).alias("samples")))
    return recordings.select(key, F.explode(cut).alias("f")).select(key, "f.frame_no", "f.samples").withColumn("whole", F.size("samples") == size)


@pandas_udf(BinaryType())
def from_base64(payload: pd.Series) -> pd.Series:
    """Bytes of base64 text; text that is none is null."""

    def one(x: str | None) -> bytes | None:
        try:
            return None if x is None else base64.b64decode(x, validate=True)
        except ValueError:
            return None

    return payload.map(one)


@pandas_udf(BinaryType())
def pcm_stream(samples: pd.Series) -> pd.Series:
    """16-bit samples as a mono WAV stream at 24 kHz."""

    def one(x) -> bytes | None:
        if x is None:
            return None
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(24_000)
            w.writeframes(np.asarray(x, dtype="<i2").tobytes())
        return out.getvalue()

    return samples.map(one)


def event_lines(lines: DataFrame, text: str, schema: str) -> DataFrame:
    """Lines that start with "data:", their rest as JSON; the [DONE] line is left out."""
    rest = F.trim(F.substring(F.col(text), 6, 1 << 30))
    return lines.filter(F.col(text).startswith("data:")).withColumn("rest", rest).filter("rest <> '[DONE]'").withColumn("event", F.from_json("rest", schema)).drop("rest")


def messages_json(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """One JSON object of the columns a row in ``value``; null members are left out. Kept columns stay beside it."""
    return df.select(*(keep or []), F.to_json(F.struct(*columns)).alias("value"))
