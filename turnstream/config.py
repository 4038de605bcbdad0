"""Defaults and request validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The defaults.
SAMPLE_RATE = 16_000
FRAME_SAMPLES = 512
MAX_CHUNK_SECONDS = 25
MINIMUM_SILENT_MS = 200
MINIMUM_TRIGGER_VAD_MS = 1500
REJECT_SEGMENT_VAD_RATIO = 0.9
VAD_WORKERS = 8
SPEAKER_SIMILARITY = 0.5
SPEAKER_MAX_N = 5
MIN_CHUNK_SAMPLES = 8000
MICRO_BATCH = 8

# What requests may ask for.
LANGUAGES = ["none", "null", "en", "ms", "zh", "ta"]
RESPONSE_FORMATS = ["text", "json", "verbose_json"]
DIARIZATIONS = ["none", "online", "offline"]


@dataclass(frozen=True)
class Cutting:
    """Silence cutting in whole samples: all comparisons are between integers."""

    minimum_trigger_ms: int = MINIMUM_TRIGGER_VAD_MS
    minimum_silent_ms: int = MINIMUM_SILENT_MS
    max_seconds: int = MAX_CHUNK_SECONDS
    sample_rate: int = SAMPLE_RATE

    def __post_init__(self):
        if min(self.minimum_trigger_ms, self.minimum_silent_ms, self.max_seconds, self.sample_rate) < 1:
            raise ValueError("cutting parameters must be at least 1")


def validate_request(language: str | None, response_format: str, diarization: str) -> tuple[str, str, str]:
    """Lower-cased, stripped values; ValueError if one is not allowed. A missing language is "null"."""
    out = []
    for what, value, allowed in (("language", "null" if language is None else language, LANGUAGES), ("response_format", response_format, RESPONSE_FORMATS), ("diarization", diarization, DIARIZATIONS)):
        value = value.lower().strip()
        if value not in allowed:
            raise ValueError(f"{what} must be one of {allowed}")
        out.append(value)
    return tuple(out)


def valid_parameters(similarity: Column, max_n: Column, silent: Column, trigger: Column, ratio: Column) -> Column:
    """Exclusive ranges of similarity, maximum speakers and rejection ratio; at least one for the times."""
    between = lambda c, a, b: (c > a) & (c < b)
    return between(similarity, 0, 1) & between(max_n, 1, 100) & (silent >= 1) & (trigger >= 1) & between(ratio, 0, 1)


def checked(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """Rows as they are; the query fails with the message at the first row that is not ok."""
    return df.filter(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.lit(message)).isNotNull()))
