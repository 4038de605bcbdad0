"""Marker text: <|speaker:N|><|start|>text<|end|>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstream.functions.scalars import py_round2

# The marker formats.
SEGMENT = r"(?:<\|speaker:(\d+)\|>)?<\|(\d+\.\d+)\|>(.*?)<\|(\d+\.\d+)\|>"
MARKER = r"<\|-?\d+\.?\d*\|>"
SPECIAL_TOKENS = ["<|startoftranscript|>", "<|endoftext|>", "<|transcribe|>", "<|transcribeprecise|>"]


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def segments_of(text: Column) -> Column:
    """array<struct<speaker, start, end, text>> of the marked segments, in order; speaker null if unmarked."""
    parts = [F.regexp_extract_all(text, F.lit(SEGMENT), F.lit(g)) for g in (1, 2, 3, 4)]
    rows = F.arrays_zip(*(p.alias(n) for p, n in zip(parts, ("k", "s", "t", "e"), strict=True)))
    one = lambda r: F.struct(F.nullif(r["k"], F.lit("")).cast("int").alias("speaker"), r["s"].cast("double").alias("start"), r["e"].cast("double").alias("end"), stripped(r["t"]).alias("text"))
    return F.transform(rows, one)


def parse(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row a segment: the kept columns, id (0, 1, ...), start, end, text, speaker."""
    return df.select(*keep, F.posexplode(segments_of(F.col(text))).alias("id", "m")).select(*keep, "id", "m.start", "m.end", "m.text", "m.speaker")


def marked(start: Column, end: Column, text: Column, speaker: Column | None = None) -> Column:
    """A segment as marker text; times are shown with two places."""
    show = lambda c: F.format_string("<|%.2f|>", c)
    head = F.lit("") if speaker is None else F.when(speaker.isNotNull(), F.concat(F.lit("<|speaker:"), speaker, F.lit("|>"))).otherwise("")
    return F.concat(head, show(start), text, show(end))


def without_markers(text: Column) -> Column:
    return stripped(F.regexp_replace(text, MARKER, ""))


def without_special_tokens(text: Column) -> Column:
    for token in SPECIAL_TOKENS:
        text = F.replace(text, F.lit(token), F.lit(""))
    return text


def shifted(text: Column, offset: Column) -> Column:
    """Every marker's time moved by ``offset`` centiseconds, each once."""
    times = F.regexp_extract_all(text, F.lit(MARKER), F.lit(0))
    moved = F.transform(times, lambda m: F.format_string("<|%.2f|>", (F.round(F.regexp_replace(m, r"[<|>]", "").cast("double") * 100) + offset) / 100))
    texts = F.split(text, MARKER, -1)
    return F.concat(F.array_join(F.flatten(F.zip_with(F.slice(texts, 1, F.size(times)), moved, lambda t, m: F.array(t, m))), ""), F.element_at(texts, -1))


def shifted_segments(df: DataFrame, start: str, end: str, text: str, offset: Column) -> DataFrame:
    """Segments moved by ``offset`` seconds and rounded to two places; a missing time is 0.0, empty texts are dropped."""
    moved = lambda c: py_round2(F.coalesce(F.col(c), F.lit(0.0)) + offset)
    return df.withColumns({start: moved(start), end: moved(end), text: stripped(F.coalesce(F.col(text), F.lit("")))}).filter(F.col(text) != "")


def short_time(seconds: Column) -> Column:
    """Two places without the last zero: 5.0, 3.5, 12.34."""
    return F.regexp_replace(F.format_string("%.2f", seconds), "0$", "")
