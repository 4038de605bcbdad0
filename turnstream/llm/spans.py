"""Matches of regular expressions as spans of code points, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCATED = "array<struct<gap:string,match:string,part:string,start:int,end:int>>"
SPAN = "struct<kind:string,start:int,end:int>"


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<gap, match, part, start, end>>: leftmost non-overlapping matches from left to right.

    gap is the text before a match since the last one, part the given group of the match. A match's place
    is the length of all gaps and matches before it. No match, or null text: an empty array.
    """
    regex = F.lit(pattern)
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, regex, F.lit(0))
    parts = matches if group == 0 else F.regexp_extract_all(text, regex, F.lit(group))
    rows = F.filter(F.arrays_zip(gaps.alias("gap"), matches.alias("match"), parts.alias("part")), lambda r: r["match"].isNotNull())
    return let(rows, lambda r: F.when(F.size(r) > 0, _placed(r)).otherwise(F.array().cast(LOCATED)))


def let(value: Column, body) -> Column:
    """body(value), with the value computed once: what lambdas mention would be computed at each call."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _placed(rows: Column) -> Column:
    """Running lengths, by blocks of about the square root of the number of rows.

    Appending to an array copies it, so one fold over n matches would cost n*n; blocks cost n*sqrt(n).
    """
    return let(F.ceil(F.sqrt(F.size(rows))).cast("int"), lambda size: _by_blocks(rows, size))


def _by_blocks(rows: Column, size: Column) -> Column:
    length = lambda r: F.length(r["gap"]) + F.length(r["match"])
    total = lambda part: F.aggregate(part, F.lit(0), lambda n, r: n + length(r))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / size).cast("int")), lambda b: F.slice(rows, b * size + 1, size))

    def row_step(state: Column, row: Column) -> Column:
        begin = state["at"] + F.length(row["gap"])
        end = begin + F.length(row["match"])
        found = F.struct(row["gap"].alias("gap"), row["match"].alias("match"), row["part"].alias("part"), begin.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(found)).alias("out"))

    def block_step(state: Column, block: Column) -> Column:
        start = F.struct(state["at"].alias("at"), F.array().cast(LOCATED).alias("out"))
        done = F.aggregate(block, start, row_step, lambda s: s["out"])
        return F.struct((state["at"] + total(block)).alias("at"), F.concat(state["out"], F.array(done)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{LOCATED}>").alias("out"))
    return F.aggregate(blocks, start, block_step, lambda s: F.flatten(s["out"]))


def as_spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def by_kind(spans: Column, kinds: list[str]) -> Column:
    """Ordered by kind as listed, then start, then end."""
    keyed = F.transform(spans, lambda s: F.struct(F.array_position(F.lit(kinds), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def by_start(spans: Column, kinds: list[str]) -> Column:
    """Ordered by start, then kind as listed, then end."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.lit(kinds), s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def overlaps(spans: Column, start: Column, end: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < end) & (s["end"] > start))
