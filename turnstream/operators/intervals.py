"""Joins and algebra of intervals, and nearest-neighbour filling. Times are integers (centiseconds)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def best_overlap(segments: DataFrame, turns: DataFrame, key: str, segment_id: str, width: int = 6000) -> DataFrame:
    """key, segment_id, speaker: for each segment the turn with the largest overlap, the first of equal ones.

    segments: key, segment_id, s, e; turns: key, pos, s, e, speaker. Both sides are laid out on a grid of
    ``width``, so a recording with very many turns is joined cell by cell; a pair counts in the cell in
    which its overlap starts. No overlap: a null speaker.
    """
    cells = lambda d: d.withColumn("cell", F.explode(F.sequence(F.floor(F.col("s") / width), F.greatest(F.floor((F.col("e") - 1) / width), F.floor(F.col("s") / width)))))
    a, b = cells(segments.select(key, segment_id, "s", "e").filter("e > s")).alias("a"), cells(turns.select(key, "pos", "s", "e", "speaker").filter("e > s")).alias("b")
    start = F.greatest("a.s", "b.s")
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("b.s") < F.col("a.e")) & (F.col("b.e") > F.col("a.s")) & (F.floor(start / width) == F.col("a.cell"))
    pairs = a.join(b, on).select(F.col(f"a.{key}").alias(key), F.col(f"a.{segment_id}").alias(segment_id), F.struct((F.least("a.e", "b.e") - start).alias("overlap"), (-F.col("b.pos")).alias("back")).alias("rank"), "speaker")
    best = pairs.groupBy(key, segment_id).agg(F.max_by("speaker", "rank").alias("speaker"))
    return segments.select(key, segment_id).join(best, [key, segment_id], "left")


def speaker_number(label: Column) -> Column:
    """SPEAKER_07 -> 7; anything that is no number: 0."""
    return F.coalesce(F.regexp_replace(label, "SPEAKER_", "").try_cast("int"), F.lit(0))


def fill_nearest(rows: DataFrame, key: str, index: str, value: str) -> DataFrame:
    """Replaces nulls of ``value`` by the nearest non-null one of the key, the left of equally near ones; 0 if none."""
    before = Window.partitionBy(key).orderBy(index)
    after = Window.partitionBy(key).orderBy(F.col(index).desc())
    seen = F.when(F.col(value).isNotNull(), F.struct(F.col(index).alias("i"), F.col(value).alias("v")))
    left, right = F.last(seen, True).over(before), F.last(seen, True).over(after)
    both = rows.withColumn("l", left).withColumn("r", right)
    near = F.when(F.col("l").isNull() | (F.col("r.i") - F.col(index) < F.col(index) - F.col("l.i")), F.col("r.v")).otherwise(F.col("l.v"))
    return both.withColumn(value, F.coalesce(near, F.lit(0))).drop("l", "r")


def algebra(s1: Column, e1: Column, s2: Column, e2: Column) -> dict[str, Column]:
    """Intersection, span, gap and predicates of two intervals; an empty intersection has equal ends."""
    s, e = F.greatest(s1, s2), F.least(e1, e2)
    return {
        "intersects": s < e,
        "cut_start": F.when(s < e, s).otherwise(0),
        "cut_end": F.when(s < e, e).otherwise(0),
        "span_start": F.least(s1, s2),
        "span_end": F.greatest(e1, e2),
        "gap": F.greatest(F.lit(0), s - e),
        "contains": (s1 <= s2) & (e2 <= e1),
    }


def clamp_gaps(segments: DataFrame, key: str, order: str, threshold: int) -> DataFrame:
    """A start less than ``threshold`` after the previous end is moved to that end."""
    last = F.lag("e").over(Window.partitionBy(key).orderBy(order))
    return segments.withColumn("s", F.when(F.col("s") - last < threshold, last).otherwise(F.col("s")))


def bucket_for(value: Column, buckets: list[int]) -> Column:
    """The smallest bucket that holds the value; the value itself beyond the last."""
    return F.coalesce(F.array_min(F.filter(F.lit(buckets), lambda b: b >= value)).cast("long"), value)


def points(s: Column, e: Column, t: Column) -> dict[str, Column]:
    """Duration, middle (doubled, so that it stays whole), whether an interval is more than empty, and whether it holds a time."""
    return {"duration": e - s, "middle_x2": s + e, "filled": e > s, "overlaps": (s <= t) & (t <= e)}


def merge_speakers(segments: DataFrame, speaker_data: DataFrame | None, mode: str, key: str, segment_id: str, chunks: DataFrame | None = None) -> DataFrame:
    """segments (key, segment_id, s, e, ...) with ``speaker``, by mode.

    online: chunks (key, chunk_idx, s, e) and speaker_data (key, chunk_idx, speaker); a missing end is the
    start. offline: speaker_data (key, pos, s, e, speaker label); a missing start or end is 0. A segment that
    overlaps nothing, and a chunk without an assignment, speak as 0. Any other mode leaves segments as they are.
    """
    if mode == "online" and chunks is not None:
        rows = segments.withColumn("s", F.coalesce("s", F.lit(0))).withColumn("e", F.coalesce("e", "s"))
        order = F.row_number().over(Window.partitionBy(key).orderBy("s", "chunk_idx"))
        ranges = chunks.select(key, order.alias("pos"), "s", "e", F.col("chunk_idx").alias("speaker"))
        best = best_overlap(rows, ranges, key, segment_id).withColumnRenamed("speaker", "chunk_idx")
        best = best.join(speaker_data.select(key, "chunk_idx", F.col("speaker").cast("int").alias("speaker")), [key, "chunk_idx"], "left")
    elif mode == "offline":
        rows = segments.withColumn("s", F.coalesce("s", F.lit(0))).withColumn("e", F.coalesce("e", F.lit(0)))
        best = best_overlap(rows, speaker_data, key, segment_id).withColumn("speaker", speaker_number(F.col("speaker")))
    else:
        return segments
    return segments.join(best.select(key, segment_id, F.coalesce("speaker", F.lit(0)).alias("speaker")), [key, segment_id])
