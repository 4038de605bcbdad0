"""Ordered folds by key over streams of any length.

Rows are dealt by key and sorted; a task reads its sorted rows batch by batch and keeps only the fold's
state, so a stream that holds a third of all rows needs no more memory than a short one. Where a stream may
be cut into ranges (``parts``), the range is part of the key and one stream spreads over several tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Fold:
    """One stream's state. ``take`` gets the columns of its next rows, ``end`` closes it; both return rows."""

    def take(self, columns: dict[str, np.ndarray]) -> list[tuple]:
        raise NotImplementedError

    def end(self) -> list[tuple]:
        return []


def fold(df: DataFrame, keys: list[str], order: list[str], values: list[str], make: Callable[[], Fold], out: str) -> DataFrame:
    """Rows of the folds, each with its stream's keys in front. ``out``: the DDL of what folds return."""
    chosen = list(dict.fromkeys([*keys, *order, *values]))
    rows = df.select(*chosen).repartition(*keys).sortWithinPartitions(*keys, *order)
    key_ddl = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ddl = f"{key_ddl}, {out}"
    schema = to_arrow_schema(_parse_datatype_string(ddl))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def table(found: list[tuple]) -> Iterator[pa.RecordBatch]:
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            n, found = batch.num_rows, []
            if not n:
                continue
            key_columns = [batch.column(k).to_pylist() for k in keys]
            columns = {v: _values(batch.column(v)) for v in dict.fromkeys([*order, *values])}
            rows_keys = list(zip(*key_columns, strict=True))
            at = [0, *(i for i in range(1, n) if rows_keys[i] != rows_keys[i - 1]), n]
            for a, b in zip(at[:-1], at[1:], strict=True):
                if state is None or rows_keys[a] != key:
                    if state is not None:
                        found += [(*key, *r) for r in state.end()]
                    key, state = rows_keys[a], make()
                found += [(*key, *r) for r in state.take({v: c[a:b] for v, c in columns.items()})]
            yield from table(found)
        if state is not None:
            yield from table([(*key, *r) for r in state.end()])

    return rows.mapInArrow(scan, ddl)


def _values(column: pa.Array) -> np.ndarray:
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        out = np.empty(len(column), dtype=object)
        out[:] = column.to_pylist()
        return out
    return column.to_numpy(zero_copy_only=False)


class Segmenter(Fold):
    """Cuts frames into chunks at silence or length: (chunk_idx, start_frame, end_frame, n_silent, n_samples).

    A chunk closes at a frame where it is long enough and the silence at its end is, or where it is at its
    longest; silence and counts start anew. What is left at the end is a chunk too, unless ``tail`` is off.
    """

    def __init__(self, trigger_ms: int, silent_ms: int, max_seconds: int, rate: int, tail: bool = True):
        self.trigger, self.silent, self.longest, self.rate, self.tail = trigger_ms * rate, silent_ms * rate, max_seconds * rate, rate, tail
        self.chunk = self.frame = self.start = 0
        self.samples = self.run = self.n_silent = 0
        self.begun = False

    def take(self, columns: dict[str, np.ndarray]) -> list[tuple]:
        out = []
        for frame, speech, n in zip(columns["frame_no"].tolist(), columns["is_speech"].tolist(), columns["n_samples"].tolist(), strict=True):
            if not self.begun:
                self.start, self.begun = frame, True
            self.frame = frame
            self.samples += n
            self.run, self.n_silent = (0, self.n_silent) if speech else (self.run + n, self.n_silent + 1)
            if (self.samples * 1000 >= self.trigger and self.run * 1000 >= self.silent) or self.samples >= self.longest:
                out.append(self._close())
        return out

    def _close(self) -> tuple:
        row = self.chunk, self.start, self.frame + 1, self.n_silent, self.samples
        self.chunk, self.samples, self.run, self.n_silent, self.begun = self.chunk + 1, 0, 0, 0, False
        return row

    def end(self) -> list[tuple]:
        return [self._close()] if self.begun and self.tail else []


CHUNK = "chunk_idx int, start_frame long, end_frame long, n_silent int, n_samples long"


def segment(frames: DataFrame, keys: list[str], cutting, tail: bool = True) -> DataFrame:
    """frames: keys, frame_no, is_speech, n_samples. Chunks with their silence ratio (0 for no frames)."""
    make = lambda: Segmenter(cutting.minimum_trigger_ms, cutting.minimum_silent_ms, cutting.max_seconds, cutting.sample_rate, tail)
    chunks = fold(frames, keys, ["frame_no"], ["is_speech", "n_samples"], make, CHUNK)
    n = F.col("end_frame") - F.col("start_frame")
    return chunks.withColumn("silence_ratio", F.when(n > 0, F.col("n_silent") / n).otherwise(0.0))


def in_parts(frames: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """Adds ``part``: equal ranges of each stream's frames, the last with the rest; each is cut by itself."""
    n = frames.groupBy(*keys).agg(F.count("*").alias("stream_frames"))
    size = F.greatest(F.floor(F.col("stream_frames") / parts), F.lit(1))
    return frames.join(n, keys).withColumn("part", F.least(F.lit(parts - 1), F.floor(F.col("frame_no") / size)).cast("int")).drop("stream_frames")


class MicroBatches(Fold):
    """Groups arrivals: at most ``most`` items, none later than ``delta`` after the group's first."""

    def __init__(self, most: int, delta: int):
        self.most, self.delta, self.group, self.n, self.first = most, delta, -1, 0, 0

    def take(self, columns: dict[str, np.ndarray]) -> list[tuple]:
        out = []
        for item, at in zip(columns["item"].tolist(), columns["at"].tolist(), strict=True):
            if self.n == 0 or self.n == self.most or at - self.first > self.delta:
                self.group, self.n, self.first = self.group + 1, 0, at
            self.n += 1
            out.append((item, self.group))
        return out


class Smoothing(Fold):
    """Exponential smoothing, the first value taken as it is: previous + factor * (value - previous)."""

    def __init__(self, factor: float):
        self.factor, self.at = factor, None

    def take(self, columns: dict[str, np.ndarray]) -> list[tuple]:
        out = []
        for item, v in zip(columns["item"].tolist(), columns["value"].tolist(), strict=True):
            self.at = v if self.at is None else self.at + self.factor * (v - self.at)
            out.append((item, self.at))
        return out


class Quota(Fold):
    """A counter that a request reads, and writes with its tokens added, unless the counter is over the limit.

    A missing counter reads as -1; it is missing before the first write and ``ttl`` after the last one.
    Rows: item, what was read, whether the request was refused.
    """

    def __init__(self, limit: int, ttl: int):
        self.limit, self.ttl, self.value, self.written = limit, ttl, -1, None

    def take(self, columns: dict[str, np.ndarray]) -> list[tuple]:
        out = []
        for item, at, tokens in zip(columns["item"].tolist(), columns["at"].tolist(), columns["tokens"].tolist(), strict=True):
            if self.written is None or at - self.written >= self.ttl:
                self.value = -1
            refused = self.value > self.limit
            out.append((item, self.value, refused))
            if not refused:
                self.value, self.written = self.value + tokens, at
        return out
