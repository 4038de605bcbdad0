"""A live session in one processor: smoothed volume, cutting and online speakers, each a state variable of its own."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from turnstream.config import Cutting
from turnstream.operators.cluster import OnlineMeans
from turnstream.operators.folds import Segmenter, Smoothing
from turnstream.streaming.sessions import STATE

LIVE = "stream_id long, type string, frame_no long, chunk_idx int, start_frame long, end_frame long, speaker long"


class LiveProcessor(StatefulProcessor):
    """One client's frames: active tokens, and a message for each chunk, silent or transcribed with its speaker.

    volume: the exponential smoothing; a frame whose score and smoothed volume are both under their limits is an active token.
    cutting: the chunk in progress, with the sum of its frames' vectors.
    speakers: centers and sizes of the online clustering that the mean vector of each chunk that is not silent goes through.
    Silent chunks have no speaker and move no center; without ``silent_tokens`` they give no message. Frames that come again
    or late are ignored; an end row gives the chunk in progress and drops all state.
    """

    def __init__(self, cutting: Cutting, reject: float, least_score: float, least_volume: float, factor: float, similarity: float, speakers: int, silent_tokens: bool = True):
        self.cutting, self.reject, self.limits, self.factor = cutting, reject, (least_score, least_volume), factor
        self.similarity, self.most, self.silent_tokens = similarity, speakers, silent_tokens

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.volume = handle.getValueState("volume", "at double")
        self.chunk = handle.getValueState("cutting", f"{STATE}, total array<double>, counted long")
        self.speakers = handle.getListState("speakers", "center array<double>, size long")

    def _segmenter(self) -> tuple[Segmenter, int, np.ndarray, int]:
        c = self.cutting
        s, last, total, counted = Segmenter(c.minimum_trigger_ms, c.minimum_silent_ms, c.max_seconds, c.sample_rate), -1, np.zeros(0), 0
        if self.chunk.exists():
            s.chunk, s.frame, s.start, s.samples, s.run, s.n_silent, s.begun, last, total, counted = self.chunk.get()
        return s, last, np.array(total, dtype=np.float64), counted

    def _means(self) -> OnlineMeans:
        means = OnlineMeans(self.similarity, self.most)
        for center, size in self.speakers.get() if self.speakers.exists() else []:
            means.centers.append(np.array(center, dtype=np.float64))
            means.sizes.append(size)
        return means

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        smooth, means = Smoothing(self.factor), self._means()
        smooth.at = self.volume.get()[0] if self.volume.exists() else None
        s, last, total, counted = self._segmenter()
        out, ended = [], False

        def closed(found: list[tuple]) -> None:
            nonlocal total, counted
            for chunk, start, end, n_silent, _ in found:
                if n_silent / max(1, end - start) <= self.reject:
                    out.append(("transcription", None, chunk, start, end, means.label(total / max(1, counted))))
                elif self.silent_tokens:
                    out.append(("silent", None, chunk, start, end, None))
                total, counted = np.zeros(0), 0

        pdf = pd.concat(list(rows)).sort_values("frame_no")  # one client's frames of one trigger
        for r in pdf.itertuples():
            if r.is_end:
                ended = True
            elif not ended and r.frame_no > last:
                last = r.frame_no
                ((_, volume),) = smooth.take({"item": np.array([r.frame_no]), "value": np.array([r.volume], dtype=np.float64)})
                if r.score < self.limits[0] and volume < self.limits[1]:
                    out.append(("active", r.frame_no, None, None, None, None))
                v = np.asarray(r.v, dtype=np.float64)
                total, counted = (v if not counted else total + v), counted + 1
                closed(s.take({"frame_no": np.array([r.frame_no]), "is_speech": np.array([r.is_speech]), "n_samples": np.array([r.n_samples])}))
        if ended:
            closed(s.end())
            for state in (self.volume, self.chunk, self.speakers):
                state.clear()
        else:
            if smooth.at is not None:
                self.volume.update((float(smooth.at),))
            self.chunk.update((s.chunk, int(s.frame), int(s.start), int(s.samples), int(s.run), s.n_silent, s.begun, int(last), total.tolist(), counted))
            if means.centers:
                self.speakers.put([(c.tolist(), int(n)) for c, n in zip(means.centers, means.sizes, strict=True)])
        yield pd.DataFrame([(key[0], *m) for m in out], columns=[x.split()[0] for x in LIVE.split(", ")]).astype({c: "Int64" for c in ("frame_no", "chunk_idx", "start_frame", "end_frame", "speaker")})

    def close(self) -> None:
        pass


def live_messages(frames: DataFrame, cutting: Cutting, reject: float, least_score: float = 0.7, least_volume: float = 0.6, factor: float = 0.2, similarity: float = 0.5, speakers: int = 5, silent_tokens: bool = True) -> DataFrame:
    """frames (streaming): stream_id, frame_no, is_speech, score, volume, n_samples, v (array), is_end."""
    processor = LiveProcessor(cutting, reject, least_score, least_volume, factor, similarity, speakers, silent_tokens)
    return frames.groupBy("stream_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=LIVE, outputMode="Append", timeMode="None")
