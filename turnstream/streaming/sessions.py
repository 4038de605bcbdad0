"""Live sessions: silence cutting with keyed state over a stream of scored frames."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from turnstream.config import FRAME_SAMPLES, Cutting
from turnstream.operators.folds import Segmenter

STATE = "chunk int, frame long, start long, samples long, run long, n_silent int, begun boolean, last long"
MESSAGE = "stream_id long, type string, chunk_idx int, start_frame long, end_frame long, n_silent int, n_samples long"


class SessionProcessor(StatefulProcessor):
    """One client's cutting: a message for each chunk, silent or to be transcribed; an end row flushes and
    drops the state. Frames that come again or late (frame_no not above the last) are ignored."""

    def __init__(self, cutting: Cutting, reject_ratio: float):
        self.cutting, self.reject = cutting, reject_ratio

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        c = self.cutting
        s = Segmenter(c.minimum_trigger_ms, c.minimum_silent_ms, c.max_seconds, c.sample_rate)
        last = -1
        if self.state.exists():
            s.chunk, s.frame, s.start, s.samples, s.run, s.n_silent, s.begun, last = self.state.get()
        pdf = pd.concat(list(rows)).sort_values("frame_no")
        frames = pdf[~pdf["is_end"] & (pdf["frame_no"] > last)].drop_duplicates("frame_no")
        found = s.take({k: frames[k].to_numpy() for k in ("frame_no", "is_speech", "n_samples")})
        if pdf["is_end"].any():
            found += s.end()
            self.state.clear()
        else:
            last = int(frames["frame_no"].max()) if len(frames) else last
            self.state.update((s.chunk, s.frame, s.start, s.samples, s.run, s.n_silent, s.begun, last))
        out = [(key[0], "silent" if r[3] / max(1, r[2] - r[1]) > self.reject else "transcription", *r) for r in found]
        yield pd.DataFrame(out, columns=[x.split()[0] for x in MESSAGE.split(", ")])

    def close(self) -> None:
        pass


def session_messages(frames: DataFrame, cutting: Cutting, reject_ratio: float) -> DataFrame:
    """frames (streaming): stream_id, frame_no, is_speech, n_samples, is_end. State: RocksDB, one row a client."""
    return frames.groupBy("stream_id").transformWithStateInPandas(
        statefulProcessor=SessionProcessor(cutting, reject_ratio), outputStructType=MESSAGE, outputMode="Append", timeMode="None"
    )


# --- raw messages

RAW_STATE = STATE + ", carry binary, seq long"
RAW_MESSAGE = "client_id long, type string, chunk_idx int, start_sample long, end_sample long, n_silent int, error string"
NOT_FLOATS = "input must be float32 audio bytes"


class AudioSessionProcessor(StatefulProcessor):
    """One client's raw messages: float32 payloads of any length, and texts, in order of ``seq``.

    Payloads are joined and cut into frames of ``frame`` samples; what is left waits for the next message.
    Frames are scored a message at a time and go through the cutting. A payload that is no float32 gives an
    error message and changes nothing. The text {"type": "end"} flushes the chunk in progress, but not the
    partial frame, and drops the state; {"type": "disconnect"} drops it without a message; any other text,
    malformed JSON too, is ignored. Messages that come again or late are ignored.
    """

    def __init__(self, cutting: Cutting, reject_ratio: float, score: Callable[[np.ndarray], np.ndarray], frame: int = FRAME_SAMPLES):
        self.cutting, self.reject, self.score, self.frame = cutting, reject_ratio, score, frame

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("audio", RAW_STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        c = self.cutting
        s, carry, seq, n_frames = Segmenter(c.minimum_trigger_ms, c.minimum_silent_ms, c.max_seconds, c.sample_rate), b"", -1, 0
        if self.state.exists():
            s.chunk, s.frame, s.start, s.samples, s.run, s.n_silent, s.begun, n_frames, carry, seq = self.state.get()
        out, gone = [], False

        def cut(found: list[tuple]) -> None:
            for chunk, start, end, n_silent, _ in found:
                kind = "silent" if n_silent / max(1, end - start) > self.reject else "transcription"
                out.append((key[0], kind, chunk, start * self.frame, end * self.frame, n_silent, None))

        for m in pd.concat(list(rows)).sort_values("seq").itertuples():
            if gone or m.seq <= seq:
                continue
            seq = m.seq
            if m.payload is None:
                kind = _message_type(m.text)
                if kind == "end":
                    cut(s.end())
                gone = kind in ("end", "disconnect")
            elif len(m.payload) % 4:
                out.append((key[0], "error", None, None, None, None, NOT_FLOATS))
            else:
                carry = bytes(carry) + bytes(m.payload)
                whole = len(carry) // (4 * self.frame)
                frames = np.frombuffer(carry[: whole * 4 * self.frame], "<f4").reshape(whole, self.frame)
                carry = carry[whole * 4 * self.frame :]
                if whole:
                    speech = np.asarray(self.score(frames), dtype=bool)
                    cut(s.take({"frame_no": np.arange(n_frames, n_frames + whole), "is_speech": speech, "n_samples": np.full(whole, self.frame)}))
                    n_frames += whole
        if gone:
            self.state.clear()
        else:
            self.state.update((s.chunk, s.frame, s.start, s.samples, s.run, s.n_silent, s.begun, n_frames, bytes(carry), seq))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in RAW_MESSAGE.split(", ")])

    def close(self) -> None:
        pass


def _message_type(text: str | None) -> str | None:
    try:
        found = json.loads(text or "")
    except ValueError:
        return None
    return found.get("type") if isinstance(found, dict) else None


def audio_messages(messages: DataFrame, cutting: Cutting, reject_ratio: float, score: Callable[[np.ndarray], np.ndarray], frame: int = FRAME_SAMPLES) -> DataFrame:
    """messages (streaming): client_id, seq, payload (binary or null), text. ``score``: frames to a flag each."""
    return messages.groupBy("client_id").transformWithStateInPandas(
        statefulProcessor=AudioSessionProcessor(cutting, reject_ratio, score, frame), outputStructType=RAW_MESSAGE, outputMode="Append", timeMode="None"
    )


def isolated(rows: DataFrame, value: str, work: Callable[[Any], str]) -> DataFrame:
    """Rows with ``result`` and ``error`` of work(value): an item that fails has an error and stops no other."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for x in pdf[value]:
                try:
                    found.append((work(x), None))
                except Exception as e:  # noqa: BLE001  whatever an item raises is that item's answer
                    found.append((None, f"{type(e).__name__}: {e}"))
            yield pdf.assign(result=[r for r, _ in found], error=[e for _, e in found])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(scan, f"{ddl}, result string, error string")
