"""Counters that run out: a stream of requests with keyed state, timers and native expiry."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

USED = "client long, item long, used long, refused boolean"
MISSING = -1


class QuotaProcessor(StatefulProcessor):
    """A client's counter. A request reads it, and writes it with its tokens added unless it is over the limit.

    A missing counter reads as -1: before the first write, and ``ttl_us`` after the last one. In event time a timer drops the
    state of a counter that has run out, once the watermark is there, and a read before that sees it by its own time. In
    processing time the state has a native time to live, that each write starts anew.
    """

    def __init__(self, limit: int, ttl_us: int, event_time: bool):
        self.limit, self.ttl, self.event_time = limit, ttl_us, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = None if self.event_time else max(1, self.ttl // 1000)
        self.counter = handle.getValueState("counter", "value long, written long", ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        value, written = self.counter.get() if self.counter.exists() else (MISSING, None)
        began, out = written, []
        chunks = [pdf[["us", "item", "tokens"]] for pdf in rows]  # what one client sends in one trigger
        for us, item, tokens in pd.concat(chunks).sort_values(["us", "item"]).itertuples(index=False):
            if self.event_time and (written is None or us - written >= self.ttl):
                value = MISSING
            refused = value > self.limit
            out.append((key[0], item, value, refused))
            if not refused:
                value, written = value + tokens, us
        if written != began:
            self.counter.update((int(value), int(written)))
            if self.event_time:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(max(int(written + self.ttl) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in USED.split(", ")])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.counter.exists() and self.counter.get()[1] + self.ttl <= timerValues.getCurrentWatermarkInMs() * 1000:
            self.counter.clear()
        yield pd.DataFrame([], columns=[c.split()[0] for c in USED.split(", ")])

    def close(self) -> None:
        pass


def metered(requests: DataFrame, limit: int, ttl_us: int, event_time: bool = True) -> DataFrame:
    """client, item, used, refused. requests (streaming): client, item, us (microseconds), tokens; with event time also a watermark.

    ``used`` is what the request read. Of one trigger a client's requests are taken in order of time, then item. In processing
    time the query runs by its clock until it is stopped: it is for live use, event time for replays that end.
    """
    return requests.groupBy("client").transformWithStateInPandas(
        statefulProcessor=QuotaProcessor(limit, ttl_us, event_time), outputStructType=USED, outputMode="Append", timeMode="EventTime" if event_time else "ProcessingTime"
    )
