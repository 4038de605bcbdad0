"""Requests and their results as two streams, joined, and sent on in the order in which they are done."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

NO_ANSWER = "no answer in time"


def answered(requests: DataFrame, results: DataFrame, within_ms: int, delay: str = "0 seconds") -> DataFrame:
    """client, item, at, type, text, error: each request with its result, or the error that none came in time.

    requests: client, item, asked (timestamp); results: client, item, done (timestamp), text, error. Both streams have a
    watermark, so state of requests that are answered or too old goes. A result counts from the moment of the request to
    ``within_ms`` later; a request without one gives an error at that moment, once the watermarks have passed it. A result
    that has an error is an error message and stops no other. Results of no request, and late ones, give nothing.
    """
    asked = requests.select("client", "item", "asked").withWatermark("asked", delay)
    done = results.select(F.col("client").alias("of_client"), F.col("item").alias("of_item"), "done", "text", "error").withWatermark("done", delay)
    wait = F.expr(f"interval {within_ms} milliseconds")
    meet = (F.col("client") == F.col("of_client")) & (F.col("item") == F.col("of_item")) & (F.col("done") >= F.col("asked")) & (F.col("done") <= F.col("asked") + wait)
    joined = asked.join(done, meet, "leftOuter")
    error = F.when(F.col("of_item").isNull(), NO_ANSWER).otherwise(F.col("error"))
    return joined.select("client", "item", "asked", F.coalesce("done", F.col("asked") + wait).alias("at"), F.when(error.isNull(), "transcription").otherwise("error").alias("type"), F.when(error.isNull(), F.col("text")).alias("text"), error.alias("error"))


MESSAGE = "client long, place long, item long, at timestamp, type string, text string, error string"
SHARDS = 256
_NO_CLIENT = -1
_ROW = pa.schema([("client", pa.int64()), ("us", pa.int64()), ("no_item", pa.bool_()), ("item", pa.int64()), ("type", pa.string()), ("text", pa.string()), ("error", pa.string())])
_STATE = "clients binary, sent binary, waiting binary"
_PLACED = "shard int, client long, us long, no_item boolean, item long, type string, text string, error string, place long"


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _ROW) as to:
        to.write_table(rows)
    return sink.getvalue().to_pybytes()


def _send(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The messages of a shard's clients by time: each waits until the watermark has passed it, as none that is earlier can come then.

    State: the clients with the number of messages sent to each, and those that wait; one timeout at the earliest that waits.
    """
    packed = state.getOption or (b"", b"", None)
    clients, sent = (np.frombuffer(x, "<i8") for x in packed[:2])
    watermark = state.getCurrentWatermarkMs()
    came = [pa.Table.from_pandas(pdf[_ROW.names], schema=_ROW, preserve_index=False, nthreads=1) for pdf in frames if len(pdf)]
    rows = pa.concat_tables([pa.ipc.open_stream(packed[2]).read_all() if packed[2] else _ROW.empty_table(), *came])
    passed = rows["us"].to_numpy() < watermark * 1000
    left, ready = rows.filter(pa.array(~passed)), rows.filter(pa.array(passed)).sort_by([(c, "ascending") for c in _ROW.names])
    now, begin, n = np.unique(ready["client"].to_numpy(), return_index=True, return_counts=True)
    every = np.union1d(clients, now)
    before = np.zeros(len(every), "<i8")
    before[np.searchsorted(every, clients)] = sent
    at = np.searchsorted(every, now)
    place = np.arange(1, len(ready) + 1) + np.repeat(before[at] - begin, n)
    before[at] += n
    state.update((every.astype("<i8").tobytes(), before.tobytes(), _packed(left) if len(left) else None))
    if len(left):
        state.setTimeoutTimestamp(max(int(left["us"].to_numpy().min()) // 1000, watermark + 1))
    pdf = ready.to_pandas(use_threads=False)
    pdf.insert(0, "shard", key[0])
    pdf["place"] = place
    yield pdf


def in_order(messages: DataFrame) -> DataFrame:
    """client, place, item, at, type, text, error: messages (of ``answered``) numbered by client in order of ``at``, then item.

    Clients are dealt to ``SHARDS`` groups with one state each, so that a batch costs by its rows and not by its clients.
    Nulls come last among items, and are a client of their own.
    """
    shard = F.when(F.col("client").isNull(), _NO_CLIENT).otherwise(F.pmod(F.xxhash64("client"), F.lit(SHARDS)).cast("int"))
    rows = messages.withColumns({"shard": shard, "us": F.unix_micros("at"), "no_item": F.col("item").isNull(), "client": F.coalesce("client", F.lit(0)), "item": F.coalesce("item", F.lit(0))})
    placed = rows.groupBy("shard").applyInPandasWithState(_send, _PLACED, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    client, item = F.when(F.col("shard") != _NO_CLIENT, F.col("client")), F.when(~F.col("no_item"), F.col("item"))
    return placed.select(client.alias("client"), "place", item.alias("item"), F.timestamp_micros("us").alias("at"), "type", "text", "error")
