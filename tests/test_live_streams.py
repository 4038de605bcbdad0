"""Results joined to requests, counters that run out, and the live processor: restarts, late rows, dropped state."""

import numpy as np
import pytest
from oracle import data
from pyspark.sql import functions as F

from turnstream.operators import folds
from turnstream.operators.cluster import OnlineMeans
from turnstream.plans import bindings as b
from turnstream.plans import streams
from turnstream.streaming import live, quotas, replay, results

REQUEST, RESULT = "client long, item long, asked timestamp", "client long, item long, done timestamp, text string, error string"


def at(seconds: float) -> str:
    return f"2024-01-01 00:{int(seconds) // 60:02d}:{seconds % 60:09.6f}"


def frame(spark, rows: list[tuple], ddl: str, column: str):
    raw = spark.createDataFrame(rows, ddl.replace("timestamp", "string"))
    return raw.withColumn(column, F.col(column).cast("timestamp"))


def test_answers_in_order_of_completion(spark, tmp_path):
    """Over three runs from one checkpoint: overtaking, an error, an answer too late, one for nobody, and none."""
    runs = [
        ([(1, 1, at(0)), (1, 2, at(1)), (2, 1, at(2))], [(1, 2, at(3), "second", None), (9, 9, at(3), "nobody's", None)]),
        ([(1, 3, at(10)), (1, 4, at(11))], [(1, 1, at(9), "first", None), (1, 3, at(12), None, "failed"), (2, 1, at(200), "too late", None)]),
        ([(-1, -1, at(3000))], [(-1, -2, at(3000), None, None)]),
    ]
    seen = []
    with replay.state_store(spark):
        for k, (asked, done) in enumerate(runs):
            frame(spark, asked, REQUEST, "asked").write.mode("append").parquet(str(tmp_path / "asked"))
            frame(spark, done, RESULT, "done").write.mode("append").parquet(str(tmp_path / "done"))
            stream = lambda name, ddl: spark.readStream.schema(ddl).parquet(str(tmp_path / name))
            out = results.in_order(results.answered(stream("asked", REQUEST), stream("done", RESULT), 60_000))
            query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
            query.trigger(availableNow=True).start().awaitTermination(180)
            seen.append(spark.read.schema(results.MESSAGE).parquet(str(tmp_path / "out")).count())
    assert seen[0] <= seen[1] < seen[2]
    found = spark.read.schema(results.MESSAGE).parquet(str(tmp_path / "out")).filter("client > 0").orderBy("client", "place").collect()
    assert [(r.client, r.place, r.item, r.type, r.text, r.error) for r in found] == [
        (1, 1, 2, "transcription", "second", None),
        (1, 2, 1, "transcription", "first", None),
        (1, 3, 3, "error", None, "failed"),
        (1, 4, 4, "error", None, results.NO_ANSWER),
        (2, 1, 1, "error", None, results.NO_ANSWER),
    ]


def test_states_grow_by_shards_not_clients(spark, tmp_path):
    """Two runs over 1,000 clients, a client and items that are null, and equal times: places go on, and the state has few keys."""
    rows = [(c, i, 1_000_000 + (c * 37 + i * 11) % 60 * 1_000_000, f"{c}-{i}") for c in range(1000) for i in range(3)]
    rows += [(None, 2**60 + 1, 5_000_000, "nobody's"), (None, 1, 40_000_000, "nobody's"), (7, None, 3_000_000, "no item"), (7, None, 45_000_000, "no item"), (7, 2**60 + 1, 45_000_000, "big")]
    runs = [[r for r in rows if r[2] < 30_000_000], [r for r in rows if r[2] >= 30_000_000], [(-1, 1, 10**15, "end")]]
    ddl = "client long, item long, us long, text string"
    with replay.state_store(spark):
        for run in runs:
            spark.createDataFrame(run, ddl).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))
            messages = stream.select("client", "item", F.timestamp_micros("us").alias("at"), F.lit("transcription").alias("type"), "text", F.lit(None).cast("string").alias("error"))
            query = results.in_order(messages.withWatermark("at", "0 seconds")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
            query.trigger(availableNow=True).start().awaitTermination(180)
    wanted, places = set(), {}
    for c, i, us, text in sorted(rows, key=lambda r: (r[2], r[1] is None, r[1] or 0)):
        places[c] = places.get(c, 0) + 1
        wanted.add((c, places[c], i, us, text))
    found = spark.read.schema(results.MESSAGE).parquet(str(tmp_path / "out")).filter("client is null or client >= 0")
    found = [tuple(r) for r in found.select("client", "place", "item", F.unix_micros("at"), "text").collect()]
    assert len(found) == len(wanted)
    assert set(found) == wanted
    assert spark.read.format("statestore").load(str(tmp_path / "cp")).count() <= results.SHARDS + 1


def test_counters_leave_the_state(spark):
    """A timer drops the counter once the watermark has passed its end; what comes later reads a missing one."""
    second = 1_000_000
    rows = [(c, i, (1000 + t) * second, n) for c, i, t, n in ((1, 1, 0, 5), (1, 2, 1, 7), (2, 3, 2, 1), (1, 4, 100, 3), (2, 5, 105, 2), (3, 6, 400, 1), (3, 7, 401, 1))]
    df = spark.createDataFrame(rows, "client long, item long, us long, tokens long")
    folder = {}
    real = replay.new_folder
    replay.new_folder = lambda s, n: folder.setdefault("at", real(s, n))
    try:
        flow = lambda s: quotas.metered(s["rows"].withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", "0 seconds"), 10, 60 * second)
        out = replay.replay({"rows": (df, F.col("us"))}, flow, batches=3)
    finally:
        replay.new_folder = real
    assert sorted((r.item, r.used, r.refused) for r in out.collect()) == [(1, -1, False), (2, 4, False), (3, -1, False), (4, -1, False), (5, -1, False), (6, -1, False), (7, 0, False)]
    state = spark.read.format("statestore").option("stateVarName", "counter").load(folder["at"] + "/checkpoint")
    assert [r.key.client for r in state.select("key").collect()] == [3]


@pytest.mark.parametrize(("ttl_ms", "wanted"), [(3_600_000, [-1, 3]), (1, [-1, -1])])
def test_native_time_to_live(spark, tmp_path, ttl_ms, wanted):
    """In processing time the state itself ends: what is read soon enough is there, what is read later is not.
    Such a query goes on by its clock until it is stopped, so each run here is a single trigger."""
    with replay.state_store(spark):
        for k in range(2):
            spark.createDataFrame([(1, k, k, 4)], "client long, item long, us long, tokens long").write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema("client long, item long, us long, tokens long").parquet(str(tmp_path / "in"))
            out = quotas.metered(stream, 100, ttl_ms * 1000, event_time=False)
            out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start().awaitTermination(180)
    assert [r.used for r in spark.read.schema(quotas.USED).parquet(str(tmp_path / "out")).orderBy("item").collect()] == wanted


def test_live_session_equals_its_parts(spark):
    """Whole table, with restarts: tokens, chunks and speakers as smoothing, cutting and clustering give them one by one."""
    d = data("sf0.001")
    frames = streams.live_frames(spark, d)
    found = streams.q105_live_session(spark, d).toPandas()
    by_stream = frames.filter("not is_end").toPandas().sort_values(["stream_id", "frame_no"])
    wanted = set()
    for stream, g in by_stream.groupby("stream_id"):
        smooth = folds.Smoothing(streams.LIVE["factor"]).take({"item": g.frame_no.to_numpy(), "value": g.volume.to_numpy()})
        for (n, volume), score in zip(smooth, g.score, strict=True):
            if score < streams.LIVE["least_score"] and volume < streams.LIVE["least_volume"]:
                wanted.add((stream, "active", n, -1, -1, -1, -1))
        c = b.CUTTING
        cut = folds.Segmenter(c.minimum_trigger_ms, c.minimum_silent_ms, c.max_seconds, c.sample_rate)
        chunks = cut.take({k: g[k].to_numpy() for k in ("frame_no", "is_speech", "n_samples")}) + cut.end()
        means, vectors = OnlineMeans(streams.LIVE["similarity"], streams.LIVE["speakers"]), np.stack(g.v.to_numpy())
        for chunk, start, end, n_silent, _ in chunks:
            spoken = n_silent / max(1, end - start) <= b.REJECT
            speaker = means.label(np.add.reduce(vectors[start:end]) / (end - start)) if spoken else -1
            wanted.add((stream, "transcription" if spoken else "silent", -1, chunk, start, end, speaker))
    got = {tuple(-1 if x != x or x is None else x if isinstance(x, str) else int(x) for x in r) for r in found.itertuples(index=False)}
    assert got == wanted
    assert len(found) == len(wanted)
    assert {r[6] for r in got} > {-1, 0}


def test_live_parameters(spark):
    """Silent tokens can be left out; a session's end drops all its state, so a client that comes back starts anew."""
    ddl = "stream_id long, frame_no long, is_speech boolean, score double, volume double, n_samples long, v array<double>, is_end boolean"
    speech = lambda k, s: (1, k, s, 1.0 if s else 0.1, 1.0, 3200, [1.0, 0.0], False)
    rows = [speech(k, k < 12) for k in range(40)] + [(1, 40, False, 0.0, 0.0, 0, [], True)]
    out = replay.replay({"frames": (spark.createDataFrame(rows, ddl), F.col("frame_no"))}, lambda s: live.live_messages(s["frames"], b.CUTTING, b.REJECT, silent_tokens=False), batches=2)
    kinds = {r.type for r in out.collect()}
    assert kinds == {"transcription"}


@pytest.mark.parametrize("batches", [1, 3])
def test_replay_reads_each_row_once(spark, batches):
    df = spark.range(50).withColumn("us", F.col("id") * 1000)
    out = replay.replay({"rows": (df, F.col("us"))}, lambda s: s["rows"].select("id"), batches=batches)
    assert sorted(r.id for r in out.collect()) == list(range(50))
