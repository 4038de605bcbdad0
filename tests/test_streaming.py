"""The live session processor gives what the batch gives."""

from pyspark.sql import functions as F

from oracle import data
from turnstream.operators import folds
from turnstream.plans import bindings as b
from turnstream.streaming.sessions import session_messages


def test_stream_equals_batch(spark, tmp_path):
    frames = b.frames(spark, data("sf0.001")).select("stream_id", "frame_no", "is_speech", F.col("n_samples").cast("int").alias("n_samples"), F.lit(False).alias("is_end"))
    ends = frames.groupBy("stream_id").agg(F.max("frame_no").alias("frame_no")).select("stream_id", "frame_no", F.lit(False).alias("is_speech"), F.lit(0).alias("n_samples"), F.lit(True).alias("is_end"))
    cut = F.floor(F.col("frame_no") / 25)
    for k in range(5):
        part = frames.filter(cut == k).unionByName(ends.filter(F.lit(k == 4)))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = session_messages(stream, b.CUTTING, b.REJECT).writeStream.format("memory").queryName("messages").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    live = {tuple(r) for r in spark.table("messages").select("stream_id", "chunk_idx", "start_frame", "end_frame", "type").collect()}
    kind = F.when(F.col("silence_ratio") > b.REJECT, "silent").otherwise("transcription")
    batch = folds.segment(b.frames(spark, data("sf0.001")), ["stream_id"], b.CUTTING)
    assert live == {tuple(r) for r in batch.select("stream_id", "chunk_idx", "start_frame", "end_frame", kind).collect()}


def test_raw_messages(spark, tmp_path):
    """Payloads that do not end at frames, errors, an end, a disconnect, repeated and malformed messages."""
    import numpy as np

    from turnstream.config import Cutting
    from turnstream.streaming.sessions import audio_messages

    cutting, frame = Cutting(minimum_trigger_ms=100, minimum_silent_ms=50, max_seconds=1, sample_rate=1000), 50
    loud = lambda n: np.ones(n, "<f4").tobytes()
    quiet = lambda n: np.zeros(n, "<f4").tobytes()
    first = [(1, 0, loud(130), None), (1, 1, b"abc", None), (1, 2, None, "{bad"), (2, 0, loud(200), None), (3, 0, quiet(100), None)]
    second = [(1, 1, loud(500), None), (1, 3, loud(20) + quiet(60), None), (1, 4, loud(90), None), (1, 5, None, '{"type": "end"}'), (2, 1, None, '{"type": "disconnect"}'), (3, 1, quiet(50), None), (3, 2, None, '{"type": "end"}')]
    schema = "client_id long, seq long, payload binary, text string"
    for k, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = audio_messages(stream, cutting, 0.9, lambda frames: frames.mean(axis=1) > 0.5, frame)
    out.writeStream.format("memory").queryName("raw").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(180)
    found = sorted((r.client_id, r.type, r.chunk_idx, r.start_sample, r.end_sample) for r in spark.table("raw").collect() if r.type != "error")
    # client 1: 130+20+60+90 = 300 samples in 6 frames, the fourth of them silent; 0 samples are left
    assert found == [(1, "transcription", 0, 0, 200), (1, "transcription", 1, 200, 300), (3, "silent", 0, 0, 100), (3, "silent", 1, 100, 150)]
    errors = [(r.client_id, r.error) for r in spark.table("raw").collect() if r.type == "error"]
    assert errors == [(1, "input must be float32 audio bytes")]


def test_failing_items_stop_no_others(spark):
    from turnstream.streaming.sessions import isolated

    rows = spark.createDataFrame([(k, k - 2) for k in range(5)], "item int, x int")
    found = {r.item: (r.result, r.error) for r in isolated(rows, "x", lambda x: str(12 // x)).collect()}
    assert found[2] == (None, "ZeroDivisionError: integer division or modulo by zero")
    assert [found[k][0] for k in (0, 1, 3, 4)] == ["-6", "-12", "12", "6"]
