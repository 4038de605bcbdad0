"""Operators on small inputs with known results."""

import io
import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from turnstream import config
from turnstream.functions import markers, normalize, scalars
from turnstream.operators import align, cluster, features, folds, intervals, report
from turnstream.sources import audio


def chunks_of(spark, pattern: str, **options):
    """Chunks of frames written as S (speech) and _ (silence), 8 frames to trigger, 2 of silence, 20 at most."""
    rows = [(1, i, c == "S", 3200) for i, c in enumerate(pattern)]
    frames = spark.createDataFrame(rows, "stream_id long, frame_no long, is_speech boolean, n_samples int")
    out = folds.segment(frames, ["stream_id"], config.Cutting(1500, 400, 4), **options)
    return [(r.start_frame, r.end_frame, r.n_silent) for r in out.orderBy("chunk_idx").collect()]


@pytest.mark.parametrize(
    ("pattern", "chunks"),
    [
        ("SSSSSS__", [(0, 8, 2)]),
        ("SSSSS__SSS", [(0, 10, 2)]),
        ("S" * 25, [(0, 20, 0), (20, 25, 0)]),
        ("_" * 8, [(0, 8, 8)]),
        ("SSSSSSSSS_", [(0, 10, 1)]),
        ("", []),
    ],
)
def test_segments(spark, pattern, chunks):
    assert chunks_of(spark, pattern) == chunks


def test_segments_without_tail(spark):
    assert chunks_of(spark, "S" * 25, tail=False) == [(0, 20, 0)]


def test_default_cut_is_at_782_frames():
    s = folds.Segmenter(1500, 200, 25, 16000)
    n = 800
    out = s.take({"frame_no": np.arange(n), "is_speech": np.ones(n, bool), "n_samples": np.full(n, 512)})
    assert out[0][:3] == (0, 0, 782)


def test_state_crosses_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert chunks_of(spark, "S" * 25) == [(0, 20, 0), (20, 25, 0)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_overlap_speaker(spark):
    seg = spark.createDataFrame([(1, 0, 0, 200), (1, 1, 200, 500), (1, 2, 900, 950)], "rec long, id int, s long, e long")
    turns = spark.createDataFrame([(1, 0, 0, 100, "SPEAKER_01"), (1, 1, 100, 200, "SPEAKER_02"), (1, 2, 300, 800, "SPEAKER_03"), (2, 0, 0, 999, "abc")], "rec long, pos int, s long, e long, speaker string")
    for width in (7, 6000):
        out = intervals.best_overlap(seg, turns, "rec", "id", width).select("id", intervals.speaker_number(F.col("speaker")).alias("k"))
        assert sorted(map(tuple, out.collect())) == [(0, 1), (1, 3), (2, 0)]


def test_nearest_fill(spark):
    rows = spark.createDataFrame([(1, i, {1: 7, 5: 9}.get(i)) for i in range(7)] + [(2, 0, None)], "rec int, i int, v int")
    out = intervals.fill_nearest(rows, "rec", "i", "v").orderBy("rec", "i").collect()
    assert [r.v for r in out] == [7, 7, 7, 7, 9, 9, 9, 0]


def test_online_means():
    m = cluster.OnlineMeans(0.5, 2)
    assert [m.label(np.array(x, float)) for x in ([1, 0], [0, 1], [2, 0], [-1, 0])] == [0, 1, 0, 0]
    assert m.centers[0].tolist() == [4, 0]
    assert m.sizes == [1, 1]


def test_markers(spark):
    cases = {
        "<|0.0|>Hello world<|2.5|><|3.0|>How are you<|5.5|>": [("Hello world", None), ("How are you", None)],
        "<|speaker:0|><|0.0|>Hello<|2.0|><|speaker:1|><|3.0|>World<|5.0|>": [("Hello", 0), ("World", 1)],
        "": [],
        "Just plain text without timestamps": [],
        "<|0.0|>Valid segment<|2.0|>Some text without timestamps<|4.0|>Another segment<|6.0|>": [("Valid segment", None), ("Another segment", None)],
        "<|0|>x<|1|>": [],
        "<|0.0|>a\nb<|1.0|>": [],
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "rec int, text string")
    found = markers.parse(df, "text", ["rec"]).orderBy("rec", "id").collect()
    for i, wanted in enumerate(cases.values()):
        assert [(r.text, r.speaker) for r in found if r.rec == i] == wanted


def test_shift_moves_each_marker_once(spark):
    df = spark.createDataFrame([("<|1.00|>a<|2.00|><|2.00|>b<|3.00|>",)], "t string")
    assert df.select(markers.shifted(F.col("t"), F.lit(100))).first()[0] == "<|2.00|>a<|3.00|><|3.00|>b<|4.00|>"


def test_normalize(spark):
    cases = {"Hello, World!": "hello world", "(Sam 24:18) go": "go", "12 ab 46 x8 9": "ab x8", "don’t": "don't", "a35b": "a b", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(normalize.text_normalize(F.col("t"))).collect()] == list(cases.values())


def test_star_tokens(spark):
    out = spark.range(1).select(normalize.starred(normalize.uroman_tokens(F.array(F.lit("Yes"), F.lit("sir,"))))).first()[0]
    assert out == ["<star>", "y e s", "<star>", "s i r"]
    with pytest.raises(ValueError):
        normalize.starred(F.array(), "none")


def test_runs_and_words(spark):
    rows = [(1, j, t, p) for t, (j, p) in enumerate([(0, 0.5), (0, 0.7), (1, 0.9), (1, 0.9), (1, 0.9), (2, 0.4)])]
    path = spark.createDataFrame(rows, "utt long, token_index int, time_index int, probability double")
    runs = align.merge_repeats(path, "utt")
    assert [(r.start, r.end, round(r.score, 6)) for r in runs.orderBy("token_index").collect()] == [(0, 2, 0.6), (2, 5, 0.9), (5, 6, 0.4)]
    labels = F.when(F.col("token_index") == 1, "a").otherwise("<star>")
    words = align.merge_words(runs.withColumn("label", labels), "utt", "label").collect()
    assert [(r.text, r.start, r.end, round(r.score, 6)) for r in words] == [("a", 2, 5, 0.9)]


def test_path_that_does_not_fit():
    e = np.zeros((2, 4))
    tokens = np.array([1, 2, 3])
    assert align.best_path(align.trellis(e, tokens), e, tokens) == []


def test_order_statistics(spark):
    df = spark.createDataFrame([("a", i) for i in range(1, 101)] + [("b", 5)] * 3, "k string, v long")
    r = {x.k: x for x in report.order_statistics(df, ["k"], "v").collect()}
    assert (r["a"].p50, r["a"].p90, r["a"].p95, r["a"].p99, r["a"].total) == (50, 90, 95, 99, 5050)
    assert (r["b"].p90, r["b"].n) == (5, 3)


def test_log_softmax_and_convolutions(spark):
    r = spark.range(1).select(align.log_softmax_star(F.array(F.lit(1.0), F.lit(1.0))).alias("e"), align.convolved(F.lit(16000)).alias("n")).first()
    assert np.allclose(r.e, [-np.log(2), -np.log(2), 0])
    assert r.n == 49


@pytest.mark.parametrize(("n_fft", "hop"), [(32, 16), (64, 16), (32, 32)])
def test_mel_of_pieces_is_that_of_whole_streams(spark, n_fft, hop):
    r = np.random.default_rng(4)
    streams = [(k, r.normal(size=n).tolist()) for k, n in enumerate([1, 31, 99, 500, 511, 512, 513, 1024, 1300, 1535])]
    whole = features.log_mel(spark.createDataFrame(streams, "id int, samples array<double>"), ["id"], "samples", 16_000, n_fft, hop, 8)
    rows = spark.createDataFrame([(k, i, v) for k, x in streams for i, v in enumerate(x)], "id int, i long, v double")
    cut = features.log_mel_of_streams(rows, "id", "i", "v", 16_000, n_fft, hop, 8, piece=512)
    got, wanted = ({(x.id, x.frame): x.mel for x in df.collect()} for df in (cut, whole))
    assert got.keys() == wanted.keys() and cut.count() == len(wanted)
    assert all(np.allclose(got[k], wanted[k]) for k in wanted)


def test_statistics_and_mel(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0)], "k int, x double")
    r = {x.k: x for x in features.statistics_pool(df, ["k"], "x").collect()}
    assert r[1].mean == 2.0
    assert np.isclose(r[1].deviation, np.sqrt(2))
    assert np.isclose(r[2].deviation, 1e-5)
    t = np.sin(2 * np.pi * 1000 * np.arange(1600) / 16000)
    mel = features.log_mel(spark.createDataFrame([(1, t.tolist())], "id int, samples array<double>"), ["id"], "samples", 16000).toPandas()
    assert len(mel) == 1600 // 160 + 1
    assert np.argmax(mel.mel.iloc[5]) == np.argmax(features.mel_filters(80, 512, 16000)[:, 32])


def test_wav_round_trip(spark):
    x = np.sin(np.arange(4000) / 20).astype(np.float32)
    df = spark.createDataFrame([("a", x.tolist()), ("b", None)], "path string, samples array<float>")
    coded = df.filter("samples is not null").select("path", audio.encode_wav("samples").alias("content"))
    bad = spark.createDataFrame([("bad", bytearray(b"no wav"))], "path string, content binary")
    out = {r.path: r for r in audio.decode_wav(coded.unionByName(bad)).collect()}
    assert np.abs(np.array(out["a"].samples) - x / np.abs(x).max()).max() < 1e-3
    assert out["bad"].samples is None
    assert out["bad"].error
    with wave.open(io.BytesIO(bytes(coded.first().content))) as w:
        assert (w.getframerate(), w.getnchannels(), w.getsampwidth()) == (16000, 1, 2)


def test_payloads_and_frames(spark):
    df = spark.createDataFrame([(1, bytearray(np.array([0.5, -1], "<f4").tobytes())), (2, bytearray(b"abc"))], "id int, p binary")
    out = [r[0] for r in df.orderBy("id").select(audio.float32_samples("p")).collect()]
    assert out == [[0.5, -1.0], None]
    rec = spark.createDataFrame([(1, [0.0] * 1100), (2, [])], "id int, samples array<float>")
    frames = audio.frames_of(rec, "id", "samples").orderBy("frame_no").collect()
    assert [(r.frame_no, len(r.samples), r.whole) for r in frames] == [(0, 512, True), (1, 512, True), (2, 76, False)]


def test_event_lines(spark):
    df = spark.createDataFrame([('data: {"a": 1}',), ("data: [DONE]",), (": ping",)], "line string")
    assert [r.event.a for r in audio.event_lines(df, "line", "a int").collect()] == [1]


def test_validation():
    assert config.validate_request(None, " JSON ", "Online") == ("null", "json", "online")
    for bad in (("invalid_lang", "json", "none"), ("en", "invalid_format", "none"), ("en", "json", "invalid")):
        with pytest.raises(ValueError):
            config.validate_request(*bad)


def test_checked_fails_on_a_bad_row(spark):
    df = pd.DataFrame({"x": [1, 2]})
    good = config.checked(spark.createDataFrame(df), F.col("x") > 0, "x must be positive")
    assert good.count() == 2
    with pytest.raises(Exception, match="x must be below 2"):
        config.checked(spark.createDataFrame(df), F.col("x") < 2, "x must be below 2").collect()


def test_relabelled_and_unbounded_means():
    m = cluster.OnlineMeans(0.5, 2, "euclidean", relabel=True)
    assert [m.label(np.array(x, float)) for x in ([0, 0], [5, 0], [9, 0])] == [0, 1, 0]
    assert len(m.centers) == 1  # the farthest center stood for one value and went
    u = cluster.UnboundedMeans(0.5)
    assert [u.label(np.array(x, float)) for x in ([0, 0], [5, 0], [9, 0], [9, 0.1])] == [0, 1, 2, 2]


def test_agglomerate():
    x = np.array([[1, 0], [1, 0.1], [0, 1], [0.1, 1], [-1, 0]])
    assert cluster.agglomerate(x, 0.3, 1, 5) == [0, 0, 1, 1, 2]
    assert cluster.agglomerate(x, 0.3, 2, 2) == [0, 0, 0, 0, 1] or len(set(cluster.agglomerate(x, 0.3, 2, 2))) == 2


def test_scalars(spark):
    df = spark.createDataFrame([(-3_661_007, 1.0, 2.675, "ﬁ é ab12c x", [2.0, 1.0, 1.0])], "m long, s double, r double, t string, v array<double>")
    c = F.col
    r = df.select(scalars.clock(c("m")), scalars.int16_wrapped(c("s")), scalars.py_round2(c("r")), scalars.nfkc(c("t")), scalars.without_accents(c("t")), scalars.spaced_alpha_num(F.lit("ab12c x")), scalars.faded_int16(c("v"), 2), scalars.codec_tokens(F.lit("<|s_12|><|speech_3|>")), scalars.from_log(F.lit(9.0))).first()
    assert list(r) == ["-01:01:01.007", -32768, 2.67, "fi é ab12c x", "ﬁ e ab12c x", "ab 12 C X", [32767, 32767, 0], [12, 3], 1e5]


def test_buckets_are_even(spark):
    """One value far from all others leaves no bucket with more than a hundredth of the distinct values."""
    from turnstream.operators import report

    df = spark.range(1_000_000).selectExpr("1 as k", "id as v").unionByName(spark.createDataFrame([(1, 10**13), (2, 5), (2, 5), (2, None)], "k int, v long"))
    counted = df.groupBy("k", "v").agg(F.count("*").alias("times"))
    sizes = report.in_buckets(counted.filter("k = 1"), ["k"], "v", 400).groupBy("bucket").count()
    assert sizes.agg(F.max("count")).first()[0] <= 10_000
    out = {r.k: r for r in report.order_statistics(df, ["k"], "v").collect()}
    assert (out[1].n, out[1].least, out[1].most, out[1].p50, out[1].p90, out[1].p99) == (1_000_001, 0, 10**13, 500_000, 899_999, 989_999)
    assert (out[2].least, out[2].p50, out[2].most) == (5, 5, 5)
