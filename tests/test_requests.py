"""Normalisation by languages, answers, prompts, features and windows against values worked out by hand or in plain Python."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnstream.functions import markers, normalize, prompts
from turnstream.operators import align, cluster, features, folds, intervals
from turnstream.sources import audio


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "language", "wanted"),
    [
        ("یہ ہے۔ اب؟ ہاں؞ ۔", "*", "یہ ہے اب ہاں"),  # Urdu full stops and question marks
        ("aۖb ۚc⁠d", "*", "a b c d"),
        ("xyz", "*", "x y z"),
        ("ﬁne １２ Ｗide", "*", "fine wide"),  # compatibility forms first, then digits
        ("rock’n’roll it’s ’tis dogs’", "*", "rock n'roll it's tis dogs"),  # of a word's quotes the last one stays
        ("a’’ b", "*", "a' b"),
        ("AT&amp;T &lt;b&gt; x&nbsp;y", "*", "at amp t b x y"),
        ("(Sam 24:18) (a) go (٣)", "*", "a go"),
        ("ٱلله ـ", "*", "الله"),
        ("so­ft", "*", "so­ft"),
        ("so­ft", "mon", "soft"),
        ("a‍b", "tha", "a b"),
        ("שָׁלוֹם", "heb", "שלום"),
        ("Perlu crème é", "jav", "perlu creme e"),
        ("12 ab 46 x8 9 १२", "*", "ab x8"),
    ],
)
def test_normalisation_by_hand(spark, text, language, wanted):
    assert one(spark, normalize.text_normalize(F.lit(text), language)) == wanted


def test_normalisation_takes_linear_time(spark):
    for text in ("a" * 200_000, "’a" * 60_000, "’" * 100_000, "1 " * 60_000):
        assert one(spark, F.length(normalize.text_normalize(F.lit(text)))) is not None


def test_split_and_preprocess(spark):
    df = spark.createDataFrame([(1, "Ab c. De? fg"), (2, ""), (3, None)], "i int, t string")
    words = {r.i: (r.tokens, r.texts) for r in normalize.preprocess_text(df, "t", ["i"]).collect()}
    assert words[1] == (["<star>", "a b", "<star>", "c", "<star>", "d e", "<star>", "f g"], ["<star>", "Ab", "<star>", "c.", "<star>", "De?", "<star>", "fg"])
    assert words[2] == words[3] == ([], [])
    characters = {r.i: r.texts for r in normalize.preprocess_text(df, "t", ["i"], "jpn", "word", "edges").collect()}
    assert characters[1] == ["<star>", *"Ab c. De? fg", "<star>"]
    assert one(spark, normalize.split_text(F.lit("One two. Three! Four"), "sentence")) == ["One two.", "Three!", "Four"]
    for bad in ({"size": "page"}, {"frequency": "none"}):
        with pytest.raises(ValueError, match="must be"):
            normalize.preprocess_text(df, "t", ["i"], **bad)


def test_shifted_segments(spark):
    rows = [(1, 0.125, 1.0, " a "), (2, None, 2.675, "b"), (3, 3.0, None, "c"), (4, 1.0, 2.0, " \n"), (5, 1.0, 2.0, None)]
    out = markers.shifted_segments(spark.createDataFrame(rows, "i int, s double, e double, t string"), "s", "e", "t", F.lit(1.0))
    assert sorted(map(tuple, out.collect())) == [(1, round(1.125, 2), 2.0, "a"), (2, 1.0, round(3.675, 2), "b"), (3, 4.0, 1.0, "c")]


def test_answers(spark):
    bodies = ['{"segments": [{"start": 1, "end": 2.5, "text": " a "}, {"text": "b"}, {"start": 3, "end": 4, "text": " "}]}', '{"text": "<|startoftranscript|><|0.00|>x<|1.25|>", "segments": null}', '{"segments": [], "text": "t"}', "{}", "no json"]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    found = [r[0] for r in df.orderBy("i").select(prompts.response_text(F.col("body"), F.lit(10))).collect()]
    assert found == ["<|11.0|>a<|12.5|><|10.0|>b<|10.0|>", "<|10.0|>x<|11.25|>", "", "", ""]


def test_merge_modes(spark):
    segments = spark.createDataFrame([(1, 0, 0, 100), (1, 1, None, 50), (1, 2, 120, None), (1, 3, 900, 950)], "k int, id int, s long, e long")
    turns = spark.createDataFrame([(1, 0, 0, 60, "SPEAKER_02"), (1, 1, 60, 200, "SPEAKER_x")], "k int, pos long, s long, e long, speaker string")
    chunks = spark.createDataFrame([(1, 7, 0, 110), (1, 8, 110, 300)], "k int, chunk_idx long, s long, e long")
    assigned = spark.createDataFrame([(1, 7, 4)], "k int, chunk_idx long, speaker int")
    speakers = lambda df: {r.id: r.speaker for r in df.collect()}
    assert speakers(intervals.merge_speakers(segments, turns, "offline", "k", "id")) == {0: 2, 1: 2, 2: 0, 3: 0}
    assert speakers(intervals.merge_speakers(segments, assigned, "online", "k", "id", chunks)) == {0: 4, 1: 4, 2: 0, 3: 0}
    assert intervals.merge_speakers(segments, None, "none", "k", "id") is segments


def test_prompts(spark):
    message = lambda role, text: F.struct(F.lit(role).alias("role"), F.lit(text).alias("content"))
    told = lambda *m, prompt="P": [(r.role, r.content) for r in one(spark, prompts.with_system(F.array(*m), F.lit(prompt)))]
    assert told(message("system", "S"), message("user", "u")) == [("system", "S\n\nP"), ("user", "u")]
    assert told(message("user", "u")) == [("system", "P"), ("user", "u")]
    assert told(message("user", "u"), prompt="") == [("user", "u")]
    assert told(message("system", " "), message("user", "u"), prompt="") == [("user", "u")]
    tool = {"name": "f", "parameters": {"x": [1, "é"]}}
    assert one(spark, prompts.pretty_json(F.lit(json.dumps(tool)))) == json.dumps(tool, indent=4)
    assert one(spark, prompts.tools_prompt(F.array(F.lit("{}")))) == ""
    assert one(spark, prompts.tools_prompt(F.array(F.lit("{1234}")))).startswith("Below is functions")
    strings = lambda x: one(spark, prompts.input_strings(F.lit(x), F.array(F.lit("a"), F.lit("b"))))
    assert [strings(x) for x in ('"t \\" u"', '["x", "y"]', "[0, 1]", "[[0], [1, 1]]")] == [['t " u'], ["x", "y"], ["a b"], ["a", "b b"]]
    assert one(spark, prompts.with_speaker_tag(F.lit("a<|b|><|c|>"), F.lit("3"))) == "a<|3|><|b|><|c|>"
    assert one(spark, prompts.with_speaker_tag(F.lit("a"), F.lit("3"))) == "a<|3|>"
    assert one(spark, prompts.spoken(F.lit("it's  3-5 km\nab12 x"), {"km": "kilometres"}, {"it's": "it is"})) == "it is 3 to 5 kilometres ab 12 X"
    assert [one(spark, prompts.language_field(F.lit(x))) for x in ("", "null", "en")] == [None, None, "en"]


def test_quota():
    q = folds.Quota(10, 100)
    take = lambda *rows: q.take({"item": np.array([r[0] for r in rows]), "at": np.array([r[1] for r in rows]), "tokens": np.array([r[2] for r in rows])})
    assert take((0, 0, 5), (1, 50, 8), (2, 60, 9)) == [(0, -1, False), (1, 4, False), (2, 12, True)]
    assert take((3, 149, 9), (4, 150, 1)) == [(3, 12, True), (4, -1, False)]  # a refused request does not renew the counter


def test_features_by_numpy(spark):
    x = np.random.default_rng(3).normal(size=64)
    df = spark.createDataFrame([(1, x.tolist())], "i int, samples array<double>")
    mel = np.array([r.mel for r in features.log_mel(df, ["i"], "samples", 16_000, 16, 8, 6, guard=0.0).orderBy("frame").collect()])
    db = 10 * np.log10(np.maximum(np.exp(mel), 1e-10))
    db = np.maximum(db, db.max() - 80)
    k, m = np.arange(4)[:, None], np.arange(6)
    basis = np.cos(np.pi / 6 * (m + 0.5) * k) * np.where(k == 0, math.sqrt(1 / 6), math.sqrt(2 / 6))
    found = np.array([r.mfcc for r in features.mfcc(df, ["i"], "samples", 16_000, 4, n_fft=16, hop=8, n_mels=6).orderBy("frame").collect()])
    assert np.allclose(found, db @ basis.T)
    emphasised = np.concatenate([x[:1], x[1:] - 0.97 * x[:-1]])
    again = spark.createDataFrame([(1, emphasised.tolist())], "i int, samples array<double>")
    raw = np.log(np.maximum(np.exp(np.array([r.mel for r in features.log_mel(again, ["i"], "samples", 16_000, 16, 8, 6, guard=0.0).orderBy("frame").collect()])), 2.0**-24))
    wanted = (raw - raw.mean(0)) / (np.sqrt(np.maximum(raw.var(0, ddof=1), 2.0**-24)) + 1e-5)
    found = np.array([r.mel for r in features.log_mel_clamped(df, ["i"], "samples", 16_000, n_fft=16, hop=8, n_mels=6).orderBy("frame").collect()])
    assert np.allclose(found, wanted)
    share = one(spark, features.loudness_share(F.lit(x.tolist())))
    assert math.isclose(share, (10 * math.log10(((x / np.abs(x).max()) ** 2).mean()) + 20) / 100)
    assert one(spark, features.loudness_share(F.lit([0.0, 0.0]))) == 0.0
    assert one(spark, features.padded_square(F.array(F.array(F.lit(1)), F.array(F.lit(2), F.lit(3))), 3, 2, F.lit(0), front=True)) == [[0, 0], [0, 1], [2, 3]]
    assert one(spark, features.span_sum(F.lit([1.0, 2.0, 4.0]), F.lit(1), F.lit(3))) == 6.0


@pytest.mark.parametrize("n", [1, 9, 10, 11, 25])
def test_emission_window(spark, n):
    x = [float(k + 1) for k in range(n)]
    more = -n % 10
    whole = [0.0] * 2 + x + [0.0] * (2 + more)
    assert one(spark, align.emission_window(F.lit(x), 10, 2)) == whole[:14]
    frames = whole[:14]
    kept = frames[2:-1]
    kept = kept[:-more] if more else kept
    assert one(spark, align.trimmed_frames(F.lit(frames), F.lit(n), 10, 1, 2, 1)) == kept


def test_labels(spark):
    scores = F.lit([0.1, 0.9, 0.9, 0.3])
    assert one(spark, cluster.top_k(scores, 3)) == [1, 2, 3]
    assert one(spark, cluster.top_over(scores, 0.9)) == 1
    assert one(spark, cluster.top_over(scores, 0.95)) is None


def test_more_payloads(spark):
    assert one(spark, audio.from_base64(F.lit("AAECAw=="))) == b"\x00\x01\x02\x03"
    assert one(spark, audio.from_base64(F.lit("%"))) is None
    samples = one(spark, audio.int16_samples(audio.from_base64(F.lit("AAAAQA=="))))
    assert samples == [0.0, 0.5]
    stream = one(spark, audio.pcm_stream(F.lit([1, -2])))
    assert stream[:4] == b"RIFF" and stream[-4:] == b"\x01\x00\xfe\xff" and int.from_bytes(stream[24:28], "little") == 24_000
