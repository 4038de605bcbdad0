"""Forced alignment: trellis, best path, runs and words. An utterance is one group; its frames are bounded
by the aligner's 30 seconds."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstream.config import checked

MOST_FRAMES = 1_700  # of an utterance: 30 seconds and the context, at 50 frames a second
CONVOLUTIONS = [(10, 5), (3, 2), (3, 2), (3, 2), (3, 2), (2, 2), (2, 2)]  # fixed values: kernel and stride of each layer


def trellis(emission: np.ndarray, tokens: np.ndarray, blank: int = 0) -> np.ndarray:
    """Best log score of the first j tokens within the first t frames; no token costs nothing."""
    frames, n = len(emission), len(tokens)
    out = np.full((frames + 1, n + 1), -np.inf)
    out[:, 0] = 0
    for t, e in enumerate(emission):
        stay, move = out[t, 1:] + e[blank], out[t, :-1] + e[tokens]
        out[t + 1, 1:] = np.where(move > stay, move, stay)
    return out


def best_path(scores: np.ndarray, emission: np.ndarray, tokens: np.ndarray, blank: int = 0) -> list[tuple[int, int, float]]:
    """(token_index, time_index, probability) in order of time; empty if the tokens don't fit."""
    j, path = len(tokens), []
    for t in range(int(np.argmax(scores[:, j])), 0, -1):
        e = emission[t - 1]
        moved = scores[t - 1, j - 1] + e[tokens[j - 1]] > scores[t - 1, j] + e[blank]
        path.append((j - 1, t - 1, float(np.exp(e[tokens[j - 1] if moved else blank]))))
        j -= int(moved)
        if j == 0:
            return path[::-1]
    return []


def _grouped(emissions: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """key, frames (array of emission rows in order), tokens (array of ids in order).

    The query fails if an utterance has more than MOST_FRAMES frames, before any is gathered.
    """
    size = emissions.groupBy(key).agg(F.count("*").alias("frames_of_key"))
    emissions = checked(emissions.join(size, key), F.col("frames_of_key") <= MOST_FRAMES, f"an utterance has more than {MOST_FRAMES} frames")
    ordered = lambda c, v: F.transform(F.array_sort(F.collect_list(F.struct(c, v))), lambda x: x[v])
    return emissions.groupBy(key).agg(ordered("t", "logp").alias("frames")).join(tokens.groupBy(key).agg(ordered("j", "token_id").alias("tokens")), key)


def _by_utterance(grouped: DataFrame, key: str, rows_of: Callable, ddl: str) -> DataFrame:
    names = [x.split()[0] for x in ddl.split(", ")]

    def scan(batches):
        for pdf in batches:
            out = []
            for k, frames, tokens in zip(pdf[key], pdf["frames"], pdf["tokens"], strict=True):
                emission = np.array([np.asarray(f, dtype=np.float64) for f in frames])
                out += [(k, *r) for r in rows_of(emission, np.asarray(tokens, dtype=np.int64))]
            yield pd.DataFrame(out, columns=[key, *names])

    return grouped.mapInPandas(scan, f"{key} long, {ddl}")


def align_scores(emissions: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """key, end_frame (where the whole transcript scores best, the first such), score."""

    def rows(e, t):
        last = trellis(e, t)[:, -1]
        k = int(np.argmax(last))
        return [(k, float(last[k]))]

    return _by_utterance(_grouped(emissions, tokens, key), key, rows, "end_frame int, score double")


def align_paths(emissions: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """key, token_index, time_index, probability. Utterances whose tokens don't fit have no rows."""
    rows = lambda e, t: best_path(trellis(e, t), e, t)
    return _by_utterance(_grouped(emissions, tokens, key), key, rows, "token_index int, time_index int, probability double")


def merge_repeats(path: DataFrame, key: str) -> DataFrame:
    """Runs of one token: key, token_index, start, end (exclusive), score (mean probability)."""
    return path.groupBy(key, "token_index").agg(F.min("time_index").alias("start"), (F.max("time_index") + 1).alias("end"), F.avg("probability").alias("score"))


def merge_words(runs: DataFrame, key: str, label: str, star: str = "<star>") -> DataFrame:
    """Runs between stars become words: key, word_no, text, start, end (the next star's start), score by length."""
    w = Window.partitionBy(key).orderBy("token_index")
    length = F.col("end") - F.col("start")
    numbered = runs.withColumn("group", F.sum((F.col(label) == star).cast("int")).over(w)).withColumn("next", F.lead("start").over(w))
    words = numbered.filter(F.col(label) != star).groupBy(key, "group").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_index", F.col(label).alias("l")))), lambda x: x["l"]), "").alias("text"),
        F.min("start").alias("start"), F.max_by(F.coalesce("next", "end"), "token_index").alias("end"), (F.sum(F.col("score") * length) / F.sum(length)).alias("score"),
    )
    return words.withColumn("word_no", F.row_number().over(Window.partitionBy(key).orderBy("group")) - 1).drop("group")


def word_times(words: DataFrame, sizes: DataFrame, key: str, rate: int = 16_000) -> DataFrame:
    """Words (of ``merge_words``) as they are served, in thousandths: key, word_no, text, start_ms, end_ms, start_t, end_t, score_milli, length_ms.

    sizes: key, n_samples, n_frames. A frame is the recording's length over its number of frames, so words end with it
    whatever the model's stride leaves over. A recording without frames has no words.
    """
    joined = words.join(sizes.select(key, "n_samples", "n_frames"), key)
    seconds = F.col("n_samples") / F.lit(float(rate)) / F.col("n_frames")
    milli = lambda c: F.floor(c * 1000 + 0.5).cast("long")
    return joined.select(
        key, "word_no", "text", milli(F.col("start") * seconds).alias("start_ms"), milli(F.col("end") * seconds).alias("end_ms"), F.col("start").alias("start_t"), F.col("end").alias("end_t"),
        milli(F.col("score")).alias("score_milli"), milli(F.col("n_samples") / F.lit(float(rate))).alias("length_ms"),
    )


def log_softmax_star(e: Column) -> Column:
    """Log-softmax of an array of scores with a star column of zero behind it."""
    top = F.array_max(e)
    total = F.aggregate(F.transform(e, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    return F.concat(F.transform(e, lambda x: x - top - F.log(total)), F.array(F.lit(0.0)))


def convolved(n: Column) -> Column:
    """Frames that the acoustic model makes of n samples."""
    for kernel, stride in CONVOLUTIONS:
        n = F.floor((n - kernel) / stride) + 1
    return F.greatest(n, F.lit(0))


def emission_window(samples: Column, window: int, context: int) -> Column:
    """The first window of a signal with context at both sides: zeros before it, zeros up to whole windows behind it."""
    n = F.size(samples)
    extension = (F.ceil(n / window) * window - n).cast("int")
    zeros = lambda k: F.array_repeat(F.lit(0.0), k)
    return F.slice(F.concat(zeros(F.lit(context)), samples, zeros(extension + context)), 1, window + 2 * context)


def trimmed_frames(frames: Column, n_samples: Column, window: int, rate: int, context_frames: int, frames_a_second: int) -> Column:
    """A window's frames without those of the context (all but one at the end) and of the extension."""
    own = F.slice(frames, context_frames + 1, F.greatest(F.size(frames) - 2 * context_frames + 1, F.lit(0)))
    more = F.floor((F.ceil(n_samples / window) * window - n_samples) / rate * frames_a_second).cast("int")
    return F.slice(own, 1, F.greatest(F.size(own) - more, F.lit(0)))


def zipped(a: Column, b: Column) -> Column:
    """Pairs by place: array<struct<place, a, b>>, as long as the shorter side."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.struct(x.alias("a"), y.alias("b")))
