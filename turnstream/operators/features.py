"""Signal features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pre_emphasis(df: DataFrame, key: str, order: str, value: str, out: str, factor: float = 0.97) -> DataFrame:
    """x[n] - factor * x[n-1]; the first value of a key is kept."""
    last = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn(out, F.when(last.isNull(), F.col(value)).otherwise(F.col(value) - F.lit(factor) * last))


def splice(df: DataFrame, key: str, order: str, value: str, out: str, k: int) -> DataFrame:
    """Each row with its next k-1 values; rows without so many are dropped."""
    w = Window.partitionBy(key).orderBy(order)
    parts = [F.lead(value, i).over(w) for i in range(k)]
    spliced = df.withColumn(out, F.array(*parts)).withColumn("last_of_splice", F.lead(order, k - 1).over(w))
    return spliced.filter(F.col("last_of_splice").isNotNull()).drop("last_of_splice")


def normalized(df: DataFrame, keys: list[str], value: str, out: str, eps: float = 1e-5) -> DataFrame:
    """(x - mean) / (sample deviation + eps) over all rows of the keys: those of a signal and feature, or of a
    signal for one mean of all its features. One row alone is null. Means come from a partial aggregation, not from windows over hot keys."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("mean_of_key"), F.stddev_samp(value).alias("sd_of_key"))
    return df.join(stats, keys).withColumn(out, (F.col(value) - F.col("mean_of_key")) / (F.col("sd_of_key") + eps)).drop("mean_of_key", "sd_of_key")


def normalized_fixed(df: DataFrame, value: str, out: str, mean: Column, deviation: Column) -> DataFrame:
    return df.withColumn(out, (F.col(value) - mean) / deviation)


def masked_statistics(df: DataFrame, keys: list[str], value: str, weight: str, eps: float = 1e-10) -> DataFrame:
    """keys, mean, deviation: sum(w * x) and the root of sum(w * (x - mean)**2), at least eps; weights as they are."""
    mean = df.groupBy(*keys).agg(F.sum(F.col(weight) * F.col(value)).alias("mean"))
    apart = F.col(weight) * (F.col(value) - F.col("mean")) * (F.col(value) - F.col("mean"))
    return df.join(mean, keys).groupBy(*keys).agg(F.max("mean").alias("mean"), F.sqrt(F.greatest(F.sum(apart), F.lit(eps))).alias("deviation"))


def pooled(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, most, average: pooling over time."""
    return df.groupBy(*keys).agg(F.max(value).alias("most"), F.avg(value).alias("average"))


def span_sum(scores: Column, start: Column, end: Column) -> Column:
    """The sum of scores[start:end]."""
    return F.aggregate(F.slice(scores, start + 1, F.greatest(end - start, F.lit(0))), F.lit(0.0), lambda a, x: a + x)


def padded_square(values: Column, rows: int, columns: int, fill: Column, front: bool = False) -> Column:
    """An array of arrays padded to rows x columns, behind or in front."""
    wide = F.transform(values, lambda r: padded(r, F.lit(columns), fill, front))
    return padded(wide, F.lit(rows), F.array_repeat(fill, columns), front)


def loudness_share(samples: Column, low: float = -20.0, high: float = 80.0) -> Column:
    """The level of peak-normalised samples in decibels, from 0 at ``low`` to 1 at ``high``: a mean square without the
    ear's weighting, which needs a library that is not here."""
    top = F.array_max(F.transform(samples, lambda x: F.abs(x)))
    square = F.aggregate(samples, F.lit(0.0), lambda a, x: a + (x / top) * (x / top)) / F.size(samples)
    return F.when(top > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (10 * F.log10(square) - low) / (high - low)))).otherwise(0.0)


def statistics_pool(df: DataFrame, keys: list[str], value: str, place: Column | None = None, length: Column | None = None) -> DataFrame:
    """Mean and sample deviation (variance at least 1e-10) over time; of the first ``length`` places only, if given.

    Keys none of whose places are within the length are not there.
    """
    if (place is None) != (length is None):
        raise ValueError("place and length go together")
    if place is not None:
        df = df.filter(place < length)
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.sqrt(F.greatest(F.coalesce(F.var_samp(value), F.lit(0.0)), F.lit(1e-10))).alias("deviation"))


def padded(values: Column, n: Column, fill: Column, front: bool = False) -> Column:
    more = F.array_repeat(fill, (n - F.size(values)).cast("int"))
    return F.concat(more, values) if front else F.concat(values, more)


def mel_filters(n_mels: int, n_fft: int, rate: int) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale, of unit area."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), n_mels + 2) / 2595) - 1)
    bins = np.arange(n_fft // 2 + 1) * rate / n_fft
    up = (bins - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - bins) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def log_mel(signals: DataFrame, keep: list[str], samples: str, rate: int, n_fft: int = 512, hop: int = 160, n_mels: int = 80, pad: bool = True, guard: float = 2.0**-24) -> DataFrame:
    """keep, frame, mel: log mel energies of each window of an array of samples, centred and zero-padded if pad."""
    ddl = ", ".join(f"`{c}` {signals.schema[c].dataType.simpleString()}" for c in keep) + ", frame int, mel array<double>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, window = mel_filters(n_mels, n_fft, rate), np.hanning(n_fft + 1)[:-1]
        for batch in batches:
            for i, x in enumerate(batch.column(samples).to_pylist()):
                x = np.pad(np.asarray(x or [], dtype=np.float64), n_fft // 2 if pad else 0)
                frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop] * window
                with np.errstate(divide="ignore"):
                    mel = np.log((np.abs(np.fft.rfft(frames, axis=1)) ** 2) @ filters.T + guard)
                rows = pa.array(np.full(len(mel), i))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in keep), pa.array(np.arange(len(mel), dtype=np.int32)), pa.array(list(mel), pa.list_(pa.float64()))], names=[*keep, "frame", "mel"])

    return signals.select(*keep, samples).mapInArrow(scan, ddl)


def mfcc(signals: DataFrame, keep: list[str], samples: str, rate: int, n_mfcc: int = 13, log: bool = False, **mel) -> DataFrame:
    """keep, frame, mfcc: the orthonormal cosine transform (type 2) of mel energies, in decibels or as logarithms.

    Decibels are 10 * log10, at least 1e-10, and no more than 80 below the signal's loudest.
    """
    rows = log_mel(signals, keep, samples, rate, guard=0.0, **mel)
    n_mels = mel.get("n_mels", 80)
    k, m = np.arange(n_mfcc)[:, None], np.arange(n_mels)
    basis = np.cos(np.pi / n_mels * (m + 0.5) * k) * np.sqrt(2 / n_mels)
    basis[0] /= np.sqrt(2)
    energy = F.transform("mel", lambda x: F.exp(x))
    if log:
        level = F.transform(energy, lambda x: F.log(x + 1e-6))
    else:
        rows = rows.withColumn("db", F.transform(energy, lambda x: 10 * F.log10(F.greatest(x, F.lit(1e-10)))))
        top = rows.groupBy(*keep).agg(F.max(F.array_max("db")).alias("top"))
        rows = rows.join(top, keep)
        level = F.transform("db", lambda x: F.greatest(x, F.col("top") - 80))
    row = lambda weights: F.aggregate(F.zip_with("level", F.lit([float(w) for w in weights]), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("level", level).select(*keep, "frame", F.array(*[row(b) for b in basis]).alias("mfcc"))


def log_mel_clamped(signals: DataFrame, keep: list[str], samples: str, rate: int, guard: float = 2.0**-24, factor: float = 0.97, **mel) -> DataFrame:
    """keep, frame, mel: the second front end: pre-emphasis first, energies at least ``guard`` before the logarithm, by
    feature less its mean over its deviation (divisor n - 1, variance at least the guard, plus 1e-5)."""
    x = F.col(samples)
    emphasised = F.transform(x, lambda v, i: F.when(i > 0, v - factor * F.get(x, i - 1)).otherwise(v))
    rows = log_mel(signals.withColumn(samples, emphasised), keep, samples, rate, guard=0.0, **mel)
    each = rows.select(*keep, "frame", F.posexplode("mel").alias("feature", "x")).withColumn("x", F.log(F.greatest(F.exp("x"), F.lit(guard))))
    stats = each.groupBy(*keep, "feature").agg(F.avg("x").alias("m"), F.sqrt(F.greatest(F.coalesce(F.var_samp("x"), F.lit(0.0)), F.lit(guard))).alias("sd"))
    z = each.join(stats, [*keep, "feature"]).withColumn("z", (F.col("x") - F.col("m")) / (F.col("sd") + 1e-5))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("feature", "z"))), lambda v: v["z"])
    return z.groupBy(*keep, "frame").agg(in_order.alias("mel"))


def log_mel_of_streams(df: DataFrame, key: str, order: str, value: str, rate: int, n_fft: int, hop: int, n_mels: int, piece: int) -> DataFrame:
    """key, part, frame, mel: log mel energies of whole streams, whose values are numbered from 0 by ``order``.

    Streams are cut into pieces of ``piece`` values (a multiple of ``hop``), so that none is gathered whole.
    A piece has the windows whose centres lie in it and all values that they cover, so values near a cut go
    to both sides; zeros stand only before a stream's first value and after its last. Frames are numbered
    over the stream.
    """
    half, i = n_fft // 2, F.col(order)
    parts = F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((i + hop - half) / piece)), F.floor((i + half) / piece))
    dealt = df.select(key, i.alias("at"), F.col(value).alias("value"), F.explode(parts).alias("part"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"].cast("double"))
    pieces = dealt.groupBy(key, "part").agg(in_order.alias("samples")).join(df.groupBy(key).agg((F.max(i) + 1).alias("n")), key)
    begin = F.col("part") * piece
    zeros = lambda n: F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.least(n, F.lit(half))).cast("int"))
    whole = F.concat(zeros(half - begin), "samples", zeros(begin + piece - hop + half - F.col("n")))
    # the values after a stream's last centre are in a next piece that has no centre of its own
    signals = pieces.filter(begin <= F.col("n")).select(key, "part", whole.alias("samples"))
    return log_mel(signals, [key, "part"], "samples", rate, n_fft, hop, n_mels, pad=False).withColumn("frame", (F.col("part") * (piece // hop) + F.col("frame")).cast("int"))
