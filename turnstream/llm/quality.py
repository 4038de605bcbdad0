"""Text quality by positive-unlabelled learning.

Trusted positives are labelled rows with label 1 that are not held out; all texts together are the
unlabelled sample. No other label is read. With the logistic loss l and the class prior p, the unbiased risk
of a linear score is p*E_pos[l(+z)] + (E_all[l(-z)] - p*E_pos[l(-z)]); the bracket, the risk on negatives,
must not be below zero, so a step that takes it there is refused and shortened (the non-negative
estimator). Newton steps over all rows: each gathers sums of the size of the feature vector squared, one
array a task, added up in two levels. At the minimum the mean score is the prior, so scores need no scale
from labels. Features come from the text alone.

The prior, if none is given, is estimated from the same two samples: for a first model, of one half of the
positives and the prior FIRST_PRIOR, the least ratio of the share of all texts to the share of the other
half's positives above a threshold (``estimate_prior``). Where texts above it are all good, that ratio is
the prior.
"""

from __future__ import annotations

import math

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialise, remove
from .words import Words, slices

STEPS = 25
RIDGE = 1e-3
CUT = 0.7
BINS = 50
FIRST_PRIOR, FIRST_STEPS, LEAST_MASS, LEAST_POSITIVES = 0.5, 8, 0.5, 20
LEAST_PRIOR, MOST_PRIOR = 0.05, 0.98

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".", "comma": b",", "bang": b"!?", "symbol": b"#$%&*@^~|\\<>{}[]=+_", "line": b"\n"}
_BYTE_CLASS = np.zeros((len(_CLASSES), 256), dtype=bool)
for _k, _v in enumerate(_CLASSES.values()):
    _BYTE_CLASS[_k, list(_v)] = True
SHARES = [*_CLASSES, "high", "same_before", "distinct", "distinct_pairs", "top_word", "shouted", "marked", "distinct_lines"]
KNOTS = (0.02, 0.1, 0.3, 0.6, 0.9)
N_FEATURES = len(SHARES) * (1 + len(KNOTS)) + 8


def _distinct_by_text(values: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct values of each text, and the count of its commonest one."""
    if not len(values):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((values, text))
    v, t = values[order], text[order]
    new = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (t[1:] != t[:-1])]))
    most = np.zeros(n)
    np.maximum.at(most, t[new], np.diff(np.append(new, len(v))))
    return np.bincount(t[new], minlength=n).astype(float), most


def features(words: Words) -> np.ndarray:
    """One row of shares, their hinges and lengths for each text; an empty text has all shares zero."""
    n, raw = len(words.first) - 1, words.raw
    size = np.diff(words.offsets).astype(float)
    count = np.diff(words.first).astype(float)
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(count, 1)

    def total(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (c[at[1:]] - c[at[:-1]]).astype(float)

    h = words.hashes(lower=True)
    text = np.repeat(np.arange(n), np.diff(words.first))
    last = raw[words.end - 1] if len(h) else np.zeros(0, np.uint8)
    first = raw[words.start] if len(h) else np.zeros(0, np.uint8)
    second = raw[np.minimum(words.start + 1, max(len(raw) - 1, 0))] if len(h) else first
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    pair = h[1:] * np.uint64(31) + h[:-1]
    inside = text[1:] == text[:-1]
    kinds, top = _distinct_by_text(h, text, n)
    pairs, _ = _distinct_by_text(pair[inside], text[1:][inside], n)
    breaks = np.flatnonzero(raw == 10)
    line_of = np.searchsorted(breaks, words.start) if len(h) else np.zeros(0, np.int64)
    begins = np.ones(len(h), dtype=bool)
    begins[1:] = (line_of[1:] != line_of[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(begins)
    lines = np.bincount(text[head], minlength=n).astype(float)
    shape = np.add.reduceat(h * np.uint64(3), head) if len(head) else np.zeros(0, np.uint64)
    distinct_lines, _ = _distinct_by_text(shape, text[head], n)
    upper = lambda b: (b >= 65) & (b <= 90)
    shares = [total(_BYTE_CLASS[k][raw], words.offsets) * per_byte for k in range(len(_CLASSES))]
    shares += [total(raw >= 128, words.offsets) * per_byte, total(same, words.first) * per_word, kinds * per_word, pairs * per_word, top * per_word]
    marks = _BYTE_CLASS[4] | _BYTE_CLASS[5]
    shares += [total(upper(first) & upper(second), words.first) * per_word, total(marks[last], words.first) * per_word, distinct_lines / np.maximum(lines, 1)]
    s = np.stack(shares, axis=1)
    hinges = [np.maximum(s - k, 0) for k in KNOTS]
    length, mean = np.log1p(count), size * per_word
    rest = np.stack([np.ones(n), count == 0, length, length**2 / 10, np.minimum(mean, 20) / 10, np.maximum(mean - 8, 0).clip(0, 20) / 10, np.maximum(4 - mean, 0), kinds / np.maximum(np.sqrt(count), 1) / 10], axis=1)
    return np.concatenate([s, *hinges, rest], axis=1).astype(np.float32)


def with_features(docs: DataFrame, text_col: str = "text", names: list[str] | None = None) -> DataFrame:
    """The named columns and ``features`` (array of float) of each row's whole text; null counts as empty."""
    names = names or []
    rows = docs.select(*names, F.coalesce(F.col(text_col), F.lit("")).alias("quality_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + (", " if names else "") + "features array<float>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in slices(batch, "quality_text"):
                x = features(words)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], flat], names=[*names, "features"])

    return rows.mapInArrow(scan, schema)


def _sums(table: DataFrame, weights: np.ndarray | None, scale: tuple) -> dict[str, np.ndarray]:
    """Over all rows: gradient and Hessian sums of the unlabelled risk, sums over positives, and losses."""
    d = N_FEATURES
    mean, inverse = scale

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(d + d * d + d + 5)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("features").flatten().to_numpy().reshape(-1, d).astype(float)
            good = batch.column("positive").to_numpy(zero_copy_only=False)
            if weights is None:
                out[:d] += x.sum(0)
                out[d : d + d * d] += (x.T @ x).ravel()
            else:
                x = (x - mean) * inverse
                z = x @ weights
                p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
                out[:d] += x.T @ p
                out[d : d + d * d] += (x.T @ (x * (p * (1 - p))[:, None])).ravel()
                out[-3] += np.logaddexp(0, z).sum()
                out[-2] += np.logaddexp(0, z[good]).sum()
                out[-1] += z[good].sum()
            out[d + d * d : d + d * d + d] += x[good].sum(0)
            out[-5] += len(x)
            out[-4] += good.sum()
        yield pa.RecordBatch.from_arrays([pa.array([out], pa.list_(pa.float64()))], names=["v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = sum((b.column(0).flatten().to_numpy().reshape(b.num_rows, -1).sum(0) for b in batches if b.num_rows), np.zeros(d + d * d + d + 5))
        yield pa.RecordBatch.from_arrays([pa.array([out], pa.list_(pa.float64()))], names=["v"])

    parts = table.mapInArrow(scan, "v array<double>")
    few = max(1, math.isqrt(table.rdd.getNumPartitions()))
    v = np.sum([r["v"] for r in parts.repartition(few).mapInArrow(add, "v array<double>").collect()], axis=0)  # the square root of the number of tasks
    return {"g": v[:d], "h": v[d : d + d * d].reshape(d, d), "pos": v[d + d * d : -5], "n": v[-5], "n_pos": v[-4], "all": v[-3], "pos_neg": v[-2], "z": v[-1]}


def fit(table: DataFrame, prior: float, steps: int = STEPS, ridge: float = RIDGE) -> dict:
    """table: features, positive (boolean). The weights that minimise the non-negative PU risk.

    Without positives or without rows the weights are zero but for the prior's log odds.
    """
    d = N_FEATURES
    first = _sums(table, None, (None, None))
    odds = math.log(prior / (1 - prior))
    if not first["n"] or not first["n_pos"]:
        return {"w": np.zeros(d), "mean": np.zeros(d), "inverse": np.zeros(d), "bias": odds}
    mean = first["g"] / first["n"]
    spread = np.sqrt(np.maximum(np.diag(first["h"]) / first["n"] - mean**2, 0))
    inverse = np.where(spread > 1e-6, 1 / np.maximum(spread, 1e-6), 0)
    constant = len(SHARES) * (1 + len(KNOTS))  # the feature that is always one
    mean[constant], inverse[constant] = 0, 1
    penalty = np.full(d, ridge + 1 / first["n_pos"])  # few positives allow no large weights
    penalty[constant] = 1e-9
    w = np.zeros(d)
    w[constant] = odds

    def risk(s: dict, w: np.ndarray) -> tuple[float, float]:
        negative = s["all"] / s["n"] - prior * s["pos_neg"] / s["n_pos"]
        positive = prior * (s["pos_neg"] - s["z"]) / s["n_pos"]
        return positive + max(0.0, negative) + 0.5 * float((penalty * w * w).sum()), negative

    at = _sums(table, w, (mean, inverse))
    best, _ = risk(at, w)
    for _ in range(steps):
        gradient = at["g"] / at["n"] - prior * at["pos"] / at["n_pos"] + penalty * w
        move = np.linalg.solve(at["h"] / at["n"] + np.diag(penalty + 1e-6), gradient)
        length, done = 1.0, True
        while length > 0.05:
            tried = w - length * move
            s = _sums(table, tried, (mean, inverse))
            r, negative = risk(s, tried)
            if negative >= 0 and r < best - 1e-6:
                w, at, best, done = tried, s, r, best - r < 1e-5
                break
            length /= 4
        if done:
            break
    return {"w": w, "mean": mean, "inverse": inverse, "bias": 0.0}


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def feature_table(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table, one row a document: row_id, features, positive.

    labels: doc_id, quality; a row is a trusted positive if it is not held out and all its labels are 1.
    Null ids and null labels teach nothing.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("q")).filter("label_id is not null and q is not null").filter(~held_out("label_id"))
    trusted = known.groupBy("label_id").agg(F.min("q").alias("q")).filter("q = 1").select("label_id", F.lit(True).alias("positive"))
    rows = with_features(docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("row_text")), "row_text", ["row_id"])
    return materialise(rows.join(trusted, F.col("row_id") == F.col("label_id"), "left").select("row_id", "features", F.coalesce("positive", F.lit(False)).alias("positive")), "features")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", prior: float | None = None) -> dict:
    """A model from all texts and the trusted positives among the labels."""
    table = feature_table(docs, labels, id_col, text_col)
    model = train_on(table, prior)
    remove(table)
    return model


def train_on(table: DataFrame, prior: float | None = None) -> dict:
    if prior is None:
        taught = F.col("positive") & (F.pmod(F.xxhash64("row_id"), F.lit(2)) == 0)
        first = fit(table.select("features", taught.alias("positive")), FIRST_PRIOR, FIRST_STEPS)
        prior = estimate_prior(table.filter(~taught).select("features", "positive"), first)
    prior = min(MOST_PRIOR, max(LEAST_PRIOR, prior))
    return fit(table.select("features", "positive"), prior) | {"prior": prior}


def linear(x: np.ndarray, model: dict) -> np.ndarray:
    return (x.astype(float) - model["mean"]) * model["inverse"] @ model["w"] + model["bias"]


def estimate_prior(table: DataFrame, model: dict) -> float:
    """Least ratio of the share of all rows to the share of positives at or above a score.

    Of each ratio the upper end of its standard error counts, since the least of noisy ratios would be too low,
    and only scores that at least LEAST_MASS of the positives, and LEAST_POSITIVES, reach. Without positives the
    prior is FIRST_PRIOR.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = linear(batch.column("features").flatten().to_numpy().reshape(-1, N_FEATURES), model)
            yield pa.RecordBatch.from_arrays([pa.array(np.round(np.clip(z, -20, 20) * BINS).astype(np.int32)), batch.column("positive")], names=["bin", "positive"])

    bins = table.mapInArrow(scan, "bin int, positive boolean").groupBy("bin").agg(F.count("*").alias("n"), F.count_if("positive").alias("good")).orderBy(F.desc("bin")).collect()  # at most 40 * BINS + 1 rows
    every, good = np.cumsum([r["n"] for r in bins]), np.cumsum([r["good"] for r in bins])
    if not len(bins) or not good[-1]:
        return FIRST_PRIOR
    enough = good >= min(good[-1], max(LEAST_MASS * good[-1], LEAST_POSITIVES))
    share = good[enough] / good[-1]
    return float(np.min((every[enough] + 1) / (every[-1] + 2) / share * (1 + np.sqrt((1 - share) / good[enough]))))


def score_of(x: np.ndarray, model: dict) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(linear(x, model), -50, 50)))


def scored(docs: DataFrame, model: dict, names: list[str], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The named columns and the score of each row's whole text."""
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(text_col), F.lit("")).alias("quality_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + f", `{score_col}` double"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([*batch.columns[:-1], batch.columns[-1]], names=[f"c{k}" for k in range(batch.num_columns - 1)] + ["quality_text"])
            for part, words in slices(texts, "quality_text"):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score_of(features(words), model))], names=[*names, score_col])

    return rows.mapInArrow(scan, schema)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (score >= cut).

    Rows stand alone: equal texts have equal scores, null text that of the empty text, a null id is never
    held out. Labels enter through training only. An empty table gives no rows. Other columns are not read;
    very long texts count whole.
    """
    table = feature_table(docs, labels, id_col, text_col)
    model = train_on(table)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy().reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(score_of(x, model))], names=["doc_id", "score"])

    out = table.select("row_id", "features").mapInArrow(scan, "doc_id long, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Query: all documents scored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
