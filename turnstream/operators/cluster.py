"""Online clustering of embeddings, in order, by key."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstream.config import checked

from .folds import Fold, fold

EPS = 1e-8
MOST_IN_RECORDING = 20_000  # chunks of one offline clustering: days of audio at the usual chunk length


def _cosine(centers: np.ndarray, x: np.ndarray) -> np.ndarray:
    norms = np.maximum(np.sqrt((centers * centers).sum(1)), EPS) * max(float(np.sqrt((x * x).sum())), EPS)
    return 1.0 - (centers @ x) / norms


def _euclidean(centers: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(((centers - x) ** 2).sum(1))


class OnlineMeans(Fold):
    """Means with at most ``most`` clusters.

    Within the threshold of the nearest center: the center moves. Else a new cluster while there is room;
    when there is none, the farthest center (Euclidean) gives up the value's share or, if it stands for one
    value, is replaced by the value. With ``relabel`` such a center is dropped instead, and the label is that of
    the nearest center after the change.
    """

    def __init__(self, threshold: float, most: int, metric: str = "cosine", relabel: bool = False):
        self.threshold, self.most, self.relabel = threshold, most, relabel
        self.distance = _cosine if metric == "cosine" else _euclidean
        self.centers: list[np.ndarray] = []
        self.sizes: list[int] = []

    def label(self, x: np.ndarray) -> int:
        if not self.centers:
            return self._new(x)
        k = self._change(x)
        return int(np.argmin(self.distance(np.stack(self.centers), x))) if self.relabel else k

    def _new(self, x: np.ndarray) -> int:
        self.centers.append(x)
        self.sizes.append(1)
        return len(self.centers) - 1

    def _give(self, k: int, x: np.ndarray, sign: int) -> int:
        n = self.sizes[k]
        self.centers[k], self.sizes[k] = (self.centers[k] * n + sign * x) / (n + sign), n + sign
        return k

    def _change(self, x: np.ndarray) -> int:
        d = self.distance(np.stack(self.centers), x)
        k = int(np.argmin(d))
        if d[k] <= self.threshold:
            return self._give(k, x, 1)
        return self._missed(x)

    def _missed(self, x: np.ndarray) -> int:
        if len(self.centers) < self.most:
            return self._new(x)
        k = int(np.argmax(_euclidean(np.stack(self.centers), x)))
        if self.sizes[k] > 1:
            return self._give(k, x, -1)
        if self.relabel and len(self.centers) > 1:
            del self.centers[k], self.sizes[k]
        else:
            self.centers[k] = x
        return k

    def take(self, columns: dict[str, np.ndarray]) -> list[tuple]:
        return [(i, self.label(np.asarray(x, dtype=np.float64))) for i, x in zip(columns["chunk_idx"].tolist(), columns["v"], strict=True)]


class UnboundedMeans(OnlineMeans):
    """Any number of clusters; a value that is near none takes its share from the smallest cluster, or
    starts one of its own if that stands for one value."""

    def __init__(self, threshold: float):
        super().__init__(threshold, 1 << 30, "euclidean", relabel=True)

    def _missed(self, x: np.ndarray) -> int:
        k = int(np.argmin(self.sizes))
        return self._give(k, x, -1) if self.sizes[k] > 1 else self._new(x)


class SimilarSpeakers(OnlineMeans):
    """Similarity (cosine + 1) / 2; the best center at or over the threshold becomes the mean with the value."""

    def __init__(self, threshold: float):
        super().__init__(threshold, 1 << 30)

    def label(self, x: np.ndarray) -> int:
        if self.centers:
            s = 1.0 - _cosine(np.stack(self.centers), x) / 2
            k = int(np.argmax(s))
            if s[k] >= self.threshold:
                self.centers[k] = (x + self.centers[k]) / 2
                return k
        self.centers.append(x)
        return len(self.centers) - 1


def online_labels(embeddings: DataFrame, keys: list[str], make) -> DataFrame:
    """embeddings: keys, chunk_idx, v. Adds nothing to order: labels follow chunk_idx and are never revised."""
    return fold(embeddings, keys, ["chunk_idx"], ["v"], make, "chunk_idx long, speaker int")


def _linkage(x: np.ndarray) -> list[tuple[int, int, float]]:
    """Centroid linkage: (node, node, distance) of each merge; merge k makes node len(x) + k.

    Each node knows its nearest later node. A merge makes one center, which is measured against all; only nodes whose
    nearest one is gone look for another. So what is held grows with the points, not with their pairs. Of equally near
    pairs the first goes first.
    """
    n = len(x)
    centers, sizes = np.zeros((2 * n - 1, x.shape[1])), np.ones(2 * n - 1)
    centers[:n] = x
    alive = np.zeros(2 * n - 1, dtype=bool)
    alive[:n] = True
    nearest, distance = np.full(2 * n - 1, -1), np.full(2 * n - 1, np.inf)

    def look(i: int, last: int) -> None:
        later = i + 1 + np.flatnonzero(alive[i + 1 : last])
        if len(later):
            d = _euclidean(centers[later], centers[i])
            k = int(np.argmin(d))
            nearest[i], distance[i] = later[k], d[k]
        else:
            nearest[i], distance[i] = -1, np.inf

    for i in range(n - 1):
        look(i, n)
    merges = []
    for new in range(n, 2 * n - 1):
        a = int(np.argmin(distance[:new]))
        b = int(nearest[a])
        merges.append((a, b, float(distance[a])))
        sizes[new] = sizes[a] + sizes[b]
        centers[new] = (centers[a] * sizes[a] + centers[b] * sizes[b]) / sizes[new]
        alive[[a, b]], distance[[a, b]] = False, np.inf
        rest = np.flatnonzero(alive[:new])
        alive[new] = True
        if len(rest):
            d = _euclidean(centers[rest], centers[new])
            lost = np.isin(nearest[rest], (a, b))
            nearer = ~lost & (d < distance[rest])
            nearest[rest[nearer]], distance[rest[nearer]] = new, d[nearer]
            for i in rest[lost].tolist():
                look(i, new + 1)
    return merges


def agglomerate(x: np.ndarray, threshold: float, least: int, most: int) -> list[int]:
    """Flat clusters of unit vectors cut at the threshold, which is moved so that there are least..most.

    Labels count clusters in order of their first member.
    """
    n = len(x)
    x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), EPS)
    merges = _linkage(x)
    at = lambda k: merges[-k][2] if k < n else -np.inf
    cut = at(least) if least == most else min(max(threshold, at(most)), at(least))
    top = np.full(2 * n - 1, -np.inf)  # the highest merge within a node
    for k, (a, b, d) in enumerate(merges):
        top[n + k] = max(d, top[a], top[b])
    up = np.arange(2 * n - 1)
    for k in range(n - 2, -1, -1):  # from the last merge on: a node that is low enough gives its name to its parts
        if top[n + k] <= cut:
            up[[merges[k][0], merges[k][1]]] = up[n + k]
    up = up[:n].tolist()
    names: dict[int, int] = {}
    return [names.setdefault(u, len(names)) for u in up]


def agglomerative_labels(embeddings: DataFrame, key: str, threshold: float = 0.25, least: int = 1, most: int = 20) -> DataFrame:
    """key, chunk_idx, speaker: offline clustering of one recording, whose embeddings are one group.

    Centroid linkage measures all pairs, so the query fails if a recording has more than MOST_IN_RECORDING chunks,
    before any is gathered; online labels have no such bound.
    """
    import pandas as pd

    size = embeddings.groupBy(key).agg(F.count("*").alias("chunks_of_key"))
    embeddings = checked(embeddings.join(size, key), F.col("chunks_of_key") <= MOST_IN_RECORDING, f"a recording has more than {MOST_IN_RECORDING} chunks")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk_idx")
        x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["v"]])
        labels = agglomerate(x, threshold, least, most) if len(x) > 1 else [0]
        return pd.DataFrame({key: pdf[key], "chunk_idx": pdf["chunk_idx"], "speaker": labels})

    return embeddings.select(key, "chunk_idx", "v").groupBy(key).applyInPandas(one, f"{key} long, chunk_idx long, speaker int")


# --- hidden Markov models


MOST_IN_MODEL = 4000  # chunks of one model: every step of every size of the search reads them all in order
LEAST_VARIANCE, ITERATIONS, TOLERANCE = 1e-2, 100, 1e-2
_FLOOR = 1e-3


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis=axis)


def k_means(x: np.ndarray, k: int, rounds: int = 50) -> np.ndarray:
    """Centers: the first point is the one nearest the mean, each further one is the farthest from those before, then means move."""
    centers = x[[int(np.argmin(_euclidean(x, x.mean(axis=0))))]]
    while len(centers) < k:
        far = np.min([_euclidean(x, c) for c in centers], axis=0)
        centers = np.vstack([centers, x[int(np.argmax(far))]])
    label = None
    for _ in range(rounds):
        new = np.argmin([_euclidean(x, c) for c in centers], axis=0)
        if label is not None and np.array_equal(new, label):
            break
        label = new
        centers = np.stack([x[label == j].mean(axis=0) if (label == j).any() else centers[j] for j in range(k)])
    return centers


class GaussianStates:
    """A hidden Markov model whose states are Gaussians with diagonal covariance.

    ``fit`` is Baum-Welch in logarithms. Variances have a prior of the weight of LEAST_VARIANCE, so none falls to nothing;
    each step raises ``objective``: the log-likelihood less LEAST_VARIANCE / 2 over each variance. It ends when a step
    raises the log-likelihood by less than TOLERANCE, or after ITERATIONS steps.
    """

    def __init__(self, x: np.ndarray, k: int):
        self.means = k_means(x, k)
        spread = x.var(axis=0, ddof=1) if len(x) > 1 else np.zeros(x.shape[1])
        self.variances = np.tile(spread + _FLOOR, (k, 1))
        self.start, self.moves = np.full(k, -np.log(k)), np.full((k, k), -np.log(k))
        self.history: list[float] = []

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Log densities of each point (row) in each state."""
        out = np.empty((len(x), len(self.means)))
        for j, (m, v) in enumerate(zip(self.means, self.variances, strict=True)):
            out[:, j] = -0.5 * (np.log(2 * np.pi * v).sum() + ((x - m) ** 2 / v).sum(axis=1))
        return out

    def forward(self, e: np.ndarray) -> np.ndarray:
        out = np.empty_like(e)
        out[0] = self.start + e[0]
        for t in range(1, len(e)):
            out[t] = _log_sum(out[t - 1][:, None] + self.moves, 0) + e[t]
        return out

    def backward(self, e: np.ndarray) -> np.ndarray:
        out = np.zeros_like(e)
        for t in range(len(e) - 2, -1, -1):
            out[t] = _log_sum(self.moves + e[t + 1] + out[t + 1], 1)
        return out

    def objective(self, likelihood: float) -> float:
        return likelihood - float((LEAST_VARIANCE / 2 / self.variances).sum())

    def fit(self, x: np.ndarray) -> GaussianStates:
        last = -np.inf
        for _ in range(ITERATIONS):
            e = self.emissions(x)
            a, b = self.forward(e), self.backward(e)
            likelihood = float(_log_sum(a[-1], 0))
            self.history.append(self.objective(likelihood))
            if likelihood - last < TOLERANCE:
                break
            last = likelihood
            own = np.exp(a + b - likelihood)
            with np.errstate(divide="ignore"):
                self.start = np.log(own[0] / own[0].sum())
                if len(x) > 1:
                    pairs = _log_sum(a[:-1, :, None] + self.moves + (e[1:] + b[1:])[:, None, :], 0) - likelihood
                    total = _log_sum(pairs, 1)
                    reached = np.isfinite(total)
                    self.moves[reached] = pairs[reached] - total[reached, None]
            weight = own.sum(axis=0)
            held = weight > 1e-300
            self.means[held] = (own.T @ x)[held] / weight[held, None]
            for j in np.flatnonzero(held):
                self.variances[j] = (LEAST_VARIANCE + own[:, j] @ (x - self.means[j]) ** 2) / weight[j]
        return self

    def path(self, x: np.ndarray) -> np.ndarray:
        """The likeliest states."""
        e = self.emissions(x)
        at, back = self.start + e[0], np.zeros(e.shape, dtype=np.int64)
        for t in range(1, len(e)):
            step = at[:, None] + self.moves
            back[t] = step.argmax(axis=0)
            at = step.max(axis=0) + e[t]
        out = np.empty(len(e), dtype=np.int64)
        out[-1] = int(at.argmax())
        for t in range(len(e) - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out


def _pair_distances(x: np.ndarray, cosine: bool) -> np.ndarray:
    return np.concatenate([(_cosine if cosine else _euclidean)(x[i + 1 :], x[i]) for i in range(len(x) - 1)] or [np.zeros(0)])


def markov_labels(x: np.ndarray, least: int, most: int, threshold: float = 0.25, metric: str = "cosine", share: float = 0.05, single: float = 1.15) -> np.ndarray:
    """States of a model whose number of states is searched for between ``least`` and ``most``.

    One state if the distances of all but ``share`` of the pairs are under ``single``. Else a size is better than those
    before if its centers' smallest distance is the largest so far, or over the threshold; the search ends after three sizes
    (fewer if there are fewer) that are no better. A state without points makes its size no better.
    """
    if not 0 < least <= most:
        raise ValueError("least must be at least 1 and at most most")
    if metric not in ("cosine", "euclidean"):
        raise ValueError("metric must be cosine or euclidean")
    points = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), EPS) if metric == "cosine" else x
    most = min(most, len(x))
    least = min(least, most)
    if least == most:
        return GaussianStates(points, most).fit(points).path(points)
    if least == 1:
        if np.quantile(_pair_distances(points, False), 1 - share) < single:
            return np.zeros(len(x), dtype=np.int64)
        least, most = 2, max(2, most)
    best, labels, history, patience = least, None, [-np.inf], min(3, most - least)
    for k in range(least, most + 1):
        found = GaussianStates(points, k).fit(points).path(points)
        full = len(np.unique(found)) == k
        apart = float(_pair_distances(np.stack([x[found == j].mean(axis=0) for j in range(k)]), metric == "cosine").min()) if full else -np.inf
        if labels is None or apart > max(history) or apart > threshold:
            best, labels = k, found
        elif k == best + patience:
            break
        history.append(apart)
    return labels


def markov_speakers(embeddings: DataFrame, key: str, least: int = 1, most: int = 8, threshold: float = 0.25) -> DataFrame:
    """key, chunk_idx, speaker: a recording's chunks in order as states of a hidden Markov model. A recording is one group;
    the query fails before any is gathered if one has more than MOST_IN_MODEL chunks."""
    import pandas as pd

    size = embeddings.groupBy(key).agg(F.count("*").alias("chunks_of_key"))
    embeddings = checked(embeddings.join(size, key), F.col("chunks_of_key") <= MOST_IN_MODEL, f"a recording has more than {MOST_IN_MODEL} chunks")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk_idx")
        x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["v"]])
        return pd.DataFrame({key: pdf[key], "chunk_idx": pdf["chunk_idx"], "speaker": markov_labels(x, least, most, threshold)})

    return embeddings.select(key, "chunk_idx", "v").groupBy(key).applyInPandas(one, f"{key} long, chunk_idx long, speaker long")


def top_k(scores: Column, k: int) -> Column:
    """Places of the k highest scores, highest first, of equal ones the first."""
    ranked = F.array_sort(F.transform(scores, lambda x, i: F.struct((-x).alias("back"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda r: r["i"])


def top_over(scores: Column, threshold: float) -> Column:
    """The place of the highest score of at least ``threshold``; null if there is none."""
    best = F.get(top_k(scores, 1), F.lit(0))
    return F.when(F.get(scores, best) >= threshold, best)
