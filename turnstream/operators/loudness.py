"""Integrated loudness: K weighting and gated blocks, by the public recommendation ITU-R BS.1770."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

# fixed values: the two filters by frequency, quality and gain in decibels, from which any rate's coefficients follow
SHELF, PASS = (1681.974450955533, 0.7071752369554196, 3.999843853973347), (38.13547087602444, 0.5003270373238773)
OFFSET, GATE, RELATIVE = -0.691, -70.0, -10.0
_BLOCK = 64


def weighting(rate: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(b, a) of the high shelf and of the high pass at a rate."""
    f, q, gain = SHELF
    k, high = np.tan(np.pi * f / rate), 10 ** (gain / 20)
    band = high**0.4996667741545416
    a0 = 1 + k / q + k * k
    shelf = np.array([high + band * k / q + k * k, 2 * (k * k - high), high - band * k / q + k * k]) / a0, np.array([1, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0])
    f, q = PASS
    k = np.tan(np.pi * f / rate)
    a0 = 1 + k / q + k * k
    return [shelf, (np.array([1.0, -2.0, 1.0]), np.array([1, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0]))]


def recursive(x: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """y[n] = b0 x[n] + b1 x[n-1] + b2 x[n-2] - a1 y[n-1] - a2 y[n-2], from silence.

    A block at a time: its own answer is one product, and the two values before it add their share.
    """
    if not len(x):
        return np.zeros(0)
    v = np.convolve(x, b)[: len(x)]
    answer = np.zeros(_BLOCK)
    for n in range(_BLOCK):
        answer[n] = (n == 0) - (a[1] * answer[n - 1] if n else 0) - (a[2] * answer[n - 2] if n > 1 else 0)
    own = np.array([[answer[i - j] if i >= j else 0 for j in range(_BLOCK)] for i in range(_BLOCK)])
    before = -a[1] * answer - a[2] * np.append(0, answer[:-1]), -a[2] * answer
    blocks = np.pad(v, (0, -len(v) % _BLOCK)).reshape(-1, _BLOCK) @ own.T
    one = two = 0.0
    for row in blocks:
        row += before[0] * one + before[1] * two
        one, two = row[-1], row[-2]
    return blocks.ravel()[: len(x)]


def integrated(x: np.ndarray, rate: int, seconds: float | None = 0.4, overlap: float = 0.75) -> float:
    """Loudness of one channel in LUFS: of blocks over -70, then over ten below their mean. No block: -inf.

    ``seconds`` None takes the whole signal as one block. Signals shorter than a block are one block.
    """
    for b, a in weighting(rate):
        x = recursive(np.asarray(x, dtype=np.float64), b, a)
    size = len(x) if seconds is None else min(len(x), round(seconds * rate))
    if not size:
        return -np.inf
    step = max(1, round(size * (1 - overlap)))
    sums = np.concatenate([[0], np.cumsum(x * x)])
    at = np.arange(0, len(x) - size + 1, step)
    power = (sums[at + size] - sums[at]) / size
    with np.errstate(divide="ignore"):
        level = lambda p: OFFSET + 10 * np.log10(p)
        power = power[level(power) > GATE]
        if len(power):
            power = power[level(power) > level(power.mean()) + RELATIVE]
        return float(level(power.mean())) if len(power) else -np.inf


def loudness_share(samples: Column, rate: int, low: float = -20.0, high: float = 80.0, seconds: float | None = None) -> Column:
    """Weighted loudness of peak-normalised samples, from 0 at ``low`` to 1 at ``high``. Silence and no samples give 0."""

    @pandas_udf("double")
    def share(values: pd.Series) -> pd.Series:
        def one(x) -> float | None:
            if x is None:
                return None
            x = np.asarray(x, dtype=np.float64)
            top = np.abs(x).max() if len(x) else 0
            return float(np.clip((integrated(x / top, rate, seconds) - low) / (high - low), 0, 1)) if top else 0.0

        return values.map(one)

    return share(samples)
