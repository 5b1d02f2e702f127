"""Mel features of sample arrays."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rate, bins, points of a transform, samples between frames and in one, and the weight of the sample before.
RATE, BINS, POINTS, HOP, FRAME, BEFORE = 16_000, 80, 512, 160, 400, 0.97
#: What a power is raised by before its logarithm.
FLOOR = 2.0**-24


def _mel(hz: np.ndarray | float) -> np.ndarray:
    return 2595.0 * np.log10(1.0 + np.asarray(hz) / 700.0)


@cache
def filters(rate: int = RATE, bins: int = BINS, points: int = POINTS) -> np.ndarray:
    """Triangles over the frequencies of a transform, [bins, points // 2 + 1], evenly spread by mel from 0 to half the rate."""
    edges = 700.0 * (10.0 ** (np.linspace(_mel(0.0), _mel(rate / 2), bins + 2) / 2595.0) - 1.0)
    hz = np.linspace(0.0, rate / 2, points // 2 + 1)
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0.0, np.minimum((hz - low) / (mid - low), (high - hz) / (high - mid)))


def features_of(samples: np.ndarray) -> np.ndarray:
    """Log mel powers, [frames, BINS]: as many frames as hops fit in with the last frame whole; none of fewer samples."""
    x = np.asarray(samples, np.float64)
    if len(x) < FRAME:
        return np.zeros((0, BINS))
    x = np.concatenate([x[:1], x[1:] - BEFORE * x[:-1]])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] * np.hanning(FRAME)
    power = np.abs(np.fft.rfft(frames, POINTS)) ** 2
    return np.log(power @ filters().T + FLOOR)


def features(samples: Column) -> Column:
    """`features_of` as a column of arrays of arrays; null for null."""

    @F.pandas_udf("array<array<float>>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: [row.astype(np.float32) for row in features_of(v)], na_action="ignore")

    return run(samples)
