"""Theta and Holt-Winters for many folds at once: each step of the recursion is one NumPy operation over all of them.

The results are those of the column expressions in `models`; these run where folds are many, as in backtests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .models import ETS_GRID, THETA_ALPHAS


def theta(h: np.ndarray, horizon: int, season: int) -> np.ndarray | None:
    """Of folds x values: folds x horizon; null for fewer than two values."""
    m, n = h.shape
    if n < 2:
        return None
    best, level = np.full(m, np.inf), h[:, 0].copy()
    for alpha in THETA_ALPHAS:
        at, sse = h[:, 0].copy(), np.zeros(m)
        for t in range(1, n):
            e = h[:, t] - at
            sse += e * e
            at = alpha * h[:, t] + (1 - alpha) * at
        better = sse < best
        best, level = np.where(better, sse, best), np.where(better, at, level)
    i = np.arange(n) - (n - 1) / 2
    slope = (h @ i) / (n * (n * n - 1) / 12)
    return level[:, None] + slope[:, None] / 2 * np.arange(1, horizon + 1)


def ets(h: np.ndarray, horizon: int, season: int) -> np.ndarray | None:
    m, n = h.shape
    if n < 4:
        return None
    seasonal = season > 1 and n >= 2 * season + 4
    width = season if seasonal else 1
    grid = [(a, b, g) for a in ETS_GRID["alpha"] for b in ETS_GRID["beta"] for g in (ETS_GRID["gamma"] if seasonal else (0.0,))]
    # Every fold under every choice of weights, side by side.
    a, b, g = (np.repeat(np.array(x), m) for x in zip(*grid, strict=True))
    x = np.tile(h, (len(grid), 1))
    if seasonal:
        level = x[:, :season].mean(axis=1)
        trend, phases, begin = (x[:, season : 2 * season].mean(axis=1) - level) / season, x[:, :season] - level[:, None], season
    else:
        level, trend, phases, begin = x[:, 0].copy(), x[:, 1] - x[:, 0], np.zeros((len(x), 1)), 2
    sse = np.zeros(len(x))
    for t in range(begin, n):
        v, phase = x[:, t], phases[:, t % width]
        e = v - (level + trend + phase)
        sse += e * e
        to = a * (v - phase) + (1 - a) * (level + trend)
        trend = b * (to - level) + (1 - b) * trend
        level = to
        if seasonal:
            phases[:, t % width] = g * (v - level) + (1 - g) * phase
    pick = sse.reshape(len(grid), m).argmin(axis=0) * m + np.arange(m)
    k = np.arange(1, horizon + 1)
    return level[pick][:, None] + trend[pick][:, None] * k + phases[pick][:, (n + k - 1) % width]


RECURSIVE: dict[str, Callable[[np.ndarray, int, int], np.ndarray | None]] = {"theta": theta, "ets": ets}


def with_predictions(folds: DataFrame, names: list[str], horizon: int, season: int, batch: int = 256) -> DataFrame:
    """folds with `p_<name>` for each name, from their array `past`; folds of equal length run together."""
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in folds.schema] + [f"p_{n} array<double>" for n in names])

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.reset_index(drop=True)
            out: dict[str, list] = {n: [None] * len(frame) for n in names}
            for _, group in frame.groupby(frame["past"].map(len)):
                for at in range(0, len(group), batch):
                    rows = group.index[at : at + batch]
                    h = np.array([frame["past"][i] for i in rows], dtype=float).reshape(len(rows), -1)
                    for n in names:
                        p = RECURSIVE[n](h, horizon, season)
                        for j, i in enumerate(rows):
                            out[n][i] = None if p is None else p[j]
            yield frame.assign(**{f"p_{n}": pd.Series(out[n], dtype=object) for n in names})

    return folds.mapInPandas(predict, schema)
