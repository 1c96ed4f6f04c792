"""Models of others: what an adapter must keep to, how it is checked, and how it runs over many series."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Adapter:
    """A named forecaster: predict(history, horizon, season) -> horizon finite numbers.

    It must not change its input, and must answer the same twice.
    """

    name: str
    predict: Callable[[list[float], int, int], list[float]]
    min_history: int = 1
    max_horizon: int | None = None
    revision: str | None = None


REGISTRY: dict[str, Adapter] = {}


def register(adapter: Adapter) -> None:
    if adapter.name in REGISTRY:
        raise ValueError(f"ADAPTER_EXISTS: {adapter.name}")
    REGISTRY[adapter.name] = adapter


def eligible(history: int, horizon: int) -> dict[str, str | None]:
    """Of each registered adapter why it may not run, or null."""
    return {a.name: "too little history" if history < a.min_history else "horizon too long" if a.max_horizon and horizon > a.max_horizon else None for a in REGISTRY.values()}


def checked(adapter: Adapter, history: list[float], horizon: int, season: int) -> list[float]:
    """The adapter's path, refused unless it is exactly `horizon` finite numbers."""
    out = [float(x) for x in adapter.predict(list(history), horizon, season)]
    if len(out) != horizon or not all(map(math.isfinite, out)):
        raise ValueError(f"INVALID_OUTPUT: {adapter.name} gave {len(out)} of {horizon} finite values")
    return out


def conformance(adapter: Adapter, horizon: int = 4, season: int = 2) -> dict[str, bool]:
    """What the adapter keeps of its contract, on a short series."""
    history = [float(1 + i % 2) for i in range(max(12, adapter.min_history))]
    given = list(history)

    def ok(f: Callable[[], bool]) -> bool:
        try:
            return bool(f())
        except Exception:  # whatever an adapter raises is a failure of the check
            return False

    return {
        "finite_exact_horizon": ok(lambda: len(checked(adapter, history, horizon, season)) == horizon),
        "deterministic_replay": ok(lambda: checked(adapter, history, horizon, season) == checked(adapter, history, horizon, season)),
        "input_immutable": ok(lambda: adapter.predict(given, horizon, season) is not None and given == history),
        "variable_horizon": ok(lambda: len(checked(adapter, history, 1, season)) == 1),
    }


def predictions(folds: DataFrame, adapter: Adapter, horizon: int, season: int) -> DataFrame:
    """Folds (series, origin, role, past, actual) with the adapter's predictions, in the rows of a backtest.

    Folds that are too short for it, or on which it fails, have null predictions, so that it cannot be selected.
    """

    def run(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                try:
                    path = checked(adapter, list(row.past), horizon, season) if len(row.past) >= adapter.min_history else None
                except Exception:  # one fold's failure leaves its predictions empty
                    path = None
                out += [(row.series, row.origin, row.role, adapter.name, k + 1, float(a), path[k] if path else None) for k, a in enumerate(row.actual)]
            yield pd.DataFrame(out, columns=["series", "origin", "role", "model", "lead", "actual", "predicted"])

    return folds.mapInPandas(run, "series string, origin long, role string, model string, lead long, actual double, predicted double")
