"""Point forecasts as column expressions over an array of past values, so that any number of series and folds fit and
predict in one projection, without Python.

Each builder takes (h, horizon, season) with h an array<double> in time order and gives array<double> of the horizon, or
null where the history is too short.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BASELINES = ("last_value", "seasonal_naive")
# Smoothing weights that are tried: fixed values.
THETA_ALPHAS = (0.1, 0.3, 0.5, 0.7, 0.9)
ETS_GRID = {"alpha": (0.2, 0.5, 0.8), "beta": (0.05, 0.2), "gamma": (0.05, 0.3)}


def _steps(horizon: int, f: Callable[[Column], Column]) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(horizon)), f)


def _at(h: Column, i: Column) -> Column:
    return F.get(h, i.cast("int"))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _total(h: Column) -> Column:
    return F.aggregate(h, F.lit(0.0), lambda a, v: a + v)


def _line(h: Column) -> Column:
    """struct<a, b>: intercept and slope of the least-squares line on 0, 1, ...

    n (n^2 - 1) / 12 is the spread of the positions.
    """
    n = F.size(h).cast("double")
    xy = F.aggregate(F.transform(h, lambda v, i: v * i), F.lit(0.0), lambda a, v: a + v)
    mean = _total(h) / n
    middle = (n - 1) / 2
    slope = (xy - n * middle * mean) / F.nullif(n * (n * n - 1) / 12, F.lit(0.0))
    return _let(F.struct(mean.alias("mean"), slope.alias("b")), lambda x: F.struct((x["mean"] - x["b"] * middle).alias("a"), x["b"].alias("b")))


def last_value(h: Column, horizon: int, season: int) -> Column:
    return F.when(F.size(h) >= 1, _steps(horizon, lambda k: _at(h, F.size(h) - 1)))


def seasonal_naive(h: Column, horizon: int, season: int) -> Column:
    return F.when(F.size(h) >= season, _steps(horizon, lambda k: _at(h, F.size(h) - season + (k - 1) % season)))


def drift(h: Column, horizon: int, season: int) -> Column:
    last = _at(h, F.size(h) - 1)
    return F.when(F.size(h) >= 2, _steps(horizon, lambda k: last + (last - _at(h, F.lit(0))) / (F.size(h) - 1) * k))


def linear_trend(h: Column, horizon: int, season: int) -> Column:
    return F.when(F.size(h) >= 2, _let(_line(h), lambda x: _steps(horizon, lambda k: x["a"] + x["b"] * (F.size(h) - 1 + k))))


def window_average(h: Column, horizon: int, season: int) -> Column:
    n = F.least(F.size(h), F.lit(max(2, season)))
    mean = _total(F.slice(h, F.size(h) - n + 1, n)) / n
    return F.when(F.size(h) >= 1, _let(mean, lambda m: _steps(horizon, lambda k: m)))


def theta(h: Column, horizon: int, season: int) -> Column:
    """Exponential smoothing by the weight of least squared one-step error, and half the slope of the line."""

    def smoothed(i: int, alpha: float) -> Column:
        start = F.struct(F.lit(0.0).alias("sse"), F.lit(i).alias("i"), _at(h, F.lit(0)).alias("level"))

        def step(s: Column, v: Column) -> Column:
            e = v - s["level"]
            return F.struct((s["sse"] + e * e).alias("sse"), s["i"].alias("i"), (F.lit(alpha) * v + F.lit(1 - alpha) * s["level"]).alias("level"))

        return F.aggregate(F.slice(h, F.lit(2), F.size(h)), start, step)

    # Ties of the error go to the first weight.
    best = F.array_min(F.array(*[smoothed(i, a) for i, a in enumerate(THETA_ALPHAS)]))
    both = F.struct(best["level"].alias("level"), _line(h)["b"].alias("b"))
    return F.when(F.size(h) >= 2, _let(both, lambda x: _steps(horizon, lambda k: x["level"] + x["b"] / 2 * k)))


def ets(h: Column, horizon: int, season: int) -> Column:
    """Additive Holt-Winters by the least squared one-step error over a grid; without season where history is short."""

    def run(number: int, alpha: float, beta: float, gamma: float, seasonal: bool) -> Column:
        if seasonal:
            first = _total(F.slice(h, F.lit(1), F.lit(season))) / season
            second = _total(F.slice(h, F.lit(season + 1), F.lit(season))) / season
            phases, trend, begin = F.transform(F.slice(h, F.lit(1), F.lit(season)), lambda v: v - first), (second - first) / season, season
        else:
            first, trend, begin, phases = _at(h, F.lit(0)), _at(h, F.lit(1)) - _at(h, F.lit(0)), 2, F.array(F.lit(0.0))
        start = F.struct(F.lit(0.0).alias("sse"), F.lit(number).alias("number"), first.alias("level"), trend.alias("trend"), phases.alias("phases"), F.lit(begin).alias("i"))

        def step(s: Column, v: Column) -> Column:
            at = s["i"] % F.size(s["phases"])
            phase = _at(s["phases"], at)
            level = F.lit(alpha) * (v - phase) + F.lit(1 - alpha) * (s["level"] + s["trend"])

            def with_level(x: Column) -> Column:
                slope = F.lit(beta) * (x - s["level"]) + F.lit(1 - beta) * s["trend"]
                e = v - (s["level"] + s["trend"] + phase)
                kept = F.transform(s["phases"], lambda p, j: F.when(j == at, F.lit(gamma) * (v - x) + F.lit(1 - gamma) * p).otherwise(p)) if seasonal else s["phases"]
                return F.struct((s["sse"] + e * e).alias("sse"), s["number"].alias("number"), x.alias("level"), slope.alias("trend"), kept.alias("phases"), (s["i"] + 1).alias("i"))

            return _let(level, with_level)

        return F.aggregate(F.slice(h, F.lit(begin + 1), F.greatest(F.size(h) - begin, F.lit(0))), start, step)

    def best(seasonal: bool) -> Column:
        grid = [(a, b, g) for a in ETS_GRID["alpha"] for b in ETS_GRID["beta"] for g in (ETS_GRID["gamma"] if seasonal else (0.0,))]
        chosen = F.array_min(F.array(*[run(i, *g, seasonal) for i, g in enumerate(grid)]))
        return _let(chosen, lambda m: _steps(horizon, lambda k: m["level"] + m["trend"] * k + _at(m["phases"], (F.size(h) + k - 1) % F.size(m["phases"]))))

    plain = F.when(F.size(h) >= 4, best(False))
    return F.when(F.size(h) >= 2 * season + 4, best(True)).otherwise(plain) if season > 1 else plain


MODELS: dict[str, Callable[[Column, int, int], Column]] = {
    "last_value": last_value,
    "seasonal_naive": seasonal_naive,
    "drift": drift,
    "linear_trend": linear_trend,
    "window_average": window_average,
    "theta": theta,
    "ets": ets,
}
