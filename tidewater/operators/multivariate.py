"""Models that read more than one series: vector autoregression, regression on covariates, and stacking.

Each panel, series or set of folds is solved in one grouped call, in NumPy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RIDGE = 1e-6
LEAST_CORRELATION = 0.3


def ridge(x: np.ndarray, y: np.ndarray, alpha: float = RIDGE) -> np.ndarray:
    """Least squares with a small penalty on every coefficient; y may have several columns."""
    return np.linalg.solve(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ y)


def var_paths(columns: np.ndarray, horizon: int) -> np.ndarray:
    """Of times x series: horizon x series, each step from the one before by one linear map."""
    x = np.column_stack([np.ones(len(columns) - 1), columns[:-1]])
    b, state, out = ridge(x, columns[1:]), columns[-1], []
    for _ in range(horizon):
        state = np.append(1.0, state) @ b
        out.append(state)
    return np.array(out).reshape(horizon, columns.shape[1])


def var_forecast(df: DataFrame, horizon: int) -> DataFrame:
    """(panel, series, step, point, problem) of panels (panel, series, ts, value); a panel's series form one model.

    They must have the same times, max(8, series + 3) of them, and two of them a correlation of 0.3 at least; else there is
    one row for each panel, with the problem.
    """

    def of_panel(frame: pd.DataFrame) -> pd.DataFrame:
        wide = frame.pivot_table(index="ts", columns="series", values="value", aggfunc="last").sort_index()
        names, n, problem = list(wide.columns), len(wide), None
        if len(names) < 2:
            problem = "fewer than two series"
        elif wide.isna().any().any():
            problem = "series are not observed at the same times"
        elif n < max(8, len(names) + 3):
            problem = "too few rows"
        else:
            with np.errstate(all="ignore"):
                r = np.nan_to_num(np.corrcoef(wide.to_numpy(dtype=float).T))
            if np.abs(r - np.diag(np.diag(r))).max() < LEAST_CORRELATION:
                problem = "no correlation"
        panel = frame["panel"].iloc[0]
        if problem:
            return pd.DataFrame({"panel": [panel], "series": [None], "step": [None], "point": [np.nan], "problem": [problem]}).astype({"step": "Int64"})
        p = var_paths(wide.to_numpy(dtype=float), horizon)
        rows = [(panel, s, k + 1, float(p[k, j]), None) for j, s in enumerate(names) for k in range(horizon)]
        return pd.DataFrame(rows, columns=["panel", "series", "step", "point", "problem"])

    return df.select("panel", "series", "ts", "value").groupBy("panel").applyInPandas(of_panel, "panel string, series string, step long, point double, problem string")


def covariate_forecast(history: DataFrame, future: DataFrame, names: list[str], season: int = 1) -> DataFrame:
    """(series, step, point): a line in time, the value before, the one a season before and the covariates, step by step.

    history is (series, idx, value, names...), future (series, step, names...). Rows without a covariate are left out of the
    fit; a series with fewer than max(6, coefficients + 1) rows, or a gap in the future, has none.
    """

    def of_series(key: tuple, past: pd.DataFrame, ahead: pd.DataFrame) -> pd.DataFrame:
        past, ahead = past.sort_values("idx"), ahead.sort_values("step")
        v, c = past["value"].to_numpy(dtype=float), past[names].to_numpy(dtype=float)
        n, first = len(v), max(1, season)
        at = np.arange(first, n)
        at = at[~np.isnan(c[at]).any(axis=1)] if n > first else at[:0]
        later = ahead[names].to_numpy(dtype=float)
        none = pd.DataFrame({"series": [], "step": [], "point": []}).astype({"series": str, "step": "int64", "point": float})
        if len(at) < max(6, len(names) + 5) or np.isnan(later).any():
            return none
        x = np.column_stack([np.ones(len(at)), at / n, v[at - 1], v[at - season], c[at]])
        b, seq, out = ridge(x, v[at], 1e-9), v.tolist(), []
        for k, row in enumerate(later):
            seq.append(float(np.concatenate([[1.0, (n + k) / n, seq[-1], seq[-season]], row]) @ b))
            out.append((key[0], int(ahead["step"].iloc[k]), seq[-1]))
        return pd.DataFrame(out, columns=["series", "step", "point"]) if out else none

    left = history.select("series", "idx", "value", *names).groupBy("series")
    return left.cogroup(future.select("series", "step", *names).groupBy("series")).applyInPandas(of_series, "series string, step long, point double")


def regression(df: DataFrame, target: str, predictors: list[str], minimum: int | None = None) -> DataFrame:
    """(series, term, coefficient, low, high, mse, baseline_mse, skill, points) of a ridge regression on predictors.

    The errors are one step ahead on an expanding window, against the mean so far; intervals are of 95 %. Gram matrices are
    summed as the window grows, so the fits cost no more than one pass. Series too short for it have no rows.
    """
    names = sorted(predictors)

    def of_series(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("idx")
        y = frame[target].to_numpy(dtype=float)
        x = np.column_stack([np.ones(len(frame)), frame[names].to_numpy(dtype=float)])
        n, k = x.shape
        first = max(k * 3, minimum or max(20, int(n * 0.6)))
        cols = ["series", "term", "coefficient", "low", "high", "mse", "baseline_mse", "skill", "points"]
        if n <= first + 2:
            return pd.DataFrame(columns=cols).astype({c: float for c in cols[2:8]} | {"points": "int64", "series": str, "term": str})
        gram, xy, e, e0 = x[:first].T @ x[:first], x[:first].T @ y[:first], [], []
        for i in range(first, n):
            b = np.linalg.solve(gram + RIDGE * np.eye(k), xy)
            e.append((y[i] - x[i] @ b) ** 2)
            e0.append((y[i] - y[:i].mean()) ** 2)
            gram, xy = gram + np.outer(x[i], x[i]), xy + x[i] * y[i]
        inverse = np.linalg.inv(gram + RIDGE * np.eye(k))
        b = inverse @ xy
        r = y - x @ b
        se = np.sqrt(np.maximum(0, (r @ r) / max(1, n - k) * np.diag(inverse)))
        mse, base = float(np.mean(e)), float(np.mean(e0))
        return pd.DataFrame({"series": frame["series"].iloc[0], "term": ["intercept", *names], "coefficient": b, "low": b - 1.96 * se, "high": b + 1.96 * se, "mse": mse, "baseline_mse": base, "skill": 1 - mse / max(base, 1e-12), "points": n - first})[cols]

    rows = df.select("series", "idx", target, *names)
    return rows.groupBy("series").applyInPandas(of_series, "series string, term string, coefficient double, low double, high double, mse double, baseline_mse double, skill double, points long")


def non_negative(x: np.ndarray, y: np.ndarray, alpha: float = RIDGE) -> np.ndarray:
    """Least squares with no negative coefficient, by adding one coefficient at a time to those that are free."""
    g, b = x.T @ x + alpha * np.eye(x.shape[1]), x.T @ y
    w, free = np.zeros(len(b)), np.zeros(len(b), dtype=bool)
    for _ in range(3 * len(b) + 10):
        slope = b - g @ w
        slope[free] = -np.inf
        if slope.max(initial=-np.inf) <= 1e-9 * max(1.0, float(np.abs(b).max(initial=0.0))):
            break
        free[int(slope.argmax())] = True
        while True:
            s = np.zeros(len(b))
            s[free] = np.linalg.solve(g[np.ix_(free, free)], b[free])
            if (s[free] > 0).all():
                w = s
                break
            down = free & (s <= 0)
            w = w + (w[down] / (w[down] - s[down])).min() * (s - w)
            free &= w > 1e-12
            w[~free] = 0.0
    return w


def stacking_weights(bt: DataFrame, positive: bool = True) -> DataFrame:
    """(series, model, weight) from the selection and calibration folds of a backtest: the weights that sum to 1 in the end.

    Two models and two folds at least; steps without a prediction of every model are left out.
    """

    def of_series(frame: pd.DataFrame) -> pd.DataFrame:
        wide = frame.pivot_table(index=["origin", "lead"], columns="model", values="predicted").dropna()
        y = frame.groupby(["origin", "lead"])["actual"].first().reindex(wide.index).to_numpy(dtype=float)
        none = pd.DataFrame({"series": [], "model": [], "weight": []}).astype({"series": str, "model": str, "weight": float})
        if wide.shape[1] < 2 or frame["origin"].nunique() < 2 or len(wide) < wide.shape[1]:
            return none
        x = wide.to_numpy(dtype=float)
        w = non_negative(x, y) if positive else ridge(x, y)
        if np.abs(w).max() < 1e-10 or w.sum() <= 0:
            return none
        return pd.DataFrame({"series": frame["series"].iloc[0], "model": wide.columns.tolist(), "weight": w / w.sum()})

    rows = bt.where("role <> 'test' and predicted is not null").select("series", "origin", "lead", "model", "actual", "predicted")
    return rows.groupBy("series").applyInPandas(of_series, "series string, model string, weight double")


def stacked(bt: DataFrame, weights: DataFrame) -> DataFrame:
    """(series, origin, role, lead, actual, stacked): the weighted sum of the models' predictions."""
    j = bt.join(weights, ["series", "model"])
    return j.groupBy("series", "origin", "role", "lead").agg(F.first("actual").alias("actual"), F.sum(F.col("weight") * F.col("predicted")).alias("stacked"))


def blended(bt: DataFrame, candidate: str, baseline: str, weight: float) -> DataFrame:
    """(series, origin, role, lead, actual, blended): weight * candidate + (1 - weight) * baseline, 0 < weight < 1."""
    if not 0 < weight < 1:
        raise ValueError("the weight lies between 0 and 1")
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("predicted")))
    return bt.groupBy("series", "origin", "role", "lead").agg(F.first("actual").alias("actual"), (weight * of(candidate) + (1 - weight) * of(baseline)).alias("blended"))
