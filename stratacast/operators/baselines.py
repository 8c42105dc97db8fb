"""Classical forecasts per series.

Naive and seasonal naive are relational.  The others smooth each series on its
own in a grouped map; they are small searches over standard recursions, simpler
than full automatic packages.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEASON = 7


def naive(history: DataFrame, keys: list[str], horizon: int, date: str = "date", y: str = "y") -> DataFrame:
    """The last value, for steps 1 to ``horizon``."""
    last = history.groupBy(*keys).agg(F.max_by(y, date).alias("yhat"))
    return last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))


def seasonal_naive(history: DataFrame, keys: list[str], horizon: int, season: int = SEASON, date: str = "date", y: str = "y") -> DataFrame:
    """The value a whole number of seasons before; null where the history is too short."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(date)))
    tail = history.withColumn("back", back).where(F.col("back") <= season).select(*keys, "back", F.col(y).alias("yhat"))
    steps = history.select(*keys).distinct().withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    steps = steps.withColumn("back", F.lit(season) - (F.col("step") - 1) % season)
    return steps.join(tail, [*keys, "back"], "left").select(*keys, "yhat", "step")


def in_sample_seasonal(history: DataFrame, keys: list[str], season: int = SEASON, date: str = "date", y: str = "y") -> DataFrame:
    return history.withColumn("yhat", F.lag(y, season).over(Window.partitionBy(*keys).orderBy(date)))


def croston(y: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """Demand sizes and intervals smoothed apart; the rate with least squared error of a small grid."""
    at = np.flatnonzero(y > 0)
    if not len(at):
        return np.zeros(len(y)), np.zeros(horizon)
    best = None
    for alpha in (0.02, 0.05, 0.1, 0.2, 0.3, 0.5):
        size, gap, since, fitted = y[at[0]], float(at[0] + 1), 1, np.zeros(len(y))
        for t in range(len(y)):
            fitted[t] = size / gap
            if y[t] > 0 and t > at[0]:
                size, gap, since = size + alpha * (y[t] - size), gap + alpha * (since - gap), 1
            elif t > at[0]:
                since += 1
        error = ((fitted - y) ** 2).sum()
        if best is None or error < best[0]:
            best = (error, fitted, size / gap)
    return best[1], np.full(horizon, best[2])


def ets(y: np.ndarray, horizon: int, season: int = SEASON) -> tuple[np.ndarray, np.ndarray]:
    """Exponential smoothing: no, a linear or a damped trend; no, an additive or (of positive values) a multiplicative season; chosen by AIC."""
    best = None
    kinds = ("none", *(("add",) if len(y) >= 2 * season else ()), *(("mul",) if len(y) >= 2 * season and y.min() > 0 else ()))
    for damp, kind, a, g in itertools.product((0.0, 0.9, 1.0), kinds, (0.1, 0.3, 0.6), (0.05, 0.2)):
        if kind == "none" and g > 0.05:
            continue  # the season's rate does not matter
        first = y[:season].mean()
        level, slope, fitted = y[0] if kind == "none" else first, 0.0, np.zeros(len(y))
        cycle = list(y[:season] / first if kind == "mul" else y[:season] - first if kind == "add" else np.zeros(season))
        for t, value in enumerate(y):
            s, base = cycle[t % season], level + damp * slope
            fitted[t] = base * s if kind == "mul" else base + s
            e = value - fitted[t]
            rise = a * (e / max(s, 1e-6) if kind == "mul" else e)
            level, slope = base + rise, damp * slope + (0.1 * rise if damp else 0.0)
            if kind == "add":
                cycle[t % season] = s + g * e
            elif kind == "mul":
                cycle[t % season] = s + g * e / max(abs(base), 1e-6)
        aic = len(y) * np.log(((y - fitted) ** 2).mean() + 1e-12) + 2 * (2 + (damp > 0) + (0 < damp < 1) + (kind != "none") * (season + 1))
        if best is None or aic < best[0]:
            rises = np.cumsum(damp ** np.arange(1, horizon + 1)) if damp else np.zeros(horizon)
            again = np.array([cycle[(len(y) + h) % season] for h in range(horizon)])
            ahead = (level + slope * rises) * again if kind == "mul" else level + slope * rises + again
            best = (aic, fitted, ahead)
    return best[1], best[2]


def theta(y: np.ndarray, horizon: int, season: int = SEASON) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the linear trend and of the smoothed second theta line, on additively deseasonalised data."""
    n = len(y)
    cycle = np.zeros(season)
    if n >= 2 * season:
        cycle = np.array([y[i::season].mean() for i in range(season)]) - y.mean()
    x = y - cycle[np.arange(n) % season]
    slope, base = np.polyfit(np.arange(n), x, 1) if n > 1 else (0.0, x[0])
    line = base + slope * np.arange(n + horizon)
    bent, best = 2 * x - line[:n], None
    for alpha in (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.6, 0.8, 0.95):
        level, fitted = bent[0], np.zeros(n)
        for t in range(n):
            fitted[t] = level
            level += alpha * (bent[t] - level)
        error = ((fitted - bent) ** 2).sum()
        if best is None or error < best[0]:
            best = (error, fitted, level)
    phase = cycle[np.arange(n + horizon) % season]
    return (best[1] + line[:n]) / 2 + phase[:n], (best[2] + line[n:]) / 2 + phase[n:]


def arima(y: np.ndarray, horizon: int, season: int = SEASON) -> tuple[np.ndarray, np.ndarray]:
    """Autoregression and moving averages, with a seasonal lag or not, of the values or their first differences, chosen by AIC.

    Both parts are fitted by least squares, past shocks being taken from a long
    autoregression first (the two-stage estimator of Hannan and Rissanen).
    """
    best = None
    for d, p, q, cyclic in itertools.product((0, 1), (0, 1, 2, 3), (0, 1, 2), (False, True)):
        z = np.diff(y, n=d)
        lags = sorted({*range(1, p + 1), *([season] if cyclic else [])})
        long = season + 3 if q else 0
        deep = max([*lags, long + q if q else 0])
        if len(z) <= 2 * deep + 3:
            continue
        shocks = np.zeros(len(z))
        if q:
            wide = np.column_stack([np.ones(len(z) - long), *[z[long - k : len(z) - k] for k in range(1, long + 1)]])
            shocks[long:] = z[long:] - wide @ np.linalg.lstsq(wide, z[long:], rcond=None)[0]
        grid = np.column_stack([np.ones(len(z) - deep), *[z[deep - k : len(z) - k] for k in lags], *[shocks[deep - k : len(z) - k] for k in range(1, q + 1)]])
        coef = np.linalg.lstsq(grid, z[deep:], rcond=None)[0]
        rest = z[deep:] - grid @ coef
        aic = len(rest) * np.log((rest**2).mean() + 1e-12) + 2 * len(coef)
        aic *= len(y) / len(rest)
        if best is None or aic < best[0]:
            best = (aic, d, lags, q, coef)
    if best is None:
        return np.full(len(y), y.mean()), np.full(horizon, y.mean())
    _, d, lags, q, coef = best
    z, fitted = list(np.diff(y, n=d)), np.array(y, dtype=float)
    deep, shocks = max([*lags, q]), [0.0] * len(z)
    past, moving = coef[1 : 1 + len(lags)], coef[1 + len(lags) :]

    def next_step(t: int) -> float:
        return coef[0] + sum(c * z[t - k] for c, k in zip(past, lags, strict=True)) + sum(c * shocks[t - k] for k, c in enumerate(moving, 1))

    for t in range(deep, len(z)):
        step = next_step(t)
        # a model whose shocks do not die out is held in bounds
        shocks[t] = float(np.clip(z[t] - step, -1e6, 1e6))
        fitted[t + d] = step + (y[t] if d else 0.0)
    ahead, level = [], y[-1]
    for _ in range(horizon):
        step = next_step(len(z))
        z.append(step)
        shocks.append(0.0)
        level = level + step if d else step
        ahead.append(level)
    return fitted, np.array(ahead)


MODELS = {"croston": croston, "ets": ets, "theta": theta, "arima": arima}


def classical(history: DataFrame, model: str, horizon: int, keys: tuple[str, ...] = ("aggregation", "value"), fitted: bool = False) -> DataFrame:
    """``(*keys, step, yhat)`` of one model per series; ``fitted`` adds in-sample rows at steps up to 0.

    A series whose fit fails numerically falls back to the seasonal naive forecast.
    """
    run = MODELS[model]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        y = rows.sort_values("date")["y"].to_numpy(dtype=float)
        try:
            back, ahead = run(y, horizon)
        except np.linalg.LinAlgError:
            back, ahead = y, y[-SEASON:][np.arange(horizon) % min(SEASON, len(y))]
        values = np.concatenate([back, ahead]) if fitted else ahead
        steps = np.arange(1 - len(back), horizon + 1) if fitted else np.arange(1, horizon + 1)
        return pd.DataFrame({k: rows[k].iloc[0] for k in keys} | {"step": steps.astype(np.int32), "yhat": values})

    schema = ", ".join(f"{k} string" for k in keys) + ", step int, yhat double"
    return history.select(*keys, "date", "y").groupBy(*keys).applyInPandas(one, schema)
