"""Walk-forward ridge regression: at every date a model of the labels that had matured before it."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from marketloom.functions.scalar import clamp, direction, rnd

# Penalty, training samples that a horizon needs, what a regime of interest rates counts.
LAMBDA = 2.0
MIN_SAMPLES = {21: 40, 63: 28, 126: 16}
RATE_REGIME = {"RATE_HEADWIND": -1.0, "RATE_TAILWIND": 1.0}


def model_inputs(horizon: str = "horizon") -> list[Column]:
    """The 16 inputs of the candidate model; a missing one is 0."""
    h = F.col(horizon)
    own = lambda prefix: F.coalesce(*[F.when(h == n, F.col(f"{prefix}_{n}d")) for n in MIN_SAMPLES])
    regime = F.coalesce(*[F.when(F.col("regime") == k, F.lit(v)) for k, v in RATE_REGIME.items()])
    inputs = [F.col("return_5d"), F.col("return_21d"), F.col("return_63d"), F.col("return_126d"), F.col("volatility_20d"), F.col("ma_gap_20d"),
              own("return") - own("market"), own("return") - own("industry"), F.col("flow_score"), F.col("behavior_score"),
              F.coalesce("forward_premium", "static_premium"), F.col("eps_revision"), F.col("revenue_growth"), F.col("cash_flow_margin"), regime, F.col("event_score")]
    return [F.coalesce(x.cast("double"), F.lit(0.0)) for x in inputs]


def walk_forward(day: np.ndarray, x: np.ndarray, known: np.ndarray, y: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of one series: the number of labels known before its day, and expected value, residual 10 % and 90 %
    quantiles and residual deviation of the ridge model fitted on those (nan below ``least``).

    ``known`` is the day a label became known, negative for none. Moments of growing training sets are running sums of
    centred products, so a set costs no pass over its rows; only the residuals of a date are recomputed.
    """
    n, d = x.shape
    have = np.flatnonzero(known >= 0)
    have = have[np.lexsort((day[have], known[have]))]
    tx, ty, tk = x[have], y[have], known[have]
    size = np.searchsorted(tk, day, side="left")
    out = np.full((n, 4), np.nan)
    ask = np.flatnonzero(size >= least)
    if not len(ask):
        return size, out
    shift = tx.mean(axis=0)  # takes away the bulk of cancellation; moments about the mean don't depend on it
    cx, level = tx - shift, ty.mean()
    cy = ty - level
    sx, sy, sxy = cx.cumsum(axis=0), cy.cumsum(), (cx * cy[:, None]).cumsum(axis=0)
    flat = np.maximum.accumulate(tx, axis=0) == np.minimum.accumulate(tx, axis=0)
    sizes, back = np.unique(size[ask], return_inverse=True)
    slope, origin = np.empty((len(sizes), d)), np.empty(len(sizes))
    low = high = None
    running, at = np.zeros((d, d)), 0
    for k, m in enumerate(sizes):
        running += cx[at:m].T @ cx[at:m]
        at = m
        mean = sx[m - 1] / m
        moment = running - m * np.outer(mean, mean)
        dead = flat[m - 1]
        moment[dead], moment[:, dead] = 0.0, 0.0
        scale = np.sqrt(np.maximum(np.diag(moment), 0) / (m - 1))
        scale[scale == 0] = 1.0
        right = (sxy[m - 1] - mean * sy[m - 1]) / scale
        right[dead] = 0.0
        slope[k] = np.linalg.solve(moment / np.outer(scale, scale) + LAMBDA * np.eye(d), right) / scale
        origin[k] = level + sy[m - 1] / m - (mean + shift) @ slope[k]
    out[ask, 0] = origin[back] + np.einsum("ij,ij->i", x[ask], slope[back])
    low, high, spread = np.empty(len(sizes)), np.empty(len(sizes)), np.empty(len(sizes))
    for k, m in enumerate(sizes):
        residual = ty[:m] - origin[k] - tx[:m] @ slope[k]
        low[k], high[k] = np.quantile(residual, (0.1, 0.9))
        spread[k] = residual.std(ddof=1)
    out[ask, 1], out[ask, 2], out[ask, 3] = low[back], high[back], spread[back]
    return size, out


def walk_forward_models(rows: DataFrame, keys: list[str], date: str, inputs: str, known: str, label: str, least: Callable[[tuple], int]) -> DataFrame:
    """``walk_forward`` for every series of ``keys``: adds ``training_samples, expected, residual_p10, residual_p90, residual_sd``.

    A series has one row per session, so its group is bounded by the sessions there were (about 25 000 a century),
    and the series are dealt over the cluster. A training row's label must be known strictly before a date to count there.
    """
    names = ["training_samples", "expected", "residual_p10", "residual_p90", "residual_sd"]
    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "_day int", "training_samples long", *[f"{n} double" for n in names[1:]]])
    narrow = rows.select(*keys, F.unix_date(date).alias("_day"), F.col(inputs).alias("_x"), F.coalesce(F.unix_date(known), F.lit(-(1 << 30))).alias("_known"), F.col(label).cast("double").alias("_y"))

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_day", kind="stable")
        day = g["_day"].to_numpy()
        first = min(int(day[0]), 0)  # days before the epoch are negative
        known_day = g["_known"].to_numpy().astype(np.int64)
        usable = (known_day > -(1 << 30)) & ~np.isnan(g["_y"].to_numpy())
        size, out = walk_forward(day - first, np.stack(g["_x"].to_numpy()), np.where(usable, known_day - first, -1), g["_y"].to_numpy(), least(key))
        return pd.DataFrame({**dict(zip(keys, key, strict=True)), "_day": day, names[0]: size, **{n: out[:, k] for k, n in enumerate(names[1:])}})

    found = narrow.groupBy(*keys).applyInPandas(run, schema)
    nan_to_null = [F.when(~F.isnan(n), F.col(n)).alias(n) for n in names[1:]]
    found = found.select(*keys, F.date_from_unix_date("_day").alias(date), "training_samples", *nan_to_null)
    return rows.join(found, [*keys, date])


def candidate_predictions(snapshot: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Out-of-sample ridge prediction of every (ticker, date, horizon) whose training set is large enough.

    ``evaluated``: the baseline's outcomes with ``status``, ``actual_date`` and ``actual_return``. Only matured ones teach, and
    only dates strictly after their ``actual_date``. Expected return, interval from residual quantiles, logistic probability.
    """
    outcome = evaluated.select("ticker", "trade_date", "horizon", F.when(F.col("status") == "MATURED", F.col("actual_date")).alias("_known"), F.col("actual_return").alias("_label"))
    rows = snapshot.select(*snapshot.columns, F.explode(F.array(*map(F.lit, MIN_SAMPLES))).alias("horizon"))
    rows = rows.select("ticker", "trade_date", "horizon", "close", "market_close", "quality_score", "eligible", F.array(*model_inputs()).alias("_inputs"))
    d = walk_forward_models(rows.join(outcome, ["ticker", "trade_date", "horizon"]), ["ticker", "horizon"], "trade_date", "_inputs", "_known", "_label", lambda key: MIN_SAMPLES[int(key[1])])
    e = clamp("expected", -0.8, 2)
    low, high = clamp(e + F.col("residual_p10"), -0.95, 3), clamp(e + F.col("residual_p90"), -0.95, 3)
    spread = F.when(F.col("residual_sd") > 0, F.col("residual_sd")).otherwise(0.1)
    d = d.where(F.col("expected").isNotNull())
    return d.select("ticker", "trade_date", "horizon", "close", "market_close", "quality_score", "eligible", "training_samples", rnd(F.least(low, e), 6).alias("return_p10"),
                    rnd(e, 6).alias("return_p50"), rnd(F.greatest(high, e), 6).alias("return_p90"),
                    rnd(clamp(1 / (1 + F.exp(-e / F.greatest(F.lit(0.02), spread))), 0.05, 0.95), 4).alias("probability_up"), direction(e).alias("predicted_direction"))
