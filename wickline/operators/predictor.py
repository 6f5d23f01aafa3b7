"""Pluggable forecasters: one vectorised call per common-origin cohort, failures as rows.

A predictor gets the contexts of one cohort and no targets. Contexts are built from frames that end at
the origin. Its output is checked (length, finite and positive values), never repaired.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Predictor = Callable[[dict[str, np.ndarray], int], dict[str, np.ndarray]]
SCHEMA = "symbol string, candidate_month string, forecast_origin date, horizon_step long, predicted_close double, reason_code string"


def last_close_stub(contexts: dict[str, np.ndarray], horizon: int) -> dict[str, np.ndarray]:
    """Repeats the last close; stands in for a model."""
    return {s: np.full(horizon, c[-1]) for s, c in contexts.items()}


def contexts(candles: DataFrame, cohorts: DataFrame, lookback: int) -> DataFrame:
    """One row per window with its closes as an array, oldest first.

    Origins are picked first; only their ``lookback`` bars are then gathered, by position.
    """
    numbered = candles.select("symbol", "ts", "close", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")).alias("rn"))
    origins = F.broadcast(cohorts.filter("complete").select("candidate_month", "forecast_origin"))  # one row per month
    at = numbered.join(origins, F.col("ts") == F.col("forecast_origin")).filter(F.col("rn") >= lookback)
    wanted = at.select("symbol", "candidate_month", "forecast_origin", F.explode(F.sequence(F.col("rn") - lookback + 1, F.col("rn"))).alias("rn"))
    bars = wanted.join(numbered.select("symbol", "rn", "close"), ["symbol", "rn"])
    g = bars.groupBy("symbol", "candidate_month", "forecast_origin").agg(F.sort_array(F.collect_list(F.struct("rn", "close"))).alias("x"))  # ``lookback`` bars
    return g.select("symbol", "candidate_month", "forecast_origin", F.transform("x", lambda x: x.close).alias("context"))


def predict(windows: DataFrame, predictor: Predictor, horizon: int, batch: int = 512) -> DataFrame:
    """Forecasts and coded failures. Cohorts are dealt into batches of bounded size by a hash of the symbol.

    A forecast is an array, or a pair of an array and the stamps it is for: those must be the window's ``targets`` (if it has that column).
    Failures are coded in order: schema (length), output (finite and positive), timestamps.
    """
    parts = F.pmod(F.xxhash64("symbol"), F.greatest(F.lit(1).cast("long"), F.ceil(F.count("*").over(Window.partitionBy("forecast_origin")) / F.lit(batch))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        got = predictor({r.symbol: np.asarray(r.context, float) for r in pdf.itertuples()}, horizon)
        for r in pdf.itertuples():
            made = got.get(r.symbol, [])
            made, stamps = made if isinstance(made, tuple) else (made, None)
            out = np.asarray(made, float)
            reason = "invalid_model_schema" if out.shape != (horizon,) else "invalid_model_output" if not (np.isfinite(out).all() and (out > 0).all()) else None
            if reason is None and stamps is not None and [pd.Timestamp(t) for t in stamps] != [pd.Timestamp(t) for t in getattr(r, "targets", stamps)]:
                reason = "invalid_model_timestamps"
            steps = [(None, None)] if reason else list(enumerate(out, 1))
            rows += [(r.symbol, r.candidate_month, r.forecast_origin, h, v, reason) for h, v in steps]
        return pd.DataFrame(rows, columns=["symbol", "candidate_month", "forecast_origin", "horizon_step", "predicted_close", "reason_code"]).astype({"horizon_step": "Int64"})

    return windows.withColumn("__part", parts).groupBy("forecast_origin", "__part").applyInPandas(run, SCHEMA)


# ---------------------------------------------------------------- sampling from token models


def sample_from(logits: np.ndarray, rng: np.random.Generator, temperature: float = 1.0, top_k: int = 0, top_p: float = 1.0, greedy: bool = False) -> np.ndarray:
    """A token per row of ``logits`` after temperature, top-k and nucleus filters (0 and 1 switch those off)."""
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    x = np.asarray(logits, float) / temperature
    if top_k:
        kth = np.sort(x, axis=1)[:, -min(top_k, x.shape[1])][:, None]
        x = np.where(x < kth, -np.inf, x)
    if top_p < 1:
        order = np.argsort(-x, axis=1, kind="stable")
        p = np.exp(np.take_along_axis(x, order, 1) - x.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        beyond = np.cumsum(p, axis=1) - p > top_p  # what lies before a token already has the mass
        np.put_along_axis(x, order, np.where(beyond, -np.inf, np.take_along_axis(x, order, 1)), 1)
    if greedy:
        return x.argmax(axis=1)
    p = np.exp(x - x.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    return (np.cumsum(p, axis=1) > rng.random((len(p), 1))).argmax(axis=1)


class TokenModel:
    """A pluggable two-level token model: ``first(pre, post)`` gives the logits of the next coarse token,
    ``second(pre, post, token)`` those of the fine token behind it; ``encode`` and ``decode`` change values into tokens and back."""

    def encode(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def first(self, pre: np.ndarray, post: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def second(self, pre: np.ndarray, post: np.ndarray, token: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def decode(self, pre: np.ndarray, post: np.ndarray) -> np.ndarray:
        raise NotImplementedError


def autoregressive(model: TokenModel, values: np.ndarray, horizon: int, max_context: int, samples: int = 1, seed: int = 0, clip: float = 5.0, eps: float = 1e-5, **options) -> np.ndarray:
    """(rows, horizon) forecasts of equally long contexts, the mean of ``samples`` paths.

    Values are normalised by the context's own mean and deviation and clipped. Tokens live in a ring buffer of ``max_context``: beyond
    that the oldest leave, so that a step costs the same however long the path is.
    """
    values = np.asarray(values, float)
    mean, std = values.mean(axis=1, keepdims=True), values.std(axis=1, keepdims=True)
    z = np.clip((values - mean) / (std + eps), -clip, clip)
    pre, post = (np.repeat(t, samples, axis=0) for t in model.encode(z))
    rng = np.random.default_rng(seed)
    start = max(0, pre.shape[1] - max_context)
    ring = [np.zeros((len(pre), max_context), pre.dtype), np.zeros((len(pre), max_context), post.dtype)]
    n = pre.shape[1] - start
    ring[0][:, :n], ring[1][:, :n] = pre[:, start:], post[:, start:]
    made = [np.empty((len(pre), horizon), pre.dtype), np.empty((len(pre), horizon), post.dtype)]
    head = 0  # where the oldest token is once the ring is full
    for i in range(horizon):
        window = [np.roll(r, -head, axis=1)[:, : min(n, max_context)] for r in ring]
        a = sample_from(model.first(*window), rng, **options)
        b = sample_from(model.second(*window, a), rng, **options)
        made[0][:, i], made[1][:, i] = a, b
        at = n if n < max_context else head
        ring[0][:, at], ring[1][:, at] = a, b
        if n < max_context:
            n += 1
        else:
            head = (head + 1) % max_context
    whole = [np.concatenate([t, m], axis=1)[:, -max_context:] for t, m in zip((pre, post), made)]
    out = model.decode(*whole)[:, -horizon:]
    return out.reshape(len(values), samples, -1).mean(axis=1) * (std + eps) + mean


def token_predictor(model: TokenModel, max_context: int = 512, samples: int = 5, seed: int = 0, **options) -> Predictor:
    """A predictor over a token model; the contexts of a batch must have one length. ``options``: temperature, top_k, top_p, greedy."""

    def run(contexts: dict[str, np.ndarray], horizon: int) -> dict[str, np.ndarray]:
        if len({len(c) for c in contexts.values()}) > 1:
            raise ValueError("all contexts must have the same length")
        if not contexts:
            return {}
        names = sorted(contexts)
        if horizon > max_context:
            raise ValueError("horizon must not be beyond the model's context")
        return dict(zip(names, autoregressive(model, np.stack([contexts[n] for n in names]), horizon, max_context, samples, seed, **options)))

    return run
