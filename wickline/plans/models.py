"""Queries of the predictor protocol, streaming candles and synthetic sources."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from wickline.operators import evaluation as ev
from wickline.operators import predictor as pr
from wickline.plans import oracle as o
from wickline.plans.evaluation import ARGS6, HORIZON, LOOKBACK, THRESHOLD
from wickline.plans.registry import query
from wickline.session import cut
from wickline.sources import candles as src
from wickline.sources import files
from wickline.streaming import candles as st


@query("stub_predictor", f"with {o.windows(*ARGS6)} select symbol, candidate_month, {o.d('forecast_origin')}, horizon_step, {o.r('predicted_close')}, cast(null as varchar) as reason_code from fc where method = 'last_close'")
def _(spark, sf):
    c = src.week6(spark, sf)
    cohorts = ev.monthly_cohorts(ev.canonical_calendar(c, THRESHOLD), HORIZON)
    return pr.predict(pr.contexts(c, cohorts, LOOKBACK), pr.last_close_stub, HORIZON)


#: Streams append what the watermark has passed when all is read: windows that end an hour before the latest event.
MARK = "(select date_trunc('millisecond', max(ts)) - interval 1 hour from events)"


@query("stream_candles", f"select strftime(ts, '%Y-%m-%d %H:%M:%S') as start, symbol as event_type, {o.r('open')}, {o.r('high')}, {o.r('low')}, {o.r('close')}, volume::bigint as volume from ({o.HOUR5}) where ts + interval 1 hour <= {MARK}")
def _(spark, sf):
    return st.drain(st.bars(st.event_stream(spark, sf)), f"bars-{uuid.uuid4().hex}").select(F.col("w.start").alias("start"), "event_type", "open", "high", "low", "close", "volume")


@query("stream_sliding", f"with s as (select event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) as w, value from events) select strftime(w, '%Y-%m-%d %H:%M:%S') as start, event_type, {o.r('max(value)', 'high')}, {o.r('min(value)', 'low')}, count(*) as volume from s where w + interval 2 hour <= {MARK} group by all")
def _(spark, sf):
    return st.drain(st.bars(st.event_stream(spark, sf), "2 hours", "1 hour"), f"slide_{uuid.uuid4().hex}").select(F.col("w.start").alias("start"), "event_type", "high", "low", "volume")


@query("stream_sessions", f"with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as events, {o.r('sum(value)', 'value')} from s group by user_id, k having max(ts) + interval 30 minute <= {MARK}")
def _(spark, sf):
    return st.drain(st.sessions(st.event_stream(spark, sf)), f"sess_{uuid.uuid4().hex}").select("user_id", F.col("w.start").alias("start"), "events", "value")


@query("synthetic_candles")
def _(spark, sf):
    return files.synthetic(spark, 5, 250)


class _LastMove(pr.TokenModel):
    """A stand-in token model: a coarse token per tenth of a deviation, a fine one for the rest; the next token repeats the last."""

    def encode(self, values):
        at = np.clip(np.round((values + 5) * 10), 0, 100).astype(int)
        return at, np.zeros_like(at)

    def first(self, pre, post):
        return -np.abs(np.arange(101)[None] - pre[:, -1:]) * 50.0

    def second(self, pre, post, token):
        return np.where(np.arange(4)[None] == 0, 50.0, 0.0) + np.zeros((len(token), 1))

    def decode(self, pre, post):
        return pre / 10 - 5


@query("token_predictor")
def _(spark, sf):
    c = cut(src.week6(spark, sf))
    cohorts = ev.monthly_cohorts(ev.canonical_calendar(c, THRESHOLD), HORIZON)
    return pr.predict(pr.contexts(c, cohorts, LOOKBACK), pr.token_predictor(_LastMove(), max_context=32, samples=3, seed=11, top_k=5, top_p=0.99), HORIZON)
