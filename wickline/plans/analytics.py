"""Queries of adjustments, indicators, features, tokens, reshaping and parsing, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wickline.api import gaps
from wickline.operators import adjust, features, indicators, tokens
from wickline.operators import parsing as ps
from wickline.plans import oracle as o
from wickline.plans.registry import query
from wickline.sources import candles as src

W6 = f"c as ({o.WEEK6})"
T = o.d("ts")
FACTORS = f"f as (select *, adj_close / nullif(close, 0) as factor from (select *, close * case when ts < date '1998-01-01' then 0.5 else 1 end as adj_close from ({o.WEEK6})))"


def factored(spark, sf):
    c = src.week6(spark, sf)
    return adjust.with_factor(c.withColumn("adj_close", F.col("close") * F.when(F.col("ts") < "1998-01-01", 0.5).otherwise(1.0)))


_FINGER = """y as (select symbol, year(ts) as year, count(*) as n, min(ts) as lo_ts, max(ts) as hi_ts, min(factor) as lo, max(factor) as hi, count(*) filter (abs(factor - 1) > 1e-6) as changed,
    sha256(string_agg(strftime(ts, '%Y-%m-%d') || '=' || printf('%.6f', factor), '~' order by ts)) as digest from f group by all),
  d as (select symbol, sum(n)::bigint as n_rows, min(lo_ts) as first_ts, max(hi_ts) as last_ts, min(lo) as min_factor, max(hi) as max_factor, sum(changed)::bigint as adjusted_rows, sha256(string_agg(digest, '~' order by year)) as fingerprint from y group by symbol)"""


@query("provider_factors", f"with {FACTORS}, {_FINGER} select symbol, n_rows, {o.d('first_ts')}, {o.d('last_ts')}, {o.r('min_factor')}, {o.r('max_factor')}, adjusted_rows, fingerprint from d")
def _(spark, sf):
    return adjust.diagnostics(factored(spark, sf))


@query("factor_fingerprint", f"with {FACTORS}, {_FINGER} select sha256(string_agg(symbol || '=' || fingerprint, '~' order by symbol)) as fingerprint, count(*) as names from d")
def _(spark, sf):
    return adjust.total_fingerprint(adjust.diagnostics(factored(spark, sf)))


_REBASED = f"""{FACTORS}, og as (select symbol, max(ts) as origin from f group by symbol), b as (select f.*, origin, f.factor / g.factor as scale from f join og using (symbol) join f g on g.symbol = f.symbol and g.ts = origin),
  s as (select symbol, ts, origin, volume, open * scale as o1, high * scale as h1, low * scale as l1, close * scale as c1 from b), s2 as (select *, greatest(h1, o1, c1, l1) as h2 from s), s3 as (select *, least(l1, o1, c1, h2) as l2 from s2)"""


@query("rebased_context", f"with {_REBASED} select symbol, {T}, {o.r('o1', 'open')}, {o.r('h2', 'high')}, {o.r('l2', 'low')}, {o.r('c1', 'close')}, {o.r('volume')}, round((h2 + l2 + c1) / 3 * volume, 3) + 0.0 as amount from s3")
def _(spark, sf):
    f = factored(spark, sf)
    origins = f.groupBy(F.col("symbol").alias("origin_symbol")).agg(F.max("ts").alias("origin"))
    return adjust.rebase(f, origins).select("symbol", "ts", "open", "high", "low", "close", "volume", F.round("amount", 3).alias("amount"))


@query("exposure_buckets", f"""with {FACTORS}, g as (select *, abs(ln(factor) - ln(lag(factor) over (partition by symbol order by ts))) as s from f), x as (select symbol, ts, coalesce(max(s) over (partition by symbol order by ts rows between 50 preceding and current row), 0) as m from g)
  select symbol, {T}, {o.r('m', 'context_max_abs_log_step')}, case when m > 1e-6 then 'material_factor_change' else 'no_material_change' end as exposure_bucket from x""")  # fmt: skip
def _(spark, sf):
    return adjust.exposure(factored(spark, sf), 52).select("symbol", "ts", "context_max_abs_log_step", "exposure_bucket")


HORIZON = 4
_TARGETS = f"""{FACTORS}, nb as (select *, row_number() over (partition by symbol order by ts) as rn, count(*) over (partition by symbol) as nn from f),
  tg as (select g.symbol, g.ts as origin, t.rn - g.rn as horizon_step, t.ts, t.volume, t.factor / g.factor as scale, t.open * (t.factor / g.factor) as o1, t.high * (t.factor / g.factor) as h1, t.low * (t.factor / g.factor) as l1, t.close * (t.factor / g.factor) as c1
    from nb g join nb t on g.symbol = t.symbol and t.rn between g.rn + 1 and g.rn + {HORIZON} where g.rn + {HORIZON} <= g.nn)"""


@query("rebased_target", f"with {_TARGETS}, t2 as (select *, greatest(h1, o1, c1, l1) as h2 from tg), t3 as (select *, least(l1, o1, c1, h2) as l2 from t2) select symbol, {o.d('origin')}, horizon_step, {T}, {o.r('o1', 'open')}, {o.r('h2', 'high')}, {o.r('l2', 'low')}, {o.r('c1', 'close')}, {o.r('volume')}, round((h2 + l2 + c1) / 3 * volume, 3) + 0.0 as amount from t3")
def _(spark, sf):
    t = adjust.target_rows(factored(spark, sf), HORIZON)
    return t.select("symbol", "origin", "horizon_step", "ts", "open", "high", "low", "close", "volume", F.round("amount", 3).alias("amount"))


@query("exposure_windows", f"""with {_TARGETS}, st as (select *, abs(ln(factor) - ln(lag(factor) over (partition by symbol order by ts))) as s from f), cx as (select symbol, ts, coalesce(max(s) over (partition by symbol order by ts rows between 50 preceding and current row), 0) as m from st),
  tx as (select symbol, origin as ts, max(abs(ln(scale))) as w from tg group by all)
  select symbol, {T}, {o.r('m', 'context_max_abs_log_step')}, {o.r('w', 'target_max_abs_log_factor')}, m > 1e-6 as context_changed, w > 1e-6 as target_changed, case when m > 1e-6 or w > 1e-6 then 'material_factor_change' else 'no_material_change' end as exposure_bucket from cx join tx using (symbol, ts)""")  # fmt: skip
def _(spark, sf):
    x = adjust.window_exposure(factored(spark, sf), 52, HORIZON)
    return x.select("symbol", "ts", "context_max_abs_log_step", "target_max_abs_log_factor", "context_changed", "target_changed", "exposure_bucket")


# ---------------------------------------------------------------- indicators

_MA = """ma as (select *, {five} as ma5, {twenty} as ma20, {sixty} as ma60, {vol} as vol5, count(*) over (partition by symbol order by ts rows between 19 preceding and current row) as rows20,
  avg(volume) over (partition by symbol order by ts rows between 9 preceding and 5 preceding) as vp, lag(close, 19) over (partition by symbol order by ts) as c19 from c)"""


def _mean(c: str, n: int) -> str:
    w = f"over (partition by symbol order by ts rows between {n - 1} preceding and current row)"
    return f"case when count({c}) {w} = {n} then avg({c}) {w} end"


_STRENGTH = f"""{W6}, {_MA.format(five=_mean('close', 5), twenty=_mean('close', 20), sixty=_mean('close', 60), vol=_mean('volume', 5))},
  mb as (select *, lag(ma5, 19) over (partition by symbol order by ts) as m19 from ma),
  st0 as (select *, case when rows20 < 20 then 0.5 else least(greatest(10 * (0.4 * coalesce((ma5 - m19) / nullif(m19, 0), 0) + 0.4 * (close - c19) / nullif(c19, 0) + 0.2 * coalesce(least(vol5 / nullif(vp, 0) - 1, 0.2), 0)), 0), 1) end as strength from mb),
  st as (select *, coalesce(ma5 > ma20 and ma20 > ma60 and close > ma20 and strength > 0.6, false) as uptrend from st0)"""


@query("sma_trend", f"with {_STRENGTH} select symbol, {T}, {o.r('ma5')}, {o.r('ma20')}, {o.r('ma60')}, {o.r('vol5')}, {o.r('strength')}, uptrend from st")
def _(spark, sf):
    return indicators.trend_strength(src.week6(spark, sf)).select("symbol", "ts", "ma5", "ma20", "ma60", "vol5", "strength", "uptrend")


@query("market_vote", f"with {_STRENGTH} select {T}, {o.r('avg(uptrend::int::double)', 'share')}, {o.r('avg(strength)', 'strength')}, count(*) as symbols, avg(uptrend::int::double) >= 0.5 as market_up from st group by ts")
def _(spark, sf):
    return indicators.market_vote(src.week6(spark, sf))


@query("recent_trend", f"""with {W6}, n as (select *, row_number() over (partition by symbol order by ts)::double as x from c), s as (select symbol, ts, regr_slope(close, x) over w as sl, max(close) over w - min(close) over w as sp, count(close) over w as n from n window w as (partition by symbol order by ts rows between 19 preceding and current row))
  select symbol, {T}, {o.r("coalesce(case when isnan(sl) then null else least(greatest(sl / nullif(sp, 0) * n, -0.1), 0.1) end, 0)", 'trend')} from s""")  # fmt: skip
def _(spark, sf):
    return indicators.recent_trend(src.week6(spark, sf)).select("symbol", "ts", "trend")


PRICES = ("open", "high", "low", "close")
_HIST = "hs as (select * from c where ts < date '2000-01-01'), fu as (select * from c where ts >= date '2000-01-01')"
_TREND = """tn as (select *, row_number() over (partition by symbol order by ts)::double as x, row_number() over (partition by symbol order by ts desc) as back from hs),
  tr as (select symbol, coalesce(least(greatest(regr_slope(close, x) / nullif(max(close) - min(close), 0) * count(*), -0.1), 0.1), 0) as trend from tn where back <= 20 group by symbol)"""
_WIDTH = "fw as (select *, greatest(3, least(7, count(*) over (partition by symbol) // 5)) as w, row_number() over (partition by symbol order by ts) as rn from fu)"


def halves(spark, sf):
    """Bars before and from the year 2000: a history and what stands for its forecast."""
    c = src.week6(spark, sf)
    return c.filter("ts < '2000-01-01'"), c.filter("ts >= '2000-01-01'")


@query("centered_smooth", f"with {W6}, {_HIST}, {_TREND}, {_WIDTH} select a.symbol, strftime(a.ts, '%Y-%m-%d') as ts, " + ", ".join(o.r(f"avg(b.{c}) * (1 + any_value(trend) * 0.3)", c) for c in PRICES)
  + " from fw a join fw b on a.symbol = b.symbol and b.rn between a.rn - a.w // 2 and a.rn + (a.w - 1) // 2 join tr on tr.symbol = a.symbol group by a.symbol, a.ts")
def _(spark, sf):
    before, after = halves(spark, sf)
    trend = indicators.recent_trend(before).groupBy("symbol").agg(F.max_by("trend", "ts").alias("trend"))
    return indicators.smoothed(after, trend).select("symbol", "ts", *PRICES)


_RET = f"""{W6}, r0 as (select *, close / nullif(lag(close) over (partition by symbol order by ts), 0) - 1 as change from c),
  r1 as (select *, exp(sum(ln(1 + coalesce(change, 0))) over (partition by symbol order by ts rows unbounded preceding)) as growth from r0),
  r2 as (select *, max(growth) over (partition by symbol order by ts rows unbounded preceding) as peak from r1), r3 as (select *, growth / peak - 1 as drawdown from r2)"""


@query("returns_drawdown", f"with {_RET} select symbol, {T}, {o.r('change')}, {o.r('growth')}, {o.r('peak')}, {o.r('drawdown')} from r3")
def _(spark, sf):
    return indicators.returns(src.week6(spark, sf)).select("symbol", "ts", "change", "growth", "peak", "drawdown")


_SIG = f"""{W6}, s0 as (select *, close / nullif(lag(close) over (partition by symbol order by ts), 0) - 1 as change from c), s1 as (select *, case when change > 0.05 then 1 when change < -0.05 then -1 else 0 end as raw_signal from s0),
  s2 as (select *, coalesce(last_value(nullif(raw_signal, 0) ignore nulls) over (partition by symbol order by ts rows between unbounded preceding and current row), 0) as signal from s1)"""


@query("signals", f"with {_SIG} select symbol, {T}, {o.r('change')}, raw_signal, signal from s2")
def _(spark, sf):
    return indicators.signals(src.week6(spark, sf), 0.05).select("symbol", "ts", "change", "raw_signal", "signal")


_FOLD = f"{W6}, n as (select *, row_number() over (partition by symbol order by ts) as rn, close / nullif(lag(close) over (partition by symbol order by ts), 0) - 1 as change from c)"


def _clip(c: str) -> str:
    return f"least(greatest(n.{c}, l.close * 0.9), l.close * 1.1)"


@query("price_limits", f"""with recursive {W6}, {_HIST}, n as (select *, row_number() over (partition by symbol order by ts) as rn from fu), l as (
    select symbol, date '1900-01-01' as ts, 0::bigint as rn, 0::double as open, 0::double as high, 0::double as low, arg_max(close, ts) as close from hs group by symbol
    union all select n.symbol, n.ts, n.rn, {_clip('open')}, {_clip('high')}, {_clip('low')}, {_clip('close')} from l join n on n.symbol = l.symbol and n.rn = l.rn + 1)
  select symbol, {T}, {', '.join(o.r(c) for c in PRICES)} from l where rn > 0""")  # fmt: skip
def _(spark, sf):
    before, after = halves(spark, sf)
    return indicators.price_limits(after, before.groupBy("symbol").agg(F.max_by("close", "ts").alias("last_close")), 0.1)


_PRED = f"{W6}, p as (select symbol, ts, close as actual, avg(close) over (partition by symbol order by ts rows between 3 preceding and 1 preceding) as predicted from c), pp as (select *, row_number() over (partition by symbol order by ts) as rn from p where predicted is not null)"


def predicted(spark, sf):
    """The mean of the three closes before a bar, standing for its forecast."""
    w = indicators.by_time()
    return src.week6(spark, sf).select("symbol", "ts", F.col("close").alias("actual"), F.avg("close").over(w.rowsBetween(-3, -1)).alias("predicted")).filter("predicted is not null")


_BUY, _SELL = "l.held = 0 and (n.predicted - n.actual) / n.actual > 0.03 and floor(l.cash / n.actual) > 0", "l.held > 0 and (n.predicted - n.actual) / n.actual < -0.03"


_MOVE = f"{W6}, p as (select symbol, ts, close as actual, close * close / nullif(lag(close) over (partition by symbol order by ts), 0) as predicted from c), pp as (select *, row_number() over (partition by symbol order by ts) as rn from p where predicted is not null)"


@query("threshold_strategy", f"""with recursive {_MOVE}, l as (select symbol, date '1900-01-01' as ts, 0::bigint as rn, 100000.0::double as cash, 0::bigint as held, 0.0::double as price, cast(null as varchar) as action from (select distinct symbol from pp)
    union all select n.symbol, n.ts, n.rn, case when {_BUY} then l.cash - floor(l.cash / n.actual) * n.actual when {_SELL} then l.cash + l.held * n.actual else l.cash end,
      case when {_BUY} then floor(l.cash / n.actual)::bigint when {_SELL} then 0 else l.held end, n.actual, case when {_BUY} then 'BUY' when {_SELL} then 'SELL' end from l join pp n on n.symbol = l.symbol and n.rn = l.rn + 1)
  select symbol, {T}, round(cash + held * price, 3) + 0.0 as value, held as position, action from l where rn > 0""")  # fmt: skip
def _(spark, sf):
    # the last move goes on once more
    again = F.col("close") * F.col("close") / F.nullif(F.lag("close").over(indicators.by_time()), F.lit(0.0))
    moves = src.week6(spark, sf).select("symbol", "ts", F.col("close").alias("actual"), again.alias("predicted")).filter("predicted is not null")
    return indicators.threshold_strategy(moves).select("symbol", "ts", F.round("value", 3).alias("value"), "position", "action")


@query("prediction_accuracy", f"""with {_PRED}, q as (select *, abs((predicted - actual) / nullif(actual, 0)) as e, predicted - lag(predicted) over w as dp, actual - lag(actual) over w as da from pp window w as (partition by symbol order by ts))
  select symbol, {o.r('avg(e)', 'mape')}, {o.r('avg(coalesce(e < 0.05, false)::int::double)', 'hit_rate')}, {o.r('avg(coalesce(sign(dp) = sign(da), false)::int::double)', 'direction')}, {o.r(o.CORR.format(x='predicted', y='actual'), 'correlation')} from q group by symbol""")  # fmt: skip
def _(spark, sf):
    return indicators.accuracy(predicted(spark, sf))


@query("relative_volume", f"""with {W6}, {_HIST}, pk as (select symbol, max(volume) as peak from hs group by symbol) select symbol, {T}, 'history' as part, {o.r('volume / peak', 'relative_volume')} from hs join pk using (symbol)
  union all select symbol, {T}, 'forecast', {o.r('volume / peak', 'x')} from fu join pk using (symbol)""")  # fmt: skip
def _(spark, sf):
    before, after = halves(spark, sf)
    peak = before.groupBy("symbol").agg(F.max("volume").alias("peak"))
    both = before.withColumn("part", F.lit("history")).unionByName(after.withColumn("part", F.lit("forecast")))
    return both.join(peak, "symbol").select("symbol", "ts", "part", (F.col("volume") / F.col("peak")).alias("relative_volume"))


@query("walk_forward_points", f"with {_FOLD} select symbol, {T}, rn - 1 as start_index, {o.r('close')} from n where rn - 1 >= 52 and rn - 1 + 4 <= (select max(rn) from n m where m.symbol = n.symbol) and (rn - 1 - 52) % 4 = 0")
def _(spark, sf):
    c = src.week6(spark, sf).withColumns({"start_index": F.row_number().over(indicators.by_time()) - 1, "n": F.count("*").over(Window.partitionBy("symbol"))})
    return c.filter((F.col("start_index") >= 52) & (F.col("start_index") + 4 <= F.col("n")) & ((F.col("start_index") - 52) % 4 == 0)).select("symbol", "ts", "start_index", "close")


# ---------------------------------------------------------------- features


@query("sliding_windows", f"with {W6}, x as (select symbol, ts, count(*) over w as n, max(ts) over w as end_ts, avg(close) over w as mean_close, row_number() over (partition by symbol order by ts) - 1 as start_index from c window w as (partition by symbol order by ts rows between current row and 56 following)) select symbol, {o.d('ts', 'start_ts')}, {o.d('end_ts')}, start_index, {o.r('mean_close')} from x where n = 57")
def _(spark, sf):
    return features.sliding_windows(src.week6(spark, sf), 57)


@query("zscore_clip", f"with {W6}, x as (select *, avg(close) over w as mean, stddev_pop(close) over w as std, count(*) over w as n from c window w as (partition by symbol order by ts rows between 51 preceding and current row)), z as (select *, least(greatest((close - mean) / (std + 1e-5), -5), 5) as z from x where n = 52) select symbol, {T}, {o.r('mean')}, {o.r('std')}, {o.r('z')}, {o.r('z * (std + 1e-5) + mean', 'back')} from z")
def _(spark, sf):
    return features.zscore(src.week6(spark, sf), 52).select("symbol", "ts", "mean", "std", "z", "back")


def _zs(past: bool) -> str:
    n = 8 if past else 10
    stat = lambda f, c: f"{f}({c}) over (partition by symbol order by ts rows between current row and {n - 1} following)"
    return f"""with {W6}, k as (select symbol, ts, close, volume, row_number() over (partition by symbol order by ts) as rn from c),
    b as (select symbol, ts as start_ts, rn, {stat('avg', 'close')} as mc, {stat('stddev_pop', 'close')} as sc, {stat('avg', 'volume')} as mv, {stat('stddev_pop', 'volume')} as sv, count(*) over (partition by symbol order by ts rows between current row and 9 following) as n from k)
    select b.symbol, {o.d('start_ts')}, (k.rn - b.rn)::bigint as step, {o.r('least(greatest((k.close - mc) / (sc + 1e-5), -5), 5)', 'close')}, {o.r('least(greatest((k.volume - mv) / (sv + 1e-5), -5), 5)', 'volume')} from b join k on k.symbol = b.symbol and k.rn between b.rn and b.rn + 9 where n = 10"""


@query("window_zscores", _zs(True))
def _(spark, sf):
    return features.window_zscores(src.week6(spark, sf), 8, 2, ("close", "volume")).drop("ts")


@query("window_zscores_with_future", _zs(False))
def _(spark, sf):
    return features.window_zscores(src.week6(spark, sf), 8, 2, ("close", "volume"), past_only=False).drop("ts")


@query("validation_index", "select vec_id as idx, vec_id % 301 as start_index from embeddings")
def _(spark, sf):
    v = src.read(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"))
    return v.withColumn("start_index", features.validation_index(F.col("idx"), F.lit(301)))


@query("time_features", "select event_id, minute(ts) as minute, hour(ts) as hour, isodow(ts) - 1 as weekday, day(ts) as day, month(ts) as month from events")
def _(spark, sf):
    return features.time_features(src.read(spark, sf, "events")).select("event_id", "minute", "hour", "weekday", "day", "month")


@query("split_by_ratio", f"with {W6}, x as (select symbol, ts, row_number() over (partition by symbol order by ts) - 1 as i, count(*) over (partition by symbol) as n from c) select symbol, {T}, case when i < floor(n * 0.7 + 1e-9) then 'train' when i < floor(n * 0.85 + 1e-9) then 'validation' else 'test' end as split from x")
def _(spark, sf):
    return features.split_by_ratio(src.week6(spark, sf), 0.7, 0.15).select("symbol", "ts", "split")


_RANGES = {"train": ("1995-01-01", "1998-12-31"), "validation": ("1998-06-01", "2000-01-31"), "test": ("1999-10-01", "2001-12-31")}


@query("split_by_time", f"with {W6} " + " union all ".join(f"select symbol, {T}, '{k}' as split from c where ts between date '{a}' and date '{b}'" for k, (a, b) in _RANGES.items()))
def _(spark, sf):
    return features.split_by_time(src.week6(spark, sf), _RANGES).select("symbol", "ts", "split")


@query("train_index_hash", "select vec_id as idx, e as epoch, (vec_id * 9973 + (e + 1) * 104729) % 301 as start_index from embeddings, range(0, 3) t(e)")
def _(spark, sf):
    v = src.read(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("epoch"))
    return v.withColumn("start_index", features.index_hash(F.col("idx"), F.col("epoch"), F.lit(301)))


@query("future_trading_days", f"with {W6}, l as (select symbol, max(ts) as last_ts from c group by symbol), h as (select distinct cast(o_orderdate as date) as holiday from orders where day(o_orderdate) = 1), x as (select symbol, last_ts, unnest(generate_series(last_ts + interval 1 day, last_ts + interval 60 day, interval 1 day))::date as day from l), y as (select *, row_number() over (partition by symbol, last_ts order by day) as step from x where isodow(day) < 6 and day not in (select holiday from h)) select symbol, {o.d('last_ts')}, {o.d('day')}, step from y where step <= 10")
def _(spark, sf):
    last = src.week6(spark, sf).groupBy("symbol").agg(F.max("ts").alias("last_ts"))
    hol = src.read(spark, sf, "orders").select(F.to_date("o_orderdate").alias("holiday")).filter(F.dayofmonth("holiday") == 1).distinct()
    return features.business_days(last, "last_ts", 10, hol).select("symbol", "last_ts", "day", "step")


@query("fixed_interval_steps", f"with c as ({o.HOUR5}), x as (select symbol, row_number() over (partition by symbol order by ts) as rn, ts, max(ts) over (partition by symbol) as last from c), g as (select symbol, max(last) as last, epoch(max(ts) filter (rn = 2) - max(ts) filter (rn = 1)) as gap from x group by symbol) select symbol, step, strftime(last + to_seconds((gap * step)::bigint), '%Y-%m-%d %H:%M:%S') as ts from g, range(1, 6) t(step) where gap is not null")
def _(spark, sf):
    return features.fixed_steps(src.hour5(spark, sf), 5)


@query("profile", f"with {W6}, x as (select *, row_number() over w as rn, epoch(ts::timestamp - lag(ts::timestamp) over w) as gap from c window w as (partition by symbol order by ts)) select symbol, count(*) as n_rows, {o.d('min(ts)', 'first_ts')}, {o.d('max(ts)', 'last_ts')}, {o.r('min(low)', 'min_price')}, {o.r('max(high)', 'max_price')}, {o.r('avg(gap) filter (rn <= 10)', 'spacing')}, 'days' as label from x group by symbol")
def _(spark, sf):
    return features.profile(src.week6(spark, sf))


@query("shards", "select c_name as name, ntile(7) over (order by c_custkey) - 1 as shard_index from customer")
def _(spark, sf):
    return features.contiguous_shards(src.read(spark, sf, "customer"), "c_custkey", 7).select(F.col("c_name").alias("name"), "shard_index")


_CASES = """m as (select ntile(7) over (order by c_custkey) - 1 as shard_index, c_name as s, c_nationkey from customer),
  k as (select 'good' as run, shard_index, s, 'r1' as rev from m union all select 'renumbered', case when shard_index = 6 then 7 else shard_index end, s, 'r1' from m union all select 'revised', shard_index, s, case when shard_index = 3 then 'r2' else 'r1' end from m
    union all select 'overlapping', shard_index, s, 'r1' from m union all select 'overlapping', 0, s, 'r1' from m where shard_index = 6 and c_nationkey = 1)"""


@query("shard_manifest_check", f"""with {_CASES}, g as (select run, count(distinct shard_index) as shards, count(distinct shard_index) as indexes, min(shard_index) as lo, max(shard_index) as hi, case when count(distinct rev) > 1 then 'model_revision' else '' end as differing, count(*) - count(distinct s) as overlap from k group by run)
  select *, shards = 7 and lo = 0 and hi = 6 and differing = '' and overlap = 0 as compatible from g""")  # fmt: skip
def _(spark, sf):
    s = features.contiguous_shards(src.read(spark, sf, "customer"), "c_custkey", 7)
    m = s.withColumn("rev", F.lit("r1"))
    runs = {
        "good": m, "renumbered": m.withColumn("shard_index", F.when(F.col("shard_index") == 6, 7).otherwise(F.col("shard_index"))),
        "revised": m.withColumn("rev", F.when(F.col("shard_index") == 3, "r2").otherwise("r1")), "overlapping": m.union(m.filter("shard_index = 6 and c_nationkey = 1").withColumn("shard_index", F.lit(0))),
    }
    out = None
    for run, rows in runs.items():
        g = rows.groupBy("shard_index").agg(F.collect_list("c_name").alias("symbols"), F.max("rev").alias("model_revision"))
        g = g.withColumns({c: F.lit("a") for c in features.SAME if c != "model_revision"})
        row = features.shard_check(g, 7).withColumn("run", F.lit(run))
        out = row if out is None else out.unionByName(row)
    return out


# ---------------------------------------------------------------- tokens

WHOLE, DIM = 64, 16  # entries of a vector; bits of a code
_LOGITS = f"v as (select vec_id, embedding::double[] as e from embeddings), lg as (select vec_id, unnest(range(0, {WHOLE})) as i, unnest(e) as logit from v), sm as (select *, exp(logit - max(logit) over (partition by vec_id)) as ex from lg), pr as (select *, ex / sum(ex) over (partition by vec_id) as p from sm)"


def logits(spark, sf):
    return src.read(spark, sf, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "logit"))


@query("softmax_topk", f"with {_LOGITS} select vec_id, i, {o.r('p')} from pr qualify rank() over (partition by vec_id order by logit desc) <= 5")
def _(spark, sf):
    return tokens.top_k(tokens.softmax(logits(spark, sf), "vec_id", "logit"), "vec_id", "logit", 5).select("vec_id", "i", "p")


_WARM = "wm as (select vec_id, i, exp((logit - max(logit) over (partition by vec_id)) / 0.6) as ex from lg)"


@query("softmax_temperature", f"with {_LOGITS}, {_WARM} select vec_id, i, {o.r('ex / sum(ex) over (partition by vec_id)', 'p')} from wm")
def _(spark, sf):
    return tokens.softmax(logits(spark, sf), "vec_id", "logit", 0.6).select("vec_id", "i", "p")


@query("softmax_topp", f"with {_LOGITS}, b as (select *, coalesce(sum(p) over (partition by vec_id order by logit desc, i rows between unbounded preceding and 1 preceding), 0) as mass_before from pr) select vec_id, i, {o.r('p')} from b where mass_before <= 0.5")
def _(spark, sf):
    return tokens.top_p(logits(spark, sf), "vec_id", "logit", 0.5, "i").select("vec_id", "i", "p")


@query("greedy_token", f"with {_LOGITS} select vec_id, arg_max(i, (logit, -i)) as token from lg group by vec_id")
def _(spark, sf):
    return logits(spark, sf).groupBy("vec_id").agg(F.max_by("i", F.struct("logit", -F.col("i"))).alias("token"))


@query("sampled_token", f"with {_LOGITS}, u as (select *, sum(p) over (partition by vec_id order by i rows unbounded preceding) as cdf, ('0x' || substr(sha256('7:' || vec_id), 1, 8))::ubigint / 4294967296.0 as u from pr) select vec_id, coalesce(min(i) filter (cdf > u), {WHOLE - 1}) as token from u group by vec_id")
def _(spark, sf):
    u = tokens.seed_of(7, F.col("vec_id").cast("string")) / 4294967296.0
    return tokens.draw(tokens.softmax(logits(spark, sf), "vec_id", "logit"), "vec_id", "i", u)


@query("ensemble_mean", f"with {_LOGITS} select i as step, {o.r('avg(logit)', 'mean')} from lg group by i")
def _(spark, sf):
    return logits(spark, sf).groupBy(F.col("i").alias("step")).agg(F.avg("logit").alias("mean"))


_GROUPS = f"""v as (select vec_id, embedding::double[] as e from embeddings), nrm as (select *, greatest(sqrt(list_sum(list_transform(e, lambda x: x * x))), 1e-12) as nn from v),
  tok as (select vec_id, g, e[g * {DIM} + 1:(g + 1) * {DIM}] as part, list_sum(list_transform(e[g * {DIM} + 1:(g + 1) * {DIM}], lambda x, i: case when x / nn > 0 then power(2, i - 1) else 0 end))::bigint as token from nrm, range(0, {WHOLE // DIM}) r(g))"""


def whole_vectors(spark, sf):
    v = src.read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return v.select("vec_id", tokens.quantise(tokens.l2_normalise(F.col("e")), WHOLE).alias("q"))


def group_tokens(spark, sf):
    """Codes of ``DIM`` bits over the whole vector."""
    parts = whole_vectors(spark, sf).select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(WHOLE // DIM - 1))).alias("g"), "q").withColumn("q", F.slice("q", F.col("g") * DIM + 1, F.lit(DIM)))
    return parts.withColumn("token", tokens.bits_to_index(F.col("q")))


@query("bsq_tokens", f"with {_GROUPS} select vec_id, g, token from tok")
def _(spark, sf):
    return group_tokens(spark, sf).select("vec_id", "g", "token")


@query("bsq_roundtrip", f"with {_GROUPS} select vec_id, g, array_to_string(list_transform(part, lambda x: case when x > 0 then '+' else '-' end), '') as signs, round(list_sum(list_transform(part, lambda x: case when x > 0 then 1 else -1 end)) / sqrt({WHOLE}), 6) + 0.0 as total from tok")
def _(spark, sf):
    t = group_tokens(spark, sf).withColumn("again", tokens.index_to_vector(F.col("token"), DIM, WHOLE))
    signs = F.array_join(F.transform("again", lambda x: F.when(x > 0, "+").otherwise("-")), "")
    return t.select("vec_id", "g", signs.alias("signs"), F.aggregate("again", F.lit(0.0), lambda a, x: a + x).alias("total"))


LOW = 24


@query("half_tokens", f"""with {_GROUPS.split('tok as')[0].rstrip().rstrip(',')} select vec_id, list_sum(list_transform(e[1:{LOW}], lambda x, i: case when x > 0 then power(2, i - 1) else 0 end))::bigint as first, list_sum(list_transform(e[{LOW + 1}:{WHOLE}], lambda x, i: case when x > 0 then power(2, i - 1) else 0 end))::bigint as rest,
  array_to_string(list_transform(e, lambda x: case when x > 0 then '+' else '-' end), '') as signs from nrm""")  # fmt: skip
def _(spark, sf):
    first, rest = tokens.half_indexes(F.col("q"), LOW, WHOLE)
    t = whole_vectors(spark, sf).select("vec_id", first.alias("first"), rest.alias("rest"))
    back = tokens.halves_to_vector(F.col("first"), F.col("rest"), LOW, WHOLE)
    return t.withColumn("signs", F.array_join(F.transform(back, lambda x: F.when(x > 0, "+").otherwise("-")), ""))


@query("token_split", f"with {_GROUPS} select vec_id, g, token >> 8 as high, token & 255 as low from tok")
def _(spark, sf):
    high, low = tokens.split_token(F.col("token"), 8)
    return group_tokens(spark, sf).select("vec_id", "g", high.alias("high"), low.alias("low"))


@query("codebook_entropy", f"with {_GROUPS}, g as (select token as code, count(*) as n from tok group by 1), p as (select n, n / (select sum(n) from g) as p from g) select count(*) as used_codes, sum(n)::bigint as total, {o.r('-sum(p * ln(p + 1e-8))', 'entropy')}, {o.r(f'-sum(p * ln(p + 1e-8)) / ln({1 << DIM})', 'share')} from p")
def _(spark, sf):
    return tokens.codebook(group_tokens(spark, sf).withColumn("code", F.col("token")), "code", 1 << DIM)


@query("time_embedding", "select event_id, h as place, round(case when h % 2 = 0 then sin(hour(ts) * exp(h * -ln(10000.0) / 8)) else cos(hour(ts) * exp((h - 1) * -ln(10000.0) / 8)) end + case when h % 2 = 0 then sin((isodow(ts) - 1) * exp(h * -ln(10000.0) / 8)) else cos((isodow(ts) - 1) * exp((h - 1) * -ln(10000.0) / 8)) end, 6) + 0.0 as value from events, range(0, 8) t(h)")
def _(spark, sf):
    e = src.read(spark, sf, "events").select("event_id", F.hour("ts").cast("double").alias("h"), F.weekday("ts").cast("double").alias("w"))
    both = tokens.add_vectors(tokens.sinusoid(F.col("h"), 8), tokens.sinusoid(F.col("w"), 8))
    return e.select("event_id", F.posexplode(both).alias("place", "value"))


@query("soft_entropy", f"""with {_GROUPS}, pb as (select vec_id, list_transform(e, lambda x: 1 / (1 + exp(-4 / sqrt({WHOLE}) * (x / nn)))) as p from nrm),
  own as (select avg(-list_sum(list_transform(p, lambda x: x * ln(x + 1e-8) + (1 - x) * ln(1 - x + 1e-8)))) as sample_entropy from pb),
  ms as (select g, code, avg(list_product(list_transform(range(0, 4), lambda i: case when (code >> i) % 2 = 1 then p[g * 4 + i + 1] else 1 - p[g * 4 + i + 1] end))) as m from pb, range(0, {WHOLE // 4}) a(g), range(0, 16) b(code) group by g, code),
  bk as (select -sum(m * ln(m + 1e-8)) as codebook_entropy from ms) select {o.r('sample_entropy')}, {o.r('codebook_entropy')}, {o.r('sample_entropy - codebook_entropy', 'gain')} from own, bk""")  # fmt: skip
def _(spark, sf):
    v = src.read(spark, sf, "embeddings").select(tokens.l2_normalise(F.col("embedding").cast("array<double>")).alias("v"))
    return tokens.soft_entropy(v, "v", WHOLE, WHOLE // 4)


@query("cohort_seed", "select distinct strftime(o_orderdate, '%Y-%m-%d') as day, ('0x' || substr(sha256('20260802:' || strftime(o_orderdate, '%Y-%m-%d')), 1, 8))::ubigint::bigint as seed from orders")
def _(spark, sf):
    d = src.read(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).distinct()
    return d.withColumn("seed", tokens.seed_of(20260802, F.col("day")))


# ---------------------------------------------------------------- reshape, joins, parsing


#: The instruments of ``week6`` (return flag and line status): a pivot needs its columns beforehand.
SYMBOLS = [f + t for f in "ANR" for t in "FO"]


@query("pivot_signals", f"with {W6} select {T}, " + ", ".join(o.r(f"avg(close) filter (symbol = '{s}')", s) for s in SYMBOLS) + " from c group by ts")
def _(spark, sf):
    return src.week6(spark, sf).groupBy("ts").pivot("symbol", SYMBOLS).avg("close")


@query("pivot_fields", f"with {W6} select symbol, {T}, {', '.join(o.r(c) for c in ('open', 'high', 'low', 'close'))} from c")
def _(spark, sf):
    long = src.week6(spark, sf).unpivot(["symbol", "ts"], list(PRICES), "field", "value")
    return long.groupBy("symbol", "ts").pivot("field", list(PRICES)).agg(F.first("value"))


@query("unpivot_fields", f"with {W6} " + " union all ".join(f"select symbol, {T}, '{f}' as field, {o.r(f, 'value')} from c" for f in ("open", "high", "low", "close")))
def _(spark, sf):
    return src.week6(spark, sf).unpivot(["symbol", "ts"], ["open", "high", "low", "close"], "field", "value")


@query("hist_pred_outer", f"with {W6}, h as (select symbol, ts, close from c where ts < date '2000-06-01'), p as (select symbol, ts, close * 1.01 as predicted from c where ts >= date '2000-01-01') select symbol, {T}, {o.r('close')}, {o.r('predicted')}, {o.r('coalesce(close, predicted)', 'combined')} from h full outer join p using (symbol, ts)")
def _(spark, sf):
    c = src.week6(spark, sf)
    h = c.filter(F.col("ts") < "2000-06-01").select("symbol", "ts", "close")
    p = c.filter(F.col("ts") >= "2000-01-01").select("symbol", "ts", (F.col("close") * 1.01).alias("predicted"))
    return h.join(p, ["symbol", "ts"], "full_outer").withColumn("combined", F.coalesce("close", "predicted"))


@query("future_or_all", f"with {W6}, h as (select symbol, max(ts) as last_ts from c where ts < date '2000-01-01' or symbol = 'NO' group by symbol), x as (select c.*, c.ts > last_ts as later, max((c.ts > last_ts)::int) over (partition by c.symbol) as any_later from c join h using (symbol)) select symbol, {T}, {o.r('close')} from x where later or any_later = 0")
def _(spark, sf):
    c = src.week6(spark, sf)
    h = c.filter((F.col("ts") < "2000-01-01") | (F.col("symbol") == "NO")).groupBy("symbol").agg(F.max("ts").alias("last_ts"))
    x = c.join(h, "symbol").withColumn("later", F.col("ts") > F.col("last_ts"))
    x = x.withColumn("any_later", F.max(F.col("later").cast("int")).over(Window.partitionBy("symbol")))
    return x.filter("later or any_later = 0").select("symbol", "ts", "close")


@query("trade_pairs", f"with {_SIG}, t as (select symbol, ts, close, raw_signal, row_number() over (partition by symbol, raw_signal order by ts) as k from s2 where raw_signal <> 0) select b.symbol, b.k as ordinal, {o.d('b.ts', 'buy_ts')}, {o.d('s.ts', 'sell_ts')}, {o.r('s.close - b.close', 'profit')} from t b join t s on b.symbol = s.symbol and b.k = s.k where b.raw_signal = 1 and s.raw_signal = -1")
def _(spark, sf):
    s = indicators.signals(src.week6(spark, sf), 0.05).filter("raw_signal <> 0").withColumn("ordinal", F.row_number().over(Window.partitionBy("symbol", "raw_signal").orderBy("ts")))
    b = s.filter("raw_signal = 1").select("symbol", "ordinal", F.col("ts").alias("buy_ts"), F.col("close").alias("b"))
    x = s.filter("raw_signal = -1").select("symbol", "ordinal", F.col("ts").alias("sell_ts"), F.col("close").alias("s"))
    return b.join(x, ["symbol", "ordinal"]).select("symbol", "ordinal", "buy_ts", "sell_ts", (F.col("s") - F.col("b")).alias("profit"))


@query("jsonp_klines", """select event_id, event_type as code, strftime(ts, '%Y-%m-%d') as day, round(value, 4) + 0.0 as open, round(value + 1, 4) + 0.0 as close, round(value + 2, 4) + 0.0 as high, round(value - 1, 4) + 0.0 as low, case when event_id % 3 = 0 then 0.0 else event_id::double end as volume from events""")
def _(spark, sf):
    e = src.read(spark, sf, "events")
    tail = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit(","), F.col("event_id").cast("string")))
    body = F.format_string('cb123({"data":{"code":"%s","klines":["%s,%.4f,%.4f,%.4f,%.4f%s"]}});', F.col("event_type"), F.date_format("ts", "yyyy-MM-dd"), *[F.col("value") + k for k in (0, 1, 2, -1)], tail)
    return ps.klines(e.select("event_id", body.alias("body")), "body").select("event_id", "code", "day", "open", "close", "high", "low", "volume")


@query("exchange_code", "select p_partkey, case when substr(p_partkey::varchar, 1, 1) in ('0', '2', '3') then 'SZ' else 'SH' end as exchange from part")
def _(spark, sf):
    return src.read(spark, sf, "part").select("p_partkey", ps.exchange(F.col("p_partkey").cast("string")).alias("exchange"))


@query("ticker_suffix", "select p_partkey, upper(trim(p_brand)) as symbol, upper(trim(p_brand)) || '.IS' as ticker from part")
def _(spark, sf):
    p = src.read(spark, sf, "part").withColumn("ticker", ps.with_suffix(ps.with_suffix(F.col("p_brand"), ".IS"), ".IS"))
    return p.select("p_partkey", ps.without_suffix(F.col("ticker"), ".IS").alias("symbol"), "ticker")


@query("reason_counts", "with s as (select 'arm=' || event_type || ';method=m' || (user_id % 3) as detail, case when event_id % 4 = 0 then 'invalid_model_output' else 'other' end as code from events) select regexp_extract(detail, 'arm=([^;]+)', 1) as arm, regexp_extract(detail, 'method=([^;]+)', 1) as method, count(*) as n from s where code = 'invalid_model_output' group by all")
def _(spark, sf):
    s = src.read(spark, sf, "events").select(F.concat(F.lit("arm="), "event_type", F.lit(";method=m"), (F.col("user_id") % 3).cast("string")).alias("detail"), F.when(F.col("event_id") % 4 == 0, "invalid_model_output").otherwise("other").alias("code"))
    return ps.reason_counts(s, "detail", "code", "invalid_model_output")


@query("sector_match", "select p_partkey, s as sector from part join (values ('STEEL'), ('BRASS'), ('TIN')) v(s) on contains(p_type, s) or (s = 'TIN' and p_partkey % 50 = 0)")
def _(spark, sf):
    p = src.read(spark, sf, "part")
    return ps.sectors(p, "p_type", ["STEEL", "BRASS", "TIN"], {"TIN": F.col("p_partkey") % 50 == 0}).select("p_partkey", "sector")


COMPOSITE = """least(greatest((case when uptrend then 1 + 0.08 * strength else 1 + 0.04 * (strength - 0.5) end) * (case when symbol < 'N' then 1 + 0.06 * strength + least(0.01 * 2, 0.03) else 1 + 0.02 * (strength - 0.5) end)
  * (1 + 0.06 * (0.7 - 0.5)) * (1 + 0.015 * 2) * (1 + 0.08 * (strength - 0.5)), 0.85), 1.15)"""


def scored(spark, sf):
    """Bars with their composite factor; symbols before N stand for a hot sector."""
    t = indicators.trend_strength(src.week6(spark, sf))
    s = F.col("strength")
    return t.withColumn("factor", ps.composite(F.col("uptrend"), s, hot=F.col("symbol") < "N", resonance=s, count=F.lit(2), macro=F.lit(0.7), cuts=F.lit(2), fundamentals=s))


@query("composite_factor", f"with {_STRENGTH} select symbol, {T}, {o.r(COMPOSITE, 'factor')} from st")
def _(spark, sf):
    return scored(spark, sf).select("symbol", "ts", "factor")


@query("axis_interval", f"with {W6}, g as (select symbol, max(high) - min(low) as span from c group by symbol union all select symbol || ' scaled ' || k, (max(high) - min(low)) * power(10, k - 4) from c, range(0, 5) t(k) group by symbol, k union all select 'flat', 0.0) select symbol, {o.r('span')}, case when span <= 0 then 1.0 "
  + " ".join(f"when span < {b} then {x}" for b, x in ps.AXIS_STEPS) + " else 100.0 end::double as step from g")
def _(spark, sf):
    g = src.week6(spark, sf).groupBy("symbol").agg((F.max("high") - F.min("low")).alias("span"))
    more = g.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(F.concat_ws(" ", "symbol", F.lit("scaled"), F.col("k").cast("string")).alias("symbol"), (F.col("span") * F.pow(F.lit(10.0), F.col("k") - 4)).alias("span"))
    flat = spark.createDataFrame([("flat", 0.0)], "symbol string, span double")
    return g.union(more).union(flat).withColumn("step", ps.axis_step(F.col("span")))


_SECTORS = "(values " + ", ".join(f"('{n}', {m}, {str(a).lower()})" for n, m, a in ps.SECTORS) + ") v(n, m, a)"
_INDUSTRY = "case p_partkey % 7 when 0 then '机器人与半导体' when 1 then '医药制造' when 2 then '新能源' when 3 then '人工智能' else 'other' end"
_CODE = "case when p_partkey % 11 = 0 then '600580' when p_partkey % 13 = 0 then '300207' else 'x' end"


@query("sector_resonance", f"""with p as (select p_partkey, {_INDUSTRY} as industry, {_CODE} as code from part), h as (select p_partkey, n, m, a from p join {_SECTORS} on contains(industry, n) or (code = '600580' and n in ('机器人', '低空经济')) or (code = '300207' and n = '新能源')),
  g as (select p_partkey, count(*) as k, avg(m) as r, bool_or(a) as hot, arg_max(n, m) as main from h group by p_partkey)
  select p_partkey, coalesce(k, 0) as sector_count, {o.r('coalesce(r, 0.5)', 'resonance')}, coalesce(hot, false) as hot, main as main_sector from p left join g using (p_partkey)""")  # fmt: skip
def _(spark, sf):
    p = src.read(spark, sf, "part").select("p_partkey", F.expr(_INDUSTRY).alias("industry"), F.expr(_CODE).alias("code"))
    return ps.resonance(p, "p_partkey", "code", "industry")


@query("lookup_defaults", "select p_partkey, coalesce(n_name, 'unknown') as sector, case when n_name is null then 0.5 else n_regionkey / 10.0 end::double as score from part left join nation on n_nationkey = p_size")
def _(spark, sf):
    n = src.read(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("p_size"), F.col("n_name").alias("sector"), (F.col("n_regionkey") / 10).alias("score"))
    return ps.with_defaults(src.read(spark, sf, "part").select("p_partkey", "p_size"), n, "p_size", {"sector": "unknown", "score": 0.5}).select("p_partkey", "sector", "score")


@query("epoch_samples", f"""with {W6}, l as (select symbol, greatest(count(*) - 57 + 1, 0) as starts from c group by symbol), nb as (select symbol, starts, sum(starts) over (order by symbol) as hi from l where starts > 0),
  d as (select i as sample, (('0x' || substr(sha256('5:2:' || i), 1, 12))::ubigint % (select sum(starts) from l)::ubigint)::bigint as nth from range(0, 500) t(i)) select sample, symbol, (nth - (hi - starts))::bigint as start_index from d join nb on nth >= hi - starts and nth < hi""")  # fmt: skip
def _(spark, sf):
    return features.sample_pairs(src.week6(spark, sf).groupBy("symbol").agg(F.count("*").alias("n_rows")), epoch=2, seed=5, n=500, width=57)


_GAPS = [(f, f"abs(next_{f} - {f})") for f in PRICES]


@query("continuity_gap", f"with {W6}, x as (select *, " + ", ".join(f"lead({f}) over (partition by symbol order by ts) as next_{f}" for f in PRICES) + f" from c) select symbol, {T}, " + ", ".join(f"{o.r(g, f + '_gap')}, {o.r(f'{g} / nullif(abs(next_{f}), 0) * 100', f + '_gap_pct')}" for f, g in _GAPS) + " from x where next_close is not null")
def _(spark, sf):
    x = src.week6(spark, sf).withColumns({f"next_{f}": F.lead(f).over(indicators.by_time()) for f in PRICES}).filter("next_close is not null")
    return x.select("symbol", "ts", *[c for f in PRICES for c in gaps(F.col(f), F.col(f"next_{f}"), f)])


@query("yearly_stats", f"with {W6} select symbol, year(ts) as year, count(*) as bars, {o.r('arg_min(open, ts)', 'first_open')}, {o.r('arg_max(close, ts)', 'last_close')}, {o.r('max(high)', 'high')}, {o.r('min(low)', 'low')}, {o.r('sum(volume)', 'volume')} from c group by symbol, year(ts)")
def _(spark, sf):
    return src.week6(spark, sf).groupBy("symbol", F.year("ts").alias("year")).agg(
        F.count("*").alias("bars"), F.min_by("open", "ts").alias("first_open"), F.max_by("close", "ts").alias("last_close"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume"),
    )
