"""Queries of position folds, portfolio scores, plans and summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wickline.operators import evaluation as ev
from wickline.operators import indicators
from wickline.operators import portfolio as pf
from wickline.operators import tokens as tk
from wickline.plans import oracle as o
from wickline.plans.analytics import _GROUPS, _HIST, _SIG, _STRENGTH, COMPOSITE, PRICES, T, W6, WHOLE, halves, scored, whole_vectors
from wickline.plans.evaluation import ARGS6, HORIZON, parts
from wickline.plans.registry import query
from wickline.sources import candles as src


def _positions(keep: bool) -> str:
    left = "l.cash" if keep else "0.0"
    sell, buy = "l.held <> 0 and n.sg = 0", "l.held = 0 and n.sg <> 0 and floor(l.cash / n.close) > 0"
    return f"""{_SIG}, n as (select symbol, ts, close, raw_signal as sg, row_number() over (partition by symbol order by ts) as rn from s2),
    l as (select symbol, ts, rn, 100000.0::double as cash, 0::bigint as held, close as price, cast(null as varchar) as action from n where rn = 1 union all
      select n.symbol, n.ts, n.rn, case when {sell} then l.held * n.close + {left} when {buy} then l.cash - floor(l.cash / n.close) * n.close else l.cash end,
        case when {sell} then 0 when {buy} then floor(l.cash / n.close)::bigint * n.sg else l.held end, n.close, case when {sell} then 'SELL' when {buy} then 'BUY' end from l join n on n.symbol = l.symbol and n.rn = l.rn + 1)"""


_POSITIONS = f"select symbol, {T}, round(cash + held * price, 3) + 0.0 as value, held as position, action from l"


def backtested(spark, sf, keep_cash=True):
    return pf.signal_backtest(indicators.signals(src.week6(spark, sf), 0.05), "raw_signal", keep_cash=keep_cash)


@query("signal_backtest", f"with recursive {_positions(True)} {_POSITIONS}")
def _(spark, sf):
    return backtested(spark, sf).select("symbol", "ts", F.round("value", 3).alias("value"), "position", "action")


@query("signal_backtest_forgetful", f"with recursive {_positions(False)} {_POSITIONS}")
def _(spark, sf):
    return backtested(spark, sf, keep_cash=False).select("symbol", "ts", F.round("value", 3).alias("value"), "position", "action")


_PERF = f"""{_positions(True)}, v as (select *, cash + held * price as value from l), r as (select *, case when lag(value) over w > 0 then value / lag(value) over w - 1 else 0 end as ret from v window w as (partition by symbol order by ts)),
  g0 as (select *, product(1 + ret) over (partition by symbol order by ts rows unbounded preceding) as growth from r), g1 as (select *, growth / max(growth) over (partition by symbol order by ts rows unbounded preceding) - 1 as dd from g0),
  g as (select symbol, count(*) as n, arg_max(value, ts) as final_value, stddev_samp(ret) as sd, min(dd) as max_drawdown, count(action) as trades from g1 group by symbol),
  k as (select symbol, action, price, row_number() over (partition by symbol, action order by ts) as k from l where action is not null),
  t as (select b.symbol, avg((s.price > b.price)::int::double) as win_rate, avg((s.price - b.price) / b.price) as mean_trade_return from k b join k s on s.symbol = b.symbol and s.k = b.k and b.action = 'BUY' and s.action = 'SELL' group by b.symbol),
  x as (select *, final_value / 100000.0 - 1 as total_return, power(final_value / 100000.0, 52.0 / n) - 1 as annual_return, coalesce(sd, 0) * sqrt(52.0) as volatility from g left join t using (symbol))"""


@query("backtest_metrics", f"with recursive {_PERF} select symbol, round(final_value, 3) + 0.0 as final_value, {o.r('total_return')}, {o.r('annual_return')}, {o.r('volatility')}, {o.r('coalesce((annual_return - 0.03) / nullif(volatility, 0), 0)', 'sharpe')}, {o.r('max_drawdown')}, {o.r('coalesce(win_rate, 0)', 'win_rate')}, {o.r('coalesce(mean_trade_return, 0)', 'mean_trade_return')}, trades from x")
def _(spark, sf):
    return indicators.performance(backtested(spark, sf), periods=52).withColumn("final_value", F.round("final_value", 3))


_SCORES = f"{o.windows(*ARGS6)}, g as (select symbol, candidate_month, method, arg_max(predicted_close, horizon_step) - any_value(history_last_close) as l, avg(predicted_close) - any_value(history_last_close) as m, max(predicted_close) - any_value(history_last_close) as h, min(predicted_close) - any_value(history_last_close) as s from fc where method = 'trend_20' group by all)"


@query("portfolio_scores", f"with {_SCORES} " + " union all ".join(f"select symbol, candidate_month, '{k}' as signal_type, {o.r(c, 'score')} from g" for k, c in (("last", "l"), ("mean", "m"), ("max", "h"), ("min", "s"))))
def _(spark, sf):
    f = ev.baselines(parts(spark, sf)[2], HORIZON).filter("method = 'trend_20'")
    w = f.groupBy("symbol", "candidate_month").agg(F.transform(F.sort_array(F.collect_list(F.struct("horizon_step", "predicted_close"))), lambda x: x.predicted_close).alias("p"), F.max("history_last_close").alias("c"))
    return pf.scores(w, "p", "c")


@query("forecast_plan", f"""with {W6}, g as (select symbol, count(*)::double as n, date_diff('day', min(ts), max(ts))::double as days from c group by symbol), a as (select *, floor(60 * case when days > 0 then n / days else 0.7 end) as ahead from g),
  b as (select *, least(ahead * 3, floor(n * 0.7), n - ahead) as back from a) select symbol, greatest(100, least(back, 400))::bigint as lookback, greatest(20, least(least(ahead, n - back), 120))::bigint as pred_len from b""")  # fmt: skip
def _(spark, sf):
    return pf.forecast_plan(src.week6(spark, sf))


@query("price_band", f"select p_partkey, {o.r('greatest(1.0, p_retailprice * (1 - case when p_partkey % 10 = 0 then 0.25 else 0.3 end))', 'low')}, {o.r('p_retailprice * (1 + case when p_partkey % 10 = 0 then 0.25 else 0.3 end)', 'high')} from part")
def _(spark, sf):
    low, high = pf.price_band(F.col("p_retailprice"), F.col("p_partkey") % 10 == 0)
    return src.read(spark, sf, "part").select("p_partkey", low.alias("low"), high.alias("high"))


@query("factor_applied", f"with {_STRENGTH}, f as (select *, {COMPOSITE} as factor from st) select symbol, {T}, {o.r('close * least(greatest(factor, 0.9), 1.1)', 'close')}, {o.r('volume * (1 + (factor - 1) * 0.3)', 'volume')} from f")
def _(spark, sf):
    return pf.apply_factor(scored(spark, sf), F.col("factor")).select("symbol", "ts", "close", "volume")


@query("outlook", f"""with {_STRENGTH}, f as (select *, {COMPOSITE} as factor, symbol < 'N' as hot from st),
  g as (select *, list_filter([case when strength > 0.6 then 'trend' end, case when hot then 'sector' end, case when strength > 0.6 then 'fundamentals' end], lambda x: x is not null) as dr, list_filter([case when strength < 0.4 then 'trend' end, case when not hot then 'sector' end], lambda x: x is not null) as ri from f)
  select symbol, {T}, case when factor > 1 then 'positive' else 'cautious' end as sentiment, array_to_string(dr, ',') as drivers, array_to_string(ri, ',') as risks, case when len(dr) > len(ri) then 'watch' else 'careful' end as suggestion from g""")  # fmt: skip
def _(spark, sf):
    x = pf.outlook(F.col("factor"), F.col("strength"), F.col("symbol") < "N", F.lit(0.7), F.col("strength"))
    return scored(spark, sf).withColumn("o", x).select("symbol", "ts", "o.*")


@query("buffered_range", f"with {W6}, l as (select ts, row_number() over (order by ts) - 1 as i from (select distinct ts from c)), a as (select greatest(count(*) filter (ts < date '1997-03-05') - 52, 0) as lo, least(count(*) filter (ts <= date '2000-01-15') - 1 + 4, max(i)) as hi from l) select {o.d('min(ts)', 'start_ts')}, {o.d('max(ts)', 'end_ts')} from l, a where i = lo or i = hi")
def _(spark, sf):
    return pf.buffered_range(src.week6(spark, sf).select("ts").distinct(), "1997-03-05", "2000-01-15", 52, 4)


_BITS = "list_transform(e, lambda x: case when x > 0 then 1 else 0 end)"


@query("group_codes", f"with {_GROUPS} select vec_id, array_to_string(list_transform(range(0, {WHOLE // 4}), lambda g: list_sum(list_transform(range(0, 4), lambda k: case when e[g * 4 + k + 1] > 0 then power(2, 3 - k) else 0 end))::bigint), ',') as codes from nrm")
def _(spark, sf):
    return whole_vectors(spark, sf).select("vec_id", F.array_join(pf.group_codes(F.col("q"), WHOLE // 4, 4).cast("array<string>"), ",").alias("codes"))


@query("group_codes_inverse", f"""with {_GROUPS}, b as (select vec_id, range(0, 4) as parts, {_BITS} as b from nrm)
  select vec_id, p as part, list_sum(list_transform(b[p * 16 + 1:p * 16 + 16], lambda x, i: x * power(2, 16 - i)))::bigint as index, array_to_string(list_transform(range(0, 4), lambda g: list_sum(list_transform(b[p * 16 + g * 4 + 1:p * 16 + g * 4 + 4], lambda x, i: x * power(2, 4 - i)))::bigint), ',') as codes from b, range(0, 4) t(p)""")  # fmt: skip
def _(spark, sf):
    codes = pf.group_codes(F.col("q"), WHOLE // 4, 4)
    v = whole_vectors(spark, sf).select("vec_id", codes.alias("codes"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("part"))
    index = v.select("vec_id", "part", tk.codes_to_index(F.slice("codes", F.col("part") * 4 + 1, F.lit(4)), 4).alias("index"))
    return index.withColumn("codes", F.array_join(tk.index_to_codes(F.col("index"), 4, 4).cast("array<string>"), ","))


@query("seeded_sample", "select vec_id, label from embeddings order by sha256('11:' || vec_id), vec_id limit 50")
def _(spark, sf):
    return pf.seeded_sample(src.read(spark, sf, "embeddings"), 11, "vec_id", 50).select("vec_id", "label")


_U = "('0x' || substr(sha256('3:' || symbol || ':' || strftime(ts, '%Y-%m-%d')), 1, 8))::ubigint / 4294967296.0"
_CURRENT = "cu as (select symbol, arg_max(close, ts) as current, avg(volume) as mean_volume from hs group by symbol)"


def forecast_bars(spark, sf):
    """Bars from 2000 on as a forecast, with the last price and the mean volume known before."""
    before, after = halves(spark, sf)
    known = before.groupBy("symbol").agg(F.max_by("close", "ts").alias("current"), F.avg("volume").alias("mean_volume"))
    return after.join(known, "symbol")


def jitter():
    return 0.8 + 0.4 * pf.seeded_uniform(3, F.col("symbol"), F.date_format("ts", "yyyy-MM-dd"))


def _tamed(c: str) -> str:
    return o.r(f"case when abs({c} - current) > current * 0.3 then current * (1 + ({c} / current - 1) * (0.8 + 0.4 * {_U})) else {c} end", c)


@query("tamed_outliers", f"with {W6}, {_HIST}, {_CURRENT} select symbol, {T}, {', '.join(_tamed(c) for c in PRICES)} from fu join cu using (symbol)")
def _(spark, sf):
    return pf.tame_outliers(forecast_bars(spark, sf), jitter()).select("symbol", "ts", *PRICES)


HOLIDAYS = [("2000-05-01", 20, 0.03), ("2000-10-08", 30, 0.02)]
_EFFECT = " * ".join(f"case when ts >= date '{e}' and ts < date '{e}' + interval {d} day then {1 + s} else 1 end" for e, d, s in HOLIDAYS)


@query("after_holidays", f"with {W6}, {_HIST} select symbol, {T}, {', '.join(o.r(f'{c} * {_EFFECT}', c) for c in PRICES)} from fu")
def _(spark, sf):
    return pf.after_holidays(halves(spark, sf)[1], HOLIDAYS).select("symbol", "ts", *PRICES)


@query("jittered_volume", f"with {W6}, {_HIST}, {_CURRENT} select symbol, {T}, {o.r(f'greatest(least(volume * (0.8 + 0.4 * {_U}), mean_volume * 3), mean_volume * 0.3)', 'volume')} from fu join cu using (symbol)")
def _(spark, sf):
    return pf.jitter_volume(forecast_bars(spark, sf), F.col("mean_volume"), jitter()).select("symbol", "ts", "volume")


@query("topk_dropout")
def _(spark, sf):
    w = Window.partitionBy("symbol").orderBy("ts")
    bars = src.week25(spark, sf).withColumn("score", F.col("close") / F.lag("close", 4).over(w) - 1)
    return pf.topk_dropout(bars, topk=8, n_drop=2, hold=2, limit=0.5)
