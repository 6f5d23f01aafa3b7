"""Common table expressions of the oracle SQL."""

LINES = "select l_returnflag || l_linestatus as symbol, cast(date_trunc('{unit}', l_shipdate) as date) as ts, l_extendedprice / l_quantity as px, l_quantity as q, row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as o from lineitem where l_quantity > 0"
BRANDS = "select p_brand as symbol, cast(date_trunc('week', l_shipdate) as date) as ts, l_extendedprice / l_quantity as px, l_quantity as q, row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as o from lineitem join part on l_partkey = p_partkey where l_quantity > 0"
BARS = "select symbol, ts, arg_min(px, o) as open, max(px) as high, min(px) as low, arg_max(px, o) as close, sum(q) as volume from ({trades}) group by symbol, ts"

WEEK6 = BARS.format(trades=LINES.format(unit="week"))
DAY6 = BARS.format(trades=LINES.format(unit="day"))
WEEK25 = BARS.format(trades=BRANDS)
FACTOR25 = "case when ts < date '1998-01-01' then 0.5 when symbol < 'Brand#3' and ts < date '2000-01-01' then 0.8 else 1.0 end"
ARMS25 = f"""select arm || ':' || symbol as symbol, ts, open * f as open, high * f as high, low * f as low, close * f as close, volume, close as raw, close * factor as adj, factor
  from (select *, case when arm = 'adjusted' then factor else 1.0 end as f from (select *, {FACTOR25} as factor from ({WEEK25})), (values ('raw'), ('adjusted')) v(arm))"""
HOUR5 = BARS.format(trades="select event_type as symbol, date_trunc('hour', ts) as ts, value as px, 1.0::double as q, row(ts, event_id) as o from events")


def r(x: str, name: str | None = None) -> str:
    return f"round({x}, 6) + 0.0 as {name or x}"


def d(x: str, name: str | None = None) -> str:
    return f"strftime({x}, '%Y-%m-%d') as {name or x}"


def calendar(bars: str, threshold: float) -> str:
    return f"""c as ({bars}), cal as (select ts, count(*) as symbols from (select distinct symbol, ts from c) group by ts
      having count(*) >= (select ceil(count(distinct symbol) * {threshold} - 1e-12) from c))"""


def cohorts(bars: str, threshold: float, horizon: int) -> str:
    return f"""{calendar(bars, threshold)},
    line as (select ts, strftime(ts, '%Y-%m') as candidate_month, list(ts) over (order by ts rows between 1 following and {horizon} following) as targets from cal),
    coh as (select candidate_month, ts as forecast_origin, coalesce(targets, []) as targets, len(coalesce(targets, [])) = {horizon} as complete from line
      qualify row_number() over (partition by candidate_month order by ts) = 1)"""


def windows(bars: str, threshold: float, horizon: int, lookback: int) -> str:
    return f"""{cohorts(bars, threshold, horizon)},
    num as (select *, row_number() over (partition by symbol order by ts) as rn from c),
    h as (select symbol, ts, close, rn as history_rows, count(*) over f as context_rows, min(ts) over f as context_start,
        lag(close, 19) over (partition by symbol order by ts) as first20, min(close) over g as low20, avg(close) over g as mean20, regr_slope(close, rn::double) over g as slope20
      from num window f as (partition by symbol order by ts rows between {lookback - 1} preceding and current row), g as (partition by symbol order by ts rows between 19 preceding and current row)),
    w as (select h.*, close as history_last_close, candidate_month, forecast_origin, targets from h join coh on h.ts = forecast_origin where complete and history_rows >= {lookback}),
    st as (select symbol, candidate_month, forecast_origin, history_last_close, unnest(targets) as target_ts, unnest(range(1, {horizon} + 1)) as horizon_step from w),
    act as (select st.*, c.close as actual_close from st left join c on c.symbol = st.symbol and c.ts = target_ts),
    f0 as (select w.*, unnest(range(1, {horizon} + 1)) as horizon_step, case when first20 > 0 and history_last_close > 0 then power(history_last_close / first20, 1.0/19) - 1 end as rate from w),
    fl as (select symbol, candidate_month, forecast_origin, history_last_close, horizon_step, 'last_close' as method, history_last_close as predicted_close from f0
      union all select symbol, candidate_month, forecast_origin, history_last_close, horizon_step, 'momentum_20', history_last_close * power(1 + rate, horizon_step) from f0
      union all select symbol, candidate_month, forecast_origin, history_last_close, horizon_step, 'trend_20', case when history_rows >= 20 then mean20 + slope20 * (9.5 + horizon_step) end from f0),
    fc as (select *, min(case when predicted_close is not null and not isnan(predicted_close) and predicted_close > 0 then 1 else 0 end) over (partition by symbol, candidate_month, forecast_origin, method) = 1 as valid from fl),
    fact as (select fc.* exclude (valid), act.target_ts, act.actual_close from fc join act using (symbol, candidate_month, forecast_origin, horizon_step) where valid
      qualify min((actual_close is not null)::int) over (partition by symbol, candidate_month, forecast_origin, method) = 1)"""


def metrics(bars: str, threshold: float, horizon: int, lookback: int) -> str:
    return f"{windows(bars, threshold, horizon, lookback)}, {scores('fact')}"


def scores(fact: str) -> str:
    return f"""m0 as (select symbol, candidate_month, forecast_origin, method, avg(abs(predicted_close - actual_close)) as mae, sqrt(avg((predicted_close - actual_close)^2)) as rmse,
        arg_max(predicted_close, horizon_step) as p, arg_max(actual_close, horizon_step) as a, arg_max(target_ts, horizon_step) as final_target_ts, arg_min(history_last_close, horizon_step) as history_last_close from {fact} group by all),
    m1 as (select *, abs(p - a) as final_abs_error, abs(p - a) / nullif(abs(a), 0) as final_ape, p / nullif(history_last_close, 0) - 1 as predicted_return, a / nullif(history_last_close, 0) - 1 as actual_return,
        case when p > 0 and history_last_close > 0 then ln(p / history_last_close) end as predicted_log_return, case when a > 0 and history_last_close > 0 then ln(a / history_last_close) end as actual_log_return from m0),
    m as (select * exclude (p, a), a as actual_final_close, abs(predicted_log_return - actual_log_return) as log_return_abs_error,
        case when predicted_return is not null and actual_return is not null then sign(predicted_return) = sign(actual_return) end as direction_correct from m1)"""


CORR = "case when min({x}) < max({x}) and min({y}) < max({y}) then covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0) end"
SUMMARY = (
    "count(*) as windows, count(distinct symbol) as symbols, " + r("avg(mae)", "mean_mae") + ", " + r("median(mae)", "median_mae") + ", " + r("avg(rmse)", "mean_rmse") + ", " + r("avg(final_ape)", "mean_ape") + ", "
    + r("avg(direction_correct::int::double)", "direction_accuracy") + ", " + r(CORR.format(x="predicted_return", y="actual_return"), "return_pearson")
)


def benchmark(threshold: float, horizon: int, lookback: int) -> str:
    """Two arms over one protocol: contexts raw or adjusted, targets rebased to the origin, exposure per window (CTE ``bm``)."""
    return f"""{windows(ARMS25, threshold, horizon, lookback)},
    fact2 as (select fc.symbol, fc.candidate_month, fc.forecast_origin, fc.horizon_step, fc.method, st.target_ts, case when fc.symbol like 'raw:%' then fc.predicted_close else fc.predicted_close / og.factor end as predicted_close,
        t.adj / og.factor as actual_close, og.raw as history_last_close
      from fc join st using (symbol, candidate_month, forecast_origin, horizon_step) join c og on og.symbol = fc.symbol and og.ts = fc.forecast_origin left join c t on t.symbol = fc.symbol and t.ts = st.target_ts where valid
      qualify min((t.adj is not null)::int) over (partition by fc.symbol, fc.candidate_month, fc.method) = 1),
    {scores('fact2')},
    fx as (select symbol, ts, factor, abs(ln(factor) - ln(lag(factor) over (partition by symbol order by ts))) as step from c),
    cx as (select *, coalesce(max(step) over (partition by symbol order by ts rows between {lookback - 2} preceding and current row), 0) as cmax from fx),
    ex as (select cx.symbol, candidate_month, forecast_origin, max(cmax) as cmax, coalesce(max(abs(ln(f2.factor / cx.factor))), 0) as tmax
      from cx join (select candidate_month, forecast_origin, unnest(targets) as tt from coh where complete) x on cx.ts = x.forecast_origin left join fx f2 on f2.symbol = cx.symbol and f2.ts = tt group by cx.symbol, candidate_month, forecast_origin),
    bm as (select m.* exclude (symbol), split_part(symbol, ':', 1) as experiment_arm, split_part(symbol, ':', 2) as symbol, cmax, tmax, cmax > 1e-6 as context_changed, tmax > 1e-6 as target_changed,
        case when cmax > 1e-6 or tmax > 1e-6 then 'material_factor_change' else 'no_material_change' end as exposure_bucket from m join ex using (symbol, candidate_month, forecast_origin))"""
