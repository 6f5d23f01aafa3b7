"""Queries of the ingestion gates and the evaluation chain, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wickline.config import EvaluationConfig
from wickline.operators import adjust
from wickline.operators import evaluation as ev
from wickline.operators import quality as ql
from wickline.plans import oracle as o
from wickline.plans.registry import query
from wickline.session import cut
from wickline.sources import candles as src
from wickline.sources import sinks

THRESHOLD, HORIZON, LOOKBACK, MINIMUM = 0.8, 4, 52, 20
DRAWS, SEED = EvaluationConfig().draws, EvaluationConfig().seed
ARGS6 = (o.WEEK6, THRESHOLD, HORIZON, LOOKBACK)
ARGS25 = (o.WEEK25, THRESHOLD, HORIZON, LOOKBACK)
BAR = "symbol, {day}, " + ", ".join(o.r(c) for c in ("open", "high", "low", "close", "volume"))
SPECS = [("momentum_vs_last", "momentum_20", "last_close"), ("trend_vs_last", "trend_20", "last_close"), ("momentum_vs_trend", "momentum_20", "trend_20")]

for _name, _sql, _day in (("week6", o.WEEK6, o.d("ts")), ("day6", o.DAY6, o.d("ts")), ("week25", o.WEEK25, o.d("ts")), ("hour5", o.HOUR5, "strftime(ts, '%Y-%m-%d %H:%M:%S') as ts")):
    query(f"candles_{_name}", f"select {BAR.format(day=_day)} from ({_sql})")(getattr(src, _name))


# ---------------------------------------------------------------- gates

DAMAGED = f"""select symbol, ts, open, case when day(ts) % 7 = 0 then low else high end as high, case when day(ts) % 11 = 0 then high else low end as low, close,
  case when day(ts) % 13 = 0 then -volume else volume end as volume from ({o.WEEK6})"""


def damaged(spark, sf):
    """Weekly bars with deliberate defects by day of month."""
    day = F.dayofmonth("ts")
    return src.week6(spark, sf).select(
        "symbol", "ts", "open", F.when(day % 7 == 0, F.col("low")).otherwise(F.col("high")).alias("high"),
        F.when(day % 11 == 0, F.col("high")).otherwise(F.col("low")).alias("low"), "close", F.when(day % 13 == 0, -F.col("volume")).otherwise(F.col("volume")).alias("volume"),
    )


_REPAIRED = f"""rep as (select *, high as raw_high, low as raw_low, greatest(high, open, close, low) as h2 from ({DAMAGED})), fin as (select *, least(low, open, close, h2) as l2 from rep)"""


@query("ohlc_repair", f"with {_REPAIRED} select symbol, {o.d('ts')}, {o.r('open')}, {o.r('h2', 'high')}, {o.r('l2', 'low')}, {o.r('close')} from fin")
def _(spark, sf):
    return ql.repair_envelope(damaged(spark, sf)).select("symbol", "ts", "open", "high", "low", "close")


@query(
    "ohlc_repair_audit",
    f"""with {_REPAIRED} select symbol, {o.d('ts')}, 'high' as "column", {o.r('raw_high', 'original_value')}, {o.r('h2', 'repaired_value')}, 'expand_ohlc_envelope' as reason from fin where raw_high <> h2
    union all select symbol, {o.d('ts')}, 'low', {o.r('raw_low', 'x')}, {o.r('l2', 'y')}, 'expand_ohlc_envelope' from fin where raw_low <> l2""",
)
def _(spark, sf):
    return ql.repair_audit(ql.repair_envelope(damaged(spark, sf)))


_BROKEN = f"""select symbol, case when day(ts) % 17 = 0 then null else ts end as ts, open, high, low, case when day(ts) % 23 = 0 then null when day(ts) % 29 = 0 then -close else close end as close, volume
  from ({DAMAGED}), range(0, 2) x(copy) where copy = 0 or day(ts) % 19 = 0"""


def broken(spark, sf):
    """The damaged bars with missing stamps, repeated bars, missing and negative prices as well."""
    day, b = F.dayofmonth("ts"), damaged(spark, sf)
    both = b.union(b.filter(day % 19 == 0))
    close = F.when(day % 23 == 0, F.lit(None)).when(day % 29 == 0, -F.col("close")).otherwise(F.col("close"))
    return both.withColumns({"close": close, "ts": F.when(day % 17 != 0, F.col("ts"))})


@query(
    "candle_violations",
    f"""select * from (select symbol, {o.d('ts')}, case when ts is null then 'timestamp' when count(*) over (partition by symbol, ts) > 1 then 'duplicate' when open is null or high is null or low is null or close is null or volume is null then 'non_numeric'
      when least(open, high, low, close) < 0 then 'negative_price' when volume < 0 then 'negative_volume' when high < greatest(open, close, low) then 'high' when low > least(open, close) then 'low' end as violation from ({_BROKEN})) where violation is not null""",
)
def _(spark, sf):
    return ql.violations(broken(spark, sf)).select("symbol", "ts", "violation")


@query("manifest_summary", f"with {_REPAIRED} select count(distinct symbol) + 1 as requested, count(distinct symbol) as succeeded, 1 as failed, sum((raw_high <> h2)::int + (raw_low <> l2)::int)::bigint as repairs from fin")
def _(spark, sf):
    failures = spark.createDataFrame([("ZZ", "ValueError", "no rows")], "symbol string, error_type string, error string")
    return sinks.manifest_summary(sinks.manifest(ql.repair_envelope(damaged(spark, sf)), failures))


@query("typical_amount", f"select symbol, {o.d('ts')}, {o.r('(high + low + close) / 3 * volume', 'amount')} from ({o.WEEK6})")
def _(spark, sf):
    return src.week6(spark, sf).select("symbol", "ts", ql.typical_amount(F.col("high"), F.col("low"), F.col("close"), F.col("volume")).alias("amount"))


@query(
    "amount_fill",
    f"""with b as (select *, case when symbol < 'N' then 0.0 when day(ts) % 2 = 0 then close * 2 end as amount from ({o.WEEK6}))
    select symbol, {o.d('ts')}, {o.r("case when max(coalesce(abs(amount), 0)) over (partition by symbol) > 0 then amount else close * volume end", 'amount')} from b""",
)
def _(spark, sf):
    b = src.week6(spark, sf).withColumn("amount", F.when(F.col("symbol") < "N", F.lit(0.0)).when(F.dayofmonth("ts") % 2 == 0, F.col("close") * 2))
    return ql.fill_amount(b).select("symbol", "ts", "amount")


@query(
    "open_fix",
    f"""with b as (select *, case when day(ts) % 5 = 0 then 0 else open end as op from ({o.WEEK6}))
    select symbol, {o.d('ts')}, {o.r("case when op is null or op = 0 then coalesce(lag(close) over (partition by symbol order by ts), close) else op end", 'open')} from b""",
)
def _(spark, sf):
    b = src.week6(spark, sf).withColumn("open", F.when(F.dayofmonth("ts") % 5 == 0, F.lit(0.0)).otherwise(F.col("open")))
    return ql.fix_open(b).select("symbol", "ts", "open")


@query(
    "ffill_features",
    f"""with b as (select *, case when day(ts) % 3 = 0 then null else close end as cl from ({o.WEEK6}))
    select symbol, {o.d('ts')}, {o.r("last_value(cl ignore nulls) over (partition by symbol order by ts rows between unbounded preceding and current row)", 'close')} from b""",
)
def _(spark, sf):
    b = src.week6(spark, sf).withColumn("close", F.when(F.dayofmonth("ts") % 3 != 0, F.col("close")))
    return ql.forward_fill(b, "close").select("symbol", "ts", "close")


@query(
    "numeric_cleanup",
    """with b as (select o_orderkey, case when o_orderkey % 5 = 0 then '--' when o_orderkey % 7 = 0 then '' when o_orderkey % 11 = 0 then '1,234.5' else cast(o_orderkey as varchar) end as t from orders)
    select o_orderkey, t as raw, round(try_cast(nullif(replace(t, ',', ''), '') as double), 6) + 0.0 as value from b""",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    t = F.when(k % 5 == 0, "--").when(k % 7 == 0, "").when(k % 11 == 0, "1,234.5").otherwise(k.cast("string"))
    return ql.numbers_from_text(src.read(spark, sf, "orders").select("o_orderkey", t.alias("raw"), t.alias("value")), "value")


@query("duplicate_keys", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def _(spark, sf):
    return ql.duplicate_keys(src.read(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("long_enough", f"select symbol, {o.d('ts')}, {o.r('close')} from (select *, count(*) over (partition by symbol) as n from ({o.WEEK6})) where n >= 300")
def _(spark, sf):
    return ql.long_enough(src.week6(spark, sf), 300).select("symbol", "ts", "close")


@query("universe_asof", """select c_custkey as member, strftime(valid_from, '%Y-%m-%d') as valid_from from (select c_custkey, cast(min(o_orderdate) as date) as valid_from, case when c_custkey % 3 = 0 then null else cast(max(o_orderdate) as date) end as valid_to
  from customer join orders on o_custkey = c_custkey group by c_custkey) where valid_from <= date '1998-06-01' and (valid_to is null or valid_to >= date '1998-06-01')""")  # fmt: skip
def _(spark, sf):
    u = src.read(spark, sf, "orders").join(src.read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_custkey").alias("member"))
    u = u.agg(F.to_date(F.min("o_orderdate")).alias("valid_from"), F.to_date(F.max("o_orderdate")).alias("valid_to"))
    u = u.withColumn("valid_to", F.when(F.col("member") % 3 != 0, F.col("valid_to")))
    return ql.as_of(u, F.lit("1998-06-01").cast("date")).select("member", "valid_from")


@query("unknown_symbols", "select c_custkey as member from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null and o_orderpriority = '1-URGENT')")
def _(spark, sf):
    held = src.read(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'")
    return src.read(spark, sf, "customer").join(held, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select(F.col("c_custkey").alias("member"))


# ---------------------------------------------------------------- evaluation


def parts(spark, sf, bars=src.week6):
    candles = cut(bars(spark, sf))  # read three times below: calendar, history, targets
    cohorts = ev.monthly_cohorts(ev.canonical_calendar(candles, THRESHOLD), HORIZON)
    wins = ev.windows(ev.history(candles, LOOKBACK), cohorts, LOOKBACK)
    return candles, cohorts, wins


def metrics(spark, sf, bars=src.week6):
    candles, _, wins = parts(spark, sf, bars)
    fact = ev.prediction_fact(ev.baselines(wins, HORIZON), ev.targets(wins, candles))
    return ev.window_metrics(fact)


_M = ["mae", "rmse", "history_last_close", "final_abs_error", "final_ape", "predicted_return", "actual_return", "predicted_log_return", "actual_log_return", "log_return_abs_error"]
_MC = ["symbol", "candidate_month", "forecast_origin", "method", *_M, "direction_correct"]


@query("canonical_calendar", f"with {o.calendar(o.WEEK6, THRESHOLD)} select {o.d('ts')}, symbols from cal")
def _(spark, sf):
    return ev.canonical_calendar(src.week6(spark, sf), THRESHOLD)


@query("monthly_cohorts", f"with {o.cohorts(o.WEEK6, THRESHOLD, HORIZON)} select candidate_month, {o.d('forecast_origin')}, array_to_string(list_transform(targets, lambda x: strftime(x, '%Y-%m-%d')), ',') as targets, complete from coh")
def _(spark, sf):
    c = ev.monthly_cohorts(ev.canonical_calendar(src.week6(spark, sf), THRESHOLD), HORIZON)
    return c.withColumn("targets", F.array_join(F.transform("targets", lambda x: F.date_format(x, "yyyy-MM-dd")), ","))


@query("calendar_skips", f"with {o.cohorts(o.WEEK6, THRESHOLD, 4 * HORIZON)} select candidate_month, 'incomplete_target_calendar' as reason_code from coh where not complete")
def _(spark, sf):
    c = ev.monthly_cohorts(ev.canonical_calendar(src.week6(spark, sf), THRESHOLD), 4 * HORIZON)
    return c.filter("not complete").select("candidate_month", F.lit("incomplete_target_calendar").alias("reason_code"))


_SPARSE = f"select * from ({o.WEEK6}) where not (symbol < 'N' and week(ts) % 9 = 0)"


@query(
    "window_skips",
    f"""with {o.cohorts(_SPARSE, THRESHOLD, HORIZON)}, grid as (select s.symbol, coh.* from (select distinct symbol from c) s cross join coh where complete),
    pos as (select symbol, ts, row_number() over (partition by symbol order by ts) as rn from c),
    x as (select g.symbol, g.candidate_month, any_value(p.rn) as rn, any_value(len(targets)) as need, (select count(*) from c where c.symbol = g.symbol and list_contains(any_value(g.targets), c.ts)) as hits from grid g left join pos p on p.symbol = g.symbol and p.ts = g.forecast_origin group by g.symbol, g.candidate_month)
    select * from (select symbol, candidate_month, case when rn is null then 'missing_origin_date' when hits < need then 'missing_target_date' when rn < {LOOKBACK} then 'insufficient_history' end as reason_code, coalesce(rn, 0) as available_history_rows, hits as available_target_rows from x) where reason_code is not null""",
)
def _(spark, sf):
    candles = src.week6(spark, sf).filter(~((F.col("symbol") < "N") & (F.weekofyear("ts") % 9 == 0)))
    return ev.window_skips(candles, ev.monthly_cohorts(ev.canonical_calendar(candles, THRESHOLD), HORIZON), LOOKBACK)


@query("context_profile", f"with {o.windows(*ARGS6)} select symbol, candidate_month, {o.d('forecast_origin')}, context_rows, history_rows, {o.d('context_start')}, {o.r('history_last_close')} from w")
def _(spark, sf):
    return parts(spark, sf)[2].select("symbol", "candidate_month", "forecast_origin", "context_rows", "history_rows", "context_start", "history_last_close")


@query("baseline_forecasts", f"with {o.windows(*ARGS6)} select symbol, candidate_month, method, horizon_step, {o.r('predicted_close')}, valid from fc")
def _(spark, sf):
    return ev.baselines(parts(spark, sf)[2], HORIZON).select("symbol", "candidate_month", "method", "horizon_step", "predicted_close", "valid")


@query("invalid_baselines", f"with {o.windows(*ARGS6)} select symbol, candidate_month, method, 'invalid_baseline_output' as reason_code, {o.r('min(predicted_close)', 'worst')} from fc where not valid group by symbol, candidate_month, method")
def _(spark, sf):
    bad = ev.baselines(parts(spark, sf)[2], HORIZON).filter("not valid")
    return bad.groupBy("symbol", "candidate_month", "method").agg(F.lit("invalid_baseline_output").alias("reason_code"), F.min("predicted_close").alias("worst"))


@query("prediction_fact", f"with {o.windows(*ARGS6)} select symbol, candidate_month, {o.d('forecast_origin')}, {o.d('target_ts')}, horizon_step, method, {o.r('predicted_close')}, {o.r('actual_close')}, {o.r('history_last_close')} from fact")
def _(spark, sf):
    candles, _, wins = parts(spark, sf)
    return ev.prediction_fact(ev.baselines(wins, HORIZON), ev.targets(wins, candles))


@query("window_metrics", f"with {o.metrics(*ARGS6)} select symbol, candidate_month, {o.d('forecast_origin')}, method, {', '.join(o.r(c) for c in _M)}, direction_correct from m")
def _(spark, sf):
    return metrics(spark, sf).select(*_MC)


@query("benchmark_window_metrics", f"with {o.metrics(*ARGS25)} select symbol, candidate_month, {o.d('forecast_origin')}, method, {', '.join(o.r(c) for c in _M)}, direction_correct from m")
def _(spark, sf):
    return ev.require_positive(metrics(spark, sf, src.week25)).select(*_MC)


@query("symbol_metrics", f"with {o.metrics(*ARGS6)} select symbol as name, method, {o.SUMMARY} from m group by symbol, method")
def _(spark, sf):
    return ev.summary(metrics(spark, sf).withColumn("name", F.col("symbol")), "name", "method")


@query("period_metrics", f"with {o.metrics(*ARGS6)} select candidate_month, method, {o.SUMMARY} from m group by candidate_month, method")
def _(spark, sf):
    return ev.summary(metrics(spark, sf), "candidate_month", "method")


@query("arm_summary", f"with {o.metrics(*ARGS25)} select method, {o.SUMMARY} from m group by method")
def _(spark, sf):
    return ev.summary(metrics(spark, sf, src.week25), "method")


_RANKED = f"""{o.metrics(*ARGS25)}, r0 as (select *, row_number() over (partition by candidate_month, forecast_origin, method order by predicted_return desc, symbol) as rp, row_number() over (partition by candidate_month, forecast_origin, method order by actual_return desc, symbol) as ra,
  rank() over (partition by candidate_month, forecast_origin, method order by predicted_return) + (count(*) over (partition by candidate_month, forecast_origin, method, predicted_return) - 1) / 2.0 as sp,
  rank() over (partition by candidate_month, forecast_origin, method order by actual_return) + (count(*) over (partition by candidate_month, forecast_origin, method, actual_return) - 1) / 2.0 as sa from m where predicted_return is not null and actual_return is not null),
  r1 as (select candidate_month, forecast_origin, method, count(*) as eligible, {o.CORR.format(x='sp', y='sa')} as spearman, sum((rp <= 5 and ra <= 5)::int)::bigint as top_overlap, avg(case when rp <= 5 then actual_return end) as top_return from r0 group by all)"""


@query("ranking_metrics", f"with {_RANKED} select candidate_month, {o.d('forecast_origin')}, method, eligible, eligible >= {MINIMUM} as ranking_available, {o.r(f'case when eligible >= {MINIMUM} then spearman end', 'spearman')}, case when eligible >= {MINIMUM} then top_overlap end as top_overlap, {o.r(f'case when eligible >= {MINIMUM} then top_return end', 'top_return')} from r1")
def _(spark, sf):
    return ev.ranking(metrics(spark, sf, src.week25), MINIMUM)


_PAIRS = "pr as (" + " union all ".join(
    f"""select a.symbol, a.candidate_month, a.forecast_origin, '{i}' as comparison_id, a.log_return_abs_error as challenger_error, b.log_return_abs_error as reference_error, a.log_return_abs_error - b.log_return_abs_error as difference
    from m a join m b on a.symbol = b.symbol and a.candidate_month = b.candidate_month and a.forecast_origin = b.forecast_origin where a.method = '{c}' and b.method = '{r}'"""
    for i, c, r in SPECS
) + ")"


@query("paired_comparison", f"with {o.metrics(*ARGS6)}, {_PAIRS} select comparison_id, symbol, candidate_month, {o.r('challenger_error')}, {o.r('reference_error')}, {o.r('difference')}, case when difference < 0 then 'challenger' when difference > 0 then 'reference' else 'tie' end as winner, true as consistent from pr")
def _(spark, sf):
    return ev.paired(metrics(spark, sf), SPECS).select("comparison_id", "symbol", "candidate_month", "challenger_error", "reference_error", "difference", "winner", "consistent")


_SPOILT = f"sp as (select * exclude (actual_final_close), actual_final_close + case when method = 'momentum_20' and symbol = 'RF' and month(forecast_origin) = 3 then 999 else 0 end as actual_final_close from m)"


@query(
    "pair_mismatch",
    f"with {o.metrics(*ARGS6)}, {_SPOILT} "
    + " union all ".join(
        f"""select '{i}' as comparison_id, count(*) as pairs, sum((abs(a.actual_final_close - b.actual_final_close) > 1e-8 + 1e-5 * abs(b.actual_final_close) or abs(a.history_last_close - b.history_last_close) > 1e-8 + 1e-5 * abs(b.history_last_close) or a.final_target_ts <> b.final_target_ts)::int)::bigint as mismatches
        from sp a join sp b using (symbol, candidate_month, forecast_origin) where a.method = '{c}' and b.method = '{r}'"""
        for i, c, r in SPECS
    ),
)
def _(spark, sf):
    spoilt = (F.col("method") == "momentum_20") & (F.col("symbol") == "RF") & (F.month("forecast_origin") == 3)
    m = metrics(spark, sf).withColumn("actual_final_close", F.col("actual_final_close") + F.when(spoilt, 999).otherwise(0))
    return ev.paired(m, SPECS).groupBy("comparison_id").agg(F.count("*").alias("pairs"), F.sum((~F.col("consistent")).cast("long")).alias("mismatches"))


@query("win_rates", f"with {o.metrics(*ARGS6)}, {_PAIRS} select comparison_id, {o.r('avg((difference < 0)::int::double)', 'win_rate')}, count(*) as windows from pr group by comparison_id")
def _(spark, sf):
    return ev.paired(metrics(spark, sf), SPECS).groupBy("comparison_id").agg(F.avg((F.col("difference") < 0).cast("double")).alias("win_rate"), F.count("*").alias("windows"))


def _boot(cluster: str, seed: int, draws: int = DRAWS) -> str:
    return f"""s_{cluster} as (select comparison_id, cast({cluster} as varchar) as cluster, sum(difference) as s, count(*) as n from pr where difference is not null group by all),
    o_{cluster} as (select *, row_number() over (partition by comparison_id order by cluster) - 1 as i, count(*) over (partition by comparison_id) as k from s_{cluster}),
    p_{cluster} as (select comparison_id, draw, ('0x' || substr(sha256('{seed}:' || draw || ':' || place), 1, 8))::ubigint % k as i from (select distinct comparison_id, k from o_{cluster} where k >= 2), range(0, {draws}) a(draw), lateral (select unnest(range(0, k)) as place)),
    q_{cluster} as (select comparison_id, draw, sum(s) / sum(n) as mm from p_{cluster} p join o_{cluster} o using (comparison_id, i) group by all),
    b_{cluster} as (select comparison_id, quantile_cont(mm, 0.025) as lower, quantile_cont(mm, 0.975) as upper from q_{cluster} group by all),
    i_{cluster} as (select k.comparison_id, '{cluster}' as cluster_column, k.k >= 2 as available, k.n_rows, k.k as clusters, k.mean_difference, b.lower, b.upper
      from (select comparison_id, count(*) as k, sum(n)::bigint as n_rows, sum(s) / sum(n) as mean_difference from s_{cluster} group by all) k left join b_{cluster} b using (comparison_id))"""


_INT = f"{o.metrics(*ARGS6)}, {_PAIRS}, {_boot('symbol', SEED)}, {_boot('forecast_origin', SEED + 1)}, iv as (select * from i_symbol union all select * from i_forecast_origin)"
_DECIDE = "case when min(available::int) = 1 and max(upper) < 0 then 'robustly_better' when min(available::int) = 1 and min(lower) > 0 then 'robustly_worse' else 'mixed_or_inconclusive' end as decision"


def intervals(spark, sf):
    return ev.bootstrap(ev.paired(metrics(spark, sf), SPECS, strict=True), {"symbol": SEED, "forecast_origin": SEED + 1}, DRAWS)


@query("bootstrap_intervals", f"with {_INT} select comparison_id, cluster_column, available, n_rows, clusters, {o.r('mean_difference')}, {o.r('lower')}, {o.r('upper')} from iv")
def _(spark, sf):
    return intervals(spark, sf)


@query("decisions", f"with {_INT} select comparison_id, {_DECIDE} from iv group by comparison_id")
def _(spark, sf):
    return ev.decisions(intervals(spark, sf))


# ---------------------------------------------------------------- benchmark of arms

ARMS = ("raw", "adjusted")
BENCH = o.benchmark(THRESHOLD, HORIZON, LOOKBACK)
BENCH_SPECS = [("momentum_adjusted_vs_raw", "adjusted/momentum_20", "raw/momentum_20"), ("trend_adjusted_vs_raw", "adjusted/trend_20", "raw/trend_20"), ("adjusted_momentum_vs_last", "adjusted/momentum_20", "adjusted/last_close")]


def benchmark(spark, sf):
    """Metrics of two arms (contexts raw or adjusted by the provider's factor); both are scored on targets rebased to the origin."""
    change = F.when(F.col("ts") < "1998-01-01", 0.5).when((F.col("symbol") < "Brand#3") & (F.col("ts") < "2000-01-01"), 0.8).otherwise(1.0)
    base = src.week25(spark, sf).withColumn("factor", change)
    arm = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), (F.col("factor") if a == "adjusted" else F.lit(1.0)).alias("f")) for a in ARMS]))
    candles = base.withColumn("a", arm).select(
        F.concat("a.arm", F.lit(":"), "symbol").alias("symbol"), "ts", *[(F.col(c) * F.col("a.f")).alias(c) for c in ("open", "high", "low", "close")], "volume", F.col("close").alias("raw"), (F.col("close") * F.col("factor")).alias("adj"), "factor",
    )
    candles = cut(candles)
    cohorts = cut(ev.monthly_cohorts(ev.canonical_calendar(candles, THRESHOLD), HORIZON))
    wins = ev.windows(ev.history(candles, LOOKBACK), cohorts, LOOKBACK)
    fact = ev.prediction_fact(ev.baselines(wins, HORIZON), ev.targets(wins, candles.select("symbol", "ts", F.col("adj").alias("close"))))
    seen = adjust.cohort_exposure(candles, cohorts, LOOKBACK)
    origins = wins.select(*ev.KEYS, F.col("factor").alias("origin_factor"), F.col("raw").alias("origin_close"))
    scaled = fact.drop("history_last_close").join(origins, list(ev.KEYS)).withColumns({
        "predicted_close": F.when(F.col("symbol").startswith("raw:"), F.col("predicted_close")).otherwise(F.col("predicted_close") / F.col("origin_factor")),
        "actual_close": F.col("actual_close") / F.col("origin_factor"), "history_last_close": F.col("origin_close"),
    })
    m = ev.require_positive(ev.window_metrics(scaled)).join(seen, list(ev.KEYS))
    part = lambda i: F.split_part("symbol", F.lit(":"), F.lit(i))
    return m.withColumns({"experiment_arm": part(1), "symbol": part(2)})


@query("benchmark_exposure", f"with {BENCH} select experiment_arm, symbol, candidate_month, {o.d('forecast_origin')}, method, {o.r('cmax', 'context_max_abs_log_step')}, {o.r('tmax', 'target_max_abs_log_from_origin')}, context_changed as context_factor_changed, target_changed as target_factor_changed, exposure_bucket, {o.r('log_return_abs_error')}, {o.r('history_last_close')}, {o.r('actual_final_close')}, {o.d('final_target_ts')} from bm")
def _(spark, sf):
    return benchmark(spark, sf).select(
        "experiment_arm", "symbol", "candidate_month", "forecast_origin", "method", "context_max_abs_log_step", "target_max_abs_log_from_origin", "context_factor_changed", "target_factor_changed", "exposure_bucket",
        "log_return_abs_error", "history_last_close", "actual_final_close", "final_target_ts",
    )


_BSUM = "count(*) as windows, count(distinct symbol) as symbols, " + ", ".join(
    o.r(x, n) for x, n in (("avg(log_return_abs_error)", "mean_log_return_abs_error"), ("median(log_return_abs_error)", "median_log_return_abs_error"), ("avg(final_ape)", "mean_final_ape"), ("median(final_ape)", "median_final_ape"), ("avg(mae)", "mean_mae"), ("avg(rmse)", "mean_rmse"), ("avg(direction_correct::int::double)", "direction_accuracy"))
)


@query("benchmark_symbol_metrics", f"with {BENCH} select experiment_arm, symbol as name, method, exposure_bucket, {_BSUM} from bm group by experiment_arm, symbol, method, exposure_bucket")
def _(spark, sf):
    return ev.benchmark_summary(benchmark(spark, sf).withColumn("name", F.col("symbol")), "experiment_arm", "name", "method", "exposure_bucket")


@query("benchmark_period_metrics", f"with {BENCH} select experiment_arm, candidate_month, {o.d('forecast_origin')}, method, exposure_bucket, {_BSUM} from bm group by experiment_arm, candidate_month, forecast_origin, method, exposure_bucket")
def _(spark, sf):
    return ev.benchmark_summary(benchmark(spark, sf), "experiment_arm", "candidate_month", "forecast_origin", "method", "exposure_bucket")


@query("benchmark_arm_summary", f"with {BENCH} select experiment_arm, method, {_BSUM} from bm group by experiment_arm, method")
def _(spark, sf):
    return ev.benchmark_summary(benchmark(spark, sf), "experiment_arm", "method")


@query("exposure_counts", f"with {BENCH} select exposure_bucket, count(*) as windows from (select distinct symbol, candidate_month, exposure_bucket from bm) group by exposure_bucket")
def _(spark, sf):
    return benchmark(spark, sf).select("symbol", "candidate_month", "exposure_bucket").distinct().groupBy("exposure_bucket").agg(F.count("*").alias("windows"))


_BY = "partition by experiment_arm, candidate_month, forecast_origin, method"
_BRANKED = f"""{BENCH}, r0 as (select *, row_number() over ({_BY} order by predicted_log_return desc, symbol) as rp, row_number() over ({_BY} order by actual_log_return desc, symbol) as ra,
  rank() over ({_BY} order by predicted_log_return) + (count(*) over ({_BY}, predicted_log_return) - 1) / 2.0 as sp, rank() over ({_BY} order by actual_log_return) + (count(*) over ({_BY}, actual_log_return) - 1) / 2.0 as sa from bm),
  r1 as (select experiment_arm, candidate_month, forecast_origin, method, count(*) as eligible, {o.CORR.format(x='sp', y='sa')} as spearman, sum((rp <= 5 and ra <= 5)::int)::bigint as top_overlap, avg(case when rp <= 5 then actual_return end) as top_return, avg(case when rp <= 5 then actual_log_return end) as top_log_return from r0 group by all)"""


@query("benchmark_ranking", f"with {_BRANKED} select experiment_arm, candidate_month, {o.d('forecast_origin')}, method, eligible, eligible >= {MINIMUM} as ranking_available, " + ", ".join(o.r(f"case when eligible >= {MINIMUM} then {c} end", c) for c in ("spearman", "top_return", "top_log_return")) + f", case when eligible >= {MINIMUM} then top_overlap end as top_overlap from r1")
def _(spark, sf):
    return ev.benchmark_ranking(benchmark(spark, sf), MINIMUM)


@query("benchmark_pairs", f"with {BENCH} " + " union all ".join(
    f"""select '{i}' as comparison_id, symbol, candidate_month, {o.d('forecast_origin')}, {o.r('a.log_return_abs_error', 'challenger_error')}, {o.r('b.log_return_abs_error', 'reference_error')}, {o.r('a.log_return_abs_error - b.log_return_abs_error', 'difference')}, a.exposure_bucket
    from bm a join bm b using (symbol, candidate_month, forecast_origin) where a.experiment_arm || '/' || a.method = '{c}' and b.experiment_arm || '/' || b.method = '{r}'""" for i, c, r in BENCH_SPECS))  # fmt: skip
def _(spark, sf):
    m = benchmark(spark, sf).withColumn("name", F.concat("experiment_arm", F.lit("/"), "method"))
    return ev.paired(m, BENCH_SPECS, name="name", strict=True).select("comparison_id", "symbol", "candidate_month", "forecast_origin", "challenger_error", "reference_error", "difference", "exposure_bucket")


@query("overall_summary", f"""with {_RANKED}, g as (select count(*) as n from (select distinct symbol from c) cross join coh where complete)
  select (select count(*) from m where method = 'last_close') as eligible_windows, (select count(distinct symbol) from m) as symbols_evaluated, (select n from g) - (select count(*) from w where len(targets) = (select count(*) from c where c.symbol = w.symbol and list_contains(w.targets, c.ts))) as skipped_windows, (select count(*) from r1 where eligible >= {MINIMUM}) as ranking_cohorts""")  # fmt: skip
def _(spark, sf):
    candles, cohorts, wins = parts(spark, sf, src.week25)
    m = cut(ev.window_metrics(ev.prediction_fact(ev.baselines(wins, HORIZON), ev.targets(wins, candles))))
    return ev.overall(m, ev.window_skips(candles, cohorts, LOOKBACK), ev.ranking(m, MINIMUM), "last_close")


@query("walk_forward", f"""with c as ({o.WEEK6}), n as (select symbol, ts, close, row_number() over (partition by symbol order by ts) - 1 as i, count(*) over (partition by symbol) as n from c)
  select a.symbol, {o.d('a.ts', 'origin')}, (b.i - a.i)::bigint as step, {o.d('b.ts', 'ts')}, {o.r('a.close', 'predicted')}, {o.r('b.close', 'actual')} from n a join n b on b.symbol = a.symbol and b.i between a.i + 1 and a.i + {HORIZON}
  where a.i >= {LOOKBACK} and a.i + {HORIZON} < a.n and (a.i - {LOOKBACK}) % {HORIZON} = 0""")  # fmt: skip
def _(spark, sf):
    return ev.walk_forward(src.week6(spark, sf), LOOKBACK, HORIZON)


@query("global_mean", "select l_returnflag, round(sum(l_extendedprice) / count(*), 4) + 0.0 as mean from lineitem group by l_returnflag")
def _(spark, sf):
    parts_ = src.read(spark, sf, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.sum("l_extendedprice").alias("s"), F.count("*").alias("n"))
    return ev.global_mean(parts_, "s", "n", "l_returnflag").withColumn("mean", F.round("mean", 4))


_HOLED = f"select symbol, ts, open, high, low, case when day(ts) = 13 then null else close end as close, volume from ({o.WEEK6})"


@query("finite_windows", f"""with {o.windows(_HOLED, THRESHOLD, HORIZON, LOOKBACK)},
  sn as (select symbol, ts, sum((close is null)::int) over (partition by symbol order by ts rows between {LOOKBACK - 1} preceding and current row) as odd from c), gd as (select symbol, candidate_month, min((actual_close is not null)::int) as good from act group by all)
  select w.symbol, w.candidate_month, {o.d('forecast_origin')}, context_rows from w join sn on sn.symbol = w.symbol and sn.ts = w.forecast_origin join gd on gd.symbol = w.symbol and gd.candidate_month = w.candidate_month where odd = 0 and good = 1""")  # fmt: skip
def _(spark, sf):
    candles = cut(src.week6(spark, sf).withColumn("close", F.when(F.dayofmonth("ts") != 13, F.col("close"))))
    cohorts = ev.monthly_cohorts(ev.canonical_calendar(candles, THRESHOLD), HORIZON)
    wins = ev.windows(ev.history(candles, LOOKBACK), cohorts, LOOKBACK)
    return ev.finite_windows(wins, ev.targets(wins, candles), candles, LOOKBACK).select("symbol", "candidate_month", "forecast_origin", "context_rows")


@query("amount_variants", f"select symbol, {o.d('ts')}, {o.r('(open + high + low + close) / 4 * volume', 'amount')}, 0.0 as amount_without_volume from ({o.WEEK6})")
def _(spark, sf):
    c = src.week6(spark, sf)
    none = ql.predictor_defaults(c.drop("volume")).select("symbol", "ts", F.col("amount").alias("amount_without_volume"))
    return ql.predictor_defaults(c).join(none, ["symbol", "ts"]).select("symbol", "ts", "amount", "amount_without_volume")


@query("date_ranges", f"""with c as ({o.WEEK6}), y as (select *, max(ts) over (partition by symbol) as newest from c) select 'between' as part, symbol, {o.d('ts')} from c where ts between date '1997-03-03' and date '1997-12-29'
  union all select 'last_years', symbol, {o.d('ts')} from y where ts >= newest - interval 24 month""")  # fmt: skip
def _(spark, sf):
    c = src.week6(spark, sf)
    parts_ = {"between": ql.between(c, "1997-03-03", "1997-12-29"), "last_years": ql.last_years(c, 2)}
    out = [df.select(F.lit(k).alias("part"), "symbol", "ts") for k, df in parts_.items()]
    return out[0].union(out[1])
