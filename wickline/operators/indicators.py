"""Indicators, returns, signals and path-dependent strategies.

All frames of a symbol share one sort. What depends on its own past decisions is a fold over the symbol's
sorted bars, which carries a small state from row to row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickline.functions.numeric import clip, ratio, safe_corr
from wickline.operators.frames import by_time, fold




def full_mean(c: str, n: int) -> Column:
    """Mean of the last ``n`` rows; null before there are so many."""
    w = by_time().rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(w) == n, F.avg(c).over(w))


def moving_averages(df: DataFrame) -> DataFrame:
    return df.withColumns({"ma5": full_mean("close", 5), "ma20": full_mean("close", 20), "ma60": full_mean("close", 60), "vol5": full_mean("volume", 5)})


def trend_strength(df: DataFrame) -> DataFrame:
    """Weighted slopes of average, price and volume, from 0 to 1; 0.5 before 20 rows."""
    ma = moving_averages(df)
    before = by_time().rowsBetween(-9, -5)
    lag = lambda c, n: F.lag(c, n).over(by_time())
    parts = {
        "ma_slope": ratio(F.col("ma5") - lag("ma5", 19), lag("ma5", 19)),
        "price_slope": ratio(F.col("close") - lag("close", 19), lag("close", 19)),
        "vol_prev": F.avg("volume").over(before),
        "rows20": F.count("*").over(by_time().rowsBetween(-19, 0)),
    }
    out = ma.withColumns(parts)
    gain = F.least(ratio(F.col("vol5"), F.col("vol_prev")) - 1, F.lit(0.2))
    raw = 0.4 * F.coalesce("ma_slope", F.lit(0.0)) + 0.4 * F.col("price_slope") + 0.2 * F.coalesce(gain, F.lit(0.0))
    strength = F.when(F.col("rows20") < 20, F.lit(0.5)).otherwise(clip(raw * 10, 0.0, 1.0))
    out = out.withColumn("strength", strength)
    up = (F.col("ma5") > F.col("ma20")) & (F.col("ma20") > F.col("ma60")) & (F.col("close") > F.col("ma20")) & (F.col("strength") > 0.6)
    return out.withColumn("uptrend", F.coalesce(up, F.lit(False))).drop("ma_slope", "price_slope", "vol_prev", "rows20")


def market_vote(df: DataFrame) -> DataFrame:
    """Share of symbols in an uptrend and mean strength per date."""
    g = trend_strength(df).groupBy("ts").agg(F.avg(F.col("uptrend").cast("double")).alias("share"), F.avg("strength").alias("strength"), F.count("*").alias("symbols"))
    return g.withColumn("market_up", F.col("share") >= 0.5)


def recent_trend(df: DataFrame, n: int = 20) -> DataFrame:
    """Slope over up to ``n`` closes, relative to their range, within 0.1 either way."""
    w = by_time().rowsBetween(-(n - 1), 0)
    x = F.row_number().over(by_time()).cast("double")
    rows = df.withColumn("__x", x)
    slope, span, count = F.regr_slope("close", "__x").over(w), F.max("close").over(w) - F.min("close").over(w), F.count("close").over(w)
    return rows.withColumns({"slope": slope, "span": span, "n": count}).withColumn("trend", F.coalesce(clip(ratio(F.col("slope"), F.col("span")) * F.col("n"), -0.1, 0.1), F.lit(0.0))).drop("__x", "slope", "span", "n")


def smoothed(pred: DataFrame, trend: DataFrame, columns: tuple[str, ...] = ("open", "high", "low", "close"), factor: float = 0.3) -> DataFrame:
    """Forecast prices as centred means, times one plus ``factor`` times the recent trend of the history.

    The width follows from the number ``n`` of a symbol's forecasts: a fifth of it, from 3 to 7; an even width reaches one row further
    back. ``trend`` has a row per symbol.
    """
    width = F.greatest(F.lit(3), F.least(F.lit(7), F.floor(F.count("*").over(Window.partitionBy("symbol")) / 5)))
    frames = {w: by_time().rowsBetween(-(w // 2), (w - 1) // 2) for w in range(3, 8)}
    sized = pred.withColumn("__width", width)
    means = {}
    for c in columns:
        mean = F.lit(None).cast("double")
        for w, frame in frames.items():
            mean = F.when(F.col("__width") == w, F.avg(c).over(frame)).otherwise(mean)
        means[c] = mean
    moved = sized.withColumns(means).drop("__width").join(trend.select("symbol", F.col("trend").alias("__trend")), "symbol")
    return moved.withColumns({c: F.col(c) * (1 + F.col("__trend") * factor) for c in columns}).drop("__trend")


def returns(df: DataFrame) -> DataFrame:
    """Change over the last known close, cumulated growth, running peak and drawdown."""
    known = F.last("close", ignorenulls=True).over(by_time().rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumn("__c", known).withColumn("__p", F.lag("__c").over(by_time()))
    out = out.withColumn("change", ratio(F.col("__c"), F.col("__p")) - 1)
    so_far = by_time().rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("growth", F.exp(F.sum(F.log(1 + F.coalesce("change", F.lit(0.0)))).over(so_far)))
    out = out.withColumn("peak", F.max("growth").over(so_far))
    return out.withColumn("drawdown", F.col("growth") / F.col("peak") - 1).drop("__c", "__p")


def signals(df: DataFrame, threshold: float) -> DataFrame:
    """1 or -1 where the change passes the threshold, carried forward; 0 before the first."""
    change = ratio(F.col("close"), F.lag("close").over(by_time())) - 1
    raw = df.withColumn("change", change).withColumn("raw_signal", F.when(F.col("change") > threshold, 1).when(F.col("change") < -threshold, -1).otherwise(0))
    held = F.last(F.when(F.col("raw_signal") != 0, F.col("raw_signal")), ignorenulls=True).over(by_time().rowsBetween(Window.unboundedPreceding, 0))
    return raw.withColumn("signal", F.coalesce(held, F.lit(0)))


def price_limits(pred: DataFrame, last: DataFrame, limit: float) -> DataFrame:
    """Forecast prices within ``limit`` of the previous limited close, starting from the given ``last_close`` of each symbol.

    Missing prices stay missing; behind a missing close nothing is limited until the next one.
    """
    prices = ("open", "high", "low", "close")
    both = pred.join(last.select("symbol", F.col("last_close").alias("__last")), "symbol")

    def step(state, *values):
        *bar, given = values
        before = given if state is None else state[0]
        out = tuple(v if v is None or before is None else max(min(v, before * (1 + limit)), before * (1 - limit)) for v in bar)
        return (out[-1],), out

    return fold(both, [*prices, "__last"], ", ".join(f"{c} double" for c in prices), lambda: None, step)


def threshold_strategy(pred: DataFrame, threshold: float = 0.03, capital: float = 100000.0) -> DataFrame:
    """Long-only in whole shares: all in when the predicted return passes the threshold, all out below its negative.

    ``pred``: ``predicted`` and ``actual`` of every bar. A row per bar with the value, the position and what was done.
    """

    def step(state, predicted, actual):
        cash, held = state
        action = None
        gain = (predicted - actual) / actual if predicted is not None and actual else 0.0
        if held == 0 and gain > threshold and int(cash / actual) > 0:
            held, action = int(cash / actual), "BUY"
            cash -= held * actual
        elif held > 0 and gain < -threshold:
            cash, held, action = cash + held * actual, 0, "SELL"
        return (cash, held), (cash + held * (actual or 0.0), held, actual, action)

    return fold(pred, ["predicted", "actual"], "value double, position long, price double, action string", lambda: (capital, 0), step)


def performance(backtest: DataFrame, capital: float = 100000.0, periods: int = 252, risk_free: float = 0.03) -> DataFrame:
    """Return, volatility, Sharpe ratio and drawdown of a backtest's values per symbol, and its trades: the i-th purchase is
    paired with the i-th sale; win rate and mean return are per pair. A symbol without trades has 0 for both."""
    before = F.lag("value").over(by_time())
    rows = backtest.withColumn("__r", F.when(before > 0, (F.col("value") - before) / before).otherwise(F.lit(0.0)))
    so_far = by_time().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__growth", F.product(1 + F.col("__r")).over(so_far))
    rows = rows.withColumn("__drawdown", F.col("__growth") / F.max("__growth").over(so_far) - 1)
    g = rows.groupBy("symbol").agg(
        F.count("*").alias("n"), F.max_by("value", "ts").alias("final_value"), F.stddev_samp("__r").alias("sd"), F.min("__drawdown").alias("max_drawdown"), F.count("action").alias("trades"),
    )
    done = backtest.filter("action is not null").withColumn("k", F.row_number().over(Window.partitionBy("symbol", "action").orderBy("ts")))
    pairs = done.groupBy("symbol", "k").agg(F.max(F.when(F.col("action") == "BUY", F.col("price"))).alias("b"), F.max(F.when(F.col("action") == "SELL", F.col("price"))).alias("s"))
    won = pairs.withColumn("r", ratio(F.col("s") - F.col("b"), F.col("b"))).groupBy("symbol").agg(F.avg((F.col("r") > 0).cast("double")).alias("win_rate"), F.avg("r").alias("mean_trade_return"))
    total = F.col("final_value") / capital - 1
    annual = F.pow(1 + total, F.lit(float(periods)) / F.col("n")) - 1
    vol = F.coalesce(F.col("sd"), F.lit(0.0)) * F.sqrt(F.lit(float(periods)))
    return g.join(won, "symbol", "left").select(
        "symbol", "final_value", total.alias("total_return"), annual.alias("annual_return"), vol.alias("volatility"), F.coalesce(ratio(annual - risk_free, vol), F.lit(0.0)).alias("sharpe"),
        "max_drawdown", F.coalesce("win_rate", F.lit(0.0)).alias("win_rate"), F.coalesce("mean_trade_return", F.lit(0.0)).alias("mean_trade_return"), "trades",
    )


def accuracy(pred: DataFrame) -> DataFrame:
    """Mean percentage error, share of errors below 5 %, agreement of direction between bars and correlation.

    A bar without a bar before it has no direction and counts as a miss.
    """
    e = F.abs(ratio(F.col("predicted") - F.col("actual"), F.col("actual")))
    d = pred.withColumns({"e": e, "dp": F.col("predicted") - F.lag("predicted").over(by_time()), "da": F.col("actual") - F.lag("actual").over(by_time())})
    same = F.coalesce(F.signum("dp") == F.signum("da"), F.lit(False))
    return d.groupBy("symbol").agg(
        F.avg("e").alias("mape"), F.avg(F.coalesce(F.col("e") < 0.05, F.lit(False)).cast("double")).alias("hit_rate"), F.avg(same.cast("double")).alias("direction"),
        safe_corr(F.col("predicted"), F.col("actual")).alias("correlation"),
    )
