"""Position folds, portfolio scores, forecast plans, bounds and summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickline.functions.numeric import clip, ratio
from wickline.operators.frames import fold


def signal_backtest(df: DataFrame, signal: str, capital: float = 100000.0, keep_cash: bool = True) -> DataFrame:
    """Whole-share positions that follow a signal; value, position, price and trade of every bar with a price.

    From the second bar on, a position opens when flat and the signal is not 0, and closes when the signal is 0. ``keep_cash=False``
    forgets the cash that was left over when a position closes, as an older convention has it.
    """

    def step(state, price, now):
        cash, held, begun = state
        if price is None:
            return (cash, held, True), None
        action = None
        if begun and held and now == 0:
            cash, held, action = held * price + (cash if keep_cash else 0.0), 0, "SELL"
        elif begun and not held and now:
            shares = math.floor(cash / price) if price else 0
            if shares > 0:
                cash, held, action = cash - shares * price, shares * int(now), "BUY"
        return (cash, held, True), (cash + held * price, held, price, action)

    return fold(df, ["close", signal], "value double, position long, price double, action string", lambda: (capital, 0, False), step)


def scores(windows: DataFrame, predicted: str, last: str) -> DataFrame:
    """Last, mean, highest and lowest forecast less the last close; one row per kind."""
    p, c = F.col(predicted), F.col(last)
    mean = F.aggregate(p, F.lit(0.0), lambda a, x: a + x) / F.size(p)
    kinds = {"last": F.element_at(p, -1), "mean": mean, "max": F.array_max(p), "min": F.array_min(p)}
    rows = F.array(*[F.struct(F.lit(k).alias("signal_type"), (v - c).alias("score")) for k, v in kinds.items()])
    return windows.withColumn("__s", F.explode(rows)).select(*[x for x in windows.columns if x not in (predicted, last)], "__s.*")


def forecast_plan(df: DataFrame, target_days: int = 60) -> DataFrame:
    """Lookback and length of a forecast from the density of bars."""
    g = df.groupBy("symbol").agg(F.count("*").cast("double").alias("n"), F.datediff(F.max("ts"), F.min("ts")).cast("double").alias("days"))
    g = g.withColumn("density", F.coalesce(ratio(F.col("n"), F.when(F.col("days") > 0, F.col("days"))), F.lit(0.7)))
    g = g.withColumn("ahead", F.floor(target_days * F.col("density")))
    back = F.least(F.col("ahead") * 3, F.floor(F.col("n") * 0.7), F.col("n") - F.col("ahead"))
    g = g.withColumn("back", back).withColumn("ahead", F.least("ahead", F.col("n") - F.col("back")))
    return g.select("symbol", F.greatest(F.lit(100), F.least("back", F.lit(400))).cast("long").alias("lookback"), F.greatest(F.lit(20), F.least("ahead", F.lit(120))).cast("long").alias("pred_len"))


def price_band(price: Column, known: Column) -> tuple[Column, Column]:
    """Lower and upper reference price: 25 % either way for known codes, else 30 %; never below 1."""
    share = F.when(known, 0.25).otherwise(0.3)
    return F.greatest(F.lit(1.0), price * (1 - share)), price * (1 + share)


def apply_factor(df: DataFrame, factor: Column) -> DataFrame:
    """Prices times a factor within 10 % either way; volume by three tenths of the change."""
    f = clip(factor, 0.9, 1.1)
    return df.withColumns({c: F.col(c) * f for c in ("open", "high", "low", "close")} | {"volume": F.col("volume") * (1 + (factor - 1) * 0.3)})


def outlook(factor: Column, strength: Column, hot: Column, macro: Column, fundamentals: Column) -> Column:
    """Sentiment, drivers, risks and suggestion of a scored row."""
    picked = lambda *pairs: F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in pairs]), lambda x: x.isNotNull())
    drivers = picked(("trend", strength > 0.6), ("sector", hot), ("macro", macro > 0.7), ("fundamentals", fundamentals > 0.6))
    risks = picked(("trend", strength < 0.4), ("sector", ~hot))
    return F.struct(
        F.when(factor > 1, "positive").otherwise("cautious").alias("sentiment"), F.array_join(drivers, ",").alias("drivers"), F.array_join(risks, ",").alias("risks"),
        F.when(F.size(drivers) > F.size(risks), "watch").otherwise("careful").alias("suggestion"),
    )


def buffered_range(calendar: DataFrame, begin: str, end: str, lookback: int, ahead: int) -> DataFrame:
    """One row: the dates to load so that every day of [begin, end] has its lookback and horizon."""
    line = calendar.select("ts", (F.row_number().over(Window.orderBy("ts")) - 1).alias("i"))
    at = line.agg(
        F.count_if(F.col("ts") < F.lit(begin).cast("date")).alias("b"), (F.count_if(F.col("ts") <= F.lit(end).cast("date")) - 1).alias("e"), F.max("i").alias("top"),
    ).select(F.greatest(F.col("b") - lookback, F.lit(0)).alias("lo"), F.least(F.col("e") + ahead, F.col("top")).alias("hi"))
    both = line.join(F.broadcast(at), (F.col("i") == F.col("lo")) | (F.col("i") == F.col("hi")))  # one row
    return both.agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))


def group_codes(v: Column, groups: int, width: int) -> Column:
    """Indexes of equal groups of signs, highest bit first."""
    bits = lambda g: F.slice(v, g * width + 1, F.lit(width))
    return F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.aggregate(bits(g), F.lit(0).cast("long"), lambda a, x: a * 2 + F.when(x > 0, 1).otherwise(0)))


def seeded_sample(df: DataFrame, seed: int, key: str, n: int) -> DataFrame:
    """``n`` rows by a hash of seed and key: the same on every run and partitioning (a sampling operator)."""
    return df.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key).limit(n)


def seeded_uniform(seed: int, *keys: Column) -> Column:
    """A number from 0 to 1 by a hash of seed and keys: equal on every run and engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def tame_outliers(df: DataFrame, factor: Column, columns: tuple[str, ...] = ("open", "high", "low", "close"), bound: float = 0.3) -> DataFrame:
    """Forecast prices further than ``bound`` from the ``current`` price: their distance is scaled by ``factor`` (0.8 to 1.2)."""
    far = lambda c: F.abs(F.col(c) - F.col("current")) > F.col("current") * bound
    return df.withColumns({c: F.when(far(c), F.col("current") * (1 + (ratio(F.col(c), F.col("current")) - 1) * factor)).otherwise(F.col(c)) for c in columns})


def after_holidays(df: DataFrame, holidays: list[tuple[str, int, float]], columns: tuple[str, ...] = ("open", "high", "low", "close")) -> DataFrame:
    """Prices from the end of a holiday on, for a number of days, times one plus its strength; (end, days, strength)."""
    effect = F.lit(1.0)
    for end, days, strength in holidays:
        last = F.lit(end).cast("date")
        effect = effect * F.when((F.col("ts") >= last) & (F.col("ts") < F.date_add(last, days)), 1 + strength).otherwise(1.0)
    return df.withColumns({c: F.col(c) * effect for c in columns})


def jitter_volume(df: DataFrame, mean: Column, factor: Column) -> DataFrame:
    """Volume times ``factor``, within 0.3 and 3 times the history's mean."""
    return df.withColumn("volume", F.greatest(F.least(F.col("volume") * factor, mean * 3.0), mean * 0.3))


def topk_dropout(
    bars: DataFrame, topk: int = 50, n_drop: int = 5, hold: int = 5, account: float = 100_000_000.0, open_cost: float = 0.001, close_cost: float = 0.0015, min_cost: float = 5.0, limit: float = 0.095, invested: float = 0.95,
) -> DataFrame:
    """A daily portfolio of the ``topk`` best scores that drops at most ``n_drop`` names a day; a row per day.

    ``bars``: symbol, ts, open, close and ``score``, which is known at the close and acted on at the next day's open. Each day the held
    names and the best others are ranked together; held names among the last ``n_drop`` are sold once held for ``hold`` days, and the
    freed places are bought with equal shares of the ``invested`` part of the cash. Nothing is traded without a price or with an
    opening move of ``limit`` or more against the last close (no purchase at the upper, no sale at the lower limit).

    The portfolio is one series of days by definition. Its task reads only names that were among the best
    ``topk + n_drop`` of some day: no other name can ever be held.
    """
    by_day = Window.partitionBy("ts").orderBy(F.desc("score"), "symbol")
    yesterday = Window.partitionBy("symbol").orderBy("ts")
    known = bars.select("symbol", "ts", "open", "close", F.lag("score").over(yesterday).alias("score"), F.lag("close").over(yesterday).alias("before"))
    ranked = known.withColumn("rank", F.when(F.col("score").isNotNull(), F.row_number().over(by_day)))
    able = ranked.filter(F.col("rank") <= topk + n_drop).select("symbol").distinct()
    rows = F.struct("symbol", "open", "close", "score", "before")
    days = ranked.join(able, "symbol", "left_semi").groupBy("ts").agg(F.collect_list(rows).alias("rows")).withColumn("all", F.lit(1))

    def step(state, today):
        cash, held = state  # name: (shares, days held, last close)
        at = {r["symbol"]: r for r in today}
        scored = sorted((r["symbol"] for r in today if r["score"] is not None), key=lambda n: (-at[n]["score"], n))
        move = lambda n: at[n]["open"] / at[n]["before"] - 1 if n in at and at[n]["open"] and at[n]["before"] else None
        own = [n for n in scored if n in held] + sorted(n for n in held if n not in at or at[n]["score"] is None)
        fresh = [n for n in scored if n not in held][: n_drop + topk - len(own)]
        together = sorted(own + fresh, key=lambda n: (n not in at or at[n]["score"] is None, -(at[n]["score"] or 0.0) if n in at else 0.0, n))
        weak = set(together[-n_drop:])
        cost = turnover = 0.0
        sold = 0
        for n in [n for n in own if n in weak and held[n][1] >= hold]:
            if move(n) is not None and move(n) > -limit:
                value = held.pop(n)[0] * at[n]["open"]
                fee = max(min_cost, value * close_cost)
                cash, cost, turnover, sold = cash + value - fee, cost + fee, turnover + value, sold + 1
        buy = [n for n in fresh[: max(sold + topk - len(own), 0)] if move(n) is not None and move(n) < limit]
        share = cash * invested / len(buy) if buy else 0.0
        for n in buy:
            shares = math.floor(share / (at[n]["open"] * (1 + open_cost)))
            if shares > 0:
                value = shares * at[n]["open"]
                fee = max(min_cost, value * open_cost)
                cash, cost, turnover = cash - value - fee, cost + fee, turnover + value
                held[n] = (shares, 0, at[n]["open"])
        worth = 0.0
        for n, (shares, age, price) in list(held.items()):
            price = at[n]["close"] if n in at and at[n]["close"] is not None else price
            held[n] = (shares, age + 1, price)
            worth += shares * price
        return (cash, held), (cash + worth, cash, len(held), cost, turnover)

    return fold(days, ["rows"], "value double, cash double, names long, cost double, turnover double", lambda: (account, {}), step, key="all").drop("all")
