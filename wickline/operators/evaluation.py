"""Leakage-free evaluation: calendar, cohorts, windows, baselines, metrics, ranking, comparison.

A candle frame is shuffled once by symbol; the calendar has as many rows as there are dates and the cohorts
one per month, whatever the number of symbols.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickline.functions.numeric import average_rank, close_to, ratio, safe_corr, same_sign
from wickline.operators.frames import by_time
from wickline.session import cut


KEYS = ("symbol", "candidate_month", "forecast_origin")


def canonical_calendar(candles: DataFrame, threshold: float) -> DataFrame:
    """Dates that at least ``ceil(symbols * threshold)`` symbols share."""
    days = candles.select("symbol", F.to_date("ts").alias("ts")).distinct()
    need = candles.agg(F.ceil(F.countDistinct("symbol") * F.lit(threshold) - 1e-12).alias("need"))
    return days.groupBy("ts").agg(F.count("*").alias("symbols")).join(F.broadcast(need), F.col("symbols") >= F.col("need")).select("ts", "symbols")


def monthly_cohorts(calendar: DataFrame, horizon: int) -> DataFrame:
    """First date of each month with the next ``horizon`` calendar dates; short ones have ``complete`` false.

    The calendar is one ordered series of dates (some thousands of rows at any number of candles).
    """
    line = Window.orderBy("ts")
    ahead = F.collect_list("ts").over(line.rowsBetween(1, horizon))
    rows = calendar.select("ts", ahead.alias("targets"), F.date_format("ts", "yyyy-MM").alias("candidate_month"))
    first = rows.groupBy("candidate_month").agg(F.min_by(F.struct("ts", "targets"), "ts").alias("x"))
    return first.select("candidate_month", F.col("x.ts").alias("forecast_origin"), F.col("x.targets").alias("targets"), (F.size("x.targets") == horizon).alias("complete"))


def history(candles: DataFrame, lookback: int) -> DataFrame:
    """Everything known at each bar, from frames that end there: position, closes, baselines' inputs."""
    frame = by_time().rowsBetween(-(lookback - 1), 0)
    last20 = by_time().rowsBetween(-19, 0)
    numbered = candles.withColumn("rn", F.row_number().over(by_time()))
    x = F.col("rn").cast("double")
    return numbered.withColumns({
        "history_rows": F.col("rn").cast("long"),
        "context_rows": F.count("*").over(frame),
        "context_start": F.min("ts").over(frame),
        "first20": F.lag("close", 19).over(by_time()),
        "low20": F.min("close").over(last20),
        "mean20": F.avg("close").over(last20),
        "slope20": F.regr_slope(F.col("close"), x).over(last20),
    }).drop("rn")


def windows(hist: DataFrame, cohorts: DataFrame, lookback: int) -> DataFrame:
    """One row per symbol and complete cohort whose origin exists, with enough history; no target in sight."""
    c = F.broadcast(cohorts.filter("complete"))  # one row per month
    return hist.join(c, F.col("ts") == F.col("forecast_origin")).filter(F.col("history_rows") >= lookback).withColumnRenamed("close", "history_last_close")


def targets(wins: DataFrame, candles: DataFrame) -> DataFrame:
    """Actual closes of every window, horizon step by step; joined after prediction only."""
    steps = wins.select(*KEYS, "history_last_close", F.posexplode("targets").alias("pos", "target_ts"))
    actual = candles.select("symbol", F.col("ts").alias("target_ts"), F.col("close").alias("actual_close"))
    return steps.join(actual, ["symbol", "target_ts"], "left").select(*KEYS, "history_last_close", (F.col("pos") + 1).cast("long").alias("horizon_step"), "target_ts", "actual_close")


def finite_windows(wins: DataFrame, targets: DataFrame, candles: DataFrame, lookback: int) -> DataFrame:
    """Windows whose context closes and target closes are all finite numbers; ``candles`` are those of ``history``."""
    odd = (F.col("close").isNull() | F.isnan("close") | (F.abs("close") == float("inf"))).cast("int")
    seen = candles.select("symbol", F.col("ts").alias("forecast_origin"), F.sum(odd).over(by_time().rowsBetween(-(lookback - 1), 0)).alias("__odd"))
    good = F.coalesce(~F.isnan("actual_close") & (F.abs("actual_close") < float("inf")), F.lit(False))
    whole = targets.groupBy(*KEYS).agg(F.min(good.cast("int")).alias("__good"))
    return wins.join(seen.filter("__odd = 0"), ["symbol", "forecast_origin"]).join(whole.filter("__good = 1"), list(KEYS)).drop("__odd", "__good")


def walk_forward(df: DataFrame, lookback: int, horizon: int, forecast: Column | None = None) -> DataFrame:
    """Forecasts of the next ``horizon`` bars at every ``horizon``-th bar from ``lookback`` on, beside the bars that come.

    ``forecast``: an expression over the bar and ``step`` (default: the last close stands still).
    """
    placed = df.select("symbol", "ts", "close", (F.row_number().over(by_time()) - 1).alias("i"), F.count("*").over(Window.partitionBy("symbol")).alias("n"))
    at = (F.col("i") >= lookback) & (F.col("i") + horizon < F.col("n")) & ((F.col("i") - lookback) % horizon == 0)
    points = placed.filter(at).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    guess = F.col("close") if forecast is None else forecast
    points = points.select("symbol", F.col("ts").alias("origin"), "step", (F.col("i") + F.col("step")).alias("i"), guess.alias("predicted"))
    return points.join(placed.select("symbol", "i", "ts", F.col("close").alias("actual")), ["symbol", "i"]).drop("i")


def global_mean(parts: DataFrame, total: str, count: str, *keys: str) -> DataFrame:
    """The mean over all workers from their partial sums and counts."""
    return parts.groupBy(*keys).agg((F.sum(total) / F.nullif(F.sum(count), F.lit(0))).alias("mean"))


def window_skips(candles: DataFrame, cohorts: DataFrame, lookback: int) -> DataFrame:
    """Why a (symbol, month) has no window; the first reason in order wins."""
    full = cohorts.filter("complete")
    grid = candles.select("symbol").distinct().crossJoin(F.broadcast(full))  # symbols x months, the fact's own grain
    have = candles.select("symbol", "ts").distinct()
    pos = have.withColumn("rn", F.row_number().over(by_time()).cast("long"))
    origin = grid.join(pos.withColumnRenamed("ts", "forecast_origin"), ["symbol", "forecast_origin"], "left")
    aims = grid.select("symbol", "candidate_month", F.explode("targets").alias("ts")).join(have.withColumn("hit", F.lit(1)), ["symbol", "ts"], "left")
    found = aims.groupBy("symbol", "candidate_month").agg(F.count("hit").alias("available_target_rows"))
    rows = origin.join(found, ["symbol", "candidate_month"])
    reason = F.when(F.col("rn").isNull(), "missing_origin_date").when(F.col("available_target_rows") < F.size("targets"), "missing_target_date").when(F.col("rn") < lookback, "insufficient_history")
    return rows.withColumn("reason_code", reason).filter("reason_code is not null").select(
        "symbol", "candidate_month", "reason_code", F.coalesce("rn", F.lit(0)).alias("available_history_rows"), "available_target_rows"
    )


def baselines(wins: DataFrame, horizon: int) -> DataFrame:
    """Long forecasts of three methods; methods with an invalid step are marked as a whole."""
    h = F.col("horizon_step")
    rate = F.when((F.col("first20") > 0) & (F.col("history_last_close") > 0), F.pow(F.col("history_last_close") / F.col("first20"), F.lit(1 / 19)) - 1)
    steps = wins.withColumn("rate", rate).withColumn("horizon_step", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(horizon).cast("long"))))
    methods = F.array(
        F.struct(F.lit("last_close").alias("method"), F.col("history_last_close").alias("predicted_close")),
        F.struct(F.lit("momentum_20").alias("method"), (F.col("history_last_close") * F.pow(1 + F.col("rate"), h)).alias("predicted_close")),
        F.struct(F.lit("trend_20").alias("method"), F.when(F.col("history_rows") >= 20, F.col("mean20") + F.col("slope20") * (9.5 + h)).alias("predicted_close")),
    )
    long = steps.select(*KEYS, "history_last_close", "horizon_step", F.explode(methods).alias("m")).select(*KEYS, "history_last_close", "horizon_step", "m.*")
    good = F.col("predicted_close").isNotNull() & ~F.isnan("predicted_close") & (F.col("predicted_close") > 0)
    worst = F.min(good.cast("int")).over(Window.partitionBy(*KEYS, "method"))
    return long.withColumn("valid", worst == 1)


def prediction_fact(forecasts: DataFrame, actuals: DataFrame) -> DataFrame:
    """Valid forecasts beside the actual closes; windows that lack a target are skipped whole."""
    both = forecasts.filter("valid").drop("valid").join(actuals.drop("history_last_close"), [*KEYS, "horizon_step"])
    known = F.min(F.col("actual_close").isNotNull().cast("int")).over(Window.partitionBy(*KEYS, "method"))
    return both.withColumn("__known", known).filter("__known = 1").drop("__known")


def window_metrics(fact: DataFrame) -> DataFrame:
    """Errors per window and method; the last step decides returns and direction."""
    e = F.col("predicted_close") - F.col("actual_close")
    last = lambda c: F.max_by(c, "horizon_step")
    g = fact.groupBy(*KEYS, "method").agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        last("predicted_close").alias("p"), last("actual_close").alias("a"), last("target_ts").alias("final_target_ts"), F.min_by("history_last_close", "horizon_step").alias("history_last_close"),
    )
    p, a, c = F.col("p"), F.col("a"), F.col("history_last_close")
    out = g.withColumns({
        "actual_final_close": a, "final_abs_error": F.abs(p - a), "final_ape": ratio(F.abs(p - a), F.abs(a)),
        "predicted_return": ratio(p, c) - 1, "actual_return": ratio(a, c) - 1,
        "predicted_log_return": F.when((p > 0) & (c > 0), F.log(p / c)), "actual_log_return": F.when((a > 0) & (c > 0), F.log(a / c)),
    })
    return out.withColumns({
        "log_return_abs_error": F.abs(F.col("predicted_log_return") - F.col("actual_log_return")),
        "direction_correct": same_sign(F.col("predicted_return"), F.col("actual_return")),
    }).drop("p", "a")


def summary(metrics: DataFrame, *keys: str) -> DataFrame:
    """Aggregates of window metrics per ``keys``."""
    return metrics.groupBy(*keys).agg(
        F.count("*").alias("windows"), F.countDistinct("symbol").alias("symbols"), F.avg("mae").alias("mean_mae"), F.median("mae").alias("median_mae"), F.avg("rmse").alias("mean_rmse"),
        F.avg("final_ape").alias("mean_ape"), F.avg(F.col("direction_correct").cast("double")).alias("direction_accuracy"),
        safe_corr(F.col("predicted_return"), F.col("actual_return")).alias("return_pearson"),
    )


def ranking(metrics: DataFrame, minimum: int, top: int = 5) -> DataFrame:
    """Cross-section per month and method: Spearman, overlap of the top names, their realised return."""
    by = ("candidate_month", "forecast_origin", "method")
    order = lambda c: Window.partitionBy(*by).orderBy(F.desc(c), "symbol")
    r = metrics.filter("predicted_return is not null and actual_return is not null").withColumns({
        "rp": F.row_number().over(order("predicted_return")), "ra": F.row_number().over(order("actual_return")),
        "sp": average_rank(F.col("predicted_return"), *by), "sa": average_rank(F.col("actual_return"), *by),
    })
    g = r.groupBy(*by).agg(
        F.count("*").alias("eligible"), safe_corr(F.col("sp"), F.col("sa")).alias("spearman"),
        F.sum(((F.col("rp") <= top) & (F.col("ra") <= top)).cast("long")).alias("top_overlap"),
        F.avg(F.when(F.col("rp") <= top, F.col("actual_return"))).alias("top_return"),
    )
    ok = F.col("eligible") >= minimum
    return g.select(*by, "eligible", ok.alias("ranking_available"), *[F.when(ok, F.col(c)).alias(c) for c in ("spearman", "top_overlap", "top_return")])


def require_positive(metrics: DataFrame) -> DataFrame:
    """Benchmark metrics, or an error when a row is read whose prices have no logarithm."""
    bad = F.col("predicted_log_return").isNull() | F.col("actual_log_return").isNull()
    where = F.concat_ws(" ", F.lit("log-return prices must be strictly positive:"), "symbol", "candidate_month", "method")
    return metrics.withColumn("log_return_abs_error", F.when(bad, F.raise_error(where).cast("double")).otherwise(F.col("log_return_abs_error")))


#: What both sides of a pair must agree on.
CHECKS = ("final_target_ts", "history_last_close", "actual_final_close", "scoring_target_view", "exposure_bucket", "common_target_fingerprint")


def benchmark_summary(metrics: DataFrame, *keys: str) -> DataFrame:
    """Aggregates of benchmark metrics per ``keys`` (null keys are groups of their own)."""
    return metrics.groupBy(*keys).agg(
        F.count("*").alias("windows"), F.countDistinct("symbol").alias("symbols"), F.avg("log_return_abs_error").alias("mean_log_return_abs_error"),
        F.median("log_return_abs_error").alias("median_log_return_abs_error"), F.avg("final_ape").alias("mean_final_ape"), F.median("final_ape").alias("median_final_ape"),
        F.avg("mae").alias("mean_mae"), F.avg("rmse").alias("mean_rmse"), F.avg(F.col("direction_correct").cast("double")).alias("direction_accuracy"),
    )


def benchmark_ranking(metrics: DataFrame, minimum: int, top: int = 5) -> DataFrame:
    """Cross-section per arm, month and method by log returns: Spearman, overlap of the top names, their realised returns."""
    by = ("experiment_arm", "candidate_month", "forecast_origin", "method")
    order = lambda c: Window.partitionBy(*by).orderBy(F.desc(c), "symbol")
    r = metrics.withColumns({
        "rp": F.row_number().over(order("predicted_log_return")), "ra": F.row_number().over(order("actual_log_return")),
        "sp": average_rank(F.col("predicted_log_return"), *by), "sa": average_rank(F.col("actual_log_return"), *by),
    })
    picked = lambda c: F.avg(F.when(F.col("rp") <= top, F.col(c)))
    g = r.groupBy(*by).agg(
        F.count("*").alias("eligible"), safe_corr(F.col("sp"), F.col("sa")).alias("spearman"), F.sum(((F.col("rp") <= top) & (F.col("ra") <= top)).cast("long")).alias("top_overlap"),
        picked("actual_return").alias("top_return"), picked("actual_log_return").alias("top_log_return"),
    )
    ok = F.col("eligible") >= minimum
    return g.select(*by, "eligible", ok.alias("ranking_available"), *[F.when(ok, F.col(c)).alias(c) for c in ("spearman", "top_overlap", "top_return", "top_log_return")])


def overall(metrics: DataFrame, skips: DataFrame, rankings: DataFrame, primary: str) -> DataFrame:
    """One row: windows of the primary method, skipped windows, symbols and cohorts with a ranking."""
    m = metrics.agg(F.count_if(F.col("method") == primary).alias("eligible_windows"), F.countDistinct("symbol").alias("symbols_evaluated"))
    k = skips.agg(F.count("*").alias("skipped_windows"))
    r = rankings.agg(F.count_if("ranking_available").alias("ranking_cohorts"))
    return m.crossJoin(k).crossJoin(r)  # single rows


def paired(metrics: DataFrame, specs: list[tuple[str, str, str]], value: str = "log_return_abs_error", name: str = "method", checks: tuple[str, ...] = CHECKS, strict: bool = False) -> DataFrame:
    """(comparison, challenger, reference) pairs of methods on common windows, all at once.

    The methods of a window meet in one map (a window has a handful), without joining the metrics to themselves; a method that
    a window has twice is an error. Both sides must agree on the ``checks`` that the metrics have: ``mismatch`` names the first
    that they do not agree on; with ``strict`` that is an error, raised when the pair is read.
    """
    kept = [c for c in checks if c in metrics.columns]
    cells = F.struct(F.col(value).alias("error"), *kept)
    twice = F.raise_error(F.concat_ws(" ", F.lit("a window has a method twice:"), *KEYS)).cast("int")
    m = metrics.groupBy(*KEYS).agg(F.collect_list(F.struct(F.col(name).alias("k"), cells.alias("v"))).alias("all"))
    once = F.size(F.array_distinct(F.transform("all", lambda x: x.k))) == F.size("all")
    m = m.withColumn("__one", F.when(once, 1).otherwise(twice)).filter("__one = 1").withColumn("all", F.map_from_entries("all"))
    table = F.array(*[F.struct(F.lit(i).alias("comparison_id"), F.lit(c).alias("challenger"), F.lit(r).alias("reference")) for i, c, r in specs])
    both = m.withColumn("s", F.explode(table)).select(*KEYS, "s.*", F.col("all")[F.col("s.challenger")].alias("c"), F.col("all")[F.col("s.reference")].alias("r")).filter("c is not null and r is not null")
    kinds = dict(metrics.dtypes)
    agree = lambda x: close_to(F.col(f"c.{x}"), F.col(f"r.{x}")) if kinds[x] == "double" else F.col(f"c.{x}").eqNullSafe(F.col(f"r.{x}"))
    mismatch = F.coalesce(*[F.when(~agree(x), F.lit(x)) for x in kept], F.lit(None).cast("string"))
    both = both.withColumn("mismatch", mismatch)
    diff = F.col("c.error") - F.col("r.error")
    if strict:
        said = F.concat_ws(" ", F.lit("paired target mismatch:"), "mismatch", *KEYS)
        diff = F.when(F.col("c").isNotNull() & F.col("r").isNotNull() & F.col("mismatch").isNotNull(), F.raise_error(said).cast("double")).otherwise(diff)
    carried = [F.col(f"c.{c}").alias(c) for c in ("exposure_bucket", "common_target_fingerprint") if c in kept]
    return both.select(
        *KEYS, "comparison_id", "challenger", "reference", F.col("c.error").alias("challenger_error"), F.col("r.error").alias("reference_error"), diff.alias("difference"),
        F.when(diff < 0, "challenger").when(diff > 0, "reference").otherwise("tie").alias("winner"), "mismatch", F.col("mismatch").isNull().alias("consistent"), *carried,
    )


def bootstrap(pairs: DataFrame, clusters: dict[str, int], draws: int, level: float = 0.95, per_task: int = 250) -> DataFrame:
    """Intervals of the mean difference, drawing whole clusters with replacement; ``clusters``: column and its seed.

    Pairs are read once and summed per cluster, so that a draw adds (sum, n) pairs. A comparison's sums are two arrays (a pair of numbers per
    cluster); a draw is a fold over them inside one row, so that nothing is shuffled but the draws' means. The index of a
    place in a draw is a hash of seed, draw and place, equal on every run and engine.
    """
    if draws < 1 or not 0 < level < 1:
        raise ValueError("draws must be positive and level between 0 and 1")
    kinds = F.array(*[F.struct(F.lit(c).alias("cluster_column"), F.lit(s).alias("seed"), F.col(c).cast("string").alias("cluster")) for c, s in clusters.items()])
    each = pairs.filter("difference is not null").select("comparison_id", "difference", F.explode(kinds).alias("x")).select("comparison_id", "difference", "x.*")
    sums = each.groupBy("comparison_id", "cluster_column", "seed", "cluster").agg(F.sum("difference").alias("s"), F.count("*").alias("n"))
    held = sums.groupBy("comparison_id", "cluster_column", "seed").agg(F.sort_array(F.collect_list(F.struct("cluster", "s", "n"))).alias("all"), F.count("*").alias("k"), F.sum("n").alias("n_rows"), (F.sum("s") / F.sum("n")).alias("mean_difference"))
    held = cut(held)  # a row per comparison and cluster column
    draw = pairs.sparkSession.range(0, draws, 1, max(1, -(-draws // per_task))).select(F.col("id").alias("draw"))
    rows = draw.crossJoin(F.broadcast(held.filter("k >= 2").select("comparison_id", "cluster_column", "seed", "k", F.transform("all", lambda x: x.s).alias("s"), F.transform("all", lambda x: x.n).alias("n"))))
    word = lambda place: F.substring(F.sha2(F.concat_ws(":", F.col("seed").cast("string"), F.col("draw").cast("string"), place.cast("string")), 256), 1, 8)
    picks = F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda p: F.pmod(F.conv(word(p), 16, 10).cast("long"), F.col("k")).cast("int"))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n"))
    fold = F.aggregate(picks, zero, lambda a, i: F.struct((a.s + F.get("s", i)).alias("s"), (a.n + F.get("n", i)).alias("n")), lambda a: a.s / a.n)
    means = rows.select("comparison_id", "cluster_column", fold.alias("m"))
    tail = (1 - level) / 2
    bounds = means.groupBy("comparison_id", "cluster_column").agg(F.percentile("m", F.lit(tail)).alias("lower"), F.percentile("m", F.lit(1 - tail)).alias("upper"))
    return held.join(bounds, ["comparison_id", "cluster_column"], "left").select(
        "comparison_id", "cluster_column", (F.col("k") >= 2).alias("available"), "n_rows", F.col("k").alias("clusters"), "mean_difference", "lower", "upper"
    )


def decisions(intervals: DataFrame) -> DataFrame:
    """Both intervals below 0: better; both above: worse; else inconclusive."""
    g = intervals.groupBy("comparison_id").agg(F.max("upper").alias("hi"), F.min("lower").alias("lo"), F.min(F.col("available").cast("int")).alias("ok"))
    return g.select("comparison_id", F.when((F.col("ok") == 1) & (F.col("hi") < 0), "robustly_better").when((F.col("ok") == 1) & (F.col("lo") > 0), "robustly_worse").otherwise("mixed_or_inconclusive").alias("decision"))
