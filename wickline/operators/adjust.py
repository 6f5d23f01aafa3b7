"""Corporate-action factors: diagnostics, rebased contexts, target views, exposure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickline.functions.numeric import ratio
from wickline.operators.frames import by_time
from wickline.operators.quality import typical_amount


TOLERANCE = 1e-6


def with_factor(df: DataFrame, strict: bool = True) -> DataFrame:
    """Provider factor adj_close / close. A factor that is not finite and positive is an error, raised when the row is
    read; ``strict=False`` drops such rows instead."""
    f = ratio(F.col("adj_close"), F.col("close"))
    good = F.coalesce((F.col("factor") > 0) & ~F.isnan("factor") & (F.col("factor") < float("inf")), F.lit(False))
    out = df.withColumn("factor", f)
    if not strict:
        return out.filter(good)
    where = F.concat_ws(" ", F.lit("provider factors must be finite and strictly positive:"), F.col("symbol"), F.col("ts").cast("string"))
    return out.withColumn("factor", F.when(good, F.col("factor")).otherwise(F.raise_error(where).cast("double")))


def diagnostics(df: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Per symbol: rows, range, extremes, changed rows and a fingerprint over the ordered factors.

    The fingerprint is the digest of the digests of the years, so that no list grows beyond a year's bars.
    """
    text = F.transform(F.sort_array(F.collect_list(F.struct("ts", "factor"))), lambda x: F.format_string("%s=%.6f", F.date_format(x.ts, "yyyy-MM-dd"), x.factor))
    years = df.groupBy("symbol", F.year("ts").alias("year")).agg(
        F.count("*").alias("n"), F.min("ts").alias("lo_ts"), F.max("ts").alias("hi_ts"), F.min("factor").alias("lo"), F.max("factor").alias("hi"),
        F.count_if(F.abs(F.col("factor") - 1) > tolerance).alias("changed"), F.sha2(F.array_join(text, "~"), 256).alias("digest"),
    )
    digests = F.transform(F.sort_array(F.collect_list(F.struct("year", "digest"))), lambda x: x.digest)
    return years.groupBy("symbol").agg(
        F.sum("n").alias("n_rows"), F.min("lo_ts").alias("first_ts"), F.max("hi_ts").alias("last_ts"), F.min("lo").alias("min_factor"), F.max("hi").alias("max_factor"),
        F.sum("changed").alias("adjusted_rows"), F.sha2(F.array_join(digests, "~"), 256).alias("fingerprint"),
    )


def total_fingerprint(records: DataFrame, name: str = "symbol", digest: str = "fingerprint") -> DataFrame:
    """One digest over the digests of all names, in the order of the names (a row per name)."""
    rows = F.sort_array(F.collect_list(F.struct(name, digest)))
    return records.agg(F.sha2(F.array_join(F.transform(rows, lambda x: F.concat(x[name], F.lit("="), x[digest])), "~"), 256).alias("fingerprint"), F.count("*").alias("names"))


def rebase(df: DataFrame, origins: DataFrame) -> DataFrame:
    """Prices times factor over the factor at the origin; volume raw; amount anew; envelope kept."""
    at = df.join(origins, (df.symbol == origins.origin_symbol) & (df.ts == origins.origin)).select("origin_symbol", "origin", F.col("factor").alias("origin_factor"))
    both = df.join(at, (df.symbol == at.origin_symbol)).withColumn("scale", F.col("factor") / F.col("origin_factor"))
    out = both.withColumns({c: F.col(c) * F.col("scale") for c in ("open", "high", "low", "close")})
    out = out.withColumn("high", F.greatest("high", "open", "close", "low"))
    out = out.withColumn("low", F.least("low", "open", "close", "high"))
    return out.withColumn("amount", typical_amount(F.col("high"), F.col("low"), F.col("close"), F.col("volume"))).drop("origin_symbol", "origin_factor")


def exposure(df: DataFrame, lookback: int, tolerance: float = TOLERANCE) -> DataFrame:
    """Largest factor step inside the lookback window of each bar, and the bucket of the context alone."""
    step = F.abs(F.log(F.col("factor")) - F.log(F.lag("factor").over(by_time())))
    stepped = df.withColumn("log_step", step)
    worst = F.max("log_step").over(by_time().rowsBetween(-(lookback - 2), 0))
    out = stepped.withColumn("context_max_abs_log_step", F.coalesce(worst, F.lit(0.0)))
    return out.withColumn("exposure_bucket", F.when(F.col("context_max_abs_log_step") > tolerance, "material_factor_change").otherwise("no_material_change"))


def target_rows(df: DataFrame, horizon: int) -> DataFrame:
    """Every bar as an origin with its ``horizon`` next bars, joined after prediction only; origins near the end have none.

    Target prices are multiplied by the target's factor over the origin's; volume raw; amount anew; envelope kept.
    """
    bar = F.struct("ts", "open", "high", "low", "close", "volume", "factor")
    ahead = F.collect_list(bar).over(by_time().rowsBetween(1, horizon))
    origins = df.select("symbol", F.col("ts").alias("origin"), F.col("factor").alias("origin_factor"), ahead.alias("ahead")).filter(F.size("ahead") == horizon)
    long = origins.select("symbol", "origin", "origin_factor", F.posexplode("ahead").alias("pos", "x"))
    out = long.select("symbol", "origin", "origin_factor", (F.col("pos") + 1).cast("long").alias("horizon_step"), "x.*")
    out = out.withColumns({c: F.col(c) * (F.col("factor") / F.col("origin_factor")) for c in ("open", "high", "low", "close")})
    out = out.withColumn("high", F.greatest("high", "open", "close", "low"))
    out = out.withColumn("low", F.least("low", "open", "close", "high"))
    return out.withColumn("amount", typical_amount(F.col("high"), F.col("low"), F.col("close"), F.col("volume")))


def window_exposure(df: DataFrame, lookback: int, horizon: int, tolerance: float = TOLERANCE) -> DataFrame:
    """Per origin the largest factor step of its context and the largest distance of a target's factor from the origin's."""
    far = F.max(F.abs(F.log(F.col("factor") / F.col("origin_factor")))).alias("target_max_abs_log_factor")
    targets = target_rows(df, horizon).groupBy("symbol", F.col("origin").alias("ts")).agg(far)
    both = exposure(df, lookback, tolerance).drop("exposure_bucket").join(targets, ["symbol", "ts"])
    both = both.withColumn("context_changed", F.col("context_max_abs_log_step") > tolerance).withColumn("target_changed", F.col("target_max_abs_log_factor") > tolerance)
    return both.withColumn("exposure_bucket", F.when(F.col("context_changed") | F.col("target_changed"), "material_factor_change").otherwise("no_material_change"))


def cohort_exposure(df: DataFrame, cohorts: DataFrame, lookback: int, tolerance: float = TOLERANCE) -> DataFrame:
    """Exposure of the windows of common-origin cohorts: factor steps in the context, and the distance of the targets' factors."""
    stepped = df.select("symbol", "ts", "factor", F.abs(F.log("factor") - F.log(F.lag("factor").over(by_time()))).alias("step"))
    worst = stepped.withColumn("context_max_abs_log_step", F.coalesce(F.max("step").over(by_time().rowsBetween(-(lookback - 2), 0)), F.lit(0.0)))
    full = F.broadcast(cohorts.filter("complete").select("candidate_month", "forecast_origin", "targets"))  # one row per month
    at = worst.join(full, F.col("ts") == F.col("forecast_origin")).select("symbol", "candidate_month", "forecast_origin", "context_max_abs_log_step", F.col("factor").alias("origin_factor"), F.explode("targets").alias("ts"))
    far = at.join(df.select("symbol", "ts", "factor"), ["symbol", "ts"], "left")
    g = far.groupBy("symbol", "candidate_month", "forecast_origin").agg(
        F.max("context_max_abs_log_step").alias("context_max_abs_log_step"), F.coalesce(F.max(F.abs(F.log(F.col("factor") / F.col("origin_factor")))), F.lit(0.0)).alias("target_max_abs_log_from_origin"),
    )
    g = g.withColumns({"context_factor_changed": F.col("context_max_abs_log_step") > tolerance, "target_factor_changed": F.col("target_max_abs_log_from_origin") > tolerance})
    return g.withColumn("exposure_bucket", F.when(F.col("context_factor_changed") | F.col("target_factor_changed"), "material_factor_change").otherwise("no_material_change"))
