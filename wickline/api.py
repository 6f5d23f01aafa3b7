"""Functions behind a service: file listing, profiles, single-series forecasts with their actual bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wickline.functions.numeric import ratio
from wickline.operators import features
from wickline.operators.predictor import SCHEMA, Predictor, last_close_stub, predict
from wickline.sources import files

__all__ = ["Predictors", "SCHEMA", "continuity", "data_files", "forecast", "load_data"]


def data_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files below ``folder`` with a readable size; their contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    size = F.when(F.col("length") < 1024 * 1024, F.format_string("%.1f KB", F.col("length") / 1024)).otherwise(F.format_string("%.1f MB", F.col("length") / (1024 * 1024)))
    return df.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length", size.alias("size"))


def load_data(spark: SparkSession, path: str, step: str = "1 hour", start: str = "2024-01-01") -> tuple[DataFrame, DataFrame]:
    """(candles, profile) of a CSV or Parquet path; missing stamps are made at a fixed step, incomplete rows dropped."""
    df = files.canonical_names(spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).csv(path))
    if missing := {"open", "high", "low", "close"} - set(df.columns):
        raise ValueError(f"missing columns {sorted(missing)}")
    if "symbol" not in df.columns:
        df = df.withColumn("symbol", F.lit("series"))
    numbers = [c for c in ("open", "high", "low", "close", "volume", "amount") if c in df.columns]
    df = df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in numbers})
    if "timestamps" in df.columns:
        df = df.withColumn("ts", F.col("timestamps").cast("string").try_cast("timestamp"))
    else:
        place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.monotonically_increasing_id())) - 1
        df = df.withColumn("ts", F.expr(f"timestamp '{start}'") + F.expr(f"interval {step}") * place)
    candles = df.select("symbol", "ts", *numbers).na.drop()
    return candles, features.profile(candles)


def forecast(candles: DataFrame, lookback: int, pred_len: int, predictor: Predictor = last_close_stub, anchor: str = "head", start: str | None = None) -> DataFrame:
    """Forecasts beside the actual closes that follow, per symbol.

    ``anchor="head"``: context is the first ``lookback`` rows (from ``start`` on); ``"tail"``: the last ones. Series that are
    too short are left out.
    """
    if anchor not in ("head", "tail") or lookback < 1 or pred_len < 1:
        raise ValueError("anchor must be head or tail, lookback and pred_len positive")
    df = candles if start is None else candles.filter(F.col("ts") >= start)
    order = Window.partitionBy("symbol").orderBy("ts")
    n = F.count("*").over(Window.partitionBy("symbol"))
    placed = df.withColumns({"i": F.row_number().over(order), "n": n})
    first = F.lit(0) if anchor == "head" else F.col("n") - lookback
    placed = placed.withColumn("k", F.col("i") - first).filter((F.col("n") >= lookback) & (F.col("k") >= 1) & (F.col("k") <= lookback + pred_len))
    ctx = placed.filter(F.col("k") <= lookback).groupBy("symbol").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ts", "close"))), lambda x: x.close).alias("context"), F.to_date(F.max("ts")).alias("forecast_origin"))
    wins = ctx.select("symbol", F.date_format("forecast_origin", "yyyy-MM").alias("candidate_month"), "forecast_origin", "context")
    actual = placed.filter(F.col("k") > lookback).select("symbol", (F.col("k") - lookback).cast("long").alias("horizon_step"), F.col("ts").alias("target_ts"), F.col("open").alias("actual_open"), F.col("close").alias("actual_close"))
    return predict(wins, predictor, pred_len).join(actual, ["symbol", "horizon_step"], "left")


class Predictors:
    """The predictors that a service offers by name, and the one that it uses."""

    def __init__(self, known: dict[str, Predictor] | None = None):
        self.known = {"last_close": last_close_stub} | (known or {})
        self.chosen: str | None = None

    def available(self) -> list[str]:
        return sorted(self.known)

    def load(self, name: str) -> Predictor:
        if name not in self.known:
            raise ValueError(f"unknown predictor {name}; there are {', '.join(self.available())}")
        self.chosen = name
        return self.known[name]

    def status(self) -> dict[str, object]:
        return {"available": bool(self.known), "loaded": self.chosen is not None, "predictor": self.chosen}


def gaps(forecast: Column, actual: Column, name: str) -> list[Column]:
    """The gap between a forecast and an actual price, and its share of the actual price in percent."""
    gap = F.abs(actual - forecast)
    return [gap.alias(f"{name}_gap"), (ratio(gap, F.abs(actual)) * 100).alias(f"{name}_gap_pct")]


def continuity(result: DataFrame, fields: tuple[str, ...] = ("open", "high", "low", "close")) -> DataFrame:
    """Gaps between the first forecast and the first actual bar, for all prices that both have."""
    both = [f for f in fields if f"predicted_{f}" in result.columns and f"actual_{f}" in result.columns]
    return result.filter("horizon_step = 1").select("symbol", *[c for f in both for c in gaps(F.col(f"predicted_{f}"), F.col(f"actual_{f}"), f)])
