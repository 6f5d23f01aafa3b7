"""Candle views over the order tables: one long frame (symbol, ts, open, high, low, close, volume)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def resample(trades: DataFrame, price: Column, volume: Column, order: list[str]) -> DataFrame:
    """Bars per (symbol, ts): open and close by the given unique order, one pre-aggregated shuffle."""
    at = F.struct(*order)
    return trades.groupBy("symbol", "ts").agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, at).alias("close"), F.sum(volume).alias("volume"),
    )


_TRADE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _line_items(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").filter("l_quantity > 0")
    return items.withColumns({"ts": F.date_trunc(unit, "l_shipdate").cast("date"), "px": F.col("l_extendedprice") / F.col("l_quantity")})


def week6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of six symbols (return flag and line status)."""
    t = _line_items(spark, sf_dir, "WEEK").withColumn("symbol", F.concat("l_returnflag", "l_linestatus"))
    return resample(t, F.col("px"), F.col("l_quantity"), _TRADE_ORDER)


def day6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the same symbols."""
    t = _line_items(spark, sf_dir, "DAY").withColumn("symbol", F.concat("l_returnflag", "l_linestatus"))
    return resample(t, F.col("px"), F.col("l_quantity"), _TRADE_ORDER)


def week25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars per brand (25 symbols); the planner chooses how to join the parts."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    t = _line_items(spark, sf_dir, "WEEK").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return resample(t, F.col("px"), F.col("l_quantity"), _TRADE_ORDER)


def hour5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars per event type."""
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.date_trunc("HOUR", "ts").alias("bar"), "ts", "event_id", "value")
    e = e.select("symbol", F.col("bar").alias("hour"), F.col("ts").alias("at"), "event_id", "value")
    return resample(e.withColumnRenamed("hour", "ts"), F.col("value"), F.lit(1.0), ["at", "event_id"])
