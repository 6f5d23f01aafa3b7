"""Candles from an event stream: tumbling, sliding and session windows with late rows dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickline.session import shared_dir


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream of files; watermarks need an instant, so ``ts`` is read in the session's zone."""
    path = f"{sf_dir}/events.parquet"
    files = f"{sf_dir}/events.parque[t]"  # as a pattern it may be a file or a folder
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(files).withColumn("ts", F.col("ts").cast("timestamp"))


def bars(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """OHLCV per event type and window; state is bounded by the watermark."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    at = F.struct("ts", "event_id")
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("volume"),
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Activity sessions of users."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"), F.sum("value").alias("value"))


def drain(df: DataFrame, name: str) -> DataFrame:
    """Run a streaming frame over what is there into a Parquet table in the shared folder, and return that table.

    Rows are appended once their window is closed by the watermark (windows that it has not passed yet are not written) and late rows are
    dropped; the checkpoint beside the table makes a restart go on where the last run stopped.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/{name}"
    flat = df.select(*[F.col(c) for c in df.columns])
    flat.writeStream.format("parquet").option("path", f"{at}/table").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(flat.schema).parquet(f"{at}/table")
