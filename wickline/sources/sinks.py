"""Sinks: contract projection, key checks, tables first and the completion marker last; reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKER = "COMPLETED"


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns {missing}")
    return df.select(*columns)


def check_keys(df: DataFrame, keys: list[str]) -> None:
    if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"duplicate keys {keys}")


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_run(spark: SparkSession, tables: dict[str, tuple[DataFrame, list[str]]], manifest: dict, path: str) -> None:
    """Check keys, write every table and the manifest into a folder of this run, then name that folder in the marker.

    The marker is replaced last and by a rename: readers see the whole earlier run or the whole new one, and a run that
    fails leaves the earlier one as it was. Folders that the marker does not name are deleted when a run is completed.
    """
    for df, keys in tables.values():
        check_keys(df, keys)
    run = f"run-{uuid.uuid4().hex}"
    for name, (df, _) in tables.items():
        df.write.parquet(f"{path}/{run}/{name}")
    text = spark.range(1).select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in manifest.items()])).alias("value"))
    text.write.text(f"{path}/{run}/manifest")
    fs, marker = _fs(spark, f"{path}/{MARKER}")
    new = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MARKER}.{run}")
    out = fs.create(new, True)
    out.write(bytearray(run.encode()))
    out.close()
    fs.delete(marker, False)
    if not fs.rename(new, marker):
        raise OSError(f"{path} can not be marked")
    for f in fs.listStatus(marker.getParent()):
        if f.isDirectory() and f.getPath().getName().startswith("run-") and f.getPath().getName() != run:
            fs.delete(f.getPath(), True)


def read_run(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of a finished run; a run without its marker is refused."""
    fs, marker = _fs(spark, f"{path}/{MARKER}")
    if not fs.exists(marker):
        raise FileNotFoundError(f"{path} is not completed")
    run = spark.read.text(f"{path}/{MARKER}").first()[0]
    return spark.read.parquet(f"{path}/{run}/{table}")


def write_symbols(raw: DataFrame, model: DataFrame, failures: DataFrame, request: dict, path: str) -> None:
    """Raw and model-ready candles in a folder per symbol, with an audited manifest: a row per requested symbol.

    ``model`` comes from ``repair_envelope`` (it has ``raw_high`` and ``raw_low``); ``failures``: symbol, error_type, error.
    """
    fixed = [c for c in model.columns if c not in ("raw_high", "raw_low")]
    raw.write.mode("overwrite").partitionBy("symbol").option("header", True).csv(f"{path}/raw")
    model.select(*fixed).write.mode("overwrite").partitionBy("symbol").option("header", True).csv(f"{path}/model")
    manifest(model, failures).write.mode("overwrite").json(f"{path}/manifest")
    said = {k: F.lit(str(v)) for k, v in request.items()}
    totals = manifest_summary(manifest(model, failures))
    totals.select(F.to_json(F.struct(*[v.alias(k) for k, v in said.items()], *totals.columns)).alias("value")).write.mode("overwrite").text(f"{path}/summary")


def write_splits(df: DataFrame, path: str) -> None:
    """Training, validation and test rows in a folder each."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_predictions(candles: DataFrame, result: DataFrame, gaps: DataFrame, path: str) -> None:
    """A JSON row per symbol: its input (bars, range, last values), its forecasts in order, and the gap to the first actual bar."""
    last = F.max_by(F.struct("open", "high", "low", "close", "volume"), "ts")
    given = candles.groupBy("symbol").agg(F.struct(F.count("*").alias("rows"), F.min("ts").alias("first"), F.max("ts").alias("last"), last.alias("last_values"), F.struct(*[F.struct(F.min(c).alias("min"), F.max(c).alias("max")).alias(c) for c in ("open", "high", "low", "close")]).alias("price_range")).alias("input"))
    steps = result.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("horizon_step", "predicted_close"))).alias("predictions"))  # a forecast's length
    found = gaps.select("symbol", F.struct(*[c for c in gaps.columns if c != "symbol"]).alias("continuity"))
    to_json_rows(given.join(steps, "symbol").join(found, "symbol", "left")).write.mode("overwrite").text(path)


def manifest(model: DataFrame, failures: DataFrame) -> DataFrame:
    """A row per symbol: its bars, range and repaired cells, or its error."""
    changed = lambda c: F.count_if(F.col(f"raw_{c}") != F.col(c))
    done = model.groupBy("symbol").agg(F.count("*").alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), (changed("high") + changed("low")).alias("repairs"))
    return done.unionByName(failures.select("symbol", "error_type", "error"), allowMissingColumns=True)


def manifest_summary(rows: DataFrame) -> DataFrame:
    """One row: symbols requested, succeeded and failed, and repaired cells."""
    return rows.agg(F.count("*").alias("requested"), F.count_if(F.col("error_type").isNull()).alias("succeeded"), F.count_if(F.col("error_type").isNotNull()).alias("failed"), F.coalesce(F.sum("repairs"), F.lit(0)).alias("repairs"))


def to_json_rows(df: DataFrame) -> DataFrame:
    """JSON per row, with NaN as null."""
    fixed = [F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*fixed), {"ignoreNullFields": "false"}).alias("value"))


def write_by_symbol_year(df: DataFrame, path: str) -> None:
    df.withColumn("year", F.year("ts")).write.mode("overwrite").partitionBy("symbol", "year").parquet(path)


def markdown(summary: DataFrame, title: str) -> str:
    """A report of all rows of a summary table, read partition by partition; meant for tables that people read."""
    cells = lambda r: "| " + " | ".join("" if v is None else str(v) for v in r) + " |"
    return "\n".join([f"# {title}", "", cells(summary.columns), "|" + "---|" * len(summary.columns), *map(cells, summary.toLocalIterator()), ""])
