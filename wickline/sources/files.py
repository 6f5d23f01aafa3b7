"""File sources: universes, raw candle folders, generic tables, fallback chains."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from wickline.functions.numeric import clean_number, ratio
from wickline.operators.adjust import total_fingerprint
from wickline.operators.features import contiguous_shards
from wickline.operators.frames import by_time
from wickline.operators.quality import violations

UNIVERSE = ("symbol", "name", "valid_from", "valid_to")
#: Column synonyms of providers (fixed values).
SYNONYMS = {
    "date": "timestamps", "datetime": "timestamps", "timestamp": "timestamps", "timestamps": "timestamps", "open": "open", "high": "high", "low": "low", "close": "close",
    "adj close": "adj_close", "adjclose": "adj_close", "volume": "volume", "vol": "volume", "amount": "amount", "amt": "amount",
    "日期": "timestamps", "开盘": "open", "开盘价": "open", "最高": "high", "最高价": "high", "最低": "low", "最低价": "low", "收盘": "close", "收盘价": "close", "成交量": "volume", "成交额": "amount",
}


def canonical_names(df: DataFrame) -> DataFrame:
    """Provider headers (any case, underscores, byte-order mark, localised) as canonical names."""
    found = {c: SYNONYMS.get(c.lstrip("﻿").strip().lower().replace("_", " ")) for c in df.columns}
    return df.withColumnsRenamed({c: n for c, n in found.items() if n})


def universe(spark: SparkSession, path: str) -> DataFrame:
    """Members with their order in the file (read in one piece: a list of names); ValueError names a bad header, row or repeated symbol."""
    raw = spark.read.option("header", True).option("multiLine", True).csv(path)
    names = [c.lstrip("﻿").strip() for c in raw.columns]
    if set(names) != set(UNIVERSE):
        raise ValueError(f"universe columns must be {UNIVERSE}")
    rows = raw.toDF(*names).select(
        (F.monotonically_increasing_id() + 1).alias("ord"), F.upper(F.trim("symbol")).alias("symbol"), F.trim("name").alias("name"),
        F.trim("valid_from").try_cast("date").alias("valid_from"), F.nullif(F.trim(F.coalesce("valid_to", F.lit(""))), F.lit("")).alias("end"),
    )
    rows = rows.withColumn("valid_to", F.col("end").try_cast("date"))
    bad = ~F.coalesce(F.col("symbol").rlike("^[A-Z0-9]+$"), F.lit(False)) | (F.coalesce("name", F.lit("")) == "") | F.col("valid_from").isNull() | (F.col("end").isNotNull() & F.col("valid_to").isNull()) | (F.col("valid_to") < F.col("valid_from"))
    rows = rows.withColumn("ord", F.row_number().over(Window.orderBy("ord")))  # a list of names
    counts = rows.agg(F.min(F.when(bad, F.col("ord"))).alias("bad"), (F.count("*") - F.countDistinct("symbol")).alias("again")).first()
    if counts["bad"]:
        raise ValueError(f"universe row {counts['bad'] + 1} is invalid")  # the header is row 1
    if counts["again"]:
        raise ValueError(f"{counts['again']} repeated universe symbols")
    return rows.drop("end")


def select_symbols(members: DataFrame, text: str | None = None, shard: tuple[int, int] | None = None) -> DataFrame:
    """Members by a list of symbols (commas or spaces, any case, repeats ignored, in the given order) or by one of n contiguous
    shards ``(index, n)`` of the file's order, not both; an unknown symbol is an error."""
    if text is not None and shard is not None:
        raise ValueError("symbols and a shard exclude each other")
    if shard is not None:
        index, n = shard
        if not 0 <= index < n:
            raise ValueError("shard_index out of range")
        return contiguous_shards(members, "ord", n).filter(F.col("shard_index") == index).drop("shard_index")
    if text is None:
        return members
    names = list(dict.fromkeys(s.upper() for s in text.replace(",", " ").split()))
    if not names:
        raise ValueError("no symbols are given")
    wanted = members.sparkSession.createDataFrame(list(enumerate(names, 1)), "ord int, symbol string")
    unknown = [r.symbol for r in wanted.join(members, "symbol", "left_anti").orderBy("ord").collect()]  # at most the given names
    if unknown:
        raise ValueError("unknown symbols: " + ", ".join(unknown))
    return members.drop("ord").join(F.broadcast(wanted), "symbol")


def data_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """One digest over the digests of a folder's files, in the order of their names, and their number."""
    found = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("symbol"), F.sha2("content", 256).alias("fingerprint"))
    return total_fingerprint(found)


def feather(spark: SparkSession, path: str) -> DataFrame:
    """Feather (Arrow IPC) files as one table; the columns are those of the first file by name."""
    found = spark.read.format("binaryFile").load(path).select("path", "content")
    first = found.orderBy("path").select("content").first()
    if first is None:
        raise FileNotFoundError(path)
    schema = from_arrow_schema(pa.ipc.open_file(first[0]).schema)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                table = pa.ipc.open_file(content.as_py())
                for i in range(table.num_record_batches):
                    yield table.get_batch(i).select(names)

    return found.select("content").mapInArrow(run, schema)


def raw_candles(spark: SparkSession, path: str) -> DataFrame:
    """A folder of candle files as one long frame; numbers that do not parse are null."""
    df = canonical_names(spark.read.option("header", True).csv(path))
    numbers = [c for c in ("open", "high", "low", "close", "adj_close", "volume", "amount") if c in df.columns]
    out = df.withColumns({c: F.col(c).try_cast("double") for c in numbers}).withColumn("timestamps", F.col("timestamps").try_cast("timestamp_ntz"))
    if "symbol" not in out.columns:
        out = out.withColumn("symbol", F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1))
    return out.withColumn("adj_close", F.coalesce("adj_close", "close")) if "adj_close" in out.columns else out.withColumn("adj_close", F.col("close"))


RAW = ("ts", "open", "high", "low", "close", "adj_close", "volume", "symbol")


def discover(spark: SparkSession, folder: str, symbols: DataFrame, suffix: str = ".csv") -> DataFrame:
    """``symbol`` and ``path`` of the files of a folder that are named after a symbol of ``symbols``; contents are not read."""
    found = spark.read.format("binaryFile").load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("file"))
    named = found.filter(F.col("file").endswith(suffix)).select(F.expr(f"substring(file, 1, length(file) - {len(suffix)})").alias("symbol"), "path")
    return named.join(symbols.select("symbol").distinct(), "symbol", "left_semi")


def restricted(candles: DataFrame, symbols: DataFrame) -> DataFrame:
    """Candles of the universe's symbols only."""
    return candles.join(symbols.select("symbol").distinct(), "symbol", "left_semi")


def finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def require(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``df`` if no row fails; else ValueError with the first failing check, in the given order, and its number of rows."""
    counts = df.agg(*[F.count_if(bad).alias(f"c{i}") for i, bad in enumerate(checks.values())]).first()
    for i, name in enumerate(checks):
        if counts[i]:
            raise ValueError(f"{name}: {counts[i]} rows")
    return df


def strict_raw(df: DataFrame) -> DataFrame:
    """Raw candles that pass every gate: all columns, one row per symbol and stamp, finite numbers, positive prices, no negative volume."""
    if missing := [c for c in RAW if c not in df.columns]:
        raise ValueError("missing raw columns: " + ", ".join(missing))
    prices = ("open", "high", "low", "close", "adj_close")
    odd = F.lit(False)
    for c in (*prices, "volume"):
        odd = odd | ~finite(F.col(c))
    low = F.least(*prices) <= 0
    repeated = df.groupBy("symbol", "ts").agg(F.count("*").alias("n"), F.count_if(F.col("ts").isNull()).alias("none"), F.count_if(odd).alias("odd"), F.count_if(low).alias("low"), F.count_if(F.col("volume") < 0).alias("sold"))
    require(repeated, {
        "timestamps are missing": F.col("none") > 0, "duplicate timestamps are not allowed": F.col("n") > 1, "numeric columns contain non-finite values": F.col("odd") > 0,
        "prices must be strictly positive": F.col("low") > 0, "volume must not be negative": F.col("sold") > 0,
    })
    return df.select(*RAW)


def strict_model(df: DataFrame) -> DataFrame:
    """Model-ready candles that pass every gate: a finite amount and no violation of the candle rules."""
    if "amount" not in df.columns:
        raise ValueError("amount column is required")
    require(df, {"amount contains non-finite values": ~finite(F.col("amount"))})
    bad = violations(df).groupBy("violation").count().orderBy("violation").collect()  # a row per rule
    if bad:
        raise ValueError("candles are invalid: " + ", ".join(f"{r['violation']} ({r['count']} rows)" for r in bad))
    return df


def coverage(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Symbols and stamps only: the other columns are never read. ``strict`` refuses a stamp that a symbol has twice."""
    df = raw_candles(spark, path).select("symbol", F.col("timestamps").alias("ts"))
    if strict:
        require(df.groupBy("symbol", "ts").agg(F.count("*").alias("n")), {"duplicate timestamps": F.col("n") > 1})
    return df


def normalised(df: DataFrame) -> DataFrame:
    """A provider's frame as candles: canonical names (of two-level headers such as ``Open|X`` the first level), numbers, stamps without
    a zone, rows in which a price or the volume is missing rejected."""
    df = canonical_names(df.withColumnsRenamed({c: c.split("|")[0] for c in df.columns if "|" in c}))
    numbers = [c for c in ("open", "high", "low", "close", "adj_close", "volume") if c in df.columns]
    if missing := {"timestamps", "open", "high", "low", "close", "volume"} - set(df.columns):
        raise ValueError(f"missing columns {sorted(missing)}")
    bare = F.regexp_replace(F.col("timestamps").cast("string"), r"(Z|[+-][0-9]{2}:?[0-9]{2})$", "")
    out = df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in numbers}).withColumn("timestamps", bare.try_cast("timestamp_ntz"))
    out = out.withColumn("adj_close", F.coalesce("adj_close", "close") if "adj_close" in df.columns else F.col("close"))
    return out.na.drop(subset=["timestamps", "open", "high", "low", "close", "volume"])


def provider_daily(df: DataFrame) -> DataFrame:
    """Daily bars of a provider that reports localised headers and text numbers: canonical names, coerced numbers, the change to the
    bar before (``change``), its share (``change_pct``) and the amplitude, incomplete rows dropped."""
    named = canonical_names(df)
    numbers = [c for c in ("open", "high", "low", "close", "volume", "amount") if c in named.columns]
    rows = named.withColumns({c: clean_number(F.col(c)) for c in numbers}).withColumn("ts", F.to_date("timestamps")).na.drop(subset=["ts", *numbers])
    if "symbol" not in rows.columns:
        rows = rows.withColumn("symbol", F.lit("series"))
    before = F.lag("close").over(by_time())
    return rows.drop("timestamps").withColumns({"change": F.col("close") - before, "change_pct": ratio(F.col("close") - before, before) * 100, "amplitude": ratio(F.col("high") - F.col("low"), before) * 100})


def first_available(readers: list[Callable[[], DataFrame]]) -> DataFrame:
    """The first source that can be read and has a row."""
    failures = []
    for read in readers:
        try:
            df = read()
            if not df.isEmpty():
                return df
            failures.append("empty")
        except Exception as e:  # noqa: BLE001  any failing source hands over to the next
            failures.append(f"{type(e).__name__}: {e}"[:200])
    raise RuntimeError(f"no source has rows: {failures}")


def synthetic(spark: SparkSession, symbols: int, days: int, seed: int = 7, step: float = 0.1, low: float = 1.0) -> DataFrame:
    """Seeded random-walk candles within an envelope; a day's move is clamped to ``step`` and prices to ``low`` at least.

    ``change_pct`` is the move against the close before, ``amplitude`` the day's range against it, in percent.
    """
    base = spark.range(symbols * days).select((F.col("id") % symbols).cast("int").alias("s"), F.floor(F.col("id") / symbols).cast("int").alias("i"))
    noise = F.pmod(F.xxhash64(F.lit(seed), "s", "i"), F.lit(2001)) / 1000.0 - 1
    steps = base.select(F.format_string("SYN%04d", "s").alias("symbol"), F.expr("date_add(date '2020-01-01', i)").alias("ts"), noise.alias("z"))
    move = F.greatest(F.least(F.lit(0.01) * F.col("z"), F.lit(step)), F.lit(-step))
    walk = F.sum(move).over(by_time())
    out = steps.withColumn("close", F.greatest(100 * F.exp(walk), F.lit(low)))
    before = F.coalesce(F.lag("close").over(by_time()), F.lit(100.0))
    out = out.withColumn("open", before)
    out = out.withColumns({"high": F.greatest("open", "close") * 1.005, "low": F.least("open", "close") * 0.995, "volume": 1e4 * (1 + F.abs("z"))})
    return out.select("symbol", "ts", "open", "high", "low", "close", "volume", ((F.col("close") / F.col("open") - 1) * 100).alias("change_pct"), ((F.col("high") - F.col("low")) / F.col("open") * 100).alias("amplitude"))
