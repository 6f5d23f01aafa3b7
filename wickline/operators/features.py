"""Training features: windows, splits, normalisation, time features, dates, sampling, reshaping, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickline.functions.numeric import clip
from wickline.operators.frames import by_time
from wickline.session import cut


EPS = 1e-5


def sliding_windows(df: DataFrame, width: int) -> DataFrame:
    """Start and end of every complete window; its values stay where they are, as one frame."""
    ahead = by_time().rowsBetween(0, width - 1)
    out = df.withColumns({"n": F.count("*").over(ahead), "end_ts": F.max("ts").over(ahead), "mean_close": F.avg("close").over(ahead), "start_index": F.row_number().over(by_time()) - 1})
    return out.filter(F.col("n") == width).select("symbol", F.col("ts").alias("start_ts"), "end_ts", "start_index", "mean_close")


def zscore(df: DataFrame, lookback: int, bound: float = 5.0) -> DataFrame:
    """Close against mean and population deviation of the last ``lookback`` rows (the past only), clipped."""
    w = by_time().rowsBetween(-(lookback - 1), 0)
    full = F.count("*").over(w) == lookback
    z = df.withColumns({"mean": F.avg("close").over(w), "std": F.stddev_pop("close").over(w), "__full": full}).filter("__full").drop("__full")
    return z.withColumn("z", clip((F.col("close") - F.col("mean")) / (F.col("std") + EPS), -bound, bound)).withColumn("back", F.col("z") * (F.col("std") + EPS) + F.col("mean"))


def window_zscores(df: DataFrame, lookback: int, horizon: int, columns: tuple[str, ...] = ("open", "high", "low", "close", "volume"), past_only: bool = True, bound: float = 5.0) -> DataFrame:
    """Rows of every complete training window of ``lookback + horizon`` bars, normalised by the window's own mean and population
    deviation: of its past rows alone, or (``past_only=False``) of the whole window with its future."""
    width = lookback + horizon
    seen = by_time().rowsBetween(0, (lookback if past_only else width) - 1)
    full = by_time().rowsBetween(0, width - 1)
    stats = {f"__{f}_{c}": fn(c).over(seen) for c in columns for f, fn in (("m", F.avg), ("s", F.stddev_pop))}
    starts = df.withColumns(stats | {"__n": F.count("*").over(full), "__rn": F.row_number().over(by_time())}).filter(F.col("__n") == width)
    starts = starts.select("symbol", F.col("ts").alias("start_ts"), "__rn", *stats).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    rows = df.select("symbol", "ts", *columns, F.row_number().over(by_time()).alias("__at"))
    both = starts.withColumn("__at", F.col("__rn") + F.col("step")).join(rows, ["symbol", "__at"])
    z = [clip((F.col(c) - F.col(f"__m_{c}")) / (F.col(f"__s_{c}") + EPS), -bound, bound).alias(c) for c in columns]
    return both.select("symbol", "start_ts", "step", "ts", *z)


def time_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Minute, hour, weekday (Monday 0), day and month."""
    c = F.col(ts)
    return df.withColumns({"minute": F.minute(c), "hour": F.hour(c), "weekday": F.weekday(c), "day": F.dayofmonth(c), "month": F.month(c)})


def split_by_ratio(df: DataFrame, train: float, validation: float) -> DataFrame:
    """Leading, middle and closing rows of each symbol; cut points are truncated."""
    n = F.count("*").over(Window.partitionBy("symbol"))
    i = F.row_number().over(by_time()) - 1
    a, b = F.floor(n * F.lit(train) + 1e-9), F.floor(n * F.lit(train + validation) + 1e-9)
    return df.withColumn("split", F.when(i < a, "train").when(i < b, "validation").otherwise("test"))


def split_by_time(df: DataFrame, ranges: dict[str, tuple[str, str]]) -> DataFrame:
    """Inclusive date ranges, which may overlap: a row appears once for each range that holds it."""
    each = F.array(*[F.when(F.col("ts").between(a, b), F.lit(name)) for name, (a, b) in ranges.items()])
    return df.withColumn("split", F.explode(F.filter(each, lambda x: x.isNotNull())))


def index_hash(idx: Column, epoch: Column, n: Column) -> Column:
    """Deterministic start index of a training sample."""
    return F.pmod(idx.cast("long") * 9973 + (epoch.cast("long") + 1) * 104729, n.cast("long"))


def validation_index(idx: Column, n: Column) -> Column:
    """Start index of a validation sample: in order, over and over."""
    return F.pmod(idx.cast("long"), n.cast("long"))


def business_days(df: DataFrame, start: str, count: int, holidays: DataFrame | None = None, broadcast_rows: int = 100_000) -> DataFrame:
    """The next ``count`` weekdays after ``start`` that are no holidays.

    Weekdays alone always suffice within ``count`` weeks' worth of days; every holiday behind a start may push the end by one
    more day, so that the days looked at grow with the holidays: no number of them makes the result short.
    """
    keys = list(df.columns)
    more, few = F.lit(0), None
    if holidays is not None:
        holidays = holidays.select("holiday").filter("holiday is not null").distinct()
        n = holidays.count()
        few = F.broadcast(holidays) if n <= broadcast_rows else holidays
        more = F.lit(n)
    ahead = (F.lit(count) + more) * 7 / 5 + 7
    days = df.withColumn("day", F.explode(F.sequence(F.date_add(start, 1), F.date_add(F.col(start), ahead.cast("int"))))).filter(F.weekday("day") < 5)
    if few is not None:
        days = days.join(few, F.col("day") == F.col("holiday"), "left_anti")
    return days.withColumn("step", F.row_number().over(Window.partitionBy(*keys).orderBy("day"))).filter(F.col("step") <= count)


def fixed_steps(df: DataFrame, count: int) -> DataFrame:
    """Stamps that follow the last bar at the spacing of the first two."""
    seen = df.select("symbol", "ts", F.min("ts").over(Window.partitionBy("symbol")).alias("first"))
    g = seen.groupBy("symbol").agg(F.max("ts").alias("last"), F.min("first").alias("first"), F.min(F.when(F.col("ts") > F.col("first"), F.col("ts"))).alias("second"))
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    base = g.filter("second is not null").select("symbol", seconds("last").alias("last"), (seconds("second") - seconds("first")).alias("gap"), F.explode(F.sequence(F.lit(1), F.lit(count))).alias("step"))
    return base.select("symbol", "step", F.timestamp_seconds(F.col("last") + F.col("gap") * F.col("step")).alias("ts"))


def profile(df: DataFrame) -> DataFrame:
    """Rows, range, prices and the label of the mean of the first nine spacings."""
    d = df.withColumns({"rn": F.row_number().over(by_time()), "gap": F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lag("ts").over(by_time()).cast("timestamp"))})
    g = d.groupBy("symbol").agg(
        F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min("low").alias("min_price"), F.max("high").alias("max_price"),
        F.avg(F.when(F.col("rn") <= 10, F.col("gap"))).alias("spacing"),
    )
    return g.withColumn("label", F.when(F.col("spacing") < 60, "seconds").when(F.col("spacing") < 3600, "minutes").when(F.col("spacing") < 86400, "hours").otherwise("days"))


def contiguous_shards(df: DataFrame, order: str, k: int) -> DataFrame:
    """Balanced contiguous shards by ``order``; the first n mod k are one larger.

    Rows are numbered within range partitions, whose counts give the offsets: no task sees the whole series.
    """
    ranged = cut(df.repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    counts = sorted((r["__part"], r["n"]) for r in ranged.groupBy("__part").agg(F.count("*").alias("n")).collect())  # a number per partition
    total, rows = sum(n for _, n in counts), []
    for part, n in counts:
        rows.append((part, rows[-1][1] + before if rows else 0))
        before = n
    sums = df.sparkSession.createDataFrame(rows, "__part int, __before long").withColumn("__total", F.lit(total).cast("long"))
    at = F.col("__before") + F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    size, larger = F.floor(F.col("__total") / k), F.col("__total") % k
    split = larger * (size + 1)
    index = F.when(F.col("__at") < split, F.floor(F.col("__at") / (size + 1))).otherwise(larger + F.floor((F.col("__at") - split) / F.greatest(size, F.lit(1))))
    return ranged.join(F.broadcast(sums), "__part").withColumn("__at", at).withColumn("shard_index", index.cast("int")).drop("__part", "__before", "__total", "__at")


#: What all manifests of a run have in common.
SAME = ("config_fingerprint", "source_data_fingerprint", "model_revision", "tokenizer_revision", "shard_count")


def shard_check(manifests: DataFrame, shard_count: int, same: tuple[str, ...] = SAME) -> DataFrame:
    """One row: whether manifests have all indexes once, one value of each field in ``same``, and no name twice."""
    names = manifests.select(F.explode("symbols").alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    overlap = names.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("overlap"))
    g = manifests.agg(
        F.count("*").alias("shards"), F.countDistinct("shard_index").alias("indexes"), F.min("shard_index").alias("lo"), F.max("shard_index").alias("hi"),
        *[F.countDistinct(F.coalesce(F.col(c).cast("string"), F.lit("null"))).alias(f"__{c}") for c in same],
    )
    differ = F.array_join(F.filter(F.array(*[F.when(F.col(f"__{c}") > 1, F.lit(c)) for c in same]), lambda x: x.isNotNull()), ",")
    g = g.withColumn("differing", differ).drop(*[f"__{c}" for c in same])
    ok = (F.col("shards") == shard_count) & (F.col("indexes") == shard_count) & (F.col("lo") == 0) & (F.col("hi") == shard_count - 1) & (F.col("differing") == "") & (F.col("overlap") == 0)
    return g.crossJoin(overlap).withColumn("compatible", F.coalesce(ok, F.lit(False)))  # two single rows


def sample_pairs(lengths: DataFrame, epoch: int, seed: int, n: int, width: int) -> DataFrame:
    """``n`` starts of training windows of an epoch, uniform over all (symbol, start) pairs by a seeded hash; equal on every run.

    ``lengths``: a row per symbol with its number of bars ``n_rows``. Pairs are numbered by cumulated counts and drawn by number.
    """
    starts = lengths.select("symbol", F.greatest(F.col("n_rows") - width + 1, F.lit(0)).alias("starts")).filter("starts > 0")
    line = Window.orderBy("symbol")  # a row per symbol
    numbered = starts.withColumn("hi", F.sum("starts").over(line)).withColumn("lo", F.col("hi") - F.col("starts"))
    total = starts.agg(F.sum("starts").alias("total"))
    drawn = lengths.sparkSession.range(n).select(F.col("id").alias("sample"), F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:{epoch}:"), F.col("id").cast("string")), 256), 1, 12), 16, 10).cast("long").alias("u"))
    at = drawn.crossJoin(F.broadcast(total)).select("sample", (F.col("u") % F.col("total")).alias("at"))  # one row
    return at.join(F.broadcast(numbered), (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))).select("sample", "symbol", (F.col("at") - F.col("lo")).alias("start_index"))
