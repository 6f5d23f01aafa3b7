"""Quality gates on candles: repair with audit, violations, fills, amounts, uniqueness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickline.functions.numeric import clean_number
from wickline.operators.frames import by_time

PRICES = ("open", "high", "low", "close")



def repair_envelope(df: DataFrame) -> DataFrame:
    """High is raised to the body and low; then low is lowered to the body and repaired high. Rows with a
    null price stay. The originals are kept as ``raw_high`` and ``raw_low``."""
    whole = F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull()
    high = F.when(whole, F.greatest("high", "open", "close", "low")).otherwise(F.col("high"))
    out = df.withColumns({"raw_high": F.col("high"), "raw_low": F.col("low")}).withColumn("high", high)
    return out.withColumn("low", F.when(whole, F.least("low", "open", "close", "high")).otherwise(F.col("low")))


def repair_audit(repaired: DataFrame) -> DataFrame:
    """A row per changed cell of ``repair_envelope``."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"raw_{c}").alias("original_value"), F.col(c).alias("repaired_value")) for c in ("high", "low")])
    each = repaired.select("symbol", "ts", F.explode(F.filter(cells, lambda x: x.original_value != x.repaired_value)).alias("x"))
    return each.select("symbol", "ts", "x.*", F.lit("expand_ohlc_envelope").alias("reason"))


def violations(df: DataFrame) -> DataFrame:
    """Rows that break a rule, with the first one broken, in the fixed order of the checks."""
    missing = None
    for c in (*PRICES, "volume"):
        bad = F.col(c).isNull() | F.isnan(c)
        missing = bad if missing is None else missing | bad
    copies = F.count("*").over(Window.partitionBy("symbol", "ts"))
    body = lambda f: f("open", "close")
    reason = (
        F.when(F.col("ts").isNull(), "timestamp").when(F.col("__n") > 1, "duplicate").when(missing, "non_numeric")
        .when(F.least(*PRICES) < 0, "negative_price").when(F.col("volume") < 0, "negative_volume")
        .when(F.col("high") < F.greatest(body(F.greatest), F.col("low")), "high").when(F.col("low") > body(F.least), "low")
    )
    return df.withColumn("__n", copies).withColumn("violation", reason).drop("__n").filter("violation is not null")


def typical_amount(high: Column, low: Column, close: Column, volume: Column) -> Column:
    return (high + low + close) / 3 * volume


def fill_amount(df: DataFrame) -> DataFrame:
    """Amount from close and volume for symbols whose amounts are all missing or 0."""
    seen = F.max(F.coalesce(F.abs("amount"), F.lit(0.0))).over(Window.partitionBy("symbol"))
    return df.withColumn("amount", F.when(seen > 0, F.col("amount")).otherwise(F.col("close") * F.col("volume")))


def mean_amount(df: DataFrame) -> DataFrame:
    """Amount as the mean of open, high, low and close times the volume."""
    return df.withColumn("amount", (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4 * F.col("volume"))


def predictor_defaults(df: DataFrame) -> DataFrame:
    """What a predictor assumes: without a volume column volume and amount are 0, without an amount column it is made of the means."""
    if "volume" not in df.columns:
        return df.withColumns({"volume": F.lit(0.0), "amount": F.lit(0.0)})
    return df if "amount" in df.columns else mean_amount(df)


def between(df: DataFrame, begin: str | None = None, end: str | None = None, column: str = "ts") -> DataFrame:
    """Rows of an inclusive range of dates; an open end is None. The filter reaches the scan."""
    if begin is not None:
        df = df.filter(F.col(column) >= F.lit(begin).cast("date"))
    return df if end is None else df.filter(F.col(column) < F.date_add(F.lit(end).cast("date"), 1))


def last_years(df: DataFrame, years: int, column: str = "ts") -> DataFrame:
    """Rows of each symbol's last ``years`` years."""
    newest = F.max(column).over(Window.partitionBy("symbol"))
    return df.withColumn("__newest", newest).filter(F.col(column) >= F.add_months("__newest", -12 * years)).drop("__newest")


def validate(df: DataFrame) -> DataFrame:
    """Candles that pass every check in order, sorted by symbol and time; ValueError names the first check that fails. Nothing is repaired."""
    if missing := [c for c in ("symbol", "ts", *PRICES, "volume") if c not in df.columns]:
        raise ValueError("missing columns: " + ", ".join(missing))
    if df.isEmpty():
        raise ValueError("no candles")
    found = {r["violation"]: r["count"] for r in violations(df).groupBy("violation").count().collect()}  # a row per check
    for check in ("timestamp", "duplicate", "non_numeric", "negative_price", "negative_volume", "high", "low"):
        if check in found:
            raise ValueError(f"{check}: {found[check]} rows")
    return df.sort("symbol", "ts")


def fix_open(df: DataFrame) -> DataFrame:
    """Open of 0 or null becomes the previous close, else the row's own."""
    bad = F.col("open").isNull() | F.isnan("open") | (F.col("open") == 0)
    return df.withColumn("open", F.when(bad, F.coalesce(F.lag("close").over(by_time()), F.col("close"))).otherwise(F.col("open")))


def forward_fill(df: DataFrame, *columns: str) -> DataFrame:
    """The last value known up to each row."""
    so_far = by_time().rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in columns})


def numbers_from_text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: clean_number(F.col(c)) for c in columns})


def long_enough(df: DataFrame, rows: int) -> DataFrame:
    """Complete rows of symbols that have at least ``rows`` of them."""
    whole = df.na.drop()
    return whole.withColumn("__n", F.count("*").over(Window.partitionBy("symbol"))).filter(F.col("__n") >= rows).drop("__n")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once; must be empty where a contract asks for uniqueness."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def as_of(universe: DataFrame, day: Column) -> DataFrame:
    """Members whose inclusive interval holds ``day``; an open end is null."""
    return universe.filter((F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day)))
