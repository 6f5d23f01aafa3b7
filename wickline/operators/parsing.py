"""Parsing and lookups: JSONP payloads, codes, reason strings, sectors, composite factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def klines(df: DataFrame, body: str) -> DataFrame:
    """Bars inside ``callback({"data": {"code", "klines": ["date,open,close,high,..."]}})``; missing fields are 0."""
    inner = F.from_json(F.regexp_extract(body, r"(?s)^[^(]*\((.*)\)\s*;?\s*$", 1), "data struct<code:string,klines:array<string>>")
    rows = df.withColumn("__d", inner).select("*", F.col("__d.data.code").alias("code"), F.explode("__d.data.klines").alias("__k")).drop("__d")
    part = F.split("__k", ",")
    number = lambda i: F.coalesce(F.get(part, F.lit(i)).try_cast("double"), F.lit(0.0))
    return rows.withColumns({"day": F.get(part, F.lit(0)), "open": number(1), "close": number(2), "high": number(3), "low": number(4), "volume": number(5)}).drop("__k")


def exchange(code: Column) -> Column:
    return F.when(F.substring(code, 1, 1).isin("0", "2", "3"), "SZ").otherwise("SH")


def with_suffix(symbol: Column, suffix: str) -> Column:
    """Upper-cased and trimmed, with the suffix once."""
    clean = F.upper(F.trim(symbol))
    return F.when(clean.endswith(suffix), clean).otherwise(F.concat(clean, F.lit(suffix)))


def without_suffix(ticker: Column, suffix: str) -> Column:
    return F.when(ticker.endswith(suffix), ticker.substr(F.lit(1), F.length(ticker) - len(suffix))).otherwise(ticker)


def reason_counts(skips: DataFrame, detail: str, code: str, wanted: str) -> DataFrame:
    parts = {k: F.regexp_extract(detail, f"{k}=([^;]+)", 1) for k in ("arm", "method")}
    return skips.filter(F.col(code) == wanted).withColumns(parts).groupBy("arm", "method").agg(F.count("*").alias("n"))


def sectors(df: DataFrame, column: str, names: list[str], members: dict[str, Column]) -> DataFrame:
    """A row per sector whose name occurs in ``column`` or whose list holds the row (no join: the list is fixed)."""
    hits = [F.when(F.contains(F.col(column), F.lit(n)) | members.get(n, F.lit(False)), F.lit(n)) for n in names]
    return df.withColumn("sector", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())))


#: Sectors in the news with their momentum and whether they are active (fixed values).
SECTORS = (("机器人", 0.85, True), ("半导体", 0.8, True), ("人工智能", 0.75, True), ("低空经济", 0.7, True), ("新能源", 0.6, True), ("医药", 0.5, False))
#: Sectors that a code belongs to whatever its industry says (fixed values).
SECTOR_CODES = {"机器人": ("600580",), "低空经济": ("600580",), "新能源": ("300207",)}


def resonance(df: DataFrame, key: str, code: str, industry: str) -> DataFrame:
    """Per row: the number of its sectors, their mean momentum, the strongest one and whether any is active; 0.5 and no sector without a match."""
    hits = [
        F.when(F.contains(F.coalesce(F.col(industry), F.lit("")), F.lit(n)) | F.col(code).isin(*SECTOR_CODES.get(n, ("",))), F.struct(F.lit(m).alias("momentum"), F.lit(n).alias("sector"), F.lit(a).alias("active")))
        for n, m, a in SECTORS
    ]
    rows = df.select(key, F.filter(F.array(*hits), lambda x: x.isNotNull()).alias("s"))
    mean = F.aggregate("s", F.lit(0.0), lambda acc, x: acc + x.momentum) / F.size("s")
    return rows.select(
        key, F.size("s").alias("sector_count"), F.when(F.size("s") > 0, mean).otherwise(0.5).alias("resonance"), F.exists("s", lambda x: x.active).alias("hot"),
        F.when(F.size("s") > 0, F.array_max("s").sector).alias("main_sector"),
    )


def composite(
    uptrend: Column, strength: Column, hot: Column, resonance: Column, count: Column, macro: Column, cuts: Column, fundamentals: Column, low: float = 0.85, high: float = 1.15,
) -> Column:
    """Product of trend, sector, macro, rate and fundamental factors within bounds."""
    trend = F.when(uptrend, 1 + 0.08 * strength).otherwise(1 + 0.04 * (strength - 0.5))
    sector = F.when(hot, 1 + 0.06 * resonance + F.least(0.01 * count, F.lit(0.03))).otherwise(1 + 0.02 * (resonance - 0.5))
    f = trend * sector * (1 + 0.06 * (macro - 0.5)) * (1 + 0.015 * cuts) * (1 + 0.08 * (fundamentals - 0.5))
    return F.least(F.greatest(f, F.lit(low)), F.lit(high))


#: Axis steps by the span that they are used below (fixed values).
AXIS_STEPS = ((1, 0.1), (5, 0.5), (10, 1.0), (20, 2.0), (50, 5.0), (100, 10.0), (200, 20.0), (500, 50.0))


def axis_step(span: Column) -> Column:
    """The step of an axis by its span; 1 for an empty span."""
    step = F.lit(100.0)
    for below, x in reversed(AXIS_STEPS):
        step = F.when(span < below, F.lit(x)).otherwise(step)
    return F.when(span <= 0, F.lit(1.0)).otherwise(step)


def with_defaults(df: DataFrame, lookup: DataFrame, key: str, defaults: dict[str, object], broadcast_rows: int = 100_000) -> DataFrame:
    """Columns of a lookup table by ``key``, with ``defaults`` where it has no row (or a null); the table is broadcast behind a count."""
    small = lookup.select(key, *defaults)
    hint = F.broadcast if small.count() <= broadcast_rows else (lambda x: x)
    return df.drop(*defaults).join(hint(small), key, "left").withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def check_request(code: str, name: str, pred_days: object, history_years: object) -> tuple[str, str, int, int]:
    """A forecast request within its bounds; ValueError names the field that is not."""
    code, name = (code or "").strip(), (name or "").strip()
    if not code or not name:
        raise ValueError(f"{'code' if not code else 'name'} must not be empty")
    numbers = []
    for field, value, most in (("pred_days", pred_days, 365), ("history_years", history_years, 10)):
        try:
            number = int(str(value).strip())
        except ValueError:
            raise ValueError(f"{field} must be a whole number") from None
        if not 1 <= number <= most:
            raise ValueError(f"{field} must be from 1 to {most}")
        numbers.append(number)
    return code, name, *numbers
