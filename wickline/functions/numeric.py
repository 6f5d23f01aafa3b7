"""Scalar expressions with explicit null, zero and NaN behaviour (no Python in the plan)."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def clean_number(c: Column) -> Column:
    """Text to double: thousands commas dropped, ``--`` and blanks null, anything else unparsable null."""
    bare = F.trim(F.regexp_replace(c.cast("string"), ",", ""))
    return nan_to_null(bare.try_cast("double"))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return a / F.when(b != 0, b)


def clip(c: Column, low: float, high: float) -> Column:
    """Within bounds; null stays null (``greatest`` alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def same_sign(a: Column, b: Column) -> Column:
    """Whether two numbers point the same way; zero agrees with zero only; null with a null."""
    return F.when(a.isNotNull() & b.isNotNull(), F.signum(a) == F.signum(b))


def close_to(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Equality within a tolerance relative to ``b``; two nulls are equal."""
    return F.coalesce(F.abs(a - b) <= atol + rtol * F.abs(b), a.isNull() & b.isNull())


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation as an aggregate; null for constants and fewer than two pairs."""
    pair = a.isNotNull() & b.isNotNull()
    x, y = F.when(pair, a), F.when(pair, b)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.covar_pop(x, y) / F.when(spread != 0, spread))


def average_rank(value: Column, *by: str) -> Column:
    """Rank from 1 ascending with ties averaged, within ``by``."""
    ordered = Window.partitionBy(*by).orderBy(value)
    ties = Window.partitionBy(*by, value)
    return F.rank().over(ordered) + (F.count("*").over(ties) - 1) / 2.0
