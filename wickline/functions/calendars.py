"""Exchange holidays as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Statutory holidays of 2025 (fixed values).
HOLIDAYS_2025 = (
    "2025-01-01",
    "2025-01-27", "2025-01-28", "2025-01-29", "2025-01-30", "2025-01-31", "2025-02-01", "2025-02-02",
    "2025-04-04", "2025-04-05", "2025-04-06",
    "2025-05-01", "2025-05-02", "2025-05-03",
    "2025-06-08", "2025-06-09", "2025-06-10",
    "2025-10-01", "2025-10-02", "2025-10-03", "2025-10-04", "2025-10-05", "2025-10-06", "2025-10-07",
)
#: The national holiday of 2025 alone, with its eighth day (fixed values).
OCTOBER_2025 = ("2025-10-01", "2025-10-02", "2025-10-03", "2025-10-04", "2025-10-05", "2025-10-06", "2025-10-07", "2025-10-08")


def holidays(spark: SparkSession, days: tuple[str, ...] = HOLIDAYS_2025) -> DataFrame:
    """The column ``holiday`` that ``business_days`` takes."""
    return spark.createDataFrame([(d,) for d in days], "holiday string").selectExpr("to_date(holiday) as holiday")
