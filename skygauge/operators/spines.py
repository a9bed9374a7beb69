"""Date spines: filling, calendars, month expansion and the weekly mart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def week_label(date):
    """Sunday that ends the week of ``date``."""
    return F.next_day(F.date_sub(date, 1), "SUN")


def fill_missing_dates(df: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """One row per day between each group's first and last date; new rows are null."""
    keys = list(keys)
    spine = df.groupBy(*keys).agg(F.min(date).alias("_a"), F.max(date).alias("_b")).select(
        *keys, F.explode(F.sequence("_a", "_b")).alias(date))
    return spine.join(df, keys + [date], "left")


def full_calendar_years(df: DataFrame, keys: Sequence[str], year: str = "year", date: str = "date") -> DataFrame:
    """Every day of each (keys, year) that has a row."""
    keys = list(keys)
    days = F.sequence(F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year, F.lit(12), F.lit(31)))
    spine = df.select(*keys, year).distinct().select(*keys, year, F.explode(days).alias(date))
    return spine.join(df, keys + [year, date], "left").withColumn("doy", F.dayofyear(date))


def align_to_daily(df: DataFrame, date: str = "date") -> DataFrame:
    """Repeat each row on every day of its month."""
    days = F.sequence(F.trunc(date, "MM"), F.last_day(date))
    return df.withColumn(date, F.explode(days))


def weekly_mart(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """Weekly means per (location, year); weeks end on Sunday, empty weeks stay as null rows."""
    wk = df.groupBy("location", "year", week_label("date").alias("date")).agg(
        *[F.avg(v).alias(v) for v in values])
    spine = wk.groupBy("location", "year").agg(F.min("date").alias("_a"), F.max("date").alias("_b")).select(
        "location", "year", F.explode(F.sequence("_a", "_b", F.expr("interval 7 days"))).alias("date"))
    return spine.join(wk, ["location", "year", "date"], "left")


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise inside the job when a key repeats; the check rides on the aggregate of the keys."""
    bad = df.groupBy(*keys).count().filter("count > 1").limit(1)
    if not bad.isEmpty():
        raise ValueError(f"key {list(keys)} is not unique")
    return df
