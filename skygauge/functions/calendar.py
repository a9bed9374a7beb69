"""Calendar columns; all JVM-side expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PEAK_RAIN_MONTHS = (10, 11, 12, 1)


def calendar_fields(date: str = "date") -> dict[str, Column]:
    """year, month, weekday (Monday = 0), day of year, ISO week."""
    return {
        "year": F.year(date), "month": F.month(date), "day_of_week": F.weekday(date),
        "day_of_year": F.dayofyear(date), "week_of_year": F.weekofyear(date),
    }


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = 2 * math.pi * value / period
    return F.sin(angle), F.cos(angle)


def season_fields(month: Column, doy_sin: Column, doy_cos: Column) -> dict[str, Column]:
    return {
        "season": F.floor((month % 12) / 3).cast("int"),
        "season_intensity": 0.5 * doy_sin + 0.5 * doy_cos,
        "is_peak_rain_season": month.isin(*PEAK_RAIN_MONTHS).cast("int"),
    }


def time_features(df: DataFrame, date: str = "date", year_days: float = 365.0) -> DataFrame:
    """Calendar fields, their cyclic forms and the season columns."""
    df = df.withColumns(calendar_fields(date))
    cyc = {}
    for name, col, period in (("month", "month", 12), ("dow", "day_of_week", 7),
                              ("doy", "day_of_year", year_days), ("woy", "week_of_year", 52)):
        cyc[f"{name}_sin"], cyc[f"{name}_cos"] = cyclic(F.col(col), period)
    df = df.withColumns(cyc)
    return df.withColumns(season_fields(F.col("month"), F.col("doy_sin"), F.col("doy_cos")))


def time_sigmoid(date: Column, first: Column, last: Column) -> Column:
    """Logistic ramp over first..last; null for a one-day range."""
    t = F.try_divide(F.datediff(date, first), F.datediff(last, first))
    return 1 / (1 + F.exp(-10 * (t - 0.5)))


def add_time_sigmoid(df: DataFrame, bounds: DataFrame | None = None, date: str = "date") -> DataFrame:
    """``bounds`` holds the fitted first and last date (one row); default is the frame's own."""
    bounds = bounds if bounds is not None else date_bounds(df, date)
    lim = bounds.select(F.struct("first_date", "last_date").alias("b")).scalar()
    return df.withColumn("_b", lim).withColumn(
        "time_sigmoid", time_sigmoid(F.col(date), F.col("_b.first_date"), F.col("_b.last_date"))).drop("_b")


def date_bounds(df: DataFrame, date: str = "date") -> DataFrame:
    return df.agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def floor_day(ts: Column, cutoff_hour: int = 23, cutoff_minute: int = 15) -> Column:
    """Day of a timestamp whose day turns at the cut-off hour instead of midnight."""
    minutes = (24 - cutoff_hour) * 60 - cutoff_minute
    return F.to_date(F.date_trunc("day", ts + F.expr(f"interval {minutes} minutes")))


def window_days(t0: Column, t1: Column) -> Column:
    return F.datediff(t1, t0) + 1


def is_year_start(d: Column) -> Column:
    return (F.month(d) == 1) & (F.dayofmonth(d) == 1)


def is_year_end(d: Column) -> Column:
    return (F.month(d) == 12) & (F.dayofmonth(d) == 31)


def local_today(now_utc: Column, zone: str = "Asia/Singapore") -> Column:
    return F.to_date(F.from_utc_timestamp(now_utc, zone))


def in_forecast_window(date: Column, today: Column, days: int = 14) -> Column:
    return date.between(today, F.date_add(today, days))


def last_observed_date(today: Column) -> Column:
    return F.date_sub(today, 1)


def time_key(col: Column, out_format: str, formats: tuple[str, ...] = ("yyyy-MM-dd", "dd/MM/yyyy", "yyyy/MM/dd", "yyyy-MM")) -> Column:
    """Text date in any of the given formats, rendered in ``out_format``; null if none fits."""
    parsed = F.coalesce(*[F.try_to_timestamp(col, F.lit(f)) for f in formats])
    return F.date_format(parsed, out_format)
