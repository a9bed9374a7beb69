"""Landed JSON of the live feeds, flattened to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

READINGS_SCHEMA = "items array<struct<timestamp:string, readings:array<struct<station_id:string, value:double>>>>"
STATIONS_SCHEMA = "metadata struct<stations:array<struct<id:string, location:struct<latitude:double, longitude:double>>>>"
RAIN_SCHEMA = "minutely_15 struct<time:array<string>, precipitation:array<double>>"
WEATHER_SCHEMA = (
    "daily struct<time:array<string>, temperature_2m_mean:array<double>, temperature_2m_max:array<double>, "
    "temperature_2m_min:array<double>, windspeed_10m_mean:array<double>, windspeed_10m_max:array<double>>")
# Column of each feed array.
WEATHER_COLUMNS = {
    "temperature_2m_mean": "mean_temperature_c", "temperature_2m_max": "maximum_temperature_c",
    "temperature_2m_min": "minimum_temperature_c", "windspeed_10m_mean": "mean_wind_speed_kmh",
    "windspeed_10m_max": "max_wind_speed_kmh"}


def parse(df: DataFrame, schema: str, text: str = "value") -> DataFrame:
    """Typed columns of a JSON text column; the other columns stay."""
    return df.withColumn("_j", F.from_json(text, schema)).select("*", "_j.*").drop("_j", text)


def flatten_readings(df: DataFrame) -> DataFrame:
    item = df.select(F.explode("items").alias("i"))
    row = item.select(F.try_to_timestamp("i.timestamp").alias("timestamp"), F.explode("i.readings").alias("r"))
    return row.select("timestamp", "r.station_id", F.col("r.value").alias("rainfall_mm"))


def flatten_gauges(df: DataFrame) -> DataFrame:
    s = df.select(F.explode("metadata.stations").alias("s"))
    return s.select(F.col("s.id").alias("station_id"), "s.location.latitude", "s.location.longitude")


def flatten_rain(df: DataFrame) -> DataFrame:
    """One row per 15-minute step of parallel arrays; columns beside ``minutely_15`` are kept."""
    keep = [c for c in df.columns if c != "minutely_15"]
    z = df.select(*keep, F.explode(F.arrays_zip("minutely_15.time", "minutely_15.precipitation")).alias("z"))
    return z.select(*keep, F.try_to_timestamp("z.time").alias("time"), F.col("z.precipitation").alias("rain_15min_mm"))


def flatten_weather(df: DataFrame) -> DataFrame:
    keep = [c for c in df.columns if c != "daily"]
    z = df.select(*keep, F.explode(F.arrays_zip("daily.time", *[f"daily.{c}" for c in WEATHER_COLUMNS])).alias("z"))
    return z.select(*keep, F.col("z.time").try_cast("date").alias("date"),
                    *[F.col(f"z.{c}").alias(n) for c, n in WEATHER_COLUMNS.items()])


def daily_totals(readings: DataFrame) -> DataFrame:
    """Rain per station and day; partial sums are built before the shuffle."""
    return readings.groupBy("station_id", F.to_date("timestamp").alias("date")).agg(
        F.sum("rainfall_mm").alias("daily_rainfall_total_mm"))
