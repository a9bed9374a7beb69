"""Weather feature columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bin edges.
RANGE_BINS = (0, 5, 10, 15, 20, 100)
MEAN_POSITION_BINS = (0.0, 0.33, 0.66, 1.0)
ASYMMETRY_BINS = (-100, -2, 2, 100)
RAIN_BINS = (0, 0.1, 1, 5, 10, 20, 50, 300)


def right_closed_bin(col: Column, edges: Sequence[float]) -> Column:
    """Code of the interval (edge[i], edge[i+1]]; the first one is closed on both sides, outside is null."""
    out = F.when(col < edges[0], None)
    for i, hi in enumerate(edges[1:]):
        out = out.when(col <= hi, i)
    return out.otherwise(None).cast("int")


def temperature_features(df: DataFrame) -> DataFrame:
    hi, lo, mean = (F.col(f"{k}_temperature_c") for k in ("maximum", "minimum", "mean"))
    df = df.withColumns({
        "temp_range_c": hi - lo, "temp_mean_minus_min": mean - lo, "temp_max_minus_mean": hi - mean})
    df = df.withColumns({
        "temp_mean_position": F.try_divide(F.col("temp_mean_minus_min"), F.col("temp_range_c") + 1e-6),
        "temp_asymmetry": F.col("temp_mean_minus_min") - F.col("temp_max_minus_mean")})
    return df.withColumns({
        "temp_range_bin": right_closed_bin(F.col("temp_range_c"), RANGE_BINS),
        "temp_mean_position_bin": right_closed_bin(F.col("temp_mean_position"), MEAN_POSITION_BINS),
        "temp_asymmetry_bin": right_closed_bin(F.col("temp_asymmetry"), ASYMMETRY_BINS)})


def ratio_or_one(a: Column, b: Column) -> Column:
    """a / b, and 1 where the quotient is missing or not finite."""
    return F.coalesce(F.try_divide(a, b), F.lit(1.0))


def rain_bins(df: DataFrame, edges: Sequence[float] = RAIN_BINS) -> DataFrame:
    cols = [f"highest_{m}_min_rainfall_mm" for m in (30, 60, 120)]
    return df.withColumns({f"{c}_bin": right_closed_bin(F.col(c), edges) for c in cols})


def wind_rain_features(df: DataFrame) -> DataFrame:
    df = df.withColumns({
        "wind_gust_factor": ratio_or_one(F.col("max_wind_speed_kmh"), F.col("mean_wind_speed_kmh")),
        "rain_intensity_ratio": ratio_or_one(
            F.col("highest_60_min_rainfall_mm"), F.col("highest_30_min_rainfall_mm"))})
    return rain_bins(df)


def interaction_features(df: DataFrame) -> DataFrame:
    """Products of weather and climate columns; the climate ones stop at the first missing column."""
    df = df.withColumn("wind_x_rain", F.col("mean_wind_speed_kmh") * F.col("highest_60_min_rainfall_mm"))
    for name, a, b in (
        ("ONI_x_temp", "ONI", "mean_temperature_c"), ("DMI_x_rainfall", "DMI", "highest_60_min_rainfall_mm"),
        ("heat_index_proxy", "RH", "mean_temperature_c"), ("aqi_x_temp_range", "AQI", "temp_range_c"),
    ):
        if not {a, b} <= set(df.columns):
            break
        df = df.withColumn(name, F.col(a) * F.col(b))
    return df


def log_target(y: Column) -> Column:
    return F.log1p(y)


def unlog_target(z: Column) -> Column:
    return F.expm1(z)
