"""Marts and the series shown from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skygauge.operators.spines import weekly_mart

DAILY_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()), T.StructField("location", T.StringType()),
    T.StructField("year", T.IntegerType()), T.StructField("extracted_mm", T.DoubleType()),
    T.StructField("cv_predicted_mm", T.DoubleType()), T.StructField("obs_predicted_mm", T.DoubleType()),
    T.StructField("observed_mm", T.DoubleType())])
WEEKLY_SCHEMA = DAILY_SCHEMA
MART_VALUES = ("extracted_mm", "cv_predicted_mm", "obs_predicted_mm", "observed_mm")


def empty_mart(spark: SparkSession, schema: T.StructType = DAILY_SCHEMA) -> DataFrame:
    return spark.createDataFrame([], schema)


def replace_mart(df: DataFrame, path: str, partition_by: Sequence[str] = ("year",)) -> DataFrame:
    """Overwrite the mart folder, one directory per year, rows of a year spread over tasks by location."""
    out = df.repartition(*partition_by, "location") if "location" in df.columns else df
    out.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def build_daily_mart(predicted: DataFrame, observed: DataFrame, features: Sequence[str],
                     target: str = "daily_rainfall_total_mm") -> DataFrame:
    """Predictions nulled on days without any feature, joined to the observed value; matched days only."""
    no_features = F.lit(True)
    for c in features:
        no_features = no_features & F.col(c).isNull()
    blank = no_features & F.col(target).isNotNull()
    train = predicted.select(
        F.replace("location", F.lit("_"), F.lit(" ")).alias("location"), "date", F.col(target).alias("extracted_mm"),
        *[F.when(~blank, F.col(c)).alias(c) for c in ("cv_predicted_mm", "obs_predicted_mm")])
    obs = observed.select("location", "date", F.col(target).alias("observed_mm"))
    obs = obs.join(train.select("location").distinct(), "location", "left_semi")
    return train.join(obs, ["location", "date"], "left").dropna(subset=["observed_mm"]).withColumn(
        "year", F.year("date"))


def build_weekly_mart(daily: DataFrame) -> DataFrame:
    return weekly_mart(daily, MART_VALUES)


def melt(weekly: DataFrame) -> DataFrame:
    """Wide mart to (location, year, date, type, rainfall), nulls dropped."""
    named = weekly.select("location", "year", "date", F.col("observed_mm").alias("Observed"),
                          F.col("cv_predicted_mm").alias("Predicted"), F.col("extracted_mm").alias("Extracted"))
    return named.unpivot(["location", "year", "date"], ["Observed", "Predicted", "Extracted"], "type", "rainfall") \
        .filter(F.col("rainfall").isNotNull())


def of_label_year(df: DataFrame) -> DataFrame:
    """Rows with the year of their date label, the year the chart queries select by."""
    return df.withColumn("label_year", F.year("date"))


def timeseries(df: DataFrame) -> DataFrame:
    return of_label_year(df).select(
        "location", "label_year", "date", "observed_mm", "extracted_mm", "cv_predicted_mm",
        F.abs(F.col("observed_mm") - F.col("extracted_mm")).alias("abs_error"))


def error_series(df: DataFrame) -> DataFrame:
    d = of_label_year(df.dropna(subset=["cv_predicted_mm", "extracted_mm"]))
    return d.select("location", "label_year", "date",
                    F.abs(F.col("cv_predicted_mm") - F.col("extracted_mm")).alias("abs_error"))


def one_location(df: DataFrame, location: str, year: int | None = None) -> DataFrame:
    """Ordered rows of a location (and year); names what is available when there are none."""
    out = df.filter(F.col("location") == location)
    if year is not None:
        out = out.filter(F.year("date") == year)
    if out.isEmpty():
        known = [r[0] for r in df.select("location").distinct().orderBy("location").collect()]
        raise ValueError(f"no rows for {location!r}; available: {known}")
    return out.orderBy("date")


def series_payload(df: DataFrame, keys: Sequence[str], series: dict[str, str], date: str = "date",
                   dropna: bool = False) -> DataFrame:
    """Sorted dates and one value array per series, nulls kept unless ``dropna``.

    One output row per group; a group holds one row per date.
    """
    have = {label: c for label, c in series.items() if c in df.columns}
    row = F.struct(F.col(date).alias("d"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(have.values())])
    g = df.filter(F.col(date).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_rows"))

    def values(i: int) -> Column:
        v = F.transform("_rows", lambda s: s[f"v{i}"])
        return F.filter(v, lambda x: x.isNotNull()) if dropna else v

    return g.select(*keys, F.transform("_rows", lambda s: F.date_format(s.d, "yyyy-MM-dd")).alias("dates"),
                    F.struct(*[values(i).alias(label) for i, label in enumerate(have)]).alias("series"))


def long_payload(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Payload of (date, type, rainfall) rows: every series on all dates of its group."""
    keys = list(keys)
    dates = df.select(*keys, "date").distinct()
    grid = dates.join(df.select(*keys, "type").distinct(), keys)
    full = grid.join(df.groupBy(*keys, "date", "type").agg(F.max("rainfall").alias("rainfall")),
                     keys + ["date", "type"], "left")
    g = full.groupBy(*keys, "type").agg(F.sort_array(F.collect_list(F.struct("date", "rainfall"))).alias("_rows"))
    return g.select(*keys, "type", F.transform("_rows", lambda s: F.date_format(s.date, "yyyy-MM-dd")).alias("dates"),
                    F.transform("_rows", lambda s: s.rainfall).alias("values"))


def error_payload(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return series_payload(df, keys, {"Absolute Error": "abs_error"})


def calibration_pairs(df: DataFrame) -> DataFrame:
    return of_label_year(df.dropna(subset=["extracted_mm", "cv_predicted_mm"])).select(
        "location", "label_year", "date", F.col("extracted_mm").alias("x"), F.col("cv_predicted_mm").alias("y"))


def bias_series(weekly: DataFrame) -> DataFrame:
    """Observed minus extracted weekly means; weeks without both stay null."""
    return of_label_year(weekly).select(
        "location", "label_year", "date", (F.col("observed_mm") - F.col("extracted_mm")).alias("bias"))


def extreme_days_by_weekly_p90(daily: DataFrame, weekly: DataFrame) -> DataFrame:
    """Daily rows at or above the linear p90 of the weekly means of their location and year."""
    thr = of_label_year(weekly).groupBy("location", "label_year").agg(
        F.expr("percentile(extracted_mm, 0.9)").alias("p90"))
    return timeseries(daily).join(thr, ["location", "label_year"]).filter(
        F.col("extracted_mm") >= F.col("p90")).select(
        "location", "label_year", "date", "extracted_mm", "abs_error", "p90")
