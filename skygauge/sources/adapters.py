"""Station tables derived from the order and event tables.

Every derived table is a distributed aggregate of the given tables, so its size
follows theirs. ``(location, date)`` is unique in :func:`station_days`: a group
by location is bounded by the days of the calendar, whatever the input size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skygauge.session import cut_lineage, land

RAIN = ("highest_30_min_rainfall_mm", "highest_60_min_rainfall_mm", "highest_120_min_rainfall_mm")
WEATHER = ("mean_temperature_c", "maximum_temperature_c", "minimum_temperature_c",
           "mean_wind_speed_kmh", "max_wind_speed_kmh")
FEATURES = RAIN + WEATHER
TARGET = "daily_rainfall_total_mm"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def station_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per nation and ship date with rain, prediction and weather columns."""
    li = table(spark, sf_dir, "lineitem")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nat = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("location"))
    q = F.col("l_quantity")
    # lines shrink to one row per supplier and day before they meet the suppliers
    per_day = li.groupBy("l_suppkey", F.to_date("l_shipdate").alias("date")).agg(
        F.sum(q).alias("q"), F.sum(q * (1 - F.col("l_discount"))).alias("cv"), F.sum(q * (1 + F.col("l_tax"))).alias("ob"),
        F.count(F.lit(1)).alias("n"), F.count(q).alias("n_q"), F.max("l_linenumber").alias("gust"), F.min(q).alias("h30"), F.max(q).alias("h120"))
    base = (
        per_day.join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nat, F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy("location", "date")
        .agg(
            F.sum("q").alias("q"), F.sum("cv").alias("cv"), F.sum("ob").alias("ob"),
            (F.sum("n") - 1).cast("double").alias("wind"), F.max("gust").cast("double").alias("gust"),
            F.min("h30").alias("h30"), F.try_divide(F.sum("q"), F.sum("n_q")).alias("h60"), F.max("h120").alias("h120"),
        )
    )
    day = F.dayofmonth("date")
    extracted = F.greatest(F.col("q") - 20, F.lit(0.0))
    mean_t = 20 + F.col("q") % 10
    rain_on = day % 7 != 0
    return base.select(
        "location", "date", F.year("date").alias("year"), "q",
        extracted.alias("extracted_mm"),
        F.round("cv", 4).alias("cv_predicted_mm"),
        F.round("ob", 4).alias("obs_predicted_mm"),
        F.when(day % 10 != 0, F.greatest(F.col("q") - 18, F.lit(0.0))).alias("observed_mm"),
        F.when(rain_on, F.col("h30")).alias(RAIN[0]),
        F.when(rain_on, F.round("h60", 4)).alias(RAIN[1]),
        F.when(rain_on, F.col("h120")).alias(RAIN[2]),
        mean_t.alias(WEATHER[0]),
        (mean_t + 1 + F.col("q") % 4).alias(WEATHER[1]),
        (mean_t - 1 - F.col("q") % 3).alias(WEATHER[2]),
        F.when(day != 13, F.col("wind")).alias(WEATHER[3]),
        F.col("gust").alias(WEATHER[4]),
        F.when(day != 20, extracted).alias(TARGET),
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily mart: location, date, year, extracted, two predictions, observed."""
    return station_days(spark, sf_dir).select(
        "location", "date", "year", "extracted_mm", "cv_predicted_mm", "obs_predicted_mm", "observed_mm")


def mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily mart as a table of its own, for what reads it more than once: the lines are read one time."""
    return land(daily(spark, sf_dir), "mart")


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return station_days(spark, sf_dir).select("location", "date", *FEATURES, TARGET)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauge readings: one row per event."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("station_id"), F.col("ts").alias("timestamp"),
        F.col("value").alias("rainfall_mm"))


def quarter_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings summed to 15-minute cells per station."""
    r = readings(spark, sf_dir)
    return (
        r.groupBy("station_id", F.window("timestamp", "15 minutes").start.alias("time"))
        .agg(F.round(F.sum("rainfall_mm"), 4).alias("rain_15min_mm"))
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("station_code"), F.col("n_name").alias("station_name"),
        (1.2 + F.col("n_nationkey") * 0.01).alias("latitude"),
        (103.6 + F.col("n_regionkey") * 0.05).alias("longitude"))


def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("gauge_id"),
        (1.2 + F.col("s_nationkey") * 0.01 + F.col("s_suppkey") % 7 * 0.003).alias("latitude"),
        (103.6 + F.col("s_suppkey") % 5 * 0.05 + F.col("s_suppkey") % 11 * 0.002).alias("longitude"))


def gauge_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``gauge_id, date, daily_rainfall_total_mm``: each gauge's own readings of a day."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("gauge_id"), F.to_date("l_shipdate").alias("date")).agg(F.sum("l_quantity").alias("daily_rainfall_total_mm"))


def monthly_index(spark: SparkSession, sf_dir: str, name: str = "ONI") -> DataFrame:
    """One value per order month, -9999 where missing (every 11th month).

    The four indices differ in what they average and in their first month, so a
    spine over all of them has holes.
    """
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint"))  # exact in any order
    price = cents.cast("double") / F.count(F.lit(1)) / 100
    what, missing, first = {
        "AQI": (price / 1000, 3, 1), "DMI": (price / 5000 - 20, 5, 4),
        "ONI": (price / 2500 - 30, 0, 1), "RH": (price % 100, 7, 8),
    }[name]
    o = table(spark, sf_dir, "orders")
    month = F.to_date(F.date_trunc("month", "o_orderdate"))
    n = F.year("date") * 12 + F.month("date")
    return (
        o.groupBy(month.alias("date")).agg(F.round(what, 3).alias("v"))
        .filter((F.year("date") > 1995) | (F.month("date") >= first))
        .select("date", F.when(n % 11 == missing, -9999.0).otherwise(F.col("v")).alias(name))
    )


class Landed(str):
    """Data folder whose chart points have been written out once, for queries that read them often."""

    days: DataFrame | None = None


def land_charts(spark: SparkSession, sf_dir: str) -> Landed:
    out = Landed(sf_dir)
    out.days = cut_lineage(plot_days(spark, sf_dir))
    return out


def plot_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the yearly charts: one per station-day whose observed value is present."""
    landed = getattr(sf_dir, "days", None)
    if landed is not None:
        return landed
    return (
        station_days(spark, sf_dir).filter("observed_mm IS NOT NULL")
        .select(F.concat_ws("-", F.regexp_replace("location", " ", "_"), F.col("year")).alias("plot_id"),
                "date", "year", F.dayofyear("date").alias("doy"), "extracted_mm")
    )


def dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected dots: 2.7 px per day on integer pixels, so spacings are 2 and 3."""
    return plot_days(spark, sf_dir).select(
        "plot_id", F.floor(100 + F.col("doy") * 27 / 10).cast("int").alias("x"),
        (600 - 4 * F.col("extracted_mm")).cast("int").alias("y"))


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per chart with its year and its first and last chart pixel."""
    return (
        plot_days(spark, sf_dir).groupBy("plot_id", "year").agg(F.count(F.lit(1)).alias("n_dots"))
        .withColumn("n_days", F.dayofyear(F.make_date("year", F.lit(12), F.lit(31))))
        .withColumn("data_start", F.lit(102))
        .withColumn("data_end", F.floor(100 + F.col("n_days") * 27 / 10).cast("int"))
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month-start ticks of every chart, one pixel off on every third month."""
    m = plots(spark, sf_dir).select("plot_id", "year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    date = F.make_date("year", "month", F.lit(1))
    x = F.floor(100 + F.dayofyear(date) * 27 / 10) + F.when(F.col("month") % 3 == 0, 1).otherwise(0)
    return m.select("plot_id", x.cast("double").alias("x"), date.alias("date"),
                    F.date_format(date, "yyyy-MM").alias("label"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value labels 0, 20, 40, ... up to each chart's maximum (at least 40)."""
    top = plot_days(spark, sf_dir).groupBy("plot_id").agg(F.max("extracted_mm").alias("mx"))
    k = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("mx") / 20), F.lit(2)).cast("int")))
    return top.select("plot_id", k.alias("k")).select(
        "plot_id", (F.col("k") * 20).cast("double").alias("value"), F.lit(60.0).alias("x"),
        (600.0 - 80 * F.col("k")).alias("y"))


def grid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected grid lines of every chart: borders, month starts, year end; label heights one pixel off on odd ones."""
    p = plots(spark, sf_dir)
    month = F.explode(F.sequence(F.lit(1), F.lit(12)))
    starts = p.select("plot_id", "year", month.alias("m")).select(
        "plot_id", F.floor(100 + F.dayofyear(F.make_date("year", "m", F.lit(1))) * 27 / 10).cast("int").alias("pos"))
    edges = p.select("plot_id", F.explode(F.array(F.lit(100), F.col("data_end"), F.col("data_end") + 6)).alias("pos"))
    vertical = starts.unionByName(edges).select("plot_id", F.lit("x").alias("axis"), "pos")
    level = labels(spark, sf_dir).select(
        "plot_id", F.lit("y").alias("axis"), (F.col("y") + F.col("value") / 20 % 2).cast("int").alias("pos"))
    return vertical.unionByName(level)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised text of every chart: value labels, stray numbers and words, and month texts."""
    lab = labels(spark, sf_dir).select(
        "plot_id", F.col("value").cast("int").cast("string").alias("text"), F.lit(50.0).alias("x"),
        (F.col("y") - 5).alias("y"), F.lit(20.0).alias("w"), F.lit(10.0).alias("h"))
    p = plots(spark, sf_dir)
    t = lambda s, x, y: F.struct(F.lit(s).alias("text"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    stray = p.select("plot_id", F.explode(F.when(
        F.col("n_dots") % 2 == 0, F.array(t("33", 50, 295), t("mm", 50, 100), t("50", 400, 300)))
        .otherwise(F.array(t("7", 50, 400), t("1999-13", 50, 650)))).alias("t"))
    stray = stray.select("plot_id", "t.text", "t.x", "t.y", F.lit(20.0).alias("w"), F.lit(10.0).alias("h"))
    days = ticks(spark, sf_dir).select(
        "plot_id", F.concat("label", F.lit(",")).alias("text"), (F.col("x") - 15).alias("x"), F.lit(640.0).alias("y"),
        F.lit(30.0).alias("w"), F.lit(10.0).alias("h"))
    return lab.unionByName(stray).unionByName(days)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blue 5 x 5 squares around every point, 6 px per day, every fifth day 3 px closer to its predecessor."""
    p = plot_days(spark, sf_dir)
    cx = 6 * F.col("doy") - F.when(F.col("doy") % 5 == 0, 3).otherwise(0)
    cy = (600 - 4 * F.col("extracted_mm")).cast("int")
    c = p.select("plot_id", cx.alias("cx"), cy.alias("cy"))
    span = F.sequence(F.lit(-2), F.lit(2))
    c = c.withColumn("dx", F.explode(span)).withColumn("dy", F.explode(span))
    return c.select("plot_id", (F.col("cx") + F.col("dx")).alias("x"), (F.col("cy") + F.col("dy")).alias("y")) \
        .distinct().select("plot_id", "x", "y", F.lit(31).alias("r"), (F.lit(119) + F.col("x") % 3).alias("g"), F.lit(180).alias("b"))
