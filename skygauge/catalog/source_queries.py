"""Readers, writers, feeds and cleaning over the derived station tables."""

from pyspark.sql import functions as F

from skygauge.catalog.registry import query, shown
from skygauge.catalog.shapes import CELLS, GAUGES, READINGS, SD, STATIONS
from skygauge.functions import calendar as cal
from skygauge.functions import text
from skygauge.operators import cleaning as cl
from skygauge.operators import windows as win
from skygauge.plans import marts
from skygauge.session import cut_lineage, land, scratch_dir
from skygauge.sources import adapters as ad
from skygauge.sources import feeds, files

FEATS = ", ".join(ad.FEATURES)
WEATHER_SQL = f"WITH {SD} SELECT location, date, {FEATS} FROM sd"
ALL_NULL = " AND ".join(f"{c} IS NULL" for c in ad.FEATURES)
RAIN_NULL = " AND ".join(f"{c} IS NULL" for c in ad.RAIN)


def land_csv(spark, d):
    """Station files as they arrive: a folder per station, raw headers, text, the missing mark."""
    w = ad.weather(spark, d)
    raw = w.select(
        F.col("location").alias("station"), F.col("date").cast("string").alias(files.RAW_HEADERS["date"]),
        *[F.coalesce(F.col(c).cast("string"), F.lit(files.MISSING_MARK)).alias(files.RAW_HEADERS[c]) for c in ad.FEATURES])
    path = scratch_dir(spark, "landed")
    raw.repartition("station").write.partitionBy("station").option("header", True).csv(path)
    return path


#: Layout of a station's files: 0 as delivered, 1 in reversed column order, 2 without the strongest wind.
LAYOUT = "ascii(right(location, 1)) % 3"


def land_mixed_csv(spark, d):
    """Station files of three layouts below one folder."""
    w = ad.weather(spark, d)
    path = scratch_dir(spark, "landed")
    cells = {"Date": F.col("date").cast("string")} | {files.RAW_HEADERS[c]: F.coalesce(F.col(c).cast("string"), F.lit(files.MISSING_MARK)) for c in ad.FEATURES}
    names = list(cells)
    for k, order in enumerate((names, names[::-1], [n for n in names if n != files.RAW_HEADERS["max_wind_speed_kmh"]])):
        part = w.filter(F.expr(LAYOUT) == k).select(F.col("location").alias("station"), *[cells[n].alias(n) for n in order])
        part.repartition("station").write.mode("append").partitionBy("station").option("header", True).csv(path)
    return path


def station_of_folder(df):
    return df.withColumn("location", F.regexp_replace("location", "^station=", ""))


@query("io01_read_station_csv", f"""WITH {SD} SELECT count(*) AS n, {', '.join(f'count({c}) AS {c}' for c in ad.FEATURES)} FROM sd""")
def io01(spark, d):
    raw = files.read_station_csv(spark, land_csv(spark, d))
    typed = cl.convert_numeric(raw, raw.columns)
    return typed.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in ad.FEATURES])


@query("io02_concat_folder", f"""WITH {SD} SELECT date, count(*) AS n, round(sum(CASE WHEN {LAYOUT} <> 2 THEN max_wind_speed_kmh END) + 1e-9, 4) AS wind FROM sd GROUP BY 1""",
       dates=("date",))
def io02(spark, d):
    rows = files.concat_folder(spark, land_mixed_csv(spark, d))
    assert "csv_files" in rows.columns
    return cl.convert_numeric(rows, ad.FEATURES).groupBy(F.col("date").try_cast("date").alias("date")).agg(
        F.count("csv_files").alias("n"), shown(F.sum("max_wind_speed_kmh"), 4).alias("wind"))


BY_NAME_SQL = WEATHER_SQL.replace("max_wind_speed_kmh FROM", f"CASE WHEN {LAYOUT} <> 2 THEN max_wind_speed_kmh END AS max_wind_speed_kmh FROM")


@query("io03_concat_stations", BY_NAME_SQL, dates=("date",))
def io03(spark, d):
    rows = station_of_folder(files.concat_stations(spark, land_mixed_csv(spark, d)))
    typed = cl.convert_numeric(rows, ad.FEATURES).withColumn("date", F.col("date").try_cast("date"))
    return typed.drop("csv_files")


@query("io04_header_audit", f"""WITH {SD} SELECT (SELECT count(DISTINCT location) FROM sd) AS stations, (SELECT count(DISTINCT {LAYOUT} = 2) FROM sd) AS headers""")
def io04(spark, d):
    folder = F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)
    return files.header_audit(spark, land_mixed_csv(spark, d)).agg(
        F.count_distinct(folder).alias("stations"), F.count_distinct("columns").alias("headers"))


@query("io05_count_rows", f"WITH {SD} SELECT location, count(*) AS n FROM sd GROUP BY 1")
def io05(spark, d):
    return station_of_folder(files.count_rows(spark, land_csv(spark, d)))


@query("io06_sample_file")
def io06(spark, d):
    return station_of_folder(files.sample_file(spark, land_csv(spark, d), seed=7))


@query("io07_stations_json", f"""WITH {STATIONS} SELECT CAST(station_code AS VARCHAR) AS station_code, station_name,
  round(latitude + 1e-9, 6) AS latitude, round(longitude + 1e-9, 6) AS longitude FROM stations""")
def io07(spark, d):
    path = scratch_dir(spark, "stations")
    ad.stations(spark, d).withColumn("station_code", F.col("station_code").cast("string")).write.json(path)
    return files.read_stations(spark, path, one_array=False).withColumns(
        {c: shown(c, 6) for c in ("latitude", "longitude")})


def readings_feed(spark, d):
    """Feed text: one item per event with the reading of its type and of its user group."""
    e = ad.table(spark, d, "events")
    one = lambda sid: F.struct(sid.alias("station_id"), F.col("value"))
    item = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
                    F.array(one(F.col("event_type")), one(F.concat(F.lit("U"), F.col("user_id") % 10))).alias("readings"))
    return e.select(F.to_json(F.struct(F.array(item).alias("items"))).alias("value"))


@query("io08_flatten_readings", """SELECT event_type AS station_id, date_trunc('second', ts) AS timestamp, round(value + 1e-9, 4) AS rainfall_mm FROM events
UNION ALL SELECT 'U' || (user_id % 10), date_trunc('second', ts), round(value + 1e-9, 4) FROM events""", stamps=("timestamp",))
def io08(spark, d):
    out = feeds.flatten_readings(feeds.parse(readings_feed(spark, d), feeds.READINGS_SCHEMA))
    return out.withColumn("rainfall_mm", shown("rainfall_mm", 4))


@query("io09_flatten_gauges", f"""WITH {GAUGES} SELECT CAST(gauge_id AS VARCHAR) AS station_id, round(latitude + 1e-9, 6) AS latitude,
  round(longitude + 1e-9, 6) AS longitude FROM gauges""")
def io09(spark, d):
    g = ad.gauges(spark, d).select(F.to_json(F.struct(F.struct(F.array(F.struct(
        F.col("gauge_id").cast("string").alias("id"), F.struct("latitude", "longitude").alias("location"))).alias("stations"))
        .alias("metadata"))).alias("value"))
    out = feeds.flatten_gauges(feeds.parse(g, feeds.STATIONS_SCHEMA))
    return out.withColumns({c: shown(c, 6) for c in ("latitude", "longitude")})


def rain_feed(spark, d):
    """15-minute rain per station-day as parallel arrays (at most 96 steps)."""
    cells = ad.quarter_hours(spark, d).withColumn("date", F.to_date("time"))
    g = cells.groupBy("station_id", "date").agg(F.sort_array(F.collect_list(F.struct("time", "rain_15min_mm"))).alias("c"))
    return g.select("station_id", "date", F.to_json(F.struct(F.struct(
        F.transform("c", lambda s: F.date_format(s.time, "yyyy-MM-dd'T'HH:mm")).alias("time"),
        F.transform("c", lambda s: s.rain_15min_mm).alias("precipitation")).alias("minutely_15"))).alias("value"))


@query("io10_flatten_rain", f"WITH {CELLS} SELECT station_id, time, rain_15min_mm FROM cells", stamps=("time",))
def io10_rain(spark, d):
    return feeds.flatten_rain(feeds.parse(rain_feed(spark, d), feeds.RAIN_SCHEMA)).drop("date")


def weather_feed(spark, d):
    """Daily weather per station-month as parallel arrays (at most 31 steps)."""
    w = ad.weather(spark, d)
    row = F.struct(F.col("date"), *[F.col(n).alias(c) for c, n in feeds.WEATHER_COLUMNS.items()])
    g = w.groupBy("location", F.trunc("date", "MM").alias("m")).agg(F.sort_array(F.collect_list(row)).alias("c"))
    field = lambda c: F.transform("c", lambda s: s[c]).alias(c)
    arrays = [field(c) for c in feeds.WEATHER_COLUMNS]
    return g.select("location", F.to_json(F.struct(F.struct(
        F.transform("c", lambda s: s.date.cast("string")).alias("time"), *arrays).alias("daily"))).alias("value"))


@query("io10_flatten_weather", f"WITH {SD} SELECT location, date, {', '.join(ad.WEATHER)} FROM sd", dates=("date",))
def io10_weather(spark, d):
    return feeds.flatten_weather(feeds.parse(weather_feed(spark, d), feeds.WEATHER_SCHEMA))


@query("io11_normalize_archive", f"WITH {SD} SELECT date, {FEATS}, location, daily_rainfall_total_mm FROM sd", dates=("date",))
def io11(spark, d):
    w = ad.weather(spark, d)
    raw = w.select(F.year("date").alias("Year"), F.month("date").alias("Month"), F.dayofmonth("date").alias("Day"),
                   F.concat(F.lit("( "), F.col("location"), F.lit("  )")).alias("location"),
                   *[F.col(c).alias(files.RAW_HEADERS[c]) for c in ad.FEATURES],
                   F.col(ad.TARGET).alias("Daily Rainfall Total (mm)"))
    return files.normalize_archive(raw)


@query("io12_csv_sink", f"WITH {SD} SELECT location, date, extracted_mm FROM sd", dates=("date",))
def io12(spark, d):
    path = scratch_dir(spark, "sink")
    files.write_csv(ad.daily(spark, d).select("location", "date", "extracted_mm"), path)
    return files.load_training(spark, path, ["extracted_mm"])


@query("io13_replace_daily_mart", f"""WITH {SD} SELECT year, count(*) AS n, round(sum(extracted_mm) + 1e-9, 4) AS mm FROM sd GROUP BY 1""")
def io13(spark, d):
    mart = marts.replace_mart(ad.daily(spark, d), scratch_dir(spark, "daily"))
    return mart.groupBy("year").agg(F.count(F.lit(1)).alias("n"), shown(F.sum("extracted_mm"), 4).alias("mm"))


@query("io17_submission", f"""WITH {SD} SELECT lower(location) || '_' || strftime(date, '%Y_%m_%d') AS "ID (kota)",
  CAST(year(date) AS INTEGER) AS tahun, CAST(month(date) AS INTEGER) AS bulan, CAST(day(date) AS INTEGER) AS hari,
  round(greatest(cv_predicted_mm - 20, 0) + 1e-9, 6) AS prediksi FROM sd""")
def io17(spark, d):
    p = ad.daily(spark, d).withColumn("prediksi", F.col("cv_predicted_mm") - 20)
    return files.submission(p).withColumn("prediksi", shown("prediksi", 6))


@query("io18_load_training", f"SELECT * EXCLUDE (location) FROM ({BY_NAME_SQL}) AS named", dates=("date",))
def io18(spark, d):
    return files.load_training(spark, land_mixed_csv(spark, d), ad.FEATURES)


# ---- feeds: aggregates ------------------------------------------------------

@query("a12_gauge_daily_totals", f"""WITH {READINGS} SELECT station_id, CAST(timestamp AS DATE) AS date,
  round(sum(rainfall_mm) + 1e-9, 4) AS daily_rainfall_total_mm FROM readings GROUP BY 1, 2""", dates=("date",))
def a12(spark, d):
    t = feeds.daily_totals(ad.readings(spark, d))
    return t.withColumn("daily_rainfall_total_mm", shown("daily_rainfall_total_mm", 4))


def _roll(k: int) -> str:
    f = f"OVER (PARTITION BY station_id, date ORDER BY time ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(v) {f} = {k} THEN sum(v) {f} END"


@query("a13_rolling_rain_maxima", f"""WITH {CELLS},
c AS (SELECT station_id, CAST(time AS DATE) AS date, time, rain_15min_mm AS v FROM cells),
r AS (SELECT station_id, date, {_roll(2)} AS a, {_roll(4)} AS b, {_roll(8)} AS c FROM c)
SELECT station_id, date, round(max(a) + 1e-9, 4) AS highest_30_min_rainfall_mm, round(max(b) + 1e-9, 4) AS highest_60_min_rainfall_mm,
  round(max(c) + 1e-9, 4) AS highest_120_min_rainfall_mm FROM r GROUP BY 1, 2""", dates=("date",))
def a13(spark, d):
    cells = ad.quarter_hours(spark, d).withColumn("date", F.to_date("time"))
    out = win.rolling_maxima(cells, ["station_id", "date"], "time", "rain_15min_mm")
    return out.withColumns({c: shown(c, 4) for c in ad.RAIN})


@query("m23_feature_rows", f"""WITH {CELLS},
c AS (SELECT station_id, CAST(time AS DATE) AS date, time, rain_15min_mm AS v FROM cells),
r AS (SELECT station_id, date, {_roll(2)} AS a, {_roll(4)} AS b, {_roll(8)} AS c FROM c),
w AS (SELECT event_type AS station_id, CAST(ts AS DATE) AS date, max(user_id % 30) AS t FROM events GROUP BY 1, 2)
SELECT r.station_id AS location, r.date, CAST(any_value(t) AS DOUBLE) AS mean_temperature_c, round(max(a) + 1e-9, 4) AS highest_30_min_rainfall_mm,
  round(max(b) + 1e-9, 4) AS highest_60_min_rainfall_mm, round(max(c) + 1e-9, 4) AS highest_120_min_rainfall_mm
FROM r JOIN w USING (station_id, date) GROUP BY 1, 2""", dates=("date",))
def m23(spark, d):
    """Feature rows of many station-days at once: weather feed joined to the rain maxima."""
    e = ad.table(spark, d, "events")
    w = e.groupBy(F.col("event_type").alias("location"), F.to_date("ts").alias("date")).agg(
        F.max(F.col("user_id") % 30).cast("double").alias("t"))
    text_feed = w.select("location", F.to_json(F.struct(F.struct(
        F.array(F.col("date").cast("string")).alias("time"),
        *[F.array("t").alias(c) for c in feeds.WEATHER_COLUMNS]).alias("daily"))).alias("value"))
    daily = feeds.flatten_weather(feeds.parse(text_feed, feeds.WEATHER_SCHEMA))
    rain = feeds.flatten_rain(feeds.parse(rain_feed(spark, d), feeds.RAIN_SCHEMA))
    rows = feature_rows(daily, rain.withColumnRenamed("station_id", "location"))
    return rows.select("location", "date", "mean_temperature_c", *[shown(c, 4).alias(c) for c in ad.RAIN])


def feature_rows(daily, rain):
    maxima = win.rolling_maxima(rain, ["location", "date"], "time", "rain_15min_mm")
    return daily.join(maxima, ["location", "date"])


# ---- cleaning ---------------------------------------------------------------

@query("pf01_clean_headers", f"WITH {SD} SELECT date, {FEATS} FROM sd", dates=("date",))
def pf01(spark, d):
    w = ad.weather(spark, d)
    raw = w.select(F.col("date").alias("﻿Date"), *[F.col(c).alias(files.RAW_HEADERS[c].replace("°", "Â°")) for c in ad.FEATURES])
    return cl.clean_headers(raw)


@query("pf02_convert_numeric", f"WITH {SD} SELECT location, date, highest_30_min_rainfall_mm, mean_wind_speed_kmh FROM sd", dates=("date",))
def pf02(spark, d):
    w = ad.weather(spark, d).select("location", "date", "highest_30_min_rainfall_mm", "mean_wind_speed_kmh")
    marked = w.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(files.MISSING_MARK))
                            for c in ("highest_30_min_rainfall_mm", "mean_wind_speed_kmh")})
    return cl.convert_numeric(marked, marked.columns + ["absent"])


@query("pf03_station_names", "SELECT n_name AS raw, trim(regexp_replace(regexp_replace(' (' || n_name || ')  West ', '[()]', '', 'g'), '\\s+', ' ', 'g')) AS name FROM nation")
def pf03(spark, d):
    messy = F.concat(F.lit(" ("), F.col("n_name"), F.lit(")  West "))
    return ad.table(spark, d, "nation").select(F.col("n_name").alias("raw"), text.station_name(messy).alias("name"))


@query("pf04_unslug", "SELECT n_name AS raw, replace(n_name, '_', ' ') AS name FROM nation")
def pf04(spark, d):
    return ad.table(spark, d, "nation").select(F.col("n_name").alias("raw"), text.unslug(F.col("n_name")).alias("name"))


@query("pf05_time_key", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS time_key FROM orders""")
def pf05(spark, d):
    k = F.col("o_orderkey") % 3
    raw = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "dd/MM/yyyy")) \
        .otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    return ad.table(spark, d, "orders").select("o_orderkey", cal.time_key(raw, "yyyy-MM").alias("time_key"))


@query("pf07_drop_rename", f"WITH {SD} SELECT location, date, daily_rainfall_total_mm AS extracted_mm FROM sd", dates=("date",))
def pf07(spark, d):
    w = cl.drop_features(ad.weather(spark, d), [*ad.FEATURES, "no_such_column"])
    return w.withColumnsRenamed({ad.TARGET: "extracted_mm"})


def rain_only(spark, d):
    return ad.weather(spark, d).select("location", "date", *ad.RAIN, ad.TARGET)


RAIN_COLS = ", ".join(ad.RAIN)


@query("pf08_remove_no_signal", f"WITH {SD} SELECT location, date, {RAIN_COLS}, daily_rainfall_total_mm FROM sd WHERE NOT ({RAIN_NULL})", dates=("date",))
def pf08(spark, d):
    return cl.remove_no_signal(rain_only(spark, d), ad.RAIN)


@query("pf09_drop_target_only", f"""WITH {SD} SELECT location, date, {RAIN_COLS}, daily_rainfall_total_mm FROM sd
WHERE NOT ({RAIN_NULL} AND daily_rainfall_total_mm IS NOT NULL)""", dates=("date",))
def pf09(spark, d):
    return cl.drop_target_only(rain_only(spark, d), ad.RAIN, ad.TARGET)


@query("pf10_blank_predictions", f"""WITH {SD} SELECT location, date,
  CASE WHEN NOT ({RAIN_NULL} AND daily_rainfall_total_mm IS NOT NULL) THEN cv_predicted_mm END AS cv_predicted_mm FROM sd""", dates=("date",))
def pf10(spark, d):
    s = ad.station_days(spark, d)
    return cl.blank_predictions(s, ad.RAIN, ad.TARGET, ["cv_predicted_mm"]).select("location", "date", "cv_predicted_mm")


@query("pf11_fill_constants", f"""WITH {SD} SELECT location, date, coalesce(highest_30_min_rainfall_mm, 0) AS highest_30_min_rainfall_mm,
  coalesce(daily_rainfall_total_mm, 0) AS daily_rainfall_total_mm FROM sd""", dates=("date",))
def pf11(spark, d):
    return ad.weather(spark, d).fillna(0.0, subset=[*ad.RAIN, ad.TARGET]).select("location", "date", ad.RAIN[0], ad.TARGET)


@query("pf12_point_lookup", f"""WITH {SD}
SELECT location, date, CASE WHEN year(date) <= 2000 THEN extracted_mm END AS extracted_mm,
  CASE WHEN year(date) <= 1999 THEN 'train_dataset' WHEN year(date) <= 2000 THEN 'test_dataset' END AS feature_source,
  CASE WHEN year(date) > 2000 THEN 'no source has these keys' END AS reason FROM sd""", dates=("date",))
def pf12(spark, d):
    """Every station-day is asked for; the later years are in no source and come back with a reason."""
    x = cut_lineage(ad.daily(spark, d).select("location", "date", "extracted_mm"))
    train, test = x.filter(F.year("date") <= 1999), x.filter(F.year("date").between(1998, 2000))
    return cl.look_up(x.select("location", "date"), [("train_dataset", train), ("test_dataset", test)])


def _filter_sql(extra: str, col: str) -> str:
    return f"WITH {SD} SELECT location, date, {col} AS daily_rainfall_total_mm FROM sd WHERE year(date) > 1998 {extra}"


def _filter_train(spark, d, nulls):
    return cl.filter_train(ad.weather(spark, d).select("location", "date", ad.TARGET), 1998, ad.TARGET, nulls)


@query("pf13_filter_train_drop", _filter_sql("AND daily_rainfall_total_mm IS NOT NULL", ad.TARGET), dates=("date",))
def pf13_drop(spark, d):
    return _filter_train(spark, d, "drop")


@query("pf13_filter_train_impute", _filter_sql("", f"coalesce({ad.TARGET}, 0)"), dates=("date",))
def pf13_impute(spark, d):
    return _filter_train(spark, d, "impute")


@query("pf13_filter_train_keep", _filter_sql("", ad.TARGET), dates=("date",))
def pf13_keep(spark, d):
    return _filter_train(spark, d, "keep")


@query("pf14_clip", f"WITH {SD} SELECT location, date, round(greatest(cv_predicted_mm - 20, 0) + 1e-9, 6) AS p FROM sd", dates=("date",))
def pf14(spark, d):
    p = F.greatest(F.col("cv_predicted_mm") - 20, F.lit(0.0))
    return ad.daily(spark, d).select("location", "date", shown(p, 6).alias("p"))


@query("pf15_forecast_window", f"""WITH {SD}, t AS (SELECT CAST(max(date) + INTERVAL 20 HOUR + INTERVAL 8 HOUR AS DATE) - 30 AS today FROM sd)
SELECT location, date, today - 1 AS last_observed FROM sd, t WHERE date BETWEEN today AND today + 14""", dates=("date", "last_observed"))
def pf15(spark, d):
    """The clock is a parameter: 20:00 UTC thirty days before the last row."""
    x = ad.mart(spark, d)
    clock = x.agg((F.max("date").cast("timestamp") + F.expr("interval 20 hours")).alias("now")).scalar()
    today = F.date_sub(cal.local_today(clock), 30)
    return x.withColumn("today", today).filter(cal.in_forecast_window(F.col("date"), F.col("today"))).select(
        "location", "date", cal.last_observed_date(F.col("today")).alias("last_observed"))


@query("pf16_repair_ids", f"""WITH {SD} SELECT location, date, lower(location) || '_' || strftime(date, '%Y_%m_%d') AS repaired,
  regexp_extract(lower(location) || '_' || strftime(date, '%Y'), '^(.*?_?\\d+)(_|$)', 1) || '_' || strftime(date, '%m_%d') AS rebuilt FROM sd""",
       dates=("date",))
def pf16(spark, d):
    full = text.calendar_id(F.col("location"), F.col("date"))
    cut = F.when(F.dayofmonth("date") % 2 == 0, F.regexp_replace(full, r"_\d{2}_\d{2}$", "")).otherwise(full)
    m, dd = F.month("date"), F.dayofmonth("date")
    return ad.daily(spark, d).select("location", "date", text.repair_id(cut, m, dd).alias("repaired"),
                                     text.rebuild_id(cut, m, dd).alias("rebuilt"))


@query("pf17_split_by_date", f"WITH {SD} SELECT location, date, CASE WHEN date < DATE '2000-01-01' THEN 'train' ELSE 'test' END AS part FROM sd",
       dates=("date",))
def pf17(spark, d):
    train, test = cl.split_by_date(ad.mart(spark, d).select("location", "date"), "2000-01-01")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("a22_null_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null FROM sd" for c in ad.FEATURES).join([f"WITH {SD} ", ""]))
def a22(spark, d):
    return cl.null_profile(ad.weather(spark, d), ad.FEATURES)


_FLAGS = ad.FEATURES[:5]


@query("a23_missing_correlation", f"WITH {SD} " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN isnan(corr(CAST({a} IS NULL AS INT), CAST({b} IS NULL AS INT))) THEN NULL "
    f"ELSE round(corr(CAST({a} IS NULL AS INT), CAST({b} IS NULL AS INT)) + 1e-9, 6) END AS corr FROM sd"
    for a in _FLAGS for b in _FLAGS))
def a23(spark, d):
    return cl.missing_correlation(ad.weather(spark, d), _FLAGS).withColumn("corr", shown("corr", 6))


_NULLS = " + ".join(f"(count(*) - count({c}))" for c in ad.FEATURES)


@query("a24_stage_profile", f"""WITH {SD} SELECT 'loaded' AS stage, count(*) AS n_rows, 11 AS n_cols, {_NULLS} AS n_null, 0 AS n_inf FROM sd
UNION ALL SELECT 'signal', count(*), 11, {_NULLS}, 0 FROM sd WHERE NOT ({RAIN_NULL})""")
def a24(spark, d):
    w = land(ad.weather(spark, d), "weather")
    return cl.stage_profile("loaded", w, ad.FEATURES).unionByName(
        cl.stage_profile("signal", cl.remove_no_signal(w, ad.RAIN), ad.FEATURES))


@query("s19_validate_requests", f"""WITH {SD} SELECT location, CAST(date AS VARCHAR) AS date, CASE WHEN day(date) % 9 = 0 THEN 'date is not yyyy-MM-dd'
  WHEN day(date) % 11 = 0 THEN 'location required' END AS reason FROM sd""")
def s19(spark, d):
    day = F.dayofmonth("date")
    raw = ad.mart(spark, d).select(
        F.col("location").alias("who"), F.col("date").alias("d"),
        F.when(day % 11 != 0, F.col("location")).alias("location"),
        F.when(day % 9 == 0, F.date_format("date", "dd/MM/yyyy")).otherwise(F.col("date").cast("string")).alias("date"))
    good, bad = cl.validate_requests(raw, numeric=())
    out = good.withColumn("reason", F.lit(None).cast("string")).drop("date").unionByName(bad.drop("date"))
    return out.select(F.col("who").alias("location"), F.col("d").alias("date"), "reason")
