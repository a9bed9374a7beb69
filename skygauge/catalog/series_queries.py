"""Spines, calendar fields, windows, joins and correlations."""

from pyspark.sql import functions as F

from skygauge.catalog.registry import query, shown
from skygauge.catalog.shapes import GAUGES, INDICES, READINGS, SD, STATIONS, WEEKLY
from skygauge.functions import calendar as cal
from skygauge.functions.text import unslug
from skygauge.operators import correlation as co
from skygauge.operators import joins as jn
from skygauge.operators import metrics as m
from skygauge.operators import spines as sp
from skygauge.operators import windows as win
from skygauge.operators.ordering import with_ordinal
from skygauge.plans import marts
from skygauge.session import cut_lineage, land
from skygauge.sources import adapters as ad
from skygauge.sources import feeds

IX = ("AQI", "DMI", "ONI", "RH")


def r6(df, *cols):
    return df.withColumns({c: shown(c, 6) for c in cols})


def target_days(spark, d):
    return ad.station_days(spark, d).select("location", "date", "year", ad.TARGET)


# ---- spines and calendar ----------------------------------------------------

FILLED = SD + """,
span AS (SELECT location, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM sd GROUP BY 1),
filled AS (SELECT location, date, extracted_mm FROM span LEFT JOIN sd USING (location, date))"""


@query("c01_fill_missing_dates", f"WITH {FILLED} SELECT * FROM filled", dates=("date",))
def c01(spark, d):
    return sp.fill_missing_dates(ad.mart(spark, d).select("location", "date", "extracted_mm"), ["location"])


@query("c02_reindex_plots", f"""WITH {SD},
span AS (SELECT location, year, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM sd GROUP BY 1, 2)
SELECT location, year, date, extracted_mm FROM span LEFT JOIN sd USING (location, year, date)""", dates=("date",))
def c02(spark, d):
    return sp.fill_missing_dates(ad.mart(spark, d).select("location", "year", "date", "extracted_mm"), ["location", "year"])


CALENDAR = SD + """,
span AS (SELECT location, year, CAST(unnest(generate_series(make_date(year, 1, 1), make_date(year, 12, 31), INTERVAL 1 DAY)) AS DATE) AS date
         FROM (SELECT DISTINCT location, year FROM sd) AS ly),
cal AS (SELECT location, year, date, CAST(dayofyear(date) AS INTEGER) AS doy, daily_rainfall_total_mm FROM span LEFT JOIN sd USING (location, year, date))"""


@query("c03_full_calendar_years", f"WITH {CALENDAR} SELECT * FROM cal", dates=("date",))
def c03(spark, d):
    return sp.full_calendar_years(land(target_days(spark, d), "target_days"), ["location"])


@query("c04_align_to_daily", f"""WITH {INDICES}
SELECT CAST(unnest(generate_series(date, last_day(date), INTERVAL 1 DAY)) AS DATE) AS date, ONI FROM oni""", dates=("date",))
def c04(spark, d):
    return sp.align_to_daily(ad.monthly_index(spark, d, "ONI"))


@query("pf06_sentinel_to_null", f"WITH {INDICES} SELECT date, nullif(ONI, -9999) AS ONI FROM oni", dates=("date",))
def pf06(spark, d):
    from skygauge.operators.cleaning import sentinel_to_null

    return sentinel_to_null(ad.monthly_index(spark, d, "ONI"), ["ONI"])


@query("c05_calendar_fields", f"""WITH {SD} SELECT location, date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
  CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(dayofyear(date) AS INTEGER) AS day_of_year, CAST(weekofyear(date) AS INTEGER) AS week_of_year FROM sd""",
       dates=("date",))
def c05(spark, d):
    return ad.daily(spark, d).select("location", "date").withColumns(cal.calendar_fields())


_ANG = {"month": ("month(date)", 12), "dow": ("isodow(date) - 1", 7), "doy": ("dayofyear(date)", 365), "woy": ("weekofyear(date)", 52)}


@query("c06_cyclic_fields", f"WITH {SD} SELECT location, date, " + ", ".join(
    f"round({f}(2 * pi() * ({e}) / {p}) + 1e-9, 6) AS {n}_{f}" for n, (e, p) in _ANG.items() for f in ("sin", "cos")) + " FROM sd", dates=("date",))
def c06(spark, d):
    t = cal.time_features(ad.daily(spark, d).select("location", "date"))
    cols = [f"{n}_{f}" for n in _ANG for f in ("sin", "cos")]
    return r6(t.select("location", "date", *cols), *cols)


@query("c06_cyclic_fields_leap", f"WITH {SD} SELECT location, date, round(sin(2 * pi() * dayofyear(date) / 366) + 1e-9, 6) AS doy_sin FROM sd", dates=("date",))
def c06_leap(spark, d):
    t = cal.time_features(ad.daily(spark, d).select("location", "date"), year_days=366)
    return r6(t.select("location", "date", "doy_sin"), "doy_sin")


@query("c07_season_fields", f"""WITH {SD} SELECT location, date, CAST((month(date) % 12) // 3 AS INTEGER) AS season,
  round(0.5 * sin(2 * pi() * dayofyear(date) / 365) + 0.5 * cos(2 * pi() * dayofyear(date) / 365) + 1e-9, 6) AS season_intensity,
  CAST(month(date) IN (10, 11, 12, 1) AS INTEGER) AS is_peak_rain_season FROM sd""", dates=("date",))
def c07(spark, d):
    t = cal.time_features(ad.daily(spark, d).select("location", "date"))
    return r6(t.select("location", "date", "season", "season_intensity", "is_peak_rain_season"), "season_intensity")


@query("c08_time_sigmoid", f"""WITH {SD}, b AS (SELECT min(date) AS a, max(date) AS z FROM sd)
SELECT location, date, round(1 / (1 + exp(-10 * (CAST(date - a AS DOUBLE) / (z - a) - 0.5))) + 1e-9, 6) AS time_sigmoid FROM sd, b""", dates=("date",))
def c08(spark, d):
    return r6(cal.add_time_sigmoid(ad.mart(spark, d).select("location", "date")), "time_sigmoid")


@query("c09_floor_day", f"""WITH {READINGS} SELECT timestamp, CAST(timestamp + INTERVAL 30 MINUTE AS DATE) AS cut_2330,
  CAST(timestamp + INTERVAL 8 HOUR AS DATE) AS cut_1600 FROM readings""", dates=("cut_2330", "cut_1600"), stamps=("timestamp",))
def c09(spark, d):
    t = F.col("timestamp")
    return ad.readings(spark, d).select("timestamp", cal.floor_day(t, 23, 30).alias("cut_2330"), cal.floor_day(t, 16, 0).alias("cut_1600"))


@query("c10_window_days", f"""WITH {SD} SELECT location, year, min(date) AS t0, max(date) AS t1, max(date) - min(date) + 1 AS n_days,
  (month(min(date)) = 1 AND day(min(date)) = 1) AS at_start, (month(max(date)) = 12 AND day(max(date)) = 31) AS at_end FROM sd GROUP BY 1, 2""",
       dates=("t0", "t1"))
def c10(spark, d):
    g = ad.daily(spark, d).groupBy("location", "year").agg(F.min("date").alias("t0"), F.max("date").alias("t1"))
    return g.withColumns({"n_days": cal.window_days(F.col("t0"), F.col("t1")), "at_start": cal.is_year_start(F.col("t0")),
                          "at_end": cal.is_year_end(F.col("t1"))})


# ---- windows ----------------------------------------------------------------

PW = "PARTITION BY location ORDER BY date"


@query("w01_lag_features", f"WITH {SD} SELECT location, date, " + ", ".join(
    f"coalesce(lag({c}, 1) OVER ({PW}), {c}) AS {c}_lag1" for c in win.LAG_COLUMNS) + " FROM sd", dates=("date",))
def w01(spark, d):
    out = win.lag_features(ad.weather(spark, d))
    return out.select("location", "date", *[f"{c}_lag1" for c in win.LAG_COLUMNS])


@query("w01_lag_features_frame", f"WITH {SD} SELECT location, date, " + ", ".join(
    f"coalesce(lag({c}, 1) OVER (ORDER BY date, location), {c}) AS {c}_lag1" for c in win.LAG_COLUMNS) + " FROM sd", dates=("date",))
def w01_frame(spark, d):
    out = win.lag_features(ad.weather(spark, d), scope="frame", chunk=2000)
    return out.select("location", "date", *[f"{c}_lag1" for c in win.LAG_COLUMNS])


def _rolling_sql(over: str) -> str:
    return f"""WITH {SD} SELECT location, date,
  round(avg(mean_temperature_c) OVER ({over} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) + 1e-9, 6) AS mean_temp_roll_7d,
  max(highest_60_min_rainfall_mm) OVER ({over} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS max_rain_roll_3d,
  round(avg(mean_wind_speed_kmh) OVER ({over} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) + 1e-9, 6) AS mean_wind_roll_7d FROM sd"""


ROLLED = ("mean_temp_roll_7d", "max_rain_roll_3d", "mean_wind_roll_7d")


@query("w02_rolling_stats", _rolling_sql(PW), dates=("date",))
def w02(spark, d):
    return r6(win.rolling_stats(ad.weather(spark, d)).select("location", "date", *ROLLED), ROLLED[0], ROLLED[2])


@query("w02_rolling_stats_frame", _rolling_sql("ORDER BY date, location"), dates=("date",))
def w02_frame(spark, d):
    out = win.rolling_stats(ad.weather(spark, d), scope="frame", chunk=2000)
    return r6(out.select("location", "date", *ROLLED), ROLLED[0], ROLLED[2])


SPECS = [("mean_temperature_c", [1, 7]), (ad.TARGET, [1, 3, 7])]
_LAGROLL = ", ".join(
    f"lag({c}, {k}) OVER ({PW}) AS {c}_lag_{k}, round(avg({c}) OVER ({PW} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) + 1e-9, 6) AS {c}_roll_mean_{k}, "
    f"max({c}) OVER ({PW} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS {c}_roll_max_{k}" for c, ks in SPECS for k in ks)


@query("w03_lag_rolling", f"WITH {SD} SELECT location, date, {_LAGROLL} FROM sd", dates=("date",))
def w03(spark, d):
    x = ad.weather(spark, d).select("location", "date", *[c for c, _ in SPECS])
    out = win.lag_rolling(x, SPECS, funcs=("mean", "max")).drop(*[c for c, _ in SPECS])
    return r6(out, *[c for c in out.columns if "roll_mean" in c])


@query("w03_lag_rolling_bleed", f"""WITH {SD},
s AS (SELECT location, date, lag(mean_temperature_c) OVER ({PW}) AS p FROM sd)
SELECT location, date, round(CASE WHEN count(p) OVER w >= 2 THEN avg(p) OVER w END + 1e-9, 6) AS mean_temperature_c_roll_mean_5 FROM s
WINDOW w AS (ORDER BY location, date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""", dates=("date",))
def w03_bleed(spark, d):
    x = ad.weather(spark, d).select("location", "date", "mean_temperature_c")
    out = win.lag_rolling(x, [("mean_temperature_c", [5])], min_periods=2, bleed=True, chunk=2000)
    return r6(out.select("location", "date", "mean_temperature_c_roll_mean_5"), "mean_temperature_c_roll_mean_5")


@query("w03_calendar_lag", f"""WITH {SD} SELECT a.location, a.date, b.daily_rainfall_total_mm AS daily_rainfall_total_mm_day_lag_3
FROM sd a LEFT JOIN sd b ON a.location = b.location AND a.date = b.date + 3""", dates=("date",))
def w03_calendar(spark, d):
    x = land(ad.weather(spark, d), "weather").select("location", "date", ad.TARGET)
    return win.calendar_lag(x, ad.TARGET, 3).drop(ad.TARGET)


@query("w04_delta_days", f"WITH {SD} SELECT location, date, CAST(date - lag(date) OVER ({PW}) AS DOUBLE) AS delta_days FROM sd", dates=("date",))
def w04(spark, d):
    x = ad.weather(spark, d).select("location", "date", ad.TARGET)
    out = win.lag_rolling(x, [(ad.TARGET, [1])], keep_delta=True)
    return out.select("location", "date", F.col("delta_days").cast("double").alias("delta_days"))


@query("w05_target_lag_difference", f"""WITH {SD} SELECT location, date, lag(daily_rainfall_total_mm, 7) OVER ({PW})
  - lag(daily_rainfall_total_mm, 1) OVER ({PW}) AS target_lag_7_minus_1 FROM sd""", dates=("date",))
def w05(spark, d):
    x = ad.weather(spark, d).select("location", "date", ad.TARGET)
    out = win.lag_rolling(x, [(ad.TARGET, [1, 7])], target=ad.TARGET)
    return out.select("location", "date", "target_lag_7_minus_1")


def monthly_indices(spark, d):
    return [ad.monthly_index(spark, d, n) for n in IX]


SPINE = INDICES + ",\n" + ",\n".join(
    f"{n.lower()}_d AS (SELECT CAST(unnest(generate_series(date, last_day(date), INTERVAL 1 DAY)) AS DATE) AS date, {n} FROM {n.lower()})"
    for n in IX) + """,
dates AS (SELECT date FROM aqi_d UNION SELECT date FROM dmi_d UNION SELECT date FROM oni_d UNION SELECT date FROM rh_d),
folded AS (SELECT dates.date, AQI, DMI, ONI, RH FROM dates LEFT JOIN aqi_d USING (date) LEFT JOIN dmi_d USING (date)
           LEFT JOIN oni_d USING (date) LEFT JOIN rh_d USING (date))"""
FILLED_IX = SPINE + """,
ext AS (SELECT date, """ + ", ".join(
    f"coalesce(first_value(nullif({n}, -9999) IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), "
    f"last_value(nullif({n}, -9999) IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS {n}"
    for n in IX) + " FROM folded)"


def folded(spark, d):
    return jn.fold_on_spine([sp.align_to_daily(t) for t in monthly_indices(spark, d)])


def external(spark, d):
    """Daily climate indices, filled backward then forward."""
    from skygauge.operators.cleaning import sentinel_to_null

    return win.fill_ordered(sentinel_to_null(folded(spark, d), IX), IX)


@query("j06_fold_on_spine", f"WITH {SPINE} SELECT * FROM folded", dates=("date",))
def j06(spark, d):
    return folded(spark, d)


@query("w06_index_lags", f"WITH {FILLED_IX} SELECT date, ONI, " + ", ".join(
    [f"lag(ONI, {k}) OVER (ORDER BY date) AS ONI_lag_{k}" for k in (1, 2, 3, 6)] +
    [f"round(avg(ONI) OVER (ORDER BY date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) + 1e-9, 6) AS ONI_rolling_mean_{k}" for k in (3, 6, 12)])
    + " FROM ext", dates=("date",))
def w06(spark, d):
    out = win.index_lags(external(spark, d).select("date", "ONI"), ["ONI"])
    return r6(out, *[c for c in out.columns if "rolling" in c])


@query("w07_fill_backward_forward", f"WITH {FILLED_IX} SELECT * FROM ext", dates=("date",))
def w07(spark, d):
    return external(spark, d)


@query("w08_fill_forward", f"""WITH {INDICES} SELECT date, last_value(nullif(ONI, -9999) IGNORE NULLS)
  OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ONI FROM oni""", dates=("date",))
def w08(spark, d):
    from skygauge.operators.cleaning import sentinel_to_null

    return win.fill_ordered(sentinel_to_null(ad.monthly_index(spark, d, "ONI"), ["ONI"]), ["ONI"], causal=True)


@query("w11_last_rows", f"""WITH {SD} SELECT location, date, extracted_mm FROM sd
QUALIFY row_number() OVER (PARTITION BY location ORDER BY date DESC) <= 91""", dates=("date",))
def w11(spark, d):
    return win.last_rows(ad.daily(spark, d).select("location", "date", "extracted_mm"), 91)


@query("w12_partition_statistics", f"""WITH {SD} SELECT location, date, extracted_mm,
  quantile_disc(extracted_mm, 0.9) OVER (PARTITION BY location) AS p90 FROM sd""", dates=("date",))
def w12(spark, d):
    x = ad.mart(spark, d).select("location", "date", "extracted_mm")
    return m.with_group_threshold(x, ["location"], "extracted_mm")


@query("w13_gap_audit", f"""WITH {SD},
g AS (SELECT location, date, lag(date) OVER ({PW}) AS prev FROM sd),
h AS (SELECT *, date - prev AS gap, count(*) FILTER (WHERE date - prev >= 2) OVER ({PW}) AS nth FROM g)
SELECT location, count(*) FILTER (WHERE gap >= 2) AS num_gaps, coalesce(max(gap) FILTER (WHERE gap >= 2), 0) AS max_gap_days,
  coalesce(string_agg(prev || ' → ' || date || ' (' || gap || ' days)', '; ' ORDER BY date) FILTER (WHERE gap >= 2 AND nth <= 5), '') AS examples
FROM h GROUP BY 1""")
def w13(spark, d):
    return win.audit_gaps(ad.daily(spark, d)).withColumn("examples", F.array_join("examples", "; "))


@query("w14_null_runs", f"""WITH {FILLED},
n AS (SELECT *, row_number() OVER ({PW}) AS i FROM filled),
k AS (SELECT *, i - row_number() OVER ({PW}) AS run FROM n WHERE extracted_mm IS NULL)
SELECT location, min(date) AS start, max(date) AS "end", count(*) AS length FROM k GROUP BY location, run""", dates=("start", '"end"'))
def w14(spark, d):
    f = sp.fill_missing_dates(ad.mart(spark, d).select("location", "date", "extracted_mm"), ["location"])
    return win.null_runs(f, "extracted_mm", "date", ["location"])


# ---- joins ------------------------------------------------------------------

_J1 = {"inner": "JOIN", "left": "LEFT JOIN", "outer": "FULL JOIN", "right": "RIGHT JOIN"}


def _sides(spark, d):
    x = ad.mart(spark, d)
    day = F.dayofmonth("date")
    return (x.filter(day % 3 != 0).select("location", "date", "extracted_mm"),
            x.filter(day % 4 != 0).select("location", "date", "observed_mm"))


for _how, _kw in _J1.items():
    def _j01(spark, d, how=_how):
        return jn.merge(*_sides(spark, d), ["location", "date"], how)

    query(f"j01_merge_{_how}", f"""WITH {SD}, l AS (SELECT location, date, extracted_mm FROM sd WHERE day(date) % 3 <> 0),
r AS (SELECT location, date, observed_mm FROM sd WHERE day(date) % 4 <> 0)
SELECT location, date, extracted_mm, observed_mm FROM l {_kw} r USING (location, date)""", dates=("date",))(_j01)


@query("j02_features_with_target", f"""WITH {SD}, f AS (SELECT location, date, mean_temperature_c FROM sd WHERE day(date) % 6 <> 0),
t AS (SELECT location, date, daily_rainfall_total_mm FROM sd WHERE day(date) % 8 <> 0)
SELECT location, date, mean_temperature_c, daily_rainfall_total_mm FROM f FULL JOIN t USING (location, date)""", dates=("date",))
def j02(spark, d):
    w, day = land(ad.weather(spark, d), "weather"), F.dayofmonth("date")
    return jn.merge(w.filter(day % 6 != 0).select("location", "date", "mean_temperature_c"),
                    w.filter(day % 8 != 0).select("location", "date", ad.TARGET), ["location", "date"], "outer")


@query("j03_add_external", f"WITH {SD}, {FILLED_IX} SELECT location, date, extracted_mm, AQI, DMI, ONI, RH FROM sd LEFT JOIN ext USING (date)", dates=("date",))
def j03(spark, d):
    return jn.add_external(ad.daily(spark, d).select("location", "date", "extracted_mm"), external(spark, d))


@query("j04_daily_mart", f"""WITH {SD} SELECT replace(location, '_', ' ') AS location, date, year, daily_rainfall_total_mm AS extracted_mm, cv_predicted_mm, obs_predicted_mm,
  observed_mm FROM sd WHERE observed_mm IS NOT NULL""", dates=("date",))
def j04(spark, d):
    s = land(ad.station_days(spark, d), "station_days")
    observed = s.select(unslug(F.col("location")).alias("location"), "date", F.col("observed_mm").alias(ad.TARGET))
    return marts.build_daily_mart(s, observed, ad.FEATURES)


@query("j05_semi_join_locations", f"""WITH {SD} SELECT location, date, observed_mm FROM sd
WHERE location IN (SELECT location FROM sd WHERE extracted_mm > 60)""", dates=("date",))
def j05(spark, d):
    x = ad.mart(spark, d)
    return x.select("location", "date", "observed_mm").join(x.filter("extracted_mm > 60").select("location"), "location", "left_semi")


@query("j07_month_key_join", f"""WITH {SD}, {INDICES}, chain AS (SELECT date AS month, AQI, DMI, ONI, RH FROM aqi RIGHT JOIN dmi USING (date)
  RIGHT JOIN oni USING (date) RIGHT JOIN rh USING (date))
SELECT location, date, AQI, DMI, ONI, RH FROM sd LEFT JOIN chain ON date_trunc('month', date) = month""", dates=("date",))
def j07(spark, d):
    chain = jn.right_chain(monthly_indices(spark, d), "date").withColumnRenamed("date", "month")
    x = ad.daily(spark, d).select("location", "date", F.trunc("date", "MM").alias("month"))
    return jn.merge(x, chain, "month", "left", drop=True)


@query("j08_nearest_gauge", f"""WITH {STATIONS}, {GAUGES},
g AS (SELECT latitude, longitude, min(gauge_id) AS gauge_id FROM gauges GROUP BY 1, 2),
x AS (SELECT station_code, gauge_id, round(2 * 6371 * asin(sqrt(
   sin((radians(g.latitude) - radians(s.latitude)) / 2) ** 2 + cos(radians(s.latitude)) * cos(radians(g.latitude))
   * sin((radians(g.longitude) - radians(s.longitude)) / 2) ** 2)) + 1e-9, 9) AS km FROM stations s, g)
SELECT station_code, gauge_id, round(km + 1e-9, 6) AS distance_km FROM x
QUALIFY row_number() OVER (PARTITION BY station_code ORDER BY km, gauge_id) = 1""")
def j08(spark, d):
    return r6(jn.nearest_point(ad.stations(spark, d), ad.gauges(spark, d), "station_code", "gauge_id", cell_deg=0.02), "distance_km")


@query("j09_totals_with_gauge", f"""WITH {READINGS}, t AS (SELECT station_id, CAST(timestamp AS DATE) AS date, round(sum(rainfall_mm) + 1e-9, 4) AS mm
  FROM readings GROUP BY 1, 2), g AS (SELECT DISTINCT event_type AS station_id, length(event_type) * 1.0::DOUBLE AS latitude FROM events WHERE event_type <> 'view')
SELECT station_id, date, mm, latitude FROM t LEFT JOIN g USING (station_id)""", dates=("date",))
def j09(spark, d):
    r = ad.readings(spark, d)
    meta = r.filter("station_id <> 'view'").select("station_id").distinct().select(
        "station_id", F.struct((F.length("station_id") * 1.0).cast("double").alias("latitude")).alias("location"))
    t = feeds.daily_totals(r).join(meta, "station_id", "left")
    return t.select("station_id", "date", shown("daily_rainfall_total_mm", 4).alias("mm"), "location.latitude")


@query("j10_scalar_threshold", f"""WITH {SD}, t AS (SELECT quantile_cont(extracted_mm, 0.9) AS p90 FROM sd)
SELECT location, date, extracted_mm FROM sd, t WHERE extracted_mm >= p90""", dates=("date",))
def j10(spark, d):
    from skygauge.operators.ordering import global_quantiles

    x = ad.daily(spark, d).select("location", "date", "extracted_mm")
    return x.filter(F.col("extracted_mm") >= global_quantiles(x, "extracted_mm", [0.9], ["p90"]).scalar())


EDGES = """ring AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS place, count(*) OVER () AS size FROM nation),
edges AS (SELECT a.n_name AS location, b.n_name AS neighbor FROM ring a JOIN ring b ON b.place IN ((a.place + 1) % a.size, (a.place + 7) % a.size))"""


def ring_edges(spark, d):
    """Each station's two neighbours on the ring of nations, in the order of their keys."""
    n = cut_lineage(with_ordinal(ad.table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"], "place"))
    size = n.count()
    steps = n.select(F.col("n_name").alias("location"), F.explode(F.array((F.col("place") + 1) % size, (F.col("place") + 7) % size)).alias("place"))
    return steps.join(n.select("place", F.col("n_name").alias("neighbor")), "place").select("location", "neighbor")


def _nbr(k):
    return f"""n{k} AS (SELECT sd.location, sd.date, CASE WHEN count(*) = count(v.highest_30_min_rainfall_mm) THEN avg(v.highest_30_min_rainfall_mm) END AS mean,
  CASE WHEN count(*) = count(v.highest_30_min_rainfall_mm) THEN max(v.highest_30_min_rainfall_mm) END AS mx
  FROM sd JOIN edges USING (location) JOIN sd v ON v.location = neighbor AND v.date = sd.date - {k} GROUP BY 1, 2)"""


@query("j11_neighbor_rain", f"""WITH {SD}, {EDGES}, {_nbr(0)}, {_nbr(1)}
SELECT sd.location, sd.date, round(n0.mean + 1e-9, 6) AS neighbor_highest_30_min_rainfall_mm_mean_lag0, n0.mx AS neighbor_highest_30_min_rainfall_mm_max_lag0,
  round(n1.mean + 1e-9, 6) AS neighbor_highest_30_min_rainfall_mm_mean_lag1, n1.mx AS neighbor_highest_30_min_rainfall_mm_max_lag1
FROM sd LEFT JOIN n0 USING (location, date) LEFT JOIN n1 USING (location, date)""", dates=("date",))
def j11(spark, d):
    x = land(ad.weather(spark, d), "weather").select("location", "date", ad.RAIN[0])
    out = jn.neighbor_stats(x, ring_edges(spark, d), ad.RAIN[0]).drop(ad.RAIN[0])
    return r6(out, *[c for c in out.columns if "mean" in c])


@query("w10_neighbor_target_lags", f"""WITH {SD}, {EDGES},
axis AS (SELECT date, row_number() OVER (ORDER BY date) AS r FROM (SELECT DISTINCT date FROM sd) AS dd),
means AS (SELECT edges.location, r, avg(daily_rainfall_total_mm) AS v FROM edges JOIN sd ON sd.location = neighbor JOIN axis USING (date) GROUP BY 1, 2)
SELECT sd.location, sd.date, round(a.v + 1e-9, 6) AS nbr_target_mean_lag1, round(b.v + 1e-9, 6) AS nbr_target_mean_lag7
FROM sd JOIN axis USING (date) LEFT JOIN means a ON a.location = sd.location AND a.r = axis.r - 1
LEFT JOIN means b ON b.location = sd.location AND b.r = axis.r - 7""", dates=("date",))
def w10(spark, d):
    x = land(ad.weather(spark, d), "weather").select("location", "date", ad.TARGET)
    out = jn.neighbor_target_lags(x, ring_edges(spark, d), ad.TARGET, [1, 7]).drop(ad.TARGET)
    return r6(out, "nbr_target_mean_lag1", "nbr_target_mean_lag7")


IDS = f"""WITH {SD}, a AS (SELECT location || date AS k, location || '_' || strftime(date, '%Y_%m_%d') AS id FROM sd WHERE day(date) % 9 <> 0),
b AS (SELECT location || date AS k, CASE WHEN day(date) % 7 = 0 THEN location || '_' || year ELSE location || '_' || strftime(date, '%Y_%m_%d') END AS id
      FROM sd WHERE day(date) % 8 <> 0)"""


@query("j14_compare_ids", IDS + " SELECT k, a.id AS left_id, b.id AS right_id FROM a FULL JOIN b USING (k) WHERE a.id IS DISTINCT FROM b.id")
def j14(spark, d):
    x, day = ad.mart(spark, d), F.dayofmonth("date")
    full = F.concat_ws("_", "location", F.date_format("date", "yyyy_MM_dd"))
    k = F.concat("location", F.col("date").cast("string")).alias("k")
    a = x.filter(day % 9 != 0).select(k, full.alias("id"))
    b = x.filter(day % 8 != 0).select(k, F.when(day % 7 == 0, F.concat_ws("_", "location", "year")).otherwise(full).alias("id"))
    return jn.compare_ids(a, b, "k", "id")


@query("j15_rank_aligned", f"""WITH {SD}, a AS (SELECT location, date AS d1, row_number() OVER ({PW}) AS i FROM sd WHERE day(date) % 2 = 0),
b AS (SELECT location, date AS d2, row_number() OVER ({PW}) AS j FROM sd WHERE day(date) % 2 = 1)
SELECT a.location, d1, d2 FROM a JOIN b ON a.location = b.location AND b.j = a.i + 3""", dates=("d1", "d2"))
def j15(spark, d):
    x = ad.mart(spark, d)
    a = x.filter(F.dayofmonth("date") % 2 == 0).select("location", F.col("date").alias("d1"))
    b = x.filter(F.dayofmonth("date") % 2 == 1).select("location", F.col("date").alias("d2"))
    return jn.rank_aligned(a, "d1", b, "d2", "location", F.lit(3))


# ---- correlations -----------------------------------------------------------

CORR = SD + """,
c AS (SELECT x.location AS a, y.location AS b, count(*) AS n, corr(x.daily_rainfall_total_mm, y.daily_rainfall_total_mm) AS r
      FROM sd x JOIN sd y USING (date) WHERE x.daily_rainfall_total_mm IS NOT NULL AND y.daily_rainfall_total_mm IS NOT NULL GROUP BY 1, 2)"""


@query("a19_location_correlation", f"WITH {CORR} SELECT a, b, n, CASE WHEN isnan(r) THEN NULL ELSE round(r + 1e-9, 6) END AS corr FROM c")
def a19(spark, d):
    return r6(co.correlation_matrix(target_days(spark, d), "date", "location", ad.TARGET), "corr")


@query("t04_top_neighbors", f"""WITH {CORR} SELECT a AS location, b AS neighbor, row_number() OVER (PARTITION BY a ORDER BY r DESC, b) AS rank, round(r + 1e-9, 6) AS corr
FROM c WHERE a <> b AND NOT isnan(r) AND r > 0.01 QUALIFY rank <= 3""")
def t04(spark, d):
    corr = co.correlation_matrix(target_days(spark, d), "date", "location", ad.TARGET)
    return r6(co.neighbors_from_corr(corr, k=3, min_corr=0.01), "corr")


@query("a20_wet_day_correlation", f"""WITH {CALENDAR}, w AS (SELECT location, year, doy, CASE WHEN daily_rainfall_total_mm > 0 THEN 1 ELSE 0 END AS wet FROM cal)
SELECT x.location, x.year AS a, y.year AS b, count(*) AS n, CASE WHEN isnan(corr(x.wet, y.wet)) THEN NULL ELSE round(corr(x.wet, y.wet) + 1e-9, 6) END AS corr
FROM w x JOIN w y ON x.location = y.location AND x.doy = y.doy GROUP BY 1, 2, 3""")
def a20(spark, d):
    full = sp.full_calendar_years(target_days(spark, d), ["location"])
    wet = full.withColumn("is_wet", F.coalesce(F.col(ad.TARGET) > 0, F.lit(False)).cast("double"))
    return r6(co.correlation_matrix(wet, "doy", "year", "is_wet", key="location"), "corr")


@query("a21_extreme_persistence", f"""WITH {SD}, t AS (SELECT location, quantile_cont(daily_rainfall_total_mm, 0.95) AS thr FROM sd GROUP BY 1),
y AS (SELECT location, year, count(*) AS n, max(daily_rainfall_total_mm) AS mx FROM sd JOIN t USING (location) WHERE daily_rainfall_total_mm >= thr GROUP BY 1, 2),
l AS (SELECT *, lag(n) OVER (PARTITION BY location ORDER BY year) AS n0, lag(mx) OVER (PARTITION BY location ORDER BY year) AS mx0 FROM y)
SELECT location, CASE WHEN isnan(corr(n, n0)) THEN NULL ELSE round(corr(n, n0) + 1e-9, 6) END AS extreme_count_corr,
  CASE WHEN isnan(corr(mx, mx0)) THEN NULL ELSE round(corr(mx, mx0) + 1e-9, 6) END AS extreme_max_corr, count(*) AS n_years
FROM l GROUP BY 1 HAVING count(*) >= 2""")
def a21(spark, d):
    return r6(co.extreme_year_persistence(land(target_days(spark, d), "target_days"), ad.TARGET), "extreme_count_corr", "extreme_max_corr")
