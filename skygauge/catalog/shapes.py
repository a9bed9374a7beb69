"""SQL text of the derived station tables, for use in WITH lists of oracle queries."""

SD = """base AS (
  SELECT n_name AS location, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS q,
         sum(l_quantity * (1 - l_discount)) AS cv, sum(l_quantity * (1 + l_tax)) AS ob,
         CAST(count(*) - 1 AS DOUBLE) AS wind, CAST(max(l_linenumber) AS DOUBLE) AS gust,
         min(l_quantity) AS h30, avg(l_quantity) AS h60, max(l_quantity) AS h120
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY 1, 2),
sd AS (
  SELECT location, date, CAST(year(date) AS INTEGER) AS year, q,
    greatest(q - 20, 0) AS extracted_mm, round(cv, 4) AS cv_predicted_mm, round(ob, 4) AS obs_predicted_mm,
    CASE WHEN day(date) % 10 <> 0 THEN greatest(q - 18, 0) END AS observed_mm,
    CASE WHEN day(date) % 7 <> 0 THEN h30 END AS highest_30_min_rainfall_mm,
    CASE WHEN day(date) % 7 <> 0 THEN round(h60, 4) END AS highest_60_min_rainfall_mm,
    CASE WHEN day(date) % 7 <> 0 THEN h120 END AS highest_120_min_rainfall_mm,
    20 + q % 10 AS mean_temperature_c, 20 + q % 10 + 1 + q % 4 AS maximum_temperature_c,
    20 + q % 10 - 1 - q % 3 AS minimum_temperature_c,
    CASE WHEN day(date) <> 13 THEN wind END AS mean_wind_speed_kmh, gust AS max_wind_speed_kmh,
    CASE WHEN day(date) <> 20 THEN greatest(q - 20, 0) END AS daily_rainfall_total_mm
  FROM base)"""

# Weeks end on Sunday; empty weeks between the first and last label of a (location, year) stay as null rows.
WEEKLY = SD + """,
labelled AS (SELECT *, CAST(date + CAST((7 - isodow(date)) AS INTEGER) AS DATE) AS week FROM sd),
wk AS (SELECT location, year, week, avg(extracted_mm) AS e, avg(cv_predicted_mm) AS c,
              avg(obs_predicted_mm) AS o, avg(observed_mm) AS ob FROM labelled GROUP BY ALL),
spine AS (SELECT location, year, CAST(unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS DATE) AS date
          FROM labelled GROUP BY location, year),
weekly AS (SELECT s.location, s.year, s.date, e AS extracted_mm, c AS cv_predicted_mm, o AS obs_predicted_mm, ob AS observed_mm
           FROM spine s LEFT JOIN wk ON s.location = wk.location AND s.year = wk.year AND s.date = wk.week)"""

READINGS = """readings AS (SELECT event_type AS station_id, ts AS timestamp, value AS rainfall_mm FROM events)"""

CELLS = READINGS + """,
cells AS (SELECT station_id, time_bucket(INTERVAL '15 minutes', timestamp) AS time,
                 round(sum(rainfall_mm), 4) AS rain_15min_mm FROM readings GROUP BY ALL)"""

STATIONS = """stations AS (SELECT n_nationkey AS station_code, n_name AS station_name,
  1.2 + n_nationkey * 0.01::DOUBLE AS latitude, 103.6 + n_regionkey * 0.05::DOUBLE AS longitude FROM nation)"""

GAUGES = """gauges AS (SELECT s_suppkey AS gauge_id,
  1.2::DOUBLE + s_nationkey * 0.01::DOUBLE + s_suppkey % 7 * 0.003::DOUBLE AS latitude,
  103.6::DOUBLE + s_suppkey % 5 * 0.05::DOUBLE + s_suppkey % 11 * 0.002::DOUBLE AS longitude FROM supplier)"""


def _index(name: str, what: str, missing: int, first: int) -> str:
    return f"""{name.lower()} AS (
  SELECT date, CASE WHEN (year(date) * 12 + month(date)) % 11 = {missing} THEN -9999.0::DOUBLE
                    ELSE round({what}, 3) END AS {name}
  FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
               CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS p
        FROM orders GROUP BY 1) AS months
  WHERE year(date) > 1995 OR month(date) >= {first})"""


INDICES = ",\n".join([
    _index("AQI", "p / 1000", 3, 1), _index("DMI", "p / 5000 - 20", 5, 4),
    _index("ONI", "p / 2500 - 30", 0, 1), _index("RH", "p % 100", 7, 8)])

PLOTS = SD + """,
plot_days AS (SELECT replace(location, ' ', '_') || '-' || year AS plot_id, date, year,
                     dayofyear(date) AS doy, extracted_mm FROM sd WHERE observed_mm IS NOT NULL),
dots AS (SELECT plot_id, CAST(floor(100 + doy * 27 / 10) AS INTEGER) AS x,
                CAST(600 - 4 * extracted_mm AS INTEGER) AS y FROM plot_days),
plots AS (SELECT plot_id, year, n_dots, n_days, 102 AS data_start,
                 CAST(floor(100 + n_days * 27 / 10) AS INTEGER) AS data_end
          FROM (SELECT plot_id, year, count(*) AS n_dots, dayofyear(make_date(year, 12, 31)) AS n_days
                FROM plot_days GROUP BY 1, 2) AS per_plot),
ticks AS (SELECT plot_id, CAST(floor(100 + dayofyear(d) * 27 / 10)
                               + CASE WHEN m % 3 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS x, d AS date,
                 strftime(d, '%Y-%m') AS label
          FROM (SELECT plot_id, m, make_date(year, m, 1) AS d
                FROM plots, (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS m) AS months) AS starts),
labels AS (SELECT plot_id, CAST(k * 20 AS DOUBLE) AS value, 60.0::DOUBLE AS x, 600.0::DOUBLE - 80 * k AS y
           FROM (SELECT plot_id, unnest(range(0, greatest(CAST(ceil(max(extracted_mm) / 20) AS BIGINT), 2) + 1)) AS k
                 FROM plot_days GROUP BY plot_id) AS steps)"""

CHARTS = PLOTS + """,
grid AS (
  SELECT plot_id, 'x' AS axis, CAST(floor(100 + dayofyear(make_date(year, m, 1)) * 27 / 10) AS INTEGER) AS pos
  FROM plots, (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS m) AS months
  UNION ALL SELECT plot_id, 'x', unnest([100, data_end, data_end + 6]) FROM plots
  UNION ALL SELECT plot_id, 'y', CAST(y + CAST(value / 20 AS INTEGER) % 2 AS INTEGER) FROM labels),
tokens AS (
  SELECT plot_id, CAST(CAST(value AS INTEGER) AS VARCHAR) AS text, 50.0::DOUBLE AS x, y - 5 AS y, 20.0::DOUBLE AS w, 10.0::DOUBLE AS h FROM labels
  UNION ALL SELECT plot_id, s.text, s.x, s.y, 20, 10 FROM (SELECT plot_id, unnest(CASE WHEN n_dots % 2 = 0
      THEN [{'text': '33', 'x': 50.0::DOUBLE, 'y': 295.0::DOUBLE}, {'text': 'mm', 'x': 50.0::DOUBLE, 'y': 100.0::DOUBLE}, {'text': '50', 'x': 400.0::DOUBLE, 'y': 300.0::DOUBLE}]
      ELSE [{'text': '7', 'x': 50.0::DOUBLE, 'y': 400.0::DOUBLE}, {'text': '1999-13', 'x': 50.0::DOUBLE, 'y': 650.0::DOUBLE}] END) AS s FROM plots) AS stray
  UNION ALL SELECT plot_id, label || ',', x - 15, 640, 30, 10 FROM ticks)"""

PIXELS = PLOTS + """,
centres AS (SELECT plot_id, 6 * doy - CASE WHEN doy % 5 = 0 THEN 3 ELSE 0 END AS cx, CAST(600 - 4 * extracted_mm AS INTEGER) AS cy FROM plot_days),
pixels AS (SELECT DISTINCT plot_id, cx + dx AS x, cy + dy AS y FROM centres, (SELECT unnest(range(-2, 3)) AS dx) AS a, (SELECT unnest(range(-2, 3)) AS dy) AS b)"""
