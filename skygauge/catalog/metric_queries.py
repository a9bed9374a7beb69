"""Dashboard metrics and series over the daily and weekly marts."""

from pyspark.sql import functions as F

from skygauge.catalog.registry import query, shown
from skygauge.catalog.shapes import SD, WEEKLY
from skygauge.functions import evaluation as ev
from skygauge.operators import metrics as m
from skygauge.operators import wide
from skygauge.plans import marts
from skygauge.sources.adapters import daily, mart

LY = ["location", "year"]


def r6(df, *cols):
    return df.withColumns({c: shown(c, 6) for c in cols})


def weekly(spark, d):
    return marts.build_weekly_mart(mart(spark, d))


def with_abs_error(df):
    return df.withColumn("abs_error", F.abs(F.col("observed_mm") - F.col("extracted_mm")))


@query("a01_global_errors", f"""WITH {SD}
SELECT round(avg(abs(e)) + 1e-9, 6) AS mae, round(avg(e * e) + 1e-9, 6) AS mse, round(sqrt(avg(e * e)) + 1e-9, 6) AS rmse
FROM (SELECT observed_mm - cv_predicted_mm AS e FROM sd WHERE observed_mm IS NOT NULL AND cv_predicted_mm IS NOT NULL) AS x""")
def a01(spark, d):
    return r6(m.global_errors(daily(spark, d)), "mae", "mse", "rmse")


@query("a02_r_squared", f"""WITH {SD}, ok AS (SELECT observed_mm AS o, cv_predicted_mm AS p FROM sd WHERE observed_mm IS NOT NULL)
SELECT round(1 - sum((o - p) ** 2) / sum((o - mean) ** 2) + 1e-9, 6) AS r2 FROM ok, (SELECT avg(o) AS mean FROM ok) AS mu""")
def a02(spark, d):
    return r6(m.r_squared(daily(spark, d)), "r2")


@query("a03_zero_rain_false_rate", f"""WITH {SD}
SELECT round(100.0::DOUBLE * count(*) FILTER (WHERE extracted_mm = 0 AND cv_predicted_mm > 5)
       / nullif(count(*) FILTER (WHERE extracted_mm = 0), 0) + 1e-9, 6) AS zero_rain_false_rate_pct FROM sd""")
def a03(spark, d):
    return r6(m.zero_rain_false_rate(daily(spark, d)), "zero_rain_false_rate_pct")


@query("a04_signed_error", f"WITH {SD} SELECT round(avg(observed_mm - cv_predicted_mm) + 1e-9, 6) AS mae FROM sd")
def a04(spark, d):
    return r6(m.signed_error(daily(spark, d)), "mae")


@query("a05_available_years", f"WITH {WEEKLY} SELECT DISTINCT year FROM weekly")
def a05_years(spark, d):
    return weekly(spark, d).select("year").distinct().orderBy("year")


@query("a05_available_locations", f"WITH {SD} SELECT DISTINCT location FROM sd")
def a05_locations(spark, d):
    return daily(spark, d).select("location").distinct().orderBy("location")


@query("a05_years_by_location",
       f"WITH {WEEKLY} SELECT DISTINCT location, strftime(date, '%Y') AS year FROM weekly")
def a05_by_location(spark, d):
    return weekly(spark, d).select("location", F.date_format("date", "yyyy").alias("year")).distinct()


@query("a06_row_count", f"WITH {SD} SELECT count(*) AS n FROM sd")
def a06(spark, d):
    return daily(spark, d).agg(F.count(F.lit(1)).alias("n"))


def _group_metrics_sql(keys: str) -> str:
    return f"""WITH {SD},
thr AS (SELECT {keys}, quantile_disc(extracted_mm, 0.9) AS p90 FROM sd GROUP BY {keys}),
j AS (SELECT sd.*, p90, cv_predicted_mm - extracted_mm AS e FROM sd JOIN thr USING ({keys}))
SELECT {keys}, round(avg(abs(e)) + 1e-9, 6) AS mae, round(sqrt(avg(e * e)) + 1e-9, 6) AS rmse, round(avg(e) + 1e-9, 6) AS bias,
  CASE WHEN isnan(corr(extracted_mm, cv_predicted_mm)) THEN NULL
       ELSE round(corr(extracted_mm, cv_predicted_mm) + 1e-9, 6) END AS corr,
  round(100.0::DOUBLE * count(*) FILTER (WHERE extracted_mm = 0 AND cv_predicted_mm > 5)
        / nullif(count(*) FILTER (WHERE extracted_mm = 0), 0) + 1e-9, 6) AS false_rain_rate,
  round(avg(abs(e)) FILTER (WHERE extracted_mm >= p90) + 1e-9, 6) AS extreme_mae
FROM j GROUP BY {keys}"""


METRICS = ("mae", "rmse", "bias", "corr", "false_rain_rate", "extreme_mae")


@query("a07_city_metrics", _group_metrics_sql("location"))
def a07(spark, d):
    return r6(m.group_metrics(mart(spark, d), ["location"]), *METRICS)


@query("a08_city_year_metrics", _group_metrics_sql("location, year"))
def a08(spark, d):
    return r6(m.group_metrics(mart(spark, d), LY), *METRICS)


@query("a09_baseline_comparison", f"""WITH {SD},
thr AS (SELECT location, year, quantile_disc(extracted_mm, 0.9) AS p90 FROM sd GROUP BY 1, 2),
j AS (SELECT location, year, extracted_mm >= p90 AS hot, abs(cv_predicted_mm - extracted_mm) AS own,
             abs(cv_predicted_mm - obs_predicted_mm) AS ref FROM sd JOIN thr USING (location, year)),
g AS (SELECT location, year, avg(own) AS a, avg(ref) AS b, avg(own) FILTER (WHERE hot) AS c,
             avg(ref) FILTER (WHERE hot) AS d FROM j GROUP BY 1, 2)
SELECT location, year, round(a + 1e-9, 6) AS year_mae, round(b + 1e-9, 6) AS baseline_mae,
  round(100 * (b - a) / nullif(b, 0) + 1e-9, 6) AS mae_improvement_pct, round(c + 1e-9, 6) AS year_extreme_mae,
  round(d + 1e-9, 6) AS baseline_extreme_mae, round(100 * (d - c) / nullif(d, 0) + 1e-9, 6) AS extreme_improvement_pct FROM g""")
def a09(spark, d):
    out = m.baseline_comparison(mart(spark, d), LY)
    return r6(out, *[c for c in out.columns if c not in LY])


@query("a10_extreme_day_errors", f"""WITH {SD},
thr AS (SELECT location, year, quantile_disc(extracted_mm, 0.9) AS p90 FROM sd GROUP BY 1, 2)
SELECT location, year, date, extracted_mm, round(abs(cv_predicted_mm - extracted_mm) + 1e-9, 6) AS abs_error
FROM sd JOIN thr USING (location, year) WHERE extracted_mm >= p90""", dates=("date",))
def a10(spark, d):
    return r6(m.extreme_day_errors(mart(spark, d), LY), "abs_error")


@query("a11_weekly_mart", f"WITH {WEEKLY} SELECT location, year, date, round(extracted_mm + 1e-9, 6) AS extracted_mm, round(cv_predicted_mm + 1e-9, 6) AS cv_predicted_mm, round(obs_predicted_mm + 1e-9, 6) AS obs_predicted_mm, round(observed_mm + 1e-9, 6) AS observed_mm FROM weekly", dates=("date",))
def a11(spark, d):
    return r6(weekly(spark, d), *marts.MART_VALUES)


@query("a26_error_histogram", f"""WITH {SD},
v AS (SELECT location, year, abs(observed_mm - extracted_mm) AS e FROM sd WHERE observed_mm IS NOT NULL),
g AS (SELECT location, year, greatest(CAST(ceil(max(e)) AS INTEGER), 1) AS bins FROM v GROUP BY 1, 2),
spine AS (SELECT location, year, CAST(unnest(range(0, bins)) AS INTEGER) AS bin FROM g),
c AS (SELECT location, year, least(CAST(floor(e) AS INTEGER), bins - 1) AS bin, count(*) AS n
      FROM v JOIN g USING (location, year) GROUP BY ALL)
SELECT location, year, bin, bin || '.0–' || (bin + 1) || '.0' AS label, coalesce(n, 0) AS n
FROM spine LEFT JOIN c USING (location, year, bin)""")
def a26(spark, d):
    return m.histogram(with_abs_error(mart(spark, d)), LY, "abs_error")


@query("a26_prediction_error_histogram", f"""WITH {SD},
v AS (SELECT location, abs(cv_predicted_mm - extracted_mm) AS e FROM sd),
g AS (SELECT location, greatest(CAST(ceil(max(e)) AS INTEGER), 1) AS bins FROM v GROUP BY 1),
spine AS (SELECT location, CAST(unnest(range(0, bins)) AS INTEGER) AS bin FROM g),
c AS (SELECT location, least(CAST(floor(e) AS INTEGER), bins - 1) AS bin, count(*) AS n
      FROM v JOIN g USING (location) GROUP BY ALL)
SELECT location, bin, bin || '.0–' || (bin + 1) || '.0' AS label, coalesce(n, 0) AS n
FROM spine LEFT JOIN c USING (location, bin)""")
def a26_location(spark, d):
    e = mart(spark, d).withColumn("abs_error", F.abs(F.col("cv_predicted_mm") - F.col("extracted_mm")))
    return m.histogram(e, ["location"], "abs_error")


@query("a27_axis_bounds", f"""WITH {SD}
SELECT location, year, CAST(ceil(max(greatest(extracted_mm, cv_predicted_mm)) / 10) * 10 AS DOUBLE) AS axis_max,
  CAST(coalesce(greatest(ceil(max(abs(observed_mm - extracted_mm)) / 5) * 5, 5), 5) AS DOUBLE) AS error_max
FROM sd GROUP BY 1, 2""")
def a27(spark, d):
    return m.axis_bounds(daily(spark, d), LY)


@query("a07_rollup_errors", f"""WITH {SD}, x AS (SELECT location, year, cv_predicted_mm - extracted_mm AS e FROM sd)
SELECT location, year, count(*) AS n, round(avg(abs(e)) + 1e-9, 6) AS mae, round(sqrt(avg(e * e)) + 1e-9, 6) AS rmse,
  round(avg(e) + 1e-9, 6) AS bias FROM x GROUP BY GROUPING SETS ((), (location), (location, year))""")
def a07_rollup(spark, d):
    return r6(m.rollup_errors(daily(spark, d)), "mae", "rmse", "bias")


# ---- series -----------------------------------------------------------------

SERIES = ("observed_mm", "extracted_mm", "cv_predicted_mm", "abs_error")
TS = """SELECT location, CAST(year(date) AS INTEGER) AS label_year, date, round(observed_mm + 1e-9, 6) AS observed_mm, round(extracted_mm + 1e-9, 6) AS extracted_mm, round(cv_predicted_mm + 1e-9, 6) AS cv_predicted_mm,
  round(abs(observed_mm - extracted_mm) + 1e-9, 6) AS abs_error"""


@query("t01_weekly_timeseries", f"WITH {WEEKLY} {TS} FROM weekly", dates=("date",))
def t01_weekly(spark, d):
    return r6(marts.timeseries(weekly(spark, d)), *SERIES).orderBy("location", "date")


@query("t01_daily_timeseries", f"WITH {SD} {TS} FROM sd", dates=("date",))
def t01_daily(spark, d):
    return r6(marts.timeseries(daily(spark, d)), *SERIES).orderBy("location", "date")


@query("t01_weekly_error_series", f"""WITH {WEEKLY} SELECT location, CAST(year(date) AS INTEGER) AS label_year, date,
  round(abs(cv_predicted_mm - extracted_mm) + 1e-9, 5) AS abs_error FROM weekly WHERE cv_predicted_mm IS NOT NULL""",
       dates=("date",))
def t01_error(spark, d):
    return marts.error_series(weekly(spark, d)).withColumn("abs_error", shown("abs_error", 5))


@query("t02_error_values", f"""WITH {SD} SELECT location, year AS label_year,
  round(abs(cv_predicted_mm - extracted_mm) + 1e-9, 6) AS abs_error FROM sd""")
def t02(spark, d):
    return r6(marts.error_series(daily(spark, d)).select("location", "label_year", "abs_error"), "abs_error")


@query("t03_top_squared_errors", f"""WITH {SD}
SELECT location, date, extracted_mm AS y, cv_predicted_mm AS pred, round((cv_predicted_mm - extracted_mm) ** 2 + 1e-9, 6) AS sq_err
FROM sd ORDER BY sq_err DESC, location, date LIMIT 20""", dates=("date",))
def t03(spark, d):
    e = F.col("cv_predicted_mm") - F.col("extracted_mm")
    return daily(spark, d).select(
        "location", "date", F.col("extracted_mm").alias("y"), F.col("cv_predicted_mm").alias("pred"),
        shown(e * e, 6).alias("sq_err")).orderBy(F.desc("sq_err"), "location", "date").limit(20)


@query("t05_daily_table", f"""WITH {SD} SELECT location, date, year, extracted_mm, cv_predicted_mm, obs_predicted_mm,
  observed_mm FROM sd""", dates=("date",))
def t05(spark, d):
    return daily(spark, d)


@query("t06_union_and_dates", f"""WITH {SD}
SELECT date, 'Extracted' AS type, count(*) AS n FROM sd GROUP BY 1 UNION ALL
SELECT date, 'Observed', count(*) FROM sd WHERE observed_mm IS NOT NULL GROUP BY 1""", dates=("date",))
def t06(spark, d):
    x = mart(spark, d)
    ext = x.select("date", F.lit("Extracted").alias("type"))
    obs = x.filter("observed_mm IS NOT NULL").select("date", F.lit("Observed").alias("type"))
    return ext.unionByName(obs).groupBy("date", "type").agg(F.count(F.lit(1)).alias("n"))


@query("t07_multi_key_sort", f"WITH {SD} SELECT location, date, extracted_mm FROM sd", dates=("date",))
def t07(spark, d):
    return daily(spark, d).select("location", "date", "extracted_mm").orderBy("location", F.desc("date"))


YEARS = range(1995, 2002)  # the years of the given tables


@query("t08_pivot_years", f"WITH {SD} SELECT location, " + ", ".join(f"round(avg(CASE WHEN year = {y} THEN extracted_mm END) + 1e-9, 6) AS y{y}" for y in YEARS) + " FROM sd GROUP BY 1")
def t08(spark, d):
    """Years come from the data: a year is a column as soon as it has rows."""
    named = daily(spark, d).withColumn("y", F.concat(F.lit("y"), F.col("year").cast("string")))
    return named.groupBy("location").pivot("y").agg(shown(F.avg("extracted_mm"), 6))


def _cells(digits: int):
    return F.array_join(F.transform("cells", lambda v: F.when(v.isNull(), "-").otherwise(F.format_string(f"%.{digits}f", v))), ",").alias("cells")


@query("t08_pivot_dates", f"""WITH {SD}, names AS (SELECT DISTINCT location FROM sd), days AS (SELECT DISTINCT date FROM sd)
SELECT date, string_agg(coalesce(printf('%.1f', extracted_mm), '-'), ',' ORDER BY location) AS cells
FROM days CROSS JOIN names LEFT JOIN sd USING (date, location) GROUP BY 1""", dates=("date",))
def t08_dates(spark, d):
    """Dates by stations: a station is a position, however many there are."""
    x = daily(spark, d)
    return wide.pivot_positions(x, "date", "location", F.sum("extracted_mm"), wide.column_dictionary(x, "location")).select("date", _cells(1))


QUANTILE_STEPS = (0.9, 0.95, 0.99, 0.995, 0.999, 1.0)


@query("t08_quantile_unstack", f"""WITH {SD} SELECT location, concat_ws(',', """ + ", ".join(f"printf('%.3f', quantile_cont(extracted_mm, {p}) + 1e-9)" for p in QUANTILE_STEPS) + """) AS cells
FROM sd GROUP BY 1""")
def t08_quantiles(spark, d):
    """Quantiles per station, long, then one position per probability."""
    q = daily(spark, d).groupBy("location").agg(F.expr(f"percentile(extracted_mm, array({', '.join(map(str, QUANTILE_STEPS))}))").alias("q"))
    long = q.select("location", F.posexplode("q").alias("step", "mm"))
    return wide.pivot_positions(long, "location", "step", F.sum(F.col("mm") + 1e-9), wide.column_dictionary(long, "step")).select("location", _cells(3))


def _shown(values):
    text = F.transform(values, lambda v: F.when(v.isNull(), "null").otherwise(F.format_string("%.2f", v)))
    return F.array_join(text, ",")


def _agg_text(col, date="date"):
    return f"string_agg(coalesce(printf('%.2f', {col}), 'null'), ',' ORDER BY {date})"


@query("t09_timeseries_payload", f"""WITH {SD}
SELECT location, year, string_agg(CAST(date AS VARCHAR), ',' ORDER BY date) AS dates, {_agg_text('observed_mm')} AS observed,
  {_agg_text('extracted_mm')} AS extracted, {_agg_text('cv_predicted_mm')} AS predicted FROM sd GROUP BY 1, 2""")
def t09(spark, d):
    p = marts.series_payload(daily(spark, d), LY, {
        "Observed": "observed_mm", "Extracted": "extracted_mm", "Predicted": "cv_predicted_mm", "Absent": "nothing"})
    return p.select("location", "year", F.array_join("dates", ",").alias("dates"),
                    _shown(F.col("series.Observed")).alias("observed"), _shown(F.col("series.Extracted")).alias("extracted"),
                    _shown(F.col("series.Predicted")).alias("predicted"))


@query("t09_error_payload", f"""WITH {SD}, e AS (SELECT location, year, date, round(abs(cv_predicted_mm - extracted_mm), 2) AS a FROM sd)
SELECT location, year, string_agg(CAST(date AS VARCHAR), ',' ORDER BY date) AS dates, {_agg_text('a')} AS abs_error
FROM e GROUP BY 1, 2""")
def t09_error(spark, d):
    e = daily(spark, d).withColumn("abs_error", F.round(F.abs(F.col("cv_predicted_mm") - F.col("extracted_mm")), 2))
    return marts.error_payload(e, LY).select(
        "location", "year", F.array_join("dates", ",").alias("dates"),
        _shown(F.col("series")["Absolute Error"]).alias("abs_error"))


@query("t09_long_payload", f"""WITH {SD},
l AS (SELECT location, year, date, 'Extracted' AS type, extracted_mm AS v FROM sd UNION ALL
      SELECT location, year, date, 'Observed', observed_mm FROM sd WHERE observed_mm IS NOT NULL),
g AS (SELECT location, year, date, type FROM (SELECT DISTINCT location, year, date FROM l) AS a
      JOIN (SELECT DISTINCT location, year, type FROM l) AS b USING (location, year)),
f AS (SELECT g.*, v FROM g LEFT JOIN l USING (location, year, date, type))
SELECT location, year, type, string_agg(CAST(date AS VARCHAR), ',' ORDER BY date) AS dates, {_agg_text('v')} AS shown
FROM f GROUP BY 1, 2, 3""")
def t09_long(spark, d):
    x = mart(spark, d)
    long = x.select(*LY, "date", F.lit("Extracted").alias("type"), F.col("extracted_mm").alias("rainfall")).unionByName(
        x.filter("observed_mm IS NOT NULL").select(*LY, "date", F.lit("Observed").alias("type"),
                                                   F.col("observed_mm").alias("rainfall")))
    p = marts.long_payload(long, LY)
    return p.select(*LY, "type", F.array_join("dates", ",").alias("dates"), _shown(F.col("values")).alias("shown"))


@query("t10_calibration_pairs", f"""WITH {SD} SELECT location, year AS label_year, date, extracted_mm AS x,
  cv_predicted_mm AS y FROM sd WHERE extracted_mm IS NOT NULL AND cv_predicted_mm IS NOT NULL""", dates=("date",))
def t10_pairs(spark, d):
    return marts.calibration_pairs(daily(spark, d))


@query("t10_weekly_bias", f"""WITH {WEEKLY} SELECT location, CAST(year(date) AS INTEGER) AS label_year, date,
  round(observed_mm - extracted_mm + 1e-9, 5) AS bias FROM weekly""", dates=("date",))
def t10_bias(spark, d):
    return marts.bias_series(weekly(spark, d)).withColumn("bias", shown("bias", 5))


@query("t10_extreme_days", f"""WITH {WEEKLY},
thr AS (SELECT location, year(date) AS label_year, quantile_cont(extracted_mm, 0.9) AS p90 FROM weekly GROUP BY 1, 2)
SELECT sd.location, year AS label_year, date, extracted_mm, abs(observed_mm - extracted_mm) AS abs_error, round(p90 + 1e-9, 5) AS p90
FROM sd JOIN thr ON sd.location = thr.location AND sd.year = thr.label_year WHERE extracted_mm >= p90""", dates=("date",))
def t10_extreme(spark, d):
    x = mart(spark, d)
    return marts.extreme_days_by_weekly_p90(x, marts.build_weekly_mart(x)).withColumn("p90", shown("p90", 5))


@query("t11_location_series", f"""WITH {SD} SELECT location, date, extracted_mm FROM sd
WHERE location = (SELECT min(location) FROM sd)""", dates=("date",))
def t11(spark, d):
    x = daily(spark, d)
    first = x.agg(F.min("location").alias("l")).first()["l"]
    return marts.one_location(x, first).select("location", "date", "extracted_mm")


@query("pf18_melt", f"""WITH {WEEKLY}
SELECT location, year, date, 'Observed' AS type, round(observed_mm + 1e-9, 6) AS rainfall FROM weekly WHERE observed_mm IS NOT NULL UNION ALL
SELECT location, year, date, 'Predicted', round(cv_predicted_mm + 1e-9, 6) FROM weekly WHERE cv_predicted_mm IS NOT NULL UNION ALL
SELECT location, year, date, 'Extracted', round(extracted_mm + 1e-9, 6) FROM weekly WHERE extracted_mm IS NOT NULL""", dates=("date",))
def pf18(spark, d):
    return r6(marts.melt(weekly(spark, d)), "rainfall")


# ---- classes and texts ------------------------------------------------------

def _case(texts: dict, key: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in texts.items())
    return f"CASE {key} {whens} END"


INTENSITY = """CASE WHEN cv_predicted_mm <= 1 THEN 'drizzle' WHEN cv_predicted_mm <= 10 THEN 'light'
  WHEN cv_predicted_mm <= 30 THEN 'moderate' ELSE 'heavy' END"""


@query("s08_rain_intensity", f"""WITH {SD}, k AS (SELECT location, date, {INTENSITY} AS intensity FROM sd)
SELECT *, {_case(ev.INTENSITY_LABELS, 'intensity')} AS label FROM k""", dates=("date",))
def s08(spark, d):
    k = daily(spark, d).select("location", "date", ev.rain_intensity(F.col("cv_predicted_mm")).alias("intensity"))
    return k.withColumn("label", ev.lookup(ev.INTENSITY_LABELS, F.col("intensity")))


@query("s09_evaluation", f"""WITH {SD},
e AS (SELECT location, date, cv_predicted_mm - observed_mm AS diff, observed_mm AS o FROM sd WHERE observed_mm IS NOT NULL),
r AS (SELECT *, abs(diff) / greatest(o, 1) * 100 AS rel,
  CASE WHEN diff > 0 THEN 'overprediction' WHEN diff < 0 THEN 'underprediction' ELSE 'exact' END AS direction,
  CASE WHEN o <= 5 THEN 'drizzle' WHEN o <= 30 THEN 'moderate' ELSE 'heavy' END AS regime FROM e),
s AS (SELECT *, CASE WHEN o <= 5 THEN CASE WHEN abs(diff) <= 2 THEN 'low' ELSE 'moderate' END
  WHEN rel <= 20 THEN 'low' WHEN rel <= 50 THEN 'moderate' ELSE 'high' END AS severity FROM r)
SELECT location, date, round(abs(diff) + 1e-9, 6) AS absolute_error_mm, round(rel + 1e-9, 1) AS relative_error_pct, direction, regime, severity,
  {_case(ev.SEVERITY_TEXT, "CASE WHEN o <= 5 THEN 'drizzle/' ELSE '' END || severity")} || ' ' ||
  {_case(ev.DIRECTION_TEXT, 'direction')} || ' ' || {_case(ev.REGIME_TEXT, 'regime')} AS insight_text FROM s""",
       dates=("date",))
def s09(spark, d):
    x = daily(spark, d).filter("observed_mm IS NOT NULL")
    # half a unit of the last decimal would go to the even one here and up in SQL: both are shifted off the tie
    cols = ev.evaluation_columns(F.col("cv_predicted_mm"), F.col("observed_mm"), shift=1e-9)
    out = x.select("location", "date", *[c.alias(n) for n, c in cols.items()])
    return r6(out, "absolute_error_mm")


@query("s10_insight_texts", f"""WITH {SD}, k AS (SELECT location, date, {INTENSITY} AS intensity FROM sd)
SELECT location, date, {_case(ev.FORECAST_TEXT, 'intensity')} AS forecast_text,
  {_case(ev.SCENARIO_TEXT, 'intensity')} AS scenario_text FROM k""", dates=("date",))
def s10(spark, d):
    k = ev.rain_intensity(F.col("cv_predicted_mm"))
    return daily(spark, d).select("location", "date", ev.lookup(ev.FORECAST_TEXT, k).alias("forecast_text"),
                                  ev.lookup(ev.SCENARIO_TEXT, k).alias("scenario_text"))


@query("s11_kpi_text", f"""WITH {SD}
SELECT location, date, observed_mm AS num, coalesce(printf('%.2f', observed_mm), 'Not Available') AS text,
  CASE WHEN observed_mm IS NULL THEN '' ELSE 'mm' END AS unit,
  coalesce(printf('%+.0f%%', observed_mm - extracted_mm), '') AS pct,
  CASE WHEN observed_mm - extracted_mm < 0 THEN 'negative' ELSE '' END AS css_class FROM sd""", dates=("date",))
def s11(spark, d):
    x = daily(spark, d).select("location", "date", ev.kpi(F.col("observed_mm"), "mm").alias("k"),
                               ev.signed_pct(F.col("observed_mm") - F.col("extracted_mm")).alias("p"))
    return x.select("location", "date", "k.num", "k.text", "k.unit", F.col("p.text").alias("pct"), "p.css_class")
