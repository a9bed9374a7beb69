"""Feature columns, encodings, splits and evaluation tables."""

from pyspark.sql import functions as F

from skygauge.catalog.registry import query, shown
from skygauge.catalog.series_queries import FILLED_IX, external, r6, target_days
from skygauge.catalog.shapes import SD
from skygauge.functions import evaluation as ev
from skygauge.functions import weather as wx
from skygauge.operators import encoding as en
from skygauge.operators import validation as va
from skygauge.operators.ordering import attach_row, global_quantiles
from skygauge.session import cut_lineage, land
from skygauge.sources import adapters as ad

T = ad.TARGET


def _bin_sql(col: str, edges) -> str:
    whens = " ".join(f"WHEN {col} <= {hi} THEN {i}" for i, hi in enumerate(edges[1:]))
    return f"CASE WHEN {col} < {edges[0]} THEN NULL {whens} END"


TEMP = SD + """,
t AS (SELECT location, date, maximum_temperature_c - minimum_temperature_c AS temp_range_c, mean_temperature_c - minimum_temperature_c AS temp_mean_minus_min,
        maximum_temperature_c - mean_temperature_c AS temp_max_minus_mean FROM sd),
tt AS (SELECT *, temp_mean_minus_min / (temp_range_c + 1e-6) AS pos, temp_mean_minus_min - temp_max_minus_mean AS temp_asymmetry FROM t)"""


@query("s01_temperature_features", f"""WITH {TEMP} SELECT location, date, temp_range_c, temp_mean_minus_min, temp_max_minus_mean,
  round(pos + 1e-9, 6) AS temp_mean_position, temp_asymmetry FROM tt""", dates=("date",))
def s01(spark, d):
    out = wx.temperature_features(ad.weather(spark, d)).select(
        "location", "date", "temp_range_c", "temp_mean_minus_min", "temp_max_minus_mean", "temp_mean_position", "temp_asymmetry")
    return r6(out, "temp_mean_position")


@query("s02_temperature_bins", f"""WITH {TEMP} SELECT location, date, {_bin_sql('temp_range_c', wx.RANGE_BINS)} AS temp_range_bin,
  {_bin_sql('pos', wx.MEAN_POSITION_BINS)} AS temp_mean_position_bin, {_bin_sql('temp_asymmetry', wx.ASYMMETRY_BINS)} AS temp_asymmetry_bin FROM tt""",
       dates=("date",))
def s02(spark, d):
    return wx.temperature_features(ad.weather(spark, d)).select(
        "location", "date", "temp_range_bin", "temp_mean_position_bin", "temp_asymmetry_bin")


@query("s03_rain_bins", f"WITH {SD} SELECT location, date, " + ", ".join(
    f"{_bin_sql(c, wx.RAIN_BINS)} AS {c}_bin" for c in ad.RAIN) + " FROM sd", dates=("date",))
def s03(spark, d):
    return wx.rain_bins(ad.weather(spark, d)).select("location", "date", *[f"{c}_bin" for c in ad.RAIN])


@query("s04_wind_rain_ratios", f"""WITH {SD} SELECT location, date,
  round(coalesce(max_wind_speed_kmh / nullif(mean_wind_speed_kmh, 0), 1) + 1e-9, 6) AS wind_gust_factor,
  round(coalesce(highest_60_min_rainfall_mm / nullif(highest_30_min_rainfall_mm, 0), 1) + 1e-9, 6) AS rain_intensity_ratio FROM sd""", dates=("date",))
def s04(spark, d):
    out = wx.wind_rain_features(ad.weather(spark, d)).select("location", "date", "wind_gust_factor", "rain_intensity_ratio")
    return r6(out, "wind_gust_factor", "rain_intensity_ratio")


INTER = ("wind_x_rain", "ONI_x_temp", "DMI_x_rainfall", "heat_index_proxy", "aqi_x_temp_range")


@query("s05_interactions", f"""WITH {SD}, {FILLED_IX} SELECT location, sd.date,
  round(mean_wind_speed_kmh * highest_60_min_rainfall_mm + 1e-9, 5) AS wind_x_rain, round(ONI * mean_temperature_c + 1e-9, 5) AS ONI_x_temp,
  round(DMI * highest_60_min_rainfall_mm + 1e-9, 5) AS DMI_x_rainfall, round(RH * mean_temperature_c + 1e-9, 5) AS heat_index_proxy,
  round(AQI * (maximum_temperature_c - minimum_temperature_c) + 1e-9, 5) AS aqi_x_temp_range FROM sd LEFT JOIN ext USING (date)""", dates=("date",))
def s05(spark, d):
    w = ad.weather(spark, d).join(external(spark, d), "date", "left")
    out = wx.interaction_features(wx.temperature_features(w)).select("location", "date", *INTER)
    return out.withColumns({c: shown(c, 5) for c in INTER})


IMP = ("highest_30_min_rainfall_mm", "mean_wind_speed_kmh")


@query("s06_impute_medians", f"""WITH {SD}, l AS (SELECT location, {', '.join(f'median({c}) AS {c}_l' for c in IMP)} FROM sd GROUP BY 1),
g AS (SELECT {', '.join(f'median({c}) AS {c}_g' for c in IMP)} FROM sd)
SELECT location, date, {', '.join(f'coalesce({c}, {c}_l, {c}_g) AS {c}' for c in IMP)} FROM sd JOIN l USING (location), g""", dates=("date",))
def s06(spark, d):
    x = cut_lineage(ad.weather(spark, d).select("location", "date", *IMP))  # read by every fit
    return en.impute_medians(x, IMP, en.location_medians(x, IMP), en.global_medians(x, IMP))


@query("s06_impute_from_train", f"""WITH {SD}, tr AS (SELECT * FROM sd WHERE year <= 1996 AND location <> (SELECT min(location) FROM sd)),
l AS (SELECT location, median(highest_30_min_rainfall_mm) AS m FROM tr GROUP BY 1), g AS (SELECT median(highest_30_min_rainfall_mm) AS gm FROM tr)
SELECT location, date, coalesce(highest_30_min_rainfall_mm, m, gm) AS highest_30_min_rainfall_mm FROM sd LEFT JOIN l USING (location), g""", dates=("date",))
def s06_train(spark, d):
    """Medians of the training rows applied to all rows; a station unseen in training takes the global one."""
    x = cut_lineage(ad.station_days(spark, d).select("location", "date", "year", IMP[0]))
    train = x.filter(F.col("year") <= 1996).filter(F.col("location") != x.agg(F.min("location").alias("l")).scalar())
    out = en.impute_medians(x, IMP[:1], en.location_medians(train, IMP[:1]), en.global_medians(train, IMP[:1]))
    return out.drop("year")


@query("a14_medians", f"""WITH {SD} SELECT location, median(highest_30_min_rainfall_mm) AS highest_30_min_rainfall_mm_loc,
  median(mean_wind_speed_kmh) AS mean_wind_speed_kmh_loc, any_value(a) AS highest_30_min_rainfall_mm_all, any_value(b) AS mean_wind_speed_kmh_all
FROM sd, (SELECT median(highest_30_min_rainfall_mm) AS a, median(mean_wind_speed_kmh) AS b FROM sd) AS g GROUP BY 1""")
def a14(spark, d):
    x = cut_lineage(ad.weather(spark, d).select("location", *IMP))
    return attach_row(en.location_medians(x, IMP), en.global_medians(x, IMP))


ENC = SD + """,
g AS (SELECT avg(daily_rainfall_total_mm) AS gm FROM sd WHERE year <= 1999),
cell AS (SELECT location, month(date) AS month, (coalesce(sum(daily_rainfall_total_mm), 0) + any_value(gm) * 50) / (count(daily_rainfall_total_mm) + 50) AS te
         FROM sd, g WHERE year <= 1999 AND month(date) <> 6 GROUP BY 1, 2)"""


def _encoding(spark, d):
    x = land(target_days(spark, d).withColumn("month", F.month("date")), "target_days")
    train = x.filter("year <= 1999")
    cells, overall = en.fit_target_encoding(train, T)
    return x, cells.filter("month <> 6"), overall


@query("a15_target_encoding", f"WITH {ENC} SELECT location, CAST(month AS INTEGER) AS month, round(te + 1e-9, 6) AS te_location_month FROM cell")
def a15(spark, d):
    return r6(_encoding(spark, d)[1], "te_location_month")


@query("s07_apply_encoding", f"""WITH {ENC} SELECT sd.location, date, round(coalesce(te, gm) + 1e-9, 6) AS te_location_month
FROM sd LEFT JOIN cell ON sd.location = cell.location AND month(sd.date) = cell.month, g""", dates=("date",))
def s07(spark, d):
    x, cells, overall = _encoding(spark, d)
    return r6(en.apply_target_encoding(x, cells, overall).select("location", "date", "te_location_month"), "te_location_month")


QS = ", ".join(f"quantile_cont({T}, {p}) AS {n}" for n, p in en.QUANTILES.items())


@query("a16_location_quantiles", f"WITH {SD}, q AS (SELECT location, {QS} FROM sd GROUP BY 1) SELECT location, "
       + ", ".join(f"round({n} + 1e-9, 5) AS {n}" for n in en.QUANTILES) + " FROM q")
def a16(spark, d):
    return en.location_quantiles(target_days(spark, d), T).withColumns({n: shown(n, 5) for n in en.QUANTILES})


WEIGHT = f"""WITH {SD}, q AS (SELECT location, {QS} FROM sd GROUP BY 1),
w AS (SELECT location, date, CASE WHEN {T} > q999 THEN 11.0::DOUBLE WHEN {T} > q995 THEN 9 WHEN {T} > q99 THEN 7 WHEN {T} > q95 THEN 5
  WHEN {T} > q90 THEN 3 ELSE 1 END AS weight FROM sd JOIN q USING (location))"""


def weights(spark, d):
    return en.sample_weights(land(target_days(spark, d), "target_days"), T)


@query("s13_sample_weights", WEIGHT + " SELECT * FROM w", dates=("date",))
def s13(spark, d):
    return weights(spark, d)


@query("a25_weight_summary", WEIGHT + """ SELECT count(*) AS n, round(avg(weight) + 1e-9, 6) AS mean, round(stddev_samp(weight) + 1e-9, 6) AS std, min(weight) AS lo,
  quantile_cont(weight, 0.5) AS p50, quantile_cont(weight, 0.9) AS p90, quantile_cont(weight, 0.95) AS p95, quantile_cont(weight, 0.99) AS p99,
  max(weight) AS hi FROM w""")
def a25(spark, d):
    w = weights(spark, d)
    stats = w.agg(F.count("weight").alias("n"), shown(F.avg("weight"), 6).alias("mean"), shown(F.stddev_samp("weight"), 6).alias("std"),
                  F.min("weight").alias("lo"), F.max("weight").alias("hi"))
    return attach_row(stats, global_quantiles(w, "weight", [.5, .9, .95, .99], ["p50", "p90", "p95", "p99"]))


@query("s17_log_target", f"WITH {SD} SELECT location, date, round(ln(1 + extracted_mm) + 1e-9, 6) AS z, round(extracted_mm + 1e-9, 4) AS back FROM sd", dates=("date",))
def s17(spark, d):
    z = wx.log_target(F.col("extracted_mm"))
    return ad.daily(spark, d).select("location", "date", shown(z, 6).alias("z"), shown(wx.unlog_target(z), 4).alias("back"))


@query("s18_response", f"""WITH {SD} SELECT location, date, 'evaluation' AS mode, round(cv_predicted_mm + 1e-9, 3) AS mm, observed_mm AS observed,
  round(cv_predicted_mm - observed_mm + 1e-9, 3) AS error_mm, 'train_dataset' AS source, 'Historical evaluation using best available features' AS note FROM sd""",
       dates=("date",))
def s18(spark, d):
    r = ev.response(F.lit("evaluation"), F.col("location"), F.col("date"), F.col("cv_predicted_mm"), F.lit("train_dataset"),
                    F.lit("Historical evaluation using best available features"), F.col("observed_mm"))
    x = ad.daily(spark, d).select(r.alias("r"))
    return x.select("r.input.location", "r.input.date", "r.mode", F.col("r.prediction.daily_rainfall_mm").alias("mm"),
                    F.col("r.comparison.observed_daily_rainfall_mm").alias("observed"), F.col("r.comparison.error_mm").alias("error_mm"),
                    F.col("r.meta.feature_source").alias("source"), F.get("r.meta.notes", F.lit(0)).alias("note"))


TODAY = "2000-06-15"


@query("s18_response_forecast", f"""WITH {SD}, t AS (SELECT *, date BETWEEN DATE '{TODAY}' AND DATE '{TODAY}' + 14 AS ok FROM sd)
SELECT location, date, CASE WHEN ok THEN 'forecast' END AS mode, CASE WHEN ok THEN round(cv_predicted_mm + 1e-9, 3) END AS mm, CASE WHEN ok THEN 'open_meteo' END AS source,
  CASE WHEN ok THEN 'Forecast limited to short-term weather window' END AS note,
  CASE WHEN NOT ok THEN 'Forecast date must be between {TODAY} and 2000-06-29' END AS reason FROM t""", dates=("date",))
def s18_forecast(spark, d):
    """Every station-day as a forecast request of one day: answered within the window, else with the reason."""
    reason = ev.forecast_reason(F.col("date"), F.to_date(F.lit(TODAY)))
    r = F.when(reason.isNull(), ev.forecast_response(F.col("location"), F.col("date"), F.col("cv_predicted_mm")))
    return ad.daily(spark, d).select("location", "date", r.alias("r"), reason.alias("reason")).select(
        "location", "date", "r.mode", F.col("r.prediction.daily_rainfall_mm").alias("mm"), F.col("r.meta.feature_source").alias("source"),
        F.get("r.meta.notes", F.lit(0)).alias("note"), "reason")


@query("s18_response_random", f"""WITH {SD} SELECT location, date, 'random' AS mode, round(cv_predicted_mm + 1e-9, 3) AS mm, 'random_user_input' AS source,
  'Scenario-based prediction' AS note, true AS no_comparison FROM sd""", dates=("date",))
def s18_random(spark, d):
    r = ev.scenario_response(F.col("location"), F.col("date"), F.col("cv_predicted_mm"))
    return ad.daily(spark, d).select("location", "date", r.alias("r")).select(
        "location", "date", "r.mode", F.col("r.prediction.daily_rainfall_mm").alias("mm"), F.col("r.meta.feature_source").alias("source"),
        F.get("r.meta.notes", F.lit(0)).alias("note"), F.col("r.comparison").isNull().alias("no_comparison"))


# ---- evaluation tables ------------------------------------------------------

PREDS = ("cv_predicted_mm", "obs_predicted_mm")
ERR = SD + """,
e AS (SELECT location, date, observed_mm AS y, cv_predicted_mm AS a, obs_predicted_mm AS b FROM sd WHERE observed_mm IS NOT NULL)"""


def errors(spark, d):
    return va.error_columns(ad.daily(spark, d).dropna(subset=["observed_mm"]), PREDS, "observed_mm")


@query("s14_error_columns", f"WITH {ERR} SELECT location, date, " + ", ".join(
    f"round({e} + 1e-9, 4) AS {n}_{p}" for c, p in zip("ab", PREDS) for n, e in (("err", f"{c} - y"), ("abs_err", f"abs({c} - y)"), ("sq_err", f"({c} - y) ** 2")))
       + " FROM e", dates=("date",))
def s14(spark, d):
    cols = [f"{n}_{p}" for p in PREDS for n in ("err", "abs_err", "sq_err")]
    return errors(spark, d).select("location", "date", *[shown(c, 4).alias(c) for c in cols])


ABS = "round(avg(abs(a - y)) + 1e-9, 6) AS abs_err_cv_predicted_mm, round(avg(abs(b - y)) + 1e-9, 6) AS abs_err_obs_predicted_mm"
ABS_COLS = [f"abs_err_{p}" for p in PREDS]


@query("a17_error_by_location", f"WITH {ERR} SELECT location, {ABS} FROM e GROUP BY 1")
def a17(spark, d):
    return r6(va.error_means(errors(spark, d), PREDS, "location"), *ABS_COLS).orderBy(F.desc(ABS_COLS[0]))


@query("a18_error_by_rain_bin", f"""WITH {ERR} SELECT CASE WHEN y <= -1 THEN NULL WHEN y <= 0 THEN 'no_rain' WHEN y <= 10 THEN 'light'
  WHEN y <= 30 THEN 'moderate' WHEN y <= 100 THEN 'heavy' ELSE 'extreme' END AS rain_bin, {ABS} FROM e GROUP BY 1""")
def a18(spark, d):
    by = ev.error_rain_bin(F.col("observed_mm")).alias("rain_bin")
    return r6(va.error_means(errors(spark, d), PREDS, by), *ABS_COLS)


@query("m22_model_rmse", f"""WITH {ERR} SELECT 'cv_predicted_mm' AS model, round(sqrt(avg((a - y) ** 2)) + 1e-9, 6) AS rmse FROM e
UNION ALL SELECT 'obs_predicted_mm', round(sqrt(avg((b - y) ** 2)) + 1e-9, 6) FROM e""")
def m22(spark, d):
    return r6(va.model_rmse(errors(spark, d), PREDS, "observed_mm"), "rmse")


@query("m02_imputers", f"""WITH {SD}, md AS (SELECT median(highest_30_min_rainfall_mm) AS m FROM sd),
mode AS (SELECT location AS most FROM sd GROUP BY 1 ORDER BY count(*) DESC, location LIMIT 1)
SELECT date, location, coalesce(CASE WHEN day(date) <> 4 THEN location END, most) AS filled_location, coalesce(highest_30_min_rainfall_mm, m) AS filled FROM sd, md, mode""",
       dates=("date",))
def m02(spark, d):
    """Median for numbers, most frequent value (ties by name) for text."""
    x = ad.weather(spark, d).select("location", "date", IMP[0])
    most = x.groupBy("location").count().agg(F.min_by("location", F.struct(-F.col("count"), F.col("location"))).alias("v"))
    mid = global_quantiles(x, IMP[0], [0.5], ["v"])
    gap = F.when(F.dayofmonth("date") != 4, F.col("location"))
    return x.select("date", "location", F.coalesce(gap, most.scalar()).alias("filled_location"),
                    F.coalesce(IMP[0], mid.scalar()).alias("filled"))


@query("m08_time_ordered_folds", f"""WITH {SD}, r AS (SELECT location, date, row_number() OVER (ORDER BY date, location) - 1 AS o, count(*) OVER () AS n FROM sd),
s AS (SELECT *, n // 6 AS size FROM r)
SELECT location, date, CAST(CASE WHEN o < n - 5 * size THEN 0 ELSE (o - (n - 5 * size)) // size + 1 END AS INTEGER) AS test_fold FROM s""", dates=("date",))
def m08(spark, d):
    return va.time_ordered_folds(ad.daily(spark, d).select("location", "date")).drop("ordinal")


@query("m09_year_folds", f"""WITH {SD}, y AS (SELECT DISTINCT year FROM sd), k AS (SELECT max(year) AS top FROM y)
SELECT f AS fold, 'train' AS part, count(*) AS n FROM sd, k, (SELECT unnest(range(0, 3)) AS f) AS fs WHERE year < top - (3 - f) * 2 + 1 GROUP BY 1
UNION ALL SELECT f, 'validation', count(*) FROM sd, k, (SELECT unnest(range(0, 3)) AS f) AS fs
WHERE year BETWEEN top - (3 - f) * 2 + 1 AND top - (3 - f) * 2 + 2 GROUP BY 1""")
def m09(spark, d):
    out = None
    for i, (train, val) in enumerate(va.year_folds(ad.mart(spark, d).select("location", "date"), 3, 2)):
        for part, rows in (("train", train), ("validation", val)):
            c = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).cast("bigint").alias("fold"), F.lit(part).alias("part"), "n")
            out = c if out is None else out.unionByName(c)
    return out


@query("m10_holdout_months", f"""WITH {SD}, c AS (SELECT location, max(date) - INTERVAL 18 MONTH AS cut, max(date) - INTERVAL 12 MONTH AS cut_year FROM sd GROUP BY 1)
SELECT sd.location, date, CASE WHEN date <= cut THEN 'train' ELSE 'validation' END AS part, CASE WHEN date < cut_year THEN 'train' ELSE 'validation' END AS part_year
FROM sd JOIN c USING (location)""", dates=("date",))
def m10(spark, d):
    x = va.holdout_last(ad.mart(spark, d).select("location", "date"), 18)
    return va.holdout_last(x.withColumnRenamed("part", "p18"), 12, inclusive=False).select(
        "location", "date", F.col("p18").alias("part"), F.col("part").alias("part_year"))


SCORED = SD + """,
sc AS (SELECT round(cv_predicted_mm / (cv_predicted_mm + 20) + 1e-9, 4) AS score, CASE WHEN extracted_mm > 1 AND day(date) % 3 > 0 THEN 1 ELSE 0 END AS label FROM sd)"""


def scored(spark, d):
    p = F.col("cv_predicted_mm")
    wet = (F.col("extracted_mm") > 1) & (F.dayofmonth("date") % 3 > 0)
    return ad.daily(spark, d).select(shown(p / (p + 20), 4).alias("score"), wet.cast("int").alias("label"))


TH = (0.3, 0.5, 0.7)


@query("m13_threshold_report", f"""WITH {SCORED}, c AS (SELECT t AS threshold, count(*) FILTER (WHERE score > t AND label = 1) AS tp,
  count(*) FILTER (WHERE score > t AND label = 0) AS fp, count(*) FILTER (WHERE score <= t AND label = 1) AS fn,
  count(*) FILTER (WHERE score <= t AND label = 0) AS tn FROM sc, (SELECT unnest([0.3, 0.5, 0.7])::DOUBLE AS t) AS ts GROUP BY 1)
SELECT *, round((tp + tn) / (tp + fp + fn + tn) + 1e-9, 6) AS accuracy, round(tp / nullif(tp + fp, 0) + 1e-9, 6) AS precision_rain, round(tp / nullif(tp + fn, 0) + 1e-9, 6) AS recall_rain,
  round(2 * tp / nullif(2 * tp + fp + fn, 0) + 1e-9, 6) AS f1_rain, round(tn / nullif(tn + fn, 0) + 1e-9, 6) AS precision_dry, round(tn / nullif(tn + fp, 0) + 1e-9, 6) AS recall_dry,
  round(2 * tn / nullif(2 * tn + fp + fn, 0) + 1e-9, 6) AS f1_dry FROM c""")
def m13(spark, d):
    out = va.threshold_report(scored(spark, d), "score", "label", TH)
    return r6(out, *[c for c in out.columns if c not in ("threshold", "tp", "fp", "fn", "tn")])


LEVELS = SCORED + """,
lv AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM sc GROUP BY 1),
cu AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM lv)"""


@query("m14_pr_curve", f"WITH {LEVELS} SELECT score, round(tp / (tp + fp) + 1e-9, 6) AS precision, round(tp / np + 1e-9, 6) AS recall FROM cu")
def m14(spark, d):
    return r6(va.pr_curve(va.score_levels(scored(spark, d), "score", "label")), "precision", "recall")


@query("m14_ranking_scores", f"""WITH {LEVELS} SELECT round(sum(pos * tp / (tp + fp)) / any_value(np) + 1e-9, 6) AS average_precision,
  round(sum(neg * (tp - pos / 2.0::DOUBLE)) / any_value(np) / any_value(nn) + 1e-9, 6) AS roc_auc, round(any_value(np) / (any_value(np) + any_value(nn)) + 1e-9, 6) AS base_rate FROM cu""")
def m14_scores(spark, d):
    return r6(va.ranking_scores(va.score_levels(scored(spark, d), "score", "label")), "average_precision", "roc_auc", "base_rate")


@query("m15_blend_weights", f"""WITH {ERR}, s AS (SELECT count(*) AS n, sum((a - b) ** 2) AS dd, sum((a - b) * (b - y)) AS de, sum((b - y) ** 2) AS ee FROM e)
SELECT round(i / 999 + 1e-9, 6) AS w, round(sqrt(greatest(((i / 999) ** 2 * dd + 2 * (i / 999) * de + ee) / n, 0)) + 1e-9, 5) AS rmse
FROM s, (SELECT CAST(unnest(range(0, 1000)) AS DOUBLE) AS i) AS g""")
def m15(spark, d):
    g = va.blend_weights(ad.daily(spark, d), "cv_predicted_mm", "obs_predicted_mm", "observed_mm")
    return g.select(shown("w", 6).alias("w"), shown("rmse", 5).alias("rmse"))


@query("m15_best_blend", f"""WITH {ERR}, s AS (SELECT count(*) AS n, sum((a - b) ** 2) AS dd, sum((a - b) * (b - y)) AS de, sum((b - y) ** 2) AS ee FROM e),
g AS (SELECT i / 999 AS w, sqrt(greatest(((i / 999) ** 2 * dd + 2 * (i / 999) * de + ee) / n, 0)) AS rmse FROM s, (SELECT CAST(unnest(range(0, 1000)) AS DOUBLE) AS i) AS k)
SELECT round(w + 1e-9, 6) AS best_w, round(rmse + 1e-9, 5) AS best_rmse FROM g ORDER BY rmse, w LIMIT 1""")
def m15_best(spark, d):
    g = va.blend_weights(ad.daily(spark, d), "cv_predicted_mm", "obs_predicted_mm", "observed_mm")
    return va.best_blend(g).select(shown("best_w", 6).alias("best_w"), shown("best_rmse", 5).alias("best_rmse"))


@query("m21_class_weight", f"""WITH {SD} SELECT round((count(*) - count(*) FILTER (WHERE {T} > 1)) / nullif(count(*) FILTER (WHERE {T} > 1), 0) + 1e-9, 6) AS scale_pos_weight FROM sd""")
def m21(spark, d):
    return r6(va.class_weight(target_days(spark, d), T), "scale_pos_weight")
