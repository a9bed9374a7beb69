"""Model, forecast and stream queries.

Folds, lags, history, weights and neighbours are the production ones. The number of trees is not:
each tree is a chain of jobs, and the README has the times; sizes are parameters of the library.
"""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from skygauge.catalog.registry import query, shown
from skygauge.catalog.series_queries import external, ring_edges
from skygauge.catalog.shapes import READINGS
from skygauge.model import forecast as fc
from skygauge.model import selection as sel
from skygauge.model import transformers as tr
from skygauge.model import two_stage as ts
from skygauge.model.grouped import GroupedTwoStage
from skygauge.operators import joins as jn
from skygauge.operators.encoding import sample_weights
from skygauge.session import cut_lineage, scratch_dir
from skygauge.sources import adapters as ad
from skygauge.sources import feeds
from skygauge.streaming import live

T = ad.TARGET
SMALL = {"maxIter": 8, "maxDepth": 3, "stepSize": 0.2}
GROUPED = {"trees": 6, "depth": 3, "step_size": 0.3}


def train_rows(spark, d):
    """Training rows; null targets count as dry days."""
    return cut_lineage(ad.weather(spark, d).fillna(0.0, subset=[T]))


def prepared(df):
    return Pipeline(stages=ts.preprocessor(ad.FEATURES)).fit(df)


def two_stage(**kw):
    return ts.TwoStage(T, threshold=ts.RAIN_THRESHOLD, clf_params=SMALL, reg_params=[SMALL], **kw)


@query("m01_preprocess")
def m01(spark, d):
    x = train_rows(spark, d)
    v = prepared(x).transform(x).select("location", "date", vector_to_array("features").alias("f"))
    return v.select("location", "date", F.size("f").alias("width"), shown(F.aggregate("f", F.lit(0.0), lambda a, b: a + b), 4).alias("total"))


@query("m03_classifier")
def m03(spark, d):
    x = train_rows(spark, d)
    p = ts.build_pipeline(T, ad.FEATURES, "classifier", clf_params=SMALL).fit(x).transform(x)
    return p.select("location", "date", shown(vector_to_array("_prob")[1], 6).alias("chance"))


@query("m04_regressor_log_target")
def m04(spark, d):
    x = train_rows(spark, d)
    m = ts.build_pipeline(T, ad.FEATURES, "regressor", reg_params=SMALL, log_target=True).fit(x)
    return m.transform(x).select("location", "date", shown("prediction", 6).alias("prediction"))


@query("m05_two_stage")
def m05(spark, d):
    x = train_rows(spark, d)
    v = prepared(x).transform(x)
    return two_stage().fit(v).transform(v).select(
        "location", "date", shown("prediction_chance", 6).alias("chance"), shown("prediction", 6).alias("prediction"))


def reloaded(spark, fitted):
    """The whole fitted pipeline, feature steps included, as it comes back from storage."""
    path = scratch_dir(spark, "pipeline")
    fitted.write().save(path)
    return PipelineModel.load(path)


@query("m06_feature_and_model_stages")
def m06(spark, d):
    """All feature steps, the preprocessor and the two-stage model in one fit; saved, read back and applied to raw rows."""
    x = train_rows(spark, d)
    ext = cut_lineage(external(spark, d))
    columns = [*ad.FEATURES, "temp_range_c", "wind_gust_factor", "doy_sin", "doy_cos", "time_sigmoid", "mean_temp_roll_7d", "ONI_x_temp"]
    p = ts.build_pipeline(T, columns, feature_stages=tr.feature_stages(ad.RAIN[:1], ext), clf_params=SMALL, reg_params=SMALL)
    return ts.score(reloaded(spark, p.fit(x)), x.drop(T)).select("location", "date", shown("predicted_daily_rainfall_mm", 6).alias("predicted"))


@query("m07_batch_scoring")
def m07(spark, d):
    """Fit preprocessor and model, write both, read them back and score raw rows."""
    x = train_rows(spark, d)
    p = ts.build_pipeline(T, ad.FEATURES, clf_params=SMALL, reg_params=SMALL).fit(x)
    return ts.score(reloaded(spark, p), x.drop(T)).select("location", "date", shown("predicted_daily_rainfall_mm", 6).alias("predicted"))


@query("m08_cross_validation")
def m08_cv(spark, d):
    x = train_rows(spark, d)
    return sel.time_series_cv(prepared(x).transform(x), two_stage(), T, k=5)


@query("m11_grid_search_recall")
def m11(spark, d):
    x = train_rows(spark, d)
    v = prepared(x).transform(x).withColumns({"_wet": (F.col(T) > 1).cast("double"), "_weight": F.lit(1.0)})
    grid = [{**SMALL, "maxDepth": depth, "stepSize": step} for depth in (2, 3) for step in (0.1, 0.3)]
    return sel.grid_search_recall(sel.landed_folds(v, 5), lambda p: ts.classifier(**p), grid, "_wet", 5, vector_to_array("_prob")[1])


@query("m12_per_location_scores")
def m12(spark, d):
    return sel.per_location_scores(train_rows(spark, d), ad.FEATURES, T, k=5, **GROUPED)


@query("m16_stacking")
def m16(spark, d):
    x = cut_lineage(ad.daily(spark, d).dropna(subset=["observed_mm"]))
    out = sel.stack(x, ["cv_predicted_mm", "obs_predicted_mm"], "observed_mm", **SMALL)
    return out.select("location", "date", shown("meta_lr", 4).alias("meta_lr"), shown("meta_gbt", 4).alias("meta_gbt"))


@query("m17_isotonic_calibration")
def m17(spark, d):
    x = cut_lineage(ad.daily(spark, d).dropna(subset=["observed_mm"]))
    return sel.calibrate(x, "cv_predicted_mm", "observed_mm").select("location", "date", shown("calibrated", 4).alias("calibrated"))


@query("m18_robust_calibration")
def m18(spark, d):
    x = cut_lineage(ad.daily(spark, d).dropna(subset=["observed_mm"]))
    return sel.robust_calibrate(x, "cv_predicted_mm", "observed_mm", **SMALL).select(
        "location", "date", shown("calibrated", 4).alias("calibrated"))


LAGS = fc.TARGET_LAGS
LAG_COLUMNS = [f"{T}_lag_{k}" for k in LAGS] + [f"{T}_roll_mean_{k}" for k in LAGS] + [f"nbr_target_mean_lag{k}" for k in LAGS]
HORIZON = 7


def _forecast_parts(spark, d):
    """Rows before the last days of the table, and those days as the horizon; lagged training rows and the neighbours."""
    x = ad.weather(spark, d).select("location", "date", ad.WEATHER[0], T)
    cut = cut_lineage(x.agg(F.date_sub(F.max("date"), HORIZON).alias("c"))).scalar()
    history = cut_lineage(x.filter(F.col("date") <= cut).fillna(0.0, subset=[T]))
    edges = cut_lineage(ring_edges(spark, d))
    return history, x.filter(F.col("date") > cut), edges, cut_lineage(fc.lag_features(history, T, edges, LAGS))


@query("m19_recursive_forecast")
def m19(spark, d):
    history, future, edges, feats = _forecast_parts(spark, d)
    prep = Pipeline(stages=ts.preprocessor([ad.WEATHER[0], *LAG_COLUMNS])).fit(feats)
    est = ts.TwoStage(T, threshold=1.0, clf_params=SMALL, reg_params=[SMALL, {**SMALL, "maxDepth": 4, "seed": 7}])
    model = est.fit(prep.transform(feats))
    out = fc.recursive_forecast(history, future, lambda df: model.transform(prep.transform(df)), T, edges, LAGS,
                                extra=("prediction_0", "prediction_1"))
    return out.withColumns({c: shown(c, 6) for c in ("prediction", "prediction_0", "prediction_1")})


@query("m20_recursive_forecast_per_location")
def m20(spark, d):
    """Every station's own classifier and weighted regressor, all grown together, fed with their own forecasts and the neighbours'."""
    history, future, edges, feats = _forecast_parts(spark, d)
    feats = feats.join(sample_weights(feats, T), ["location", "date"])
    model = GroupedTwoStage(T, [ad.WEATHER[0], *LAG_COLUMNS], threshold=1.0, weight="weight", **GROUPED).fit(feats)
    out = fc.recursive_forecast(history, future, model.transform, T, edges, LAGS)
    return out.withColumn("prediction", shown("prediction", 6))


@query("m24_evaluate_requests")
def m24(spark, d):
    """Every station-day is asked for, some requests malformed: best source, prediction, rain of the nearest gauge, response as JSON or reason."""
    s = cut_lineage(ad.weather(spark, d).select("location", "date", *ad.FEATURES, T))
    rows = s.fillna(0.0, subset=[T])
    model = ts.build_pipeline(T, ad.FEATURES, clf_params=SMALL, reg_params=SMALL).fit(rows)
    day = F.dayofmonth("date")
    text = F.when(day == 30, F.date_format("date", "dd/MM/yyyy")).otherwise(F.col("date").cast("string"))
    requests = s.select(F.when(day != 29, F.col("location")).alias("location"), text.alias("date"))
    train = rows.filter(F.year("date") <= 1999).drop(T)
    test = rows.filter(F.year("date") == 2000).drop(T)
    feed = rows.filter((F.year("date") == 2001) & (F.month("date") <= 6))  # the weather service's answer, one text a station-day
    daily = F.struct(F.array(F.col("date").cast("string")).alias("time"), *[F.array(F.col(c)).alias(f) for f, c in feeds.WEATHER_COLUMNS.items()])
    recent = feeds.flatten_weather(feeds.parse(feed.select("location", F.to_json(F.struct(daily.alias("daily"))).alias("value")), feeds.WEATHER_SCHEMA))
    st, ga = ad.stations(spark, d), ad.gauges(spark, d)
    near = jn.nearest_point(st, ga, "station_code", "gauge_id", cell_deg=0.02)
    observed = fc.nearest_gauge_rain(st, ad.gauge_totals(spark, d), near)
    out = fc.answer_requests(requests, [("train_dataset", train), ("test_dataset", test), ("open_meteo", recent)], lambda df: ts.score(model, df), observed)
    return out.select("location", "date", F.to_json("response").alias("response"), "reason")


# ---- streams ----------------------------------------------------------------

def landed_readings(spark, d):
    """The readings as a folder of files."""
    path = scratch_dir(spark, "readings")
    ad.readings(spark, d).select("station_id", F.col("timestamp").cast("timestamp").alias("timestamp"), "rainfall_mm").write.parquet(path)
    return path


CLOSED = "(SELECT max(timestamp) - INTERVAL 1 HOUR FROM readings)"


@query("st01_daily_totals_stream", f"""WITH {READINGS} SELECT station_id, CAST(timestamp AS DATE) AS date, round(sum(rainfall_mm) + 1e-9, 4) AS daily_rainfall_total_mm
FROM readings GROUP BY 1, 2 HAVING CAST(CAST(timestamp AS DATE) + 1 AS TIMESTAMP) <= {CLOSED}""".replace("HAVING CAST(CAST(timestamp AS DATE)", "HAVING CAST(any_value(CAST(timestamp AS DATE))"),
       dates=("date",))
def st01(spark, d):
    out = live.drain(live.daily_totals(live.read_readings(spark, landed_readings(spark, d))))
    return out.withColumn("daily_rainfall_total_mm", shown("daily_rainfall_total_mm", 4))


def _sliding(minutes: int) -> str:
    k = minutes // 15
    return f"""WITH {READINGS},
c AS (SELECT station_id, time_bucket(INTERVAL '15 minutes', timestamp) AS t, sum(rainfall_mm) AS mm FROM readings GROUP BY 1, 2),
s AS (SELECT a.station_id, a.t, sum(b.mm) AS mm FROM c a JOIN c b ON a.station_id = b.station_id AND b.t >= a.t AND b.t < a.t + INTERVAL {minutes} MINUTE
      AND CAST(a.t AS DATE) = CAST(b.t AS DATE) GROUP BY 1, 2 HAVING count(*) = {k})
SELECT station_id, CAST(t AS DATE) AS date, round(max(mm) + 1e-9, 4) AS highest_mm FROM s
WHERE CAST(CAST(t AS DATE) + 1 AS TIMESTAMP) <= {CLOSED} GROUP BY 1, 2"""


def _sliding_stream(minutes: int):
    def build(spark, d):
        out = live.drain(live.sliding_maxima(live.read_readings(spark, landed_readings(spark, d)), minutes))
        return out.withColumn("highest_mm", shown("highest_mm", 4))

    return build


for _minutes, _name in ((30, "st02_sliding_maxima_stream"), (60, "st02_sliding_maxima_stream_60"), (120, "st02_sliding_maxima_stream_120")):
    query(_name, _sliding(_minutes), dates=("date",))(_sliding_stream(_minutes))


def _state_rows(spark, path):
    """Rows of state of the error join, where a prediction lies in two spans, and of figures by station."""
    r = spark.read.schema(live.READING_SCHEMA).parquet(path).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("station_id").alias("stations")).first()
    return 3 * r["n"], r["stations"]


def _errors(spark, path, packed=False):
    obs = live.read_readings(spark, path)
    pred = live.read_readings(spark, path).select(
        "station_id", (F.col("timestamp") - F.expr("interval 5 minutes")).alias("made_at"), (F.col("rainfall_mm") * 1.1).alias("predicted_mm"))
    return live.error_stream(pred, obs, packed=packed)


ERRORS = READINGS + """,
err AS (SELECT p.station_id, p.timestamp - INTERVAL 5 MINUTE AS made_at, o.timestamp, p.rainfall_mm * 1.1 - o.rainfall_mm AS e
        FROM readings p JOIN readings o ON p.station_id = o.station_id AND o.timestamp >= p.timestamp - INTERVAL 5 MINUTE AND o.timestamp <= p.timestamp + INTERVAL 5 MINUTE)"""


@query("st03_error_stream", f"WITH {ERRORS} SELECT station_id, made_at, timestamp, round(e + 1e-9, 4) AS error_mm FROM err", stamps=("made_at", "timestamp"))
def st03(spark, d):
    """The joined stream lands as blocks; their pairs are made where the result is read."""
    path = landed_readings(spark, d)
    out = live.error_pairs(live.drain(_errors(spark, path, packed=True), state_rows=_state_rows(spark, path)[0]))
    return out.select("station_id", "made_at", "timestamp", shown("error_mm", 4).alias("error_mm"))


METRICS = "count(*) AS n, round(avg(abs(e)) + 1e-9, 5) AS mae, round(sqrt(avg(e * e)) + 1e-9, 5) AS rmse, round(avg(e) + 1e-9, 5) AS bias"


def metrics_shown(df):
    return df.withColumns({c: shown(c, 5) for c in ("mae", "rmse", "bias")})


@query("st04_running_metrics_stream", f"WITH {ERRORS} SELECT station_id, {METRICS} FROM err GROUP BY 1")
def st04(spark, d):
    """The joined stream lands as files of blocks, which are the next stream: metrics of their pairs are upserted batch by batch."""
    folder, path = scratch_dir(spark, "errors"), landed_readings(spark, d)
    joined, stations = _state_rows(spark, path)
    blocks = live.drain(_errors(spark, path, packed=True), folder=folder, state_rows=joined)
    again = live.error_pairs(spark.readStream.schema(blocks.schema).parquet(f"{folder}/rows"))
    return metrics_shown(live.drain(live.running_metrics(again), mode="update", keys=("station_id",), state_rows=stations))


@query("st04_daily_metrics_stream", f"""WITH {ERRORS} SELECT station_id, CAST(timestamp AS DATE) AS date, {METRICS} FROM err
GROUP BY 1, 2 HAVING CAST(any_value(CAST(timestamp AS DATE)) + 1 AS TIMESTAMP) <= {CLOSED} - INTERVAL 15 MINUTE""", dates=("date",))
def st04_daily(spark, d):
    """Stream join and day's aggregate in one query."""
    path = landed_readings(spark, d)
    return metrics_shown(live.drain(live.daily_metrics(_errors(spark, path)), state_rows=_state_rows(spark, path)[0]))
