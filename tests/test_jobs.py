"""Sources, models, forecasts and streams."""

import datetime as dt
import random
import time

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from skygauge.model import forecast as fc
from skygauge.model import selection as sel
from skygauge.model import transformers as tr
from skygauge.model import two_stage as ts
from skygauge.operators import windows as win
from skygauge.plans import marts
from skygauge.sources import adapters as ad
from skygauge.sources import feeds, files
from skygauge.streaming import live
from skygauge.streaming.sink import UpsertTable
from tests.conftest import SMALL

SMALL_TREES = {"maxIter": 2, "maxDepth": 2}


def test_csv_tree(spark, tmp_path):
    a, b = tmp_path / "A", tmp_path / "B_C"
    a.mkdir(), b.mkdir()
    (a / "A_2009.csv").write_text("Date,Mean Temperature (°C)\n2009-01-01,27.5\n2009-01-02,\u0097\n", encoding="utf-8")
    (a / "A_2010.csv").write_text("Mean Temperature (°C),Date\n30.1,2010-01-01\n", encoding="utf-8")
    (b / "B_2009.csv").write_text("Date,Max Wind Speed (km/h)\n2009-05-01,9\n", encoding="utf-8")
    root = str(tmp_path)
    out = {(r["location"], r["csv_files"], r["date"]): r for r in files.concat_stations(spark, root).collect()}
    assert set(out) == {("A", "A_2009", "2009-01-01"), ("A", "A_2009", "2009-01-02"), ("A", "A_2010", "2010-01-01"), ("B_C", "B_2009", "2009-05-01")}
    assert out["A", "A_2010", "2010-01-01"]["mean_temperature_c"] == "30.1"
    assert out["B_C", "B_2009", "2009-05-01"]["mean_temperature_c"] is None
    audit = files.header_counts(files.header_audit(spark, root)).collect()
    assert sorted(r["n_files"] for r in audit) == [1, 2]  # column order does not matter
    assert {r["location"]: r["n"] for r in files.count_rows(spark, str(b)).collect()} == {"B_C": 1}
    one = files.sample_file(spark, str(a), seed=1).collect()
    assert len({r["year"] for r in one}) == 1 and one[0]["location"] == "A"
    assert [r[0] for r in files.sample_file(spark, str(a), seed=1).collect()] == [r[0] for r in one]
    t = files.load_training(spark, str(a / "A_2009.csv"), ["mean_temperature_c"])
    assert [(r["date"], r["mean_temperature_c"]) for r in t.orderBy("date").collect()] == [(dt.date(2009, 1, 1), 27.5), (dt.date(2009, 1, 2), None)]
    with pytest.raises(FileNotFoundError):
        files.concat_folder(spark, str(tmp_path / "none"))


def test_csv_columns_go_by_name(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text('Date,"Max, Wind",T\n2009-01-01,"1,5",7\n\n2009-01-02,,"say ""x"""\n')
    (tmp_path / "b.csv").write_text('T,Date\n8,2009-02-01\n9,2009-02-02\n9\n')
    (tmp_path / "c.csv").write_text('Date,Extra\n')  # a header alone: its columns count
    (tmp_path / "empty.csv").write_text("")
    out = files.concat_folder(spark, str(tmp_path))
    assert set(out.columns) == {"date", "max,_wind", "t", "extra", "csv_files"}
    got = sorted(((r.csv_files, r.date, r["max,_wind"], r.t, r.extra) for r in out.collect()), key=str)
    assert got == sorted([("a", "2009-01-01", "1,5", "7", None), ("a", "2009-01-02", None, 'say "x"', None), ("b", "2009-02-01", None, "8", None),
                          ("b", "2009-02-02", None, "9", None), ("b", None, None, "9", None)], key=str)
    assert [c for r in files.header_audit(spark, str(tmp_path)).collect() for c in r.columns if r.file.endswith("a.csv")] == ["Date", "Max, Wind", "T"]
    with pytest.raises(Exception, match="header|Header"):
        files.read_station_csv(spark, str(tmp_path / "[ab].csv")).collect()
    # a long file is read in blocks: rows of later blocks find the header by their file
    long = tmp_path / "long"
    long.mkdir()
    (long / "x.csv").write_text("B,A\n" + "".join(f"{i},{i + 1}\n" for i in range(5000)))
    (long / "y.csv").write_text("A,B\n" + "".join(f"{i + 1},{i}\n" for i in range(5000)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = files.concat_folder(spark, str(long))
        assert rows.count() == 10_000 and rows.filter("int(a) <> int(b) + 1 or a is null").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_stations_array_and_archive(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"station_code": "S1", "station_name": "X", "latitude": 1.0, "longitude": 2.0},\n {"station_code": "S2", "station_name": "Y", "latitude": 3.0, "longitude": 4.0}]')
    assert files.read_stations(spark, str(tmp_path / "s.json")).count() == 2
    with pytest.raises(ValueError, match="Missing columns"):
        files.normalize_archive(spark.createDataFrame([("2020", "1", "2")], "Year string, Month string, Day string"), "X (Y)")


def test_empty_mart_and_replace(spark, tmp_path):
    e = marts.empty_mart(spark)
    assert e.count() == 0 and e.columns[0] == "date"
    d = spark.createDataFrame([("a", dt.date(2020, 1, 1), 2020, 1.0)], "location string, date date, year int, v double")
    for _ in range(2):  # replacing twice leaves one copy
        back = marts.replace_mart(d, str(tmp_path / "m"))
    assert back.count() == 1
    with pytest.raises(ValueError, match="available"):
        marts.one_location(d, "zzz")


def test_bad_feed_text_gives_no_rows(spark):
    df = spark.createDataFrame([('{"items": [{"timestamp": "2020-01-01T00:05:00", "readings": [{"station_id": "S1", "value": 0.4}]}]}',), ("not json",)], "value string")
    assert [(r["station_id"], r["rainfall_mm"]) for r in feeds.flatten_readings(feeds.parse(df, feeds.READINGS_SCHEMA)).collect()] == [("S1", 0.4)]


def rain_rows(spark, wet=True):
    d0 = dt.date(2020, 1, 1)
    rows = [(loc, d0 + dt.timedelta(days=i), float(i % 7), 5.0 * (i % 3) * wet) for loc in ("a", "b") for i in range(120)]
    return spark.createDataFrame(rows, "location string, date date, t double, y double")


def fitted(spark, df, **kw):
    v = Pipeline(stages=ts.preprocessor(["t"])).fit(df).transform(df)
    return v, ts.TwoStage("y", clf_params=SMALL_TREES, reg_params=[SMALL_TREES], **kw).fit(v)


def test_two_stage_rules(spark, tmp_path):
    v, dry = fitted(spark, rain_rows(spark, wet=False))
    assert dry.transform(v).filter("prediction <> 0").count() == 0
    v, m = fitted(spark, rain_rows(spark), log_target=True)
    out = ts.score(m, v)
    assert out.filter("predicted_daily_rainfall_mm < 0 OR predicted_daily_rainfall_mm IS NULL").count() == 0
    m.save(str(tmp_path / "m"))
    again = ts.score(ts.TwoStageModel.load(str(tmp_path / "m")), v)
    assert out.select("location", "date", "predicted_daily_rainfall_mm").exceptAll(again.select("location", "date", "predicted_daily_rainfall_mm")).count() == 0
    with pytest.raises(ValueError):
        ts.build_model("other", "y")


def weather_rows(spark):
    rows = []
    for loc in ("a", "b"):
        for i in range(90):
            t = 25.0 + i % 7
            rows.append((loc, dt.date(2020, 1, 1) + dt.timedelta(days=i), t, t + 3, t - 2, 4.0 + i % 5, 9.0, None if i % 6 == 0 else float(i % 4), 2.0, 3.0, 5.0 * (i % 3)))
    cols = ["mean_temperature_c", "maximum_temperature_c", "minimum_temperature_c", "mean_wind_speed_kmh", "max_wind_speed_kmh",
            "highest_30_min_rainfall_mm", "highest_60_min_rainfall_mm", "highest_120_min_rainfall_mm", "y"]
    return spark.createDataFrame(rows, "location string, date date, " + ", ".join(f"{c} double" for c in cols))


@pytest.mark.parametrize("kind", ["two_stage", "regressor", "classifier"])
def test_whole_pipeline_scores_alike_after_reload(spark, tmp_path, kind):
    df = weather_rows(spark)
    ext = spark.createDataFrame([(dt.date(2020, m, 1), float(m)) for m in (1, 2, 3)], "date date, ONI double")
    features = tr.feature_stages(["highest_30_min_rainfall_mm"], ext) + [tr.TargetEncoder("y", ["location", "month"])]
    columns = ["mean_temperature_c", "highest_30_min_rainfall_mm", "temp_range_c", "time_sigmoid", "mean_temp_roll_7d", "te_location_month"]
    params = {"two_stage": {"clf_params": SMALL_TREES, "reg_params": SMALL_TREES, "log_target": True}, "regressor": {"reg_params": SMALL_TREES, "log_target": True}, "classifier": {"clf_params": SMALL_TREES}}
    pipe = ts.build_pipeline("y", columns, kind, feature_stages=features, **params[kind])
    pipe.save(str(tmp_path / "pipe"))
    fitted = Pipeline.load(str(tmp_path / "pipe")).fit(df) if kind != "two_stage" else pipe.fit(df)
    fitted.save(str(tmp_path / "fitted"))
    again = PipelineModel.load(str(tmp_path / "fitted"))
    out = "_wet_pred" if kind == "classifier" else "prediction"
    # rows that training did not see: another station, a later day, missing values
    new = df.drop("y").unionByName(spark.createDataFrame([("z", dt.date(2020, 6, 1), *([20.0] * 5), None, 1.0, 2.0)], df.drop("y").schema))
    a, b = (sorted((r["location"], r["date"], r[out]) for r in m.transform(new).select("location", "date", out).collect()) for m in (fitted, again))
    assert a == b and len(a) == 181 and len({x[2] for x in a}) > 1
    assert [type(s) for s in again.stages] == [type(s) for s in fitted.stages]


def test_unknown_station_has_zero_indicator(spark):
    df = rain_rows(spark)
    p = Pipeline(stages=ts.preprocessor(["t"])).fit(df)
    new = spark.createDataFrame([("zzz", 4.0), ("a", None)], "location string, t double")
    assert [r["features"].toArray().tolist() for r in p.transform(new).collect()] == [[0, 0, 4], [1, 0, -1]]


def test_fitted_transformers_use_training_values(spark):
    train = spark.createDataFrame([("a", dt.date(2020, 1, 1), 1.0), ("a", dt.date(2020, 1, 11), 3.0), ("b", dt.date(2020, 1, 2), 10.0)], "location string, date date, x double")
    new = spark.createDataFrame([("a", dt.date(2020, 1, 6), None), ("z", dt.date(2020, 1, 21), None)], "location string, date date, x double")
    imp = tr.MedianImputer(["x"]).fit(train).transform(new)
    assert {r["location"]: r["x"] for r in imp.collect()} == {"a": 2.0, "z": 3.0}
    sig = {r["location"]: r["time_sigmoid"] for r in tr.TimeFeatures().fit(train).transform(new).collect()}
    assert sig["a"] == pytest.approx(0.5) and sig["z"] > 0.99


def test_recursive_forecast_feeds_itself(spark):
    d0 = dt.date(2020, 1, 1)
    hist = spark.createDataFrame([(loc, d0 + dt.timedelta(days=i), float(i)) for loc in ("a", "b") for i in range(10)], "location string, date date, y double")
    fut = spark.createDataFrame([(loc, d0 + dt.timedelta(days=i), None) for loc in ("a", "b") for i in (10, 11, 12)], "location string, date date, y double")
    plus_one = lambda df: df.withColumn("prediction", F.col("y_lag_1") + F.when(F.col("location") == "a", 1).otherwise(-100))
    out = fc.recursive_forecast(hist, fut, plus_one, "y", lags=(1, 7))
    got = {(r["location"], r["date"].day): r["prediction"] for r in out.collect()}
    assert [got["a", k] for k in (11, 12, 13)] == [10, 11, 12] and [got["b", k] for k in (11, 12, 13)] == [0, 0, 0]


def test_isotonic_is_monotone_and_clipped(spark):
    df = spark.createDataFrame([(float(i), float(i % 5) - 2) for i in range(40)], "p double, y double")
    v = [r["calibrated"] for r in sel.calibrate(df, "p", "y").orderBy("p").collect()]
    assert v == sorted(v) and min(v) >= 0


def test_streams_equal_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("s%d" % (i % 2), t0 + dt.timedelta(minutes=7 * i), float(i % 11)) for i in range(600)]
    rows += [("s9", t0 + dt.timedelta(days=9), 0.0)]  # closes the days before it
    df = spark.createDataFrame(rows, live.READING_SCHEMA)
    df.repartition(3).write.parquet(str(tmp_path / "r"))
    closed = df.filter("station_id <> 's9'")
    read = lambda: live.read_readings(spark, str(tmp_path / "r"))
    got = live.drain(live.daily_totals(read()))
    assert got.exceptAll(feeds.daily_totals(closed)).count() == 0 and got.count() == feeds.daily_totals(closed).count()
    cells = closed.groupBy("station_id", F.window("timestamp", "15 minutes").start.alias("time")).agg(F.sum("rainfall_mm").alias("mm")).withColumn("date", F.to_date("time"))
    want = win.rolling_maxima(cells, ["station_id", "date"], "time", "mm").select("station_id", "date", F.col("highest_30_min_rainfall_mm").alias("highest_mm"))
    maxima = live.drain(live.sliding_maxima(read(), 30))
    assert maxima.exceptAll(want).count() == 0 and maxima.count() == want.count()


def test_stream_totals_do_not_depend_on_files(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("s%d" % (i % 2), t0 + dt.timedelta(minutes=31 * i), float(i % 7)) for i in range(400)] + [("s9", t0 + dt.timedelta(days=30), 0.0)]
    order = random.Random(4).sample(range(len(rows)), len(rows))
    shuffled = spark.createDataFrame([rows[i] for i in order], live.READING_SCHEMA)
    shuffled.repartition(150).write.parquet(str(tmp_path / "many"))
    shuffled.coalesce(1).write.parquet(str(tmp_path / "one"))
    closed = shuffled.filter("station_id <> 's9'")
    for stream in (live.daily_totals, lambda r: live.sliding_maxima(r, 60)):
        many, one = (live.drain(stream(live.read_readings(spark, str(tmp_path / f)))) for f in ("many", "one"))
        assert sorted(map(str, many.collect())) == sorted(map(str, one.collect()))
    assert live.drain(live.daily_totals(live.read_readings(spark, str(tmp_path / "many")))).exceptAll(feeds.daily_totals(closed)).count() == 0


def test_update_mode_equals_complete(spark, tmp_path):
    folder, t0 = str(tmp_path / "r"), dt.datetime(2024, 1, 1)
    for k, s in enumerate(("A", "B", "A", "C")):
        spark.createDataFrame([(s, t0 + dt.timedelta(hours=k), float(k))], live.READING_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    errors = lambda n: live.read_readings(spark, folder, n).select("station_id", F.col("rainfall_mm").alias("error_mm"))
    show = lambda df: sorted(map(tuple, df.collect()))
    want = show(live.drain(live.running_metrics(errors(None)), mode="complete"))
    assert len(want) == 3
    for n in (1, 2, None):
        assert show(live.drain(live.running_metrics(errors(n)), mode="update", keys=("station_id",))) == want
    with pytest.raises(ValueError):
        live.drain(live.running_metrics(errors(1)), mode="update")


def test_joined_stream_feeds_metrics(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("s%d" % (i % 3), t0 + dt.timedelta(minutes=20 * i), float(i % 11)) for i in range(300)]
    spark.createDataFrame(rows, live.READING_SCHEMA).repartition(4).write.parquet(str(tmp_path / "r"))
    read = lambda: live.read_readings(spark, str(tmp_path / "r"))
    pred = read().select("station_id", (F.col("timestamp") - F.expr("interval 5 minutes")).alias("made_at"), (F.col("rainfall_mm") * 1.5).alias("predicted_mm"))
    errors = live.drain(live.error_stream(pred, read()), folder=str(tmp_path / "errors"))
    assert errors.count() == 300
    # the landed join is the next stream, a file a batch: update equals complete equals the batch aggregate
    errors.repartition(5).write.parquet(str(tmp_path / "again"))
    stream = lambda: live.running_metrics(spark.readStream.schema(errors.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "again")))
    show = lambda df: sorted((r.station_id, r.n, round(r.mae, 9), round(r.rmse, 9), round(r.bias, 9)) for r in df.collect())
    want = show(live.running_metrics(errors))
    assert len(want) == 3 and show(live.drain(stream(), mode="update", keys=("station_id",))) == show(live.drain(stream(), mode="complete")) == want
    # one query from both streams to the closed days
    closed = errors.filter(F.to_date("timestamp") < F.lit("2024-01-05"))
    daily = live.drain(live.daily_metrics(live.error_stream(pred, read())))
    batch = closed.groupBy("station_id", F.to_date("timestamp").alias("date")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("error_mm"), 6).alias("bias"))
    assert sorted(map(tuple, daily.select("station_id", "date", "n", F.round("bias", 6)).collect())) == sorted(map(tuple, batch.collect()))


def test_error_stream_meets_each_pair_once(spark, tmp_path):
    """Readings lie on and off the ends of spans; equal rows keep their number, rows without station or time meet none."""
    t0 = dt.datetime(2024, 1, 1)
    rows = [("s%d" % (i % 2), t0 + dt.timedelta(seconds=i * 150), float(i % 11)) for i in range(60)]
    rows += rows[5:8] + [(None, t0, 1.0), ("s0", None, 2.0), ("s1", t0, None)]
    df = spark.createDataFrame(rows, live.READING_SCHEMA)
    df.repartition(3).write.parquet(str(tmp_path / "r"))
    predicted = lambda r: r.select("station_id", (F.col("timestamp") - F.expr("interval 5 minutes")).alias("made_at"), (F.col("rainfall_mm") * 1.5).alias("predicted_mm"))
    read = lambda: live.read_readings(spark, str(tmp_path / "r"))
    for within in ("10 minutes", "1 hour 1 second", "0 seconds"):
        p, o = predicted(df).alias("p"), df.alias("o")
        bound = F.expr(f"p.station_id = o.station_id AND o.timestamp >= p.made_at AND o.timestamp <= p.made_at + interval {within}")
        want = p.join(o, bound).select("p.station_id", "made_at", "timestamp", "predicted_mm", "rainfall_mm", (F.col("predicted_mm") - F.col("rainfall_mm")).alias("error_mm"))
        got = live.drain(live.error_stream(predicted(read()), read(), within))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []


def test_error_stream_of_one_busy_station(spark, tmp_path):
    """A reading is compared with its neighbours in time: all pairs of the station would take minutes."""
    n, folder = 20000, str(tmp_path / "r")
    start = F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))
    spark.range(n).select(F.lit("s").alias("station_id"), F.timestamp_seconds(start + F.col("id") * 60).alias("timestamp"), (F.col("id") % 11).cast("double").alias("rainfall_mm")).write.parquet(folder)
    read = lambda: live.read_readings(spark, folder)
    pred = read().select("station_id", F.col("timestamp").alias("made_at"), F.col("rainfall_mm").alias("predicted_mm"))
    began = time.monotonic()
    assert live.drain(live.error_stream(pred, read())).count() == 11 * n - 55
    assert time.monotonic() - began < 60


def test_packs_and_blocks_hold_each_pair_once(spark, tmp_path, monkeypatch):
    """Blocks and packs of any size give the joined rows, in one batch or several; few rows land for many pairs."""
    t0 = dt.datetime(2024, 1, 1)
    rows = [("s%d" % (i % 2), t0 + dt.timedelta(seconds=i * 75), float(i % 11)) for i in range(120)]
    rows += rows[5:8] * 2 + [(None, t0, 1.0), ("s0", None, 2.0), ("s1", t0, None), ("s1", t0, float("nan"))]
    df = spark.createDataFrame(rows, live.READING_SCHEMA)
    df.repartition(3).write.parquet(str(tmp_path / "r"))
    predicted = lambda r: r.select("station_id", (F.col("timestamp") - F.expr("interval 5 minutes")).alias("made_at"), (F.col("rainfall_mm") * 1.5).alias("predicted_mm"))
    for pack, within, files, packed in ((1024, "10 minutes", None, True), (3, "10 minutes", 1, True), (3, "1 hour 1 second", None, True), (2, "10 minutes", 1, False)):
        monkeypatch.setattr(live, "PACK", pack, raising=False)
        read = lambda: live.read_readings(spark, str(tmp_path / "r"), files)  # noqa: E731, B023
        p, o = predicted(df).alias("p"), df.alias("o")
        bound = F.expr(f"p.station_id = o.station_id AND o.timestamp >= p.made_at AND o.timestamp <= p.made_at + interval {within}")
        want = p.join(o, bound).select("p.station_id", "made_at", "timestamp", "predicted_mm", "rainfall_mm", (F.col("predicted_mm") - F.col("rainfall_mm")).alias("error_mm"))
        got = live.drain(live.error_stream(predicted(read()), read(), within, delay="1 day", packed=packed))
        assert sorted(map(str, (live.error_pairs(got, within) if packed else got).collect())) == sorted(map(str, want.collect())) != []
        if pack == 1024:
            assert want.count() > 8 * got.count()


def test_join_takes_predictions_in_packs(spark, tmp_path):
    """The day's figures of a dense station come from few rows of the join; the day closes as with single rows."""
    t0, folder = dt.datetime(2024, 1, 1, 22), str(tmp_path / "r")
    rows = [("s", t0 + dt.timedelta(seconds=9 * i), float(i % 7)) for i in range(1400)]
    spark.createDataFrame(rows, live.READING_SCHEMA).coalesce(2).write.parquet(folder)
    read = lambda: live.read_readings(spark, folder)
    pred = read().select("station_id", (F.col("timestamp") - F.expr("interval 5 minutes")).alias("made_at"), F.col("rainfall_mm").alias("predicted_mm"))
    stream, seen = live.daily_metrics(live.error_stream(pred, read())), []
    query = stream.writeStream.format("memory").queryName("dense").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    for progress in query.recentProgress:
        seen += [o.numRowsUpdated for o in progress.stateOperators if o.operatorName == "symmetricHashJoin"]
    days = {str(r["date"]): r.n for r in spark.table("dense").collect()}
    n = sum(1 for i in range(800) for k in range(max(0, i - 33), min(1399, i + 33) + 1))
    assert days == {"2024-01-01": n} and max(seen) < 1400 + 200


def test_error_queries_land_no_pairs(spark, tmp_path, monkeypatch):
    """A busy station's pairs are many times its readings: what lands is not."""
    from skygauge.catalog import load

    t0, landed, drain = dt.datetime(2024, 1, 1), [], live.drain
    rows = [(i, t0 + dt.timedelta(seconds=i), "s", float(i % 7)) for i in range(1500)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))

    def noted(stream, *args, **kw):
        out = drain(stream, *args, **kw)
        landed.append(out.count())
        return out

    monkeypatch.setattr(live, "drain", noted)
    n = sum(min(i + 300, 1499) - max(i - 300, 0) + 1 for i in range(1500))
    assert load()["st03_error_stream"].build(spark, str(tmp_path)).count() == n > 500_000
    assert [r.n for r in load()["st04_running_metrics_stream"].build(spark, str(tmp_path)).collect()] == [n]
    assert max(landed) < 1500


def test_state_partitions_follow_the_rows(spark, tmp_path):
    """Few rows of state are not dealt into all the session's partitions, each of which would commit files; more rows are."""
    folder, t0, shuffle, cores = str(tmp_path / "r"), dt.datetime(2024, 1, 1), live.SHUFFLE, spark.sparkContext.defaultParallelism
    spark.createDataFrame([(s, t0, 1.0) for s in "ABAC"], live.READING_SCHEMA).coalesce(1).write.parquet(folder)
    before = spark.conf.get(shuffle)
    spark.conf.set(shuffle, 8 * cores)
    try:
        for rows, want in ((3, 2 * cores), (live.STATE_ROWS * 3 * cores + 1, 3 * cores + 1), (live.STATE_ROWS * 9 * cores, 8 * cores)):
            out = tmp_path / f"sink{want}"
            metrics = live.running_metrics(live.read_readings(spark, folder).select("station_id", F.col("rainfall_mm").alias("error_mm")))
            got = live.drain(metrics, mode="update", keys=("station_id",), folder=str(out), state_rows=rows)
            assert {r.station_id: r.n for r in got.collect()} == {"A": 2, "B": 1, "C": 1}
            assert sum(p.name.isdigit() for p in (out / "progress" / "state" / "0").iterdir()) == want
            assert spark.conf.get(shuffle) == str(8 * cores)
    finally:
        spark.conf.set(shuffle, before)


def test_metrics_queries_state_is_dealt_by_its_rows(spark, tmp_path, monkeypatch):
    """The join's state counts a reading three times (an observation, a prediction in two spans), the running figures' their stations."""
    from skygauge.catalog import load

    t0, seen, drain = dt.datetime(2024, 1, 1), [], live.drain
    rows = [(i, t0 + dt.timedelta(minutes=i), "s%d" % (i % 3), float(i)) for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))

    def noted(*args, **kw):
        if kw.get("state_rows") is not None:
            seen.append(kw["state_rows"])
        return drain(*args, **kw)

    monkeypatch.setattr(live, "drain", noted)
    for name, want in (("st04_daily_metrics_stream", [180]), ("st04_running_metrics_stream", [180, 3])):
        seen.clear()
        load()[name].build(spark, str(tmp_path)).count()
        assert seen == want


def test_restarted_drain_goes_on(spark, tmp_path):
    folder, t0 = str(tmp_path / "r"), dt.datetime(2024, 1, 1)
    metrics = lambda: live.running_metrics(live.read_readings(spark, folder).select("station_id", F.col("rainfall_mm").alias("error_mm")))
    drain = lambda: {r.station_id: r.n for r in live.drain(metrics(), mode="update", keys=("station_id",), folder=str(tmp_path / "sink")).collect()}
    for names, want in ((["A", "B"], {"A": 1, "B": 1}), (["B", "C"], {"A": 1, "B": 2, "C": 1}), ([], {"A": 1, "B": 2, "C": 1})):
        if names:
            spark.createDataFrame([(s, t0, 1.0) for s in names], live.READING_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        assert drain() == want


def test_upsert_rewrites_touched_partitions_only(spark, tmp_path):
    schema = spark.createDataFrame([], "k int, v int").schema
    t = UpsertTable(spark, str(tmp_path / "t"), schema, ["k"], parts=8)
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    t.upsert(rows(*((i, 0) for i in range(40))), 0)
    first = t._manifest()
    t.upsert(rows((3, 9), (100, 1)), 4)
    second = t._manifest()
    assert 0 < sum(second[p] == 4 for p in second) <= 2 and all(second[p] in (first.get(p), 4) for p in second)
    t.upsert(rows((3, 9), (100, 1)), 4)  # a repeated batch
    t.upsert(rows(), 5)
    assert {r.k: r.v for r in t.read().collect()} == {i: 0 for i in range(40)} | {3: 9, 100: 1}
    assert UpsertTable(spark, str(tmp_path / "t"), schema, ["k"], parts=8).read().count() == 41
    assert UpsertTable(spark, str(tmp_path / "none"), schema, ["k"]).read().count() == 0


def test_every_request_is_answered_or_rejected_once(spark):
    day = lambda n: dt.date(2020, 1, n)
    train = spark.createDataFrame([("a", day(1), 1.0), ("a", day(2), 2.0)], "location string, date date, t double")
    test = spark.createDataFrame([("a", day(2), 20.0), ("a", day(3), 30.0)], "location string, date date, t double")
    feed = spark.createDataFrame([("a", day(4), 4.0, 1)], "location string, date date, t double, more int")
    seen = spark.createDataFrame([("a", day(1), 1.5), ("a", day(2), 2.5), ("a", day(4), 0.0), ("a", day(3), None)], "location string, date date, observed_mm double")
    asked = [("a", "2020-01-01"), ("a", "2020-01-02"), ("a", "2020-01-02"), ("a", "2020-01-03"), ("a", "2020-01-04"), ("b", "2020-01-01"), (None, "2020-01-01"), ("a", None), ("a", "01/01/2020")]
    out = fc.answer_requests(spark.createDataFrame(asked, "location string, date string"), [("train_dataset", train), ("test_dataset", test), ("open_meteo", feed)],
                             lambda df: df.withColumn("predicted_daily_rainfall_mm", F.col("t")), seen).collect()
    assert sorted(map(str, ((r.location, r.date) for r in out))) == sorted(map(str, asked))
    assert all((r.response is None) != (r.reason is None) for r in out)
    got = {(r.location, r.date): r.reason or (r.response.prediction.daily_rainfall_mm, r.response.comparison.error_mm, r.response.meta.feature_source) for r in out}
    assert got == {
        ("a", "2020-01-01"): (1.0, -0.5, "train_dataset"), ("a", "2020-01-02"): (2.0, -0.5, "train_dataset"), ("a", "2020-01-04"): (4.0, 4.0, "open_meteo"),
        ("a", "2020-01-03"): "Observed rainfall not available for this date", ("b", "2020-01-01"): "No features for this location and date",
        (None, "2020-01-01"): "location required", ("a", None): "date required", ("a", "01/01/2020"): "date is not yyyy-MM-dd"}


def test_late_reading_is_dropped(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    folder = str(tmp_path / "r")
    at = lambda **kw: t0 + dt.timedelta(**kw)
    # a batch drops what was late before it began, so the late row comes two batches after the jump
    batches = [[("s", t0, 1.0)], [("s", at(days=3), 2.0)], [("s", at(days=3, hours=1), 3.0)], [("s", at(hours=1), 50.0)], [("s", at(days=9), 0.0)]]
    for b in batches:  # one file each, in order
        spark.createDataFrame(b, live.READING_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    got = {str(r["date"]): r["daily_rainfall_total_mm"] for r in live.drain(live.daily_totals(live.read_readings(spark, folder, 1))).collect()}
    assert got["2024-01-01"] == 1.0 and got["2024-01-04"] == 5.0


def test_weather_table_is_unique(spark):
    w = ad.weather(spark, SMALL)
    assert w.count() == w.select("location", "date").distinct().count()
