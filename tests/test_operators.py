import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from skygauge.functions import calendar as cal
from skygauge.functions import evaluation as ev
from skygauge.functions import text
from skygauge.functions import weather as wx
from skygauge.operators import cleaning as cl
from skygauge.operators import correlation as co
from skygauge.operators import encoding as en
from skygauge.operators import joins as jn
from skygauge.operators import metrics as m
from skygauge.operators import ordering as od
from skygauge.operators import spines as sp
from skygauge.operators import validation as va
from skygauge.operators import wide
from skygauge.operators import windows as win

D = dt.date


def col(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def test_right_closed_bins(spark):
    df = col(spark, [0.0, 5.0, 5.0001, 100.0, 101.0, -1.0, None])
    got = [r[0] for r in df.select(wx.right_closed_bin(F.col("v"), wx.RANGE_BINS)).collect()]
    assert got == [0, 0, 1, 4, None, None, None]


def lag_frame(spark):
    rows = [("a", D(2020, 1, i + 1), float(v)) for i, v in enumerate([1, 2, 3])]
    rows += [("b", D(2020, 1, i + 1), float(v)) for i, v in enumerate([10, 20, 30])]
    return spark.createDataFrame(rows, "location string, date date, x double")


@pytest.mark.parametrize("bleed, want", [(False, [None, 1, 1.5, None, 10, 15]), (True, [None, 1, 1.5, 2, 10, 15])])
def test_rolling_over_group_borders(spark, bleed, want):
    out = win.lag_rolling(lag_frame(spark), [("x", [2])], bleed=bleed, chunk=2).orderBy("location", "date")
    assert [r["x_roll_mean_2"] for r in out.collect()] == want


def test_frame_scope_lag_crosses_stations(spark):
    out = win.lag_features(lag_frame(spark), 1, ["x"], scope="frame", chunk=2).orderBy("date", "location")
    assert [r["x_lag1"] for r in out.collect()] == [1, 1, 10, 2, 20, 3]


def test_lag_rolling_fill_and_delta(spark):
    out = win.lag_rolling(lag_frame(spark), [("x", [1, 7])], target="x", fill_value=0.0, keep_delta=True)
    assert "target_lag_7_minus_1" in out.columns and out.filter("x_lag_1 IS NULL OR delta_days IS NULL").count() == 0


def test_weekly_mart(spark):
    rows = [("a", D(2009, 12, 26), 1.0), ("a", D(2009, 12, 31), 2.0), ("a", D(2010, 1, 1), 3.0), ("a", D(2010, 1, 20), 4.0)]
    df = spark.createDataFrame(rows, "location string, date date, v double").withColumn("year", F.year("date"))
    got = [(r["year"], r["date"], r["v"]) for r in sp.weekly_mart(df, ["v"]).orderBy("year", "date").collect()]
    assert got == [(2009, D(2009, 12, 27), 1), (2009, D(2010, 1, 3), 2), (2010, D(2010, 1, 3), 3),
                   (2010, D(2010, 1, 10), None), (2010, D(2010, 1, 17), None), (2010, D(2010, 1, 24), 4)]


def test_discrete_p90(spark):
    df = spark.range(1, 25).selectExpr("id AS n", "explode(sequence(1, id)) AS x")
    got = m.with_group_threshold(df, ["n"], "x").groupBy("n").agg(F.first("p90").alias("p")).orderBy("n")
    assert [r["p"] for r in got.collect()] == [1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 18, 19, 20, 21, 22]


def test_correlation_of_one_row_or_constant_is_null(spark):
    df = spark.createDataFrame([("one", 1.0, 2.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("line", 1.0, 2.0), ("line", 2.0, 4.0)], "g string, a double, b double")
    got = dict(df.groupBy("g").agg(m.pair_corr(F.col("a"), F.col("b"))).collect())
    assert got["one"] is None and got["flat"] is None and math.isclose(got["line"], 1)


def test_correlation_matrix_over_several_blocks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, f"c{j:03d}", rng.gauss(50, 5)) for i in range(12) for j in range(70) if rng.random() > 0.2]
    df = spark.createDataFrame(rows, "r int, c string, v double")
    got = {(r["a"], r["b"]): (r["n"], r["corr"]) for r in co.correlation_matrix(df, "r", "c", "v").collect()}
    x = df.alias("x").join(df.alias("y"), "r").groupBy(F.col("x.c").alias("a"), F.col("y.c").alias("b")).agg(
        F.count(F.lit(1)).alias("n"), m.pair_corr(F.col("x.v"), F.col("y.v")).alias("corr"))
    want = {(r["a"], r["b"]): (r["n"], r["corr"]) for r in x.collect()}
    assert got.keys() == want.keys()
    for k, (n, c) in want.items():
        assert got[k][0] == n and (c is None) == (got[k][1] is None)
        assert c is None or abs(c - got[k][1]) < 1e-9


def test_global_quantiles_are_exact(spark):
    rng = random.Random(5)
    vals = [round(rng.random() * 10, 1) for _ in range(999)] + [None] * 5
    df = col(spark, vals).repartition(7)
    got = od.global_quantiles(df, "v", [0.0, 0.5, 0.93, 1.0], list("abcd")).first()
    s = sorted(v for v in vals if v is not None)
    for name, p in zip("abcd", [0.0, 0.5, 0.93, 1.0]):
        pos = p * (len(s) - 1)
        lo, hi = s[math.floor(pos)], s[math.ceil(pos)]
        assert math.isclose(got[name], lo + (hi - lo) * (pos - math.floor(pos)))


def test_ordinal_and_prefix_sums(spark):
    df = spark.range(1000).selectExpr("id", "(id * 7919) % 1000 AS k").repartition(9)
    assert od.with_ordinal(df, ["k"]).filter("ordinal <> k").count() == 0
    assert od.prefix_sums(df, ["k"], {"s": "k"}).filter("s <> k * (k + 1) / 2").count() == 0


def test_nearest_point_equals_brute_force(spark):
    rng = random.Random(11)
    right = [(i, rng.uniform(-60, 60), rng.uniform(-170, 170)) for i in range(60)] + [(100, 1.3, 103.8), (101, 1.3, 103.8)]
    left = [(i, rng.uniform(-80, 80), rng.uniform(-179.9, 179.9)) for i in range(25)] + [(99, 1.31, 103.8)]
    r = spark.createDataFrame(right, "g int, latitude double, longitude double")
    s = spark.createDataFrame(left, "s int, latitude double, longitude double")
    got = {x["s"]: x["g"] for x in jn.nearest_point(s, r, "s", "g", cell_deg=0.5).collect()}

    def km(a, b):
        la, lo, lb, mo = map(math.radians, (a[1], a[2], b[1], b[2]))
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((mo - lo) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h))

    assert got == {a[0]: min(right, key=lambda b: (round(km(a, b), 9), b[0]))[0] for a in left}


def test_neighbor_null_rule(spark):
    rows = [("a", D(2020, 1, 2), 1.0), ("b", D(2020, 1, 1), 4.0), ("b", D(2020, 1, 2), None), ("c", D(2020, 1, 2), 6.0)]
    df = spark.createDataFrame(rows, "location string, date date, x double")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "a")], "location string, neighbor string")
    out = {(r["location"], r["date"].day): r for r in jn.neighbor_stats(df, edges, "x").collect()}
    assert out["a", 2]["neighbor_x_mean_lag0"] is None  # b is present and null
    assert out["a", 2]["neighbor_x_mean_lag1"] == 4.0  # c is absent on the day before
    assert out["c", 2]["neighbor_x_max_lag0"] == 1.0 and out["b", 2]["neighbor_x_mean_lag0"] is None


def test_external_rows_must_be_unique(spark):
    df = lag_frame(spark)
    ext = spark.createDataFrame([(D(2020, 1, 1), 1.0), (D(2020, 1, 1), 2.0)], "date date, ONI double")
    with pytest.raises(ValueError):
        jn.add_external(df, ext)


def test_month_expansion_repeats_double_rows(spark):
    df = spark.createDataFrame([(D(2020, 2, 10), 1.0), (D(2020, 2, 20), 2.0)], "date date, v double")
    assert sp.align_to_daily(df).count() == 58


def test_fill_order_and_causal(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([None, 1.0, None, 3.0, None])], "date int, v double")
    assert [r["v"] for r in win.fill_ordered(df, ["v"]).orderBy("date").collect()] == [1, 1, 3, 3, 3]
    assert [r["v"] for r in win.fill_ordered(df, ["v"], causal=True).orderBy("date").collect()] == [None, 1, 1, 3, 3]


def test_sigmoid_of_one_day_is_null(spark):
    assert cal.add_time_sigmoid(spark.createDataFrame([(D(2020, 1, 1),)], "date date")).first()["time_sigmoid"] is None


def test_day_floor_with_cutoff(spark):
    df = spark.createDataFrame([("2020-01-01 23:14:59",), ("2020-01-01 23:45:00",)], "t string").select(F.to_timestamp("t").alias("t"))
    got = [r[0] for r in df.select(cal.floor_day(F.col("t"), 23, 15)).collect()]
    assert got == [D(2020, 1, 1), D(2020, 1, 2)]


def test_unfinite_ratio_is_one(spark):
    df = spark.createDataFrame([(4.0, 2.0), (1.0, 0.0), (0.0, 0.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(wx.ratio_or_one(F.col("a"), F.col("b"))).collect()] == [2, 1, 1, 1]


def test_interactions_stop_at_a_missing_column(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "mean_wind_speed_kmh double, highest_60_min_rainfall_mm double, mean_temperature_c double, ONI double")
    assert [c for c in wx.interaction_features(df).columns if "_x_" in c] == ["wind_x_rain", "ONI_x_temp"]


def test_unseen_encoding_cell_takes_global_mean(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 1, None), ("b", 1, 30.0), ("b", 2, None)], "location string, month int, y double")
    cells, overall = en.fit_target_encoding(df, "y")
    new = spark.createDataFrame([("a", 1), ("b", 2), ("z", 9)], "location string, month int")
    got = {r["location"]: r["te_location_month"] for r in en.apply_target_encoding(new, cells, overall).collect()}
    assert math.isclose(got["a"], (10 + 20 * 50) / 51) and got["b"] == 20 and got["z"] == 20


def test_evaluation_classes(spark):
    df = spark.createDataFrame([(1.0, 0.0), (9.0, 1.0), (10.0, 10.0), (20.0, 40.0), (30.0, 20.0)], "p double, o double")
    r = df.select(*[c.alias(n) for n, c in ev.evaluation_columns(F.col("p"), F.col("o")).items()]).collect()
    assert [(x["direction"], x["regime"], x["severity"]) for x in r] == [
        ("overprediction", "drizzle", "low"), ("overprediction", "drizzle", "moderate"), ("exact", "moderate", "low"),
        ("underprediction", "heavy", "moderate"), ("overprediction", "moderate", "moderate")]
    assert r[0]["relative_error_pct"] == 100.0 and r[2]["insight_text"].startswith("Prediction is highly reliable")


def test_kpi_and_percent(spark):
    k = [r[0] for r in col(spark, [1.234, None, float("nan")]).select(ev.kpi(F.col("v"), "mm")).collect()]
    assert (k[0]["text"], k[0]["unit"]) == ("1.23", "mm") and k[1]["text"] == k[2]["text"] == "Not Available" and k[2]["num"] is None
    p = [tuple(r[0]) for r in col(spark, [12.4, -3.0, None, float("inf")]).select(ev.signed_pct(F.col("v"))).collect()]
    assert p == [("+12%", ""), ("-3%", "negative"), ("", ""), ("", "")]


def test_response_without_observation(spark):
    r = spark.range(1).select(ev.response(F.lit("forecast"), F.lit("X"), F.lit("2020-01-01"), F.lit(1.23456), F.lit("open_meteo"), F.lit("n")).alias("r")).first()["r"]
    assert r["prediction"]["daily_rainfall_mm"] == 1.235 and r["comparison"] is None and r["meta"]["notes"] == ["n"]


def test_headers_and_ids(spark):
    assert text.clean_header("﻿Mean Temperature (Â°C)") == "mean_temperature_c"
    assert text.clean_header(" Max Wind Speed (km/h)") == "max_wind_speed_kmh"
    df = spark.createDataFrame([("ang_mo_kio_2009", 3, 7), ("kent_2009_03_07", 3, 7), ("nothing", 1, 1)], "i string, m int, d int")
    got = [tuple(r) for r in df.select(text.repair_id(F.col("i"), F.col("m"), F.col("d")), text.rebuild_id(F.col("i"), F.col("m"), F.col("d"))).collect()]
    assert got == [("ang_mo_kio_2009_03_07",) * 2, ("kent_2009_03_07",) * 2, ("nothing_01_01", None)]


def test_numbers_from_debris(spark):
    df = spark.createDataFrame([("1.5", "a"), ("\u0097", "b"), ("NaN", "c"), ("", "d"), (None, "e")], "x string, location string")
    assert [r["x"] for r in cl.convert_numeric(df, ["x", "location", "absent"]).collect()] == [1.5, None, None, None, None]


def test_requests_with_numbers(spark):
    df = spark.createDataFrame([("A", "2020-01-01", "1"), ("A", "2020-01-01", "x"), ("", "2020-01-01", "1"), ("A", "01/02/2020", "1")], "location string, date string, v string")
    good, bad = cl.validate_requests(df, ["v"])
    assert good.first()["v"] == 1.0 and good.count() == 1
    assert sorted(r["reason"] for r in bad.collect()) == ["date is not yyyy-MM-dd", "location required", "v is not a number"]


def test_time_folds_match_the_rule(spark):
    rows = [("l%d" % (i % 3), D(2020, 1, 1) + dt.timedelta(days=i // 3)) for i in range(31)]
    out = va.time_ordered_folds(spark.createDataFrame(rows, "location string, date date"), 4)
    n, size = 31, 31 // 5
    for r in out.collect():
        want = next((i for i in range(1, 5) if n - (5 - i) * size <= r["ordinal"] < n - (4 - i) * size), 0)
        assert r["test_fold"] == want


def test_ranking_scores_with_ties(spark):
    rng = random.Random(2)
    rows = [(round(rng.random(), 1), int(rng.random() < 0.4)) for _ in range(200)]
    got = va.ranking_scores(va.score_levels(spark.createDataFrame(rows, "p double, y int"), "p", "y")).first()
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert math.isclose(got["roc_auc"], auc) and math.isclose(got["base_rate"], len(pos) / 200)
    ap, seen = 0.0, 0
    for s in sorted({p for p, _ in rows}, reverse=True):
        tp, k = sum(p >= s for p in pos), sum(p >= s for p, _ in rows)
        ap += (tp - seen) / len(pos) * tp / k
        seen = tp
    assert math.isclose(got["average_precision"], ap)


def test_blend_weight_equals_direct_search(spark):
    rng = random.Random(4)
    rows = [(rng.random(), rng.random(), rng.random()) for _ in range(50)]
    g = va.blend_weights(spark.createDataFrame(rows, "a double, b double, y double"), "a", "b", "y", steps=101)
    w = va.best_blend(g).first()
    want = min(range(101), key=lambda i: sum((i / 100 * a + (1 - i / 100) * b - y) ** 2 for a, b, y in rows))
    assert math.isclose(w["best_w"], want / 100)


def test_histogram_with_zero_maximum_has_one_bin(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 2.0), ("b", 0.2)], "g string, v double")
    got = sorted((r["g"], r["bin"], r["n"], r["label"]) for r in m.histogram(df, ["g"], "v").collect())
    assert got == [("a", 0, 1, "0.0–1.0"), ("b", 0, 1, "0.0–1.0"), ("b", 1, 1, "1.0–2.0")]


def test_column_quantiles_of_one_sort(spark):
    rng = random.Random(6)
    rows = [(float(rng.randint(0, 9)), rng.choice([None, float("nan"), rng.random()]), None, i) for i in range(301)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d int").repartition(5)
    got = {r.column: r.q for r in od.column_quantiles(df, ["a", "b", "c", "d"], [0, 0.25, 0.5, 0.9, 1]).collect()}
    assert set(got) == {"a", "b", "d"}  # c holds nothing
    for k, c in enumerate("abd"):
        vals = sorted(v for r in rows for v in [r["abcd".index(c)]] if v is not None and v == v)
        for p, q in zip([0, 0.25, 0.5, 0.9, 1], got[c]):
            pos = (len(vals) - 1) * p
            lo, hi = vals[math.floor(pos)], vals[math.ceil(pos)]
            assert q == pytest.approx(lo + (hi - lo) * (pos - math.floor(pos)))
    one = en.global_medians(df, ["a", "c"]).first()
    assert one.a_all == pytest.approx(got["a"][2]) and one.c_all is None
    plan = od.column_quantiles(df, ["a", "b", "d"], [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan  # the one sort is written before


def test_correlation_of_many_columns(spark, monkeypatch):
    rng = random.Random(1)
    n_cols, data = 200, {}
    for r in range(40):
        base = rng.random()
        for c in range(n_cols):
            if rng.random() < 0.7:
                data[r, c] = base * (c % 3 - 1) + rng.random()
    df = spark.createDataFrame([(r, f"c{c:03d}", v) for (r, c), v in data.items()], "r int, c string, v double")
    got = {(x.a, x.b): (x.n, x["corr"]) for x in co.correlation_matrix(df, "r", "c", "v").collect()}
    wide_ = pd.DataFrame([(r, f"c{c:03d}", v) for (r, c), v in data.items()], columns=["r", "c", "v"]).pivot(index="r", columns="c", values="v")
    want, both = wide_.corr(min_periods=2), wide_.notna().astype(int)
    both = both.T @ both
    for a in wide_.columns:
        for b in wide_.columns:
            n, corr = got.get((a, b), (0, None))
            assert n == both.loc[a, b]
            assert (corr is None and pd.isna(want.loc[a, b])) or corr == pytest.approx(want.loc[a, b], abs=1e-9)


def test_pivot_by_position(spark):
    rows = [("x", f"k{i}", i, float(i)) for i in range(0, 300, 2)] + [("y", "k1", 0, 5.0), ("y", "k1", 0, 7.0), ("z", None, 0, 1.0)]
    df = spark.createDataFrame(rows, "r string, c string, i int, v double")
    names = wide.column_dictionary(df, "c")
    at = {r.name: r.position for r in names.collect()}
    assert sorted(at, key=at.get) == sorted({r[1] for r in rows if r[1]})  # a null is no column
    out = wide.pivot_positions(df, "r", "c", F.sum("v"), names)
    got = {r.r: r.cells for r in out.collect()}
    assert set(got) == {"x", "y"} and all(len(c) == 151 for c in got.values())
    assert got["y"][at["k1"]] == 12 and sum(v is not None for v in got["y"]) == 1 and got["x"][at["k298"]] == 298
    back = sorted(map(tuple, wide.unpivot_positions(out, "r", names).collect()))
    assert back == sorted([(r, c, v) for r, c, _, v in rows[:150]] + [("y", "k1", 12.0)])


def test_look_up_keeps_every_request(spark):
    x = spark.createDataFrame([("a", D(2020, 1, k), float(k)) for k in (1, 2, 3)], "location string, date date, v double")
    asked = spark.createDataFrame([("a", D(2020, 1, 1)), ("a", D(2020, 1, 3)), ("a", D(2020, 1, 3)), ("b", D(2020, 1, 1)), (None, None)], "location string, date date")
    out = cl.look_up(asked, [("first", x.filter("v < 3")), ("second", x.filter("v > 1"))]).collect()
    got = sorted(((r.location, str(r.date), r.v, r.feature_source, r.reason) for r in out), key=str)
    none = (None, None, "no source has these keys")
    assert got == sorted([("a", "2020-01-01", 1.0, "first", None), *[("a", "2020-01-03", 3.0, "second", None)] * 2, ("b", "2020-01-01", *none), (None, "None", *none)], key=str)


def test_forecast_window(spark):
    today = D(2020, 2, 20)
    df = spark.createDataFrame([(None,), (D(2020, 2, 19),), (today,), (D(2020, 3, 5),), (D(2020, 3, 6),)], "d date")
    got = [r[0] for r in df.select(ev.forecast_reason(F.col("d"), F.lit(today))).collect()]
    text = "Forecast date must be between 2020-02-20 and 2020-03-05"
    assert got == ["date required", text, None, None, text]
