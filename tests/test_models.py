"""Grouped boosting, Huber boosting, pruned folds and forecasts per station."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from skygauge.model import selection as sel
from skygauge.model.grouped import GroupedBoosting, GroupedBoostingModel, GroupedTwoStage, GroupedTwoStageModel
from skygauge.model.huber import HuberBoosting, HuberBoostingModel
from skygauge.operators.validation import fold_parts

D0 = dt.date(2020, 1, 1)
BOOST = {"trees": 2, "depth": 2, "step_size": 0.8, "bins": 8, "min_weight": 2.0}


def station_rows(spark):
    rng = np.random.default_rng(4)
    rows = []
    for name, slope, n in (("a", 3.0, 80), ("b", -2.0, 60), ("c", 0.0, 3)):
        for i in range(n):
            x, z = float(rng.integers(0, 10)), None if i % 9 == 0 else float(i % 4)
            rows.append((name, D0 + dt.timedelta(days=i), x, z, max(0.0, slope * x + (z or 7.0)), 1.0 + i % 2))
    return spark.createDataFrame(rows, "location string, date date, x double, z double, y double, w double")


@pytest.mark.parametrize("loss", ["squared", "logistic"])
def test_groups_do_not_see_each_other(spark, loss):
    df = station_rows(spark).withColumn("t", F.col("y") if loss == "squared" else (F.col("y") > 8).cast("double"))
    est = GroupedBoosting(features=["x", "z"], label="t", weight="w", loss=loss, **BOOST)
    key = lambda r: (r.location, r.date)
    together = {key(r): r.prediction for r in est.fit(df).transform(df).collect()}
    for name in ("a", "c"):
        own = df.filter(F.col("location") == name)
        alone = {key(r): r.prediction for r in est.fit(own).transform(own).collect()}
        assert {k: v for k, v in together.items() if k[0] == name} == pytest.approx(alone)
    rows = [r for r in df.collect() if r.location != "c"]
    if loss == "squared":
        flat = {n: np.average([r.t for r in rows if r.location == n], weights=[r.w for r in rows if r.location == n]) for n in "ab"}
        assert sum((together[key(r)] - r.t) ** 2 for r in rows) < 0.4 * sum((flat[r.location] - r.t) ** 2 for r in rows)
    else:
        assert all(0 < p < 1 for p in together.values()) and sum((together[key(r)] > 0.5) == (r.t == 1) for r in rows) > 0.8 * len(rows)


def tree_by_hand(rows, l2, min_weight):
    """One split over all (feature, value) borders and sides for the missing, the best by gain."""
    g = [r["y"] - r["f"] for r in rows]
    best = (0.0,)
    for j in ("x", "z"):
        for cut in sorted({r[j] for r in rows if r[j] is not None})[:-1]:
            for missing_left in (False, True):
                left = [missing_left if r[j] is None else r[j] <= cut for r in rows]
                gl, nl = sum(a for a, s in zip(g, left) if s), sum(left)
                gr, nr = sum(g) - gl, len(rows) - nl
                if min(nl, nr) >= min_weight:
                    gain = gl**2 / (nl + l2) + gr**2 / (nr + l2) - sum(g) ** 2 / (len(rows) + l2)
                    best = max(best, (round(gain, 6), [gl / (nl + l2) if s else gr / (nr + l2) for s in left]), key=lambda b: b[0])
    return best


def test_one_split_equals_the_best_by_hand(spark):
    df = station_rows(spark).filter("location = 'a'")
    rows = [r.asDict() for r in df.collect()]
    base = sum(r["y"] for r in rows) / len(rows)
    gain, values = tree_by_hand([r | {"f": base} for r in rows], 1.0, 2.0)
    m = GroupedBoosting(features=["x", "z"], label="y", trees=1, depth=1, step_size=1.0, bins=64, min_weight=2.0, subsample=1.0).fit(df)
    got = {r.date: r.prediction for r in m.transform(df).collect()}
    assert [got[r["date"]] for r in rows] == pytest.approx([base + v for v in values]) and gain > 0


def test_grouped_edges(spark, tmp_path):
    df = station_rows(spark)
    df = df.unionByName(df.limit(1).withColumns({"location": F.lit("n"), "y": F.lit(None).cast("double")}))
    m = GroupedBoosting(features=["x", "z"], label="y", **BOOST).fit(df)
    m.save(str(tmp_path / "m"))
    again = GroupedBoostingModel.load(str(tmp_path / "m"))
    new = df.withColumn("x", F.when(F.col("date") == F.lit(D0), float("nan")).otherwise(F.col("x") * 100))  # outside the cuts, NaN
    a, b = (sorted((r.location, r.date, r.prediction if r.prediction is not None else -1) for r in k.transform(new).collect()) for k in (m, again))
    assert a == b and [x[2] for x in a if x[0] == "n"] == [-1] and len(a) == df.count()
    with pytest.raises(ValueError, match="loss"):
        GroupedBoosting(loss="other")
    two = GroupedTwoStage("y", ["x", "z"], threshold=1.0, weight="w", **BOOST)
    dry = df.filter("location <> 'n'").withColumn("y", F.when(F.col("location") == "c", 0.0).otherwise(F.col("y")))
    fitted = two.fit(dry)
    fitted.save(str(tmp_path / "two"))
    out = GroupedTwoStageModel.load(str(tmp_path / "two")).transform(dry).collect()
    assert all(r.prediction == 0 for r in out if r.location == "c") and max(r.prediction for r in out if r.location == "a") > 10
    assert sorted(out) == sorted(fitted.transform(dry).collect())


def test_per_location_scores_fit_all_folds_together(spark):
    df = station_rows(spark).filter("location <> 'c'")
    got = {r.location: r for r in sel.per_location_scores(df, ["x", "z"], "y", k=2, **BOOST).collect()}
    rows = {n: sorted((r for r in df.collect() if r.location == n), key=lambda r: r.date) for n in "ab"}
    for name, own in rows.items():
        size, scores = len(own) // 3, []
        for fold in range(2):  # each fold fitted on its own rows alone
            cut = len(own) - (2 - fold) * size
            train, test = own[:cut], own[cut : cut + size]
            m = GroupedBoosting(features=["x", "z"], label="y", **BOOST).fit(spark.createDataFrame(train, df.schema))
            p = m.transform(spark.createDataFrame(test, df.schema)).collect()
            scores.append(math.sqrt(sum((r.prediction - r.y) ** 2 for r in p) / size))
        assert got[name].mean_rmse == pytest.approx(sum(scores) / 2)
        assert got[name].normalized_rmse == pytest.approx(sum(scores) / 2 / np.std([r.y for r in own], ddof=1))


def test_folds_read_their_own_files(spark):
    folds = sel.landed_folds(station_rows(spark), 4)
    train, test = fold_parts(folds, 2)
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(test_fold" in plan and "PushedFilters: []" in plan
    folder = lambda f: int(f.split("test_fold=")[1].split("/")[0])
    assert {folder(f) for f in train.inputFiles()} == {0, 1, 2, 3, 4}  # listed
    assert {r.test_fold for r in train.collect()} == {0, 1} and {r.test_fold for r in test.collect()} == {2}


def test_huber_pulls_less_towards_outliers(spark, tmp_path):
    rows = [(float(i % 20), 2.0 * (i % 20) + (500.0 if i % 40 == 7 else 0.0)) for i in range(400)] + [(1.0, None)]
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.createDataFrame(rows, "x double, y double"))
    size = {"maxIter": 6, "maxDepth": 3, "stepSize": 0.4}
    fit = lambda alpha: HuberBoosting(label="y", alpha=alpha, **size).fit(df)
    at = lambda m: {r.x: r.prediction for r in m.transform(df).collect()}
    huber, squared = at(fit(0.9)), at(fit(1.0))  # with alpha 1 no residual is held: squared loss
    truth = 2.0 * 7
    assert abs(huber[7.0] - truth) < 0.5 * abs(squared[7.0] - truth) and squared[7.0] > truth + 50
    m = HuberBoosting(label="y", maxIter=2, maxDepth=3).fit(df)
    m.save(str(tmp_path / "h"))
    assert at(HuberBoostingModel.load(str(tmp_path / "h"))) == at(m)
    none = HuberBoosting(label="y", **size).fit(df.filter("y is null"))
    assert none.transform(df.limit(1)).first().prediction is None


def test_calibration_is_clipped(spark):
    df = spark.createDataFrame([(float(i), float(i % 5) - 3) for i in range(60)], "p double, y double")
    out = sel.robust_calibrate(df, "p", "y", maxIter=2, maxDepth=2).collect()
    assert min(r.calibrated for r in out) >= 0 and "_cal" not in out[0].asDict()
