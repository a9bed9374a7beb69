"""Cross-validation, tuning, stacking and calibration over Spark ML models."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skygauge.model.grouped import GroupedBoosting
from skygauge.model.huber import HuberBoosting
from skygauge.operators.validation import fold_parts, threshold_report, time_ordered_folds
from skygauge.session import land


def regression_scores(df: DataFrame, y: str, pred: str) -> dict:
    e = F.col(pred) - F.col(y)
    mae, rmse = df.dropna(subset=[y, pred]).agg(F.avg(F.abs(e)), F.sqrt(F.avg(e * e))).first()
    return {"mae": mae, "rmse": rmse}


def landed_folds(df: DataFrame, k: int = 5, order: Sequence[str] = ("date", "location")) -> DataFrame:
    """Time-ordered folds, written one folder per fold: a filter on ``test_fold`` reads the folders it needs and no others."""
    return land(time_ordered_folds(df, k, order), "folds", by=["test_fold"])


def time_series_cv(df: DataFrame, estimator: Estimator, y: str, pred: str = "prediction", k: int = 5, parallelism: int = 2) -> DataFrame:
    """MAE and RMSE per time-ordered fold; a few fits run at a time, each as distributed jobs over the files of its folds."""
    folds = landed_folds(df, k)

    def one(i: int) -> tuple:
        train, test = fold_parts(folds, i)
        s = regression_scores(estimator.fit(train).transform(test), y, pred)
        return i, s["mae"], s["rmse"]

    with ThreadPool(parallelism) as pool:
        rows = pool.map(one, range(1, k + 1))
    return df.sparkSession.createDataFrame(rows, "fold int, mae double, rmse double")


def grid_search_recall(folds: DataFrame, make, grid: Sequence[dict], label: str, k: int, score_col, parallelism: int = 4) -> DataFrame:
    """Mean recall of the wet class per parameter set over time-ordered folds; best first.

    ``make(params)`` gives an estimator, ``score_col`` a column with the wet probability. ``folds``
    comes from ``landed_folds``, so a fit reads its own part.
    """
    def one(job: tuple[int, int]) -> tuple[int, float]:
        n, i = job
        train, test = fold_parts(folds, i)
        p = make(grid[n]).fit(train).transform(test).withColumn("_p", score_col)
        return n, threshold_report(p, "_p", label, [0.5]).first()["recall_rain"] or 0.0

    with ThreadPool(parallelism) as pool:
        found = pool.map(one, [(n, i) for n in range(len(grid)) for i in range(1, k + 1)])
    rows = [(n, str(sorted(params.items())), sum(r for m, r in found if m == n) / k) for n, params in enumerate(grid)]
    out = folds.sparkSession.createDataFrame(rows, "candidate int, params string, recall double")
    return out.orderBy(F.desc("recall"), "candidate")


def per_location_scores(df: DataFrame, features: Sequence[str], y: str, k: int = 5, location: str = "location", date: str = "date", **boost) -> DataFrame:
    """Mean fold RMSE of a boosted model per station, also over the station's standard deviation.

    Folds are time-ordered within each station (a station is bounded by the calendar). A row trains
    every later fold of its station, so the models of all stations and folds grow together, one job a level; all
    predictions are scored in one aggregate.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(location))
    i = F.row_number().over(Window.partitionBy(location).orderBy(date))
    back = F.ceil(F.try_divide(n - i + 1, F.floor(n / (k + 1))))
    folds = land(df.select(location, date, y, *features).withColumn("test_fold", F.when(back <= k, k + 1 - back).otherwise(0).cast("int")), "folds", by=["test_fold"])
    train = folds.filter(F.col("test_fold") < k).withColumn("fold", F.explode(F.sequence(F.col("test_fold") + 1, F.lit(k))))
    test = folds.filter("test_fold > 0").withColumn("fold", F.col("test_fold"))
    est = GroupedBoosting(group_cols=[location, "fold"], features=features, label=y, out="_p", key_cols=[date], **boost)
    scored = est.fit(train).transform(test)
    per_fold = scored.groupBy(location, "fold").agg(F.sqrt(F.avg(F.pow(F.col("_p") - F.col(y), 2))).alias("rmse"))
    mean = per_fold.groupBy(location).agg(F.avg("rmse").alias("mean_rmse"))
    std = folds.groupBy(location).agg(F.stddev_samp(y).alias("std"))
    return mean.join(std, location).select(location, "mean_rmse", F.try_divide("mean_rmse", "std").alias("normalized_rmse"))


def stack(df: DataFrame, preds: Sequence[str], y: str, linear_out: str = "meta_lr", boosted_out: str = "meta_gbt", **boost) -> DataFrame:
    """Linear and boosted model over the predictions of others."""
    x = VectorAssembler(inputCols=list(preds), outputCol="_meta").transform(df)
    lin = LinearRegression(featuresCol="_meta", labelCol=y, predictionCol=linear_out).fit(x)
    gbt = GBTRegressor(featuresCol="_meta", labelCol=y, predictionCol=boosted_out, seed=42, **boost).fit(x)
    return gbt.transform(lin.transform(x)).drop("_meta")


def calibrate(df: DataFrame, pred: str, y: str, out: str = "calibrated", clip_min: float = 0.0) -> DataFrame:
    """Monotone calibration, flat outside the fitted range, clipped below."""
    m = IsotonicRegression(featuresCol=pred, labelCol=y, predictionCol=out).fit(df.dropna(subset=[pred, y]))
    return m.transform(df).withColumn(out, F.greatest(F.col(out), F.lit(clip_min)))


def robust_calibrate(df: DataFrame, pred: str, y: str, out: str = "calibrated", clip_min: float = 0.0, **params) -> DataFrame:
    """Boosted calibration with Huber loss, clipped below."""
    stages = [VectorAssembler(inputCols=[pred], outputCol="_cal"), HuberBoosting("_cal", y, out, **params)]
    m = Pipeline(stages=stages).fit(df.dropna(subset=[pred, y]))
    return m.transform(df).withColumn(out, F.greatest(F.col(out), F.lit(clip_min))).drop("_cal")
