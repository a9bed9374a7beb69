"""Recursive daily forecast and evaluation of requests."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge.functions import evaluation as ev
from skygauge.operators.cleaning import first_source, validate_requests
from skygauge.operators.joins import neighbor_target_lags
from skygauge.operators.windows import lag_rolling, last_rows
from skygauge.session import cut_lineage, land

# Row lags of the target.
TARGET_LAGS = (1, 2, 3, 7, 14, 28, 60, 91)


def lag_features(df: DataFrame, target: str, edges: DataFrame | None = None, lags: Sequence[int] = TARGET_LAGS) -> DataFrame:
    """Own lags and rolling means of the target, and the neighbours' means at the same lags."""
    out = lag_rolling(df, [(target, list(lags))], target=target)
    return out if edges is None else neighbor_target_lags(out, edges, target, list(lags))


def recursive_forecast(history: DataFrame, future: DataFrame, predict: Callable[[DataFrame], DataFrame], target: str,
                       edges: DataFrame | None = None, lags: Sequence[int] = TARGET_LAGS, extra: Sequence[str] = ()) -> DataFrame:
    """Predict day by day; each day's clipped predictions are the next days' lags.

    Days depend on each other through the neighbours, so they run in sequence, all
    stations of a day in one job. The history is cut to the longest lag, which keeps
    every day's work the same. ``predict`` adds ``prediction``; ``extra`` names further
    prediction columns to keep.
    """
    base = list(history.columns)
    keep = max(lags)
    future = cut_lineage(future)
    state = cut_lineage(last_rows(history, keep))
    dates = [r[0] for r in future.select("date").distinct().orderBy("date").collect()]  # the horizon
    done = None
    for day in dates:
        today = future.filter(F.col("date") == F.lit(day)).select(*[
            F.lit(None).cast("double").alias(target) if c == target else F.col(c) for c in base])
        featured = lag_features(state.unionByName(today), target, edges, lags).filter(F.col("date") == F.lit(day))
        pred = predict(featured.drop(target)).withColumn("prediction", F.greatest(F.col("prediction"), F.lit(0.0)))
        pred = cut_lineage(pred.select(*[c for c in base if c != target], F.col("prediction").alias(target), *extra))
        step = pred.select("location", "date", F.col(target).alias("prediction"), *extra)
        done = step if done is None else done.unionByName(step)
        state = cut_lineage(last_rows(state.unionByName(pred.select(*base)), keep))
    return done


def answer_requests(requests: DataFrame, sources: Sequence[tuple[str, DataFrame]], score: Callable[[DataFrame], DataFrame],
                    observed: DataFrame, pred: str = "predicted_daily_rainfall_mm") -> DataFrame:
    """Every request once: the given columns, and either ``response`` or the ``reason`` why there is none.

    ``requests`` has location and date as text, as they came in; ``observed`` has location, date,
    observed_mm. A request is rejected when it is malformed, when no source has its features, and when
    nothing was observed. Repeated requests are answered each; a key is scored once.
    """
    numbered = land(requests.withColumn("_request", F.monotonically_increasing_id()), "requests")
    good, bad = validate_requests(numbered)
    rows = score(first_source(good, sources))
    note = F.when(F.col("feature_source") == "open_meteo", "Recent evaluation using Open-Meteo features").otherwise(
        "Historical evaluation using best available features")
    mm = observed.select("location", "date", "observed_mm").dropna()
    answer = ev.response(F.lit("evaluation"), F.col("location"), F.col("date"), F.col(pred), F.col("feature_source"), note, F.col("observed_mm"))
    known = rows.join(mm, ["location", "date"], "left").select(
        "location", "date", F.when(F.col("observed_mm").isNotNull(), answer).alias("response"),
        F.when(F.col("observed_mm").isNull(), "Observed rainfall not available for this date").alias("_why"), F.lit(True).alias("_found"))
    tried = good.select("_request", "location", "date").join(known, ["location", "date"], "left")
    why = F.when(F.col("_found").isNull(), "No features for this location and date").otherwise(F.col("_why"))
    done = tried.select("_request", "response", why.alias("reason"))
    rejected = bad.select("_request", F.col("reason").alias("_bad"))
    out = numbered.join(done, "_request", "left").join(rejected, "_request", "left")
    return out.withColumn("reason", F.coalesce("_bad", "reason")).drop("_request", "_bad")


def nearest_gauge_rain(stations: DataFrame, totals: DataFrame, nearest: DataFrame) -> DataFrame:
    """Observed rain of each station and day from its nearest gauge: ``location, date, observed_mm``.

    ``nearest`` has station_code, gauge_id; ``totals`` gauge_id, date, daily_rainfall_total_mm.
    """
    return stations.join(nearest, "station_code").join(totals, "gauge_id").select(
        F.col("station_name").alias("location"), "date", F.col("daily_rainfall_total_mm").alias("observed_mm"))
