"""Classes, texts and formatted values shown with a prediction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts.
INTENSITY_LABELS = {
    "drizzle": "No rain / Drizzle", "light": "Light rain", "moderate": "Moderate rain", "heavy": "Heavy rain"}
FORECAST_TEXT = {
    "drizzle": "Minimal Rainfall is expected. No significant impact is anticipated under typical conditions.",
    "light": "Light Rainfall is expected. Conditions may feel damp, but impacts are generally limited.",
    "moderate": "Moderate Rainfall is expected. Consider short-term planning impacts, especially around commute hours.",
    "heavy": "Heavy Rainfall is expected. Be alert for localized flooding risk and changing conditions."}
SCENARIO_TEXT = {
    "drizzle": "Under the specified inputs, the model indicates minimal Rainfall. This reflects a low-rain response scenario.",
    "light": "Under the specified inputs, the model predicts light Rainfall. This scenario suggests mild rain conditions.",
    "moderate": "Under the specified inputs, the model predicts moderate Rainfall. This scenario can affect short-term activity planning.",
    "heavy": "Under the specified inputs, the model predicts heavy Rainfall. This scenario indicates elevated rain intensity."}
DIRECTION_TEXT = {
    "overprediction": "Predicted Rainfall is higher than observed.",
    "underprediction": "Predicted Rainfall is lower than observed.",
    "exact": "Prediction closely matches observed Rainfall."}
REGIME_TEXT = {
    "drizzle": "Rainfall is within the drizzle regime, where small absolute differences are common and generally low-impact.",
    "moderate": "Rainfall falls within a moderate range, where prediction accuracy can influence short-term planning.",
    "heavy": "Rainfall is in the heavy regime, where prediction errors may have significant real-world impact."}
SEVERITY_TEXT = {
    "drizzle/low": "Deviation is minimal and unlikely to have practical impact.",
    "drizzle/moderate": "Relative deviation appears large, but absolute Rainfall remains low.",
    "low": "Prediction is highly reliable for this Rainfall level.",
    "moderate": "Prediction shows noticeable deviation that may affect planning decisions.",
    "high": "Prediction deviates substantially from observed Rainfall."}


def lookup(texts: dict[str, str], key: Column) -> Column:
    """Text of a class through a map literal."""
    pairs = [F.lit(x) for kv in texts.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def rain_intensity(mm: Column) -> Column:
    return F.when(mm <= 1, "drizzle").when(mm <= 10, "light").when(mm <= 30, "moderate").when(mm > 30, "heavy")


def error_rain_bin(mm: Column) -> Column:
    """Bins of the error table: (-1,0], (0,10], (10,30], (30,100], above."""
    return (F.when(mm <= -1, None).when(mm <= 0, "no_rain").when(mm <= 10, "light").when(mm <= 30, "moderate")
            .when(mm <= 100, "heavy").when(mm > 100, "extreme"))


def evaluation_columns(pred: Column, obs: Column, eps: float = 1.0, shift: float = 0.0) -> dict[str, Column]:
    """Error, direction, regime, severity and text; ``shift`` is added to the relative error before it is rounded."""
    diff = pred - obs
    err = F.abs(diff)
    rel = err / F.greatest(obs, F.lit(eps)) * 100
    direction = F.when(diff > 0, "overprediction").when(diff < 0, "underprediction").when(diff == 0, "exact")
    regime = F.when(obs <= 5, "drizzle").when(obs <= 30, "moderate").when(obs > 30, "heavy")
    severity = (
        F.when(obs <= 5, F.when(err <= 2, "low").otherwise("moderate"))
        .otherwise(F.when(rel <= 20, "low").when(rel <= 50, "moderate").when(rel > 50, "high")))
    text_key = F.when(obs <= 5, F.concat(F.lit("drizzle/"), severity)).otherwise(severity)
    return {
        "absolute_error_mm": err, "relative_error_pct": F.bround(rel + shift, 1),
        "direction": direction, "regime": regime, "severity": severity,
        "insight_text": F.concat_ws(" ", lookup(SEVERITY_TEXT, text_key), lookup(DIRECTION_TEXT, direction),
                                    lookup(REGIME_TEXT, regime)),
    }


def kpi(value: Column, unit: str) -> Column:
    """Struct of number, two-decimal text and unit; 'Not Available' without a value."""
    bad = value.isNull() | F.isnan(value)
    return F.struct(
        F.when(~bad, value).alias("num"),
        F.when(bad, "Not Available").otherwise(F.format_string("%.2f", value)).alias("text"),
        F.when(bad, "").otherwise(unit).alias("unit"))


def signed_pct(value: Column) -> Column:
    """Struct of signed whole percent and its style class; empty without a finite value."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    sign = F.format_string("%+.0f%%", F.bround(value, 0))
    return F.struct(
        F.when(bad, "").otherwise(sign).alias("text"),
        F.when(~bad & (value < 0), "negative").otherwise("").alias("css_class"))


def sample_weight(y: Column, q90: Column, q95: Column, q99: Column, q995: Column, q999: Column) -> Column:
    """Weight tiers by a location's upper quantiles."""
    return (F.when(y > q999, 11.0).when(y > q995, 9.0).when(y > q99, 7.0)
            .when(y > q95, 5.0).when(y > q90, 3.0).otherwise(1.0))


FORECAST_DAYS = 14


def forecast_reason(date: Column, today: Column) -> Column:
    """Why a forecast cannot be given for a date; null where it can."""
    last = F.date_add(today, FORECAST_DAYS)
    text = F.format_string("Forecast date must be between %s and %s", today.cast("string"), last.cast("string"))
    return F.when(date.isNull(), "date required").when(~date.between(today, last), text)


def forecast_response(location: Column, date: Column, pred: Column) -> Column:
    return response(F.lit("forecast"), location, date, pred, F.lit("open_meteo"), F.lit("Forecast limited to short-term weather window"))


def scenario_response(location: Column, date: Column, pred: Column) -> Column:
    return response(F.lit("random"), location, date, pred, F.lit("random_user_input"), F.lit("Scenario-based prediction"))


def response(mode: Column, location: Column, date: Column, pred: Column, source: Column, notes: Column,
             obs: Column | None = None) -> Column:
    """Nested answer of a prediction request; ``comparison`` is null without an observation."""
    obs = obs if obs is not None else F.lit(None).cast("double")
    comparison = F.when(obs.isNotNull(), F.struct(
        F.bround(obs, 3).alias("observed_daily_rainfall_mm"), F.bround(pred - obs, 3).alias("error_mm")))
    return F.struct(
        mode.alias("mode"), F.struct(location.alias("location"), date.alias("date")).alias("input"),
        F.struct(F.bround(pred, 3).alias("daily_rainfall_mm")).alias("prediction"),
        comparison.alias("comparison"),
        F.struct(source.alias("feature_source"), F.array(notes).alias("notes")).alias("meta"))
