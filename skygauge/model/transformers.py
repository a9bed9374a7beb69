"""Feature steps as Spark ML transformers, and the fitted ones as estimators; all of them can be saved."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from skygauge.functions import calendar as cal
from skygauge.functions import weather as wx
from skygauge.model.persist import Parts
from skygauge.operators import encoding as en
from skygauge.operators import joins as jn
from skygauge.operators import windows as win
from skygauge.session import cut_lineage


class Saved(DefaultParamsReadable, DefaultParamsWritable):
    """Stages that are their parameters."""


class HasGroup(Params):
    group = Param(Params._dummy(), "group", "column of the station", TypeConverters.toString)


class HasEncoding(HasOutputCol):
    target = Param(Params._dummy(), "target", "column to encode by", TypeConverters.toString)
    keys = Param(Params._dummy(), "keys", "columns of a cell", TypeConverters.toListString)
    alpha = Param(Params._dummy(), "alpha", "weight of the global mean, in rows", TypeConverters.toFloat)


class MedianImputer(Estimator, HasInputCols, HasGroup, Saved):
    def __init__(self, cols: Sequence[str] = (), group: str = "location"):
        super().__init__()
        self._set(inputCols=list(cols), group=group)

    def _fit(self, df: DataFrame) -> "MedianImputerModel":
        # fitted tables are written once; later stages read them back
        cols, group = self.getInputCols(), self.getOrDefault("group")
        tables = {"local": cut_lineage(en.location_medians(df, cols, group)), "overall": cut_lineage(en.global_medians(df, cols))}
        return self._copyValues(MedianImputerModel(tables))


class MedianImputerModel(Parts, HasInputCols, HasGroup):
    def _transform(self, df: DataFrame) -> DataFrame:
        return en.impute_medians(df, self.getInputCols(), self.tables["local"], self.tables["overall"], self.getOrDefault("group"))


class TargetEncoder(Estimator, HasEncoding, Saved):
    def __init__(self, target: str = "", keys: Sequence[str] = ("location", "month"), alpha: float = 50.0, out: str = "te_location_month"):
        super().__init__()
        self._set(target=target, keys=list(keys), alpha=alpha, outputCol=out)

    def _fit(self, df: DataFrame) -> "TargetEncoderModel":
        target, keys, alpha = (self.getOrDefault(p) for p in ("target", "keys", "alpha"))
        cells, overall = (cut_lineage(t) for t in en.fit_target_encoding(df, target, keys, alpha, self.getOutputCol()))
        return self._copyValues(TargetEncoderModel({"cells": cells, "overall": overall}))


class TargetEncoderModel(Parts, HasEncoding):
    def _transform(self, df: DataFrame) -> DataFrame:
        return en.apply_target_encoding(df, self.tables["cells"], self.tables["overall"], self.getOrDefault("keys"), self.getOutputCol())


class HasSigmoid(Params):
    sigmoid = Param(Params._dummy(), "sigmoid", "add the time ramp", TypeConverters.toBoolean)


class TimeFeatures(Estimator, HasSigmoid, Saved):
    """Calendar columns; the time ramp runs over the dates seen in ``fit``."""

    def __init__(self, sigmoid: bool = True):
        super().__init__()
        self._set(sigmoid=sigmoid)

    def _fit(self, df: DataFrame) -> "TimeFeaturesModel":
        return self._copyValues(TimeFeaturesModel({"bounds": cut_lineage(cal.date_bounds(df))} if self.getOrDefault("sigmoid") else {}))


class TimeFeaturesModel(Parts, HasSigmoid):
    def _transform(self, df: DataFrame) -> DataFrame:
        out = cal.time_features(df)
        return cal.add_time_sigmoid(out, self.tables["bounds"]) if self.getOrDefault("sigmoid") else out


class ExternalFeatures(Parts):
    """Indices joined by date; the table is saved with the stage."""

    def __init__(self, external: DataFrame | None = None):
        super().__init__({} if external is None else {"external": external})

    def _transform(self, df: DataFrame) -> DataFrame:
        return jn.add_external(df, self.tables["external"])


class TemperatureFeatures(Transformer, Saved):
    def _transform(self, df: DataFrame) -> DataFrame:
        return wx.temperature_features(df)


class WindRainFeatures(Transformer, Saved):
    def _transform(self, df: DataFrame) -> DataFrame:
        return wx.wind_rain_features(df)


class LagFeatures(Transformer, Saved):
    lagDays = Param(Params._dummy(), "lagDays", "rows to look back", TypeConverters.toInt)

    def __init__(self, lag_days: int = 1):
        super().__init__()
        self._set(lagDays=lag_days)

    def _transform(self, df: DataFrame) -> DataFrame:
        return win.lag_features(df, self.getOrDefault("lagDays"))


class RollingStatsFeatures(Transformer, Saved):
    def _transform(self, df: DataFrame) -> DataFrame:
        return win.rolling_stats(df)


class InteractionFeatures(Transformer, Saved):
    def _transform(self, df: DataFrame) -> DataFrame:
        return wx.interaction_features(df)


def feature_stages(columns: Sequence[str], external: DataFrame | None = None, lag_days: int = 1) -> list:
    """Imputation, external indices, calendar, temperature, wind and rain, lags, rolling means, interactions."""
    first = [MedianImputer(columns)] + ([] if external is None else [ExternalFeatures(external)])
    return first + [TimeFeatures(), TemperatureFeatures(), WindRainFeatures(), LagFeatures(lag_days), RollingStatsFeatures(), InteractionFeatures()]
