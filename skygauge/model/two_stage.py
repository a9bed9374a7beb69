"""Two-stage rain model: chance of rain times amount, as Spark ML estimators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge.model.persist import Parts
from skygauge.model.transformers import Saved

# Production sizes of the two stages.
CLASSIFIER = {"maxIter": 500, "maxDepth": 3, "stepSize": 0.05, "subsamplingRate": 0.8, "minInstancesPerNode": 5, "seed": 42}
REGRESSOR = {"maxIter": 1000, "maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 0.8, "minInstancesPerNode": 5, "seed": 42}
POSITIVE_WEIGHT = 1.25
RAIN_THRESHOLD = 0.1


class FillMissing(Transformer, HasInputCols, Saved):
    """Replace null features by a value that the trees can split off."""

    value = Param(Params._dummy(), "value", "what stands for a missing number", TypeConverters.toFloat)

    def __init__(self, cols: Sequence[str] = (), value: float = -1.0):
        super().__init__()
        self._set(inputCols=list(cols), value=value)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.fillna(self.getOrDefault("value"), subset=self.getInputCols())


def preprocessor(numeric: Sequence[str], location: str = "location") -> list:
    """One-hot location (unknown stations give zeros) and the numbers; other columns are ignored."""
    return [
        StringIndexer(inputCol=location, outputCol="_loc_ix", handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCol="_loc_ix", outputCol="_loc_vec", dropLast=True),
        FillMissing(numeric),
        VectorAssembler(inputCols=["_loc_vec", *numeric], outputCol="features"),
    ]


def classifier(**params) -> GBTClassifier:
    c = GBTClassifier(featuresCol="features", labelCol="_wet", weightCol="_weight", predictionCol="_wet_pred", **{**CLASSIFIER, **params})
    return c.setRawPredictionCol("_raw").setProbabilityCol("_prob")


def regressor(out: str = "_amount", label: str = "_y", weight: str | None = None, **params) -> GBTRegressor:
    more = {"weightCol": weight} if weight else {}
    return GBTRegressor(featuresCol="features", labelCol=label, predictionCol=out, **{**REGRESSOR, **more, **params})


class HasOut(HasOutputCol):
    logTarget = Param(Params._dummy(), "logTarget", "regress the logarithm of 1 + target", TypeConverters.toBoolean)


class TwoStage(Estimator, HasOut, Saved):
    """Classifier on ``y > threshold``, regressor on the wet rows; prediction is chance times amount.

    With several regressors (``reg_params``, one set of parameters each) the amount is their mean.
    Without wet rows every prediction is 0.
    """

    target = Param(Params._dummy(), "target", "column to predict", TypeConverters.toString)
    threshold = Param(Params._dummy(), "threshold", "amount above which a day is wet", TypeConverters.toFloat)
    positiveWeight = Param(Params._dummy(), "positiveWeight", "weight of a wet day in the classifier", TypeConverters.toFloat)
    weightCol = Param(Params._dummy(), "weightCol", "row weights of the regressors; empty: none", TypeConverters.toString)
    clfParams = Param(Params._dummy(), "clfParams", "parameters of the classifier", TypeConverters.identity)
    regParams = Param(Params._dummy(), "regParams", "parameters of each regressor", TypeConverters.identity)

    def __init__(self, target: str = "", out: str = "prediction", threshold: float = 0.0, log_target: bool = False, positive_weight: float = POSITIVE_WEIGHT,
                 weight_col: str | None = None, clf_params: dict | None = None, reg_params: Sequence[dict] = ({},)):
        super().__init__()
        self._set(target=target, outputCol=out, threshold=threshold, logTarget=log_target, positiveWeight=positive_weight,
                  weightCol=weight_col or "", clfParams=dict(clf_params or {}), regParams=[dict(p) for p in reg_params])

    def _fit(self, df: DataFrame) -> "TwoStageModel":
        target = self.getOrDefault("target")
        wet = F.coalesce((F.col(target) > self.getOrDefault("threshold")).cast("double"), F.lit(0.0))
        y = F.log1p(target) if self.getOrDefault("logTarget") else F.col(target)
        train = df.withColumns({"_wet": wet, "_y": y}).withColumn(
            "_weight", F.when(F.col("_wet") == 1, self.getOrDefault("positiveWeight")).otherwise(1.0)).persist()
        try:
            n_wet, n_dry = train.agg(F.count_if(F.col("_wet") == 1), F.count_if(F.col("_wet") == 0)).first()
            models: dict[str, Model] = {}
            if n_wet and n_dry:  # all wet: the chance is 1
                models["classifier"] = classifier(**self.getOrDefault("clfParams")).fit(train)
            for i, p in enumerate(self.getOrDefault("regParams") if n_wet else []):
                models[f"regressor{i}"] = regressor(f"_amount{i}", weight=self.getOrDefault("weightCol") or None, **p).fit(train.filter("_wet = 1"))
            return self._copyValues(TwoStageModel(models=models))
        finally:
            train.unpersist()


class TwoStageModel(Parts, HasOut):
    """Fitted stages by name: ``classifier`` where both kinds of day were seen, ``regressor0``, ... where wet ones were."""

    def _transform(self, df: DataFrame) -> DataFrame:
        out = self.getOutputCol()
        names = [f"_amount{i}" for i in range(len(self.models) - ("classifier" in self.models))]
        if not names:
            return df.withColumns({f"{out}_chance": F.lit(0.0), out: F.lit(0.0)})
        scored, chance = df, F.lit(1.0)
        if "classifier" in self.models:
            scored, chance = self.models["classifier"].transform(df), vector_to_array("_prob")[1]
        for i in range(len(names)):
            scored = self.models[f"regressor{i}"].transform(scored)
        scored = scored.withColumn(f"{out}_chance", chance)
        amounts = [F.expm1(n) if self.getOrDefault("logTarget") else F.col(n) for n in names]
        p = F.col(f"{out}_chance")
        cols = {out: p * sum(amounts[1:], amounts[0]) / len(amounts)}
        if len(amounts) > 1:  # each regressor alone, for stacking and blending
            cols |= {f"{out}_{i}": p * F.greatest(a, F.lit(0.0)) for i, a in enumerate(amounts)}
        drop = [c for c in ("_raw", "_prob", "_wet_pred", *names) if c in scored.columns]
        return scored.withColumns(cols).drop(*drop)


def build_model(kind: str, target: str, out: str = "prediction", clf_params: dict | None = None,
                reg_params: dict | None = None, log_target: bool = False, threshold: float = 0.0) -> list:
    """Stages of a "regressor", "classifier" or "two_stage" model over ``features``."""
    if kind == "regressor":
        if log_target:
            return [LogTarget(target), regressor(out, label="_y", **(reg_params or {})), Unlog(out)]
        return [regressor(out, label=target, **(reg_params or {}))]
    if kind == "classifier":
        return [WetFlag(target, threshold), classifier(**(clf_params or {}))]
    if kind == "two_stage":
        return [TwoStage(target, out, threshold, log_target, clf_params=clf_params or {}, reg_params=[reg_params or {}])]
    raise ValueError(f"Unknown model_type: {kind}")


class HasTarget(Params):
    target = Param(Params._dummy(), "target", "column to predict", TypeConverters.toString)


class LogTarget(Transformer, HasTarget, Saved):
    """``_y``, the logarithm of 1 + target; rows to be scored have no target and stay as they are."""

    def __init__(self, target: str = ""):
        super().__init__()
        self._set(target=target)

    def _transform(self, df: DataFrame) -> DataFrame:
        target = self.getOrDefault("target")
        return df.withColumn("_y", F.log1p(target)) if target in df.columns else df


class Unlog(Transformer, HasOutputCol, Saved):
    def __init__(self, col: str = "prediction"):
        super().__init__()
        self._set(outputCol=col)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), F.expm1(self.getOutputCol()))


class WetFlag(Transformer, HasTarget, Saved):
    """``_wet`` and the classifier's ``_weight``; rows to be scored have no target and stay as they are."""

    threshold = Param(Params._dummy(), "threshold", "amount above which a day is wet", TypeConverters.toFloat)

    def __init__(self, target: str = "", threshold: float = 0.0):
        super().__init__()
        self._set(target=target, threshold=threshold)

    def _transform(self, df: DataFrame) -> DataFrame:
        target = self.getOrDefault("target")
        if target not in df.columns:
            return df
        wet = F.coalesce((F.col(target) > self.getOrDefault("threshold")).cast("double"), F.lit(0.0))
        return df.withColumns({"_wet": wet, "_weight": F.when(wet == 1, POSITIVE_WEIGHT).otherwise(1.0)})


def build_pipeline(target: str, numeric: Sequence[str], kind: str = "two_stage", feature_stages: Sequence = (), **model) -> Pipeline:
    """Feature transformers, preprocessor and model in one Spark ML pipeline."""
    model.setdefault("threshold", RAIN_THRESHOLD)
    return Pipeline(stages=[*feature_stages, *preprocessor(numeric), *build_model(kind, target, **model)])


def score(model: PipelineModel | Model, df: DataFrame, out: str = "prediction", clip: bool = True,
          name: str = "predicted_daily_rainfall_mm") -> DataFrame:
    """Batch prediction; negative amounts are clipped to 0."""
    p = model.transform(df)
    value = F.greatest(F.col(out), F.lit(0.0)) if clip else F.col(out)
    return p.select(*df.columns, value.alias(name))
