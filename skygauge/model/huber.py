"""Boosting with Huber loss on Spark's regression trees."""

from __future__ import annotations

from pyspark.ml import Estimator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge.model.persist import Parts
from skygauge.model.transformers import Saved
from skygauge.operators.ordering import global_quantiles
from skygauge.session import land


class HuberParams(HasFeaturesCol, HasPredictionCol):
    start = Param(Params._dummy(), "start", "prediction before the first tree", TypeConverters.toFloat)
    stepSize = Param(Params._dummy(), "stepSize", "share of a tree's values that is added", TypeConverters.toFloat)


class HuberBoosting(Estimator, HuberParams, Saved):
    """Each round fits a tree to the residuals, held at the exact ``alpha`` quantile of their size.

    Residuals within the quantile pull by their size, larger ones all alike: squared loss inside, absolute
    loss outside, with a border that shrinks as the fit improves. The first prediction is the median. Rows with a
    null label are left out; without any rows the prediction is null.
    """

    label = Param(Params._dummy(), "label", "column to fit", TypeConverters.toString)
    alpha = Param(Params._dummy(), "alpha", "share of residuals that count by their size", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "number of trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a tree", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the trees", TypeConverters.toInt)

    # Production sizes of the calibration.
    def __init__(self, features: str = "features", label: str = "label", out: str = "prediction", alpha: float = 0.9, maxIter: int = 5000, maxDepth: int = 5,
                 stepSize: float = 0.2, seed: int = 42):
        super().__init__()
        self._set(featuresCol=features, label=label, predictionCol=out, alpha=alpha, maxIter=maxIter, maxDepth=maxDepth, stepSize=stepSize, seed=seed)

    def _fit(self, df: DataFrame) -> "HuberBoostingModel":
        label, step = self.getOrDefault("label"), self.getOrDefault("stepSize")
        rows = land(df.filter(F.col(label).isNotNull()).select(self.getFeaturesCol(), F.col(label).cast("double").alias("_y")), "rows")
        start = global_quantiles(rows, "_y", [0.5], ["median"]).first()[0]
        model = self._copyValues(HuberBoostingModel())
        if start is None:
            return model
        model._set(start=start)
        rows = rows.withColumn("_f", F.lit(start))
        for t in range(self.getOrDefault("maxIter")):
            e = F.col("_y") - F.col("_f")
            rows = land(rows.withColumns({"_e": e, "_size": F.abs(e)}), "rows")
            border = global_quantiles(rows, "_size", [self.getOrDefault("alpha")], ["border"]).first()[0]
            held = rows.withColumn("_e", F.greatest(F.lit(-border), F.least(F.lit(border), F.col("_e"))))
            tree = DecisionTreeRegressor(featuresCol=self.getFeaturesCol(), labelCol="_e", predictionCol="_t", maxDepth=self.getOrDefault("maxDepth"), seed=self.getOrDefault("seed"))
            model.models[f"tree{t}"] = tree.fit(held)
            rows = model.models[f"tree{t}"].transform(rows).withColumn("_f", F.col("_f") + step * F.col("_t")).select(self.getFeaturesCol(), "_y", "_f")
        return model


class HuberBoostingModel(Parts, HuberParams):
    def _transform(self, df: DataFrame) -> DataFrame:
        out = self.getPredictionCol()
        x = df.withColumn(out, F.lit(self.getOrDefault("start") if self.isDefined("start") else None).cast("double"))
        for t in range(len(self.models)):
            x = self.models[f"tree{t}"].transform(x).withColumn(out, F.col(out) + self.getOrDefault("stepSize") * F.col("_t")).drop("_t")
        return x
