"""Boosted trees of many groups at once: every level of every group's tree is one aggregate over all rows."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skygauge.model.persist import Parts
from skygauge.model.transformers import Saved
from skygauge.session import land, scratch_dir

_NODES = "array<struct<feature:int,bin:int,missing_left:boolean,left:double,right:double>>"


class GroupedParams(HasInputCols, HasOutputCol):
    groupCols = Param(Params._dummy(), "groupCols", "columns that tell the groups apart", TypeConverters.toListString)
    loss = Param(Params._dummy(), "loss", "squared or logistic", TypeConverters.toString)
    depth = Param(Params._dummy(), "depth", "levels of splits of a tree", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "share of a tree's values that is added", TypeConverters.toFloat)


class GroupedBoosting(Estimator, GroupedParams, Saved):
    """Gradient boosting fitted for each group on its own rows, all groups together.

    Features are cut at the group's own quantiles into at most ``bins`` bins (a missing value has a bin
    of its own, and each split learns its side). A level of all trees is one job: gradient and curvature are summed by
    (group, node, feature, bin), splits are chosen from running sums, and rows find their node by the
    tree so far. The result for a group does not depend on the other groups. Rows and trees are
    written after each step, so a lost executor costs one step at most.

    ``loss`` is squared, or logistic for a label of 0 and 1 (the output is then the chance of 1). Rows
    with a null label are left out; a group with no rows left has no model. ``subsample`` of the rows, by a hash of ``keyCols``
    and the number of the tree, grow each tree.
    """

    label = Param(Params._dummy(), "label", "column to fit", TypeConverters.toString)
    weight = Param(Params._dummy(), "weight", "row weights; empty: all 1", TypeConverters.toString)
    keyCols = Param(Params._dummy(), "keyCols", "columns that tell a group's rows apart", TypeConverters.toListString)
    trees = Param(Params._dummy(), "trees", "number of trees", TypeConverters.toInt)
    bins = Param(Params._dummy(), "bins", "bins of a feature", TypeConverters.toInt)
    minWeight = Param(Params._dummy(), "minWeight", "least curvature of a child", TypeConverters.toFloat)
    l2 = Param(Params._dummy(), "l2", "penalty of leaf values", TypeConverters.toFloat)
    subsample = Param(Params._dummy(), "subsample", "share of rows for a tree", TypeConverters.toFloat)

    def __init__(self, group_cols: Sequence[str] = ("location",), features: Sequence[str] = (), label: str = "", out: str = "prediction", loss: str = "squared",
                 weight: str | None = None, key_cols: Sequence[str] = ("date",), trees: int = 100, depth: int = 3, step_size: float = 0.05, bins: int = 32,
                 min_weight: float = 5.0, l2: float = 1.0, subsample: float = 0.8):
        super().__init__()
        if loss not in ("squared", "logistic"):
            raise ValueError(f"unknown loss: {loss}")
        if trees < 1 or depth < 1:
            raise ValueError("at least one tree of one level")
        self._set(groupCols=list(group_cols), inputCols=list(features), label=label, outputCol=out, loss=loss, weight=weight or "", keyCols=list(key_cols),
                  trees=trees, depth=depth, stepSize=step_size, bins=bins, minWeight=min_weight, l2=l2, subsample=subsample)

    def _fit(self, df: DataFrame) -> "GroupedBoostingModel":
        p = {q.name: v for q, v in self.extractParamMap().items()}
        group, features = p["groupCols"], p["inputCols"]
        w = F.coalesce(F.col(p["weight"]).cast("double"), F.lit(1.0)) if p["weight"] else F.lit(1.0)
        x = df.filter(F.col(p["label"]).isNotNull()).select(
            *group, F.xxhash64(*p["keyCols"]).alias("_key"), F.col(p["label"]).cast("double").alias("_y"), w.alias("_w"), *[number(c).alias(c) for c in features])
        probs = ", ".join(str((i + 1) / p["bins"]) for i in range(p["bins"] - 1))
        cuts = [F.coalesce(F.array_distinct(F.expr(f"percentile(`{c}`, array({probs}))")), F.array().cast("array<double>")) for c in features]
        mean = F.sum(F.col("_y") * F.col("_w")) / F.sum("_w")
        inner = F.least(F.greatest(mean, F.lit(1e-6)), F.lit(1 - 1e-6))
        base = F.log(inner / (1 - inner)) if p["loss"] == "logistic" else mean
        start = land(x.groupBy(*group).agg(F.array(*cuts).alias("cuts"), F.round(base, 9).alias("base")), "cuts")
        rows = land(x.join(start, group).select(*group, "_key", "_y", "_w", binned(features).alias("_bins"), F.col("base").alias("_f"), drawn(0, p).alias("_on")), "rows")
        grown = scratch_dir(df.sparkSession, "trees")
        for t in range(p["trees"]):
            tree = start.select(*group, F.array().cast(_NODES).alias("nodes"))
            for level in range(p["depth"]):
                tree = self._split(rows, tree, level, p)
            tree.write.parquet(f"{grown}/t={t}")
            if t + 1 < p["trees"]:
                value = reached(F.col("nodes"), F.col("_bins"), p["depth"]).value
                rows = land(rows.join(tree, group).withColumns({"_f": F.col("_f") + p["stepSize"] * value, "_on": drawn(t + 1, p)}).drop("nodes"), "rows")
        listed = F.transform(F.sort_array(F.collect_list(F.struct("t", "nodes"))), lambda s: s.nodes)
        model = start.join(df.sparkSession.read.parquet(grown).groupBy(*group).agg(listed.alias("trees")), group)
        return self._copyValues(GroupedBoostingModel({"groups": land(model, "groups")}))

    def _split(self, rows: DataFrame, tree: DataFrame, level: int, p: dict) -> DataFrame:
        """The trees with one level more; nodes without a worthwhile split get none."""
        group = p["groupCols"]
        e = F.col("_y") - F.col("_f")
        chance = 1 / (1 + F.exp(-F.col("_f")))
        g, h = (F.col("_w") * e, F.col("_w")) if p["loss"] == "squared" else (F.col("_w") * (F.col("_y") - chance), F.col("_w") * chance * (1 - chance))
        own = rows.filter("_on").join(tree, group).select(*group, reached(F.col("nodes"), F.col("_bins"), level).node.alias("node"), g.alias("g"), h.alias("h"), "_bins")
        cells = own.filter("node is not null").select(*group, "node", "g", "h", F.posexplode("_bins").alias("feature", "bin"))
        # sums are rounded: the order in which tasks add must not decide between equal splits
        sums = cells.groupBy(*group, "node", "feature", "bin").agg(F.round(F.sum("g"), 9).alias("g"), F.round(F.sum("h"), 9).alias("h"))
        whole = Window.partitionBy(*group, "node", "feature")
        upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        seen = F.col("bin") > 0
        sums = sums.repartition(*group).withColumns({
            "all_g": F.sum("g").over(whole), "all_h": F.sum("h").over(whole),
            "left_g": F.sum(F.when(seen, F.col("g"))).over(upto), "left_h": F.sum(F.when(seen, F.col("h"))).over(upto),
            "none_g": F.coalesce(F.sum(F.when(~seen, F.col("g"))).over(whole), F.lit(0.0)), "none_h": F.coalesce(F.sum(F.when(~seen, F.col("h"))).over(whole), F.lit(0.0)),
        }).filter(seen)

        def option(missing_left: bool) -> Column:
            lg = F.col("left_g") + F.col("none_g") if missing_left else F.col("left_g")
            lh = F.col("left_h") + F.col("none_h") if missing_left else F.col("left_h")
            rg, rh = F.col("all_g") - lg, F.col("all_h") - lh
            gain = lg * lg / (lh + p["l2"]) + rg * rg / (rh + p["l2"]) - F.col("all_g") * F.col("all_g") / (F.col("all_h") + p["l2"])
            sound = (lh >= p["minWeight"]) & (rh >= p["minWeight"])
            return F.struct(F.when(sound, F.round(gain, 6)).otherwise(0.0).alias("gain"), F.lit(missing_left).alias("missing_left"),
                            (lg / (lh + p["l2"])).alias("left"), (rg / (rh + p["l2"])).alias("right"))

        best = F.array_max(F.array(option(False), option(True)))
        ranked = sums.select(*group, "node", "feature", "bin", best.alias("o")).filter("o.gain > 0").groupBy(*group, "node").agg(
            F.max(F.struct("o.gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "o.missing_left", "o.left", "o.right")).alias("s"))
        split = F.struct((-F.col("s.f")).cast("int").alias("feature"), (-F.col("s.b")).cast("int").alias("bin"), F.col("s.missing_left").alias("missing_left"),
                         F.col("s.left").alias("left"), F.col("s.right").alias("right"))
        found = ranked.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("node", split.alias("split")))).alias("found"))
        level_nodes = F.transform(F.sequence(F.lit(1 << level), F.lit((2 << level) - 1)), lambda n: F.try_element_at(F.col("found"), n))
        return land(tree.join(found, group, "left").select(*group, F.concat("nodes", level_nodes).cast(_NODES).alias("nodes")), "tree")


class GroupedBoostingModel(Parts, GroupedParams):
    """One row of cuts, base value and trees per group; rows of a group without a model get null."""

    def _transform(self, df: DataFrame) -> DataFrame:
        group, out = self.getOrDefault("groupCols"), self.getOutputCol()
        depth, step = self.getOrDefault("depth"), self.getOrDefault("stepSize")
        g = self.tables["groups"].select(*group, F.col("cuts").alias("_cuts"), F.col("base").alias("_base"), F.col("trees").alias("_trees"))
        x = df.join(g, group, "left").withColumn("_bins", binned(self.getInputCols(), "_cuts"))
        total = F.aggregate("_trees", F.col("_base"), lambda f, nodes: f + step * reached(nodes, F.col("_bins"), depth).value)
        total = 1 / (1 + F.exp(-total)) if self.getOrDefault("loss") == "logistic" else total
        return x.withColumn(out, total).select(*[c for c in df.columns if c != out], out)


class GroupedTwoStage(Estimator, HasOutputCol, Saved):
    """For every group a classifier of wet rows (``target > threshold``) and a weighted regressor of their amount's logarithm; the
    prediction is chance times amount. Both forests grow at the same time, each with one job a level for all groups.

    A group without wet rows is predicted 0, one with nothing else is always wet.
    """

    target = Param(Params._dummy(), "target", "column to predict", TypeConverters.toString)
    features = Param(Params._dummy(), "features", "feature columns", TypeConverters.toListString)
    threshold = Param(Params._dummy(), "threshold", "amount above which a row is wet", TypeConverters.toFloat)
    weight = Param(Params._dummy(), "weight", "row weights of the regressor; empty: all 1", TypeConverters.toString)
    boost = Param(Params._dummy(), "boost", "parameters of both forests", TypeConverters.identity)

    def __init__(self, target: str = "", features: Sequence[str] = (), out: str = "prediction", threshold: float = 0.0, weight: str | None = None, **boost):
        super().__init__()
        self._set(target=target, features=list(features), outputCol=out, threshold=threshold, weight=weight or "", boost=boost)

    def _fit(self, df: DataFrame) -> "GroupedTwoStageModel":
        target, features, boost = (self.getOrDefault(p) for p in ("target", "features", "boost"))
        wet = F.coalesce(F.col(target) > self.getOrDefault("threshold"), F.lit(False))
        x = land(df.withColumns({"_wet": wet.cast("double"), "_amount": F.when(wet, F.log1p(target))}), "train")
        chance = GroupedBoosting(features=features, label="_wet", out="_chance", loss="logistic", **boost)
        amount = GroupedBoosting(features=features, label="_amount", out="_amount", weight=self.getOrDefault("weight") or None, **boost)
        with ThreadPool(2) as pool:
            models = dict(zip(("chance", "amount"), pool.map(lambda e: e.fit(x), (chance, amount))))
        return self._copyValues(GroupedTwoStageModel(models=models))


class GroupedTwoStageModel(Parts, HasOutputCol):
    def _transform(self, df: DataFrame) -> DataFrame:
        out = self.getOutputCol()
        x = self.models["amount"].transform(self.models["chance"].transform(df))
        wet = F.col("_chance") * F.greatest(F.expm1("_amount"), F.lit(0.0))
        return x.withColumn(out, F.when(F.col("_chance").isNotNull(), F.coalesce(wet, F.lit(0.0)))).drop("_chance", "_amount")


def drawn(t: int, p: dict) -> Column:
    """The row is used for tree ``t``."""
    return F.pmod(F.xxhash64("_key", F.lit(t)), F.lit(1 << 20)) < int(p["subsample"] * (1 << 20))


def number(c: str) -> Column:
    """A feature as a double; NaN counts as missing."""
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def binned(features: Sequence[str], cuts: str = "cuts") -> Column:
    """Bin of each feature: 0 for missing, else 1 + the cuts below the value."""
    def place(j: int, c: str) -> Column:
        v = number(c)
        return F.when(v.isNull(), 0).otherwise(1 + F.size(F.filter(F.get(F.col(cuts), F.lit(j)), lambda e: e < v)))

    return F.array(*[place(j, c) for j, c in enumerate(features)])


def reached(nodes: Column, bins: Column, levels: int) -> Column:
    """Struct of the node (null below a node without a split) and the value that ``levels`` steps down a tree lead to."""
    def step(at: Column, _: Column) -> Column:
        def down(s: Column) -> Column:
            b = F.get(bins, s.feature)
            left = F.when(b == 0, s.missing_left).otherwise(b <= s.bin)
            return F.when(s.isNull(), F.struct(F.lit(None).cast("int").alias("node"), at.value.alias("value"))).otherwise(F.struct(
                (2 * at.node + F.when(left, 0).otherwise(1)).cast("int").alias("node"), F.when(left, s.left).otherwise(s.right).alias("value")))

        return F.get(F.transform(F.array(F.get(nodes, at.node - 1)), down), F.lit(0))

    root = F.struct(F.lit(1).alias("node"), F.lit(0.0).alias("value"))
    return root if levels == 0 else F.aggregate(F.sequence(F.lit(1), F.lit(levels)), root, step)
