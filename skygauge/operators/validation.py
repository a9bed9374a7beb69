"""Time-aware splits, classification scores and comparison of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygauge.operators.ordering import attach_row, prefix_sums, with_ordinal


def time_ordered_folds(df: DataFrame, k: int = 5, order: Sequence[str] = ("date", "location")) -> DataFrame:
    """Add ``test_fold`` (1..k, 0 for rows that are only trained on) by global position.

    Fold i is tested on its rows and trained on every row before them.
    """
    ranked = with_ordinal(df, list(order))
    n = ranked.agg((F.max("ordinal") + 1).alias("n")).scalar()
    size = F.floor(F.col("_n") / (k + 1))
    back = F.ceil(F.try_divide(F.col("_n") - F.col("ordinal"), size))  # 1 for the last fold
    fold = F.when(back <= k, k + 1 - back).otherwise(0)
    return ranked.withColumn("_n", n).withColumn("test_fold", fold.cast("int")).drop("_n")


def fold_parts(df: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of one time-ordered fold."""
    return df.filter(F.col("test_fold") < fold), df.filter(F.col("test_fold") == fold)


def year_folds(df: DataFrame, n_folds: int = 3, val_years: int = 2, date: str = "date") -> list[tuple[DataFrame, DataFrame]]:
    """Validation blocks of years from the end, each trained on the earlier years."""
    years = [r[0] for r in df.select(F.year(date).alias("y")).distinct().orderBy("y").collect()]
    folds = []
    if len(years) <= n_folds * val_years:
        raise ValueError(f"{n_folds} folds of {val_years} years and a year to train on need more than the {len(years)} years of the table")
    for i in range(n_folds):
        start = years[-(n_folds - i) * val_years]
        y = F.year(date)
        folds.append((df.filter(y < start), df.filter(y.between(start, start + val_years - 1))))
    return folds


def holdout_last(df: DataFrame, months: int, group: str = "location", date: str = "date", inclusive: bool = True) -> DataFrame:
    """Add ``part``: train up to the group's last date minus ``months``, then validation.

    ``inclusive`` keeps the cut-off day in train; otherwise it starts validation.
    """
    cut = df.groupBy(group).agg(F.add_months(F.max(date), -months).alias("_cut"))
    d = F.col(date)
    train = d <= F.col("_cut") if inclusive else d < F.col("_cut")
    return df.join(cut, group).withColumn("part", F.when(train, "train").otherwise("validation")).drop("_cut")


def threshold_report(df: DataFrame, score: str, label: str, thresholds: Sequence[float]) -> DataFrame:
    """Accuracy and per-class precision, recall and F1 at each threshold, in one aggregate."""
    y = F.col(label) == 1
    cells = []
    for t in thresholds:
        p = F.col(score) > t
        cells.append(F.struct(F.lit(float(t)).alias("threshold"), F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"),
                              F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn")))
    c = df.agg(F.array(*cells).alias("c")).select(F.inline("c"))

    def prf(hit: str, extra: str, missed: str, name: str) -> list[Column]:
        h = F.col(hit)
        return [F.try_divide(h, h + F.col(extra)).alias(f"precision_{name}"), F.try_divide(h, h + F.col(missed)).alias(f"recall_{name}"),
                F.try_divide(2 * h, 2 * h + F.col(extra) + F.col(missed)).alias(f"f1_{name}")]

    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return c.select("threshold", "tp", "fp", "fn", "tn", F.try_divide(F.col("tp") + F.col("tn"), total).alias("accuracy"),
                    *prf("tp", "fp", "fn", "rain"), *prf("tn", "fn", "fp", "dry"))


def score_levels(df: DataFrame, score: str, label: str) -> DataFrame:
    """Positives and negatives per score with running counts from the highest score down."""
    y = F.col(label) == 1
    levels = df.groupBy(F.col(score).alias("score")).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    return prefix_sums(levels, [F.desc("score")], {"tp": "pos", "fp": "neg"})


def _with_totals(levels: DataFrame) -> DataFrame:
    totals = levels.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return attach_row(levels, totals)


def pr_curve(levels: DataFrame) -> DataFrame:
    return _with_totals(levels).select(
        "score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.try_divide(F.col("tp"), F.col("n_pos")).alias("recall"))


def ranking_scores(levels: DataFrame) -> DataFrame:
    """Average precision (step sum), ROC-AUC (ties at mid-rank) and the base rate."""
    x = _with_totals(levels)
    step = F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    above = F.col("neg") * (F.col("tp") - F.col("pos") / 2)
    return x.agg(
        F.try_divide(F.sum(step), F.first("n_pos")).alias("average_precision"),
        F.try_divide(F.sum(above), F.first("n_pos") * F.first("n_neg").cast("double")).alias("roc_auc"),
        (F.first("n_pos") / (F.first("n_pos") + F.first("n_neg"))).alias("base_rate"))


def blend_weights(df: DataFrame, a: str, b: str, y: str, steps: int = 1000) -> DataFrame:
    """RMSE of ``w a + (1 - w) b`` on a weight grid, from one pass of cross products."""
    u, v, t = F.col(a), F.col(b), F.col(y)
    ok = df.dropna(subset=[a, b, y])
    s = ok.agg(F.count(F.lit(1)).alias("n"), F.sum((u - v) * (u - v)).alias("dd"),
               F.sum((u - v) * (v - t)).alias("de"), F.sum((v - t) * (v - t)).alias("ee"))
    spark = df.sparkSession
    grid = spark.range(steps).select((F.col("id") / (steps - 1)).alias("w"))
    w = F.col("w")
    mse = (w * w * F.col("dd") + 2 * w * F.col("de") + F.col("ee")) / F.col("n")
    return attach_row(grid, s).select("w", F.sqrt(F.greatest(mse, F.lit(0.0))).alias("rmse"))


def best_blend(grid: DataFrame) -> DataFrame:
    return grid.agg(F.min_by("w", F.struct("rmse", "w")).alias("best_w"), F.min("rmse").alias("best_rmse"))


def error_columns(df: DataFrame, preds: Sequence[str], y: str) -> DataFrame:
    out = {}
    for p in preds:
        e = F.col(p) - F.col(y)
        out |= {f"err_{p}": e, f"abs_err_{p}": F.abs(e), f"sq_err_{p}": e * e}
    return df.withColumns(out)


def error_means(df: DataFrame, preds: Sequence[str], by: Column | str) -> DataFrame:
    """Mean absolute error of each model per group."""
    return df.groupBy(by).agg(*[F.avg(f"abs_err_{p}").alias(f"abs_err_{p}") for p in preds])


def model_rmse(df: DataFrame, preds: Sequence[str], y: str) -> DataFrame:
    one = df.agg(*[F.sqrt(F.avg(F.pow(F.col(p) - F.col(y), 2))).alias(p) for p in preds])
    return one.unpivot([], list(preds), "model", "rmse")


def class_weight(df: DataFrame, target: str, threshold: float = 1.0) -> DataFrame:
    """Negatives over positives; a null target counts as dry."""
    wet = F.coalesce(F.col(target) > threshold, F.lit(False))
    return df.agg(F.try_divide(F.count_if(~wet), F.count_if(wet)).alias("scale_pos_weight"))
