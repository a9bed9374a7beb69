"""Fitted tables: medians, target encodings and quantiles, and their application."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge.functions import evaluation as ev
from skygauge.operators.ordering import attach_row, column_quantiles

QUANTILES = {"q90": 0.90, "q95": 0.95, "q99": 0.99, "q995": 0.995, "q999": 0.999, "max": 1.0}


def location_medians(df: DataFrame, cols: Sequence[str], group: str = "location") -> DataFrame:
    """Exact medians per group; a group is bounded by the days of the calendar."""
    return df.groupBy(group).agg(*[F.median(c).alias(f"{c}_loc") for c in cols])


def global_medians(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact medians of whole columns as one row; all columns share one sort."""
    q = column_quantiles(df, cols, [0.5])
    return q.agg(*[F.max(F.when(F.col("column") == c, F.get("q", F.lit(0)))).alias(f"{c}_all") for c in cols])


def impute_medians(df: DataFrame, cols: Sequence[str], local: DataFrame, overall: DataFrame,
                   group: str = "location") -> DataFrame:
    """Missing values from the group's median, then from the global one."""
    j = attach_row(df.join(local, group, "left"), overall)
    filled = {c: F.coalesce(F.col(c), F.col(f"{c}_loc"), F.col(f"{c}_all")) for c in cols}
    return j.withColumns(filled).select(*df.columns)


def fit_target_encoding(df: DataFrame, target: str, keys: Sequence[str] = ("location", "month"),
                        alpha: float = 50.0, out: str = "te_location_month") -> tuple[DataFrame, DataFrame]:
    """Smoothed mean per cell, and the one-row global mean."""
    overall = df.agg(F.avg(target).alias("global_mean"))
    n = F.count(target)
    cells = df.groupBy(*keys).agg(F.sum(target).alias("_s"), n.alias("_n"))
    enc = (F.coalesce("_s", F.lit(0.0)) + F.col("global_mean") * alpha) / (F.col("_n") + alpha)
    cells = attach_row(cells, overall).select(*keys, enc.alias(out))
    return cells, overall


def apply_target_encoding(df: DataFrame, cells: DataFrame, overall: DataFrame,
                          keys: Sequence[str] = ("location", "month"), out: str = "te_location_month") -> DataFrame:
    """Cell value, or the global mean for an unseen cell."""
    j = attach_row(df.join(cells, list(keys), "left"), overall)
    return j.withColumn(out, F.coalesce(out, "global_mean")).drop("global_mean")


def location_quantiles(df: DataFrame, target: str, group: str = "location") -> DataFrame:
    """Linear upper quantiles per group, one column each."""
    ps = ", ".join(str(p) for p in QUANTILES.values())
    q = df.groupBy(group).agg(F.expr(f"percentile({target}, array({ps}))").alias("_q"))
    return q.select(group, *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(QUANTILES)])


def sample_weights(df: DataFrame, target: str, group: str = "location", date: str = "date") -> DataFrame:
    """``location, date, weight``: tiers by the upper quantiles of the row's own station."""
    j = df.join(location_quantiles(df, target, group), group)
    w = ev.sample_weight(F.col(target), *[F.col(q) for q in ("q90", "q95", "q99", "q995", "q999")])
    return j.select(group, date, w.alias("weight"))
