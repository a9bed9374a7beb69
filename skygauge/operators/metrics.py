"""Accuracy metrics of predicted against extracted or observed rain.

All are grouped aggregates with map-side partials. Thresholds that need the whole
group (90th percentile) are aggregated first and joined back on the group key;
that side holds one row per group and the optimiser picks the join by its size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def both_present(df: DataFrame, *cols: str) -> DataFrame:
    return df.dropna(subset=list(cols))


def pair_corr(a: Column, b: Column) -> Column:
    """Correlation over rows where both are present; null for one row or a constant."""
    ok = a.isNotNull() & b.isNotNull()
    a, b = F.when(ok, a), F.when(ok, b)
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def improvement_pct(base: Column, own: Column) -> Column:
    return F.try_divide(100.0 * (base - own), base)


def false_rain_rate(dry: Column, pred: Column, eps: float) -> Column:
    return F.try_divide(100.0 * F.count_if(dry & (pred > eps)), F.count_if(dry))


def global_errors(df: DataFrame, obs: str = "observed_mm", pred: str = "cv_predicted_mm") -> DataFrame:
    e = F.col(obs) - F.col(pred)
    return both_present(df, obs, pred).agg(
        F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"))


def r_squared(df: DataFrame, obs: str = "observed_mm", pred: str = "cv_predicted_mm") -> DataFrame:
    """1 - SSE / SST in one pass; SST is the population variance times n."""
    e = F.col(obs) - F.col(pred)
    return both_present(df, obs, pred).agg(
        (1 - F.try_divide(F.sum(e * e), F.var_pop(obs) * F.count(obs))).alias("r2"))


def zero_rain_false_rate(df: DataFrame, eps: float = 5.0) -> DataFrame:
    """A dry day without prediction stays in the denominator."""
    return df.agg(false_rain_rate(F.col("extracted_mm") == 0, F.col("cv_predicted_mm"), eps)
                  .alias("zero_rain_false_rate_pct"))


def signed_error(df: DataFrame) -> DataFrame:
    return both_present(df, "observed_mm", "cv_predicted_mm").agg(
        F.avg(F.col("observed_mm") - F.col("cv_predicted_mm")).alias("mae"))


def with_group_threshold(df: DataFrame, keys: Sequence[str], col: str, p: float = 0.9,
                         discrete: bool = True, out: str = "p90") -> DataFrame:
    """Join each row with its group's exact percentile of ``col``."""
    kind = "percentile_disc" if discrete else "percentile_cont"
    thr = df.groupBy(*keys).agg(F.expr(f"{kind}({p}) WITHIN GROUP (ORDER BY {col})").alias(out))
    return df.join(thr, list(keys))


def group_metrics(df: DataFrame, keys: Sequence[str], eps: float = 5.0) -> DataFrame:
    """mae, rmse, bias, corr, false rain rate and extreme mae per group."""
    base = with_group_threshold(both_present(df, "extracted_mm", "cv_predicted_mm"), keys, "extracted_mm")
    x, p = F.col("extracted_mm"), F.col("cv_predicted_mm")
    e = p - x
    return base.groupBy(*keys).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"),
        pair_corr(x, p).alias("corr"), false_rain_rate(x == 0, p, eps).alias("false_rain_rate"),
        F.avg(F.when(x >= F.col("p90"), F.abs(e))).alias("extreme_mae"))


def baseline_comparison(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Own error against the distance to the second model, overall and on extreme days."""
    base = with_group_threshold(
        both_present(df, "cv_predicted_mm", "extracted_mm", "obs_predicted_mm"), keys, "extracted_mm")
    own = F.abs(F.col("cv_predicted_mm") - F.col("extracted_mm"))
    ref = F.abs(F.col("cv_predicted_mm") - F.col("obs_predicted_mm"))
    hot = F.col("extracted_mm") >= F.col("p90")
    m = base.groupBy(*keys).agg(
        F.avg(own).alias("year_mae"), F.avg(ref).alias("baseline_mae"),
        F.avg(F.when(hot, own)).alias("year_extreme_mae"),
        F.avg(F.when(hot, ref)).alias("baseline_extreme_mae"))
    return m.select(
        *keys, "year_mae", "baseline_mae",
        improvement_pct(F.col("baseline_mae"), F.col("year_mae")).alias("mae_improvement_pct"),
        "year_extreme_mae", "baseline_extreme_mae",
        improvement_pct(F.col("baseline_extreme_mae"), F.col("year_extreme_mae")).alias("extreme_improvement_pct"))


def extreme_day_errors(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    base = with_group_threshold(both_present(df, "cv_predicted_mm", "extracted_mm"), keys, "extracted_mm")
    return base.filter("extracted_mm >= p90").select(
        *keys, "date", "extracted_mm",
        F.abs(F.col("cv_predicted_mm") - F.col("extracted_mm")).alias("abs_error"))


def rollup_errors(df: DataFrame) -> DataFrame:
    """Whole table, per location and per location-year in one aggregate."""
    e = F.col("cv_predicted_mm") - F.col("extracted_mm")
    base = both_present(df, "extracted_mm", "cv_predicted_mm")
    return base.groupingSets([[], ["location"], ["location", "year"]], "location", "year").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))


def histogram(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """1 mm bins per group, zero bins included, the last bin closed.

    Counts are aggregated per bin before the spine is built, so the spine join
    sees one row per bin and not one per value.
    """
    keys = list(keys)
    vals = df.dropna(subset=[col])
    n_bins = F.greatest(F.ceil(F.max(col)).cast("int"), F.lit(1))
    spine = vals.groupBy(*keys).agg(n_bins.alias("n_bins"))
    per_floor = vals.groupBy(*keys, F.floor(col).cast("int").alias("raw")).agg(F.count(F.lit(1)).alias("n"))
    counts = (
        per_floor.join(spine, keys)
        .groupBy(*keys, F.least("raw", F.col("n_bins") - 1).alias("bin"))
        .agg(F.sum("n").alias("n"))
    )
    bins = spine.select(*keys, F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("bin"))
    return bins.join(counts, keys + ["bin"], "left").select(
        *keys, "bin", F.format_string("%d.0–%d.0", F.col("bin"), F.col("bin") + 1).alias("label"),
        F.coalesce("n", F.lit(0)).alias("n"))


def axis_bounds(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Calibration axis up to the next 10; error axis up to the next 5, at least 5."""
    both = F.col("extracted_mm").isNotNull() & F.col("cv_predicted_mm").isNotNull()
    top = F.max(F.when(both, F.greatest("extracted_mm", "cv_predicted_mm")))
    err = F.max(F.abs(F.col("observed_mm") - F.col("extracted_mm")))
    return df.groupBy(*keys).agg(
        (F.ceil(top / 10) * 10).cast("double").alias("axis_max"),
        F.coalesce(F.greatest(F.ceil(err / 5) * 5, F.lit(5)), F.lit(5)).cast("double").alias("error_max"))
