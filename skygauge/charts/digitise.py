"""All charts from dots, ticks, labels and grid lines to daily series in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge.charts import axes, gaps, series
from skygauge.session import cut_lineage


@dataclass(frozen=True)
class Digitised:
    daily: DataFrame   # plot_id, date, daily_rainfall_total_mm
    failed: DataFrame  # plot_id, message


def digitise(dots: DataFrame, ticks: DataFrame, labels: DataFrame, grid: DataFrame, days: DataFrame,
             extent: DataFrame | None = None, tick_tol: float = 2.0, label_tol: float = 2.0) -> Digitised:
    """``days`` lists plot_id, date of each chart's file; ``extent`` is the blue extent, by default that of the dots.

    A chart that fails a stage has an empty series and a row in ``failed``. The inputs
    are read by most stages and are written out once.
    """
    dots, ticks, labels, grid, days = (cut_lineage(t) for t in (dots, ticks, labels, grid, days))
    extent = extent if extent is not None else dots.groupBy("plot_id").agg(
        F.min("x").alias("blue_min_x"), F.max("x").alias("blue_max_x"))
    snapped_labels = cut_lineage(axes.snap(labels, grid.filter("axis = 'y'"), "y", "value", label_tol))
    snapped = cut_lineage(axes.snap(ticks, grid.filter("axis = 'x'"), "x", "x", tick_tol))
    spacings = cut_lineage(gaps.common_spacings(dots))
    cand = cut_lineage(gaps.spacing_candidates(spacings))
    bounds = cut_lineage(axes.boundaries(extent, grid, snapped, cand.select("plot_id", F.col("c2").alias("delta"))))
    full = cut_lineage(axes.extend_ticks(snapped, bounds))
    window = axes.time_window(full, bounds)
    n_dots = dots.groupBy("plot_id").agg(F.count(F.lit(1)).alias("n_dots"))
    need = cut_lineage(window.join(n_dots, "plot_id").select("plot_id", (F.col("expected_n") - F.col("n_dots")).alias("n_missing")))

    length = days.groupBy("plot_id").agg(F.count(F.lit(1)).alias("n_days"))
    tol = length.select("plot_id", F.greatest(F.floor(365 / F.col("n_days")), F.lit(1)).cast("double").alias("tol"))
    anchor = cut_lineage(series.pick_anchor(series.tick_matches(snapped, dots, spacings, tol)))

    holes = cut_lineage(gaps.missing_ranges(dots, bounds, full, cand).join(need.filter("n_missing <> 0"), "plot_id", "left_semi"))
    options = gaps.gap_options(holes, need, cand)
    chosen = cut_lineage(gaps.choose_options(options))
    solved = need.filter("n_missing = 0").select("plot_id").unionByName(chosen.select("plot_id").distinct())
    points = gaps.insert_missing(dots, holes, chosen, cand, bounds).join(solved, "plot_id", "left_semi")
    mapped = series.map_by_anchor(points, anchor, days)
    out = cut_lineage(series.pixel_to_mm(mapped, snapped_labels).select("plot_id", "date", "daily_rainfall_total_mm"))
    failed = series.quarantine(days, [
        ("no dots", dots), ("no usable spacing", cand), ("no boundaries", bounds), ("no time window", need),
        ("missing points do not fit the gaps", solved), ("no anchor", out)])
    good = out.join(failed, "plot_id", "left_anti")
    mismatch = series.length_check(good, days.join(failed, "plot_id", "left_anti")).select(
        "plot_id", F.lit("series length differs from calendar").alias("message"))
    return Digitised(good.join(mismatch, "plot_id", "left_anti"), failed.unionByName(mismatch))
