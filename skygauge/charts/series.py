"""From dots to daily values."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skygauge.operators.joins import interpolate, label_points, nearest_within


def tick_matches(ticks: DataFrame, dots: DataFrame, cand: DataFrame, tol: DataFrame) -> DataFrame:
    """Dot next to each tick, or next to where the day before or after would be.

    Targets are tried in order: the tick, then per spacing the day before and the
    day after. ``cand`` has plot_id, dx (ordered by size), ``tol`` plot_id, tol.
    """
    steps = cand.groupBy("plot_id").agg(F.sort_array(F.collect_set("dx")).alias("dxs"))
    t = ticks.join(steps, "plot_id").join(tol, "plot_id")
    own = F.array(F.struct(F.lit(0).alias("ord"), F.col("x").cast("double").alias("at"), F.lit(0).alias("days")))
    shifted = F.flatten(F.transform("dxs", lambda d, i: F.array(
        F.struct((2 * i + 1).alias("ord"), (F.col("x") - d).cast("double").alias("at"), F.lit(-1).alias("days")),
        F.struct((2 * i + 2).alias("ord"), (F.col("x") + d).cast("double").alias("at"), F.lit(1).alias("days")))))
    probe = t.select("plot_id", F.col("x").alias("x_tick"), "date", "label", "tol", F.explode(F.concat(own, shifted)).alias("c")).select(
        "plot_id", "x_tick", "date", "label", "tol", "c.ord", "c.at", "c.days")
    hit = nearest_within(probe, dots, "plot_id", "at", "tol", "x", ["y"], width=4.0)
    best = hit.groupBy("plot_id", "x_tick", "label").agg(
        F.min_by(F.struct("date", "days", "near"), "ord").alias("m"))
    return best.select("plot_id", "x_tick", "label", F.date_add("m.date", F.col("m.days")).alias("date"),
                       F.col("m.near._rx").alias("x"), F.col("m.near.y").alias("y"))


def pick_anchor(matches: DataFrame) -> DataFrame:
    """Match closest to its tick, the earliest tick on ties."""
    d = F.abs(F.col("x") - F.col("x_tick"))
    return matches.groupBy("plot_id").agg(
        F.min_by(F.struct("x", "y", "date"), F.struct(d, F.col("x_tick"))).alias("m")).select("plot_id", "m.*")


def map_by_anchor(dots: DataFrame, anchor: DataFrame, days: DataFrame) -> DataFrame:
    """Give the i-th dot from the anchor the i-th day from the anchor's day: ``plot_id, date, y``.

    ``days`` lists the dates of each plot; days no dot reaches are null.
    """
    ranked = dots.withColumn("i", F.row_number().over(Window.partitionBy("plot_id").orderBy("x", F.col("y").isNull(), "y")))
    dated = days.withColumn("j", F.row_number().over(Window.partitionBy("plot_id").orderBy("date")))
    a = anchor.select("plot_id", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("date").alias("adate"))
    ai = ranked.join(a, "plot_id").filter((F.col("x") == F.col("ax")) & (F.col("y") == F.col("ay"))).groupBy("plot_id").agg(F.min("i").alias("ai"))
    aj = dated.join(a, "plot_id").filter(F.col("date") == F.col("adate")).select("plot_id", "j").withColumnRenamed("j", "aj")
    shift = ai.join(aj, "plot_id").select("plot_id", (F.col("aj") - F.col("ai")).alias("shift"))
    placed = ranked.join(shift, "plot_id").select("plot_id", (F.col("i") + F.col("shift")).alias("j"), "y")
    return dated.join(shift.select("plot_id"), "plot_id", "left_semi").join(placed, ["plot_id", "j"], "left").select("plot_id", "date", "y")


def pixel_to_mm(series: DataFrame, labels: DataFrame, y: str = "y", out: str = "daily_rainfall_total_mm") -> DataFrame:
    """Linear value between labels, clamped beyond the outer ones."""
    return series.join(label_points(labels, "plot_id"), "plot_id").withColumn(
        out, interpolate(F.col(y).cast("double"), F.col("points"))).drop("points")


def dots_to_days(dots: DataFrame, plots: DataFrame, zero_tol: float = 0.5, gap_factor: int = 20) -> tuple[DataFrame, DataFrame]:
    """Older mapping: dots to day buckets, the largest value above ``zero_tol`` wins.

    ``dots`` has plot_id, x, value; ``plots`` plot_id, data_start, data_end, n_days.
    Days without a dot are 0, those inside a gap wider than ``gap_factor`` days null.
    Returns (plot_id, day, value) and per-plot conflict counts.
    """
    p = plots.select("plot_id", "data_start", "n_days", (F.col("data_end") - F.col("data_start")).cast("double").alias("width"))
    day = lambda x: F.bround((x - F.col("data_start")) / F.col("width") * (F.col("n_days") - 1)).cast("int")
    d = dots.join(p, "plot_id")
    nxt = F.lead("x").over(Window.partitionBy("plot_id").orderBy("x"))
    wide = d.withColumn("nxt", nxt).filter(F.col("nxt") - F.col("x") > gap_factor * F.col("width") / F.col("n_days"))
    a, b = day(F.col("x")) + 1, day(F.col("nxt")) - 1
    inside = F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    empty = wide.select("plot_id", F.explode(inside).alias("day")).distinct().withColumn("hole", F.lit(True))
    v = F.col("value")
    bucket = d.withColumn("day", day(F.col("x"))).filter("day >= 0 AND day < n_days").groupBy("plot_id", "day").agg(
        F.coalesce(F.max(F.when(v > zero_tol, v)), F.lit(0.0)).alias("value"),
        F.count_if(v > zero_tol).alias("n_wet"), F.count_if(v <= zero_tol).alias("n_zero"))
    spine = p.select("plot_id", F.explode(F.sequence(F.lit(0), F.col("n_days") - 1)).alias("day"))
    out = spine.join(bucket, ["plot_id", "day"], "left").join(empty, ["plot_id", "day"], "left").select(
        "plot_id", "day", F.when(F.col("n_wet").isNotNull(), F.col("value")).when(F.col("hole").isNull(), 0.0).alias("value"))
    flags = bucket.groupBy("plot_id").agg(
        F.count_if(F.col("n_wet") >= 2).alias("multi_dot_nonzero"),
        F.count_if((F.col("n_wet") == 1) & (F.col("n_zero") >= 1)).alias("mixed_zero_nonzero"))
    return out, flags


def missing_mask(grid: DataFrame, gaps: DataFrame) -> DataFrame:
    """Add ``missing``: whether a grid position lies in one of the plot's ranges [a, b]."""
    g = gaps.groupBy("plot_id").agg(F.collect_list(F.struct(F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))).alias("gs"))
    hit = F.exists("gs", lambda r: (F.col("x") >= r.a) & (F.col("x") <= r.b))
    return grid.join(g, "plot_id", "left").withColumn("missing", F.coalesce(hit, F.lit(False))).drop("gs")


def nearest_day(dots: DataFrame, plots: DataFrame) -> DataFrame:
    """Each dot to the closest of the plot's evenly spaced day positions; the rightmost dot of a day stays."""
    step = (F.col("data_end") - F.col("data_start")) / (F.col("n_days") - 1)
    pos = (F.col("x") - F.col("data_start")) / step
    day = F.greatest(F.lit(0), F.least(F.ceil(pos - 0.5), F.col("n_days") - 1)).cast("int")
    return dots.join(plots, "plot_id").withColumn("day", day).groupBy("plot_id", "day").agg(
        F.max_by("y", F.struct("x", "y")).alias("y"))


def absent_days(gaps: DataFrame, plots: DataFrame) -> DataFrame:
    """Days covered by pixel gaps of the colour presence: ``plot_id, day``; gap ends are relative to the start."""
    j = gaps.join(plots, "plot_id").withColumn("ppd", (F.col("data_end") - F.col("data_start")) / (F.col("n_days") - 1))
    n = F.bround((F.col("gap_end") - F.col("gap_start") + 1) / F.col("ppd")).cast("int")
    first = F.bround(F.col("gap_start") / F.col("ppd")).cast("int")
    days = F.when(n > 0, F.sequence(first, first + n - 1)).otherwise(F.array().cast("array<int>"))
    return j.select("plot_id", "n_days", F.explode(days).alias("day")).filter("day >= 0 AND day < n_days").select("plot_id", "day").distinct()


def one_dot_per_day(dots: DataFrame, plots: DataFrame, absent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dots to days with absent days left out: the closest dot keeps its day, the others are reported.

    A dot on an absent day moves to the nearest present one, the earlier on ties.
    """
    step = (F.col("data_end") - F.col("data_start")) / (F.col("n_days") - 1)
    raw = (F.col("x") - F.col("data_start")) / step
    d = dots.join(plots, "plot_id").withColumn("raw", raw).withColumn(
        "want", F.greatest(F.lit(0), F.least(F.bround("raw").cast("int"), F.col("n_days") - 1)))
    spine = plots.select("plot_id", F.explode(F.sequence(F.lit(0), F.col("n_days") - 1)).alias("want"))
    free = F.when(F.col("gone").isNull(), F.col("want"))
    s = spine.join(absent.select("plot_id", F.col("day").alias("want"), F.lit(True).alias("gone")), ["plot_id", "want"], "left")
    w = Window.partitionBy("plot_id")
    s = s.withColumns({
        "lo": F.last(free, ignorenulls=True).over(w.orderBy("want").rowsBetween(Window.unboundedPreceding, 0)),
        "hi": F.last(free, ignorenulls=True).over(w.orderBy(F.desc("want")).rowsBetween(Window.unboundedPreceding, 0))})
    near = F.when(F.col("lo").isNull(), F.col("hi")).when(F.col("hi").isNull(), F.col("lo")).when(
        F.col("want") - F.col("lo") <= F.col("hi") - F.col("want"), F.col("lo")).otherwise(F.col("hi"))
    placed = d.join(s.select("plot_id", "want", near.alias("day")), ["plot_id", "want"]).filter("day IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("plot_id", "day").orderBy(F.abs(F.col("raw") - F.col("day")), "x"))
    placed = placed.withColumn("rank", rank)
    return (placed.filter("rank = 1").select("plot_id", "day", "y"),
            placed.filter("rank > 1").select("plot_id", "day", "x", "y"))


def free_days(dots: DataFrame, plots: DataFrame, absent: DataFrame) -> DataFrame:
    """Every dot of a chart on a day of its own: ``plot_id, x, y, want, day``; day is null when no day is left.

    From left to right a dot takes its day, or the nearest present one where that is absent, or, if a dot
    before it has that one, the nearest day still free; of two equally near days the left one. Charts
    are solved apart; a chart has at most as many days as its year and dots as its pixel columns. The next free day on either side is found by jumping
    over taken days, and each jump is shortened for the next one.
    """
    step = (F.col("data_end") - F.col("data_start")) / (F.col("n_days") - 1)
    want = F.greatest(F.lit(0), F.least(F.bround((F.col("x") - F.col("data_start")) / step).cast("int"), F.col("n_days") - 1))
    d = dots.join(plots, "plot_id").select("plot_id", "n_days", F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), want.alias("want")).alias("dot"))
    charts = d.groupBy("plot_id", "n_days").agg(F.sort_array(F.collect_list("dot")).alias("dots"))
    gone = absent.groupBy("plot_id").agg(F.collect_set("day").alias("gone"))
    one = charts.join(gone, "plot_id", "left").select("plot_id", "n_days", F.col("dots.x").alias("x"), F.col("dots.y").alias("y"), F.col("dots.want").alias("want"), "gone")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                gone = [] if r.gone is None else r.gone
                present, free = FreeDays(r.n_days, gone), FreeDays(r.n_days, gone)
                days = []
                for w in r.want:
                    near = present.nearest(int(w))
                    days.append(None if near is None else free.nearest(near))
                    if days[-1] is not None:
                        free.take(days[-1])
                yield pd.DataFrame({"plot_id": r.plot_id, "x": r.x, "y": r.y, "want": r.want, "day": pd.array(days, "Int32")})

    return one.mapInPandas(place, "plot_id string, x double, y double, want int, day int")


class FreeDays:
    """Days 0..n-1, some taken; ``left[d]`` and ``right[d]`` lead towards the next free day on each side of a taken one."""

    def __init__(self, n: int, taken: Iterable[int]):
        self.n, self.left, self.right = n, list(range(-1, n)), list(range(n + 1))  # left is shifted by one, so that -1 has a place
        for d in taken:
            self.take(int(d))

    def take(self, day: int) -> None:
        self.left[day + 1], self.right[day] = day - 1, day + 1

    def _follow(self, links: list[int], at: int, shift: int) -> int:
        path = []
        while links[at + shift] != at:
            path.append(at)
            at = links[at + shift]
        for p in path:
            links[p + shift] = at
        return at

    def nearest(self, day: int) -> int | None:
        low, high = self._follow(self.left, day, 1), self._follow(self.right, day, 0)
        if low < 0 and high >= self.n:
            return None
        return low if high >= self.n or (low >= 0 and day - low <= high - day) else high


def length_check(series: DataFrame, days: DataFrame) -> DataFrame:
    """Plots whose series length differs from their calendar."""
    n = lambda df, name: df.groupBy("plot_id").agg(F.count(F.lit(1)).alias(name))
    j = n(days, "n_days").join(n(series, "n_series"), "plot_id", "left").withColumn("n_series", F.coalesce("n_series", F.lit(0)))
    return j.filter("n_days <> n_series")


def quarantine(plots: DataFrame, stages: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """First stage at which each plot is absent: ``plot_id, message``; plots that pass all are left out."""
    j = plots.select("plot_id").distinct()
    missed = []
    for i, (text, passed) in enumerate(stages):
        j = j.join(passed.select("plot_id").distinct().withColumn(f"_s{i}", F.lit(True)), "plot_id", "left")
        missed.append(F.when(F.col(f"_s{i}").isNull(), text))
    return j.withColumn("message", F.coalesce(*missed)).filter("message IS NOT NULL").select("plot_id", "message")
