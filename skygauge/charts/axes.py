"""Axes of charts: ticks, value labels, grid snapping, boundaries and time windows.

An axis carries a few dozen labels, ticks and lines, so per-plot arrays of them
are small whatever the number of charts.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skygauge.functions.calendar import floor_day, is_year_end, is_year_start

TOP_Y, BOTTOM_Y = 82.0, 618.0


def date_ticks(tokens: DataFrame, roi_x0: float = 0.0) -> DataFrame:
    """Tokens holding yyyy-MM[-dd] as ``plot_id, x, date, label``; charts with fewer than two are dropped."""
    m = lambda i: F.regexp_extract("text", r"(\d{4})-(\d{2})(?:-(\d{2}))?", i)
    day = F.when(m(3) == "", "01").otherwise(m(3))
    date = F.try_to_timestamp(F.concat_ws("-", m(1), m(2), day), F.lit("yyyy-MM-dd")).cast("date")
    t = tokens.filter(m(1) != "").select(
        "plot_id", (F.col("x") + F.col("w") / 2 + roi_x0).alias("x"), date.alias("date"),
        F.replace("text", F.lit(","), F.lit("")).alias("label")).filter("date IS NOT NULL")
    enough = t.groupBy("plot_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("plot_id")
    return t.join(enough, "plot_id", "left_semi")


def value_labels(tokens: DataFrame, top_y: float = TOP_Y, bottom_y: float = BOTTOM_Y, x_tol: float = 30.0) -> DataFrame:
    """Value axis from tokens as ``plot_id, value, x, y``.

    Keeps numbers of the label column that share the residue of the longest chain
    of steps, the lowest mark per value, and adds the zero and the top border.
    """
    t = tokens.filter(F.col("text").rlike(r"^\d+(\.\d+)?$")).select(
        "plot_id", F.col("text").try_cast("double").alias("value"), (F.col("x") + F.col("w") / 2).alias("x"),
        (F.col("y") + F.col("h") / 2).alias("y"))
    t = t.filter(((F.col("value") == 0) | (F.col("value") >= 10)) & (F.col("value") <= 300) & F.col("y").between(top_y, bottom_y))
    mid = t.groupBy("plot_id").agg(F.median("x").alias("mx"))
    column = t.join(mid, "plot_id").filter(F.abs(F.col("x") - F.col("mx")) <= x_tol).drop("mx")

    by_value = Window.partitionBy("plot_id").orderBy("value")
    steps = column.select("plot_id", "value", F.round(F.col("value") - F.lag("value").over(by_value), 3).alias("step")) \
        .filter("step > 1e-6").groupBy("plot_id", "step").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("at"))
    step = steps.groupBy("plot_id").agg(F.min_by("step", F.struct(-F.col("n"), F.col("at"))).alias("step"))

    in_class = column.join(step, "plot_id").withColumn("k", F.floor(F.col("value") / F.col("step") + 1e-9)) \
        .withColumn("residue", F.round(F.col("value") - F.col("k") * F.col("step"), 5))
    distinct = in_class.select("plot_id", "residue", "k", "value").distinct()
    ordered = Window.partitionBy("plot_id", "residue").orderBy("k")
    islands = distinct.withColumn("g", F.col("k") - F.row_number().over(ordered)).groupBy("plot_id", "residue", "g").agg(
        F.count(F.lit(1)).alias("len"), F.min("value").alias("start"))
    main = islands.groupBy("plot_id").agg(F.min_by("residue", F.struct(-F.col("len"), F.col("start"))).alias("residue"))
    kept = in_class.join(main, ["plot_id", "residue"]).groupBy("plot_id", "value").agg(
        F.max_by(F.struct("x", "y"), "y").alias("p"))

    row = F.struct("value", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    ends = kept.groupBy("plot_id").agg(F.min(row).alias("low"), F.max(row).alias("high"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    scale = F.abs(F.col("high.y") - F.col("low.y")) / (F.col("high.value") - F.col("low.value"))
    extra = ends.withColumn("scale", scale).select("plot_id", F.explode(F.array(
        F.struct(F.lit(0.0).alias("value"), F.col("low.x").alias("x"), (F.col("low.y") + F.col("low.value") * F.col("scale")).alias("y"), F.lit(1).alias("prio")),
        F.struct((F.col("high.value") + F.try_divide(F.col("high.y") - top_y, "scale")).alias("value"), F.col("high.x").alias("x"),
                 F.lit(top_y).alias("y"), F.lit(-1).alias("prio")))).alias("e")).select("plot_id", "e.*")
    found = kept.join(ends.select("plot_id"), "plot_id", "left_semi").select("plot_id", "value", "p.x", "p.y", F.lit(0).alias("prio"))
    # a found zero wins over the computed one, the top border over a label of the same value
    return found.unionByName(extra).groupBy("plot_id", "value").agg(F.min_by(F.struct("x", "y"), "prio").alias("p")).select(
        "plot_id", "value", "p.x", "p.y").filter("value IS NOT NULL")


def older_value_labels(tokens: DataFrame, top: DataFrame, x_cut: float) -> DataFrame:
    """Older rule: whole numbers below 200 left of ``x_cut``; the two lowest marks give the scale."""
    t = tokens.filter(F.col("text").rlike(r"^\d+$")).withColumn("value", F.col("text").try_cast("double")).filter(
        (F.col("value") < 200) & (F.col("x") + F.col("w") <= x_cut) & (F.col("w") >= 6) & (F.col("h") >= 8))
    t = t.select("plot_id", "value", (F.col("x") + F.col("w") / 2).alias("x"), (F.col("y") + F.col("h") / 2).alias("y"))
    lowest = t.groupBy("plot_id", "value").agg(F.max(F.struct("y", "x")).alias("p"))
    w = Window.partitionBy("plot_id").orderBy(F.desc("p.y"), "value")
    two = lowest.withColumn("i", F.row_number().over(w)).filter("i <= 2").groupBy("plot_id").agg(
        F.min_by(F.struct("value", "p.x", "p.y"), "i").alias("a"), F.max_by(F.struct("value", "p.x", "p.y"), "i").alias("b"),
        F.count(F.lit(1)).alias("n")).filter("n = 2")
    high = t.groupBy("plot_id").agg(F.max_by(F.struct("value", "x", "y"), F.struct("value", F.col("y"))).alias("m"))
    s = two.join(high, "plot_id").join(top, "plot_id", "left").withColumn(
        "scale", F.abs(F.col("b.y") - F.col("a.y")) / F.abs(F.col("b.value") - F.col("a.value")))
    zero = s.select("plot_id", F.lit(0.0).alias("value"), F.col("a.x").alias("x"), (F.col("a.y") + F.col("a.value") * F.col("scale")).alias("y"), F.lit(2).alias("prio"))
    border = s.filter("top IS NOT NULL").select(
        "plot_id", (F.col("m.value") + F.try_divide(F.col("m.y") - F.col("top"), "scale")).alias("value"), F.col("m.x").alias("x"),
        F.col("top").cast("double").alias("y"), F.lit(1).alias("prio"))
    found = lowest.join(s.select("plot_id"), "plot_id", "left_semi").select("plot_id", "value", "p.x", "p.y", F.lit(0).alias("prio"))
    out = found.unionByName(zero).unionByName(border).filter("value IS NOT NULL")
    return out.groupBy("plot_id", "value").agg(F.max_by(F.struct("x", "y"), "prio").alias("p")).select("plot_id", "value", "p.x", "p.y")


def award_lines(values: list[float], lines: list[float], tol: float) -> list[float | None]:
    """Each value in turn takes the nearest line that is still free and within ``tol``, the lower of two as near, or none.

    Links lead past taken lines to the next free one on either side, and shorten on the way.
    """
    lines = sorted(g for g in lines if g == g)
    n, out = len(lines), []
    below, above = list(range(n + 1)), list(range(n + 1))  # line i is i + 1 in ``below``; its 0 and the n of ``above`` stand for no line

    def free(links, i):
        while links[i] != i:
            links[i] = i = links[links[i]]
        return i

    for v in values:
        at = bisect_right(lines, v) if v == v else 0
        near = min(((abs(lines[i] - v), lines[i], i) for i in (free(below, at) - 1, free(above, at)) if 0 <= i < n), default=None)
        hit = near is not None and near[0] <= tol
        if hit:
            below[near[2] + 1], above[near[2]] = near[2], near[2] + 1
        out.append(near[1] if hit else None)
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _awarded(values: pd.Series, lines: pd.Series, tol: pd.Series) -> pd.Series:
    floats = lambda a: np.asarray(a, "float64").tolist()
    return pd.Series([award_lines(floats(v), floats(g), t) for v, g, t in zip(values, lines, tol)])


def snap(items: DataFrame, lines: DataFrame, value: str, order: str, tol: float = 2.0) -> DataFrame:
    """Move each item, in order, to the nearest grid line that is still free and within ``tol``.

    The award depends on the order, but only among items and lines that a chain of steps within ``tol`` connects:
    a chart is cut at wider steps, and each piece is awarded by itself.
    """
    it = items.select("plot_id", F.struct(F.col(order).alias("_o"), F.col(value).cast("double").alias("_v"), F.struct(*items.columns).alias("_row")).alias("it"))
    ln = lines.select("plot_id", F.col("pos").cast("double").alias("at")).dropna().distinct()
    both = it.withColumn("at", F.col("it._v")).unionByName(ln, allowMissingColumns=True)
    w = Window.partitionBy("plot_id").orderBy("at")
    wide = F.col("at") - F.lag("at").over(w) > tol
    pieces = both.withColumn("_cut", F.coalesce(wide, F.lit(False)).cast("int")).withColumn("piece", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    j = pieces.groupBy("plot_id", "piece").agg(
        F.sort_array(F.collect_list("it")).alias("its"), F.collect_list(F.when(F.col("it").isNull(), F.col("at"))).alias("free")).filter(F.size("its") > 0)
    lines_of = _awarded(F.col("its._v"), F.col("free"), F.lit(float(tol)))
    rows = j.select("its", lines_of.alias("line")).select(F.explode(F.arrays_zip("its", "line")).alias("z"))
    return rows.select("z.its._row.*", F.coalesce("z.line", "z.its._v").alias("_new")).withColumn(value, F.col("_new")).drop("_new")


def _grid_ends(grid: DataFrame) -> DataFrame:
    g = grid.filter("axis = 'x'").groupBy("plot_id").agg(F.sort_array(F.collect_set("pos")).alias("g")).filter(F.size("g") >= 4)
    n = F.size("g")
    return g.select("plot_id", F.get("g", F.lit(0)).alias("left"), F.get("g", F.lit(1)).alias("first_line"),
                    F.get("g", n - 2).alias("last_line"), F.get("g", n - 1).alias("right"))


def _bounds_input(extent: DataFrame, grid: DataFrame, ticks: DataFrame) -> DataFrame:
    last = ticks.groupBy("plot_id").agg(F.max_by("date", "x").alias("last_date"))
    return extent.join(_grid_ends(grid), "plot_id").join(last, "plot_id")


def boundaries(extent: DataFrame, grid: DataFrame, ticks: DataFrame, delta: DataFrame) -> DataFrame:
    """``data_start, data_end`` per plot; ``delta`` holds each plot's widest dot spacing."""
    j = _bounds_input(extent, grid, ticks).join(delta, "plot_id")
    hi, last, right = F.col("blue_max_x"), F.col("last_line"), F.col("right")
    start = F.when(F.col("blue_min_x") >= F.col("first_line") - F.col("delta"), F.col("first_line")).otherwise(F.col("left"))
    end = (F.when(is_year_end(F.col("last_date")), last)
           .when(is_year_start(F.col("last_date")), F.when(hi <= last + F.col("delta"), last).otherwise(right))
           .otherwise(F.when(hi <= last, last).otherwise(right)))
    return j.select("plot_id", F.when(start == F.col("left"), start + 2).otherwise(start).cast("int").alias("data_start"),
                    end.cast("int").alias("data_end"))


def older_boundaries(extent: DataFrame, grid: DataFrame, ticks: DataFrame, delta: DataFrame) -> DataFrame:
    """Older rule: without a year-start tick the blue extent may pass the border."""
    j = _bounds_input(extent, grid, ticks).join(delta, "plot_id")
    hi, last, right = F.col("blue_max_x"), F.col("last_line"), F.col("right")
    start = F.when(F.col("blue_min_x") >= F.col("first_line") - F.col("delta"), F.col("first_line")).otherwise(F.col("left"))
    end = F.when(is_year_start(F.col("last_date")), F.when(hi <= last, last).otherwise(right)).otherwise(
        F.when(hi <= right + F.col("delta"), last).otherwise(hi))
    return j.select("plot_id", start.cast("int").alias("data_start"), end.cast("int").alias("data_end"))


def tick_spacing(ticks: DataFrame) -> DataFrame:
    """Median pixel and time step between ordered ticks, with both ends."""
    w = Window.partitionBy("plot_id").orderBy("x")
    sec = F.unix_timestamp(F.col("date").cast("timestamp"))
    d = ticks.withColumn("sec", sec).withColumns({"dx": F.col("x") - F.lag("x").over(w), "dt": F.col("sec") - F.lag("sec").over(w)})
    end = F.struct("x", "sec")
    return d.groupBy("plot_id").agg(F.median("dx").alias("dx"), F.median("dt").alias("dt"), F.min(end).alias("first"), F.max(end).alias("last")) \
        .filter("dx > 0")


def extend_ticks(ticks: DataFrame, bounds: DataFrame) -> DataFrame:
    """Ticks continued by the median steps to both data boundaries: ``plot_id, x, sec, label``."""
    s = tick_spacing(ticks).join(bounds, "plot_id")
    left = F.floor((F.col("first.x") - F.col("data_start")) / F.col("dx")).cast("int")
    right = F.floor((F.col("data_end") - F.col("last.x")) / F.col("dx")).cast("int")
    none = F.array().cast("array<int>")
    steps = lambda n: F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(none)
    l = s.select("plot_id", F.explode(steps(left)).alias("k"), "dx", "dt", "first").select(
        "plot_id", (F.col("first.x") - F.col("k") * F.col("dx")).alias("x"), (F.col("first.sec") - F.col("k") * F.col("dt")).alias("sec"))
    r = s.select("plot_id", F.explode(steps(right)).alias("k"), "dx", "dt", "last").select(
        "plot_id", (F.col("last.x") + F.col("k") * F.col("dx")).alias("x"), (F.col("last.sec") + F.col("k") * F.col("dt")).alias("sec"))
    new = l.unionByName(r).withColumn("label", F.date_format(F.timestamp_seconds("sec"), "yyyy-MM"))
    own = ticks.select("plot_id", "x", F.unix_timestamp(F.col("date").cast("timestamp")).cast("double").alias("sec"), "label")
    return own.unionByName(new)


def pixel_time_fit(ticks: DataFrame) -> DataFrame:
    """Least squares ``sec = base + slope * x + intercept``; seconds count from the first tick, which keeps digits."""
    first = ticks.groupBy("plot_id").agg(F.min("sec").alias("base"))
    c = ticks.join(first, "plot_id").withColumn("s", F.col("sec") - F.col("base"))
    return c.groupBy("plot_id", "base").agg(F.regr_slope("s", "x").alias("slope"), F.regr_intercept("s", "x").alias("intercept"))


def _at(x: Column) -> Column:
    return F.timestamp_seconds(F.col("base") + F.col("slope") * x + F.col("intercept"))


def time_window(ticks: DataFrame, bounds: DataFrame, cutoff_hour: int = 16, cutoff_minute: int = 0) -> DataFrame:
    """First and last day between the boundaries and their number; a window that ends on 1 January loses that day."""
    j = pixel_time_fit(ticks).join(bounds, "plot_id")
    t0 = floor_day(_at(F.col("data_start")), cutoff_hour, cutoff_minute)
    t1 = floor_day(_at(F.col("data_end")), cutoff_hour, cutoff_minute)
    d = j.select("plot_id", t0.alias("a"), F.when(is_year_start(t1), F.date_sub(t1, 1)).otherwise(t1).alias("z"))
    return d.select("plot_id", F.least("a", "z").alias("t0"), F.greatest("a", "z").alias("t1")).withColumn(
        "expected_n", F.datediff("t1", "t0") + 1)


def missing_left_tick(ticks: DataFrame, border_x: float = 0.0, tolerance: float = 0.4) -> DataFrame:
    """A tick before the first one if the border leaves room for it, else the border itself."""
    full = ticks.select("plot_id", "x", F.unix_timestamp(F.col("date").cast("timestamp")).alias("sec"))
    j = pixel_time_fit(full).join(tick_spacing(ticks), "plot_id")
    cand = F.col("first.x") - F.col("dx")
    fits = cand >= border_x + tolerance * F.col("dx")
    x = F.when(fits, cand).otherwise(F.lit(float(border_x)))
    return j.select("plot_id", fits.alias("exists"), x.alias("x"), _at(x).alias("timestamp"),
                    F.when(fits, "estimated_missing_tick").otherwise("border_fallback").alias("method"))
