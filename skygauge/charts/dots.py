"""From chart pixels to dots, for all charts in one job.

Pixels are rows ``plot_id, x, y, r, g, b``. Neighbourhoods are joins on plot and
place, so one large chart spreads over tasks like many small ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skygauge.session import cut_lineage

# Colour of the series and its HSV band (hue in half degrees).
DOT_RGB = (31, 119, 180)
BLUE_HUE, BLUE_SAT, BLUE_VAL = (100, 130), (50, 255), (30, 255)
BUCKET = 64


def near_rgb(rgb: tuple[int, int, int] = DOT_RGB, tolerance: int = 5) -> Column:
    test = F.lit(True)
    for name, want in zip("rgb", rgb):
        test = test & (F.abs(F.col(name) - want) <= tolerance)
    return test


def is_blue() -> Column:
    """HSV test on 8-bit r, g, b with hue halved to 0..180."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d = hi - lo
    hue = (F.when(d == 0, 0.0).when(hi == r, 60 * F.try_divide(g - b, d))
           .when(hi == g, 120 + 60 * F.try_divide(b - r, d)).otherwise(240 + 60 * F.try_divide(r - g, d)))
    h = F.round(F.when(hue < 0, hue + 360).otherwise(hue) / 2)
    s = F.round(F.coalesce(F.try_divide(255 * d, hi), F.lit(0.0)))
    return h.between(*BLUE_HUE) & s.between(*BLUE_SAT) & hi.between(*BLUE_VAL)


def solid_centres(mask: DataFrame) -> DataFrame:
    """Pixels whose whole 3 x 3 neighbourhood is set: first by row, then the survivors by column.

    One shuffle per axis and no copies of pixels; a window holds one row or column of a chart.
    """
    def inner(df: DataFrame, along: str, across: str) -> DataFrame:
        w = Window.partitionBy("plot_id", across).orderBy(along)
        d = df.withColumns({"_p": F.lag(along).over(w), "_n": F.lead(along).over(w)})
        return d.filter((F.col("_p") == F.col(along) - 1) & (F.col("_n") == F.col(along) + 1)).drop("_p", "_n")

    rows = mask.select("plot_id", "x", "y").repartition("plot_id", "y").dropDuplicates()
    return inner(inner(rows, "x", "y"), "y", "x")


def dot_mask(pixels: DataFrame, rgb: tuple[int, int, int] = DOT_RGB, tolerance: int = 5,
             roi: tuple[int, int, int, int] | None = None) -> DataFrame:
    near = pixels.filter(near_rgb(rgb, tolerance))
    if roi is not None:
        x0, x1, y0, y1 = roi
        near = near.filter((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))
    return solid_centres(near)


def runs(mask: DataFrame, along: str = "x", across: str = "y") -> DataFrame:
    """Maximal runs of set pixels: ``plot_id, <across>, a, z, length``."""
    w = Window.partitionBy("plot_id", across).orderBy(along)
    d = mask.select("plot_id", "x", "y").distinct()
    d = d.withColumn("_g", F.col(along) - F.row_number().over(w))
    return d.groupBy("plot_id", across, "_g").agg(
        F.min(along).alias("a"), F.max(along).alias("z"), F.count(F.lit(1)).alias("length")).drop("_g")


def residual_mask(mask: DataFrame, horizontal: int = 2, vertical: int = 5) -> DataFrame:
    """Pixels outside every horizontal run >= 2 and every vertical run >= 5 (older extractor)."""
    def covered(along: str, across: str, least: int) -> DataFrame:
        return runs(mask, along, across).filter(F.col("length") >= least).select(
            "plot_id", across, F.explode(F.sequence("a", "z")).alias(along))

    keys = ["plot_id", "x", "y"]
    return mask.select(*keys).distinct().join(covered("x", "y", horizontal), keys, "left_anti") \
        .join(covered("y", "x", vertical), keys, "left_anti")


def labelled_runs(mask: DataFrame) -> DataFrame:
    """Horizontal runs with the label of their 8-connected component.

    Labels fall to the smallest one among touching runs and then jump to the label
    of their label, so the rounds grow with the logarithm of a component's extent.
    """
    node = F.struct("y", "a")
    r = cut_lineage(runs(mask).withColumn("id", node).select("plot_id", "id", "y", "a", "z", "length"))
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / BUCKET), F.floor(hi / BUCKET)))
    upper = r.select("plot_id", F.col("id").alias("u"), (F.col("y") + 1).alias("yy"), F.col("a").alias("ua"), F.col("z").alias("uz"),
                     cells(F.col("a") - 1, F.col("z") + 1).alias("cell"))
    lower = r.select("plot_id", F.col("id").alias("v"), F.col("y").alias("yy"), "a", "z", cells(F.col("a"), F.col("z")).alias("cell"))
    touch = upper.join(lower, ["plot_id", "yy", "cell"]).filter("ua <= z + 1 AND a <= uz + 1").select("plot_id", "u", "v").distinct()
    edges = cut_lineage(touch.unionByName(touch.select("plot_id", F.col("v").alias("u"), F.col("u").alias("v"))))
    lab = r.select("plot_id", "id", F.col("id").alias("label"))
    while True:
        seen = edges.join(lab.select("plot_id", F.col("id").alias("v"), "label"), ["plot_id", "v"]).groupBy(
            "plot_id", F.col("u").alias("id")).agg(F.min("label").alias("near"))
        low = lab.join(seen, ["plot_id", "id"], "left").select(
            "plot_id", "id", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        low = cut_lineage(low)
        target = low.select("plot_id", F.col("id").alias("label"), F.col("label").alias("further"))
        jumped = low.join(target, ["plot_id", "label"]).select("plot_id", "id", "old", F.col("further").alias("label"))
        jumped = cut_lineage(jumped)
        lab = jumped.select("plot_id", "id", "label")
        if jumped.filter(F.col("old") != F.col("label")).isEmpty():
            break
    return r.join(lab, ["plot_id", "id"])


def component_dots(mask: DataFrame, split_by: str = "mean", min_area: int = 1, split_wide: bool = True) -> DataFrame:
    """Centre of every component; one at least twice as wide as high becomes two dots.

    ``split_by`` "mean" truncates means and moves the right dot by one pixel;
    "median" takes medians of both halves.
    """
    r = cut_lineage(labelled_runs(mask))
    sum_x = (F.col("a") + F.col("z")) * F.col("length") / 2
    comp = r.groupBy("plot_id", "label").agg(
        F.sum("length").alias("area"), F.sum(sum_x).alias("sx"), F.sum(F.col("y") * F.col("length")).alias("sy"),
        (F.max("z") - F.min("a") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"), F.min("a").alias("x0"),
    ).filter(F.col("area") >= min_area)
    centre = comp.select("plot_id", "label", F.lit(0).alias("part"), (F.col("sx") / F.col("area")).cast("int").alias("x"),
                         (F.col("sy") / F.col("area")).cast("int").alias("y"), (F.col("w") >= 2 * F.col("h")).alias("wide"))
    if not split_wide:
        return centre.select("plot_id", "x", "y")
    wide = centre.filter("wide").select("plot_id", "label")
    px = r.join(wide, ["plot_id", "label"]).select("plot_id", "label", "y", F.explode(F.sequence("a", "z")).alias("x"))
    mid = px.groupBy("plot_id", "label").agg(F.median("x").alias("mid"))
    halves = px.join(mid, ["plot_id", "label"]).withColumn("part", F.when(F.col("x") <= F.col("mid"), 1).otherwise(2))
    if split_by == "mean":
        x, y = F.avg("x").cast("int") + F.when(F.first("part") == 2, 1).otherwise(0), F.avg("y").cast("int")
    else:
        x, y = F.median("x").cast("int"), F.median("y").cast("int")
    two = halves.groupBy("plot_id", "label", "part").agg(x.alias("x"), y.alias("y"))
    both = two.filter("part = 2").select("plot_id", "label")
    pair = two.join(both, ["plot_id", "label"], "left_semi")
    single = centre.join(both, ["plot_id", "label"], "left_anti")
    return single.select("plot_id", "x", "y").unionByName(pair.select("plot_id", "x", "y"))


def blue_extent(mask: DataFrame) -> DataFrame:
    return mask.groupBy("plot_id").agg(F.min("x").alias("blue_min_x"), F.max("x").alias("blue_max_x"))


def top_border(pixels: DataFrame, bounds: DataFrame, min_row: int = 10, share: float = 0.2, dark: int = 200) -> DataFrame:
    """First row from ``min_row`` whose dark pixels exceed a share of the plot's width; ``bounds`` has left, right."""
    grey = F.round(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b"))
    p = pixels.join(bounds, "plot_id").filter(
        (F.col("x") >= F.col("left")) & (F.col("x") < F.col("right")) & (F.col("y") >= min_row) & (grey <= dark))
    rows = p.groupBy("plot_id", "y").agg(F.count(F.lit(1)).alias("n"), F.first(F.col("right") - F.col("left")).alias("width"))
    return rows.filter(F.col("n") > F.col("width") * share).groupBy("plot_id").agg(F.min("y").alias("top"))


def border_stats(grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spread of the outer grid lines over charts, and how often each position occurs."""
    outer = grid.groupBy("plot_id", "axis").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    long = outer.unpivot(["plot_id", "axis"], ["first", "last"], "side", "pos")
    stats = long.groupBy("axis", "side").agg(
        F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.stddev_pop("pos").alias("std"))
    return stats, long.groupBy("axis", "side", "pos").agg(F.count(F.lit(1)).alias("n"))
