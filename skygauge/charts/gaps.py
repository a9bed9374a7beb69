"""Missing points between dots: spacings, gaps, how many points each gap lacks, and where they sit.

A chart spans at most a few hundred days, which bounds its dots, gaps and options.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skygauge.functions.calendar import is_year_start

NO_RATIO = 1e9  # target or ratio when one kind of interval is absent


def _steps(dots: DataFrame) -> DataFrame:
    w = Window.partitionBy("plot_id").orderBy("x")
    return dots.select("plot_id", "x", F.lead("x").over(w).alias("nxt")).filter("nxt IS NOT NULL").withColumn(
        "dx", F.col("nxt") - F.col("x"))


def common_spacings(dots: DataFrame, top_k: int = 3) -> DataFrame:
    """Most frequent positive spacing and its neighbours one pixel apart: ``plot_id, rank, dx, n``.

    Ties go to the spacing seen first from the left.
    """
    counts = _steps(dots).filter("dx > 0").groupBy("plot_id", "dx").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("at"))
    base = counts.groupBy("plot_id").agg(F.min_by("dx", F.struct(-F.col("n"), F.col("at"))).alias("base"))
    near = counts.join(base, "plot_id").filter(F.abs(F.col("dx") - F.col("base")) <= 1)
    prio = F.when(F.col("dx") == F.col("base"), 0).when(F.col("dx") < F.col("base"), 1).otherwise(2)
    w = Window.partitionBy("plot_id").orderBy(F.desc("n"), prio)
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k).select("plot_id", "rank", "dx", "n")


def spacing_candidates(spacings: DataFrame) -> DataFrame:
    """Smallest and largest spacing with the target ratio of their counts."""
    g = spacings.groupBy("plot_id").agg(
        F.min("dx").alias("c1"), F.max("dx").alias("c2"), F.min_by("n", "dx").alias("n1"), F.max_by("n", "dx").alias("n2"))
    return g.withColumn("target", F.col("n1") / F.col("n2"))


def missing_ranges(dots: DataFrame, bounds: DataFrame, ticks: DataFrame, cand: DataFrame) -> DataFrame:
    """Pixel ranges that lack points, in order: ``plot_id, gap, x_left, x_right``.

    ``ticks`` has plot_id, x, sec; only the last one matters.
    """
    ends = dots.groupBy("plot_id").agg(F.min("x").alias("x_first"), F.max("x").alias("x_last"))
    last = ticks.groupBy("plot_id").agg(F.max_by(F.to_date(F.timestamp_seconds("sec")), "x").alias("last_date"))
    j = ends.join(bounds, "plot_id").join(last, "plot_id").join(cand.select("plot_id", "c2"), "plot_id")
    rng = lambda a, b: F.struct(F.col(a).cast("double").alias("x_left") if isinstance(a, str) else a.cast("double").alias("x_left"),
                                (F.col(b) if isinstance(b, str) else b).cast("double").alias("x_right"))
    lead = F.when(F.col("x_first") > F.col("data_start"), rng(F.col("data_start") - F.col("c2"), "x_first"))
    room = F.col("data_end") - F.col("x_last")
    tail = F.when(room > 0, F.when(~is_year_start(F.col("last_date")), rng("x_last", F.col("data_end") + F.col("c2")))
                  .when(room >= F.col("c2") + 1, rng("x_last", "data_end")))
    edges = j.select("plot_id", F.explode(F.array_compact(F.array(lead, tail))).alias("r")).select("plot_id", "r.*")
    inner = _steps(dots).join(cand.select("plot_id", "c2"), "plot_id").filter(F.col("dx") > F.col("c2") + 1).select(
        "plot_id", F.col("x").cast("double").alias("x_left"), F.col("nxt").cast("double").alias("x_right"))
    w = Window.partitionBy("plot_id").orderBy("x_left", "x_right")
    return edges.unionByName(inner).withColumn("gap", F.row_number().over(w) - 1).select("plot_id", "gap", "x_left", "x_right")


def gap_options(gaps: DataFrame, missing: DataFrame, cand: DataFrame) -> DataFrame:
    """Feasible numbers of extra points per gap with their split and cost.

    A gap of ``extra + 1`` points has ``extra + 2`` intervals, ``a`` of the small and
    ``b`` of the large spacing. ``missing`` has plot_id, n_missing. Only interval
    counts that the spacings admit are generated.
    """
    n_gaps = gaps.groupBy("plot_id").agg(F.count(F.lit(1)).alias("n_gaps"))
    j = gaps.join(n_gaps, "plot_id").join(missing, "plot_id").join(cand, "plot_id").withColumn(
        "remaining", (F.col("n_missing") - F.col("n_gaps")).cast("int")).filter("remaining >= 0")
    dx = F.abs(F.col("x_right") - F.col("x_left"))
    lo = F.greatest(F.ceil(dx / F.col("c2")), F.lit(2)).cast("int")
    hi = F.least(F.floor(dx / F.col("c1")), F.col("remaining") + 2).cast("int")
    o = j.withColumn("dx", dx).withColumn("m", F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))))
    d = F.col("c2") - F.col("c1")
    over = F.col("dx") - F.col("m") * F.col("c1")
    b = F.when(d == 0, F.when(over == 0, 0.0)).when(over % F.nullif(d, F.lit(0)) == 0, F.try_divide(over, d))
    o = o.withColumn("b", b.cast("int")).filter("b IS NOT NULL AND b BETWEEN 0 AND m").withColumn("a", F.col("m") - F.col("b"))
    ratio = F.when(F.col("b") == 0, NO_RATIO).otherwise(F.try_divide(F.col("a"), F.col("b")))
    return o.select("plot_id", "gap", "n_gaps", "remaining", (F.col("m") - 2).alias("extra"), "a", "b",
                    F.abs(ratio - F.col("target")).alias("cost"))


def _choose(pdf: pd.DataFrame) -> pd.DataFrame:
    """One option per gap so that the extras sum to ``remaining`` at least cost; empty if there is none."""
    cols = ["plot_id", "gap", "extra", "a", "b", "cost"]
    pdf = pdf.sort_values(["gap", "extra"], ascending=[True, False], ignore_index=True)  # ties: smallest earlier sum
    remaining, n_gaps = int(pdf.remaining.iloc[0]), int(pdf.n_gaps.iloc[0])
    extra, step = pdf.extra.to_numpy(), pdf.cost.to_numpy()
    first = np.searchsorted(pdf.gap.to_numpy(), np.arange(n_gaps + 1))
    cost = np.full(remaining + 1, np.inf)
    cost[0] = 0.0
    picks = []
    for gap in range(n_gaps):
        best, pick = np.full(remaining + 1, np.inf), np.full(remaining + 1, -1)
        for row in range(first[gap], first[gap + 1]):
            e = extra[row]
            cand = cost[:remaining + 1 - e] + step[row]
            better = cand < best[e:]
            best[e:][better], pick[e:][better] = cand[better], row
        cost = best
        picks.append(pick)
    if not np.isfinite(cost[remaining]):
        return pdf.loc[[], cols]
    rows, s = [], remaining
    for pick in reversed(picks):
        rows.append(pick[s])
        s -= extra[pick[s]]
    return pdf.loc[rows, cols]


def choose_options(options: DataFrame) -> DataFrame:
    """Solve every chart at once, one small table per chart."""
    return options.groupBy("plot_id").applyInPandas(
        _choose, "plot_id string, gap int, extra int, a int, b int, cost double")


def insert_missing(dots: DataFrame, gaps: DataFrame, chosen: DataFrame, cand: DataFrame, bounds: DataFrame) -> DataFrame:
    """Dots with the missing points added, ``y`` null; a leading gap starts at the data boundary."""
    first = dots.groupBy("plot_id").agg(F.min("x").alias("x_first"))
    g = chosen.join(gaps, ["plot_id", "gap"]).join(cand.select("plot_id", "c1", "c2"), "plot_id").join(bounds, "plot_id").join(first, "plot_id")
    steps = lambda n: F.least(n, F.col("a")) * F.col("c1") + F.greatest(n - F.col("a"), F.lit(0)) * F.col("c2")
    k = F.col("k")
    leading = (F.col("gap") == 0) & (F.col("x_first") > F.col("x_left"))
    pts = g.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("extra") + 1)))
    x = F.when(leading, F.col("data_start") + steps(k) - steps(F.lit(1))).otherwise(F.col("x_left") + steps(k))
    new = pts.select("plot_id", x.cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    return dots.select("plot_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).unionByName(new)


# ---- older gap rules --------------------------------------------------------

def allocate_slots(gaps: DataFrame, missing: DataFrame) -> DataFrame:
    """Older rule: missing points shared over gaps by width, floored, then repaired to the total.

    ``gaps`` has plot_id, a, b (inclusive pixels), ``missing`` plot_id, n_missing. Repair is
    a loop in the rule; here surplus is taken from the narrowest gaps first and a
    shortfall goes to the leading gap, else to the widest one.
    """
    w = Window.partitionBy("plot_id")
    order = w.orderBy("a")
    g = gaps.join(missing, "plot_id").withColumn("len", (F.col("b") - F.col("a") + 1).cast("double"))
    g = g.withColumns({"share": F.col("len") / F.sum("len").over(w) * F.col("n_missing"), "i": F.row_number().over(order)})
    floor = F.greatest(F.floor("share"), F.lit(1))
    g = g.withColumn("k", F.when((F.col("a") != 0) & (F.col("share") > 1) & (F.col("share") < 2), 1).otherwise(floor))
    g = g.withColumn("over", F.sum("k").over(w) - F.col("n_missing"))
    spare = F.when(F.col("a") != 0, F.col("k") - 1).otherwise(0)
    g = g.withColumn("spare", spare).withColumn(
        "before", F.coalesce(F.sum("spare").over(w.orderBy("len", "i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = F.least("spare", F.greatest(F.col("over") - F.col("before"), F.lit(0)))
    wide = F.row_number().over(w.orderBy(F.desc("len"), "i")) == 1
    leading = F.min("a").over(w) == 0
    takes = F.when(leading, F.col("i") == 1).otherwise(wide)
    k = F.when(F.col("n_missing") <= 0, 0).otherwise(
        F.col("k") - cut + F.when(takes & (F.col("over") < 0), -F.col("over")).otherwise(0))
    return g.withColumn("slots", k.cast("int")).select("plot_id", "a", "b", "slots")


def spread_slots(slots: DataFrame) -> DataFrame:
    """Positions of the allocated points, evenly inside their gap."""
    k = F.explode(F.when(F.col("slots") > 0, F.sequence(F.lit(1), F.col("slots"))).otherwise(F.array().cast("array<int>")))
    return slots.withColumn("k", k).select(
        "plot_id", (F.col("a") + F.col("k") * (F.col("b") - F.col("a")) / (F.col("slots") + 1)).alias("x"))


def points_per_gap(dots: DataFrame, gaps: DataFrame, px_per_day: float) -> DataFrame:
    """Older rule: a gap between two dots, or outside all, holds its width over px/day points (at least one)."""
    own = dots.select("plot_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    n = F.greatest(F.bround((F.col("b") - F.col("a") + 1) / px_per_day), F.lit(1)).cast("int")
    clear = _clear_gaps(dots, gaps)
    new = clear.withColumn("k", F.explode(F.sequence(F.lit(0), n - 1))).select(
        "plot_id", (F.col("a") + (F.col("k") + 0.5) * px_per_day).alias("x"), F.lit(None).cast("double").alias("y"))
    return own.unionByName(new)


def _clear_gaps(dots: DataFrame, gaps: DataFrame) -> DataFrame:
    """Gaps that hold no dot strictly or on their edge."""
    marks = dots.select("plot_id", F.col("x").alias("p"), F.lit(None).cast("double").alias("b")).unionByName(
        gaps.select("plot_id", F.col("a").alias("p"), F.col("b").cast("double").alias("b")))
    w = Window.partitionBy("plot_id").orderBy(F.col("p"), F.col("b").isNotNull())
    ahead = Window.partitionBy("plot_id").orderBy(F.desc("p"), F.col("b").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    dot = F.when(F.col("b").isNull(), F.col("p"))
    nxt = F.last(dot, ignorenulls=True).over(ahead)
    m = marks.withColumns({"nxt": nxt, "prev": F.last(dot, ignorenulls=True).over(w)})
    return m.filter("b IS NOT NULL AND (nxt IS NULL OR nxt > b) AND (prev IS NULL OR prev < p)").select(
        "plot_id", F.col("p").alias("a"), "b")


def one_point_per_gap(dots: DataFrame, gaps: DataFrame) -> DataFrame:
    """Older rule: leading gaps all count; between two dots only the first gap does, at its middle pixel."""
    own = dots.select("plot_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    clear = _clear_gaps(dots, gaps)
    marks = own.select("plot_id", F.col("x").alias("a"), F.lit(None).cast("double").alias("b"), F.lit(1).alias("dot")).unionByName(
        clear.select("plot_id", F.col("a").cast("double").alias("a"), "b", F.lit(0).alias("dot")))
    w = Window.partitionBy("plot_id").orderBy("a").rowsBetween(Window.unboundedPreceding, 0)
    m = marks.withColumn("seen", F.sum("dot").over(w)).filter("dot = 0")
    total = own.groupBy("plot_id").agg(F.count(F.lit(1)).alias("n"))
    m = m.join(total, "plot_id").withColumn("nth", F.row_number().over(Window.partitionBy("plot_id", "seen").orderBy("a")))
    keep = m.filter("seen = 0 OR (seen < n AND nth = 1)")
    return own.unionByName(keep.select(
        "plot_id", F.floor((F.col("a") + F.col("b")) / 2).cast("double").alias("x"), F.lit(None).cast("double").alias("y")))
