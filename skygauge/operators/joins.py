"""Joins beyond plain equality.

Nearest and bracketing joins are equality joins on a grid cell or group key with a
reduction per row; no side is multiplied by the whole of the other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skygauge.operators.spines import require_unique
from skygauge.session import cut_lineage

EARTH_KM = 6371.0


def merge(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "left", drop: bool = False,
          save_path: str | None = None) -> DataFrame:
    keys = [on] if isinstance(on, str) else list(on)
    out = left.join(right, keys, how)
    out = out.drop(*keys) if drop else out
    if save_path:
        out.write.mode("overwrite").option("header", True).csv(save_path)
    return out


def add_external(df: DataFrame, external: DataFrame, on: str = "date") -> DataFrame:
    """Left join that insists on at most one external row per key."""
    return df.join(require_unique(external, [on]), on, "left")


def fold_on_spine(tables: Sequence[DataFrame], on: str = "date") -> DataFrame:
    """Distinct keys of all tables, each table left-joined to them."""
    spine = tables[0].select(on)
    for t in tables[1:]:
        spine = spine.unionByName(t.select(on))
    out = spine.distinct()
    for t in tables:
        out = out.join(t, on, "left")
    return out


def right_chain(tables: Sequence[DataFrame], on: str) -> DataFrame:
    """Chain of right joins: the last table's keys survive."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, on, "right")
    return out


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    la1, lo1, la2, lo2 = (F.radians(c) for c in (lat1, lon1, lat2, lon2))
    s1, s2 = F.sin((la2 - la1) / 2), F.sin((lo2 - lo1) / 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(s1 * s1 + F.cos(la1) * F.cos(la2) * s2 * s2))


def nearest_point(left: DataFrame, right: DataFrame, left_id: str, right_id: str, cell_deg: float = 0.01,
                  parts: int = 64) -> DataFrame:
    """Nearest right point per left point by great-circle distance; ties by id.

    Points meet in the 3 x 3 cells around the left one. A hit closer than a cell
    edge is final, the others go on with cells four times as wide. Points left over
    at the end meet all right points, dealt into ``parts``, so the answer is exact. Right points on the same
    coordinates are reduced to one first. Both tables carry latitude, longitude.
    """
    r = right.groupBy(F.col("latitude").alias("lat2"), F.col("longitude").alias("lon2")).agg(
        F.min(right_id).alias(right_id))
    todo = left.select(left_id, F.col("latitude").alias("lat1"), F.col("longitude").alias("lon1"))
    done, cell = None, cell_deg
    while True:
        whole = cell >= 360  # every remaining point sees all, part by part
        if whole:
            met = todo.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(
                r.withColumn("part", F.pmod(F.xxhash64("lat2", "lon2"), F.lit(parts)).cast("int")), "part")
        else:
            span = F.array(*[F.lit(d) for d in (-1, 0, 1)])
            cx = lambda c: F.floor(c / cell)
            met = todo.withColumn("dx", F.explode(span)).withColumn("dy", F.explode(span)).withColumns(
                {"cx": cx(F.col("lat1")) + F.col("dx"), "cy": cx(F.col("lon1")) + F.col("dy")}
            ).join(r.withColumns({"cx": cx(F.col("lat2")), "cy": cx(F.col("lon2"))}), ["cx", "cy"])
        near = (
            met.withColumn("km", F.round(haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")), 9))
        )
        best = near.groupBy(left_id).agg(
            F.first("lat1").alias("lat1"), F.first("lon1").alias("lon1"), F.min(F.struct("km", right_id)).alias("hit"))
        # a cell edge is shortest along the parallel nearest to the pole that the search can reach
        # and never reaches over the antimeridian, where cells do not meet
        edge = F.least(F.lit(float(cell)), 180 - F.abs("lon1"))
        reach = EARTH_KM * F.radians(edge) * F.greatest(
            F.cos(F.radians(F.least(F.abs("lat1") + 2 * cell, F.lit(90.0)))), F.lit(0.0)) * 0.99
        final = best if whole else best.filter(F.col("hit.km") < reach)
        final = cut_lineage(final.select(left_id, F.col(f"hit.{right_id}").alias(right_id),
                                         F.col("hit.km").alias("distance_km")))
        done = final if done is None else done.unionByName(final)
        todo = cut_lineage(todo.join(final.select(left_id), left_id, "left_anti"))
        if whole or todo.isEmpty():
            break
        cell = 360 if cell * 4 > 45 else cell * 4
    return done


def nearest_within(left: DataFrame, right: DataFrame, key: str, x: str, tol: Column | str, rx: str,
                   payload: Sequence[str], width: float = 1.0) -> DataFrame:
    """Nearest right position of the same key within ``tol`` of ``x``; ties by smallest position.

    The axis is cut into cells of ``width``; a left row visits only the cells its
    tolerance touches.
    """
    t = F.col(tol) if isinstance(tol, str) else tol
    cells = F.sequence(F.floor((F.col(x) - t) / width), F.floor((F.col(x) + t) / width))
    probe = left.withColumn("_cell", F.explode(cells))
    r = right.select(key, F.col(rx).alias("_rx"), *payload, F.floor(F.col(rx) / width).alias("_cell"))
    d = F.abs(F.col("_rx") - F.col(x))
    hit = probe.join(r, [key, "_cell"]).filter(d <= t).withColumn("_d", d)
    return hit.groupBy(*left.columns).agg(F.min(F.struct("_d", "_rx", *payload)).alias("near"))


def interpolate(y: Column, points: Column) -> Column:
    """Piecewise-linear value at ``y`` from sorted ``array<struct<y, value>>``, clamped at both ends."""
    n = F.size(points)
    k = F.size(F.filter(points, lambda p: p.y <= y))
    a, b = F.get(points, k - 1), F.get(points, k)
    inner = a.value + (b.value - a.value) * F.try_divide(y - a.y, b.y - a.y)
    return (F.when(y.isNull() | (n == 0), None).when(k == 0, F.get(points, F.lit(0)).value)
            .when(k >= n, F.get(points, n - 1).value).otherwise(inner))


def label_points(labels: DataFrame, key: str) -> DataFrame:
    """Labels of each plot as one sorted array; an axis has a few dozen labels at most."""
    return labels.groupBy(key).agg(F.sort_array(F.collect_set(F.struct("y", "value"))).alias("points"))


def neighbor_stats(df: DataFrame, edges: DataFrame, col: str, lags: Sequence[int] = (0, 1)) -> DataFrame:
    """Mean and maximum of ``col`` over neighbour stations ``lag`` days earlier.

    An absent neighbour-day is skipped; a present null makes both null.
    """
    vals = df.select(F.col("location").alias("neighbor"), F.col("date").alias("_d"), F.col(col).alias("_v"))
    shifted = (
        edges.select("location", "neighbor").join(vals, "neighbor")
        .withColumn("_lag", F.explode(F.array(*[F.lit(k) for k in lags])))
        .withColumn("date", F.date_add("_d", F.col("_lag")))
    )
    aggs = []
    for k in lags:
        v = F.when(F.col("_lag") == k, F.col("_v"))
        whole = F.count_if((F.col("_lag") == k) & F.col("_v").isNull()) == 0
        aggs += [F.when(whole, F.avg(v)).alias(f"neighbor_{col}_mean_lag{k}"),
                 F.when(whole, F.max(v)).alias(f"neighbor_{col}_max_lag{k}")]
    return df.join(shifted.groupBy("location", "date").agg(*aggs), ["location", "date"], "left")


def neighbor_target_lags(df: DataFrame, edges: DataFrame, target: str, lags: Sequence[int],
                         prefix: str = "nbr_target") -> DataFrame:
    """Neighbour mean at row lags along the axis of dates present in the frame; nulls are skipped."""
    axis = df.select("date").distinct().withColumn("_r", F.row_number().over(Window.orderBy("date")))
    vals = df.filter(F.col(target).isNotNull()).select(
        F.col("location").alias("neighbor"), "date", F.col(target).alias("_v"))
    means = edges.select("location", "neighbor").join(vals, "neighbor").groupBy("location", "date").agg(
        F.avg("_v").alias("_m"))
    moved = means.join(axis, "date").select(
        "location", "_m", F.col("_r").alias("_src"), F.explode(F.array(*[F.lit(k) for k in lags])).alias("_lag"))
    wide = moved.groupBy("location", (F.col("_src") + F.col("_lag")).alias("_r")).agg(
        *[F.max(F.when(F.col("_lag") == k, F.col("_m"))).alias(f"{prefix}_mean_lag{k}") for k in lags])
    return df.join(axis, "date").join(wide, ["location", "_r"], "left").drop("_r")


def compare_ids(a: DataFrame, b: DataFrame, key: str, id_: str) -> DataFrame:
    """Rows whose id differs between two tables on the same key, absent rows included."""
    j = a.select(key, F.col(id_).alias("left_id")).join(b.select(key, F.col(id_).alias("right_id")), key, "outer")
    return j.filter(~F.col("left_id").eqNullSafe(F.col("right_id")))


def rank_aligned(a: DataFrame, a_order: str, b: DataFrame, b_order: str, key: str, shift: Column) -> DataFrame:
    """Pair the i-th row of ``a`` with the (i + shift)-th of ``b`` per key; ``shift`` is a column of ``a``."""
    ra = a.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(a_order)))
    rb = b.withColumn("_j", F.row_number().over(Window.partitionBy(key).orderBy(b_order)))
    return ra.withColumn("_j", F.col("_i") + shift).join(rb, [key, "_j"]).drop("_i", "_j")
