"""Ordered operators: lags, rolling statistics, fills, gaps and runs.

Groups are locations of a table that is unique in ``(location, date)``, so a
window partition never exceeds the days of the calendar. Order over the whole
frame goes through :mod:`skygauge.operators.ordering`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skygauge.operators.ordering import chunk_window, with_halo, with_ordinal

LAG_COLUMNS = ("mean_temperature_c", "highest_60_min_rainfall_mm", "mean_wind_speed_kmh")
FUNCS = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "std": F.stddev_samp}


def _scoped(df: DataFrame, scope: str, group: str, date: str, back: int, chunk: int):
    """Rows and window for ``scope``: per group, or over the whole frame in (date, group) order."""
    if scope == "group":
        return df, Window.partitionBy(group).orderBy(date)
    if scope == "frame":
        return with_halo(with_ordinal(df, [date, group]), "ordinal", back, chunk), chunk_window()
    raise ValueError(f"unknown scope: {scope}")


def _own(df: DataFrame, scope: str) -> DataFrame:
    return df if scope == "group" else df.filter(~F.col("_halo")).drop("_chunk", "_halo", "ordinal")


def lag_features(df: DataFrame, lag_days: int = 1, cols: Sequence[str] = LAG_COLUMNS, group: str = "location",
                 date: str = "date", scope: str = "group", chunk: int = 100_000) -> DataFrame:
    """``<col>_lag<k>``: the value k rows earlier, else the row's own value."""
    d, w = _scoped(df, scope, group, date, lag_days, chunk)
    return _own(d.withColumns(
        {f"{c}_lag{lag_days}": F.coalesce(F.lag(c, lag_days).over(w), F.col(c)) for c in cols}), scope)


def rolling_stats(df: DataFrame, group: str = "location", date: str = "date", scope: str = "group",
                  chunk: int = 100_000) -> DataFrame:
    """7-row mean temperature, 3-row maximum rain, 7-row mean wind."""
    d, w = _scoped(df, scope, group, date, 6, chunk)
    return _own(d.withColumns({
        "mean_temp_roll_7d": F.avg("mean_temperature_c").over(w.rowsBetween(-6, 0)),
        "max_rain_roll_3d": F.max("highest_60_min_rainfall_mm").over(w.rowsBetween(-2, 0)),
        "mean_wind_roll_7d": F.avg("mean_wind_speed_kmh").over(w.rowsBetween(-6, 0)),
    }), scope)


def lag_rolling(df: DataFrame, specs: Sequence[tuple[str, Sequence[int]]], target: str | None = None,
                group: str = "location", date: str = "date", funcs: Sequence[str] = ("mean",),
                min_periods: int = 1, fill_value: float | None = None, keep_delta: bool = False,
                bleed: bool = False, chunk: int = 100_000) -> DataFrame:
    """Lags and statistics of the k rows before the current one, per spec.

    With ``bleed`` the rolling frame runs on across group borders in (group, date)
    order, as a rolling frame over a grouped shift does.
    """
    w = Window.partitionBy(group).orderBy(date)
    cols = {"delta_days": F.datediff(date, F.lag(date).over(w))}
    for c, lags in specs:
        for k in lags:
            cols[f"{c}_lag_{k}"] = F.lag(c, k).over(w)
        if bleed:
            cols[f"_s_{c}"] = F.lag(c, 1).over(w)
        else:
            for k in lags:
                frame = w.rowsBetween(-k, -1)
                for f in funcs:
                    cols[f"{c}_roll_{f}_{k}"] = F.when(
                        F.count(c).over(frame) >= min_periods, FUNCS[f](c).over(frame))
    out = df.withColumns(cols)
    if bleed:
        widest = max(k for _, lags in specs for k in lags)
        out = with_halo(with_ordinal(out, [group, date]), "ordinal", widest, chunk)
        rolled = {}
        for c, lags in specs:
            for k in lags:
                frame = chunk_window().rowsBetween(-(k - 1), 0)
                for f in funcs:
                    rolled[f"{c}_roll_{f}_{k}"] = F.when(
                        F.count(f"_s_{c}").over(frame) >= min_periods, FUNCS[f](f"_s_{c}").over(frame))
        out = out.withColumns(rolled).filter(~F.col("_halo")).drop(
            "_chunk", "_halo", "ordinal", *[f"_s_{c}" for c, _ in specs])
    if target and {f"{target}_lag_1", f"{target}_lag_7"} <= set(out.columns):
        out = out.withColumn("target_lag_7_minus_1", F.col(f"{target}_lag_7") - F.col(f"{target}_lag_1"))
    if fill_value is not None:
        out = out.fillna(fill_value, subset=[c for c in out.columns if c not in df.columns])
    return out if keep_delta else out.drop("delta_days")


def calendar_lag(df: DataFrame, col: str, days: int, group: str = "location", date: str = "date") -> DataFrame:
    """Value exactly ``days`` calendar days earlier, null where that day is absent."""
    past = df.select(group, F.date_add(date, days).alias(date), F.col(col).alias(f"{col}_day_lag_{days}"))
    return df.join(past, [group, date], "left")


def index_lags(df: DataFrame, cols: Sequence[str], date: str = "date", lags=(1, 2, 3, 6), means=(3, 6, 12)) -> DataFrame:
    """Lags and rolling means of index columns along one date axis (bounded by the calendar)."""
    w = Window.orderBy(date)
    out = {}
    for c in cols:
        for k in lags:
            out[f"{c}_lag_{k}"] = F.lag(c, k).over(w)
        for k in means:
            out[f"{c}_rolling_mean_{k}"] = F.avg(c).over(w.rowsBetween(-(k - 1), 0))
    return df.withColumns(out)


def fill_ordered(df: DataFrame, cols: Sequence[str], date: str = "date", group: Sequence[str] = (),
                 causal: bool = False) -> DataFrame:
    """Backward then forward fill; ``causal`` only carries earlier values forward."""
    fwd = Window.partitionBy(*group).orderBy(date).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # running frame over the reversed order: linear, unlike a frame that ends at the last row
    back = Window.partitionBy(*group).orderBy(F.desc(date)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = {}
    for c in cols:
        last = F.last(c, ignorenulls=True).over(fwd)
        out[c] = last if causal else F.coalesce(F.last(c, ignorenulls=True).over(back), last)
    return df.withColumns(out)


def last_rows(df: DataFrame, n: int, group: str = "location", date: str = "date") -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(date))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def audit_gaps(df: DataFrame, min_gap_days: int = 2, examples: int = 5, group: str = "location",
               date: str = "date") -> DataFrame:
    """Gap count, longest gap and the first examples per group; groups without gaps are kept."""
    w = Window.partitionBy(group).orderBy(date)
    g = df.select(group, date, F.lag(date).over(w).alias("_prev"))
    g = g.withColumn("_gap", F.datediff(date, "_prev"))
    hit = F.col("_gap") >= min_gap_days
    g = g.withColumn("_nth", F.sum(F.when(hit, 1).otherwise(0)).over(w))
    text = F.format_string("%s → %s (%d days)", F.col("_prev").cast("string"), F.col(date).cast("string"), "_gap")
    shown = F.collect_list(F.when(hit & (F.col("_nth") <= examples), F.struct(F.col(date).alias("d"), text.alias("t"))))
    return g.groupBy(group).agg(
        F.count_if(hit).alias("num_gaps"),
        F.coalesce(F.max(F.when(hit, F.col("_gap"))), F.lit(0)).alias("max_gap_days"),
        F.transform(F.sort_array(shown), lambda s: s.t).alias("examples"))


def null_runs(df: DataFrame, col: str, pos: str, keys: Sequence[str]) -> DataFrame:
    """Start, end and length of each run of nulls along ``pos``."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(pos)
    d = df.select(*keys, pos, F.col(col).isNull().alias("_null"), F.row_number().over(w).alias("_i"))
    d = d.filter("_null").withColumn("_run", F.col("_i") - F.row_number().over(w))
    return d.groupBy(*keys, "_run").agg(
        F.min(pos).alias("start"), F.max(pos).alias("end"), F.count(F.lit(1)).alias("length")).drop("_run")


def presence_gaps(df: DataFrame, pos: str, bounds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Gaps of an integer axis [start, stop) that hold no position; both edges included.

    ``bounds`` has ``keys, start, stop``. Gap ends are inclusive and relative to start.
    """
    keys = list(keys)
    marks = df.join(bounds, keys).filter((F.col(pos) >= F.col("start")) & (F.col(pos) < F.col("stop")))
    marks = marks.select(*keys, F.col(pos).alias("x")).distinct()
    edges = bounds.select(*keys, F.explode(F.array(F.col("start") - 1, F.col("stop"))).alias("x"))
    w = Window.partitionBy(*keys).orderBy("x")
    gaps = marks.unionByName(edges).withColumn("nxt", F.lead("x").over(w)).filter("nxt - x > 1")
    return gaps.join(bounds, keys).select(
        *keys, (F.col("x") + 1 - F.col("start")).alias("gap_start"), (F.col("nxt") - 1 - F.col("start")).alias("gap_end"))


def cluster_positions(df: DataFrame, pos: str, keys: Sequence[str], max_gap: int = 0) -> DataFrame:
    """Positions closer than ``max_gap`` to their predecessor collapse to their truncated mean."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(pos)
    new = F.when(F.col(pos) - F.lag(pos).over(w) <= max_gap, 0).otherwise(1)
    d = df.select(*keys, pos, new.alias("_new")).withColumn(
        "_c", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "_c").agg(F.avg(pos).cast("int").alias(pos)).drop("_c")


def rolling_maxima(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """Largest 30, 60 and 120-minute sums of 15-minute rows; short or null frames give null."""
    w = Window.partitionBy(*keys).orderBy(time)
    sums = {}
    for minutes, k in ((30, 2), (60, 4), (120, 8)):
        f = w.rowsBetween(-(k - 1), 0)
        sums[f"_r{minutes}"] = F.when(F.count(value).over(f) == k, F.sum(value).over(f))
    return df.withColumns(sums).groupBy(*keys).agg(
        *[F.max(f"_r{m}").alias(f"highest_{m}_min_rainfall_mm") for m in (30, 60, 120)])
