"""Whole-table order without a one-task window.

``orderBy`` range-partitions the rows; the sorted rows are checkpointed so that a
row keeps its partition and place, and only the table of partition sizes (one row
per partition) is accumulated in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skygauge.session import cut_lineage

_PLACE = 33  # monotonically_increasing_id keeps the place in its lower 33 bits


def _sorted_places(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    s = cut_lineage(df.orderBy(*order)).withColumn("_id", F.monotonically_increasing_id())
    return s.withColumns({
        "_part": F.shiftright("_id", _PLACE),
        "_pos": F.col("_id").bitwiseAND(F.lit((1 << _PLACE) - 1)),
    }).drop("_id")


def _offsets(s: DataFrame, sums: dict[str, Column]) -> DataFrame:
    per_part = s.groupBy("_part").agg(*[c.alias(n) for n, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select("_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums])


def with_ordinal(df: DataFrame, order: Sequence[str | Column], out: str = "ordinal") -> DataFrame:
    """Add the 0-based position of every row in the given total order."""
    s = _sorted_places(df, order)
    offs = _offsets(s, {"_off": F.count(F.lit(1))})
    return s.join(offs, "_part").withColumn(out, F.col("_off") + F.col("_pos")).drop("_part", "_pos", "_off")


def prefix_sums(df: DataFrame, order: Sequence[str | Column], cols: dict[str, str]) -> DataFrame:
    """Inclusive running sums over the total order; ``cols`` maps output to input column."""
    s = _sorted_places(df, order)
    offs = _offsets(s, {f"_o_{out}": F.sum(c) for out, c in cols.items()})
    run = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    j = s.join(offs, "_part").withColumns(
        {out: F.col(f"_o_{out}") + F.sum(c).over(run) for out, c in cols.items()})
    return j.drop("_part", "_pos", *[f"_o_{out}" for out in cols])


def attach_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row, as a scalar subquery (it fails on a second row)."""
    row = one.select(F.struct(*one.columns).alias("_row")).scalar()
    return df.withColumn("_row", row).select("*", "_row.*").drop("_row")


def global_quantiles(df: DataFrame, col: str, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Exact linear quantiles of a whole column as one row.

    Rows shrink to one per distinct value before the sort; no task holds them all.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    cum = prefix_sums(counts, ["_v"], {"_hi": "_n"})
    total = cum.agg(F.max("_hi").alias("_total"))
    ranked = attach_row(cum, total)
    aggs = []
    for p, name in zip(probs, names):
        pos = (F.col("_total") - 1) * F.lit(float(p))
        at = lambda k: F.max(F.when((k >= F.col("_hi") - F.col("_n")) & (k < F.col("_hi")), F.col("_v")))
        lo, hi = at(F.floor(pos)), at(F.ceil(pos))
        frac = F.max(pos - F.floor(pos))
        aggs.append((lo + (hi - lo) * frac).alias(name))
    return ranked.agg(*aggs)


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact linear quantiles of many columns: ``column, q``, ``q`` as an array in the order of ``probs``.

    The columns are melted and counted by value, sorted once by (column, value), and ranked within
    their column by the running count less what stands before the column. Nulls and NaN are left out; a column without values has no row.
    """
    melted = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("_v")) for c in cols])).alias("e")).select("e.*")
    counts = melted.filter(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy("column", "_v").agg(F.count(F.lit(1)).alias("_n"))
    cum = cut_lineage(prefix_sums(counts, ["column", "_v"], {"_hi": "_n"}))
    spans = cum.groupBy("column").agg(F.sum("_n").alias("_total"), F.min(F.col("_hi") - F.col("_n")).alias("_before"))
    ranked = cum.join(spans, "column").withColumn("_hi", F.col("_hi") - F.col("_before"))
    aggs = []
    for p in probs:
        pos = (F.col("_total") - 1) * F.lit(float(p))
        at = lambda k: F.max(F.when((k >= F.col("_hi") - F.col("_n")) & (k < F.col("_hi")), F.col("_v")))
        lo, hi = at(F.floor(pos)), at(F.ceil(pos))
        aggs.append(lo + (hi - lo) * F.max(pos - F.floor(pos)))
    return ranked.groupBy("column").agg(F.array(*aggs).alias("q"))


def with_halo(df: DataFrame, ordinal: str, back: int, size: int = 100_000) -> DataFrame:
    """Cut the order into chunks and copy the last ``back`` rows of each into the next one.

    A window over ``_chunk`` then sees every row it needs; keep rows with ``_halo`` false.
    """
    size = max(size, back)
    own = F.floor(F.col(ordinal) / size)
    spill = F.col(ordinal) % size >= size - back
    return (
        df.withColumn("_own", own)
        .withColumn("_chunk", F.explode(F.when(spill, F.array(own, own + 1)).otherwise(F.array(own))))
        .withColumn("_halo", F.col("_chunk") != F.col("_own")).drop("_own")
    )


def chunk_window(ordinal: str = "ordinal"):
    return Window.partitionBy("_chunk").orderBy(ordinal)
