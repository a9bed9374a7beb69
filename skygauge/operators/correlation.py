"""Pairwise-complete correlation matrices and what is built on them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skygauge.operators.metrics import pair_corr
from skygauge.operators.ordering import with_ordinal
from skygauge.session import cut_lineage

BLOCK = 64
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _dense(slots: pd.Series, values: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Values and presence of packed rows as matrices of rows by BLOCK."""
    n = slots.map(len).to_numpy()
    row, col = np.repeat(np.arange(len(n)), n), np.concatenate(slots.to_numpy())
    x, m = np.zeros((len(n), BLOCK)), np.zeros((len(n), BLOCK))
    x[row, col], m[row, col] = np.concatenate(values.to_numpy()), 1.0
    return x, m


def _gram_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Matrix products of two blocks of columns, summed over the rows of one task."""
    acc: dict[tuple, np.ndarray] = {}

    def flush() -> Iterator[pd.DataFrame]:
        for (k, bi, bj), sums in acc.items():
            i, j = np.nonzero(sums[0])
            yield pd.DataFrame({"k": k, "i": bi * BLOCK + i, "j": bj * BLOCK + j} | {c: v[i, j] for c, v in zip(SUMS, sums)})
        acc.clear()

    for pdf in batches:
        for key, part in pdf.groupby(["k", "bi", "bj"], sort=False):
            x, mx = _dense(part.si, part.vi)
            y, my = (x, mx) if key[1] == key[2] else _dense(part.sj, part.vj)
            both = np.stack([mx.T @ my, x.T @ my, mx.T @ y, (x * x).T @ my, mx.T @ (y * y), x.T @ y])
            acc[key] = acc[key] + both if key in acc else both
        if len(acc) > 256:  # sums are additive: hand over and start again
            yield from flush()
    yield from flush()


def correlation_matrix(df: DataFrame, row: str, col: str, value: str, key: str | None = None) -> DataFrame:
    """Correlation of every two columns over shared rows, as ``[key,] a, b, n, corr``.

    Columns are packed into blocks of fixed width, so a task multiplies blocks and
    emits sums; pairs of single values are never written out. Values are centred
    on their column mean first, which keeps the sums well conditioned.
    """
    k = F.col(key).cast("string") if key else F.lit("")
    vals = df.filter(F.col(value).isNotNull()).select(
        k.alias("k"), F.col(row).alias("r"), F.col(col).alias("c"), F.col(value).cast("double").alias("v"))
    vals = cut_lineage(vals.groupBy("k", "r", "c").agg(F.avg("v").alias("v")))  # read three times
    names = vals.groupBy("k", "c").agg(F.avg("v").alias("mean"))
    if key:  # columns of one key, e.g. years: bounded by the calendar
        names = names.withColumn("id", F.row_number().over(Window.partitionBy("k").orderBy("c")) - 1)
    else:
        names = with_ordinal(names, ["c"], "id")
    names = cut_lineage(names)
    slots = vals.join(names, ["k", "c"]).select(
        "k", "r", F.floor(F.col("id") / BLOCK).alias("blk"),
        F.struct((F.col("id") % BLOCK).cast("int").alias("slot"), (F.col("v") - F.col("mean")).alias("v")).alias("e"))
    packed = slots.groupBy("k", "r", "blk").agg(F.collect_list("e").alias("e")).select("k", "r", "blk", F.col("e.slot").alias("s"), F.col("e.v").alias("v"))
    one_block = names.agg((F.max("id") < BLOCK).alias("one")).scalar()
    left = packed.select("k", "r", F.col("blk").alias("bi"), F.col("s").alias("si"), F.col("v").alias("vi"))
    # a block meets itself without a join; only tables of several blocks join their rows
    own = left.select("k", "bi", F.col("bi").alias("bj"), "si", "vi", F.col("si").alias("sj"), F.col("vi").alias("vj"))
    right = packed.filter(~one_block).select("k", "r", F.col("blk").alias("bj"), F.col("s").alias("sj"), F.col("v").alias("vj"))
    pairs = own.unionByName(left.filter(~one_block).join(right, ["k", "r"]).filter("bi < bj").drop("r"))
    sums = pairs.mapInPandas(_gram_blocks, "k string, i long, j long, " + ", ".join(f"{c} double" for c in SUMS))
    s = sums.groupBy("k", "i", "j").agg(*[F.sum(c).alias(c) for c in SUMS])
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    varies = (vx > 1e-12 * F.col("sxx")) & (vy > 1e-12 * F.col("syy"))
    corr = F.when((F.col("n") > 1) & varies, cov / F.sqrt(vx * vy))
    half = s.select("k", "i", "j", F.col("n").cast("long").alias("n"), corr.alias("corr"))
    full = half.withColumn("ends", F.explode(F.when(
        (F.col("i") == F.col("j")) | (F.floor(F.col("i") / BLOCK) == F.floor(F.col("j") / BLOCK)),
        F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")))).otherwise(
        F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")),
                F.struct(F.col("j").alias("a"), F.col("i").alias("b"))))))
    ids = names.select("k", "id", "c")
    out = (
        full.select("k", F.col("ends.a").alias("ia"), F.col("ends.b").alias("ib"), "n", "corr")
        .join(ids.select("k", F.col("id").alias("ia"), F.col("c").alias("a")), ["k", "ia"])
        .join(ids.select("k", F.col("id").alias("ib"), F.col("c").alias("b")), ["k", "ib"])
    )
    return out.select(*([F.col("k").alias(key)] if key else []), "a", "b", "n", "corr")


def neighbors_from_corr(corr: DataFrame, k: int = 5, min_corr: float = 0.0) -> DataFrame:
    """Edges ``location, neighbor, rank``: the k best columns above ``min_corr``; ties by name."""
    w = Window.partitionBy("a").orderBy(F.desc("corr"), "b")
    best = corr.filter((F.col("a") != F.col("b")) & (F.col("corr") > min_corr))
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        F.col("a").alias("location"), F.col("b").alias("neighbor"), "rank", "corr")


def extreme_year_persistence(df: DataFrame, target: str, group: str = "location") -> DataFrame:
    """Lag-1 correlation over present years of the count and maximum of extreme days (>= q95)."""
    thr = df.groupBy(group).agg(F.expr(f"percentile({target}, 0.95)").alias("thr"))
    yearly = (
        df.join(thr, group).filter(F.col(target) >= F.col("thr"))
        .groupBy(group, F.year("date").alias("year"))
        .agg(F.count(target).alias("n"), F.max(target).alias("mx"))
    )
    w = Window.partitionBy(group).orderBy("year")
    lagged = yearly.withColumns({"n0": F.lag("n").over(w), "mx0": F.lag("mx").over(w)})
    return lagged.groupBy(group).agg(
        pair_corr(F.col("n"), F.col("n0")).alias("extreme_count_corr"),
        pair_corr(F.col("mx"), F.col("mx0")).alias("extreme_max_corr"),
        F.count(F.lit(1)).alias("n_years")).filter("n_years >= 2")
