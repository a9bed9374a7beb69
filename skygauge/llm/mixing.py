"""Mixing sources to target weights by a time-varying curriculum, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skygauge.llm.text import WORD_PATTERN

#: (training time, rate) knots of each weight class: early, even, late. Rates are scaled to a mean of 1.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
WEIGHTS, MOST = (1, 2, 3), 3


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with the number of words of the whole text as ``size`` (null text: 0)."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long"))


def source_targets(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: source, cls (place in ``weights``), source_size, target, to_take.

    Sources by code point, null last, weigh ``weights`` in turn and share all sizes. Sources whose
    share exceeds ``most`` times their size are found in the order of size per weight; what they
    cannot take goes to the others by weight.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~")).alias("src")
    total = docs.groupBy(key).agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    every, in_order = Window.partitionBy(), Window.orderBy("src")
    ranked = total.withColumn("cls", ((F.row_number().over(in_order) - 1) % len(weights)).cast("int"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), F.col("cls") + 1).cast("long")
    ranked = ranked.withColumns({"w": w, "cap": most * F.col("source_size")})
    tight = Window.orderBy(F.col("cap") / F.col("w"), "src").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(tight), F.lit(0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(tight), F.lit(0)))
    ranked = ranked.withColumn("level", level)
    ranked = ranked.withColumn("level", F.max(F.when(F.col("w") * F.col("level") <= F.col("cap"), F.col("level"))).over(every))
    target = F.least(F.col("cap").cast("double"), F.col("w") * F.col("level"))
    return ranked.select("src", "source", "cls", "source_size", target.alias("target"), F.floor(target + 0.5).alias("to_take"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, schedules=SCHEDULES, n_buckets: int = 4096) -> DataFrame:
    """Every row of ``docs`` (doc_id, source, size, ...) with source_size, target, taken and ``passes``.

    Each source is read again and again in the order of a hash of doc_id until its target is taken;
    ``passes`` has one (pass, words, position) for every reading of the document, taken is the sum of
    their words, at most ``most`` times the size. Only the reading that meets the target is partial.
    position (0 to 1) is the training time at which the source's cumulative demand, the integral of
    its rate schedule, reaches the middle of the reading.

    A hot source is cut into ``n_buckets`` hash ranges, whose sums are accumulated first; running
    sums are then local to a range. Null texts and white space have size 0 and are never taken, a
    null source is a source of its own, a null doc_id counts as an empty one, repeated rows are taken
    as separate documents, an empty table gives no rows. Extra columns stay, whatever their names,
    but for those named like one of the four added ones, which are replaced.
    """
    added = ("source_size", "target", "taken", "passes")
    extra = [c for c in docs.columns if c not in ("doc_id", "source", "size", *added)]
    shown = [F.col("_extra").getField(c).alias(c) if c in extra else F.col(c) for c in docs.columns if c not in added]
    docs = docs.select("doc_id", "source", "size", *([F.struct(*extra).alias("_extra")] if extra else []))
    targets = source_targets(docs, weights, most)
    code = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.withColumns({
        "_src": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~")), "_code": code,
        "_bucket": (F.conv(F.substring(code, 1, 8), 16, 10).cast("long") * n_buckets / 2**32).cast("int"),
    })
    sums = rows.groupBy("_src", "_bucket").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    starts = starts.join(targets.drop("source").withColumnRenamed("src", "_src"), "_src")
    own = Window.partitionBy("_src", "_bucket").orderBy("_code", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(starts, ["_src", "_bucket"]).withColumn("_before", F.col("_start") + F.coalesce(F.sum("size").over(own), F.lit(0)))

    def reading(k: int) -> Column:
        offset = F.col("_before") + k * F.col("source_size")
        taken = F.greatest(F.lit(0), F.least(F.col("size"), F.col("to_take") - offset))
        return F.struct(F.lit(k).alias("pass"), taken.alias("words"), training_time((offset + taken / 2) / F.greatest(F.col("to_take"), F.lit(1)), F.col("cls"), schedules).alias("position"))

    passes = F.filter(F.array(*[reading(k) for k in range(most)]), lambda x: x["words"] > 0)
    rows = rows.withColumn("passes", passes)
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda s, x: s + x["words"])
    return rows.withColumn("taken", taken).select(*shown, *added)


def training_time(share: Column, cls: Column, schedules=SCHEDULES) -> Column:
    """Time at which the integral of a class's piecewise linear rate reaches ``share`` of its whole."""
    out = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        area = sum((t1 - t0) * (r0 + r1) / 2 for (t0, r0), (t1, r1) in zip(knots, knots[1:]))
        need, before, time = share * area, 0.0, F.lit(knots[-1][0])
        pieces = []
        for (t0, r0), (t1, r1) in zip(knots, knots[1:]):
            slope, mine = (r1 - r0) / (t1 - t0), (t1 - t0) * (r0 + r1) / 2
            left = need - before
            # left = r0 * x + slope * x^2 / 2
            x = left / r0 if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), r0 * r0 + 2 * slope * left)) - r0) / slope
            before += mine
            pieces.append((need <= before, t0 + x))
        for test, value in reversed(pieces):
            time = F.when(test, value).otherwise(time)
        out = F.when(cls == k % len(schedules), time).otherwise(out)
    return out


def training_order(mixed: DataFrame) -> DataFrame:
    """One row for every reading of every document, range-sorted by position.

    Columns pass, words and position are added in place of ``passes`` and replace columns of their names.
    """
    read = mixed.select(*[c for c in mixed.columns if c not in ("passes", "pass", "words", "position")], F.inline("passes"))
    return read.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
