"""Structured Streaming forms of the reading aggregates.

State is bounded by the watermark: closed windows leave it, later rows are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skygauge.session import scratch_dir
from skygauge.streaming.sink import UpsertTable

#: Rows of state that a partition of a stateful operator is made for.
STATE_ROWS = 100_000
SHUFFLE = "spark.sql.shuffle.partitions"
#: Readings of a pack, and rows that a task holds to pack them.
PACK, HELD = 1024, 2**18

READING_SCHEMA = T.StructType([
    T.StructField("station_id", T.StringType()), T.StructField("timestamp", T.TimestampType()),
    T.StructField("rainfall_mm", T.DoubleType())])


def read_readings(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Readings landed as Parquet files.

    By default everything that has landed is one batch, so the order of files does not matter. With
    ``files_per_batch`` the watermark moves between batches, and files must land in time order.
    """
    r = spark.readStream.schema(READING_SCHEMA)
    return (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r).parquet(folder)


def daily_totals(readings: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Rain per station and day once the day is closed."""
    return readings.withWatermark("timestamp", delay).groupBy("station_id", F.window("timestamp", "1 day").alias("day")).agg(
        F.sum("rainfall_mm").alias("daily_rainfall_total_mm")).select(
        "station_id", F.to_date("day.start").alias("date"), "daily_rainfall_total_mm")


def sliding_maxima(readings: DataFrame, minutes: int, delay: str = "1 hour") -> DataFrame:
    """Daily maximum of full sliding sums of 15-minute cells; a window with a missing cell does not count."""
    k = minutes // 15
    cells = readings.withWatermark("timestamp", delay).groupBy("station_id", F.window("timestamp", "15 minutes").alias("cell")).agg(
        F.sum("rainfall_mm").alias("mm"))
    sums = cells.groupBy("station_id", F.window(F.window_time("cell"), f"{minutes} minutes", "15 minutes").alias("span")).agg(
        F.sum("mm").alias("mm"), F.count(F.lit(1)).alias("n"))
    same_day = F.to_date("span.start") == F.to_date(F.window_time("span"))
    full = sums.withColumn("at", F.window_time("span")).filter((F.col("n") == k) & same_day)
    return full.groupBy("station_id", F.window("at", "1 day").alias("day")).agg(F.max("mm").alias("highest_mm")).select(
        "station_id", F.to_date("day.start").alias("date"), "highest_mm")


def _micros(within: str) -> Column:
    return F.expr(f"unix_micros(timestamp_seconds(0) + interval {within})")


def _span(at: Column, within: str) -> Column:
    """Number of the span of time, as long as the bound, that microseconds ``at`` lie in."""
    width = F.greatest(_micros(within), F.lit(1).cast("long"))
    return F.call_function("div", at - F.pmod(at, width), width)


def error_stream(predictions: DataFrame, observations: DataFrame, within: str = "10 minutes", delay: str = "1 hour", packed: bool = False) -> DataFrame:
    """Predictions joined to the observations of their station that follow within the bound.

    The state is keyed by station and span of time, a span as long as the bound: predictions go to every span they reach,
    an observation to its own, so a pair meets once and a row is compared with its neighbours in time, not with its whole station.
    Predictions of a span travel in packs of at most ``PACK``, which the join takes as one row and which are opened behind it;
    a pack is late when its last row is.

    ``packed`` gives the same pairs as blocks of at most ``PACK`` predictions by ``PACK`` observations, for :func:`error_pairs`: what
    lands and what the state holds then grows with the readings and hardly with their pairs.
    """
    reached = F.sequence("_span", _span(F.unix_micros("last") + _micros(within), within))
    p = _packs(predictions, "made_at", "predicted_mm", within).withWatermark("last", delay).withColumn("_span", F.explode(reached)).alias("p")
    same = (F.col("p.station_id") == F.col("o.station_id")) & (F.col("p._span") == F.col("o._span"))
    if packed:
        o = _packs(observations, "timestamp", "rainfall_mm", within).withWatermark("last", delay).alias("o")
        # what meets is never further apart than this, which bounds the state
        bound = F.expr(f"o.last >= p.last - interval {within} AND o.last <= p.last + interval {within} + interval {within} AND o.last >= p.first AND o.first <= p.last + interval {within}")
        return p.join(o, same & bound).select("p.station_id", F.col("p.rows").alias("predictions"), F.col("o.rows").alias("observations"))
    o = observations.withWatermark("timestamp", delay).withColumn("_span", _span(F.unix_micros("timestamp"), within)).alias("o")
    bound = F.expr(f"o.timestamp >= p.last - interval {within} AND o.timestamp <= p.last + interval {within} AND o.timestamp >= p.first")
    return _opened(p.join(o, same & bound).select("p.station_id", "o.timestamp", "o.rainfall_mm", F.inline("p.rows").alias("made", "predicted_mm")), within)


def _opened(met: DataFrame, within: str) -> DataFrame:
    """The pairs within the bound, with their errors."""
    seen = F.unix_micros("timestamp")
    return met.filter((seen >= F.col("made")) & (seen <= F.col("made") + _micros(within))).select(
        "station_id", F.timestamp_micros("made").alias("made_at"), "timestamp", "predicted_mm", "rainfall_mm",
        (F.col("predicted_mm") - F.col("rainfall_mm")).alias("error_mm"))


def error_pairs(blocks: DataFrame, within: str = "10 minutes") -> DataFrame:
    """The rows of :func:`error_stream` from its blocks: every pair within the bound, made where it is read."""
    pairs = blocks.select("station_id", F.inline("predictions").alias("made", "predicted_mm"), "observations").select(
        "station_id", "made", "predicted_mm", F.inline("observations").alias("seen", "rainfall_mm"))
    return _opened(pairs.withColumn("timestamp", F.timestamp_micros("seen")), within)


def _packs(readings: DataFrame, at: str, mm: str, within: str) -> DataFrame:
    """(station_id, _span, first, last, rows): readings of a station and span in order of time, at most ``PACK`` in a row, time in
    microseconds. Rows without station or time, which meet nothing, are left out. Holds no state: each batch has packs of its own."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= HELD:
                yield _pack(held)
                held, n = [], 0
        if n:
            yield _pack(held)

    rows = readings.where(F.col("station_id").isNotNull() & F.col(at).isNotNull()).select(
        "station_id", _span(F.unix_micros(at), within).alias("_span"), F.unix_micros(at).alias("at"), F.col(mm).cast("double").alias("mm"))
    packs = rows.repartition("station_id", "_span").mapInArrow(pack, "station_id string, _span long, first long, last long, rows array<struct<at: long, mm: double>>")
    return packs.withColumns({c: F.timestamp_micros(c) for c in ("first", "last")})


def _pack(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(batches).combine_chunks()
    station, span, at, mm = (c.combine_chunks() for c in rows.columns)
    code, s, t = station.dictionary_encode().indices.to_numpy(), span.to_numpy(), at.to_numpy()
    order = np.lexsort((t, s, code))
    new = np.r_[True, (np.diff(code[order]) != 0) | (np.diff(s[order]) != 0)]
    place = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    start = np.flatnonzero(place % PACK == 0)
    ends = np.r_[start, len(order)]
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([at.take(pa.array(order)), mm.take(pa.array(order))], names=["at", "mm"]))
    one, last = pa.array(order[start]), pa.array(order[ends[1:] - 1])
    return pa.RecordBatch.from_arrays([station.take(one), span.take(one), at.take(one), at.take(last), lists], names=["station_id", "_span", "first", "last", "rows"])


def running_metrics(errors: DataFrame) -> DataFrame:
    """Running mae, rmse and bias per station, for update or complete mode."""
    e = F.col("error_mm")
    return errors.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))


def daily_metrics(errors: DataFrame) -> DataFrame:
    """The same per station and day of the observation, once the day is closed.

    Stands on the joined stream in the same query: the watermarks of predictions and observations pass through the join
    into the day's aggregate, so the state of both is bounded.
    """
    e = F.col("error_mm")
    return errors.groupBy("station_id", F.window("timestamp", "1 day").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias")).select(
        "station_id", F.to_date("day.start").alias("date"), "n", "mae", "rmse", "bias")


def state_partitions(spark: SparkSession, rows: int) -> int:
    """Partitions for about ``rows`` rows of state: two a core at least, at most the session's shuffle partitions."""
    return min(int(spark.conf.get(SHUFFLE)), max(2 * spark.sparkContext.defaultParallelism, -(-rows // STATE_ROWS)))


def drain(stream: DataFrame, mode: str = "append", keys: Sequence[str] = (), folder: str | None = None, state_rows: int | None = None) -> DataFrame:
    """Run a stream over what has landed and return the sink's content.

    Append mode writes files; complete mode replaces the table with every batch, update mode upserts each batch by ``keys``. With a
    ``folder`` sink and progress stay there, and a later drain of the same stream goes on where this one ended.

    Every partition of the state commits files for each of its stores in each batch, which takes longer than the rows where
    partitions are many and small. With ``state_rows``, about how many rows the largest state holds, their number follows it.
    """
    spark = stream.sparkSession
    folder = folder or scratch_dir(spark, "sink")
    if state_rows is not None:
        before = spark.conf.get(SHUFFLE)
        spark.conf.set(SHUFFLE, state_partitions(spark, state_rows))
        try:
            return drain(stream, mode, keys, folder)
        finally:
            spark.conf.set(SHUFFLE, before)
    w = stream.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        w.format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys of the result")
    if mode == "update":
        table = UpsertTable(spark, f"{folder}/rows", stream.schema, keys)
        w.foreachBatch(table.upsert).start().awaitTermination()
        return table.read()
    w.foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{folder}/rows")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
