"""Best-fit packing planned on the histogram of lengths; documents take planned slots by rank."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skygauge.llm.bpe import byte_bpe, tokenizer_path
from skygauge.llm.storage import land

VOCABULARY, CAPACITY, END = "byte_bpe_50k.json", 1024, 2
_SLOTS = "length int, first_rank long, last_rank long, each int, first_sequence long, first_offset int"


def pieces(docs: DataFrame, path: str, capacity: int, end: int, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): whole documents, longer ones cut so that only the first piece is shorter."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, stop = byte_bpe(path), np.array([end], "<u4").tobytes()
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf.doc_id, pdf.text):
                ids = bpe.ids(text) + stop
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                bounds = [0, *range(first, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    part = ids[4 * a : 4 * b]
                    rows.append((doc_id, k, a, b - a, zlib.crc32(part), *([np.frombuffer(part, "<i4")] if with_ids else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text")
    made = rows.mapInPandas(cut, "doc_id string, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit over counts, longest first: rows (length, first_rank, last_rank, each, first_sequence, first_offset).

    Pieces of a length with ranks first_rank..last_rank fill sequences from first_sequence on, ``each``
    side by side in every one, from first_offset on. Alike sequences are kept as one range with a
    count, so the work depends on the number of lengths, not on the number of documents. A sequence
    holds at most about sqrt(2 * capacity) different lengths and each length opens or splits a few
    ranges, so the plan stays below capacity * 4 * sqrt(2 * capacity) rows.
    """
    slots = []
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens: ranges (first sequence, how many)
    made = 0
    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left, rank = counts[length], 0
        while left:
            free = min((r for r in room if r >= length), default=None)
            if free is None:
                free = capacity
                need = -(-left // (capacity // length))
                first, many = made, need
                made += need
            else:
                first, many = room[free].pop()
                if not room[free]:
                    del room[free]
            each = free // length
            full = min(many, left // each)
            if full:
                slots.append((length, rank, rank + full * each - 1, each, first, capacity - free))
                room.setdefault(free - each * length, []).append((first, full))
                left, rank, first, many = left - full * each, rank + full * each, first + full, many - full
            if left and many:  # fewer than ``each`` remain: they share one sequence
                slots.append((length, rank, rank + left - 1, left, first, capacity - free))
                room.setdefault(free - left * length, []).append((first, 1))
                rank, left, first, many = rank + left, 0, first + 1, many - 1
            if many:
                room.setdefault(free, []).append((first, many))
        room.pop(0, None)
    return slots


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False, n_buckets: int = 512) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids on request).

    A document's ids end with ``end``; only those longer than ``capacity`` are cut. The histogram of
    lengths (at most ``capacity`` rows) is planned on the driver; pieces are ranked within their
    length, in ``n_buckets`` hash buckets whose counts are accumulated first, so one common length is
    never ranked by a single task; the plan, bounded by the capacity, is joined on the rank.

    Null and empty texts are one piece with the end id alone. Repeated rows and null ids are pieces of
    their own. An empty table gives no rows. Extra columns are ignored.
    """
    spark = docs.sparkSession
    cut = land(pieces(docs, path or tokenizer_path(VOCABULARY), capacity, end, with_ids), "pieces")
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_buckets)).cast("int"))
    counts = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.createDataFrame(plan(histogram, capacity), _SLOTS)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = cut.join(starts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(own) - 1)
    s, p = slots.alias("s"), ranked.alias("p")
    placed = p.join(F.broadcast(s), (F.col("p.length") == F.col("s.length")) & F.col("rank").between(F.col("first_rank"), F.col("last_rank")))
    k = F.col("rank") - F.col("first_rank")
    return placed.select(
        "doc_id", "piece", "start", "p.length", "ids_crc32",
        (F.col("first_sequence") + F.floor(k / F.col("each"))).alias("sequence_id"),
        (F.col("first_offset") + k % F.col("each") * F.col("p.length")).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )
