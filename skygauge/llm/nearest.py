"""Nearest neighbours by inner product: a block matrix join on 8-bit codes whose error bounds decide what is computed in full."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skygauge.llm.storage import land
from skygauge.llm.text import runs

NEAREST, EVERY = 20, 20
#: Rows of a block on either side: a tile of two blocks is one unit of work, compared in parts of PART queries and candidates.
LEAST_BLOCK, MOST_BLOCK, TILES, PART = 1024, 65_536, 24, (512, 4096)
_VECTOR = "node long, width int, codes binary, step double, error double, norm double, floats binary"


@dataclass
class Side:
    """Vectors of one side of a tile: codes * step is within ``error`` (Euclidean) of the vector, whose length is ``norm``."""

    node: np.ndarray
    codes: np.ndarray
    step: np.ndarray
    error: np.ndarray
    norm: np.ndarray
    floats: np.ndarray

    @classmethod
    def of(cls, pdf: pd.DataFrame) -> Side:
        floats = np.frombuffer(b"".join(pdf.floats), "<f8").reshape(len(pdf), -1)
        codes = np.frombuffer(b"".join(pdf.codes), np.int8).reshape(len(pdf), -1)
        return cls(pdf.node.to_numpy(), codes, *(pdf[c].to_numpy(np.float64) for c in ("step", "error", "norm")), floats)


def quantised(rows: DataFrame) -> DataFrame:
    """(vec_id string, node, width, codes, step, error, norm, floats) of usable vectors; node is a hash of the components."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for vec_id, v in zip(pdf.vec_id, pdf.embedding):
                x = None if v is None or len(v) == 0 else np.asarray([np.nan if c is None else c for c in v], "<f8")
                if x is None or not np.isfinite(x).all() or not x.any():
                    continue
                x = x + 0.0  # one zero
                step = np.abs(x).max() / 127
                codes = np.clip(np.rint(x / step) if step else np.zeros(len(x)), -127, 127).astype(np.int8)
                node = int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True)
                with np.errstate(over="ignore"):
                    out.append((vec_id, node, len(x), codes.tobytes(), step, np.linalg.norm(x - codes * step), np.linalg.norm(x), x.tobytes()))
            yield pd.DataFrame(out, columns=["vec_id", "node", "width", "codes", "step", "error", "norm", "floats"])

    given = rows.where("vec_id is not null").select(F.col("vec_id").cast("long").cast("string").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return given.mapInPandas(read, f"vec_id string, {_VECTOR}").withColumn("vec_id", F.col("vec_id").cast("long"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``b``, components added from left to right in double precision."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore", invalid="ignore"):
        for d in range(a.shape[1]):
            total += a[:, d] * b[:, d]
    return total


def tile(q: Side, c: Side, ids: list[np.ndarray], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(query node, scores, ids, candidate nodes): the k best of the tile's candidates, best first.

    Products of the codes are exact in floats (127^2 times the width stays in their mantissa); times
    the steps they miss the true product by at most |q'| e_c + e_q |c|, q' being the coded query. A
    pair is computed in full unless its upper bound is below the k-th best score known so far: the
    k-th best lower bound of the part, or the k-th best score of the parts before.
    """
    kind = np.float32 if q.codes.shape[1] <= 1000 else np.float64
    first = np.fromiter((i[0] for i in ids), np.int64, len(ids))
    for i in range(0, len(q.node), PART[0]):
        rows = slice(i, i + PART[0])
        codes, n = q.codes[rows].astype(kind), len(q.node[rows])
        best = [(np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))] * n
        known = np.full(n, -np.inf)
        for j in range(0, len(c.node), PART[1]):
            cols = slice(j, j + PART[1])
            with np.errstate(over="ignore", invalid="ignore"):
                about = (codes @ c.codes[cols].astype(kind).T).astype(np.float64) * q.step[rows, None] * c.step[cols]
                slack = (q.norm + q.error)[rows, None] * c.error[cols] + q.error[rows, None] * c.norm[cols]
                slack += 1e-12 * (q.norm[rows, None] * c.norm[cols])
                if about.shape[1] >= k:
                    lower = np.partition(about - slack, about.shape[1] - k, axis=1)[:, about.shape[1] - k]
                    known = np.fmax(known, lower)
                x, y = np.nonzero(~(about + slack < known[:, None]))
            for s in range(0, len(x), 1 << 18):  # bounded, however many pairs lie within the bounds
                px, py = x[s : s + (1 << 18)], y[s : s + (1 << 18)] + j
                score = products(q.floats[px + i], c.floats[py])
                score[np.isnan(score)] = -np.inf
                order = np.lexsort((first[py], -score, px))
                px, py, score = px[order], py[order], score[order]
                heads = np.flatnonzero(np.diff(px, prepend=-1))
                for a, b in zip(heads, [*heads[1:], len(px)]):
                    row, b = px[a], min(b, a + k)
                    some = [ids[m] for m in py[a:b]]
                    each = np.fromiter(map(len, some), np.int64, len(some))
                    have = best[row]
                    s2 = np.concatenate([have[0], np.repeat(score[a:b], each)])
                    i2, n2 = np.concatenate([have[1], *some]), np.concatenate([have[2], np.repeat(c.node[py[a:b]], each)])
                    keep = np.lexsort((i2, -s2))[:k]
                    best[row] = s2[keep], i2[keep], n2[keep]
                    if len(keep) == k:
                        known[row] = max(known[row], s2[keep[-1]])
        for row, (score, found, node) in enumerate(best):
            yield int(q.node[i + row]), score, found, node


def merged(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """Per query node the k best of all tiles' lists, held in a heap whose root is the worst: no list of tiles is gathered."""
    out: list[tuple] = []
    last, heap = None, []

    def close() -> None:
        ranked = sorted(heap, reverse=True)
        out.append((last, [s for s, _, _ in ranked], [-i for _, i, _ in ranked], [n for _, _, n in ranked]))

    for pdf in batches:
        for query, scores, ids, nodes in zip(pdf["query"], pdf.scores, pdf.ids, pdf.nodes):
            if query != last:
                if last is not None:
                    close()
                last, heap = query, []
            for one in zip(scores.tolist(), (-ids).tolist(), nodes.tolist()):
                if len(heap) < k:
                    heapq.heappush(heap, one)
                elif one > heap[0]:
                    heapq.heapreplace(heap, one)
                else:
                    break  # the rest of a sorted list is worse
        if len(out) >= 4096:
            yield pd.DataFrame(out, columns=["query", "scores", "ids", "nodes"])
            out = []
    if last is not None:
        close()
    yield pd.DataFrame(out, columns=["query", "scores", "ids", "nodes"])


def nearest(rows: DataFrame, queries: DataFrame | None = None, k: int = NEAREST, every: int = EVERY) -> DataFrame:
    """Each query's ``k`` nearest rows: query_id, rank (from 1), vec_id, score; largest inner product first, ties to the smaller vec_id.

    ``queries`` (vec_id, embedding) defaults to the rows whose vec_id is divisible by ``every``;
    candidates are all rows but the query's own (same vec_id and vector, once). The answer is exact:
    8-bit codes and their error bounds only spare pairs that cannot be among the k nearest.

    Equal vectors form one node that carries its k + 1 smallest vec_ids; more of them cannot be in an
    answer. Nodes are dealt by hash into blocks, and every block of queries meets every block of
    candidates of its width in one tile. A tile answers with k + 1 rows a query, however many near copies
    it holds, and the tiles' lists are merged by heaps. Blocks grow with the table up to MOST_BLOCK rows, so a
    task is bounded, and rows travel once per block of the other side.

    Rows with a null vec_id, and vectors that are null, empty, zero or hold null or non-finite components, take
    no part. Vectors meet vectors of their own length only. Repeated rows of a query each get an answer, and are
    candidates for each other. Products that overflow to no number come last. Fewer candidates than k give all of them; an empty
    table gives no rows. Extra columns are ignored.
    """
    base = land(quantised(rows), "codes")
    asked = base.where(F.col("vec_id") % every == 0) if queries is None else land(quantised(queries), "queries")
    vector = [c.split()[0] for c in _VECTOR.split(", ")]
    # the k + 1 smallest ids of a node: each task keeps its own k + 1 before the shuffle
    low = base.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    nodes = low.groupBy("node").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), *(F.any_value(c).alias(c) for c in vector[1:]))
    candidates = land(nodes, "candidates")
    wanted = land(asked.groupBy("node").agg(*(F.any_value(c).alias(c) for c in vector[1:])), "wanted")

    def dealt(side: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
        size = F.least(F.lit(MOST_BLOCK), F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.col("n") / parts)))
        n = side.groupBy("width").agg(F.count("*").alias("n")).select("width", F.ceil(F.col("n") / size).cast("int").alias("n_blocks"))
        own = F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int").alias("own")
        return side.join(n, "width").select("*", own).drop("n_blocks"), n

    left, n_left = dealt(wanted, 1 if queries is None else TILES)
    right, n_right = dealt(candidates, TILES)
    every_block = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    a = left.join(n_right, "width").select(*vector, F.lit(None).cast("array<long>").alias("ids"), F.col("own").alias("qb"), every_block(F.col("n_blocks")).alias("cb"))
    b = right.join(n_left, "width").select(*vector, "ids", every_block(F.col("n_blocks")).alias("qb"), F.col("own").alias("cb"))
    tiles = a.unionByName(b).repartition("width", "qb", "cb").sortWithinPartitions("width", "qb", "cb")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs(batches, ["width", "qb", "cb"]):
            asks = group.ids.isna()
            ours = group[~asks]
            if asks.any() and len(ours):
                found = tile(Side.of(group[asks]), Side.of(ours), [np.asarray(i, np.int64) for i in ours.ids], k + 1)
                yield pd.DataFrame(list(found), columns=["query", "scores", "ids", "nodes"])

    lists = "query long, scores array<double>, ids array<long>, nodes array<long>"
    parts = tiles.mapInPandas(compare, lists).repartition("query").sortWithinPartitions("query")
    best = parts.mapInPandas(lambda batches: merged(batches, k + 1), lists)
    answers = asked.select(F.col("vec_id").alias("query_id"), F.col("node").alias("query")).join(best, "query")
    each = F.arrays_zip("scores", "ids", "nodes")
    own = F.array_position(F.transform(each, lambda x: (x["ids"] == F.col("query_id")) & (x["nodes"] == F.col("query"))), True)
    others = F.slice(F.filter(each, lambda x, i: i + 1 != own), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("at", "one")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("one.ids").alias("vec_id"), F.col("one.scores").alias("score")
    )
