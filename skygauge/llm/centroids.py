"""Centroid clustering of integer vectors; distances are gathered from tables of squared differences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge.llm.storage import land

WIDTH, SCALE, CLUSTERS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Integers are held within this bound, so that a distance over up to 64 components fits 64 bits.
LIMIT = 1 << 27
#: Vectors of one block: their distinct values per dimension are few against their number.
BLOCK = 4096
_BLOCK = "vec_id array<string>, values binary, sizes binary, codes binary"


def integer_vectors(rows: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id string, v array<long>): vectors of ``width`` components, none null or non-finite, as floor(scale * x)."""
    v = F.col("embedding").cast("array<double>")
    sound = (F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    bounded = lambda x: F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), x * float(scale)))
    whole = F.transform(v, lambda x: F.floor(bounded(x)).cast("long"))
    return rows.where(sound).select(F.col("vec_id").cast("long").cast("string").alias("vec_id"), whole.alias("v"))


def blocks(vectors: DataFrame, width: int) -> DataFrame:
    """Up to BLOCK vectors a row: per dimension the sorted values that occur, and each vector's places among them (16 bits)."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[str | None] = []
        held: list[np.ndarray] = []
        for pdf in batches:
            ids += pdf.vec_id.tolist()
            held += pdf.v.tolist()
            while len(ids) >= BLOCK:
                yield block(ids[:BLOCK], np.stack(held[:BLOCK]))
                ids, held = ids[BLOCK:], held[BLOCK:]
        if ids:
            yield block(ids, np.stack(held))

    def block(ids: list, v: np.ndarray) -> pd.DataFrame:
        found = [np.unique(v[:, d], return_inverse=True) for d in range(width)]
        return pd.DataFrame({
            "vec_id": [ids], "values": [np.concatenate([u for u, _ in found]).astype("<i8").tobytes()],
            "sizes": [np.array([len(u) for u, _ in found], "<i4").tobytes()], "codes": [np.stack([c for _, c in found]).astype("<u2").tobytes()],
        })

    return vectors.mapInPandas(fold, _BLOCK)


def opened(row) -> tuple[list[np.ndarray], np.ndarray]:
    """Occurring values per dimension, and the codes of a block (dimension by vector)."""
    cuts = np.cumsum(np.frombuffer(row.sizes, "<i4"))[:-1]
    return np.split(np.frombuffer(row.values, "<i8"), cuts), np.frombuffer(row.codes, "<u2").reshape(-1, len(row.vec_id))


def nearest(values: list[np.ndarray], codes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smallest one of equals) and squared distance of every vector of a block.

    Per dimension a table holds (value - centroid)^2 for each occurring value and each centroid; a
    vector's distances are the sums of the rows its codes gather.
    """
    total = np.zeros((codes.shape[1], len(centroids)), np.int64)
    for d, occurring in enumerate(values):
        table = np.subtract.outer(occurring, centroids[:, d]) ** 2
        total += table[codes[d]]
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(cluster)), cluster]


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """Vectors with the smallest sha256 of ``seed:vec_id``, in that order; of rows with one id the smaller components come first."""
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("vec_id", F.lit(""))), 256)
    picked = vectors.select(code.alias("code"), "v").orderBy("code", "v").limit(clusters).collect()
    return np.array([r.v for r in picked], np.int64)


def moved(folded: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: componentwise floor(sum / count) of their vectors, exact; empty ones stay."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, width = centroids.shape
        counts, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                values, codes = opened(row)
                cluster, _ = nearest(values, codes, centroids)
                counts += np.bincount(cluster, minlength=k)
                for d, occurring in enumerate(values):  # how often a value occurs in a cluster, times the value
                    times = np.bincount(cluster * len(occurring) + codes[d], minlength=k * len(occurring)).reshape(k, -1)
                    sums[:, d] += times @ occurring
        on = np.flatnonzero(counts)
        if len(on):
            yield pd.DataFrame({"cluster": on, "n": counts[on], "sums": list(sums[on])})

    parts = folded.mapInPandas(add, "cluster int, n long, sums array<long>")
    n = {r[0]: r[1] for r in parts.groupBy("cluster").agg(F.sum("n")).collect()}  # at most k rows
    each = parts.select("cluster", F.posexplode("sums").alias("d", "s")).groupBy("cluster", "d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = centroids.copy()
    for r in each.collect():  # at most k * width rows
        out[r.cluster, r.d] = int(r.s) // n[r.cluster]
    return out


def centroid_clusters(
    rows: DataFrame, width: int = WIDTH, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``width`` components, none null or non-finite; a component x becomes
    floor(scale * x). The first centroids are the vectors with the smallest sha256 of ``seed:vec_id``.
    ``rounds`` times every vector goes to its nearest centroid (squared Euclidean distance, the smaller
    number of equals) and every non-empty centroid to the floor of its vectors' mean; then vectors
    are assigned once more. All sums are exact integers.

    Vectors lie in blocks of their codes, written once; a round reads them, tabulates squared
    differences for the values that occur in a block, and sends one sum per cluster and task.
    A hot vector is a value like others: rows are never gathered by cluster.

    Left out: null vectors, other lengths, null or non-finite components. Integers beyond 2^27 either way are held
    at that bound. A null vec_id is hashed as an empty one. Repeated rows are vectors of their own. Fewer kept
    vectors than ``clusters`` give as many centroids; an empty table gives no rows. Extra columns are ignored.
    Sums over more than 2^63 / distance vectors would overflow; they end in null.
    """
    spark = rows.sparkSession
    vectors = integer_vectors(rows, width, scale)
    folded = land(blocks(vectors, width), "codes")
    centroids = first_centroids(vectors, clusters, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(folded, centroids)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                cluster, distance = nearest(*opened(row), centroids)
                yield pd.DataFrame({"vec_id": row.vec_id, "cluster": cluster.astype(np.int32), "distance": distance})

    placed = land(folded.mapInPandas(assign, "vec_id string, cluster int, distance long"), "assigned")
    sums = {r[0]: int(r[1]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    facts = [(k, fits(sums.get(k, 0)), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(centroids)]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # one row per centroid
    return placed.join(F.broadcast(table), "cluster").select(
        F.col("vec_id").cast("long").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
