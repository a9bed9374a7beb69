"""Near-duplicate vectors by a forest of random-projection trees with spill overlap."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skygauge.llm import blocks
from skygauge.llm.blocks import deal, met, spanning
from skygauge.llm.components import components
from skygauge.llm.storage import land, tidy
from skygauge.llm.text import runs

SIMILARITY, TREES, LEAF, SPILL, SAMPLE = 0.9, 16, 256, 0.12, 20_000
#: Bytes of vectors in a cell, the part of a tree that one task takes down to its leaves; bytes of vectors dealt to cells in one round.
CELL, ROUND = 2**23, 2**27
#: Cells of a hit matrix that are held until their memberships are looked up.
HELD = 2**24


@dataclass
class Tree:
    """One random direction per level; split and half width of the overlap per cell of a level.

    Cells are told apart by the first ``resolved`` steps of a path, as far as the sample can estimate
    medians; deeper levels go on splitting by the sample of that cell, so a tree can be as deep as
    the table asks while its size is bounded by the sample.
    """

    directions: np.ndarray
    resolved: int
    splits: list[np.ndarray]
    margins: list[np.ndarray]

    def cell(self, path: np.ndarray, level: int) -> np.ndarray:
        return path >> max(0, level - self.resolved)


def on_grid(x: np.ndarray, bits: int) -> np.ndarray:
    """``x`` in whole steps of 2**-bits. Products of unit vectors (13 bits) and directions (9 bits) and all their sums are then
    exact in single precision, so that a vector has the same projections, and leaves, in any batch of any task."""
    return (np.round(x * 2.0**bits) * 2.0**-bits).astype(np.float32)


def fit_tree(sample: np.ndarray, depth: int, spill: float, seed: int) -> Tree:
    """Each cell splits at its sample's median; the ``spill`` share of rows nearest to it goes to both sides."""
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(depth, sample.shape[1])).astype(np.float32)
    directions = on_grid(directions / np.linalg.norm(directions, axis=1, keepdims=True), 9)
    sample = on_grid(sample, 13)
    tree = Tree(directions, max(0, int(np.log2(max(1, len(sample) / 16)))), [], [])
    path = np.zeros(len(sample), np.int64)
    for level in range(depth):
        x = sample @ directions[level]
        cell = tree.cell(path, level)
        n = 2 ** min(level, tree.resolved)
        split = np.full(n, np.median(x) if len(x) else 0.0)
        margin = np.full(n, np.quantile(np.abs(x - split[0]), spill) if len(x) else 0.0)
        order = np.argsort(cell, kind="stable")
        for k, own in zip(*_grouped(cell[order], x[order])):
            split[k] = np.median(own)
            margin[k] = np.quantile(np.abs(own - split[k]), spill)
        tree.splits.append(split)
        tree.margins.append(margin)
        path = path * 2 + (x > split[cell])
    return tree


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    names, start = np.unique(keys, return_index=True)
    return names, np.split(values, start[1:])


def leaves(tree: Tree, x: np.ndarray, path: np.ndarray | None = None, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of every cell of level ``last`` (default: every leaf) that a row on the grid falls into, from its cell ``path``
    of level ``first``; rows within a cell's margin go to both children."""
    rows, path = np.arange(len(x)), np.zeros(len(x), np.int64) if path is None else path
    along = x @ tree.directions[first:last].T
    for level, own in enumerate(along.T, first):
        cell = tree.cell(path, level)
        away = own[rows] - tree.splits[level][cell]
        left, right = away <= tree.margins[level][cell], away > -tree.margins[level][cell]
        rows, path = np.concatenate([rows[left], rows[right]]), np.concatenate([path[left] * 2, path[right] * 2 + 1])
    return rows, path


def units(payload: Iterable[bytes], kind: str) -> np.ndarray:
    """Vectors of one length, given as bytes of floats, in double precision and of length one."""
    held = list(payload)
    x = np.frombuffer(b"".join(held), kind).reshape(len(held), -1).astype("<f8")
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Alike:
    """Cosine of at least ``similarity``, in double precision, between rows of ``u`` (unit vectors).

    Single precision decides what lies off the threshold by more than its error; the rest is computed again.
    """

    def __init__(self, u: np.ndarray, similarity: float):
        self.u, self.near, self.similarity, self.error = u, u.astype(np.float32), similarity, (u.shape[1] + 8) * 2.0**-23

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        s = self.near[left] @ self.near[right].T
        hit = s >= np.float32(self.similarity - self.error)
        unsure = hit & (s <= np.float32(self.similarity + self.error))
        if unsure.any():
            i, j = np.nonzero(unsure)
            step = max(1, 2**20 // self.u.shape[1])
            for k in range(0, len(i), step):
                p, q = i[k : k + step], j[k : k + step]
                hit[p, q] = np.einsum("ij,ij->i", self.u[left[p]], self.u[right[q]]) >= self.similarity
        return hit


@dataclass
class Wood:
    """The trees of one length of vectors. Cells of level ``top`` go to tasks, ``rows`` is about how many nodes a cell holds."""

    kind: int
    top: int
    rows: int
    trees: list[Tree]


def compare_cell(group: pd.DataFrame, wood: Wood, t: int, cell: int, first_gid: int, floats: str, similarity: float) -> Iterator[pd.DataFrame]:
    """Links (u, v, n) as of :func:`skygauge.llm.blocks.linked` among the nodes of a cell of tree ``t``, leaf by leaf.

    ``group`` (own, id, weight, payload) is one block of the cell or two, which meet. A leaf of tree k is the group
    ``first_gid + (k << 40) + leaf``; a pair counts in the smallest it shares.
    """
    u = units(group.payload, floats)
    grid, alike, ids, weight = on_grid(u, 13), Alike(u, similarity), group.id.to_numpy(), group.weight.to_numpy(np.float64)
    side = group.own.to_numpy() != group.own.min()  # of two blocks, those of the second
    apart = bool(side.any())
    rows, leaf = leaves(wood.trees[t], grid, np.full(len(group), cell, np.int64), wood.top)
    order = np.lexsort((side[rows], leaf))
    rows, leaf = rows[order], leaf[order]
    n, ends, held, size = np.zeros(len(group)), [], [], 0
    for a, b in zip(*(np.searchsorted(leaf, np.unique(leaf), s) for s in ("left", "right"))):
        own = rows[a:b]
        cut = int(np.searchsorted(side[own], True)) if apart else 0
        left, right = (own[:cut], own[cut:]) if apart else (own, own)
        for i in range(0, len(left), blocks.BLOCK):
            for j in range(0 if apart else i, len(right), blocks.BLOCK):
                p, q = left[i : i + blocks.BLOCK], right[j : j + blocks.BLOCK]
                hit = alike(p, q)
                twice = not apart and i == j
                if twice:
                    np.fill_diagonal(hit, False)
                on_p, on_q = hit.any(axis=1), hit.any(axis=0)
                if on_p.any():
                    held.append((int(leaf[a]), p[on_p], q[on_q], hit[np.ix_(on_p, on_q)], twice))
                    size += held[-1][3].size
                if size > HELD:
                    ends.append(_settle(held, n, weight, grid, wood, t, first_gid))
                    held, size = [], 0
    ends.append(_settle(held, n, weight, grid, wood, t, first_gid))
    yield blocks._counts(ids, n)
    u, v = (ids[x] for x in np.unique(np.sort(np.concatenate(ends, axis=1), axis=0), axis=1))
    yield pd.DataFrame({"u": pd.array(u, "Int64"), "v": pd.array(v, "Int64"), "n": np.zeros(len(u), np.int64)})


def _settle(held: list, n: np.ndarray, weight: np.ndarray, grid: np.ndarray, wood: Wood, t: int, first_gid: int) -> np.ndarray:
    """Adds the weights of newly linked rows to ``n``; the two ends of spanning links as rows of a matrix."""
    if not held:
        return np.zeros((2, 0), np.int64)
    on = np.unique(np.concatenate([x for _, p, q, _, _ in held for x in (p, q)]))
    at, of = [], []
    for k, tree in enumerate(wood.trees[: t + 1]):
        r, leaf = leaves(tree, grid[on])
        at.append(r)
        of.append(first_gid + (k << 40) + leaf)
    at, of = np.concatenate(at), np.concatenate(of)
    order = np.lexsort((of, at))
    of, start = of[order], np.searchsorted(at[order], np.arange(len(on) + 1))

    def before(rows: np.ndarray, gid: int) -> tuple[np.ndarray, np.ndarray]:
        a = start[np.searchsorted(on, rows)]
        each = start[np.searchsorted(on, rows) + 1] - a
        p = np.repeat(np.arange(len(rows)), each)
        groups = of[np.repeat(a - np.cumsum(each) + each, each) + np.arange(each.sum())]
        p, groups = p[groups < gid], groups[groups < gid]
        by = np.argsort(groups, kind="stable")
        return p[by], groups[by]

    ends = []
    for leaf, p, q, hit, twice in held:
        a, b = spanning(hit)
        ends.append(np.concatenate([p, q])[np.stack([a, b])])
        gid = first_gid + (t << 40) + leaf
        hit &= ~met(hit.shape, *before(p, gid), *before(q, gid))
        n[p] += hit @ weight[q]
        if not twice:
            n[q] += weight[p] @ hit
    return np.concatenate(ends, axis=1)


def vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, node, payload): payload the components as floats, 32-bit ones if the table's are, node a hash of them; both null for unusable vectors."""
    kind = rows.schema["embedding"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            x = lists.flatten().to_numpy(zero_copy_only=False).astype("<f8") + 0.0  # one zero; a null component is NaN
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            bad, some = (np.concatenate([[0], np.cumsum(on)])[ends] for on in (~np.isfinite(x), x != 0))
            usable = (np.diff(bad) == 0) & (np.diff(some) > 0)
            wide, own = x.tobytes(), x.astype("<f4").tobytes() if single else None
            node = [int.from_bytes(hashlib.blake2b(wide[8 * a : 8 * b], digest_size=8).digest(), "little", signed=True) if on else None for a, b, on in zip(ends, ends[1:], usable)]
            payload = [(own[4 * a : 4 * b] if single else wide[8 * a : 8 * b]) if on else None for a, b, on in zip(ends, ends[1:], usable)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.int64()), pa.array(payload, pa.binary())], names=["vec_id", "node", "payload"])

    embedding = F.col("embedding") if single else F.col("embedding").cast("array<double>").alias("embedding")
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), embedding).mapInArrow(read, "vec_id long, node long, payload binary")


def near_vectors(
    rows: DataFrame, similarity: float = SIMILARITY, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, sample: int = SAMPLE, seed: int = 11
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Equal vectors form one node before anything is compared. Every node falls into the leaves of
    ``trees`` trees, whose random splits are fitted on a bounded sample of at most about ``sample``
    nodes (hash order; all nodes are indexed); nodes of a leaf are compared in double precision, in
    blocks, so a leaf with a large group of near copies is neither gathered nor written out as pairs.
    The depth of the trees follows the number of nodes, for about ``leaf`` nodes in a leaf.

    A vector travels to the cells of a tree's upper levels, which hold about ``CELL`` bytes each, and is taken
    down to its leaves where it is compared, so it travels a few times a tree and not once for each leaf. Trees
    go in rounds that deal about ``ROUND`` bytes of vectors, one tree at least, and a round leaves its links only.

    Lengths of vectors are few: each has a forest of its own, with its share of the sample.

    Null, empty and zero vectors and those with null or non-finite components link with nothing and
    are kept. Repeated rows link with
    each other. A null vec_id counts but is never a component_id unless all of a component are null.
    An empty table gives no rows. Extra columns are ignored.
    """
    with tidy(rows.sparkSession):
        return _near_vectors(rows, similarity, trees, leaf, spill, sample, seed)


def _near_vectors(rows: DataFrame, similarity: float, trees: int, leaf: int, spill: float, sample: int, seed: int) -> DataFrame:
    spark = rows.sparkSession
    all_rows = land(vectors(rows), "vectors")
    usable = all_rows.where("node is not null")
    nodes = land(usable.groupBy("node").agg(F.count("*").alias("size"), F.min("vec_id").alias("first_id"), F.any_value("payload").alias("payload")), "nodes")
    lengths = {r[0]: r[1] for r in nodes.groupBy(F.length("payload")).agg(F.count("*")).collect()}
    floats = "<f4" if dict(rows.dtypes)["embedding"] == "array<float>" else "<f8"
    forest: dict[int, Wood] = {}
    total = sum(lengths.values())
    for kind, (width, n) in enumerate(sorted(lengths.items())):
        share = max(64, sample * n // max(total, 1))
        picked = nodes.where(F.length("payload") == width).where(F.pmod(F.xxhash64("node"), F.lit(2**31)) < min(2**31, int(2**31 * share / n) + 1)).select("payload").collect()
        x = units((r[0] for r in picked), floats) if picked else np.zeros((0, width // np.dtype(floats).itemsize))
        depth = int(np.ceil(np.log2(max(1, n / leaf))))
        in_cell = max(leaf, CELL // width)
        top = next((k for k in range(depth) if n * ((1 + spill) / 2) ** k <= in_cell), depth)
        forest[width] = Wood(kind, top, in_cell, [fit_tree(x, depth, spill, seed + t) for t in range(trees)])
    woods = list(forest.values())
    shared = spark.sparkContext.broadcast(forest)

    def placed(batch: pa.RecordBatch, chosen: range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, gid) of the cells that a batch of nodes falls into, tree by tree."""
        payload = batch.column(2).to_pylist()
        widths = np.array([len(v) for v in payload])
        for width in np.unique(widths):
            own, wood = np.flatnonzero(widths == width), shared.value[int(width)]
            grid = on_grid(units([payload[i] for i in own], floats), 13)
            for t in chosen:
                at, cell = leaves(wood.trees[t], grid, last=wood.top)
                yield own[at], (wood.kind * trees + t << 40) + cell

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, gids in placed(batch, range(trees)):
                gid, n = np.unique(gids, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gid), pa.array(n)], names=["gid", "n"])

    def place(chosen: range) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, gids in placed(batch, chosen):
                    yield pa.RecordBatch.from_arrays([pa.array(gids), *(c.take(pa.array(at)) for c in batch.columns)], names=["gid", "id", "weight", "payload"])

        return run

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grown = sorted(shared.value.values(), key=lambda w: w.kind)
        for group in runs(batches, ["gid", "a", "b"]):
            group = group.drop_duplicates("id")
            if len(group) < 2 or group.own.nunique() < 1 + (group.a.iloc[0] != group.b.iloc[0]):
                continue
            (kind, t), cell = divmod(int(group.gid.iloc[0]) >> 40, trees), int(group.gid.iloc[0]) & 2**40 - 1
            yield from compare_cell(group, grown[kind], t, cell, kind * trees << 40, floats, similarity)

    plain = nodes.select(F.col("node").alias("id"), F.col("size").alias("weight"), "payload")
    cells = land(plain.mapInArrow(count, "gid long, n long").groupBy("gid").agg(F.sum("n").alias("n_members")), "cells")
    # a cell of more than twice the usual size is dealt into blocks
    most = F.get(F.array(*[F.lit(2 * w.rows) for w in woods]), F.call_function("div", F.shiftright("gid", 40), F.lit(trees)).cast("int")) if woods else 1
    per_round = max(1, min(trees, ROUND // max(1, sum(width * n for width, n in lengths.items()))))
    rounds = []
    for t in range(0, trees, per_round):
        members = plain.mapInArrow(place(range(t, min(t + per_round, trees))), "gid long, id long, weight long, payload binary")
        dealt = deal(members, most, cells).repartition("gid", "a", "b").sortWithinPartitions("gid", "a", "b")
        rounds.append(land(dealt.mapInPandas(compare, "u long, v long, n long"), "links"))
    found = reduce(DataFrame.unionByName, rounds)
    links = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("links"))
    named = components(found.where("v is not null")).join(nodes.select("node", "first_id"), "node")
    named = named.join(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "component")
    facts = (
        nodes.select("node", "size", "first_id")
        .join(links, "node", "left")
        .join(named.select("node", "component_id"), "node", "left")
        .select("node", F.coalesce("component_id", "first_id").alias("component_id"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    rows_out = usable.select("vec_id", "node").join(facts, "node").drop("node")
    alone = all_rows.where("node is null").select("vec_id", F.col("vec_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return rows_out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
