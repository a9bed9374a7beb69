"""Pairs within overlapping groups, compared in blocks and counted without being written out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygauge.llm.text import runs

#: Members of one block; a task holds two blocks at a time.
BLOCK = 1024
Alike = Callable[[pd.Series, pd.Series | None], np.ndarray]


def deal(members: DataFrame, size: int | Column = BLOCK, sizes: DataFrame | None = None) -> DataFrame:
    """Rows (gid, a, b, side, ...) that bring every two members of a group together in one (gid, a, b).

    ``members`` has gid (long), id (long) and further columns. A group of n members is dealt by a
    hash of the id into ceil(n / size) blocks, and every two blocks meet once, so no task gets a
    whole large group. Groups of one member are left out: they hold no pair. ``sizes`` (gid, n_members)
    is given where groups are few beside their members, which then stay where they are for it.
    """
    counted = members.groupBy("gid").agg(F.count("*").alias("n_members")) if sizes is None else F.broadcast(sizes)
    sizes = counted.where("n_members > 1")
    n = F.ceil(F.col("n_members") / size).cast("int")
    own = F.pmod(F.xxhash64("id", "gid"), n).cast("int")
    return (
        members.join(sizes, "gid")
        .withColumns({"n_blocks": n, "own": own})
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")})
        .drop("n_members", "n_blocks", "other")
    )


def linked(dealt: DataFrame, alike: Alike, id_type: str = "long") -> DataFrame:
    """Counts and spanning links of ``dealt`` rows (gid, a, b, own, id, weight, gids, payload).

    ``alike(left, right)`` gives the boolean matrix of linked pairs of two payload columns (right
    None: left with itself). A pair that shares several groups counts in the smallest one only.
    Returned rows: (u, v, n): v null: node u got n (sum of weights of linked nodes) more links; else a
    link u-v, enough of them to connect what is linked here.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs(batches, ["gid", "a", "b"]):
            group = group.drop_duplicates("id")
            gid, a, b = group.gid.iloc[0], group.a.iloc[0], group.b.iloc[0]
            left = group[group.own == a]
            right = left if a == b else group[group.own == b]
            if left.empty or right.empty or (a == b and len(left) < 2):
                continue
            hit = alike(left.payload, None if a == b else right.payload)
            if a == b:
                np.fill_diagonal(hit, False)
            if not hit.any():
                continue
            x, y = left.id.to_numpy(), right.id.to_numpy()
            rows = [_forest(x, y, hit)]
            hit &= ~_met_before(left.gids, right.gids, gid, hit)
            rows.append(_counts(x, hit @ right.weight.to_numpy(np.float64)))
            if a != b:
                rows.append(_counts(y, left.weight.to_numpy(np.float64) @ hit))
            yield pd.concat(rows, ignore_index=True)

    return dealt.repartition("gid", "a", "b").sortWithinPartitions("gid", "a", "b").mapInPandas(compare, f"u {id_type}, v {id_type}, n long")


def _counts(ids: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    on = n > 0
    return pd.DataFrame({"u": pd.array(ids[on], "Int64"), "v": pd.array([None] * int(on.sum()), "Int64"), "n": n[on].astype(np.int64)})


def _met_before(left: pd.Series, right: pd.Series, gid: int, hit: np.ndarray) -> np.ndarray:
    """Pairs that share a group smaller than ``gid``, among rows and columns with a hit.

    Works on the sorted memberships of either side, so memory grows with their number and not with
    members times groups.
    """

    def members(lists: pd.Series, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        groups = [np.asarray(lists.iloc[i], np.int64) for i in on]
        at, of = np.repeat(on, [len(g) for g in groups]), np.concatenate(groups)
        at, of = at[of < gid], of[of < gid]
        order = np.argsort(of, kind="stable")
        return at[order], of[order]

    return met(hit.shape, *members(left, np.flatnonzero(hit.any(axis=1))), *members(right, np.flatnonzero(hit.any(axis=0))))


def met(shape: tuple[int, int], p: np.ndarray, of_p: np.ndarray, q: np.ndarray, of_q: np.ndarray) -> np.ndarray:
    """Rows ``p`` and columns ``q`` that share a group: ``of_p`` and ``of_q`` are the sorted groups of each membership."""
    out = np.zeros(shape, bool)
    both = np.intersect1d(of_p, of_q)
    ends = [np.searchsorted(of, both, side) for of in (of_p, of_q) for side in ("left", "right")]
    for i, j, k, m in zip(*ends):
        out[p[i:j, None], q[None, k:m]] = True
    return out


def _forest(x: np.ndarray, y: np.ndarray, hit: np.ndarray) -> pd.DataFrame:
    u, v = (np.concatenate([x, y])[ends] for ends in spanning(hit))
    return pd.DataFrame({"u": pd.array(u, "Int64"), "v": pd.array(v, "Int64"), "n": np.zeros(len(u), np.int64)})


def spanning(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of a spanning forest of the linked pairs, breadth first over rows and columns; columns are numbered after the rows."""
    free_r, free_c = hit.any(axis=1), hit.any(axis=0)
    n, u, v = len(free_r), [], []
    while free_r.any():
        i = int(np.argmax(free_r))
        free_r[i] = False
        todo = [(True, i)]
        while todo:
            row, k = todo.pop()
            new = np.flatnonzero(hit[k] & free_c if row else hit[:, k] & free_r)
            (free_c if row else free_r)[new] = False
            u += [k if row else n + k] * len(new)
            v += (n + new if row else new).tolist()
            todo += [(not row, j) for j in new.tolist()]
    return np.array(u, np.int64), np.array(v, np.int64)
