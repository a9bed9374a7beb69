"""Similarity join on word n-grams: MinHash banding finds candidates, full n-gram sets decide."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge.llm.blocks import deal, linked
from skygauge.llm.components import components
from skygauge.llm.storage import land
from skygauge.llm.text import _mix, shingle_hashes, words

N_GRAM, SIMILARITY, RECALL, ROWS = 5, 0.8, 0.999, 6
#: Pairs of rows counted at a time, for grams that few rows hold.
PAIRS = 500_000


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """Smallest number of bands that catches a pair at exactly ``similarity`` with chance ``recall``."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))


def band_hashes(grams: np.ndarray, n_bands: int, rows: int, seed: int = 7) -> np.ndarray:
    """MinHash of ``grams`` under n_bands * rows hash functions, one number per band (the band's place mixed in)."""
    rng = np.random.default_rng(seed)
    mul = rng.integers(1, 2**63, n_bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.full(len(mul), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(grams), 2048):
        np.minimum(low, np.multiply.outer(mul, grams[i : i + 2048]).min(axis=1), out=low)
    out = _mix(np.arange(1, n_bands + 1, dtype=np.uint64))
    for column in low.reshape(n_bands, rows).T:
        out = _mix(out * np.uint64(31) + column)
    return out.view(np.int64)


def alike(left: pd.Series, right: pd.Series | None, n: int, similarity: float) -> np.ndarray:
    """Boolean matrix: Jaccard similarity of the full n-gram sets of two columns of texts reaches ``similarity``."""
    a = [shingle_hashes(words(t), n) for t in left]
    b = a if right is None else [shingle_hashes(words(t), n) for t in right]
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    both, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    col_a, col_b = at[: na.sum()], at[na.sum() :] if right is not None else at[na.sum() :]
    row_a, row_b = np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(b)), nb)
    df_a, df_b = np.bincount(col_a, minlength=len(both)), np.bincount(col_b, minlength=len(both))
    shared = np.zeros((len(a), len(b)), np.float32)
    work = df_a * df_b
    dense = work * 50 > len(a) * len(b)
    # grams that few rows have: their pairs are counted one by one
    few = (work > 0) & ~dense
    if few.any():
        pa, pb = few[col_a], few[col_b]
        order_a, order_b = np.argsort(col_a[pa], kind="stable"), np.argsort(col_b[pb], kind="stable")
        ra, ca, rb, cb = row_a[pa][order_a], col_a[pa][order_a], row_b[pb][order_b], col_b[pb][order_b]
        start, n_pairs = np.searchsorted(cb, ca), np.cumsum(df_b[ca])
        # slices of a bounded number of pairs: one side may hold a gram in a few rows and the other in nearly all
        cuts = np.unique(np.searchsorted(n_pairs, np.arange(0, n_pairs[-1], PAIRS)))
        for i, j in zip(cuts, [*cuts[1:], len(ra)]):
            n_each = df_b[ca[i:j]]
            first = np.repeat(start[i:j] - np.cumsum(n_each) + n_each, n_each)
            np.add.at(shared, (np.repeat(ra[i:j], n_each), rb[first + np.arange(n_each.sum())]), 1)
    # grams that many rows have: matrix products over slices of them
    which = np.flatnonzero(dense)
    for i in range(0, len(which), 2048):
        part = which[i : i + 2048]
        place = np.full(len(both), -1)
        place[part] = np.arange(len(part))
        ma, mb = np.zeros((len(a), len(part)), np.float32), np.zeros((len(b), len(part)), np.float32)
        for m, row, col in ((ma, row_a, col_a), (mb, row_b, col_b)):
            on = place[col] >= 0
            m[row[on], place[col[on]]] = 1
        shared += ma @ mb.T
    union = na[:, None] + nb[None, :] - shared
    return (shared > 0) & (shared >= similarity * union - 1e-6)


def signed(docs: DataFrame, n: int, n_bands: int, rows: int) -> DataFrame:
    """(doc_id, text_hash, node, bands): node is a 64-bit hash of the n-gram set, null without words."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            node, bands = [], []
            for text in pdf.text:
                grams = shingle_hashes(words(text), n)
                node.append(int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True) if len(grams) else None)
                bands.append(band_hashes(grams, n_bands, rows) if len(grams) else None)
            yield pd.DataFrame({"doc_id": pdf.doc_id, "text_hash": pdf.text_hash, "node": pd.array(node, "Int64"), "bands": bands})

    rows_in = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    return rows_in.mapInPandas(sign, "doc_id long, text_hash long, node long, bands array<long>")


def jaccard_join(docs: DataFrame, n: int = N_GRAM, similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, text_hash, component_id, n_links, kept.

    Documents are linked where the Jaccard similarity of their sets of word n-grams reaches
    ``similarity``. n_links counts the other documents linked directly, component_id is the smallest
    doc_id reachable by links, kept marks the document that bears it.

    Documents with equal gram sets form one class (a node) before anything is compared. Classes that
    agree in a band get the smallest of them as pivot; all classes of a pivot are compared on their
    full sets, in blocks, so a group of near copies of any size is neither gathered nor written out
    as pairs, and no candidate is left out. ``recall`` holds for a pair at the threshold itself.

    Null and empty texts, and texts of white space, link with nothing and are kept. Texts of fewer
    than n words are one gram. Repeated rows link with each other. A null doc_id counts as a document
    but is never a component_id unless all of a component are null. Extra columns are ignored.
    """
    signs = land(signed(docs, n, bands_for(similarity, recall, rows), rows), "signs")
    with_words = signs.where("node is not null")
    classes = land(
        with_words.groupBy("node").agg(
            F.count("*").alias("size"), F.min("doc_id").alias("first_id"),
            F.min(F.struct("doc_id", "text_hash")).alias("row"), F.any_value("bands").alias("bands"),
        ),
        "classes",
    )
    keys = classes.select("node", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = keys.join(buckets, "key").groupBy("node").agg(F.sort_array(F.collect_set("pivot")).alias("gids"))
    stars = land(stars.join(classes.select("node", "size", "row"), "node"), "stars")
    members = stars.select(
        F.explode("gids").alias("gid"), F.col("node").alias("id"), F.col("size").alias("weight"), "gids",
        F.col("row.doc_id").alias("row_id"), F.col("row.text_hash").alias("row_hash"),
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("row_id"), F.xxhash64("text").alias("row_hash"), F.col("text").alias("payload"))
    # both sides grow with the table: always a merge join, never a broadcast
    dealt = deal(members).alias("d").join(
        texts.alias("t").hint("merge"), (F.col("d.row_hash") == F.col("t.row_hash")) & F.col("d.row_id").eqNullSafe(F.col("t.row_id"))
    ).select("gid", "a", "b", "own", "id", "weight", "gids", "payload")
    found = land(linked(dealt, partial(alike, n=n, similarity=similarity)), "links")
    links = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("links"))
    parts = components(found.where("v is not null"))
    named = parts.join(classes.select("node", "first_id"), "node")
    named = named.join(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "component")
    facts = (
        classes.select("node", "size", "first_id")
        .join(links, "node", "left")
        .join(named.select("node", "component_id"), "node", "left")
        .select("node", F.coalesce("component_id", "first_id").alias("component_id"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    rows_out = with_words.select("doc_id", "text_hash", "node").join(facts, "node").drop("node")
    alone = signs.where("node is null").select("doc_id", "text_hash", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return rows_out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group of near copies, all columns unchanged.

    Of repeated rows with the same doc_id and text one stays. Documents without words, null texts
    included, all stay but for such repeats. An empty table gives no rows. Columns may have any name.
    """
    stay = jaccard_join(docs.select("doc_id", "text"), **options).where("kept").select(F.col("doc_id").cast("long").alias("id"), F.col("text_hash").alias("hash"))
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    o, s = own.alias("o"), stay.distinct().alias("s")
    rows = o.join(s, (F.col("o.hash") == F.col("s.hash")) & F.col("o.id").eqNullSafe(F.col("s.id"))).select("o.*")
    return rows.dropDuplicates(["id", "hash"]).select("row.*")
