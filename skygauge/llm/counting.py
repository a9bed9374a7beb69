"""Token counts of whole texts: pieces are counted once per distinct pre-token and joined back."""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from zlib import compress, crc32, decompress

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge.llm.bpe import REMEMBER, WordPieces, tokenizer_path, word_pieces
from skygauge.llm.storage import land

VOCABULARY, LIMIT = "word_bpe_49k.json", 2048
#: Documents and characters of one block of frequencies (a longer text has a block of its own).
BLOCK_DOCS, BLOCK_CHARS = 1024, 2_000_000
_BLOCK = "block long, doc_id array<long>, n_bytes array<long>, buckets array<struct<bucket:int,pretokens:binary>>, doc binary, uses binary, n binary"


class Numbered(dict):
    """Numbers of chunks in the order they came; each is cut into numbered pre-tokens when it is first seen.

    Chunk k has each[k] pre-tokens, whose numbers stand in ``flat``, chunk after chunk.
    """

    def __init__(self, words: WordPieces, n_buckets: int):
        super().__init__()
        self.words, self.n_buckets = words, n_buckets
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.names: dict[str, int] = {}
        self.each, self.flat, self.chars = array("q"), array("q"), 0
        self.bucket, self.head = np.empty(0, np.int64), np.empty(0, np.uint64)

    def __missing__(self, chunk: str) -> int:
        split, names = [chunk] if chunk[0] == "\n" else self.words.work(chunk), self.names
        for p in split:
            self.flat.append(names.setdefault(p, len(names)))
        self.each.append(len(split))
        self.chars += len(chunk)
        out = self[chunk] = len(self)
        return out

    def order(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash buckets of all pre-tokens and, to sort them by, their first eight bytes as numbers."""
        raw = [p.encode() for p in islice(self.names, len(self.bucket), None)]
        self.bucket = np.append(self.bucket, np.fromiter(map(crc32, raw), np.int64, len(raw)) % self.n_buckets)
        self.head = np.append(self.head, np.array(raw, "S8").view(">u8").astype(np.uint64))
        return self.bucket, self.head

    @property
    def full(self) -> bool:
        return len(self) > REMEMBER or self.chars > 16 * REMEMBER


@lru_cache(maxsize=1)
def numbered(path: str, n_buckets: int) -> Numbered:
    """A worker's numbers, forgotten after a block when they are full; results do not depend on them."""
    return Numbered(word_pieces(path), n_buckets)


def frequencies(docs: DataFrame, path: str, n_buckets: int) -> DataFrame:
    """Blocks of documents with their pre-token frequencies.

    The block's pre-tokens stand in ``buckets``, by hash bucket and then by first bytes; the k-th of them in
    that order is used by uses[k] documents; entries follow in the same order: document doc[e] has it
    n[e] times (little-endian 16, 16 and 32 bits). Names (a JSON list) and numbers are deflated, for
    they are what travels.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = numbered(path, n_buckets)
        part, made = TaskContext.get().partitionId(), 0
        ids, sizes, chunks, chars = [], [], [], 0
        for pdf in batches:
            for doc_id, text in zip(pdf.doc_id, pdf.text):
                n = len(text or "")
                if ids and (len(ids) >= BLOCK_DOCS or chars + n > BLOCK_CHARS):
                    yield block(known, part << 32 | made, ids, sizes, chunks)
                    made, ids, sizes, chunks, chars = made + 1, [], [], [], 0
                ids.append(doc_id)
                sizes.append(len(text.encode()) if text else 0)
                cut = known.words.chunks(text)
                chunks.append(np.fromiter(map(known.__getitem__, cut), np.int64, len(cut)))
                chars += n
        if ids:
            yield block(known, part << 32 | made, ids, sizes, chunks)

    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(count, _BLOCK)


def block(known: Numbered, number: int, ids: list, sizes: list, chunks: list[np.ndarray]) -> pd.DataFrame:
    each, flat, (bucket, head) = np.array(known.each), np.array(known.flat), known.order()
    start = np.cumsum(each) - each
    met, n = np.unique(np.concatenate(chunks) * len(ids) + np.repeat(np.arange(len(ids)), [len(c) for c in chunks]), return_counts=True)
    chunk, doc = np.divmod(met, len(ids))
    reps = each[chunk]
    at = np.repeat(start[chunk] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
    used = np.flatnonzero(np.bincount(flat[at], minlength=len(bucket)))
    used = used[np.lexsort((head[used], bucket[used]))]
    rank = np.zeros(len(bucket), np.int64)
    rank[used] = np.arange(len(used))
    code = rank[flat[at]] * len(ids) + np.repeat(doc, reps)
    order = np.argsort(code, kind="stable")
    code, heads = np.unique(code[order], return_index=True)
    total = np.add.reduceat(np.repeat(n, reps)[order], heads) if len(code) else np.empty(0)
    listed = list(known.names)
    names = [listed[k] for k in used.tolist()]
    of = bucket[used]
    cuts = [*np.flatnonzero(np.diff(of, prepend=-1)).tolist(), len(names)]
    made = pd.DataFrame({
        "block": [number], "doc_id": [[None if i is None or i != i else int(i) for i in ids]], "n_bytes": [sizes],
        "buckets": [[{"bucket": int(of[a]), "pretokens": compress(json.dumps(names[a:b], ensure_ascii=False).encode(), 1)} for a, b in zip(cuts, cuts[1:])]],
        "doc": [deflate(code % len(ids), "<u2")], "uses": [deflate(np.bincount(code // len(ids), minlength=len(names)), "<u2")], "n": [deflate(total, "<u4")],
    })
    if known.full:
        known.forget()
    return made


def deflate(numbers: np.ndarray, kind: str) -> bytes:
    return compress(numbers.astype(kind).tobytes(), 1)


def inflate(packed: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(decompress(packed), kind)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, n_buckets: int = 256) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Counts equal the library's for the whole text without begin and end tokens; special strings in a
    text count as one. Frequencies are gathered per block of documents, so that a frequent pre-token
    is there once per block. Pre-tokens travel by hash bucket, where each distinct one is counted
    once, and only its number of pieces goes back to the blocks, to be summed with the frequencies.
    No ids are made. ``n_buckets`` bounds the tasks that count pieces: raise it with the table.

    Null and empty texts have 0 bytes and tokens. Null ids and repeated rows stay as they are. A very
    long text is a block of its own. An empty table gives no rows. Extra columns are ignored.
    """
    path = path or tokenizer_path(VOCABULARY)
    blocks = land(frequencies(docs, path, n_buckets), "frequencies")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = word_pieces(path)
        for pdf in batches:
            lists = map(json.loads, map(decompress, pdf.pretokens))
            sizes = [np.fromiter(map(words.pieces.__getitem__, names), "<u4").tobytes() for names in lists]
            yield pd.DataFrame({"block": pdf.block, "bucket": pdf.bucket, "pieces": sizes})

    uses = blocks.select("block", F.inline("buckets")).repartition("bucket").sortWithinPartitions("bucket")
    found = uses.mapInPandas(count, "block long, bucket int, pieces binary")
    found = found.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "pieces")))["pieces"].alias("pieces"))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                parts = [] if row.pieces is None else list(row.pieces)
                pieces = np.repeat(np.frombuffer(b"".join(parts), "<u4"), inflate(row.uses, "<u2")).astype(np.float64)
                sums = np.bincount(inflate(row.doc, "<u2"), weights=inflate(row.n, "<u4") * pieces, minlength=len(row.n_bytes))
                ids = [None if i is None or i != i else int(i) for i in row.doc_id]
                yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n_bytes": row.n_bytes, "n_tokens": sums.astype(np.int64)})

    counted = blocks.drop("buckets").join(found, "block", "left").mapInPandas(add, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
