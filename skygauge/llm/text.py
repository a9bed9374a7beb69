"""Words, shingles and batch helpers shared by the text operators."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd

#: White space that ends a word: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8; ``bytes.split`` cuts at exactly the six ASCII white space characters."""
    return text.encode().split() if text else []


def shingle_hashes(tokens: list[bytes], n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word ``n``-grams; a shorter text is one gram of all its words.

    The hash of a word mixes two checksums of its bytes and the hash of a gram mixes its words by
    place, so that equal grams of any two texts, on any executor, get equal numbers.
    """
    if not tokens:
        return np.empty(0, np.uint64)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in tokens), np.int64, len(tokens))
    codes = _mix(np.fromiter((zlib.crc32(w) << 32 | zlib.adler32(w) ^ zlib.crc32(w, 0x9E3779B9) for w in seen), np.uint64, len(seen)))[ids]
    k = min(n, len(tokens))
    out = np.zeros(len(codes) - k + 1, np.uint64)
    for i in range(k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + codes[i : len(codes) - k + 1 + i])
    if len(tokens) < n:
        out = _mix(out + np.uint64(len(tokens)))
    return np.unique(out)


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """One frame for each run of equal keys in a partition that is sorted by them."""
    held: list[pd.DataFrame] = []
    last = None
    for pdf in batches:
        if pdf.empty:
            continue
        marks = pdf[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(pdf)]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(marks[a])
            if held and key != last:
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
                held = []
            held.append(pdf.iloc[a:b])
            last = key
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
