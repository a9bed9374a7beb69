"""Public tokenizers inside tasks: one per Python worker, with a bounded memory of chunks already seen."""

from __future__ import annotations

import json
import re
import string
from array import array
from functools import cached_property, lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

#: Entries of a worker's memory (twice as many with the generation before); results do not depend on it.
REMEMBER = 250_000
#: A space between two characters that are not white space, which byte-level pre-tokens never cross.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space beyond the space: the narrow signs, and all others.
_NARROW = "\t\n\v\f\r\x1c\x1d\x1e\x1f"
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class Memory(dict):
    """Results of ``work(key)``; when full, entries not used since the last time are forgotten."""

    def __init__(self):
        super().__init__()
        self.before: dict = {}

    def __missing__(self, key: str):
        out = self.before.get(key)
        if out is None:
            out = self.work(key)
        if len(key) <= 64:
            if len(self) >= REMEMBER:
                self.before = dict(self)
                self.clear()
            self[key] = out
        return out


class ByteBpe(Memory):
    """Token ids of whole texts as little-endian 32-bit bytes, equal to the library's for the whole text.

    A byte-level pre-token may begin with one space but has no other, and its pattern looks no
    further than the next character, so a text cut before single inner spaces gives the same
    pre-tokens. Texts are therefore encoded as chunks, which are remembered (keys: chunk without its
    leading space). Special strings are matched first, as the library does.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def work(self, chunk: str) -> bytes:
        return self.encode(" " + chunk)

    @cached_property
    def ranked(self) -> tiktoken.Encoding | None:
        """The same vocabulary as ranks, for tokenizers with the common byte-level pattern, no normalizer, and merges in the order of their ids."""
        own = json.loads(self.tokenizer.to_str())
        split, model = own["pre_tokenizer"] or {}, own["model"]
        usual = own["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        if not usual or model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            return None
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged):
            return None
        byte = {chr(shown): b for b, shown in {**{b: b for b in range(256)}, **_SHOWN}.items()}
        made = {t for m in model["merges"] for t in ("".join(m if isinstance(m, list) else m.split(" ")),)}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if len(t) == 1 or t in made}
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.ranked is not None:
            return array("I", self.ranked.encode_ordinary(text)).tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.split is not None and any(s in text for s in self.special):
            return b"".join(np.array([self.special[t]], "<u4").tobytes() if t in self.special else self.plain(t) for t in self.split.split(text))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ") if even(text) else _CUT.split(text)
        return self.encode(first) + b"".join(map(self.__getitem__, rest))


def even(text: str) -> bool:
    """Every space of a non-empty text stands between two characters that are not white space."""
    if "  " in text or text[0] == " " or text[-1] == " " or not (text.isascii() or _WIDE.search(text) is None):
        return False
    return not any(w in text and (" " + w in text or w + " " in text) for w in _NARROW)


#: Byte-level alphabet: bytes that are no printable Latin-1 characters are shown from U+0100 on, in order.
_SHOWN = {b: 256 + k for k, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}
#: ASCII signs, which stand together in one pre-token; the apostrophe may begin another.
_SIGNS = string.punctuation.replace("'", "")
#: Letters before U+0250 as the alphabet shows the bytes of their lower case.
_LATIN = {chr(c): chr(c).lower().encode().decode("latin-1").translate(_SHOWN) for c in range(0x250)}


class WordPieces(Memory):
    """Pre-tokens of chunks between spaces and line feeds, by the tokenizer's own normalizer and pre-tokenizer.

    For tokenizers whose pre-tokens never contain white space, so that chunks are independent. Plain
    Latin words, with or without signs at their end, take a short way to the same pre-tokens.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def work(self, chunk: str) -> list[str]:
        t = self.tokenizer
        word = chunk.rstrip(_SIGNS)
        if self.plain_words and word.isalpha():
            sign = [] if len(word) == len(chunk) else [chunk[len(word) :]]
            if word.isascii():
                return [word.lower(), *sign]
            if max(word) < "\u0250" and "\u0130" not in word:
                return ["".join(map(_LATIN.__getitem__, word)), *sign]
        norm = t.normalizer.normalize_str(chunk) if t.normalizer is not None else chunk
        return [p for p, _ in t.pre_tokenizer.pre_tokenize_str(norm)]

    @cached_property
    def plain_words(self) -> bool:
        """The tokenizer lower-cases, shows bytes as the byte-level alphabet does and keeps signs together (probed once)."""
        if self.tokenizer.normalizer is None:
            return False
        probe = "\u00c9\u00e0\u00f1\u00dfX"
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(probe + _SIGNS))
        return [p for p, _ in cut] == ["".join(map(_LATIN.__getitem__, probe)), _SIGNS]

    def chunks(self, text: str | None) -> list[str]:
        """Chunks of a text; a special string is a chunk of its own, marked by a leading line feed."""
        if not text:
            return []
        if self.split is not None and any(s in text for s in self.special):
            return [c for t in self.split.split(text) for c in (["\n" + t] if t in self.special else self.chunks(t))]
        return [c for c in text.replace("\n", " ").split(" ") if c]

    def pretokens(self, chunk: str) -> list[str]:
        return [chunk] if chunk[0] == "\n" else self[chunk]

    @cached_property
    def pieces(self) -> Pieces:
        return Pieces(self.tokenizer)


class Pieces(Memory):
    """Number of pieces of a pre-token; a special string is one."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.model = tokenizer.model

    def work(self, pretoken: str) -> int:
        return 1 if pretoken[0] == "\n" else len(self.model.tokenize(pretoken))


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


@lru_cache(maxsize=4)
def word_pieces(path: str) -> WordPieces:
    return WordPieces(path)


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file, the same on every executor."""
    return public_tokenizers.path(name)
