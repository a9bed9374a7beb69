"""Quality rules: base counts, and divergence of a text's histograms from references of its language."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skygauge.llm.columns import with_columns
from skygauge.llm.storage import land

SYMBOLS = "#*$%&|<>"
#: Common words of a reference, and the least words (of documents that pass the base rules) that make one.
N_COMMON, LEAST_WORDS = 50, 5_000


@dataclass(frozen=True)
class Limits:
    """(least length, largest distance) pairs: characters for class histograms, words for common-word histograms."""

    classes: tuple = ((300, 0.28),)
    common: tuple = ((100, 0.36), (300, 0.32))


CLASSES = ("lower", "upper", "digit", "space", "break", "stop", "symbol", "other ascii", "lower letter", "upper letter", "other", "far")


def _class_of(c: str) -> int:
    if c.isascii():
        tests = (c.islower(), c.isupper(), c.isdigit(), c == " ", c.isspace(), c in ".,;:'\"?!()-", c in SYMBOLS)
        return tests.index(True) if True in tests else 7
    return 8 if c.islower() else 9 if c.isupper() else 10


#: Class of every code point below 592 (the Latin blocks); all others are "far".
_TABLE = np.array([_class_of(chr(i)) for i in range(0x250)] + [11], np.int64)


def class_histogram(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.bincount(_TABLE[np.minimum(points, 0x250)], minlength=len(CLASSES))


def script(text: str, classes: np.ndarray) -> str:
    """Where most of a text's letters come from: the Latin blocks, or else the commonest block of 256 code points, East Asian ideographs and syllables as one."""
    if classes[-1] <= classes[[0, 1, 8, 9]].sum():
        return "latin"
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    block = int(np.bincount(points[points >= 0x250] >> 8).argmax())
    return "east" if 0x2E <= block <= 0x9F or 0xAC <= block <= 0xD7 or 0x200 <= block <= 0x323 else f"block {block}"


def base_counts(text: str | None) -> tuple[tuple[int, int, int, int, int], list[bytes]]:
    """((n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), words) of a whole text."""
    if not text:
        return (0, 0, 0, 0, 0), []
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    grams = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    repeated = 0
    if len(seen := Counter(grams)) < len(grams):
        end = 0  # words before it are counted
        for i, g in enumerate(grams):
            if seen[g] > 1:
                repeated += i + 5 - max(i, end)
                end = i + 5
    return (len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated), words


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


@dataclass
class Reference:
    """Counts of one language: character classes, its common words, all words, and its script."""

    classes: np.ndarray = field(default_factory=lambda: np.zeros(len(CLASSES)))
    common: dict[bytes, float] = field(default_factory=dict)
    n_words: float = 0.0
    script: str = ""

def references(docs: DataFrame, n_common: int = N_COMMON, least_words: int = LEAST_WORDS) -> dict[str, Reference]:
    """A reference for every value of ``lang`` whose documents that pass the base rules have ``least_words`` words together.

    Words are counted in each task and summed; only the ``n_common`` most frequent words of a
    language and its class counts come to the driver, for languages with a reference only.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}
        scripts: dict[str, Counter] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for lang, c in held.items():
                yield pd.DataFrame({"lang": lang, "kind": "word", "item": list(c), "n": list(c.values())})
                yield pd.DataFrame({"lang": lang, "kind": "all", "item": b"", "n": [sum(c.values())]})
                yield pd.DataFrame({"lang": lang, "kind": "class", "item": [str(i).encode() for i in range(len(CLASSES))], "n": classes[lang]})
                yield pd.DataFrame({"lang": lang, "kind": "script", "item": [k.encode() for k in scripts[lang]], "n": list(scripts[lang].values())})
            for x in (held, classes, scripts):
                x.clear()

        for pdf in batches:
            for lang, text in zip(pdf.lang, pdf.text):
                if lang is None:
                    continue
                (n, _, _, _, again), words = base_counts(text)
                if base_failed(n, again):
                    continue
                held.setdefault(lang, Counter()).update(words)
                own = class_histogram(text)
                classes[lang] = classes.get(lang, 0) + own
                scripts.setdefault(lang, Counter())[script(text, own)] += len(text)
                if sum(map(len, held.values())) > 400_000:
                    yield from flush()
        yield from flush()

    counted = docs.select("lang", "text").mapInPandas(count, "lang string, kind string, item binary, n long")
    total = counted.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item")
    top = land(total.withColumn("place", F.row_number().over(first)).where(F.col("place") <= n_common), "references")
    spoken = top.where((F.col("kind") == "all") & (F.col("n") >= least_words)).select("lang")
    out: dict[str, Reference] = {}
    for r in top.join(spoken, "lang", "left_semi").collect():
        ref = out.setdefault(r["lang"], Reference())
        if r["kind"] == "class":
            ref.classes[int(r["item"])] = r["n"]
        elif r["kind"] == "word":
            ref.common[bytes(r["item"])] = float(r["n"])
        elif r["kind"] == "all":
            ref.n_words = float(r["n"])
        elif r["place"] == 1:
            ref.script = bytes(r["item"]).decode()
    return out


def divergence(rows: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (0 to 1) of every row's distribution to the reference's; empty rows: 0."""
    total = rows.sum(axis=1, keepdims=True)
    p, q = rows / np.maximum(total, 1), reference / reference.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1) + np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip(gain / 2, 0, 1)), 0.0)


def _over(length: np.ndarray, distance: np.ndarray, limits: tuple) -> np.ndarray:
    return np.any([(length >= least) & (distance > most) for least, most in limits], axis=0)


def judge(docs: DataFrame, limits: Limits = Limits(), n_common: int = N_COMMON, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance,
    common_distance, base_failed and kept.

    Words are runs of other characters than the six ASCII white spaces. Every value of ``lang`` with
    ``least_words`` words has a reference, made from all its documents that pass the base rules. A text that passes them is
    rejected if its character classes or its common words are farther (Jensen-Shannon) from the
    reference of its own language than ``limits`` allow for its length, and, since labels of languages err, from
    every other reference of the same script as well; shorter texts have no verdict and stay. So do
    texts of a language without a reference (distances null). A text without a language is
    held against the classes of the nearest reference of its script, if there is one, and never against words.

    Null and empty texts have no words and fail the base rules. Repeated rows are judged alike. An
    empty table gives no rows. Columns of the same names are replaced, others stay as they are.
    """
    refs = references(docs, n_common, least_words)
    places = {lang: {w: i for i, w in enumerate(r.common)} for lang, r in refs.items()}
    others = {lang: np.append(list(r.common.values()), max(r.n_words - sum(r.common.values()), 0.0)) for lang, r in refs.items()}

    def common(words: list[bytes], lang: str) -> np.ndarray:
        place = places[lang]
        found = np.bincount([*map(place.__getitem__, filter(place.__contains__, words)), len(place)], minlength=len(place) + 1)
        found[-1] = len(words) - found[:-1].sum()
        return found.astype(float)

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        base, classes, scripts = [], np.zeros((len(pdf), len(CLASSES))), []
        counted: dict[str, list[tuple[int, np.ndarray]]] = {}
        for i, (lang, text) in enumerate(zip(pdf["lang"], pdf["text"])):
            counts, words = base_counts(text)
            base.append(counts)
            if not words:
                continue
            classes[i] = class_histogram(text)
            if lang is None:
                scripts.append((i, script(text, classes[i])))
            elif lang in refs:
                counted.setdefault(lang, []).append((i, common(words, lang)))
        base = np.array(base, np.int64).reshape(-1, 5)
        n = base[:, 0]
        by_class, by_word = np.full(len(pdf), np.nan), np.full(len(pdf), np.nan)
        for lang, rows in counted.items():
            own = [i for i, _ in rows]
            by_class[own] = divergence(classes[own], refs[lang].classes)
            by_word[own] = divergence(np.stack([x for _, x in rows]), others[lang])
        for i, kind in scripts:
            near = [divergence(classes[i : i + 1], r.classes)[0] for r in refs.values() if r.script == kind]
            by_class[i] = min(near, default=np.nan)
        failed = (n < 10) | (100 * base[:, 4] > 20 * n)
        chars = classes.sum(axis=1)
        far = _over(chars, by_class, limits.classes) | _over(n, by_word, limits.common)
        for i in np.flatnonzero(far & ~failed & ~np.isnan(by_word)):
            words = base_counts(pdf["text"].iloc[i])[1]
            near = [k for k, r in refs.items() if r.script == refs[pdf["lang"].iloc[i]].script]
            by_class[i] = min(divergence(classes[i : i + 1], refs[k].classes)[0] for k in near)
            by_word[i] = min(divergence(common(words, k)[None], others[k])[0] for k in near)
        far = _over(chars, by_class, limits.classes) | _over(n, by_word, limits.common)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        return pd.DataFrame({name: base[:, k] for k, name in enumerate(names)}).assign(class_distance=by_class, common_distance=by_word, base_failed=failed, kept=~failed & ~far)

    added = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_distance double, common_distance double, base_failed boolean, kept boolean"
    return with_columns(docs, measure, added, ["lang", "text"])
