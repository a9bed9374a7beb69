"""Fill-in-middle documents, assembled from pieces by a secondary sort and taken apart again."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Units of one piece and its most code points; units and code points looked at in one go.
CHUNK, MOST_CHARS, SLICE = 1024, 16_384, 1 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARK = re.compile(f"{PREFIX}|{SUFFIX}|{MIDDLE}")
#: Order of the sections in the output; in the text it is prefix, middle, suffix.
_ORDER = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
_TEXT_PLACE = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
#: Ids travel as text: a column of numbers with nulls would become floats in pandas.
_KEY = "part int, code long, doc_id string"
_FACTS = "form string, n long, prefix_chars long, middle_chars long"


def draws(doc_id: str | None) -> list[int]:
    """The four numbers that decide over a document; a null id counts as an empty one."""
    code = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(code[i : i + 8], 16) for i in range(0, 32, 8)]


def unit_starts(text: str) -> Iterator[tuple[int, np.ndarray]]:
    """Per slice of a text: place of the slice and places in it where a unit begins (a run of ASCII letters, or another code point)."""
    before = False
    for at in range(0, len(text), SLICE):
        code = np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "surrogatepass"), "<u4")
        letter = ((code | 32) >= 97) & ((code | 32) <= 122)
        inside = letter.copy()
        inside[1:] &= letter[:-1]
        inside[0] &= before
        before = bool(letter[-1])
        yield at, np.flatnonzero(~inside)


def cuts(text: str, chunk: int) -> tuple[int, np.ndarray]:
    """Number of units of a text, and the place of every ``chunk``-th one."""
    n, places = 0, []
    for at, starts in unit_starts(text):
        places.append(starts[(-n) % chunk :: chunk] + at)
        n += len(starts)
    return n, np.concatenate(places) if places else np.empty(0, np.int64)


def place_of(text: str, marks: np.ndarray, chunk: int, unit: int, n: int) -> int:
    """Code points before the ``unit``-th unit, looked for between two marks, so no list of all units is held."""
    if unit == n:
        return len(text)
    k, left = divmod(unit, chunk)
    at = int(marks[k])
    for start, starts in unit_starts(text[at : int(marks[k + 1]) if k + 1 < len(marks) else len(text)]):
        if left < len(starts):
            return at + start + int(starts[left])
        left -= len(starts)
    raise AssertionError("a mark has fewer units behind it than it should")


def sections(doc_id: str | None, text: str, chunk: int) -> tuple[str, int, int, int, np.ndarray]:
    """Form, number of units, ends of prefix and middle in code points, and the places of every ``chunk``-th unit."""
    h1, h2, h3, h4 = draws(doc_id)
    n, marks = cuts(text, chunk)
    if not text or h3 % 100 >= 90 or _MARK.search(text):
        return "plain", n, 0, 0, marks
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = place_of(text, marks, chunk, low, n), place_of(text, marks, chunk, high, n)
    return ("spm" if h4 % 100 < 20 else "psm"), n, a, b, marks


def cut_up(text: str, a: int, b: int, marks: np.ndarray) -> Iterator[str]:
    """Pieces of text[a:b], cut before every marked unit and where one has too many code points; one empty piece if there is nothing."""
    inner = marks[np.searchsorted(marks, a, "right") : np.searchsorted(marks, b, "left")]
    bounds = [a, *inner.tolist(), b]
    for x, y in zip(bounds, bounds[1:]):
        for i in range(x, max(y, x + 1), MOST_CHARS):
            yield text[i : min(i + MOST_CHARS, y)]


def output_pieces(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(part, code, doc_id, pos, form, n, prefix_chars, middle_chars, piece): each document's output in bounded pieces.

    A document is keyed by its id, a hash of its text and the partition it was read from, so that any
    number of repeated rows is spread, and nothing depends on the order in which rows arrive. ``pos``
    numbers a document's pieces in the order of the output; a section begins with a piece that begins
    with its mark. The facts of a document ride on its first piece. Repeated rows of a partition give
    each piece repeatedly.
    """

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        held = 0
        for pdf in batches:
            for part, code, key, text in zip(pdf.part, pdf.code, pdf.doc_id, pdf.text):
                text = text or ""
                form, n, a, b, marks = sections(key, text, chunk)
                spans = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, len(text))}
                facts: tuple = (form, n, a, b - a) if form != "plain" else (form, n, None, None)
                pos = 0
                for mark, span in [(m, spans[m]) for m in _ORDER[form]] if form != "plain" else [("", (0, len(text)))]:
                    for k, piece in enumerate(cut_up(text, *span, marks)):
                        rows.append((part, code, key, pos, *(facts if pos == 0 else (None,) * 4), mark + piece if k == 0 else piece))
                        pos, held = pos + 1, held + len(piece)
                        if len(rows) >= 4096 or held > 1 << 23:
                            yield _frame(rows)
                            rows, held = [], 0
        if rows:
            yield _frame(rows)

    given = docs.select(
        F.spark_partition_id().alias("part"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("code"),
        F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"),
    )
    return given.mapInPandas(emit, f"{_KEY}, pos int, {_FACTS}, piece string")


_NULLABLE = {"n": "Int64", "prefix_chars": "Int64", "middle_chars": "Int64"}


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["part", "code", "doc_id", "pos", "form", "n", "prefix_chars", "middle_chars", "piece"]).astype(_NULLABLE)


def assembled(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The output pieces, each document in one partition and in the order of its output: a secondary sort.

    This is ``repartitionAndSortWithinPartitions`` with the sort and its spilling on the JVM's side.
    A task streams its pieces and never holds a document, however long.
    """
    return output_pieces(docs, chunk).repartition("part", "code", "doc_id").sortWithinPartitions("part", "code", "doc_id", "pos")


NEW, NEXT, COPY = range(3)
_SHOWN = ["cast(doc_id as long) as doc_id", "n", "form", "prefix_chars", "middle_chars"]


def _streamed(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, tuple]]:
    """Sorted pieces, each NEW (first of a document), NEXT, or COPY (first piece of a repeated row, whose later pieces are left out)."""
    last, pos = None, -1
    for pdf in batches:
        for row in zip(*(pdf[c] for c in pdf.columns)):
            if row[:3] != last:
                last, pos = row[:3], row[3]
                yield NEW, row
            elif row[3] != pos:
                pos = row[3]
                yield NEXT, row
            elif pos == 0:
                yield COPY, row


def fill_in_middle(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output.

    A document's text is cut into n units (runs of ASCII letters, other code points one by one); three
    of four numbers drawn from its id place the middle and choose the form: ``psm`` is <P>prefix<S>suffix<M>middle,
    ``spm`` is <S>suffix<P>prefix<M>middle, ``plain`` is the text itself (empty texts, texts with one of
    the marks, and one in ten). ``output`` is made from streamed pieces; use ``assembled`` where a
    document is too long for one row.

    Null texts are empty ones; a null id draws like an empty one. Repeated rows give repeated rows; rows of the same id
    with different texts are documents of their own. An empty table gives no rows. Extra columns are ignored.
    """

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        facts: tuple | None = None
        parts: list[str] = []
        copies = 0
        for kind, row in _streamed(batches):
            if kind == COPY:
                copies += 1
                continue
            if kind == NEW:
                if facts is not None:
                    yield _texts(facts, "".join(parts), copies)
                facts, parts, copies = (row[2], *row[4:8]), [], 1
            parts.append(row[8])
        if facts is not None:
            yield _texts(facts, "".join(parts), copies)

    return assembled(docs, chunk).mapInPandas(join, f"doc_id string, {_FACTS}, output string").selectExpr(*_SHOWN, "output")


def _texts(facts: tuple, text: str, copies: int) -> pd.DataFrame:
    return pd.DataFrame([(*facts, text)] * copies, columns=["doc_id", "form", "n", "prefix_chars", "middle_chars", "output"]).astype(_NULLABLE)


def restore(output: str, form: str) -> str:
    """The text of an output: its sections, told apart by the marks, in the order of the text."""
    if form == "plain":
        return output
    parts = re.split(f"({_MARK.pattern})", output)
    section = dict(zip(parts[1::2], parts[2::2]))
    return section[PREFIX] + section[MIDDLE] + section[SUFFIX]


def digests(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256.

    The assembled pieces run through a digest of the output. Each piece is then given its place in the
    text, read from the marks in the output and the form alone; the pieces are sorted anew within
    their partition, where a document's pieces already are, and run through a digest of the restored
    text. No task holds a document. Cases as for ``fill_in_middle``.
    """

    def out_digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        held = 0
        now = None
        for kind, row in _streamed(batches):
            if kind == COPY:
                now["copies"] += 1
                continue
            if kind == NEW:
                if now is not None:
                    rows.append(_end(now))
                now = {"key": row[:3], "facts": row[4:8], "sha": hashlib.sha256(), "section": 0, "pos": 0, "copies": 1}
            piece = row[8]
            now["sha"].update(piece.encode("utf-8", "surrogatepass"))
            if now["facts"][0] != "plain" and piece[:3] in _TEXT_PLACE:
                now["section"], piece = _TEXT_PLACE[piece[:3]], piece[3:]
            rows.append((*now["key"], now["section"], now["pos"], None, None, None, None, None, None, piece))
            now["pos"] += 1
            held += len(piece)
            if len(rows) >= 4096 or held > 1 << 23:
                yield _steps(rows)
                rows, held = [], 0
        if now is not None:
            rows.append(_end(now))
        if rows:
            yield _steps(rows)

    def text_digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        facts, sha = None, None
        for pdf in batches:
            for row in zip(*(pdf[c] for c in pdf.columns)):
                if row[3] < 0:  # the facts, sorted before the pieces
                    if facts is not None:
                        rows += _result(facts, sha)
                    facts, sha = row, hashlib.sha256()
                else:
                    sha.update(row[11].encode("utf-8", "surrogatepass"))
            if rows:
                yield _results(rows)
                rows = []
        if facts is not None:
            yield _results(_result(facts, sha))

    stepped = assembled(docs, chunk).mapInPandas(out_digest, f"{_KEY}, section int, pos int, {_FACTS}, output_sha256 string, copies long, piece string")
    return stepped.sortWithinPartitions("part", "code", "doc_id", "section", "pos").mapInPandas(
        text_digest, f"doc_id string, {_FACTS}, output_sha256 string, restored_sha256 string"
    ).selectExpr(*_SHOWN, "output_sha256", "restored_sha256")


def _end(now: dict) -> tuple:
    return (*now["key"], -1, -1, *now["facts"], now["sha"].hexdigest(), now["copies"], None)


def _steps(rows: list[tuple]) -> pd.DataFrame:
    names = ["part", "code", "doc_id", "section", "pos", "form", "n", "prefix_chars", "middle_chars", "output_sha256", "copies", "piece"]
    return pd.DataFrame(rows, columns=names).astype(_NULLABLE | {"copies": "Int64"})


def _result(facts: tuple, sha) -> list[tuple]:
    _, _, doc_id, _, _, form, n, a, b, out, copies, _ = facts
    return [(doc_id, form, n, a, b, out, sha.hexdigest())] * int(copies)


def _results(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_id", "form", "n", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]).astype(_NULLABLE)
