"""Main text of HTML pages: a linear-chain field over leaf blocks decides which of them are the article."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge.llm.chain import Chain
from skygauge.llm.columns import with_columns
from skygauge.llm.dom import Block, leaf_blocks
from skygauge.llm.labelled_pages import ROLES, WHOLE, page

_PART = re.compile(r"[a-z]+(?:-hidden)?")
_SENTENCE = re.compile(r"[.!?…][\s\"'»”)]|[.!?…]$")
#: Names that say what a page has, not what a part is.
_STATE = re.compile(r"\b(?:has|with|no|is|single|page|layout)-[\w-]*")


@lru_cache(maxsize=100_000)
def roles(marks: str) -> tuple[str, ...]:
    """Roles that a class, id or role attribute names."""
    found = set()
    for part in _PART.findall(_STATE.sub(" ", marks) if "is-hidden" not in marks else marks):
        for role, keys in ROLES.items():
            if any(part == k if k in WHOLE else k in part for k in keys):
                found.add(role)
    return tuple(sorted(found))


def shared(blocks: list[Block]) -> int:
    """Length of the ancestors that all blocks have in common, a block's own element aside."""
    first, last = min(b.path[:-1] for b in blocks), max(b.path[:-1] for b in blocks)
    return next((n for n, (x, y) in enumerate(zip(first, last)) if x != y), min(len(first), len(last)))


@lru_cache(maxsize=100_000)
def path_features(path: tuple[tuple[str, str], ...], n_shared: int = 0) -> tuple[str, ...]:
    """Features of a block's ancestors: tags, roles named by them, the innermost of both.

    What is named by the page, its body or any wrapper around all blocks says nothing about one of
    them, unless it is a mark of an article.
    """
    path = tuple((t, m) for t, m in path[:n_shared] if t in ("article", "main")) + path[n_shared:]
    path = tuple((t, m) for t, m in path if t not in ("html", "body"))
    tags = [t for t, _ in path]
    named = [r for _, m in path if m for r in roles(m)]
    near = [r for _, m in path[-3:] if m for r in roles(m)]
    out = {f"in {t}" for t in tags} | {f"role {r}" for r in named} | {f"near {r}" for r in near}
    out.add(f"own {tags[-1] if tags else 'body'}")
    if "article" in tags:
        out |= {f"article>{t}" for t in tags[tags.index("article") + 1 :]} | {f"article~{r}" for r in named}
    out.add("marked" if set(named) - {"content"} else "unmarked")
    return tuple(sorted(out))


def block_features(blocks: list[Block]) -> list[list[str]]:
    rows = []
    n_shared = shared(blocks) if blocks else 0
    for n, b in enumerate(blocks):
        size, text = len(b.text), b.text
        row = [
            "bias", *path_features(b.path, n_shared), f"size {min(9, size.bit_length())}", f"linked {min(4, round(4 * b.linked / max(1, size)))}",
            f"end {'.' if text[-1] in '.!?…' else ',' if text[-1] in ',;:' else 'w'}", f"place {min(3, n)}", f"left {min(3, len(blocks) - 1 - n)}",
        ]
        row.append(f"sentences {min(3, len(_SENTENCE.findall(text)))}")
        if text[0] in "©®" or "copyright" in text[:40].lower() or "all rights reserved" in text.lower():
            row.append("copyright")
        if "·" in text or " | " in text:
            row.append("separators")
        rows.append(row)
    for n, b in enumerate(blocks):
        rows[n].append("same before" if n and blocks[n - 1].path[:-1] == b.path[:-1] else "new before")
    return rows


@lru_cache(maxsize=2)
def trained(n_pages: int = 800, seed: int = 17) -> Chain:
    """The field, fitted on ``n_pages`` labelled pages drawn by rule (``labelled_pages``); no row of a table is used."""
    rng = np.random.default_rng(seed)
    ready = []
    for _ in range(n_pages):
        text, gold = page(rng)
        blocks = leaf_blocks(text)
        label = {}
        for t, y in gold:
            label.setdefault(" ".join(t.split()), y)
        ready.append((block_features(blocks), [label[b.text] for b in blocks]))
    return Chain().fit(ready)


def main_text(page_html: str | None, model: Chain) -> str:
    """Article blocks in page order, joined by two line feeds."""
    blocks = leaf_blocks(page_html)
    labels = model.decode(block_features(blocks))
    return "\n\n".join(b.text for b, y in zip(blocks, labels) if y)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with the article of ``html`` as ``text`` and its code points as ``n_chars``.

    Null and empty pages, pages without an article and pages of markup only have an empty text.
    Pages are read whole, whatever their length; broken markup is taken as browsers mostly do.
    Repeated rows are treated alike. Columns named text and n_chars are replaced, others stay.
    """
    model = trained()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"text": [main_text(h, model) for h in pdf["html"]]})

    return with_columns(pages.drop("n_chars"), run, "text string", ["html"]).withColumn("n_chars", F.length("text").cast("long"))
