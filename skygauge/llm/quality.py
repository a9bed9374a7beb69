"""Quality classifier: boosted trees over document statistics, learnt from labelled documents."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge.llm.boosting import Boosted, fit
from skygauge.llm.rules import CLASSES, base_counts, class_histogram
from skygauge.llm.text import words

#: Labelled rows that the model is fitted on, at most about this many (chosen by a hash of doc_id).
SAMPLE, FOLDS, THRESHOLD = 40_000, 5, 0.3
STATISTICS = (
    "words", "characters", "word length", "word length spread", "distinct words", "top word", "top pair", "repeated words", "lines", "line length",
    "repeated lines", "short lines", "words with letters", "words ending in a sign", "words in capitals", "capitalised words", "longest word",
    "words of 1 to 3 characters", "runs of one character", "class entropy", *(f"share of {c}" for c in CLASSES),
)


def statistics(text: str | None) -> np.ndarray:
    """The numbers of STATISTICS for a whole text; zeros without words."""
    tokens = words(text)
    out = np.zeros(len(STATISTICS))
    if not tokens:
        return out
    n = len(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, n)
    seen = Counter(tokens)
    pairs = Counter(zip(tokens, tokens[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    widths = np.fromiter(map(len, lines), np.int64, len(lines)) if lines else np.zeros(1)
    kinds = class_histogram(text)
    share = kinds / max(1, kinds.sum())
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    distinct = [(w, c) for w, c in seen.items()]
    of = lambda test: sum(c for w, c in distinct if test(w)) / n
    (_, _, _, _, repeated), _ = base_counts(text)
    out[:20] = (
        np.log1p(n), np.log1p(len(text)), sizes.mean(), sizes.std(), len(seen) / n, max(seen.values()) / n, max(pairs.values(), default=0) / n, repeated / n,
        np.log1p(len(lines)), np.log1p(widths.mean()), 1 - len(set(lines)) / max(1, len(lines)), (widths < 30).mean(), of(bytes.isalpha),
        of(lambda w: w[-1] in b"#*$%&|<>!^~"), of(bytes.isupper), of(bytes.istitle), np.log1p(sizes.max()), (sizes <= 3).mean(),
        (points[1:] == points[:-1]).mean() if len(points) > 1 else 0.0, -(share[share > 0] * np.log2(share[share > 0])).sum(),
    )
    out[20:] = share
    return out


def fold(doc_id: str = "doc_id", folds: int = FOLDS):
    """crc32 of the id as text modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Boosted:
    """Trees from the labelled documents outside fold 0; at most about ``sample`` of them, whatever the table's size."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    usable = usable.where("quality in (0, 1) and doc_id is not null").where(fold() != 0)
    total = usable.count()
    part = min(2**31, int(2**31 * sample / max(1, total)) + 1)
    usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(2**31)) < part)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(usable, "doc_id").select("text", "quality")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"x": [statistics(t) for t in pdf.text], "quality": pdf.quality})

    got = rows.mapInPandas(measure, "x array<double>, quality int").toPandas()
    if got.empty:
        return fit(np.zeros((0, len(STATISTICS))), np.zeros(0))
    x, y = np.stack(got.x.to_numpy()), got.quality.to_numpy(np.float64)
    order = np.lexsort((*x.T, y))  # rows arrive in any order; sums do not depend on it
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Boosted, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out (fold 0), score (0 to 1, higher: label 1 likelier), predicted, for every whole text.

    Null and empty texts have the statistics of a text without words. Null ids belong to the fold of
    an empty text. Repeated rows get equal scores. An empty table gives no rows. Extra columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack([statistics(t) for t in pdf.text]) if len(pdf) else np.zeros((0, len(STATISTICS)))
            yield pd.DataFrame({"doc_id": pdf.doc_id, "held_out": pdf.held_out, "score": shared.value.score(x)})

    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), (fold() == 0).alias("held_out"), "text")
    scored = rows.mapInPandas(run, "doc_id string, held_out boolean, score double")
    return scored.select(F.col("doc_id").cast("long"), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
