"""Columns added by Python to rows that otherwise stay as they are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Rows whose used columns are Python objects at a time.
ROWS = 1024
_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def with_columns(docs: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], added: str, uses: list[str]) -> DataFrame:
    """``docs`` with the columns ``added`` ("name type, ...") that ``fn`` makes of the columns ``uses``; columns of those names are replaced.

    Only ``uses`` become pandas columns. All others pass as Arrow columns, so NaN, nulls, whole numbers
    and nested values of a user's own columns come back as they were.
    """
    new = [x.split() for x in added.split(", ")]
    names = {n for n, _ in new}
    kept = [f for f in docs.schema.fields if f.name not in names]
    at = {f.name: i for i, f in enumerate(kept) if isinstance(f.dataType, T.StringType)}
    # what is used but replaced, or is no string, travels under a name of its own; texts that stay travel once
    apart = [c for c in uses if c not in at]
    at |= {c: len(kept) + i for i, c in enumerate(apart)}
    sent = docs.select(*[docs[f"`{f.name}`"] for f in kept], *[docs[f"`{c}`"].cast("string").alias(f"_used_{i}") for i, c in enumerate(apart)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(kept)
        for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
            out = fn(pd.DataFrame({c: batch.column(at[c]).to_pandas() for c in uses}))
            made = [pa.array(out[name], type=_ARROW[kind], from_pandas=True) for name, kind in new]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], names=[*batch.schema.names[:n], *[name for name, _ in new]])

    return sent.mapInArrow(run, T.StructType(kept + list(T._parse_datatype_string(added).fields)))
